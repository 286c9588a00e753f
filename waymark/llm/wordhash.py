"""Vectorised hashes of the words of many texts at once (NumPy)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Bytes that a row counts besides its values, in parts().
ROW = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to BLOCK."""
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(BLOCK + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _one_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers()
    b = np.frombuffer(raw, dtype=np.uint8)
    n = len(b)
    gap = np.ones(n + 2, dtype=np.int8)
    gap[1:-1] = _SPACE[b]
    edge = np.diff(gap)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of a text over BLOCK bytes, cut at white space; a longer word is hashed by its
    pieces."""
    out, at = [], 0
    carry = None  # hash of the pieces of a word that is longer than a block
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            window = np.flatnonzero(_SPACE[np.frombuffer(raw[at:end], dtype=np.uint8)])
            if len(window):
                end = at + int(window[-1]) + 1
            else:
                piece = _one_block(raw[at:end])[1]
                carry = piece if carry is None else mix(carry * np.uint64(3) + piece)
                at = end
                continue
        h = _one_block(raw[at:end])[1]
        if carry is not None and len(h):
            if _SPACE[raw[at]]:
                h = np.concatenate((carry, h))
            else:
                h[:1] = mix(carry * np.uint64(3) + h[:1])
            carry = None
        out.append(h)
        at = end
    if carry is not None:
        out.append(carry)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in order, and each text's offset in them (one more at the end).
    Words are separated by blank and 0x09-0x0D."""
    parts, counts, i = [], np.zeros(len(raws) + 1, dtype=np.int64), 0
    while i < len(raws):
        if len(raws[i]) > BLOCK - 1:
            h = _long(raws[i])
            parts.append(h)
            counts[i + 1] = len(h)
            i += 1
            continue
        j, size = i, 0
        while j < len(raws) and size + len(raws[j]) + 1 <= BLOCK:
            size += len(raws[j]) + 1
            j += 1
        starts, h = _one_block(b"\n".join(raws[i:j]))
        ends = np.cumsum([len(x) + 1 for x in raws[i:j]])
        counts[i + 1 : j + 1] = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
        parts.append(h)
        i = j
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.cumsum(counts)


def shingle(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs that start at each word (the last k - 1 have none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : n + j]
    return mix(h)


def batches_of(items: list, sizes: list[int], most: int = BLOCK):
    """Consecutive index ranges of at most ``most`` bytes in all (single longer items alone)."""
    i = 0
    while i < len(items):
        j, total = i, 0
        while j < len(items) and (j == i or total + sizes[j] <= most):
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def parts(batches: Iterable[pa.RecordBatch], *wide: int | str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most about ``most`` bytes in the columns ``wide`` (single
    longer rows alone). Spark's batches have so many rows, whatever their length; what a worker makes of
    one at a time and sends back has a bound in bytes this way."""
    for b in batches:
        sizes = np.full(b.num_rows, ROW, dtype=np.int64)
        for c in wide:
            sizes += pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False)
        for i, j in batches_of(sizes, sizes.tolist(), most):
            yield b.slice(i, j - i)
