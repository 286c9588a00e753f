"""Passages of many words that stand in more than one text.

A passage repeats if some window of ``words`` words of a text stands in the text of another row.
Windows are found as in suffix dedup: the GRAM-word string of the least hash in a window is its anchor,
so equal windows have equal anchors at the same place, and the windows of one anchor are neighbours (a
stretch). Texts with an equal stretch are settled by one hash for the stretch. For the others the
windows of those anchors that another text has are counted one by one. Texts with equal rows are
settled by counting rows. Words are separated by blank and 0x09-0x0D and compared exactly.

Cases: null and empty texts and texts of fewer words have no passage; repeated rows repeat each other;
very long texts are taken in segments; other columns are not read. Texts, anchors and windows are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .wordhash import BLOCK, batches_of, hash_words, mix, powers, shingle

WORDS, GRAM = 51, 16
#: Windows per segment of a long text.
SEGMENT = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)


def stretches(words: np.ndarray, size: int = WORDS, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: its words, and of each stretch the anchor's hash and place, first and last window."""
    w = size - gram + 1
    for start in range(0, len(words) - size + 1, SEGMENT):
        part = words[start : start + SEGMENT + size - 1]
        key = mix(shingle(part, gram))
        n = len(key)
        v = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
        v[:n] = (key & ~_LOW) | np.arange(n, dtype=np.uint64)
        v = v.reshape(-1, w)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        place = at[first]
        yield part, key[place], place, first, last


def _sums(part: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of the words modulo 2**64."""
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(mix(part) * powers()[0][: len(part)], out=sums[1:])
    return sums


def marks_of(words: np.ndarray, size: int = WORDS, gram: int = GRAM) -> np.ndarray:
    """A text's distinct marks: hashes of its anchors (even) and of its stretches (odd)."""
    _, down = powers()
    out = []
    for part, key, place, first, last in stretches(words, size, gram):
        sums = _sums(part)
        end = last + size
        whole = mix((sums[end] - sums[first]) * down[first] + mix((place - first).astype(np.uint64) + ((end - first).astype(np.uint64) << np.uint64(32))))
        out += [key & ~np.uint64(1), whole | np.uint64(1)]
    return np.unique(np.concatenate(out)) if out else words[:0]


def _list(values: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))


def _marks(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(th, marks) of each row with size words and more; of equal texts a task tells the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for b in batches:
            new = []
            for i, th in enumerate(b.column(0).to_pylist()):
                if th not in seen:
                    seen[th] = None
                    new.append(i)
                    if len(seen) > 100_000:
                        seen.pop(next(iter(seen)))
            b = b.take(pa.array(new, pa.int32()))
            raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            marks = []
            for i, j in batches_of(raws, [len(r) for r in raws], BLOCK):
                words, at = hash_words(raws[i:j])
                marks += [marks_of(words[at[k] : at[k + 1]], size, gram) for k in range(j - i)]
            out = pa.RecordBatch.from_arrays([b.column(0), _list(marks)], names=["th", "marks"])
            yield out.filter(pa.array([len(m) > 0 for m in marks], pa.bool_()))

    return docs.select("th", "text").mapInArrow(run, "th long, marks array<long>")


def windows_of(words: np.ndarray, wanted: np.ndarray, size: int = WORDS, gram: int = GRAM) -> np.ndarray:
    """Distinct hashes of a text's windows whose anchor's mark is wanted."""
    _, down = powers()
    out = []
    for part, key, _, first, last in stretches(words, size, gram):
        own = np.flatnonzero(np.isin(key & ~np.uint64(1), wanted))
        n = last[own] - first[own] + 1
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(own) else own
        sums = _sums(part)
        out.append(mix((sums[at + size] - sums[at]) * down[at]))
    return np.unique(np.concatenate(out)) if out else words[:0]


def _windows(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """texts (th, text, keys) to (th, h): hashes of the windows whose anchor is in keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, keys in zip(b.column(1), b.column(2), strict=True):
                words, _ = hash_words([(text.as_py() or "").encode("utf-8", "surrogatepass")])
                found.append(windows_of(words, keys.values.to_numpy().view(np.uint64), size, gram))
            th = np.repeat(b.column(0).to_numpy(), [len(h) for h in found])
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(h.view(np.int64))], names=["th", "h"])

    return texts.select("th", "text", "keys").mapInArrow(run, "th long, h long")


def _shared(rows: DataFrame) -> DataFrame:
    """rows (th, h) whose h another text has, too; counts are combined before the shuffle."""
    twice = rows.groupBy("h").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a != b").select("h")
    return rows.join(twice, "h", "left_semi")


def repeating_texts(docs: DataFrame, size: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(th): hashes of the texts of docs (th, text) with a passage that another row has; read from a
    table, one row a text."""
    marks = materialise(_marks(docs, size, gram))
    shared = materialise(_shared(marks.select("th", F.explode("marks").alias("h"))))
    odd = F.col("h").bitwiseAND(1) == 1
    copies = docs.groupBy("th").count().where("count > 1").join(marks.select("th"), "th", "left_semi").select("th")
    sure = materialise(shared.where(odd).select("th").union(copies).distinct())
    # Anchors that a text without an answer shares: all windows of theirs, in every text that has them.
    held = shared.where(~odd)
    asked = held.join(sure, "th", "left_anti").select("h").distinct()
    wanted = materialise(held.join(asked, "h", "left_semi").groupBy("th").agg(F.collect_set("h").alias("keys")))
    texts = docs.join(wanted.withColumnRenamed("th", "__t").hint("shuffle_hash"), F.col("th") == F.col("__t"))
    windows = materialise(_windows(texts, size, gram))
    out = materialise(sure.union(_shared(windows.distinct()).select("th")).distinct())
    discard(marks, shared, sure, wanted, windows)
    return out
