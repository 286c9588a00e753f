"""Suffix-array dedup: removes every byte that is covered by a string of LENGTH bytes that starts
somewhere else as well (in any document, the same included; overlaps count).

A suffix array over all bytes is many times the text, so only suffixes that can matter are sorted:

1. Anchors. In each window of LENGTH bytes the GRAM-byte string with the least hash is the anchor.
   Equal windows have the same anchor at the same offset, so the windows of one anchor (a stretch of
   neighbours) need to be compared with windows of equal anchors only. Anchor hashes are counted over
   all documents; those seen once are done with.
2. Runs. Each task sorts its remaining suffixes (from the anchor on; the bytes before it go along),
   collapses equal stretches, and writes front-coded runs: length of the prefix shared with the
   predecessor, then the rest. Runs are exchanged by a hash of the anchor.
3. Merge. A loser tree merges the runs of a bucket. Each entry knows how many bytes it shares with
   the last winner: the one that shares more comes first without looking at any byte, and equal ones
   are compared from there on. Neighbours that share GRAM bytes or more are a group; in a group, the
   windows that occur twice are found by the hashes (two of 64 bits, combined) of their content.
4. Anchors seen more than HOT times don't go to one bucket: their windows are counted one by one
   (128-bit hashes, combined before the shuffle) and joined back, so no task needs the whole group.
5. The covered intervals are joined with the documents, merged and cut out.

Cases: null and empty texts have no bytes and keep the digest of the empty string; texts shorter
than LENGTH stay whole; very long texts are taken in segments; repeated rows (equal doc_id and text)
are places of their own and so remove each other; a null doc_id is an ordinary value; extra columns
are not read. Cut UTF-8 sequences stay as they are (the digest is over bytes).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table
from .passages import repeating_texts
from .wordhash import mix, powers

LENGTH, GRAM = 400, 100
#: Occurrences of an anchor from which its windows are counted one by one.
HOT = 16_384
#: Windows per segment of a long text; bytes of suffixes in a task's run; bytes in a bucket.
SEGMENT, RUN_BYTES, BUCKET_BYTES = 1 << 18, 24 << 20, 24 << 20
_LOW = np.uint64(0xFFFFFFFF)
_SECOND = np.uint64(0x9FB21C651E98DF25)


def _sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of two polynomial hashes modulo 2**64."""
    up, _ = powers()
    x = b.astype(np.uint64) + np.uint64(1)
    one, two = np.zeros(len(b) + 1, np.uint64), np.zeros(len(b) + 1, np.uint64)
    np.cumsum(x * up[: len(b)], out=one[1:])
    np.cumsum(mix(x) * up[: len(b)], out=two[1:])
    return one, two


def _hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, down = powers()
    size = (end - start).astype(np.uint64)
    one = mix((sums[0][end] - sums[0][start]) * down[start] + size)
    return one, mix((sums[1][end] - sums[1][start]) * down[start] + size * _SECOND)


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, bytes, tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: its offset, bytes and sums, and of each anchor the key, its place, and its first
    and last window (all in the segment)."""
    _, down = powers()
    w = length - gram + 1
    for start in range(0, len(raw) - length + 1, SEGMENT):
        part = raw[start : start + SEGMENT + length - 1]
        b = np.frombuffer(part, np.uint8)
        sums = _sums(b)
        n = len(b) - gram + 1
        key = mix((sums[0][gram:] - sums[0][:n]) * down[:n])
        # Sliding minimum of hash and place: minima from block starts and to block ends.
        v = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
        v[:n] = (key & ~_LOW) | np.arange(n, dtype=np.uint64)
        v = v.reshape(-1, w)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        place = at[first]
        yield start, part, sums, key[place], place, first, last


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    return starts[edge], ends[np.concatenate((edge[1:] - 1, [len(ends) - 1]))] if len(edge) else ends


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while True:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + m - (d.bit_length() + 7) // 8 if d else known + m
        known += 64


def front_coded(suffixes: list[bytes], rest: list[tuple]) -> bytes:
    """A sorted run: shared prefix lengths, rests of the suffixes, and what goes along."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    share, tails, before = [], [], b""
    for i in order:
        s = suffixes[i]
        share.append(shared_prefix(before, s, 0))
        tails.append(s[share[-1] :])
        before = s
    raw = pickle.dumps((share, tails, [rest[i] for i in order]), protocol=5)
    return len(raw).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def run_entries(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(bytes shared with the predecessor, suffix, what goes along) of a front-coded run."""
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "big"), codec="zstd", asbytes=True)
    share, tails, rest = pickle.loads(raw)
    s = b""
    for h, t, r in zip(share, tails, rest, strict=True):
        s = s[:h] + t
        yield h, s, r


class LoserTree:
    """Merges sorted runs; entries (shared, suffix, rest) come out in order, shared with the entry
    that came out before."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, tuple]]]):
        self.runs = runs
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list[tuple[bytes, tuple] | None] = [None] * self.k
        self.share = [0] * self.k  # with the last winner
        for i, r in enumerate(runs):
            first = next(r, None)
            self.head[i] = first and (first[1], first[2])
        self.loser = [0] * self.k
        self.loser[0] = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length is then that with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, g = self.share[a], self.share[b]
        if h != g:  # the one that shares more with the last winner is less
            return (a, b) if h > g else (b, a)
        n = shared_prefix(x[0], y[0], h)
        p, q = x[0][n : n + 1], y[0][n : n + 1]
        if p <= q:
            self.share[b] = n
            return a, b
        self.share[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        while True:
            win = self.loser[0]
            out = self.head[win]
            if out is None:
                return
            yield self.share[win], *out
            nxt = next(self.runs[win], None) if win < len(self.runs) else None
            self.head[win] = nxt and (nxt[1], nxt[2])
            self.share[win] = nxt[0] if nxt else 0
            node = (win + self.k) >> 1
            while node:
                win, self.loser[node] = self._play(win, self.loser[node])
                node >>= 1
            self.loser[0] = win


def windows_twice(members: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """members: (bytes before the anchor and suffix together, windows, anchor's offset), of any
    number of groups. For each, which of its windows occurs twice or more."""
    total = sum(m[1] for m in members)
    flag = np.zeros(total, bool)
    at = np.cumsum([0, *[m[1] for m in members]])
    if total <= 4 << 20:
        hashes = np.concatenate([_windows(m, 0, m[1], length) for m in members])
        _mark(hashes, np.arange(total), flag)
    else:  # windows of equal content have the same distance to the anchor: slice by slice
        far = max(m[2] for m in members) + 1
        step = max(1, (2 << 20) // len(members))
        for d in range(0, far, step):
            part, where = [], []
            for m, a in zip(members, at, strict=False):
                lo, hi = max(0, m[2] - d - step + 1), min(m[1], m[2] - d + 1)
                if lo < hi:
                    part.append(_windows(m, lo, hi, length))
                    where.append(np.arange(a + lo, a + hi))
            if part:
                _mark(np.concatenate(part), np.concatenate(where), flag)
    return [flag[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _windows(m: tuple[bytes, int, int], lo: int, hi: int, length: int) -> np.ndarray:
    b = np.frombuffer(m[0], np.uint8)[lo : hi + length - 1]
    i = np.arange(hi - lo)
    one, two = _hash(_sums(b), i, i + length)
    return one ^ (two * _SECOND)


def _mark(hashes: np.ndarray, where: np.ndarray, flag: np.ndarray) -> None:
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    flag[where[order[1:][same]]] = True
    flag[where[order[:-1][same]]] = True


def merge_bucket(blobs: list[bytes], length: int, gram: int) -> Iterator[tuple]:
    """(doc_id, th, start, end) of the covered intervals."""

    def settle(group: list[tuple]) -> Iterator[tuple]:
        flags = windows_twice([(left + s, n, len(left)) for s, (left, n, *_) in group], length)
        for (_, (_, _, doc, th, lo)), f in zip(group, flags, strict=True):
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
                for a, b in edge.reshape(-1, 2).tolist():
                    yield doc, th, lo + a, lo + b - 1 + length

    held: list[tuple] = []  # whole groups, settled together
    group: list[tuple] = []
    size = 0
    for shared, s, rest in LoserTree([run_entries(b) for b in blobs]):
        if shared < gram:
            if len(group) > 1:
                held += group
                size += sum(x[1][1] for x in group)
                if size > 500_000:
                    yield from settle(held)
                    held, size = [], 0
            group = []
        group.append((s, rest))
    if len(group) > 1:
        held += group
    if held:
        yield from settle(held)


INTERVALS = "doc_id long, th long, start long, end long"


def _types():
    return [pa.int64()] * 4


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def anchor_keys(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, th, keys): a document's anchor keys, each at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], [0]
            for t in b.column(2):
                own = [s[3] for s in anchors(_raw(t), length, gram)]
                u, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                keys.append(np.repeat(u, np.minimum(n, 2)))
                at.append(at[-1] + len(keys[-1]))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["doc_id", "th", "keys"],
            )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, keys array<long>")


def sorted_runs(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """docs (doc_id, th, text, keys) to rows: runs (bucket, run) and, for stretches that repeat in a
    task already, their intervals (bucket -1)."""
    names = ["bucket", "run", "doc_id", "th", "start", "end"]
    types = [pa.int32(), pa.binary(), *_types()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[tuple]]] = {}
        seen: dict[tuple[int, int], tuple] = {}  # stretches of this run, by their content
        size = 0
        for b in batches:
            found: list[tuple] = []
            for doc, th, t, keys in zip(*b.columns, strict=True):
                doc, th = doc.as_py(), th.as_py()
                wanted = np.sort(keys.values.to_numpy().view(np.uint64))
                for start, part, sums, key, place, first, last in anchors(_raw(t), length, gram):
                    i = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    own = np.flatnonzero(wanted[i] == key)
                    if not len(own):
                        continue
                    one, two = _hash(sums, first[own], last[own] + length)
                    for j, x, y in zip(own.tolist(), one.tolist(), two.tolist(), strict=True):
                        lo, hi, p = int(first[j]), int(last[j]), int(place[j])
                        if (x, y) in seen:
                            found.append((doc, th, start + lo, start + hi + length))
                            if seen[x, y]:
                                found.append(seen[x, y])
                                seen[x, y] = ()
                            continue
                        seen[x, y] = (doc, th, start + lo, start + hi + length)
                        suffixes, rest = held.setdefault(int(key[j] >> np.uint64(20)) % buckets, ([], []))
                        suffixes.append(part[p : hi + length])
                        rest.append((part[lo:p], hi - lo + 1, doc, th, start + lo))
                        size += hi - lo + length + 200
            if found:
                yield _batch([(-1, None, *f) for f in found], names, types)
            if size > RUN_BYTES:
                for k, h in held.items():
                    yield _batch([(k, front_coded(*h), None, None, None, None)], names, types)
                held, seen, size = {}, {}, 0
        for k, h in held.items():
            yield _batch([(k, front_coded(*h), None, None, None, None)], names, types)

    return docs.select("doc_id", "th", "text", "keys").mapInArrow(
        run, "bucket int, run binary, doc_id long, th long, start long, end long"
    )


def hot_windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs (doc_id, th, text, keys) to one row per window of the anchors in keys: its place and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, th, t, keys in zip(*b.columns, strict=True):
                wanted = np.sort(keys.values.to_numpy().view(np.uint64))
                for start, _, sums, key, _, first, last in anchors(_raw(t), length, gram):
                    i = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    own = np.flatnonzero(wanted[i] == key)
                    if not len(own):
                        continue
                    at = np.concatenate([np.arange(first[j], last[j] + 1) for j in own])
                    one, two = _hash(sums, at, at + length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(at), pa.int64()), pa.array([th.as_py()] * len(at), pa.int64()),
                         pa.array(at + start), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                        names=["doc_id", "th", "start", "h1", "h2"],
                    )

    return docs.select("doc_id", "th", "text", "keys").mapInArrow(run, "doc_id long, th long, start long, h1 long, h2 long")


def covered(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """(doc_id, th, start, end): intervals whose bytes go; docs has doc_id, th and text."""
    keys = materialise(anchor_keys(docs, length, gram))
    each = keys.select("doc_id", "th", F.explode("keys").alias("key"))
    again = materialise(each.groupBy("key").count().where(F.col("count") > 1).withColumnRenamed("key", "__k"))

    def of(part: DataFrame) -> DataFrame:
        own = each.join(part, F.col("key") == F.col("__k"))
        return materialise(
            own.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_set("key").alias("keys"))
        )

    def texts(part: DataFrame) -> DataFrame:
        return docs.join(part.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(part["__d"]) & (docs["th"] == part["__t"]))

    total = again.where(F.col("count") <= hot).agg(F.sum("count")).first()[0] or 0
    buckets = max(1, -(-total * 2 * length // BUCKET_BYTES))
    runs = materialise(sorted_runs(texts(of(again.where(F.col("count") <= hot))), buckets, length, gram))

    def merge(t: pa.Table) -> pa.Table:
        rows = list(merge_bucket(t["run"].to_pylist(), length, gram))
        return pa.Table.from_batches([_batch(rows, ["doc_id", "th", "start", "end"], _types())])

    out = runs.where("bucket < 0").select("doc_id", "th", "start", "end").unionByName(
        runs.where("bucket >= 0").select("bucket", "run").groupBy("bucket").applyInArrow(merge, INTERVALS)
    )
    often = again.where(F.col("count") > hot)
    if often.limit(1).count():
        windows = materialise(hot_windows(texts(of(often)), length, gram))
        twice = materialise(windows.groupBy("h1", "h2").count().where(F.col("count") > 1).select("h1", "h2"))
        found = windows.join(twice, ["h1", "h2"], "left_semi")
        out = out.unionByName(found.select("doc_id", "th", "start", (F.col("start") + length).alias("end")))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (bytes), and th, the
    text's hash."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("th", F.xxhash64("text"))
    spans = covered(docs, length, gram, hot).groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    joined = docs.join(
        spans.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(spans["__d"]) & (docs["th"] == spans["__t"]), "left"
    ).select("doc_id", "text", "spans.start", "spans.end", docs["th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t, s, e, th in zip(*b.columns, strict=True):
                raw = _raw(t)
                if s.is_valid and len(s):
                    starts, ends = merged(s.values.to_numpy(), e.values.to_numpy())
                    edges = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc.as_py(), len(raw), len(raw) - len(kept), len(starts), kept, th.as_py()))
                else:
                    rows.append((doc.as_py(), len(raw), 0, 0, raw, th.as_py()))
            yield _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "th"], [*_types(), pa.binary(), pa.int64()])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, th long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and has_repeat: whether a passage of over 50 words stands in another
    document, too. LENGTH bytes are some 68 words of prose, so shorter passages stay in the text."""
    docs = table(spark, sf_dir, "documents")
    again = repeating_texts(docs.select(F.xxhash64("text").alias("th"), "text")).withColumnRenamed("th", "__p")
    out = suffix_dedup(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    out = out.join(broadcast_if_small(again), F.col("th") == F.col("__p"), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("__p").isNotNull().alias("has_repeat"))
