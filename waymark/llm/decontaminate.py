"""Benchmark decontamination.

Windows of an item's size around every five-word shingle that the text shares with an item (a
similar window shares one, so no other can match) get a 64-bit SimHash of their weighted shingles.
A multi-index of the items' fingerprints finds all within RADIUS: the bits are cut into BLOCKS
parts, and two fingerprints within the radius differ in some part by at most RADIUS // BLOCKS bits,
so every value that near is looked up. Candidates are verified by exact weighted similarity: over
the two multisets of shingles, the weighted sum of least counts over that of largest, at least
THRESHOLD. A shingle's weight is ln(1 + items / items that hold it).

Words are split at ASCII white space after lower-casing A-Z and leaving out ASCII punctuation.
The items go along with the tasks, at most MAX_ITEMS at once; more are taken in several passes, one
collected at a time. Weights count over the whole benchmark, whatever the passes.
The fingerprint can miss a pair near the threshold (measured in tests/llm); equal passages have
distance 0.

Cases: null and empty texts match nothing; items of fewer than five words are not searched for;
a text shorter than an item is one window; repeated items or rows give repeated matches; a null
doc_id stays null; extra columns are carried by drop_contaminated and not read otherwise.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .wordhash import BLOCK, batches_of, hash_words, parts, shingle

WORDS, THRESHOLD, RADIUS, BLOCKS, MAX_ITEMS = 5, 0.8, 19, 5, 50_000
_PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_BITS = np.arange(64, dtype=np.uint64)
SCHEMA = "doc_id long, item_id long, start long, similarity double, distance int, n_windows long"


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION)


class Benchmark:
    """The items' shingles, fingerprints and multi-index."""

    def __init__(self, ids: list[int], texts: list[str | None], radius: int = RADIUS, blocks: int = BLOCKS,
                 threshold: float = THRESHOLD, total: int | None = None, common: tuple[np.ndarray, np.ndarray] | None = None):
        """Of one pass, ``total`` items of five words or more are in the whole benchmark, and
        ``common`` has the sorted shingles that two of them or more hold, with their holders."""
        self.threshold, self.radius, self.blocks = threshold, radius, blocks
        words, at = hash_words([normal(t) for t in texts])
        own = [shingle(words[a:b], WORDS) for a, b in itertools.pairwise(at)]
        keep = [i for i, s in enumerate(own) if len(s)]
        self.ids = np.array([ids[i] for i in keep], dtype=np.int64)
        self.counts = [dict(zip(*map(np.ndarray.tolist, np.unique(own[i], return_counts=True)), strict=True)) for i in keep]
        self.size = np.array([len(own[i]) for i in keep], dtype=np.int64)  # shingles in a window
        every = np.concatenate([np.unique(own[i]) for i in keep]) if keep else np.zeros(0, np.uint64)
        self.known, df = np.unique(every, return_counts=True)
        total = len(keep) if total is None else total
        self.rare = float(np.log1p(total))
        self.weighed, self.weights = self.known, np.log1p(total / df)
        if common is not None:
            self.weighed, self.weights = common[0], np.log1p(total / common[1])
        self.holders = defaultdict(list)
        for i, c in enumerate(self.counts):
            for s in c:
                self.holders[s].append(i)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.known >> np.uint64(44)] = True
        self.prints = np.array([self.fingerprints(own[i], np.array([0]), len(own[i]))[0] for i in keep], dtype=np.uint64)
        cuts = [round(64 * j / blocks) for j in range(blocks + 1)]
        self.parts = []
        for a, b in itertools.pairwise(cuts):
            near = np.array([sum(1 << x for x in c) for r in range(radius // blocks + 1) for c in itertools.combinations(range(b - a), r)])
            value = ((self.prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))
            self.parts.append((a, b - a, near, order, first))

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.weighed):
            return np.full(len(shingles), self.rare)
        i = np.minimum(np.searchsorted(self.weighed, shingles), len(self.weighed) - 1)
        return np.where(self.weighed[i] == shingles, self.weights[i], self.rare)

    def fingerprints(self, shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """SimHash of the windows of ``size`` shingles at ``starts``."""
        signs = ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1
        sums = np.zeros((len(shingles) + 1, 64))
        np.cumsum(signs * self.weight(shingles)[:, None], axis=0, out=sums[1:])
        high = sums[np.minimum(starts + size, len(shingles))] - sums[starts] > 0
        return (high.astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within the radius."""
        found = []
        for a, width, near, order, first in self.parts:
            value = ((prints >> np.uint64(a)) & np.uint64((1 << width) - 1)).astype(np.int64)
            around = value[:, None] ^ near
            n = first[around + 1] - first[around]
            w, k = np.nonzero(n)
            n, at = n[w, k], first[around[w, k]]
            items = order[np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else order[:0]
            w = np.repeat(w, n)
            ok = np.bitwise_count(prints[w] ^ self.prints[items]) <= self.radius
            found.append(w[ok] * len(self.ids) + items[ok])
        pairs = np.unique(np.concatenate(found))
        w, i = pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)
        return zip(w.tolist(), i.tolist(), np.bitwise_count(prints[w] ^ self.prints[i]).tolist(), strict=True)

    def similarity(self, window: np.ndarray, item: int) -> float:
        keys, n = np.unique(window, return_counts=True)
        mine, other = self.counts[item], dict(zip(keys.tolist(), n.tolist(), strict=True))
        every = np.array(sorted({*mine, *other}), dtype=np.uint64)
        w = self.weight(every)
        a = np.array([mine.get(s, 0) for s in every.tolist()])
        b = np.array([other.get(s, 0) for s in every.tolist()])
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def match(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(item, start, similarity, distance, windows) of one text, the best window of each item.
        hits: positions of shingles that some item holds."""
        by_size: dict[int, set[int]] = defaultdict(set)
        for x in hits.tolist():
            for size in {int(self.size[i]) for i in self.holders.get(int(shingles[x]), ())}:
                last = max(0, len(shingles) - size)
                by_size[size].update(range(min(last, max(0, x - size + 1)), min(last, x) + 1))
        best: dict[int, tuple[float, int, int]] = {}
        seen: dict[int, int] = defaultdict(int)
        for size, where in by_size.items():
            starts = np.array(sorted(where))
            for a in range(0, len(starts), 512):
                some = starts[a : a + 512]
                lo, hi = int(some[0]), int(some[-1]) + size
                prints = self.fingerprints(shingles[lo:hi], some - lo, size)
                distinct, back = np.unique(prints, return_inverse=True)
                found = defaultdict(list)
                for w, i, d in self.near(distinct):
                    if self.size[i] == size:
                        found[w].append((i, d))
                for s, w in zip(some.tolist(), back.tolist(), strict=True):
                    for i, d in found.get(w, ()):
                        sim = self.similarity(shingles[s : s + size], i)
                        if sim >= self.threshold:
                            seen[i] += 1
                            best[i] = max(best.get(i, (-1.0, 0, 0)), (sim, -s, d))
        return [(i, -s, sim, d, seen[i]) for i, (sim, s, d) in sorted(best.items())]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, list]]:
        """(index of the text, matches) for each text with a match."""
        raws = [normal(t) for t in texts]
        for i, j in batches_of(raws, [len(r) for r in raws], BLOCK):
            words, at = hash_words(raws[i:j])
            every = shingle(words, WORDS)
            hits = np.flatnonzero(self.filter[every >> np.uint64(44)]) if len(self.known) else np.zeros(0, np.int64)
            if not len(hits):
                continue
            hits = hits[np.isin(every[hits], self.known)]
            doc = np.searchsorted(at, hits, side="right") - 1
            inside = hits + WORDS <= at[doc + 1]
            hits, doc = hits[inside], doc[inside]
            for d in np.unique(doc).tolist():
                shingles = every[at[d] : at[d + 1] - WORDS + 1]
                found = self.match(shingles, hits[doc == d] - at[d])
                if found:
                    yield i + d, found


def _shared(items: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The number of items of five words or more, and the shingles that two of them or more hold
    with their holders (all others have one, and the weight of an unknown shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = hash_words([normal(t) for t in b.column(1).to_pylist()])
            own = [np.unique(shingle(words[i:j], WORDS)) for i, j in itertools.pairwise(at)]
            own = [s for s in own if len(s)]
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            first = np.zeros(len(flat), dtype=bool)
            first[np.cumsum([0, *map(len, own)])[:-1]] = True
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(first)], names=["s", "first"])

    held = materialise(items.mapInArrow(run, "s long, first boolean"))
    total = held.where("first").count()
    rows = held.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    common = rows["s"].to_numpy().view(np.uint64)
    order = np.argsort(common)
    return total, (common[order], rows["n"].to_numpy()[order])


def _items(benchmark: DataFrame, most: int) -> Iterator[tuple[list, dict]]:
    """The items in passes of at most about ``most``, each collected as it is asked for, and what
    Benchmark needs of the whole; only the item_id and text are read."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    passes = max(1, -(-items.count() // most))
    if passes == 1:
        yield items.collect(), {}
        return
    total, common = _shared(items)
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        yield part.collect(), {"total": total, "common": common}


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS,
            blocks: int = BLOCKS, max_items: int = MAX_ITEMS) -> DataFrame:
    """The contaminated (doc_id, item_id) with the best window: its first word, similarity, Hamming
    distance, and the number of windows that match."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for items, whole in _items(benchmark, max_items):
        ids, texts = [r[0] for r in items], [r[1] for r in items]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts, whole=whole) -> Iterator[pa.RecordBatch]:
            index = Benchmark(ids, texts, radius, blocks, threshold, **whole)
            for b in parts(batches, 1):
                doc = b.column(0)
                rows = [
                    (doc[k].as_py(), int(index.ids[i]), s, sim, d, n)
                    for k, found in index.search(b.column(1).to_pylist())
                    for i, s, sim, d, n in found
                ]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                        names=["doc_id", "item_id", "start", "similarity", "distance", "n_windows"],
                    )

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS,
                      blocks: int = BLOCKS, max_items: int = MAX_ITEMS) -> DataFrame:
    """``docs`` without the rows whose text matches an item; all columns stay, nothing is shuffled."""
    at = docs.columns.index("text")
    for items, whole in _items(benchmark, max_items):
        ids, texts = [r[0] for r in items], [r[1] for r in items]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts, whole=whole) -> Iterator[pa.RecordBatch]:
            index = Benchmark(ids, texts, radius, blocks, threshold, **whole)
            for b in parts(batches, at):
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[k for k, _ in index.search(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("similarity", F.round("similarity", 6))
