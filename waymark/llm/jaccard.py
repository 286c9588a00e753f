"""N-gram Jaccard join with set-relation skipping.

Exact similarity join of the documents' word-shingle sets: two documents link when
100 * |intersection| >= percent * |union|. One row per document comes back, with its component.

1. Equal sets. Documents with equal sets form a class, found by a combined hash aggregate; all that
   follows works on one set per class, so groups of copies cost nothing.
2. Index lists. A pair within the threshold differs in few shingles, by the sizes. The shingles are
   dealt by hash to more positions than that, so the pair agrees in all of some position, and
   (size class, position, content of the position) is a complete key, of which a set keeps a few
   (see Scheme). Lists of different size classes or positions never meet: these blocks are skipped
   whole.
3. Short lists (up to SHORT classes) give their pairs. A pair is skipped when the bit sketches of the
   two sets (each shingle flips one bit, so they differ in no more bits than the sets in shingles)
   differ too much. A longer list, as of a passage that many texts share, is left out by the sets
   that have enough other keys. For the rest (families of similar sets) it is led by the class that is
   in most such lists, so that the lists of a family have few leaders: every member is compared with
   the leaders of its lists only, and the difference is kept.
4. Derived answers. For members x, y of a leader L with differences Dx, Dy (of which mx, my shingles
   are missing from L) and c common ones, |x & y| = |L| - mx - my + c: the sets themselves are not
   needed any more. Without a common difference, x and y can only link if both link with L, and so
   are connected already. So it is enough to look, for every member that does not link with L (an
   outlier), at the members that share a piece of its difference. Their lists are ordered by the
   size of the difference, and the block of sizes that can't reach the threshold is skipped.
5. Components of the links, by label propagation on tables.

A family of more than FAMILY members is cut into blocks; each block of outliers meets each block of
members in a task of its own, so a task's memory is bounded.

Cases: null or empty texts and texts without words have no shingles, link with nothing and are
their own component; fewer words than k form one shingle; rows with a null doc_id take no part in
linking (component_id null); repeated rows get equal rows; extra columns are not read. Sets are
compared by 64-bit hashes of shingles; classes by 64 bits with a second hash as a check (a
collision stops the job).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .collocations import bloom
from .common import broadcast_if_small, discard, is_small, materialise, table
from .components import connected_components
from .wordhash import BLOCK, batches_of, hash_words, mix, parts, shingle

WORDS, PERCENT = 3, 90
FAMILY = 4096
#: Lists up to this many entries give all their pairs. Equal sets that a task remembers.
SHORT, SEEN = 12, 100_000
#: Index entries that a task looks at together for hot keys, and that it sends at once.
ENTRIES, SENT = 1 << 20, 1 << 16
#: Bits a shingle of the sketches that are made of candidates only.
FINE = 2
#: Ratio of a size class's ends. A power of two above the number of classes.
RATIO, CLASSES = 2, 64


def sets_of(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for i, j in batches_of(raws, [len(r) for r in raws], BLOCK):
        words, at = hash_words(raws[i:j])
        for a, b in itertools.pairwise(at):
            if b - a >= k:
                yield np.unique(shingle(words[a:b], k))
            elif b > a:  # the whole sequence, apart from sequences of other lengths
                yield shingle(words[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield words[:0]


class Scheme:
    """Size classes, and for each the positions to which shingles are dealt.

    A set and any partner whose larger size is in class g differ in d(n, g) shingles at most, so at
    least m - d of the m positions have equal content. All contents have one order: those of two
    shingles and more first, then single shingles, then empty ones, each by hash. A set keeps its first
    d + 1 + slack contents. Of a pair, look at the set that reaches less far down the order: it leaves
    out m - d - 1 - slack contents, so at least slack + 1 equal ones are kept, and the partner, which
    reaches further, keeps them too. That is why a set may also leave out its contents with long
    lists, if they are no more than slack: they are the same contents for all sets.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [1]
        while self.ends[-1] < 1 << 40:
            self.ends.append(max(self.ends[-1] + 1, int(self.ends[-1] * RATIO), -(-self.ends[-1] * 100 // percent) + 1))
        self.bounds = np.array(self.ends)
        self.known: dict[int, tuple[int, int]] = {}

    def differences(self, n: int, g: int) -> int:
        """The most shingles in which a set of n differs from a partner, the larger one in class g."""
        partner = min(n * 100 // self.percent, self.ends[g + 1] - 1)
        return (n + partner) * (100 - self.percent) // (100 + self.percent)

    def slack(self, g: int) -> int:
        return 4 + self.differences(self.ends[g + 1] - 1, g) // 10

    def positions(self, g: int) -> int:
        """The fewest positions that leave the class's smallest and largest sets enough contents of
        two shingles (by their mean, with a margin); else the number that comes nearest to it."""
        if g not in self.known:
            ends = (max(self.ends[g] * self.percent // 100, 1), self.ends[g + 1] - 1)
            need = [self.differences(n, g) + 1 + self.slack(g) for n in ends]
            best = (-math.inf, need[1] + 1)
            for load in (x / 10 for x in range(120, 9, -1)):
                m = max(math.ceil(ends[1] / load), max(need) + 1)
                strong = [m * (1 - math.exp(-n / m) * (1 + n / m)) for n in ends]
                margin = min((s - w) / math.sqrt(w) for s, w in zip(strong, need, strict=True))
                best = max(best, (margin, m), key=lambda x: x[0])
                if margin >= 2:
                    break
            self.known[g] = best[1]
        return self.known[g]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the contents that a set keeps; the last bits of a key are its class."""
        n = len(s)
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        out = []
        for g in (own, own + 1) if n * 100 >= self.percent * self.ends[own + 1] else (own,):
            d = self.differences(n, g)
            if not d:
                continue  # only equal sets link
            m = self.positions(g)
            h = mix(s ^ np.uint64(0xA5A5A5A5 + g))
            where = (h >> np.uint64(32)).astype(np.int64) % m
            sums = np.zeros(m, dtype=np.uint64)
            np.add.at(sums, where, mix(h))
            held = np.minimum(np.bincount(where, minlength=m), 2).astype(np.uint64)
            key = mix(sums + mix(np.arange(m, dtype=np.uint64) + np.uint64(g << 40)))
            rank = ((np.uint64(2) - held) << np.uint64(62)) | (key >> np.uint64(2))
            keep = min(d + 1 + self.slack(g), m)
            key = key[np.argpartition(rank, keep - 1)[:keep]]
            out.append((key & ~np.uint64(CLASSES - 1)) | np.uint64(g))
        return np.concatenate(out) if out else s[:0]


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    a = mix(s.sum(dtype=np.uint64)[None] + np.uint64(len(s)))
    b = mix(mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64)[None])
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def sketch(s: np.ndarray, each: int = 1) -> np.ndarray:
    """Parity bits of a set, as 64-bit words: a power of two of bits, at least ``each`` times the set's
    size. Halves of a sketch folded by exclusive or give the sketch of half the length."""
    bits = max(64, 1 << (each * len(s) - 1).bit_length()) if len(s) else 64
    where, odd = np.unique(mix(s ^ np.uint64(0x3C3C3C3C)) % np.uint64(bits), return_counts=True)
    where = where[odd % 2 == 1]
    out = np.zeros(bits // 64, dtype=np.uint64)
    np.bitwise_or.at(out, (where >> np.uint64(6)).astype(np.int64), np.uint64(1) << (where & np.uint64(63)))
    return out


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls, chk, bits); cls is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            n, cls, chk, bits, at = [], [], [], [], [0]
            for s in sets_of(b.column(1).to_pylist(), k):
                n.append(len(s))
                c = class_of(s) if len(s) else (None, None)
                cls.append(c[0])
                chk.append(c[1])
                bits.append(sketch(s))
                at.append(at[-1] + len(bits[-1]))
            flat = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(chk, pa.int64()), lists],
                names=["doc_id", "n", "cls", "chk", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, cls long, chk long, bits array<long>"
    )


def unseen(c: int, seen: dict[int, None]) -> bool:
    """Whether the class is none of the last SEEN ones; it is remembered."""
    if c in seen:
        return False
    seen[c] = None
    if len(seen) > SEEN:
        seen.pop(next(iter(seen)))
    return True


def salted(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with their salts. A key with more than SHORT of those given at once is hot: these
    get a salt of their own, so that no task holds all entries of a hot key, and one entry of salt -1
    tells the key's own task."""
    values, counts = np.unique(key, return_counts=True)
    hot = values[counts > SHORT]
    salt = np.zeros(len(key), dtype=np.int32)
    if len(hot):
        at = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        # One salt for a key and call, from the first set; 0 and -1 have their meanings.
        own = mix(key[at] ^ mix(of[:1].view(np.uint64)))
        salt[at] = (own >> np.uint64(34)).astype(np.int32) | 1
        first = np.flatnonzero(at)[np.unique(key[at], return_index=True)[1]]
        key, of = np.concatenate((key, key[first])), np.concatenate((of, of[first]))
        salt = np.concatenate((salt, np.full(len(first), -1, np.int32)))
    return key, of, salt


def index_entries(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, cls, salt): the index lists' entries; a task tells equal sets once (the last SEEN of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        seen: dict[int, None] = {}
        keys, cls, held = [], [], 0
        for b in itertools.chain(parts(batches, 0), [None]):
            for s in sets_of(b.column(0).to_pylist(), k) if b is not None else ():
                c = class_of(s)[0] if len(s) else None
                if c is not None and unseen(c, seen):
                    keys.append(scheme.keys(s))
                    cls.append(c)
                    held += len(keys[-1])
            if held >= ENTRIES or (b is None and held):
                of = np.repeat(np.array(cls, np.int64), [len(x) for x in keys])
                key = np.concatenate(keys)
                keys, cls, held = [], [], 0
                key, of, salt = salted(key, of)
                for i in range(0, len(key), SENT):
                    some = slice(i, i + SENT)
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(of[some]), pa.array(salt[some])], names=["key", "cls", "salt"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "key long, cls long, salt int")


def _lists(key: np.ndarray, cls: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
    """Of whole lists, sorted by key and class: (key null, a, b) for each pair of a short one, and
    (key, a, b null) for each entry of a long one."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1 if len(key) else np.zeros(0, np.int64)
    hot = np.bincount(group, weights=long, minlength=1) > 0
    key, cls, group = key[new], cls[new], group[new]
    size = np.bincount(group, minlength=1)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    a, b = [], []
    for c in range(2, SHORT + 1):
        at = start[(size == c) & ~hot]
        if len(at):
            rows = cls[at[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            a.append(rows[:, i].ravel())
            b.append(rows[:, j].ravel())
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1) if a else np.zeros((2, 0), np.int64)
    listed = (hot | (size > SHORT))[group]
    n, m = pairs.shape[1], int(listed.sum())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((np.zeros(n, np.int64), key[listed])), mask=np.arange(n + m) < n),
            pa.array(np.concatenate((pairs[0], cls[listed]))),
            pa.array(np.concatenate((pairs[1], np.zeros(m, np.int64))), mask=np.arange(n + m) >= n),
        ],
        names=["key", "a", "b"],
    )


def meetings(entries: DataFrame) -> DataFrame:
    """(key, a, b), see _lists, of all lists of two classes and more. Each entry goes over the network
    once; lists are read in sorted order, so a task holds a batch and at most the start of a list."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(n, "key", F.greatest("salt", F.lit(0))).sortWithinPartitions("key", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, cls, long = none, none, np.zeros(0, dtype=bool)
        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate((key, b.column(0).to_numpy()))
            cls = np.concatenate((cls, b.column(1).to_numpy()))
            long = np.concatenate((long, b.column(2).to_numpy() != 0))
            last = int(np.searchsorted(key, key[-1]))
            if len(np.unique(cls[last:])) > SHORT:  # what is left of this list is long, too
                yield _lists(key, cls, long | (np.arange(len(key)) >= last))
                key, cls, long = key[-1:], cls[-1:], np.ones(1, dtype=bool)
            elif last:
                yield _lists(key[:last], cls[:last], long[:last])
                key, cls, long = key[last:], cls[last:], long[last:]
        if len(key):
            yield _lists(key, cls, long)

    return dealt.mapInArrow(run, "key long, a long, b long")


def _near_sketches(a: str, b: str, na: str, nb: str, percent: int) -> F.Column:
    """Whether two sketches leave the pair a chance; the longer one is folded once if need be."""
    fold = lambda x: F.zip_with(
        F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")),
        F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x = F.when(F.size(a) > F.size(b), fold(F.col(a))).otherwise(F.col(a))
    y = F.when(F.size(b) > F.size(a), fold(F.col(b))).otherwise(F.col(b))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    most = (F.col(na) + F.col(nb)) * (100 - percent) / (100 + percent)
    sizes = (F.col(na) * percent <= F.col(nb) * 100) & (F.col(nb) * percent <= F.col(na) * 100)
    return sizes & (F.abs(F.log2(F.size(a)) - F.log2(F.size(b))) < 1.5) & (differ <= most)


def _linked(inter: int, union: int, percent: int) -> bool:
    return 100 * inter >= percent * union


def compare_with_leader(rows: DataFrame, percent: int) -> DataFrame:
    """rows (leader, cls, lead binary, own binary, family) to (leader, cls, linked, size, missing,
    delta, family); only in families are the differences kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2, 3):
            linked, size, missing, delta, at = [], [], [], [], [0]
            for lead, own, family in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(lead.as_py(), np.uint64), np.frombuffer(own.as_py(), np.uint64)
                diff = np.setxor1d(x, y, assume_unique=True)
                inter = (len(x) + len(y) - len(diff)) // 2
                linked.append(_linked(inter, inter + len(diff), percent))
                size.append(len(x))
                missing.append(len(x) - inter)
                delta.append(diff if family else diff[:0])
                at.append(at[-1] + len(delta[-1]))
            flat = np.concatenate(delta) if delta else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(missing, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64))), b.column(4)],
                names=["leader", "cls", "linked", "size", "missing", "delta", "family"],
            )

    return rows.select("leader", "cls", "lead", "own", "family").mapInArrow(
        run, "leader long, cls long, linked boolean, size long, missing long, delta array<long>, family boolean"
    )


def derive(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between outliers and members of one family (or two blocks of it), from the differences
    alone; pairs that are connected already are left out."""
    cls = t["cls"].to_numpy()
    linked = t["linked"].to_numpy()
    own = t["outlier"].to_numpy()  # rows to ask for
    size, missing = t["size"].to_numpy(), t["missing"].to_numpy()
    lists = t["delta"].combine_chunks()
    start, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    length = np.diff(start)
    order = np.argsort(length, kind="stable")  # members by the size of their difference
    flat = np.concatenate([flat[start[i] : start[i + 1]] for i in order]) if len(order) else flat[:0]
    cls, linked, own, size, missing, length = (x[order] for x in (cls, linked, own, size, missing, length))
    owner = np.repeat(np.arange(len(cls)), length)
    start = np.concatenate(([0], np.cumsum(length)))
    by = np.lexsort((owner, flat))
    tokens, holder = flat[by], owner[by]

    root = list(range(len(cls)))
    first = np.flatnonzero(linked)
    for i in first.tolist():
        root[i] = int(first[0])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for x in np.flatnonzero(own).tolist():
        d = flat[start[x] : start[x + 1]]
        lo, hi = np.searchsorted(tokens, d, "left"), np.searchsorted(tokens, d, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        y, c = np.unique(holder[at], return_counts=True)
        # The least difference that can still make up for that of x.
        own_size = size[x] - missing[x] + (length[x] - missing[x])
        most = own_size * (100 - percent) // percent + own_size * (100 - percent) // 100 + 1
        skip = np.searchsorted(length, length[x] - most)
        y, c = y[(i := np.searchsorted(y, skip)) :], c[i:]
        inter = size[x] - missing[x] - missing[y] + c
        union = own_size + (size[y] - missing[y]) + (length[y] - missing[y]) - inter
        for z in y[(100 * inter >= percent * union) & (y != x)].tolist():
            a, b = find(x), find(z)
            if a != b:
                root[a] = b
                out.append((int(cls[x]), int(cls[z])))
    return out


def _derived_links(compared: DataFrame, percent: int, family: int) -> DataFrame:
    sizes = compared.groupBy(F.col("leader").alias("__l")).agg(
        F.count("*").alias("__n"), F.count_if(~F.col("linked")).alias("__out")
    )
    sizes = materialise(sizes.where("__out > 0 AND __n > 1"))
    rows = compared.join(broadcast_if_small(sizes), F.col("leader") == F.col("__l"))
    blocks = F.ceil(F.col("__n") / family).cast("int")
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    # An outlier asks in the tasks (its block, j); every member is asked in the tasks (i, its block).
    ask = F.when(~F.col("linked"), F.transform(every, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("o"))))
    told = F.transform(every, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("o")))
    told = F.filter(told, lambda s: F.col("linked") | (s["i"] != s["j"]))
    tasks = rows.withColumn("t", F.explode(F.concat(F.coalesce(ask, F.array().cast("array<struct<i:int,j:int,o:boolean>>")), told))).select(
        "leader", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.o").alias("outlier"),
        "cls", "linked", "size", "missing", "delta",
    )

    def run(t: pa.Table) -> pa.Table:
        links = derive(t, percent) if t["outlier"].to_numpy().any() else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return tasks.groupBy("leader", "i", "j").applyInArrow(run, "a long, b long")


def classes_of(prof: DataFrame, *held: str) -> DataFrame:
    """One row per set, from profiles: its least doc_id (rep), size, and the columns ``held``."""
    sound = prof.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(
        sound.groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.min("chk").alias("c0"), F.max("chk").alias("c1"), F.first("n").alias("n"), *[F.first(h).alias(h) for h in held]
        )
    )
    if classes.where("c0 != c1").limit(1).count():
        raise ValueError("two sets share a 64-bit class")
    return classes


def rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (doc_id, text) joined with a written table wanted (rep, ...) of some of their ids. A wanted
    table that is too large to broadcast is joined by shuffle; a Bloom filter of its ids, of 16 MB at
    most, keeps the texts that nobody asks for out of that."""
    if is_small(wanted):
        return docs.join(F.broadcast(wanted), docs["doc_id"] == wanted["rep"])
    held = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col("rep").alias("key")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.has(b.column(0).to_numpy().view(np.uint64))))

    asked = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
    return asked.join(wanted, asked["doc_id"] == wanted["rep"])


def _by_fine_sketches(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The families' rows of pairs, and those others that sketches of FINE bits a shingle leave a chance.
    The sketches bound the difference from below, so no link goes."""
    wanted = pairs.where("NOT family")
    wanted = materialise(wanted.select("cls", "rep").union(wanted.select("leader", "lead_rep")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            sets = list(sets_of(b.column(1).to_pylist(), k))
            same = pa.array([bool(len(s)) and class_of(s)[0] == c.as_py() for s, c in zip(sets, b.column(0), strict=True)], pa.bool_())
            bits = pa.array([sketch(s, FINE).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), bits], names=["cls", "n", "bits"]).filter(same)

    made = rows_of(docs, wanted).select("cls", "text").mapInArrow(run, "cls long, n long, bits array<long>")
    made = materialise(made.groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))
    own = made.select("cls", F.col("n").alias("n1"), F.col("bits").alias("b1"))
    lead = made.select(F.col("cls").alias("leader"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    near = pairs.where("NOT family").join(own, "cls").join(lead, "leader").where(_near_sketches("b1", "b2", "n1", "n2", percent))
    out = materialise(pairs.where("family").unionByName(near.select(pairs.columns)))
    discard(pairs, wanted, made)
    return out


def _sets_of_pairs(docs: DataFrame, pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(leader, cls, family, own) of each pair and (leader, lead) of each leader: the sets, made again
    from the texts. A set goes to its leaders from the task that makes it, so it is written no more
    often than they need it. The leaders' own are a table, so that a leader with very many rows can be
    split in the join."""
    ends = pairs.groupBy("cls", "rep").agg(F.collect_list(F.struct("leader", "family")).alias("to"))
    ends, leads = materialise(ends), materialise(pairs.select(F.col("leader").alias("cls"), F.col("lead_rep").alias("rep")).distinct())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            sets = list(sets_of(b.column(1).to_pylist(), k))
            same = pa.array([bool(len(s)) and class_of(s)[0] == c.as_py() for s, c in zip(sets, b.column(0), strict=True)], pa.bool_())
            out = [b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, names=["cls", "own", *b.schema.names[2:]]).filter(same)

    own = rows_of(docs, ends).select("cls", "text", "to").mapInArrow(make, "cls long, own binary, to array<struct<leader: long, family: boolean>>")
    lead = rows_of(docs, leads).select("cls", "text").mapInArrow(make, "cls long, own binary")
    lead = materialise(lead.groupBy(F.col("cls").alias("leader")).agg(F.first("own").alias("lead")))
    return own.select("cls", "own", F.explode("to").alias("t")).select("t.leader", "cls", "t.family", "own"), lead


def components_of(docs: DataFrame, prof: DataFrame, classes: DataFrame, met: DataFrame, slack: list[int], near: Callable[..., Column],
                  k: int, percent: int, family: int, coarse: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all profiles, from the lists' meetings. A set leaves out its
    long lists of a size class if they are within ``slack``; ``near`` says from what two classes keep
    (bits and sizes) whether a pair of a short list has a chance. Where that is ``coarse``, finer sketches
    are asked, too. All links are confirmed on full sets. The tables of prof and met are deleted."""
    slim = materialise(prof.select("doc_id", "n", "cls"))
    discard(prof)
    prof = slim
    slack = F.array(*(F.lit(x) for x in slack))
    listed = met.where("key IS NOT NULL").select("key", F.col("a").alias("cls"), F.col("key").bitwiseAND(CLASSES - 1).cast("int").alias("g")).distinct()
    listed = listed.withColumn("many", F.count("*").over(Window.partitionBy("cls", "g"))).where(F.col("many") > F.get(slack, F.col("g")))
    listed = materialise(listed.select("key", "cls", "many"))
    leaders = listed.groupBy("key").agg(F.max(F.struct("many", "cls"))["cls"].alias("leader"), F.count("*").alias("c"))
    leaders = materialise(leaders.where("c > 1").select("key", "leader"))
    family_rows = listed.join(broadcast_if_small(leaders), "key").where("leader != cls")
    cand = met.where("key IS NULL").select(F.col("a").alias("leader"), F.col("b").alias("cls"), F.lit(False).alias("family")).unionByName(
        family_rows.select("leader", "cls", F.lit(True).alias("family"))
    )
    cand = materialise(cand.groupBy("leader", "cls").agg(F.max("family").alias("family")))
    discard(met, listed, leaders)
    own = classes.select("cls", "rep", F.col("n").alias("n1"), F.col("bits").alias("b1"))
    lead = classes.select(F.col("cls").alias("leader"), F.col("rep").alias("lead_rep"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    pairs = materialise(
        cand.join(own, "cls").join(lead, "leader")
        .where(F.col("family") | near("b1", "b2", "n1", "n2", percent))
        .select("leader", "cls", "family", "rep", "lead_rep")
    )

    if coarse:
        pairs = _by_fine_sketches(docs, pairs, k, percent)
    own, lead = _sets_of_pairs(docs, pairs, k)
    compared = materialise(compare_with_leader(own.join(lead, "leader"), percent))
    links = compared.where("linked").select(F.col("leader").alias("a"), F.col("cls").alias("b"))
    links = materialise(links.union(_derived_links(compared.where("family"), percent, family)))
    discard(cand, pairs, lead, compared)

    comps = connected_components(links)
    reps = classes.select("cls", "rep")
    found = reps.join(comps, reps["cls"] == comps["node"]).select("cls", "rep", "comp")
    least = found.groupBy("comp").agg(F.min("rep").alias("__component"))
    merged = found.join(least, "comp").select("cls", "__component")
    # One row per class; read from a table, so that a class with very many rows can be split.
    label = materialise(
        reps.join(merged, "cls", "left").select(F.col("cls").alias("__cls"), F.coalesce("__component", "rep").alias("__component"))
    )
    return prof.join(label, prof["cls"] == label["__cls"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("__component", "doc_id")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, family: int = FAMILY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prof = materialise(profiles(docs, k))
    classes = classes_of(prof, "bits")
    met = materialise(meetings(index_entries(docs, k, percent)))
    scheme = Scheme(percent)
    slack = [scheme.slack(g) for g in range(len(scheme.ends) - 1)]
    return components_of(docs, prof, classes, met, slack, _near_sketches, k, percent, family)


def one_per_component(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with only the least doc_id of each component (and rows without a doc_id)."""
    comp = jaccard_components(docs, k, percent)
    gone = materialise(comp.where("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(broadcast_if_small(gone), F.col("doc_id") == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3
           THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.y FROM r JOIN both_ways t ON r.b = t.x
  ) SELECT a, min(b) AS c FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, reach.c AS component_id
FROM sets s JOIN reach ON s.doc_id = reach.a
"""
