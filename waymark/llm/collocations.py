"""Phrase collocation mining with generalised suffix automata.

1. Texts are cut into pieces and words; each task turns its texts into shards of about SHARD bytes and
   builds one generalised suffix automaton a shard over its word sequences, cut off at ``depth`` words:
   its states are the sets of phrases with the same end positions, with the number of these (endpos
   count), and its suffix links form the tree of the reversed pieces, which NumPy builds level by level.
   The states enumerate the shard's phrases; counts are added up over all shards by Spark.
2. A phrase can only be frequent if its parts are. So this runs three times: one word deep, two words
   deep over frequent words, then in full over runs of frequent pairs. The first two passes count 64-bit
   hashes, so a collision lets a phrase through and never loses one; they pass on a Bloom filter of at
   most FILTER_BITS bits. The last pass carries the words themselves and its counts are exact.
3. Suffix links once more, over all shards: dropping a phrase's first word (or last) leads to the next
   shorter one, and along these links the count of the most frequent longer phrase comes down. As counts
   fall with length, one link is enough to know whether any longer phrase holds most occurrences.
4. Every cut's two parts are frequent themselves, so their counts are in the same table.

Cases: a null text is empty and a null language is `und`; pieces never cross documents; repeated rows
count again; an empty table gives no rows; extra columns are not read; a text of any length is read in
slices. Within a shard words are told apart by 64 bits of hash. Sums that may pass 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table
from .wordhash import batches_of, mix

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A longer phrase with this share (percent) of the occurrences takes a shorter one's place.
SUBSUMED = 80
SHARD, SLICE = 2 << 20, 1 << 19
FILTER_BITS, PROBES = 1 << 27, 3

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of a shard: where they start and end, their hash (with the language's), and the number
    of the piece that they are in."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    doc: np.ndarray


def _slices(raw: bytes) -> Iterator[tuple[int, int]]:
    """Parts of about SLICE bytes that end after a gap; a word is never cut."""
    gap, at = _GAP[np.frombuffer(raw, dtype=np.uint8)], 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and not gap[end - 1]:
            after = np.flatnonzero(gap[end : end + SLICE])
            end = end + int(after[0]) + 1 if len(after) else end + SLICE
        yield at, min(end, len(raw))
        at = end


def split(texts: list[bytes], langs: np.ndarray) -> Words:
    """The words of texts; langs holds a 64-bit hash of each text's language."""
    raw = b"\n".join(texts).lower()
    whole = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, hashes, pieces, before = [], [], [], [], 0
    for a, b in _slices(raw):
        x = whole[a:b]
        edge = np.diff(np.concatenate(([True], _GAP[x], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        breaks = np.cumsum(_BREAK[x]) + before
        before = int(breaks[-1])
        if len(start):
            length = end - start
            at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)  # place in the word
            byte = x[np.repeat(start, length) + at].astype(np.uint64)
            h = np.add.reduceat(mix((byte + np.uint64(1)) * _STEP + at.astype(np.uint64)), np.cumsum(length) - length)
            starts.append(start + a)
            ends.append(end + a)
            hashes.append(h + length.astype(np.uint64))
            pieces.append(breaks[start])
    none = np.zeros(0, dtype=np.int64)
    start, end, piece = (np.concatenate(p) if p else none for p in (starts, ends, pieces))
    h = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return Words(raw, start, end, mix(mix(h) * _STEP + langs[doc]) if len(h) else h, piece, doc)


@dataclass
class Automaton:
    """States of a generalised suffix automaton: a state's phrases all end at the same places, one of
    which is ``end``; they have ``shortest`` to ``longest`` words. ``link`` is the state of the longest
    suffix that ends at more places (-1 at the root)."""

    end: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray
    link: np.ndarray

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, number of words, count) of each phrase of each state."""
        n = self.longest - self.shortest + 1
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.end, n), np.repeat(self.shortest, n) + at, np.repeat(self.count, n)


def automaton(word: np.ndarray, run: np.ndarray, depth: int) -> Automaton:
    """The automaton of a word sequence, for phrases of at most ``depth`` words. ``run`` tells for each
    place how many words up to it may make a phrase (0: none).

    The tree of suffix links has a node for each phrase, its parent being the phrase without its first
    word. Level by level, a place moves from its phrase of d words to that of d + 1. A phrase with as many
    end positions as its parent has the same ones: both are one state.
    """
    place = np.flatnonzero(run > 0)
    values, node = np.unique(word[place], return_inverse=True)
    levels = []  # of each level's nodes: (an end, count, parent)
    parent = np.full(len(values), -1, dtype=np.int64)
    for d in range(1, depth + 1):
        count = np.bincount(node, minlength=len(parent))
        end = np.zeros(len(parent), dtype=np.int64)
        end[node] = place
        levels.append((end, count, parent))
        longer = run[place] > d
        place, node = place[longer], node[longer]
        if d == depth or not len(place):
            break
        _, first = np.unique(word[place - d], return_inverse=True)
        wide = np.int64(first.max() + 1)
        keys, node = np.unique(node.astype(np.int64) * wide + first, return_inverse=True)
        parent = keys // wide
    end, shortest, longest, count, link = [], [], [], [], []
    state = np.zeros(0, dtype=np.int64)  # of the nodes of the level above
    total = 0
    for d, (at, c, up) in enumerate(levels, start=1):
        own = np.ones(len(c), dtype=bool)  # whether a node opens a state
        if d > 1:
            own = c < levels[d - 2][1][up]
        new = np.full(len(c), -1, dtype=np.int64)
        new[own] = total + np.arange(int(own.sum()))
        if d > 1:
            new[~own] = state[up[~own]]
            flat = np.concatenate(longest)
            flat[new[~own]] = d
            longest = [flat]
        end.append(at[own])
        shortest.append(np.full(int(own.sum()), d))
        longest.append(np.full(int(own.sum()), d))
        count.append(c[own])
        link.append(state[up[own]] if d > 1 else np.full(int(own.sum()), -1))
        total += int(own.sum())
        state = new
    return Automaton(*(np.concatenate(x).astype(np.int64) for x in (end, shortest, longest, count, link)))


def _pair(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it (the first has none: 0)."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    out[1:] = mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])
    return out


class Bloom:
    """A set of 64-bit hashes that may say yes to others, as 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for i in range(PROBES):
            at = mix(h + np.uint64(i)) & np.uint64(len(self.words) * 64 - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(keys: DataFrame) -> Bloom:
    """The filter of a table's hashes (key): 16 bits a key, and at most FILTER_BITS in all, of which only
    the words that are not 0 come to the driver (16 MB at most)."""
    bits = min(max(64, 1 << (16 * keys.count()).bit_length()), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([mix(h + np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)])
            one = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(one.view(np.int64))], names=["slot", "bits"])

    held = keys.select("key").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[held["slot"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return Bloom(words)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of each shard of rows (lang, text), and its languages."""
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1)
        known = {x: np.frombuffer(x.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64) for x in set(langs)}
        seed = {x: int((mix((v + np.uint64(1)) * _STEP + np.arange(len(v), dtype=np.uint64))).sum() + np.uint64(len(v))) for x, v in known.items()}
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, j in batches_of(sizes, sizes, SHARD):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j].to_pylist()]
            yield split(raws, mix(np.array([seed[x] for x in langs[i:j]], dtype=np.uint64))), langs[i:j]


def _runs(w: Words, words: Bloom | None, pairs: Bloom | None) -> np.ndarray:
    """How many words up to each place may make a phrase: frequent words, in frequent pairs, of one piece."""
    n = len(w.hash)
    good = words.has(w.hash) if words else np.ones(n, dtype=bool)
    joined = np.zeros(n, dtype=bool)
    joined[1:] = good[1:] & good[:-1] & (w.piece[1:] == w.piece[:-1])
    if pairs:
        joined &= pairs.has(_pair(w.hash))
    opens = np.flatnonzero(~joined)
    return np.where(good, np.arange(n) - np.repeat(opens, np.diff(np.append(opens, n))) + 1, 0) if n else np.zeros(0, np.int64)


def hashed_counts(docs: DataFrame, depth: int, words: Bloom | None = None) -> DataFrame:
    """(key, n): the counts of the phrases of one or two words, by hash."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _ in _shards(batches):
            end, size, count = automaton(w.hash, _runs(w, held.value, None), depth).phrases()
            end, count = end[size == depth], count[size == depth]
            keys = (w.hash if depth == 1 else _pair(w.hash))[end]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count)], names=["key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, words: Bloom, pairs: Bloom, depth: int) -> DataFrame:
    """(lang, phrase, k, n): exact counts of the phrases that the filters let through, and for each
    language a row with k = 0 that counts all words."""
    spark = docs.sparkSession.sparkContext
    w_held, p_held = spark.broadcast(words), spark.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, langs in _shards(batches):
            end, size, count = automaton(w.hash, _runs(w, w_held.value, p_held.value), depth).phrases()
            start = w.start[end - size + 1].tolist()
            stop = w.end[end].tolist()
            raw = w.raw
            text = [b" ".join(raw[a:b].replace(b"\t", b" ").split(b" ")) if k > 1 else raw[a:b] for a, b, k in zip(start, stop, size.tolist(), strict=True)]
            text = [b" ".join(filter(None, t.split(b" "))) if b"  " in t else t for t in text]
            of = w.doc[end].tolist()
            all_words = np.bincount(w.doc, minlength=len(langs))
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in of] + langs, pa.string()), pa.array([t.decode("utf-8", "replace") for t in text] + [""] * len(langs), pa.string()),
                 pa.array(np.concatenate((size, np.zeros(len(langs), np.int64)))), pa.array(np.concatenate((count, all_words)).astype(np.int64))],
                names=["lang", "phrase", "k", "n"],
            )

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, k long, n long")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def _wide(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(38,0)")


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def score(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more, each by its worst cut."""
    known = counts.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("n").alias("__n"))
    known = broadcast_if_small(known)
    cuts = counts.where("k >= 2").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "cut", _part(F.lit(1), F.col("cut").cast("int")).alias("p"), _part((F.col("cut") + 1).cast("int"), F.col("k").cast("int")).alias("q"))
    for part, out in (("p", "l"), ("q", "r")):
        cuts = cuts.join(known, (F.col("lang") == F.col("__lang")) & (F.col(part) == F.col("__phrase"))).withColumn(out, F.col("__n")).drop("__lang", "__phrase", "__n", part)
    cuts = cuts.withColumns({"__up": _wide(_wide("a") * 2_000_000), "__down": _wide(_wide("l") + _wide("r"))})
    dice = F.expr("__up div __down")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(dice.alias("score"), "cut", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def longer_counts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the most frequent phrase that is longer by a word."""
    long = counts.where("k >= 3").withColumn("w", F.split("phrase", " "))
    size = (F.col("k") - 1).cast("int")
    links = long.withColumn("phrase", F.explode(F.array(_part(F.lit(2), size), _part(F.lit(1), size))))
    return links.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def mine(docs: DataFrame, depth: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = bloom(materialise(hashed_counts(docs, 1).where(F.col("n") >= least)))
    pairs = bloom(materialise(hashed_counts(docs, 2, words).where(F.col("n") >= least)))
    counts = materialise(phrase_counts(docs, words, pairs, depth).where((F.col("n") >= least) | (F.col("k") == 0)))
    total = counts.where("k = 0").select(F.col("lang").alias("__lang"), F.col("n").alias("n"))
    counts = counts.where("k > 0")
    longer = longer_counts(counts).select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), "most")
    found = score(counts).join(longer, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")), "left")
    found = materialise(found.where(F.col("most").isNull() | (100 * _wide("most") < subsumed * _wide("a"))).drop("__lang", "__phrase", "most"))
    # Each part of a language gives its best, so no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(some))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(broadcast_if_small(total), F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, range(1, 5) t(k)
), f AS (SELECT lang, phrase, k, count(*)::BIGINT AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.w, c.a, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score, j
  FROM f c, range(1, 4) t(j), f l, f r
  WHERE c.k >= 2 AND j < c.k AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:j], ' ') AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM f, range(1, 4) t(i), range(2, 4) u(m) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score::BIGINT AS score
  FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON r.lang = t.lang WHERE rank <= 2000
"""
