"""Near-duplicate components with b-bit MinHash.

1. Each set of word shingles gets BANDS x ROWS minima. Of each minimum only the low BITS bits stay, packed
   as bit planes: 96 bytes a set. The whole minima are needed once, for the band keys.
2. Bands give candidates: two sets meet in a list if all minima of a band are equal. Equal sets are one
   class before that, so copies cost nothing. Lists of up to a dozen classes give their pairs. A longer
   list (as of a passage that many texts share) is left out by the sets that have at most SLACK of them;
   what is in more of them is a family of similar sets, compared with its leader, and links that the
   leader can't tell follow from the differences to it (see the n-gram Jaccard join, which has these
   steps too). No list gives all pairs of a large group, and none is cut off.
3. A pair is dropped on its signatures alone if the similarity they tell is far too low: with b bits two
   unequal minima agree by chance in 1 of 2^b cases, so the similarity is (agreement - 2^-b) / (1 - 2^-b),
   and agreement is a count of bits over the planes. Of the pairs that stay, sketches of two bits a
   shingle bound the difference from below, and what is too different by that bound is dropped as well.
4. What is left is confirmed on the full sets; links make components.

How sure: sets at the threshold s agree in a band with probability s^ROWS; all bands fail with
(1 - s^ROWS)^BANDS, under 10^-10 for 0.8. If all bands in which they agree are left out, the complete keys
tell the pair with certainty. The bound on differing minima is further off than that. Both are chances per
link at the very threshold, and fall fast above it.

Cases: null or empty texts and texts without words have no shingles, link with nothing and are their own
component; fewer words than k form one shingle; rows with a null doc_id take no part in linking
(component_id null, kept); repeated rows get equal rows; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialise, table
from .jaccard import (
    CLASSES, FAMILY, Scheme, class_of, classes_of, components_of, index_entries, meetings, rows_of, salted, sets_of, unseen,
)
from .wordhash import mix, parts

WORDS, PERCENT = 4, 80
BANDS, ROWS, BITS = 48, 4, 4
MINIMA = BANDS * ROWS
SLACK = 12
#: The band keys' size class for components_of: above those of the complete keys.
BAND_CLASS = CLASSES - 1
#: Shingles that are hashed at a time (they stay in the processor's cache).
BLOCK = 1 << 15

_SEEDS = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _SCALE = _SEEDS[:MINIMA], _SEEDS[MINIMA:] | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA rows: of each hash function, the least hash of each (non-empty) set."""
    out = np.empty((MINIMA, len(sets)), dtype=np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= BLOCK):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        if j == i + 1 and size > BLOCK:  # one long set, in pieces
            starts = np.arange(0, size, BLOCK)
        else:
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]], dtype=np.int64)))
        for f in range(MINIMA):
            least = np.minimum.reduceat((flat ^ _FLIP[f]) * _SCALE[f], starts)
            out[f, i:j] = least.min() if len(least) > j - i else least
        i = j
    return out


def planes(least: np.ndarray) -> np.ndarray:
    """(sets, BITS * MINIMA / 64): the low bits of the minima, a bit plane after the other."""
    low = mix(least)  # the last bits of a product depend on few bits
    parts = []
    for b in range(BITS):
        bit = ((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        parts.append(np.ascontiguousarray(np.packbits(bit, axis=1, bitorder="little")).view("<u8"))
    return np.concatenate(parts, axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """(sets, BANDS): hashes of the bands' minima; their last bits tell the bands' class."""
    key = np.zeros((BANDS, least.shape[1]), dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64))[:, None]
    for r in range(ROWS):
        key = mix(key ^ least[r::ROWS])
    return (key | np.uint64(BAND_CLASS)).T


def similarity(agreeing: float, total: int = MINIMA, bits: int = BITS) -> float:
    """The collision-corrected similarity of two signatures that agree in so many of ``total`` minima."""
    chance = 2.0**-bits
    return (agreeing / total - chance) / (1 - chance)


def most_differing(percent: int) -> int:
    """Differing minima beyond which a pair is dropped: eight standard deviations above what the threshold
    lets expect."""
    p = (1 - percent / 100) * (1 - 2.0**-BITS)
    return int(MINIMA * p + 8 * (MINIMA * p * (1 - p)) ** 0.5)


def near_signatures(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """Whether the signatures and sizes leave the pair a chance, by bit counts over the planes."""
    words = MINIMA // 64
    differ = F.lit(0)
    for w in range(words):
        planes_differ = [F.get(F.col(a), F.lit(p * words + w)).bitwiseXOR(F.get(F.col(b), F.lit(p * words + w))) for p in range(BITS)]
        either = planes_differ[0]
        for x in planes_differ[1:]:
            either = either.bitwiseOR(x)
        differ = differ + F.bit_count(either)
    sizes = (F.col(na) * percent <= F.col(nb) * 100) & (F.col(nb) * percent <= F.col(na) * 100)
    return sizes & (differ <= most_differing(percent))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls, chk, bits, keys): size, class, packed signature and band keys of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            sets = list(sets_of(b.column(1).to_pylist(), k))
            full = [s for s in sets if len(s)]
            least = minima(full)
            bits, keys = planes(least), band_keys(least)
            some = np.array([len(s) > 0 for s in sets], dtype=bool)
            ids = [class_of(s) if len(s) else (None, None) for s in sets]
            at = lambda width: pa.array(np.concatenate(([0], np.cumsum(some * width))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([c for c, _ in ids], pa.int64()), pa.array([c for _, c in ids], pa.int64()),
                 pa.ListArray.from_arrays(at(bits.shape[1]), pa.array(np.ascontiguousarray(bits).ravel().view(np.int64))),
                 pa.ListArray.from_arrays(at(BANDS), pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)))],
                names=["doc_id", "n", "cls", "chk", "bits", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, cls long, chk long, bits array<long>, keys array<long>"
    )


def band_entries(prof: DataFrame) -> DataFrame:
    """(key, cls, salt): the band lists' entries of profiles (cls, keys); a task tells equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for b in batches:
            first = [i for i, c in enumerate(b.column(0).to_pylist()) if unseen(c, seen)]
            if first:
                b = b.take(pa.array(first))
                of = np.repeat(b.column(0).to_numpy(), BANDS)
                key, of, salt = salted(b.column(1).flatten().to_numpy().view(np.uint64), of)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(of), pa.array(salt)], names=["key", "cls", "salt"])

    return prof.where("cls IS NOT NULL AND doc_id IS NOT NULL").select("cls", "keys").mapInArrow(run, "key long, cls long, salt int")


def _of_left_out_lists(met: DataFrame) -> DataFrame:
    """(cls): the classes of lists that some class leaves out."""
    listed = met.where("key IS NOT NULL").select("key", F.col("a").alias("cls")).distinct()
    listed = materialise(listed.withColumn("many", F.count("*").over(Window.partitionBy("cls"))))
    lists = materialise(listed.where(F.col("many") <= SLACK).select("key").distinct())
    out = materialise(listed.join(broadcast_if_small(lists), "key", "left_semi").select("cls").distinct())
    discard(listed, lists)
    return out


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, family: int = FAMILY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prof = materialise(signatures(docs, k))
    classes = classes_of(prof, "bits")
    met = materialise(meetings(band_entries(prof)))
    scheme = Scheme(percent)
    slack = [scheme.slack(g) for g in range(len(scheme.ends) - 1)]
    slack += [0] * (BAND_CLASS - len(slack)) + [SLACK]
    rest = _of_left_out_lists(met)
    if rest.limit(1).count():
        reps = materialise(classes.select("cls", "rep").join(broadcast_if_small(rest), "cls", "left_semi").select("rep"))
        met = met.unionByName(materialise(meetings(index_entries(rows_of(docs, reps), k, percent))))
    out = components_of(docs, prof, classes, met, slack, near_signatures, k, percent, family, coarse=True)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
           THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.y FROM r JOIN both_ways t ON r.b = t.x
  ) SELECT a, min(b) AS c FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, reach.c AS component_id, s.doc_id = reach.c AS kept
FROM sets s JOIN reach ON s.doc_id = reach.a
"""
