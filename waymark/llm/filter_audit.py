"""Filter interaction audit, with DataFrame functions only.

Five filters fail a document or not; all that any order of them does to a corpus follows from how many
documents of a part have each of the 32 failure masks.

1. Expressions on the text give four bits. The fifth (a smaller doc_id has the same text) comes from an
   aggregate: rows of one text, told by its SHA-256, are counted by part, mask and labels, so a group of
   copies is reduced before it is shuffled, and the least doc_id of a text is the minimum over its few
   counts. No copy is joined to its group again.
2. Counts are added up to 32 cells a part.
3. The 120 orders and their five steps are read off the cells. The Shapley figure has a closed form: a
   filter comes first among the k that a document fails in 120 / k orders.

Cases: a null text is empty; a null source is the part ''; a row with a null doc_id is never a repeat and
makes no other row one; repeated rows count again, and those of the least doc_id are no repeats; labels
count if any of a doc_id's rows says 1; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, broadcast_if_small, materialise, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
REPEAT = 1 << FILTERS.index("E")
#: Least words; least distinct words and most capitals, in percent.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the bits A to D of each row, and the SHA-256 of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(ASCII_SPACE))
    rows = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1)))
    n = F.size("words").cast("long")
    length = F.length("text").cast("long")
    capitals = length - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    failed = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")).cast("long") < MIN_DISTINCT * n,
        100 * capitals > MAX_CAPITALS * length,
        F.col("text").rlike(SYMBOLS),
    )
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and failure mask, and how many of them are
    labelled good or toxic."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id"))
    told = materialise(told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    told = told.where("good OR toxic")
    rows = text_masks(docs).join(broadcast_if_small(told), F.col("doc_id") == F.col("__id"), "left")
    rows = rows.select("doc_id", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    # The least doc_id of each kind of copies, and its rows: those are no repeats if no other kind has a lesser one.
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = rows.groupBy(*kind, F.col("doc_id").isNull().alias("unknown")).agg(F.sum("n").alias("n"), F.min(own).alias("least"))
    kinds = kinds.withColumn("of_all", F.min("least.doc_id").over(Window.partitionBy("digest")))
    first = F.when(F.col("unknown"), F.col("n")).when(F.col("least.doc_id") == F.col("of_all"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("m"), first.alias("c")), F.struct((F.col("mask") + REPEAT).alias("m"), (F.col("n") - first).alias("c")))
    parts = kinds.withColumn("x", F.explode(both)).where("x.c > 0")
    held = lambda c: F.sum(F.when(F.col(c), F.col("x.c")).otherwise(0)).alias(c)
    return parts.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.c").alias("n"), held("good"), held("toxic"))


def _bits(letters: Column) -> Column:
    """The mask of some filters, by their letters."""
    bit = lambda f: F.when(F.instr(letters, f) > 0, 1 << FILTERS.index(f)).otherwise(0)
    return sum((bit(f) for f in FILTERS), F.lit(0))


def audit(counts: DataFrame) -> DataFrame:
    """What each step of each order does to each part, from cells(): one row with the part's cells (32 at
    most) is exploded to the 600 steps, which are sums over them."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = held.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", _bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))))
    steps = steps.withColumn("before", _bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")

    def total(keep, what=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda t, c: t + what(c))

    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    removed = lambda c: fails(c) & ~gone(c)
    share = lambda c: (c["n"] * (len(ORDERS) / F.bit_count(c["mask"])).cast("int")).cast("long")
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(removed).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"), total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lab AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS x
  FROM d LEFT JOIN lab USING (doc_id)
), flags AS (
  SELECT part, good, toxic, map {'A': x.A, 'B': x.B, 'C': x.C, 'D': x.D, 'E': x.E} AS m,
         x.A::INT + x.B::INT + x.C::INT + x.D::INT + x.E::INT AS fails FROM f
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT o, s, substr(o, s, 1) AS l, string_split(substr(o, 1, s - 1), '') AS before FROM orders, range(1, 6) r(s)),
grouped AS (SELECT part, m, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM flags GROUP BY ALL),
ran AS (
  SELECT part, o, s, l, fails, n, g, x, m[l] AS bad, coalesce(list_bool_or(list_transform(list_filter(before, lambda y: y <> ''), lambda y: m[y])), false) AS gone
  FROM grouped, steps
), out AS (
  SELECT part, o AS filter_order, s::INT AS step, l, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE bad AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE bad AND fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(x) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM ran GROUP BY part, o, s, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM out
"""
