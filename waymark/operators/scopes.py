"""As-of and interval operators: enclosing scopes, forward annotations, spans, distributed ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing(rows: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """Adds scope: the latest non-null ``opens`` at or above the row in its group (as-of)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("scope", F.last(opens, ignorenulls=True).over(w))


def annotated(rows: DataFrame, keys: list[str], order: list[str], note: Column, declares: Column) -> DataFrame:
    """The declaring rows with note: the latest annotation since the declaration before."""
    rows = rows.withColumns({"__note": note, "__decl": declares})
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__seg", F.coalesce(F.sum(F.col("__decl").cast("int")).over(before), F.lit(0)))
    own = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("note", F.last("__note", ignorenulls=True).over(own)).where("__decl").drop("__note", "__decl", "__seg")


def outside_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """Points in no span [start, end) of their group, by a sweep: in the order of positions, a point is
    inside if the greatest end so far lies beyond it. Positions are cut into blocks of ``width``, each
    swept by itself; what earlier blocks leave is the greatest end of each, so a large group is shared
    out and no point meets a span. Nulls are a group of their own; a point at null is outside."""
    pos = lambda c: F.col(c).cast("double")
    here = points.select(F.struct(*points.columns).alias("row"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], pos(at).alias("at"), F.lit(None).cast("double").alias("end"))
    there = spans.select(F.lit(None).cast(here.schema["row"].dataType).alias("row"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], pos(start).alias("at"), pos(end).alias("end"))
    group = [f"__{i}" for i in range(len(keys))]
    events = here.unionByName(there.where("at IS NOT NULL AND end > at")).withColumn("block", F.floor(F.coalesce("at", F.lit(0.0)) / width))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy(*group, "block").agg(F.max("end").alias("most")).withColumn("left", F.max("most").over(before))
    left = blocks.where("left IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in (*group, "block")], "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, "block")])
    upto = Window.partitionBy(*group, "block").orderBy("at", F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("reach", F.max("end").over(upto)).where("row IS NOT NULL").join(left, same, "left")
    inside = F.greatest("reach", "left") > F.col("at")
    return swept.where(~F.coalesce(inside, F.lit(False))).select("row.*")


def global_rank(rows: DataFrame, key: str) -> DataFrame:
    """Adds rank (1, 2, ...) by ``key`` over all rows without one task that sees them all: range
    partitions, sorted each for itself, with the sizes of the partitions before."""
    from waymark.plans.lineage import cut

    # The number of a row's partition is in the upper bits, its place there in the lower 33.
    part = cut(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__m", F.monotonically_increasing_id()))
    part = part.withColumns({"__p": F.shiftright("__m", 33), "__r": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m")
    sizes = part.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row per partition: its offset is the sum over those before.
    offsets = sizes.withColumn("__off", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    out = part.join(F.broadcast(offsets.select("__p", "__off")), "__p")
    return out.withColumn("rank", (F.col("__r") + 1 + F.coalesce("__off", F.lit(0))).cast("long")).drop("__p", "__r", "__off")
