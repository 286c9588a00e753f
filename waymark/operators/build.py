"""Graph build: first-wins inserts, placeholder tests and schema checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.plans.lineage import by_shuffle, cut, side

#: Missing ids up to which they may be broadcast (within the bytes that any table may have).
MISSING_ROWS = 1_000_000


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the least ``seq`` of each key. A combined aggregate, not a window: it is reduced
    before the shuffle, and a key with very many rows needs no sort in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(df.columns)


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(df.columns)


def add_nodes(nodes: DataFrame) -> DataFrame:
    """First id wins; later attributes are discarded."""
    return first_wins(nodes, ["id"], "node_seq")


def add_edges(edges: DataFrame) -> DataFrame:
    """First (src, dst, type) wins."""
    return first_wins(edges, ["src", "dst", "type"], "edge_seq")


def missing(edges: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """(__id): the ids at the given ends of edges that no node has. Distinct ids are compared, not edges,
    and as a rule few are missing: the edges are joined with those, by broadcast where they are small. The
    nodes' own ids are never broadcast."""
    own = edges.select(F.explode(F.array(*ends)).alias("__id")) if len(ends) > 1 else edges.select(F.col(ends[0]).alias("__id"))
    gone = own.where("__id IS NOT NULL").distinct().join(by_shuffle(nodes.select(F.col("id").alias("__id"))), "__id", "left_anti")
    return side(cut(gone), rows=MISSING_ROWS)


def with_placeholder(edges: DataFrame, nodes: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Adds dst_exists and placeholder: unresolved:* always; other bare names only without a node. ``gone``:
    what missing() gives for the targets (or for more ends), where that is known."""
    joined = edges.join(missing(edges, nodes, "dst") if gone is None else gone, F.col("dst") == F.col("__id"), "left")
    dst = F.col("dst")
    exists = dst.isNotNull() & F.col("__id").isNull()
    return joined.withColumns(
        {"dst_exists": exists, "placeholder": S.is_unresolved(dst) | (~exists & S.bare_placeholder(dst))}
    ).drop("__id")


def _missing_bare(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return missing(edges.where(S.bare_placeholder(F.col("dst"))), nodes.where(S.bare_placeholder(F.col("id"))), "dst")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that can be walked: the target is no placeholder. Only bare names have to be looked up."""
    gone = _missing_bare(edges, nodes)
    return edges.where(~S.is_unresolved(F.col("dst"))).join(gone, F.col("dst") == F.col("__id"), "left_anti")


def placeholder_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The other edges, as far as they have a target."""
    gone = _missing_bare(edges, nodes)
    bare = edges.where(S.bare_placeholder(F.col("dst"))).join(gone, F.col("dst") == F.col("__id"), "left_semi")
    return edges.where(S.is_unresolved(F.col("dst"))).unionByName(bare)


def node_errors() -> Column:
    """Array of reasons why a node breaks the data model; empty where it is sound."""
    c = F.col
    asserted = c("provenance") == "asserted"
    intent = c("kind").isin(*S.INTENT_KINDS)
    tests = [
        (c("id").isNull() | (c("id") == ""), "no id"),
        (~c("kind").isin(*S.NODE_KINDS), "unknown kind"),
        (~c("provenance").isin(*S.PROVENANCES), "unknown provenance"),
        (asserted & ~intent, "asserted node of a derived kind"),
        (~asserted & intent, "derived node of an intent kind"),
        (asserted & c("confidence").isNotNull(), "asserted node with a confidence"),
        (~asserted & ~F.coalesce(c("confidence").isin(*S.CONFIDENCES), F.lit(False)), "unknown confidence"),
    ]
    found = F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(text)) for test, text in tests])
    return F.array_compact(found)


def edge_errors() -> Column:
    c = F.col
    asserted = c("provenance") == "asserted"
    intent = c("type").isin(*S.INTENT_EDGE_TYPES)
    tests = [
        (~c("type").isin(*S.EDGE_TYPES), "unknown type"),
        (~c("provenance").isin(*S.PROVENANCES), "unknown provenance"),
        (asserted & ~intent, "asserted edge of a derived type"),
        (~asserted & intent, "derived edge of an intent type"),
        (asserted & c("confidence").isNotNull(), "asserted edge with a confidence"),
        (~asserted & ~F.coalesce(c("confidence").isin(*S.CONFIDENCES), F.lit(False)), "unknown confidence"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(text)) for test, text in tests]))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
