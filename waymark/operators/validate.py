"""Validation metrics, the issues table, snapshots, diffs and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.operators.build import missing, union_all, with_placeholder


def malformed_id(col) -> F.Column:
    return (F.length(col) > S.MAX_ID_LENGTH) | col.rlike(r"[\x00-\x1F]")


def malformed_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, id): ids that are too long or hold control characters; an edge is told once."""
    c = F.col
    n = nodes.where(malformed_id(c("id"))).select(F.lit("node").alias("what"), "id")
    e = edges.where(malformed_id(c("src")) | malformed_id(c("dst"))).select(F.lit("edge").alias("what"), F.concat("src", F.lit(" -> "), "dst").alias("id"))
    return n.unionAll(e)


def broken_edges(edges: DataFrame, nodes: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Edges whose source is missing, or whose target is missing and no placeholder. ``gone``: the missing
    ids of both ends, where they are known."""
    gone = missing(edges, nodes, "src", "dst") if gone is None else gone
    here, there = (gone.select(F.col("__id").alias(k)) for k in ("__s", "__d"))
    rows = edges.join(here, F.col("src") == F.col("__s"), "left").join(there, F.col("dst") == F.col("__d"), "left")
    dst = F.col("dst")
    lost = F.col("__d").isNotNull() & ~S.is_unresolved(dst) & ~S.bare_placeholder(dst)
    return rows.where(F.col("src").isNull() | F.col("__s").isNotNull() | lost).select("src", "dst", "type", "file", "line")


def issues(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """(severity, category, message, id, file, line)."""
    c, none = F.col, F.lit(None)
    cols = lambda sev, cat, msg, id_, file, line: [
        F.lit(sev).alias("severity"), F.lit(cat).alias("category"), msg.alias("message"), id_.alias("id"),
        file.cast("string").alias("file"), line.cast("int").alias("line"),
    ]
    gone = missing(edges, nodes, "src", "dst")
    no_src = edges.join(gone, c("src") == c("__id"), "left").where(c("src").isNull() | c("__id").isNotNull())
    dup = nodes.groupBy("id").count().where(c("count") > 1)
    flagged = with_placeholder(edges, nodes, gone)
    no_file = c("file").isNull() | (c("file") == "") | (c("confidence") == "UNKNOWN")
    parts = [
        dup.select(*cols("HIGH", "validation", F.lit("duplicate node id"), c("id"), none, none)),
        no_src.select(*cols("HIGH", "validation", F.concat(F.lit("edge with unknown src "), "type"), c("src"), c("file"), c("line"))),
        flagged.where(~c("dst_exists") & ~c("placeholder")).select(*cols("HIGH", "validation", F.concat(F.lit("edge with unknown dst "), "type"), c("dst"), c("file"), c("line"))),
        nodes.where(F.coalesce(no_file, F.lit(False))).select(*cols("MEDIUM", "validation", F.lit("node without evidence"), c("id"), c("file"), c("line"))),
        unresolved.select(*cols("LOW", "unresolved", F.lit("unresolved reference"), c("ref"), none, none)),
        nodes.where("confidence = 'LOW'").select(*cols("LOW", "low-confidence", F.lit("LOW-confidence node (lead, not confirmed)"), c("id"), c("file"), c("line"))),
        edges.where("confidence = 'LOW'").select(*cols("LOW", "low-confidence", F.concat(F.lit("LOW-confidence edge "), "type"), c("src"), c("file"), c("line"))),
    ]
    if stale is not None:
        parts.append(stale.select(*cols("MEDIUM", "stale", F.lit("file changed since last sync"), none.cast("string"), c("file"), none)))
    return union_all(parts)


def validate(nodes: DataFrame, edges: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """(check, n): findings per check."""
    c = F.col
    gone = missing(edges, nodes, "src", "dst")
    broken = broken_edges(edges, nodes, gone)
    checks = {
        "unknown_kind": nodes.where(~c("kind").isin(*S.NODE_KINDS)),
        "unknown_type": edges.where(~c("type").isin(*S.EDGE_TYPES)),
        "malformed_id": malformed_ids(nodes, edges),
        "duplicate_id": nodes.groupBy("id").count().where(c("count") > 1),
        "broken_edge": broken,
        "no_evidence": nodes.where(F.coalesce(c("file").isNull() | (c("file") == "") | (c("confidence") == "UNKNOWN"), F.lit(False))),
        "placeholder_edge": with_placeholder(edges, nodes, gone).where("placeholder"),
        "low_confidence": nodes.where("confidence = 'LOW'").select("id").unionAll(edges.where("confidence = 'LOW'").select("src")),
    }
    if stale is not None:
        checks["stale_file"] = stale
    return union_all([df.agg(F.lit(k).alias("check"), F.count("*").alias("n")) for k, df in checks.items()])


def verdict(checks: DataFrame) -> DataFrame:
    """NEEDS_SYNC if a file is stale, else NEEDS_ATTENTION if there are findings, else OK."""
    bad = ("unknown_kind", "unknown_type", "malformed_id", "duplicate_id", "broken_edge", "no_evidence")
    return checks.agg(
        F.when(F.sum(F.when(F.col("check") == "stale_file", F.col("n")).otherwise(0)) > 0, "NEEDS_SYNC")
        .when(F.sum(F.when(F.col("check").isin(*bad), F.col("n")).otherwise(0)) > 0, "NEEDS_ATTENTION").otherwise("OK").alias("status")
    )


def diff_nodes(old: DataFrame, new: DataFrame, significant: bool = True) -> DataFrame:
    """(op, id, kind, name, file) of nodes that came or went; a changed one does both."""
    cols = ["id", "kind", "name", "file"]
    a, b = old.select(cols), new.select(cols)
    out = b.subtract(a).withColumn("op", F.lit("added")).unionAll(a.subtract(b).withColumn("op", F.lit("removed")))
    return out.where(F.col("kind").isin(*S.SIGNIFICANT_KINDS)) if significant else out


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    cols = ["src", "dst", "type"]
    a, b = old.select(cols), new.select(cols)
    return b.subtract(a).withColumn("op", F.lit("added")).unionAll(a.subtract(b).withColumn("op", F.lit("removed")))


def freshness(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): stale (hash differs), deleted, new or fresh; one full outer hash join."""
    a = tracked.select("path", F.col("sha256").alias("old"))
    b = current.select("path", F.col("sha256").alias("new"))
    state = (
        F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "new")
        .when(F.col("old") != F.col("new"), "stale").otherwise("fresh")
    )
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))
