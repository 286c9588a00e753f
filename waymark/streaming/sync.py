"""Incremental maintenance: purge what changed files said, extract them again, keep asserted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions.text import extension
from waymark.operators import views
from waymark.operators.build import add_edges, add_nodes, union_all
from waymark.operators.validate import diff_edges, diff_nodes, freshness, malformed_id
from waymark.plans.lineage import cut, small
from waymark.sources import store
from waymark.sources.extract import build
from waymark.sources.files import CONFIG_NAMES, SOURCE_EXTS
from waymark.sources.snapshots import Snapshots
from waymark.streaming import incremental


def sync(nodes: DataFrame, edges: DataFrame, tracked: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, states): files is the whole current tree (path, content, sha256), tracked the
    hashes of the last run. Only new and changed files are read; derived rows of changed and deleted
    files go, asserted rows stay."""
    states = freshness(tracked, files)
    gone = states.where("state != 'fresh'").select(F.col("path").alias("__p"))
    fresh = files.join(states.where("state IN ('new', 'stale')").select("path"), "path", "left_semi")
    new_nodes, new_edges, _ = build(fresh)

    def kept(df: DataFrame) -> DataFrame:
        asserted = df.where("provenance = 'asserted'")
        return df.where("provenance != 'asserted'").join(gone, F.col("file") == F.col("__p"), "left_anti").unionByName(asserted)

    # New rows come after the survivors.
    base = 1 << 50
    out_nodes = add_nodes(kept(nodes).unionByName(new_nodes.withColumn("node_seq", F.col("node_seq") + base), allowMissingColumns=True))
    out_edges = add_edges(kept(edges).unionByName(new_edges.withColumn("edge_seq", F.col("edge_seq") + base), allowMissingColumns=True))
    return out_nodes, out_edges, states


def stream(changes: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Runs ``apply(batch, batch_id)`` on each micro-batch of changed files (a readStream)."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def relevant(changed: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Of changed paths those that an extractor may claim: by extension, by name, or a CI workflow."""
    path = F.col("path")
    name = F.element_at(F.split(path, "/"), -1)
    keep = extension(path).isin(*SOURCE_EXTS) | name.isin(*CONFIG_NAMES) | path.startswith(".github/workflows/")
    for s in skip:
        keep = keep & ~path.startswith(s.rstrip("/") + "/")
    return changed.where(keep).select("path").distinct()


def purge_malformed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without ids that are too long or hold control characters, and without edges at them.
    An edge at such a node has the same bad id, so no join is needed."""
    bad = malformed_id(F.col("src")) | malformed_id(F.col("dst"))
    return nodes.where(~F.coalesce(malformed_id(F.col("id")), F.lit(False))), edges.where(~F.coalesce(bad, F.lit(False)))


def change_record(files: DataFrame, nodes: DataFrame, edges: DataFrame, most_files: int = 30, most: int = 40) -> DataFrame:
    """(section, place, line) of a change record: changed files (path), and the first significant nodes
    (of diff_nodes) and edges (of diff_edges) that came or went. No row if neither did."""
    none = F.lit("")

    def top(df: DataFrame, section: str, order: list[str], line, cap: int) -> DataFrame:
        return df.orderBy(*order).limit(cap).select(F.lit(section).alias("section"), F.concat_ws("\x00", *order).alias("place"), line.alias("line"))

    node = lambda was: F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.lit(f", {was}`"), F.coalesce("file", none), F.lit("`)"))
    keys = ["id", "kind", "name", "file"]
    parts = [
        top(files, "1 files", ["path"], F.concat(F.lit("- `"), "path", F.lit("`")), most_files),
        top(nodes.where("op = 'added'"), "2 added", keys, node(""), most),
        top(nodes.where("op = 'removed'"), "3 removed", keys, node("was "), most),
        top(edges, "4 relationships", ["src", "dst", "type"], F.concat(F.lit("- `"), "src", F.lit("` —"), "type", F.lit("→ `"), "dst", F.lit("`")), most),
    ]
    changed = nodes.select(F.lit(1).alias("x")).limit(1).unionAll(edges.select(F.lit(1).alias("x")).limit(1)).limit(1)
    return union_all(parts).join(F.broadcast(changed), F.lit(True), "left_semi")


def _text(lines: DataFrame, at: str) -> None:
    if lines.limit(1).count():
        lines.orderBy("section", "place").select("line").coalesce(1).write.mode("overwrite").text(at)


def sync_map(spark: SparkSession, folder: str, files: DataFrame, commit: str | None = None, time: str | None = None, pages: bool = True) -> DataFrame:
    """Brings the stored graph up to date with ``files`` (path, content, sha256; the whole tree) and saves
    what changed: nodes, references anywhere that now resolve to something else, flow candidates, the
    detected stack and reviews of manual bindings. The change record comes back and is written beside the
    snapshots, as are the pages. Without a change nothing is saved. A graph that was saved whole is built
    anew, with its asserted rows. Of two runs at once the slower one fails (snapshots.Conflict)."""
    snapshots = Snapshots(spark, folder)
    entry = snapshots.entry()
    if entry is None:
        raise FileNotFoundError(f"no graph in {folder}")
    info = {"version": store.VERSION, "last_sync_commit": commit, "last_sync_time": time}
    if set(incremental.SCHEMAS) <= set(entry["tables"]):
        old = incremental.Graph(**{t: snapshots.read(t, entry, schema) for t, schema in incremental.SCHEMAS.items()})
        change = incremental.advance(old, files)
        states, keys, tables = change.states, change.keys, change.rows
        before = {t: getattr(old, t).join(small(keys[t]), incremental.KEYS[t], "left_semi") for t in ("nodes", "edges")}
    else:
        kept = store.load_migrated(spark, folder)
        states = cut(freshness(kept.hashes, files).where("state != 'fresh'"))
        old = incremental.empty(spark)
        old.nodes, old.edges = incremental.asserted(*purge_malformed(kept.nodes, kept.edges))
        keys, tables = None, incremental.advance(old, files).applied(old).tables()
        before = {"nodes": kept.nodes, "edges": kept.edges}
    if not states.limit(1).count():
        none = before["nodes"].where("false")
        return change_record(states.select("path"), none.withColumn("op", F.lit("")), before["edges"].where("false"))
    now = snapshots.commit(entry, tables, keys, **info)
    after = tables if keys else {t: snapshots.read(t, now) for t in ("nodes", "edges")}
    lines = cut(change_record(states.select("path"), diff_nodes(before["nodes"], after["nodes"]), diff_edges(before["edges"], after["edges"])))
    _text(lines, f"{folder}/changes/{now['seq']:06d}")
    if pages:
        new = store.load(spark, folder, seq=now["seq"])
        views.write_views(new.nodes, new.edges, new.flows, f"{folder}/views")
    return lines
