"""The whole build in one call: files to a resolved graph with its detected stack and flow candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import iso_seconds
from waymark.operators import detect, resolve, traverse, views
from waymark.plans.lineage import cut
from waymark.sources import store
from waymark.sources.extract import build
from waymark.sources.files import scan_tree
from waymark.sources.snapshots import Snapshots
from waymark.streaming import incremental


@dataclass
class Scan:
    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame
    stack: DataFrame
    flows: DataFrame
    hashes: DataFrame


def full_scan(spark: SparkSession, files: DataFrame) -> Scan:
    """files (path, content, sha256) to a graph: extraction, resolution of names, flow candidates over
    the resolved edges, and the detected stack. Files are read once; what they yield is written."""
    nodes, edges, errors = build(files)
    nodes = cut(nodes)
    edges = cut(resolve.resolve(edges, nodes))
    stack = detect.detect(spark, files.select("path", F.decode("content", "UTF-8").alias("text")))
    return Scan(nodes, edges, errors, stack, traverse.flow_candidates(nodes, edges), files.select("path", "sha256"))


def init_map(spark: SparkSession, root: str, folder: str, map_dir: str | None = None) -> store.Stored:
    """Scans a working copy, saves the graph to ``folder`` as the start of incremental runs, and writes its
    pages beside the snapshots."""
    files = cut(scan_tree(spark, root, map_dir))
    none = incremental.empty(spark)
    tables = incremental.advance(none, files).applied(none).tables()
    now = spark.range(1).select(iso_seconds(F.current_timestamp())).first()[0]
    snapshots = Snapshots(spark, folder)
    snapshots.commit(snapshots.entry(), tables, version=store.VERSION, last_sync_commit=store.head_commit(spark, root), last_sync_time=now)
    kept = store.load(spark, folder)
    views.write_views(kept.nodes, kept.edges, kept.flows, f"{folder}/views")
    return kept
