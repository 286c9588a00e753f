"""The persisted graph: snapshots in a folder (see snapshots.py), and a log that says which one counts.

Hashes of the files that were read go along. A graph that incremental runs keep up to date has further
tables; it is read like any other.
"""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.operators.migrate import migrate
from waymark.sources.files import porcelain_path
from waymark.sources.snapshots import Snapshots

VERSION = 3
HASHES = "path string, sha256 string"
FLOWS = "seed string, kind string, chain array<string>"


@dataclass
class Stored:
    """A snapshot: its tables, and its row of the log."""

    nodes: DataFrame
    edges: DataFrame
    flows: DataFrame
    hashes: DataFrame
    state: dict


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    """The log's rows; none where nothing was saved yet."""
    return Snapshots(spark, folder).log()


def save(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, folder: str, commit: str | None = None, time: str | None = None,
         flows: DataFrame | None = None, version: int = VERSION) -> Stored:
    """Writes a whole snapshot; it is the present one as soon as its entry is in the log."""
    spark = nodes.sparkSession
    snapshots = Snapshots(spark, folder)
    tables = {"nodes": nodes, "edges": edges, "hashes": hashes.select("path", "sha256"), "flows": flows if flows is not None else spark.createDataFrame([], FLOWS)}
    snapshots.commit(snapshots.entry(), tables, version=version, last_sync_commit=commit, last_sync_time=time)
    return load(spark, folder, None)


def load(spark: SparkSession, folder: str, version: int | None = VERSION, seq: int | None = None) -> Stored:
    """The present snapshot, or an older one by its number. Another version than asked for is an error
    (None takes any)."""
    snapshots = Snapshots(spark, folder)
    row = snapshots.entry(seq)
    if row is None:
        raise FileNotFoundError(f"no graph in {folder}")
    if version is not None and row["version"] != version:
        raise ValueError(f"graph of version {row['version']}, not {version}: build it anew or load it with load_migrated()")
    nodes, edges = (snapshots.read(t, row) for t in ("nodes", "edges"))
    if "at" in nodes.columns:  # kept by incremental runs: the place in the walk is the order
        nodes, edges = nodes.withColumnRenamed("at", "node_seq"), edges.withColumnRenamed("at", "edge_seq")
    return Stored(nodes, edges, snapshots.read("flows", row, FLOWS), _hashes(snapshots, row), row.asDict())


def _hashes(snapshots: Snapshots, row: Row | None) -> DataFrame:
    try:
        out = snapshots.read("hashes", row, HASHES) if row else None
    except AnalysisException:
        out = None
    return snapshots.spark.createDataFrame([], HASHES) if out is None else out


def load_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of the present snapshot; no rows where they are missing or can't be read."""
    snapshots = Snapshots(spark, folder)
    return _hashes(snapshots, snapshots.entry())


def load_migrated(spark: SparkSession, folder: str, keep: bool = False) -> Stored:
    """The present snapshot in the present version; with ``keep`` it is saved so."""
    old = load(spark, folder, None)
    if old.state["version"] == VERSION:
        return old
    nodes, edges = migrate(old.nodes, old.edges, old.state["version"])
    if keep:
        return save(nodes, edges, old.hashes, folder, old.state["last_sync_commit"], old.state["last_sync_time"], old.flows)
    return Stored(nodes, edges, old.flows, old.hashes, {**old.state, "version": VERSION})


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A new graph."""
    return spark.createDataFrame([], S.NODE_SCHEMA), spark.createDataFrame([], S.EDGE_SCHEMA)


# --- What changed, as version control tells


def git_lines(spark: SparkSession, root: str, *command: str) -> DataFrame:
    """(value): a git command's lines, leading blanks kept; none if it fails or takes 30 seconds. This
    asks a working copy, so it runs on the driver."""
    try:
        out = subprocess.run(["git", "-C", root, *command], capture_output=True, text=True, timeout=30, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        out = ""
    return spark.createDataFrame([(x,) for x in out.splitlines()], "value string")


def head_commit(spark: SparkSession, root: str) -> str | None:
    row = git_lines(spark, root, "rev-parse", "HEAD").first()
    return row["value"].strip() if row else None


def changed_paths(diff: DataFrame, status: DataFrame, prefix: str = "", skip: tuple[str, ...] = ()) -> DataFrame:
    """(path): paths of a name-only diff and of status lines (value), relative to the scanned folder.
    ``prefix`` is that folder below the repository's top; paths outside it, and paths that start with
    one of ``skip`` (the map's own folder), are left out."""
    path = F.col("path")
    rows = diff.select(F.col("value").alias("path")).unionAll(status.select(porcelain_path(F.col("value")).alias("path")))
    if prefix:
        rows = rows.where(path.startswith(prefix + "/")).select(F.substring(path, len(prefix) + 2, 1 << 30).alias("path"))
    for s in skip:
        rows = rows.where(~path.startswith(s.rstrip("/") + "/"))
    return rows.where("path != ''").distinct()


def changed_since(spark: SparkSession, root: str, base: str | None, prefix: str = "", skip: tuple[str, ...] = ()) -> DataFrame:
    none = spark.createDataFrame([], "value string")
    diff = git_lines(spark, root, "diff", "--name-only", f"{base}..HEAD") if base else none
    return changed_paths(diff, git_lines(spark, root, "status", "--porcelain"), prefix, skip)


# --- Curated files beside the map


def change_records(texts: DataFrame, newest: int = 8) -> DataFrame:
    """(file, title) of the newest change records: texts (path, text), by file name; the title is the
    first heading of the first eight lines, else the name, of 120 characters at most."""
    name = F.element_at(F.split("path", "/"), -1)
    top = texts.select(name.alias("file"), "text").where(F.col("file").endswith(".md")).orderBy(F.desc("file")).limit(newest)
    lines = F.transform(F.slice(F.split("text", "\r\n|[\n\r]"), 1, 8), F.trim)
    heads = F.filter(lines, lambda x: x.startswith("#"))
    title = F.coalesce(F.trim(F.regexp_replace(F.get(heads, F.lit(0)), "^[# ]+", "")), F.col("file"))
    return top.select("file", F.substring(title, 1, 120).alias("title"))


def curated_flows(texts: DataFrame) -> DataFrame:
    """(seed, kind, chain, source): Markdown files with lines `node: <id>`; _candidates.md is no flow."""
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.transform(F.split("text", "\r\n|[\n\r]"), F.trim)
    ids = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("node:")), lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), "^[`\"'\\s]+|[`\"'\\s]+$", ""))
    rows = texts.select(name.alias("file"), F.filter(ids, lambda x: x != "").alias("chain"), F.col("path").alias("source"))
    keep = F.col("file").endswith(".md") & (F.col("file") != "_candidates.md") & (F.size("chain") > 0)
    return rows.where(keep).select(F.regexp_replace("file", "[.]md$", "").alias("seed"), F.lit("curated").alias("kind"), "chain", "source")
