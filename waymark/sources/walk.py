"""A pruned walk of a file tree: folders are listed level by level, each level as one Spark job, and a
folder that is skipped is never entered. Names that begin with a dot or an underscore count as any other.

The frontier is a table, so a lost executor costs one level. Paths may be local or of any file system
that Arrow knows by its URI."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.lineage import Levels

ENTRY = "path string, folder boolean, length long, modified timestamp, error string"
CONTENT = "path string, length long, content binary"
#: Bytes of file content that one Arrow batch holds, unless a single file has more.
BATCH_BYTES = 16 << 20


def _system(root: str) -> tuple[fs.FileSystem, str]:
    """File system and base path of a root."""
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    return system, base.rstrip("/")


def _spread(folders: DataFrame, rows: int, each: int = 32) -> DataFrame:
    """The folders over as many tasks as there are ``each``-folder shares, in random order: a deep
    subtree lists next to each other otherwise."""
    return folders.repartition(max(1, min(10_000, -(-rows // each))), F.xxhash64("path"))


def listing(folders: DataFrame, root: str) -> DataFrame:
    """ENTRY rows of what lies directly in each folder (path, relative to ``root``; empty: the root).
    A folder that can't be read, or is gone, gives one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for b in batches:
            for folder in b.column("path").to_pylist():
                rows = []
                try:
                    for x in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base or "/")):
                        if x.type in (fs.FileType.File, fs.FileType.Directory):
                            is_file = x.type == fs.FileType.File
                            rows.append((f"{folder}/{x.base_name}" if folder else x.base_name, not is_file, x.size if is_file else None, x.mtime, None))
                except OSError as e:
                    rows = [(folder, True, None, None, str(e))]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["path", "folder", "length", "modified", "error"])

    return folders.select("path").mapInArrow(run, ENTRY)


def walk(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = (), skip_prefixes: tuple[str, ...] = (), most_levels: int = 1000) -> DataFrame:
    """ENTRY rows of all files and folders below ``root`` that lie in no skipped folder. A skipped
    folder stands in the result (as what was seen in its parent) but nothing below it is listed.

    ``skip_dirs`` are names at any depth, ``skip_prefixes`` beginnings of names. Links to folders are
    followed; a tree deeper than ``most_levels`` (a link to its own parent) is an error, as is a root that
    can't be listed."""
    name = F.element_at(F.split("path", "/"), -1)
    skipped = name.isin(*skip_dirs) if skip_dirs else F.lit(False)
    for p in skip_prefixes:
        skipped = skipped | name.startswith(p)
    levels = Levels(listing(spark.createDataFrame([("",)], "path string"), root))
    front = levels.all()
    if lost := front.where("path = ''").first():
        raise FileNotFoundError(lost["error"])
    for _ in range(most_levels):
        folders = front.where(F.col("folder") & F.col("error").isNull() & ~skipped).select("path")
        n = folders.count()
        if not n:
            return levels.all()
        front = levels.append(listing(_spread(folders, n), root))
    raise ValueError(f"{root} is deeper than {most_levels} folders")


def contents(files: DataFrame, root: str, each: int = BATCH_BYTES) -> DataFrame:
    """CONTENT rows of files (path, length) below ``root``, shared out by their bytes. A file that is
    gone by now is left out."""
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    parts = max(1, min(100_000, max(-(-total[0] // (4 * each)), -(-total[1] // 2000))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        rows: list[tuple[str, int, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["path", "length", "content"])

        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                rows.append((path, len(data), data))
                held += len(data)
                if held >= each:
                    yield flush()
                    rows, held = [], 0
        yield flush()

    return files.select("path").repartition(parts, F.xxhash64("path")).mapInArrow(run, CONTENT)
