"""Snapshots of tables in a folder, written as changes, with a log that says which ones count.

A commit writes a part: for each table the rows of some keys, and the keys themselves. A snapshot is a
list of parts; of each key the rows of the last part that names it count, so a part replaces what it
touches and no more is written than that. Every MAX_PARTS parts the tables are written in full again.

A commit is done when the next entry of the log is there. An entry is a file that can only be made by one
writer: a second one that started from the same entry fails and leaves the tables as they are. Readers see
an entry whole or not at all, and may ask for any older one.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymark.plans.lineage import small

MAX_PARTS = 16
ENTRY = (
    "seq long, snapshot string, version int, last_sync_commit string, last_sync_time string, node_count long, edge_count long,"
    " parts array<string>, tables array<string>, batch long"
)


class Conflict(Exception):
    """Another writer made the entry first."""


def create_exclusively(spark: SparkSession, path: str, text: str) -> None:
    """Makes a file that must not be there yet; Conflict if it is."""
    url = urlparse(path)
    if url.scheme in ("", "file"):  # a name appears with its whole content, once
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        own = f"{os.path.dirname(url.path)}/.{uuid.uuid4().hex}"
        with open(own, "x") as f:
            f.write(text)
        try:
            os.link(own, url.path)
        except FileExistsError as e:
            raise Conflict(path) from e
        finally:
            os.unlink(own)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self) -> DataFrame:
        """The entries; none where nothing was saved yet."""
        try:
            return self.spark.read.schema(ENTRY).json(f"{self.folder}/log").where("seq IS NOT NULL")
        except AnalysisException:
            return self.spark.createDataFrame([], ENTRY)

    def entry(self, seq: int | None = None) -> Row | None:
        """The last entry, or the one of a number."""
        log = self.log()
        return (log if seq is None else log.where(F.col("seq") == seq)).orderBy(F.desc("seq")).first()

    def read(self, table: str, entry: Row, schema: str | None = None) -> DataFrame:
        """A table as of an entry."""
        return self._merged(table, list(entry["parts"]), schema)

    def _merged(self, table: str, parts: list[str], schema: str | None = None) -> DataFrame:
        """All parts in one scan; the number in a part's name tells which one a row is from."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        out = reader.parquet(*[f"{self.folder}/{p}/{table}" for p in parts])
        if len(parts) == 1:
            return out
        columns = out.columns
        number = F.regexp_extract("_metadata.file_path", r"/part-([0-9]+)-[0-9a-f]{32}/[^/]*/[^/]*$", 1).cast("long")
        keys = self.spark.read.parquet(*[f"{self.folder}/{p}/{table}-keys" for p in parts[1:]])
        by = keys.columns
        last = keys.withColumn("__n", number).groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max("__n").alias("__last"))
        test = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in by])
        return out.withColumn("__part", number).join(small(last), test, "left").where("__last IS NULL OR __part >= __last").select(columns)

    def commit(self, after: Row | None, tables: dict[str, DataFrame], keys: dict[str, DataFrame] | None = None, **info) -> Row:
        """Adds an entry that follows ``after`` (None: the first). Without ``keys`` the tables are whole;
        else they hold all rows of the keys given for them, and other rows stay. Conflict if another
        writer was first: its entry stands, and nothing of this one is seen."""
        seq = after["seq"] + 1 if after else 1
        part = f"part-{seq:08d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{part}/{name}")
            if keys is not None:
                keys[name].distinct().write.parquet(f"{self.folder}/{part}/{name}-keys")
        parts = [part] if keys is None else [*after["parts"], part]
        if len(parts) > MAX_PARTS:
            whole = f"part-{seq:08d}-{uuid.uuid4().hex}"
            for name in tables:
                self._merged(name, parts).write.parquet(f"{self.folder}/{whole}/{name}")
            parts = [whole]
        count = {f"{x}_count": self._merged(f"{x}s", parts).count() for x in ("node", "edge") if f"{x}s" in tables}
        entry = {"seq": seq, "snapshot": parts[-1], **info, **count, "parts": parts, "tables": sorted(tables)}
        create_exclusively(self.spark, f"{self.folder}/log/{seq:08d}.json", json.dumps(entry))
        return self.entry(seq)
