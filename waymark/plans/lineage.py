"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast; beyond that Spark chooses a shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    temporary one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        path = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write to a table and read it back. Loops call this once a level, so a lost executor costs one
    level at most and plans stay short. ``codec`` is Parquet's, for tables where size counts."""
    path = f"{shared_dir(df.sparkSession)}/waymark-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by hash of ``keys`` over as many partitions as a shuffle has, one for each core at least,
    which adaptive execution does not merge. For work that is long for its bytes."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def spread(df: DataFrame, rows: int, *keys: str | Column, each: int = 1_000_000) -> DataFrame:
    """The rows by hash of ``keys`` over at least one partition for each ``each`` of ``rows``. Adaptive
    execution merges by compressed bytes, and millions of like ids are few bytes; a task that sorts
    or hashes them then needs memory that grows with the table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
    return df.repartition(n, *keys)


class Levels:
    """A table that a loop adds to, a part at a time. A part is written once; all() reads them all, as
    one scan. n_rows is the last part's number of rows."""

    def __init__(self, first: DataFrame):
        self.spark = first.sparkSession
        self.path = f"{shared_dir(self.spark)}/waymark-{uuid.uuid4().hex}"
        self.schema = first.schema
        self.n, self.n_rows = 0, 0
        self.append(first)

    def append(self, part: DataFrame) -> DataFrame:
        """Adds the rows; they come back as a table of their own."""
        path = f"{self.path}/waymark_part={self.n}"
        part.select(self.schema.names).write.parquet(path)
        self.n += 1
        out = self.spark.read.schema(self.schema).parquet(path)
        self.n_rows = out.count()
        return out

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a materialised table of at most ``rows`` rows and ``most`` bytes. Beyond that
    Spark chooses by its own estimate: as a rule a shuffle join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if is_small(df, rows, most) else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Keeps Spark from broadcasting a table whose size is not known, in the next join with it. Spark takes the
    compressed bytes of its files for its size, and millions of like ids are few bytes."""
    return df.hint("merge")


def side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """small(), and by_shuffle() beyond it: what was found too large is not left to Spark's estimate."""
    return F.broadcast(df) if is_small(df, rows, most) else by_shuffle(df)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}
    width = sum(fixed.get(t, 0) for _, t in df.dtypes)
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if t not in ("string", "binary") else F.col(c)), F.lit(0)) for c, t in df.dtypes if t not in fixed]
    size = F.sum(sum(wide, F.lit(width))) if wide else F.count("*") * width
    n, held = df.limit(rows + 1).agg(F.count("*"), size).first()
    return n <= rows and (held or 0) <= most
