"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.lineage import cut as materialise
from waymark.plans.lineage import is_small, shared_dir
from waymark.plans.lineage import small as broadcast_if_small

__all__ = ["ascii_lower", "broadcast_if_small", "discard", "is_small", "materialise", "put", "shared_dir", "table"]

#: The white space of the contracts: blank and the control characters 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more: later steps start from
    tables that are written already, so they never have to be made again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.rsplit("/", 1)[-1].startswith("waymark-"):
                raise ValueError(f"{folder} was not written by materialise()")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII values take the byte-wise path of lower()."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; an input column of the same name gives way."""
    return df.withColumns(columns)
