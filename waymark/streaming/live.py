"""A stream of files kept as a stored graph.

1. Keyed state: of each path the last hash. A file that comes again unchanged, by another listing or a
   replay, goes no further.
2. Each batch of changes advances the stored graph (incremental.py) and is committed with the batch's
   number. A batch that was committed before is passed over, so a replay after a failure does nothing, and
   a batch that died halfway left nothing that readers see.

The state store has to be one that keeps typed values (RocksDB); see STATE_STORE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymark.sources import store
from waymark.sources.snapshots import Snapshots
from waymark.streaming import incremental

#: Setting of the session that transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FILE = "path string, content binary, sha256 string, at timestamp"


class Unseen(StatefulProcessor):
    """Lets a file through if its hash is another than the last one of its path; a null content says that
    the file is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha256 string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = None
        for part in rows:
            row = part.sort_values("at", kind="stable").iloc[-1]
            if newest is None or row["at"] >= newest["at"]:
                newest = row
        before = self.last.get()[0] if self.last.exists() else None
        now = newest["sha256"] if newest["content"] is not None else None
        if now == before:
            return
        if now is None:
            self.last.clear()
        else:
            self.last.update((now,))
        yield pd.DataFrame([newest])[["path", "content", "sha256", "at"]]

    def close(self) -> None:
        pass


def files_of(stream: DataFrame, root: str) -> DataFrame:
    """FILE rows of a binaryFile stream below ``root``."""
    base = root.rstrip("/").split("://", 1)[-1]
    rel = F.substring_index(F.col("path"), base + "/", -1)
    return stream.select(rel.alias("path"), "content", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("at"))


def changes(files: DataFrame) -> DataFrame:
    """Of a stream of FILE rows those that change something."""
    return files.groupBy("path").transformWithStateInPandas(Unseen(), outputStructType=FILE, outputMode="Update", timeMode="None")


def apply(spark: SparkSession, folder: str, batch: DataFrame, batch_id: int) -> bool:
    """Advances the stored graph by a batch of changed files (FILE) and says whether it did; a batch that is
    in the log already does nothing."""
    snapshots = Snapshots(spark, folder)
    entry = snapshots.entry()
    if entry is not None and entry["batch"] is not None and entry["batch"] >= batch_id:
        return False
    info = {"version": store.VERSION, "last_sync_commit": None, "last_sync_time": None, "batch": batch_id}
    if entry is None:
        old = incremental.empty(spark)
    else:
        old = incremental.Graph(**{t: snapshots.read(t, entry, schema) for t, schema in incremental.SCHEMAS.items()})
    state = F.when(F.col("content").isNull(), "deleted").otherwise("stale")
    change = incremental.advance(old, batch.where("content IS NOT NULL").select("path", "content", "sha256"), batch.select("path", state.alias("state")))
    if entry is None:
        snapshots.commit(None, change.applied(old).tables(), **info)
    else:
        snapshots.commit(entry, change.rows, change.keys, **info)
    return True


def follow(spark: SparkSession, files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts keeping the graph in ``folder`` up to date with a stream of FILE rows."""
    from waymark.plans.lineage import cut

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch)  # the batch is read more than once
        if rows.limit(1).count():
            apply(spark, folder, rows, batch_id)

    return changes(files).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).start()
