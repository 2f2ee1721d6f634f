"""The scheduled load as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest_versions(batch: DataFrame, key: str, stamp: str) -> DataFrame:
    """The last version of each document of a batch; of equal stamps the greatest row."""
    rest = [c for c in batch.columns if c not in (key, stamp)]
    return batch.groupBy(key).agg(F.max(F.struct(stamp, *rest)).alias("_v")).select(key, "_v.*")


def latest(df: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """What the target holds after all versions have arrived."""
    w = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def incremental_load(stream: DataFrame, upsert: Callable[[DataFrame, int], None], key: str, stamp: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's newest versions to an idempotent upsert; the checkpoint is the high-water mark."""
    return (
        stream.writeStream.foreachBatch(lambda batch, n: upsert(newest_versions(batch, key, stamp), n))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
