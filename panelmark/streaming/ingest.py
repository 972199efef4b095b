"""Incremental ingest: files that land in a folder are merged by key and the touched partitions are rebuilt."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelmark.operators.sinks import existing, replace_partitions, upserted


def merge_batch(table_path: str, keys: Sequence[str], version: str, by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into the table; only partitions with new rows are read and written. Repeating a batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        touched = batch.select(*by).distinct()
        old = existing(batch, table_path).join(F.broadcast(touched) if touched.count() <= 10_000 else touched, list(by), "left_semi")
        merged = upserted(old, batch, keys, version)
        staged = f"{table_path}__staged"  # the table is read while its partitions are rewritten
        merged.write.mode("overwrite").parquet(staged)
        replace_partitions(batch.sparkSession.read.schema(merged.schema).parquet(staged), table_path, by)
        batch.unpersist()

    return merge


def ingest(spark: SparkSession, landing: str, schema: T.StructType | str, table_path: str, checkpoint: str, keys: Sequence[str], version: str, by: Sequence[str]) -> StreamingQuery:
    """Starts the ingest of all files that are there now and ends after them."""
    stream = spark.readStream.schema(schema).parquet(landing)
    writer = stream.writeStream.foreachBatch(merge_batch(table_path, keys, version, by))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", step: str | None = None) -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows of ts; rows later than `late` are dropped."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
