"""An extension: new files as a stream, each batch through the resume filter and the upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.hashing import content_hash, task_id
from corpusloom.operators import state


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_trigger: int = 1000) -> StreamingQuery:
    """Parquet files that appear in a folder, in batches; ends once all present ones are done."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_tasks(batch: DataFrame, tasks: DataFrame, target: str, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of a batch whose content no finished task has, with their task id."""
    hashed = batch.withColumn("content_hash", content_hash(F.col(content)))
    return state.resume(hashed.withColumn("task_id", task_id(F.lit(target), F.col(path), F.col("content_hash"))), tasks)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")
