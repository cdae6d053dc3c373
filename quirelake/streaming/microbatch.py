"""Incremental ingestion: micro-batches, resume, status, consolidation, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.resolve import first_writer_wins


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 50, fmt: str = "parquet") -> dict:
    """Take in what has arrived since the last run, in batches of files, then stop.

    The checkpoint is the resume state.  Each batch is a folder of its own in the target that a repeated batch
    overwrites, so a batch that is run again after a failure leaves no copies.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    return {"batches": len([p for p in progress if p["numInputRows"]]), "rows": sum(p["numInputRows"] for p in progress)}


def status(spark: SparkSession, checkpoint: str, target: str, expected: int | None = None) -> DataFrame:
    """One row: state (not_started, in_progress, completed) and rows taken in.

    Completed: the rows expected are there; without a number, every batch that was planned has been committed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([("not_started", 0)], "state string, rows long")
    rows = spark.read.parquet(target).agg(F.count("*").alias("rows"))
    if expected is not None:
        done = F.col("rows") >= F.lit(expected)
    else:
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
        numbers = lambda p: {f.getPath().getName() for f in store.listStatus(p) if f.getPath().getName().isdigit()}
        done = F.lit(store.exists(commits) and numbers(path) <= numbers(commits))
    return rows.select(F.when(done, "completed").otherwise("in_progress").alias("state"), "rows")


def consolidate(spark: SparkSession, target: str, key: str) -> DataFrame:
    """All batches as one table, the first arrival of each key kept."""
    rows = spark.read.parquet(target)
    return first_writer_wins(rows, [key], ["batch"])


def resume(df: DataFrame, order: str, start: int) -> DataFrame:
    return df.where(F.col(order) >= start)


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output is complete."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def windowed_counts(events: DataFrame, time: str, by: list[str | Column], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window; works on streams, where rows later than ``late`` are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
