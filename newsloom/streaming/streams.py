"""Structured Streaming forms of the incremental operators.

Sources with zone-less timestamps are cast on the way in, since watermarks need an instant.
Each sink is a Parquet folder: nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sinks.ledgers import read_table, write_partition


def read_events(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType, when: str, files_per_batch: int = 1000
) -> DataFrame:
    """A stream over Parquet files of a folder, with ``when`` as an instant, so many files a micro-batch."""
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    return raw.withColumn(when, F.col(when).cast("timestamp"))


def dedupe(stream: DataFrame, keys: list[str], when: str, delay: str) -> DataFrame:
    """First arrival of each key within the delay; later copies are dropped.

    The batch operator keeps the newest copy instead; a stream cannot wait for it.
    """
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark(keys)


def volume(stream: DataFrame, outlet: str, when: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Items per outlet and window. Partial sums are formed before the shuffle."""
    frame = F.window(when, width, slide) if slide else F.window(when, width)
    return (
        stream.withWatermark(when, delay)
        .groupBy(frame.alias("w"), F.col(outlet).alias("outlet"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "outlet", "n")
    )


def recent_only(stream: DataFrame, when: str, now: Column, days: int) -> DataFrame:
    """The recency rule on a stream with a fixed reference time."""
    return stream.filter(F.col(when) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def run_to_table(stream: DataFrame, path: str, state: str, mode: str = "append") -> None:
    """Process everything available into a Parquet folder, then stop.

    ``state`` is the job's own folder: with it a second run goes on where the first one ended.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, handler, state: str, mode: str = "append") -> None:
    """Process everything available through ``handler(batch, batch_id)``, then stop; ``state`` as above."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handler)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_unseen(path: str, key: str, order: str, job: str):
    """A batch handler that inserts rows with unknown keys.

    Each micro-batch of a job owns one partition of the table. A replayed batch compares with the
    other partitions only and overwrites its own, so a retry changes nothing; a job with a new
    state has another name, so its batches never take the place of an older job's.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = T.StructType(
            [*batch.schema.fields, T.StructField("job", T.StringType()), T.StructField("batch", T.LongType())]
        )
        other = (F.col("job") != job) | (F.col("batch") != batch_id)
        known = read_table(spark, path, schema).filter(other).select(key)
        first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        write_partition(first.join(known, key, "left_anti"), path, job=job, batch=batch_id)

    return handle


def track_last_seen(path: str, source: str, when: str, job: str):
    """A batch handler that keeps, per micro-batch of a job, when each source last spoke.

    Rows are per source and batch; readers take the maximum, so a replay changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spoke = batch.groupBy(F.col(source).alias("source")).agg(F.max(when).alias("last_seen"))
        write_partition(spoke, path, job=job, batch=batch_id)

    return handle


def silent_sources(last_seen: DataFrame, quiet: str) -> DataFrame:
    """Sources whose newest item is older than ``quiet`` behind the newest of all."""
    per_source = last_seen.groupBy("source").agg(F.max("last_seen").alias("last_seen"))
    newest = last_seen.agg(F.max("last_seen")).scalar()
    return per_source.withColumn(
        "silent", F.col("last_seen") < newest - F.expr(f"INTERVAL {quiet}")
    )
