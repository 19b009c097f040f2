"""Late rows and silent sources as results of a stream, not as rows that vanish.

`late_rule` keeps the recency rule on a stream whose reference time moves on with it, and puts what
came too late into a side table. `silence_alerts` is a stateful operator: a timer a source, and an
alert that leaves the stream when it runs out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from newsloom.sinks.ledgers import read_table, write_partition

# Workers get the processor by value and need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATE, UNDATED = "late", "undated"


@dataclass(frozen=True)
class LateTables:
    """Where a job with a late rule keeps its rows, in time and too late, and its marks."""

    rows: str
    marks: str

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows with ``verdict``: null in time, else why not; and the job and batch that brought them."""
        own = [T.StructField("job", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("verdict", T.StringType())]
        return read_table(spark, self.rows, T.StructType([*schema.fields, *own]))


def lateness(when: Column, horizon: Column) -> Column:
    """Why a row is not in time: it has no time, or one before the horizon; null otherwise."""
    return F.when(when.isNull(), UNDATED).when(when < horizon, LATE)


def late_rule(tables: LateTables, when: str, window: str, job: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes every row once, marked by whether it came in time.

    A micro-batch's horizon is ``window`` before the newest time of all earlier batches of the job, so
    rows of one batch are never late among themselves and the outcome depends on the files' order alone.
    One job per batch writes rows and learns the new mark by observation; a replay overwrites its own
    partition from the mark of the batch before and changes nothing. A mark is carried along by each
    batch, so only one is ever read.
    """
    mark = T.StructType([T.StructField("newest", T.TimestampType())])

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            before = spark.read.schema(mark).parquet(f"{tables.marks}/job={job}/batch={batch_id - 1}").first()["newest"]
        horizon = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {window}")
        seen = Observation(f"late-{job}-{batch_id}")
        rows = batch.observe(seen, F.max(F.col(when)).alias("newest"))
        (
            rows.withColumn("verdict", lateness(F.col(when), horizon))
            .write.mode("overwrite").partitionBy("verdict")
            .parquet(f"{tables.rows}/job={job}/batch={batch_id}")
        )
        newest = max((t for t in (before, seen.get["newest"]) if t), default=None)
        write_partition(spark.createDataFrame([(newest,)], mark).coalesce(1), tables.marks, job=job, batch=batch_id)

    return handle


def late_counts(rows: DataFrame) -> DataFrame:
    """(batch, in_time, late, undated) of the rows of `LateTables.read`."""
    verdict = F.col("verdict")
    return rows.groupBy("job", "batch").agg(
        F.count_if(verdict.isNull()).alias("in_time"),
        F.count_if(verdict == LATE).alias("late"),
        F.count_if(verdict == UNDATED).alias("undated"),
    )


def dropped_by_watermark(query) -> int:
    """Rows that a finished query's stateful operators dropped as late, by its progress reports.

    Reports are those the session keeps (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


ALERT = "source string, last_seen timestamp, silent_since timestamp"


class SilenceProcessor(StatefulProcessor):
    """Per source: when it last spoke, and a timer ``quiet`` milliseconds after that."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        newest = max(int(part["ms"].max()) for part in rows)
        if self.last.exists():
            known = self.last.get()[0]
            if newest <= known:
                return iter(())
            self.handle.deleteTimer(known + self.quiet)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs()
        times = pd.to_datetime([at - self.quiet, at], unit="ms", utc=True)
        yield pd.DataFrame({"source": [key[0]], "last_seen": times[:1], "silent_since": times[1:]})

    def close(self) -> None:
        pass


def silence_alerts(stream: DataFrame, source: str, when: str, quiet_ms: int, delay: str = "0 seconds") -> DataFrame:
    """One row each time a source has said nothing for ``quiet_ms`` while the others went on.

    Event time decides: a timer runs out when the watermark, ``delay`` behind the newest row of the
    batches before, passes it. A source that speaks again gets a new timer, so it can fall silent
    again. State is one number and one timer a source, in the state store and its checkpoint, which
    a restarted query goes on from. The session needs the RocksDB state store, see `with_timers`.
    Rows without a time or a source are not heard. Times are to the millisecond.
    """
    heard = stream.filter(F.col(when).isNotNull() & F.col(source).isNotNull())
    keyed = heard.select(F.col(source).cast("string").alias("source"), F.col(when).alias("at"), F.unix_millis(F.col(when)).alias("ms"))
    return (
        keyed.withWatermark("at", delay)
        .groupBy("source")
        .transformWithStateInPandas(SilenceProcessor(quiet_ms), ALERT, "append", "eventTime")
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class with_timers:
    """Within it, queries that start use the state store that timers need; the setting goes back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STATE_STORE, None)
        self.spark.conf.set(STATE_STORE, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(STATE_STORE)
        else:
            self.spark.conf.set(STATE_STORE, self.before)
