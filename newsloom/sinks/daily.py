"""Daily parts: counts and sketches stored once a day and merged over any window of days.

A part covers the 24 hours up to a midnight, that midnight included, so ages in whole days before a
midnight are differences of part numbers. A run's parts replace that run's only.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.aggregates import ALL, VOLUME_WINDOWS
from newsloom.sinks.buckets import stored

DAY_US = 86_400_000_000
#: Log2 of a sketch's registers: a standard error of 0.65 %, at most 16 KB a sketch.
PRECISION = 14


def part_of(when: Column) -> Column:
    """The number of the midnight that ends a time's part, counted in days from the epoch."""
    return F.ceil(F.unix_micros(when.cast("timestamp")) / F.lit(DAY_US)).cast("int")


def _write(rows: DataFrame, path: str, run: str) -> None:
    rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={quote(run, safe='')}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    full = T.StructType.fromDDL(f"{schema}, run string, day int")
    rows = stored(spark, path, full, "day")
    return spark.createDataFrame([], full) if rows is None else rows


@dataclass(frozen=True)
class DailyVolume:
    """Items per outlet and day under ``path``. Undated items are not counted; a null outlet is one of its own."""

    path: str

    def add(self, items: DataFrame, outlet: str, when: str, run: str) -> None:
        """Store the counts of a run's items. Nothing stored earlier is read."""
        dated = items.filter(F.col(when).isNotNull())
        counts = dated.groupBy(part_of(F.col(when)).alias("day"), F.col(outlet).alias("outlet")).agg(F.count("*").alias("n"))
        _write(counts, self.path, run)

    def parts(self, spark: SparkSession) -> DataFrame:
        """(day, outlet, n) over all runs."""
        return _read(spark, self.path, "outlet string, n long").groupBy("day", "outlet").agg(F.sum("n").alias("n"))

    def report(self, spark: SparkSession, day: int) -> DataFrame:
        """`aggregates.volume_report` as of the midnight numbered ``day``, from the parts up to it."""
        age = F.lit(day) - F.col("day")
        sums = [F.sum(F.when(age <= w, F.col("n")).otherwise(0)).alias(f"d{w}") for w in VOLUME_WINDOWS]
        upto = _read(spark, self.path, "outlet string, n long").filter(F.col("day") <= day)
        return (
            upto.rollup("outlet")
            .agg(*sums, F.sum("n").alias("total"), F.min(age).alias("newest_age"), F.grouping("outlet").alias("_all"))
            .withColumn("outlet", F.when(F.col("_all") == 1, ALL).otherwise(F.col("outlet")))
            .drop("_all")
        )

    def rolling(self, spark: SparkSession) -> DataFrame:
        """(day, outlet, d7, d14, d30, total) as of every day on which the outlet had items, and for all outlets.

        Frames run over days with items, one row each, so an outlet's rows are as many as its days.
        """
        parts = self.parts(spark)
        every = parts.groupBy("day").agg(F.sum("n").alias("n")).withColumn("outlet", F.lit(ALL))
        own = Window.partitionBy("outlet").orderBy("day")
        frames = [F.sum("n").over(own.rangeBetween(-w, 0)).alias(f"d{w}") for w in VOLUME_WINDOWS]
        total = F.sum("n").over(own.rangeBetween(Window.unboundedPreceding, 0)).alias("total")
        return parts.unionByName(every).select("day", "outlet", *frames, total)


@dataclass(frozen=True)
class DailyDistinct:
    """A sketch of each column's values a day under ``path``; sketches of any days merge into one."""

    path: str
    precision: int = PRECISION

    def add(self, rows: DataFrame, columns: list[str], when: str, run: str) -> None:
        """Store the sketches of a run's rows: one row a column and day. Nulls are no values."""
        dated = rows.filter(F.col(when).isNotNull()).withColumn("day", part_of(F.col(when)))
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns]))
        long = dated.select("day", values.alias("v")).select("day", "v.*").filter(F.col("value").isNotNull())
        _write(long.groupBy("day", "what").agg(F.hll_sketch_agg("value", F.lit(self.precision)).alias("sketch")), self.path, run)

    def estimate(self, spark: SparkSession, last: int, days: int) -> DataFrame:
        """(what, estimate): distinct values in the ``days`` parts up to ``last``, of which alone files are read."""
        window = _read(spark, self.path, "what string, sketch binary").filter(F.col("day").between(last - days + 1, last))
        return window.groupBy("what").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
