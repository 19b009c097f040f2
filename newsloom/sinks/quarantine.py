"""Rejects counted while they are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sinks.buckets import stored


@dataclass(frozen=True)
class Quarantined:
    """What one write left behind: usable rows, rejects with reject_reason, and counts a reason.

    ``counts`` has every listed reason, ``""`` for usable rows and ``"other"`` for reasons not listed.
    """

    good: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def quarantine(rows: DataFrame, reason: Column, reasons: list[str], path: str) -> Quarantined:
    """Write all rows in one job, in a folder a reason; an observation on the write counts them.

    Usable rows have no reason (null or empty). ``reasons`` is the closed list that is counted. Rows are read
    once and written once, whatever share is rejected; an empty table gives empty results and zeros.
    """
    spark = rows.sparkSession
    why = F.col("reject_reason")
    named = {"": why.isNull(), **{r: why == r for r in reasons}, "other": ~why.isin(reasons)}
    seen = Observation("quarantine")
    counts = [F.count_if(F.coalesce(test, F.lit(False))).alias(f"c{i}") for i, test in enumerate(named.values())]
    tagged = rows.withColumn("reject_reason", F.nullif(reason.cast("string"), F.lit(""))).observe(seen, *counts)
    tagged.write.mode("overwrite").partitionBy("reject_reason").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("reject_reason", T.StringType())])
    back = stored(spark, path, schema, "reject_reason")
    back = spark.createDataFrame([], schema) if back is None else back
    return Quarantined(
        back.filter(why.isNull()).drop("reject_reason"),
        back.filter(why.isNotNull()),
        {name: seen.get[f"c{i}"] for i, name in enumerate(named)},
    )
