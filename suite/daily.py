"""Reports from stored daily parts, and rejects counted on the write."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.sinks.daily import DailyDistinct, DailyVolume, part_of
from newsloom.sinks.quarantine import quarantine
from suite.registry import query
from suite.tables import ITEMS, items, table

_PART = "CAST(ceil(epoch_us({}) / 86400000000.0) AS INT)"
_LAST = "last AS (SELECT max(" + _PART.format("published_at") + ") AS day FROM items_raw)"
# A time's age in whole days before a midnight.
_AGE = "CAST(floor((day * 86400000000 - epoch_us(published_at)) / 86400000000.0) AS INT)"


def last_day(rows, when):
    return rows.agg(F.max(part_of(F.col(when)))).first()[0]


@query(
    "volume_from_daily_parts",
    f"""WITH {ITEMS}, {_LAST}, aged AS (SELECT source_name AS outlet, {_AGE} AS age FROM items_raw, last)
    SELECT coalesce(outlet, 'ALL') AS outlet, count(*) FILTER (age <= 7) AS d7, count(*) FILTER (age <= 14) AS d14,
      count(*) FILTER (age <= 30) AS d30, count(*) AS total, min(age) AS newest_age FROM aged GROUP BY ROLLUP (outlet)""",
)
def _report(spark, sf):
    """All days but the last stored by one run, the last by another that reads its own items only."""
    rows = items(spark, sf).select("source_name", "published_at")
    day = last_day(rows, "published_at")
    volume = DailyVolume(scratch_path(spark, "daily-volume"))
    part = part_of(F.col("published_at"))
    volume.add(rows.filter(part < day), "source_name", "published_at", "before")
    volume.add(rows.filter(part == day), "source_name", "published_at", "today")
    return volume.report(spark, day)


@query(
    "volume_rolling",
    f"""WITH {ITEMS}, d AS (SELECT source_name AS outlet, published_at, {_PART.format('published_at')} AS part FROM items_raw
      UNION ALL SELECT 'ALL', published_at, {_PART.format('published_at')} FROM items_raw),
    days AS (SELECT DISTINCT outlet, part AS day FROM d)
    SELECT day, outlet, count(*) FILTER ({_AGE} <= 7) AS d7, count(*) FILTER ({_AGE} <= 14) AS d14,
      count(*) FILTER ({_AGE} <= 30) AS d30, count(*) AS total FROM days JOIN d USING (outlet) WHERE {_AGE} >= 0 GROUP BY day, outlet""",
)
def _rolling(spark, sf):
    volume = DailyVolume(scratch_path(spark, "daily-volume"))
    volume.add(items(spark, sf).select("source_name", "published_at"), "source_name", "published_at", "all")
    return volume.rolling(spark)


_WINDOWS = (1, 7, 14)


@query(
    "distinct_over_days",
    f"""WITH t AS (SELECT *, {_PART.format('ts')} AS day FROM events), l AS (SELECT max(day) AS last FROM t),
    w AS (SELECT unnest([{', '.join(map(str, _WINDOWS))}]) AS days)
    SELECT what, days, count(DISTINCT value) AS exact, true AS close FROM l, w, (
      SELECT day, 'user_id' AS what, CAST(user_id AS VARCHAR) AS value FROM t UNION ALL SELECT day, 'event_id', CAST(event_id AS VARCHAR) FROM t
      UNION ALL SELECT day, 'event_type', event_type FROM t) x
    WHERE day > last - days GROUP BY ALL""",
)
def _distinct(spark, sf):
    """Sketches of each day, merged over windows, beside the exact counts; close: within two hundredths."""
    rows = table(spark, sf, "events")
    columns = ["user_id", "event_id", "event_type"]
    sketches = DailyDistinct(scratch_path(spark, "daily-distinct"))
    sketches.add(rows, columns, "ts", "all")
    day, out = last_day(rows, "ts"), None
    for days in _WINDOWS:
        recent = rows.filter(part_of(F.col("ts")) > day - days)
        exact = recent.agg(*[F.count_distinct(c).alias(c) for c in columns])
        exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("exact")) for c in columns])))
        both = exact.join(sketches.estimate(spark, day, days), "what", "left").select(
            "what", F.lit(days).alias("days"), "exact",
            F.coalesce(F.abs(F.col("estimate") - F.col("exact")) <= 0.02 * F.col("exact"), F.lit(False)).alias("close"),
        )
        out = both if out is None else out.unionByName(both)
    return out


@query(
    "quarantine_counts",
    f"""WITH {ITEMS}, r AS (SELECT CASE WHEN category IS NULL THEN 'no section' WHEN is_promo = 1 THEN 'promotion'
      WHEN relevance < 0.1 THEN 'of no interest' END AS reason FROM items_raw)
    SELECT coalesce(reason, '') AS reason, count(*) AS counted, count(*) AS stored FROM r GROUP BY 1""",
)
def _counts(spark, sf):
    """Counts of the observation on the write, beside those of the files."""
    reason = (
        F.when(F.col("category").isNull(), "no section").when(F.col("is_promo") == 1, "promotion")
        .when(F.col("relevance") < 0.1, "of no interest")
    )
    reasons = ["no section", "promotion", "of no interest"]
    rows = items(spark, sf).select("seq", "category", "is_promo", "relevance")
    done = quarantine(rows, reason, reasons, scratch_path(spark, "quarantine"))
    counted = spark.createDataFrame([(r, n) for r, n in done.counts.items() if n], "reason string, counted long")
    files = done.rejects.select(F.col("reject_reason").alias("reason")).unionByName(done.good.select(F.lit("").alias("reason")))
    return counted.join(files.groupBy("reason").agg(F.count("*").alias("stored")), "reason", "full")
