"""Daily parts and rejects counted on the write."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.operators.aggregates import volume_report
from newsloom.session import scratch_path
from newsloom.sinks.daily import DailyDistinct, DailyVolume, part_of
from newsloom.sinks.quarantine import quarantine

T0 = dt.datetime(2026, 8, 1)
SCHEMA = "outlet string, at timestamp_ntz"


@pytest.fixture
def rows(spark):
    made = [(f"o{i % 5}" if i % 7 else None, T0 + dt.timedelta(hours=i * 5 % 900)) for i in range(400)]
    made += [("o1", None), ("midnight", T0 + dt.timedelta(days=3)), ("midnight", T0 + dt.timedelta(days=3, microseconds=1))]
    return spark.createDataFrame(made, SCHEMA)


def as_set(df):
    return {tuple(sorted(r.asDict().items(), key=str)) for r in df.collect()}


def test_a_part_ends_at_its_midnight(spark):
    times = [T0, T0 + dt.timedelta(microseconds=1), T0 + dt.timedelta(days=1), None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "at timestamp_ntz").select(part_of(F.col("at"))).collect()]
    assert got == [got[0], got[0] + 1, got[0] + 1, None]


def test_report_from_parts_equals_the_report_from_items(spark, rows):
    volume, part = DailyVolume(scratch_path(spark, "volume")), part_of(F.col("at"))
    day = rows.agg(F.max(part)).first()[0]
    assert volume.report(spark, day).filter("outlet <> 'ALL'").count() == 0
    for run, some in (("a", part % 2 == 0), ("b/c", part % 2 == 1), ("a", part % 2 == 0)):
        volume.add(rows.filter(some), "outlet", "at", run)
    midnight = F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(days=day))
    want = volume_report(rows.filter("at IS NOT NULL"), "outlet", "at", midnight)
    assert as_set(volume.report(spark, day).select(want.columns)) == as_set(want)
    earlier = DailyVolume(volume.path).report(spark, day - 10)
    before = rows.filter(part <= day - 10)
    assert as_set(earlier.select(want.columns)) == as_set(
        volume_report(before, "outlet", "at", F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(days=day - 10)))
    )


def test_rolling_frames_equal_a_report_a_day(spark, rows):
    volume = DailyVolume(scratch_path(spark, "volume"))
    volume.add(rows.filter("outlet IS NOT NULL"), "outlet", "at", "r")
    got = volume.rolling(spark).collect()
    for day in sorted({r["day"] for r in got})[::9]:
        want = {r["outlet"]: (r["d7"], r["d14"], r["d30"], r["total"]) for r in volume.report(spark, day).collect()}
        for r in got:
            if r["day"] == day:
                assert (r["d7"], r["d14"], r["d30"], r["total"]) == want[r["outlet"]]


def test_sketches_merge_over_days_and_open_those_only(spark):
    rows = spark.range(20_000).select(
        (F.col("id") % 6_000).alias("v"), F.lit(None).cast("string").alias("none"),
        (F.lit(T0) + F.make_dt_interval(hours=(F.col("id") % 240).cast("int"))).alias("at"),
    )
    sketches = DailyDistinct(scratch_path(spark, "distinct"))
    sketches.add(rows, ["v", "none"], "at", "r")
    last = rows.agg(F.max(part_of(F.col("at")))).first()[0]
    for days in (1, 4, 30):
        exact = rows.filter(part_of(F.col("at")) > last - days).select("v").distinct().count()
        got = {r["what"]: r["estimate"] for r in sketches.estimate(spark, last, days).collect()}
        assert set(got) == {"v"} and abs(got["v"] - exact) <= 0.02 * exact
    plan = sketches.estimate(spark, last, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_quarantine_counts_what_it_writes(spark):
    rows = spark.createDataFrame([(i, None if i % 5 else "bad", i % 3) for i in range(60)], "id long, why string, k long")
    reason = F.when(F.col("k") == 2, "odd one").otherwise(F.col("why"))
    done = quarantine(rows, reason, ["bad", "never"], scratch_path(spark, "q"))
    stored = {r["reject_reason"]: r["count"] for r in done.rejects.groupBy("reject_reason").count().collect()}
    assert done.counts == {"": done.good.count(), "bad": stored["bad"], "never": 0, "other": stored["odd one"]}
    assert sum(done.counts.values()) == 60 and done.good.columns == rows.columns


def test_quarantine_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, why string")
    done = quarantine(rows, F.col("why"), ["bad"], scratch_path(spark, "q"))
    assert done.counts == {"": 0, "bad": 0, "other": 0} and done.good.count() == 0 and done.rejects.count() == 0
