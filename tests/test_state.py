"""Ledgers and streams across runs and retries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.session import materialize, scratch_path, scratch_root
from newsloom.sinks import ledgers
from newsloom.streaming import streams as st

T0 = dt.datetime(2026, 8, 1)


def test_scratch_is_the_folder_the_session_names(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    assert materialize(spark.range(3), "t").count() == 3


def test_append_is_first_write_wins_and_retry_safe(spark):
    path = scratch_path(spark, "seen")
    first = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "b")], "uid string, seq long, title string")
    second = spark.createDataFrame([("b", 4, "again"), ("c", 5, "c")], "uid string, seq long, title string")
    assert ledgers.append_new(first, path, "r1").count() == 2
    assert ledgers.append_new(second, path, "r2").count() == 1
    assert ledgers.append_new(second, path, "r2").count() == 1
    got = {r["uid"]: r["title"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": "early", "b": "b", "c": "c"}
    assert ledgers.publish(second, path, "trial", full_run=False).count() == 0


def test_scores_are_last_write_wins_per_version(spark):
    schema = "uid string, prompt_hash string, model string, relevance double, scored_at timestamp_ntz"
    path = scratch_path(spark, "scores")
    ledgers.upsert_scores(spark.createDataFrame([("a", "p1", "m", 0.1, T0), ("a", "p2", "m", 0.5, T0), ("b", "p1", "m", 0.2, T0)], schema), path)
    out = ledgers.upsert_scores(spark.createDataFrame([("a", "p1", "m", 0.9, T0 + dt.timedelta(days=1))], schema), path)
    got = {(r["uid"], r["prompt_hash"]): r["relevance"] for r in out.collect()}
    assert got == {("a", "p1"): 0.9, ("a", "p2"): 0.5, ("b", "p1"): 0.2}


def test_version_read_prunes_partitions(spark):
    from newsloom.operators.joins import score_version

    schema = "uid string, prompt_hash string, model string, relevance double, scored_at timestamp_ntz"
    path = scratch_path(spark, "scores")
    ledger = ledgers.upsert_scores(spark.createDataFrame([("a", "p1", "m", 0.1, T0), ("a", "p2", "m", 0.5, T0)], schema), path)
    plan = score_version(ledger, "p2", "m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prompt_hash" in plan


@pytest.fixture
def feed(spark, tmp_path):
    """Events in three files, read one per micro-batch."""
    folder = str(tmp_path / "feed")
    for n in range(3):
        rows = [(n * 10 + i, T0 + dt.timedelta(days=n * 10 + i), f"u{i % 4}", "s1" if n < 2 else "s2") for i in range(10)]
        spark.createDataFrame(rows, "id long, ts timestamp_ntz, uid string, source string").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return folder, raw.withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_append_equals_batch_and_survives_replay(spark, feed):
    folder, stream = feed
    path = scratch_path(spark, "stream")
    handler = st.append_unseen(path, "uid", "id", "j")
    batches = []

    def twice(batch, batch_id):
        batches.append(batch_id)
        handler(batch, batch_id)
        handler(batch, batch_id)

    st.run_batches(stream.select("uid", "id"), twice, scratch_path(spark, "state"))
    assert len(batches) == 3
    got = spark.read.parquet(path)
    assert got.count() == got.select("uid").distinct().count() == 4


def test_stream_dedupe_and_volume_equal_batch(spark, feed):
    folder, stream = feed
    path = scratch_path(spark, "stream")
    st.run_to_table(st.dedupe(stream, ["uid"], "ts", "60 days").select("uid"), path, scratch_path(spark, "state"))
    assert sorted(r["uid"] for r in spark.read.parquet(path).collect()) == ["u0", "u1", "u2", "u3"]
    out = scratch_path(spark, "stream")
    st.run_to_table(st.volume(stream, "source", "ts", "5 days", "20 days"), out, scratch_path(spark, "state"))
    newest = T0 + dt.timedelta(days=29)
    batch = (
        spark.read.parquet(folder)
        .groupBy(F.window(F.col("ts").cast("timestamp"), "5 days").alias("w"), "source")
        .agg(F.count("*").alias("n"))
        .filter(F.col("w.end") <= F.lit(newest - dt.timedelta(days=20)).cast("timestamp"))
    )
    want = {(r["w"]["start"], r["source"], r["n"]) for r in batch.collect()}
    assert want and {(r["window_start"], r["outlet"], r["n"]) for r in spark.read.parquet(out).collect()} == want


def test_silent_sources(spark, feed):
    _, stream = feed
    path = scratch_path(spark, "stream")
    st.run_batches(stream, st.track_last_seen(path, "source", "ts", "j"), scratch_path(spark, "state"))
    got = {r["source"]: r["silent"] for r in st.silent_sources(spark.read.parquet(path), "5 DAYS").collect()}
    assert got == {"s1": True, "s2": False} or got == {"s1": False, "s2": True}


def test_a_new_job_keeps_what_an_older_one_wrote(spark, feed):
    folder, stream = feed
    path = scratch_path(spark, "stream")
    for job, part in (("one", "id < 12"), ("two", "id >= 12")):
        st.run_batches(
            stream.select("uid", "id").filter(part), st.append_unseen(path, "uid", "id", job), scratch_path(spark, "state")
        )
    got = spark.read.parquet(path)
    assert got.count() == got.select("uid").distinct().count() == 4


def test_scores_written_later_replace_earlier_ones_whatever_they_say(spark):
    schema = "uid string, prompt_hash string, model string, relevance double, scored_at timestamp_ntz"
    path = scratch_path(spark, "scores")
    ledgers.upsert_scores(spark.createDataFrame([("a", "p1", "m", 0.9, T0)], schema), path)
    out = ledgers.upsert_scores(spark.createDataFrame([("a", "p1", "m", 0.1, T0)], schema), path)
    assert [r["relevance"] for r in out.collect()] == [0.1]


def test_a_retry_with_nothing_leaves_nothing(spark):
    path = scratch_path(spark, "seen")
    rows = spark.createDataFrame([("a", 1)], "uid string, seq long")
    assert ledgers.append_new(rows, path, "r/1").count() == 1
    assert ledgers.append_new(rows.limit(0), path, "r/1").count() == 0
    assert ledgers.append_new(rows, path, "r2").count() == 1
