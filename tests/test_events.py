"""Late rows and silent sources as results of a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.streaming import events as ev
from newsloom.streaming import streams as st

T0 = dt.datetime(2026, 8, 1)
SCHEMA = "id long, ts timestamp_ntz, source string"


def arrive(spark, folder, *files):
    """One file per list of (id, hours after T0 or None, source)."""
    for rows in files:
        made = [(i, None if h is None else T0 + dt.timedelta(hours=h), s) for i, h, s in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return st.read_events(spark, folder, "*.parquet", spark.createDataFrame([], SCHEMA).schema, "ts", files_per_batch=1)


@pytest.fixture
def tables(spark):
    return ev.LateTables(scratch_path(spark, "rows"), scratch_path(spark, "marks"))


def verdicts(spark, tables):
    schema = spark.createDataFrame([], "id long, ts timestamp, source string").schema
    return {(r["id"], r["batch"]): r["verdict"] for r in tables.read(spark, schema).collect()}


def test_late_rows_go_to_the_side_and_a_replay_changes_nothing(spark, tables):
    folder, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    arrive(spark, folder, [(1, 0, "a"), (2, 100, "a")], [(3, 75, "a"), (4, 76, "a"), (5, None, "a")], [(6, 10, "b"), (7, 90, None)])
    handle = ev.late_rule(tables, "ts", "1 DAY", "j")

    def twice(batch, batch_id):
        handle(batch, batch_id)
        handle(batch, batch_id)

    st.run_batches(stream_of(spark, folder), twice, state)
    # The first file has no horizon; 76 hours is exactly a day before the newest, and in time.
    want = {(1, 0): None, (2, 0): None, (3, 1): "late", (4, 1): None, (5, 1): "undated", (6, 2): "late", (7, 2): None}
    assert verdicts(spark, tables) == want
    # The query goes on from its checkpoint, and the horizon from its mark.
    arrive(spark, folder, [(8, 200, "a")], [(9, 100, "a")])
    st.run_batches(stream_of(spark, folder), handle, state)
    assert verdicts(spark, tables) == want | {(8, 3): None, (9, 4): "late"}
    schema = spark.createDataFrame([], "id long").schema
    counts = {r["batch"]: (r["in_time"], r["late"], r["undated"]) for r in ev.late_counts(tables.read(spark, schema)).collect()}
    assert counts == {0: (2, 0, 0), 1: (1, 1, 1), 2: (1, 1, 0), 3: (1, 0, 0), 4: (0, 1, 0)}


def test_a_batch_without_times_keeps_the_mark(spark, tables):
    folder = scratch_path(spark, "in")
    arrive(spark, folder, [(1, None, "a")], [(2, 50, "a")], [(3, None, "a")], [(4, 0, "a")])
    st.run_batches(stream_of(spark, folder), ev.late_rule(tables, "ts", "1 DAY", "j"), scratch_path(spark, "state"))
    assert verdicts(spark, tables) == {(1, 0): "undated", (2, 1): None, (3, 2): "undated", (4, 3): "late"}


def test_what_stateful_operators_drop_is_counted(spark):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    arrive(spark, folder, [(1, 0, "a")], [(2, 100, "b")], [(3, 200, "c")], [(4, 1, "d"), (5, 2, "e"), (6, 199, "f")])
    unique = st.dedupe(stream_of(spark, folder), ["source"], "ts", "1 hour")
    query = (
        unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = {r["id"] for r in spark.read.parquet(out).collect()}
    assert ev.dropped_by_watermark(query) == 2 and kept == {1, 2, 3, 6}


def test_a_silent_source_is_told_once_and_again_after_it_spoke(spark):
    folder, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    files = [
        [(1, 0, "a"), (2, 0, "b")],
        [(3, 30, "b"), (4, 31, None), (5, None, "b")],
        [(6, 60, "b")],
        [(7, 61, "a"), (8, 62, "b")],
        [(9, 100, "b")],
        [(10, 130, "b")],
    ]
    with ev.with_timers(spark):
        for part in (files[:3], files[3:]):
            arrive(spark, folder, *part)
            alerts = ev.silence_alerts(stream_of(spark, folder), "source", "ts", 24 * 3_600_000)
            st.run_to_table(alerts, out, state)
    hours = lambda t: (t - T0).total_seconds() / 3600
    got = sorted((r["source"], hours(r["last_seen"]), hours(r["silent_since"])) for r in spark.read.parquet(out).collect())
    # b is silent between files too, but speaks again before the watermark gets past its timer.
    assert [r for r in got if r[0] == "a"] == [("a", 0.0, 24.0), ("a", 61.0, 85.0)]
    assert all(r[0] in "ab" and r[2] == r[1] + 24 for r in got) and len(got) == len(set(got))


def test_the_state_store_setting_goes_back(spark):
    before = spark.conf.get(ev.STATE_STORE, None)
    with ev.with_timers(spark):
        assert spark.conf.get(ev.STATE_STORE) == ev.ROCKSDB
    assert spark.conf.get(ev.STATE_STORE, None) == before
