"""Streaming forms, run to the end of what is available and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.sinks.buckets import ScoreLedger
from newsloom.streaming import events as ev
from newsloom.streaming import streams as st
from suite.registry import query
from suite.tables import table


def events(spark, sf):
    return st.read_events(spark, sf, "events*.parquet", table(spark, sf, "events").schema, "ts")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _dedupe(spark, sf):
    path, state = scratch_path(spark, "stream-dedupe"), scratch_path(spark, "state")
    unique = st.dedupe(events(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    st.run_to_table(unique.select("user_id", "event_type"), path, state)
    return spark.read.parquet(path)


_WINDOWS = """SELECT window_start, window_start + INTERVAL {width} DAY AS window_end, event_type AS outlet, count(*) AS n FROM ({src}) e
  WHERE window_start + INTERVAL {width} DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL"""


def closed(spark, sf, width, slide=None):
    path, state = scratch_path(spark, "stream-volume"), scratch_path(spark, "state")
    counts = st.volume(events(spark, sf), "event_type", "ts", width, "1 day", slide)
    st.run_to_table(counts, path, state)
    return spark.read.parquet(path).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


@query(
    "stream_volume_tumbling",
    _WINDOWS.format(
        width=7, src="SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start FROM events"
    ),
)
def _tumbling(spark, sf):
    return closed(spark, sf, "7 days")


@query(
    "stream_volume_sliding",
    _WINDOWS.format(
        width=14,
        src="SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') - to_days(CAST(k AS INT)) AS window_start FROM events, (VALUES (0), (7)) v(k)",
    ),
)
def _sliding(spark, sf):
    return closed(spark, sf, "14 days", "7 days")


@query("stream_seen_upsert", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _upsert(spark, sf):
    path, state = scratch_path(spark, "stream-seen"), scratch_path(spark, "state")
    st.run_batches(events(spark, sf).select("user_id", "event_id"), st.append_unseen(path, "user_id", "event_id", "all"), state)
    return spark.read.parquet(path).select("user_id", "event_id")


@query("stream_seen_two_runs", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _two_runs(spark, sf):
    """Two jobs, each with a state of its own, over the two halves of the events: neither loses the other's rows."""
    path = scratch_path(spark, "stream-seen")
    rows = events(spark, sf).select("user_id", "event_id")
    half = table(spark, sf, "events").agg(F.expr("max(event_id) div 2")).first()[0]
    for job, part in (("early", F.col("event_id") <= half), ("late", F.col("event_id") > half)):
        handler = st.append_unseen(path, "user_id", "event_id", job)
        st.run_batches(rows.filter(part), handler, scratch_path(spark, "state"))
    return spark.read.parquet(path).select("user_id", "event_id")


@query("stream_recency", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _recency(spark, sf):
    path, state = scratch_path(spark, "stream-recent"), scratch_path(spark, "state")
    # The reference time is a job parameter: one value, the newest timestamp of the table.
    now = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").cast("string")).first()[0]
    fresh = st.recent_only(events(spark, sf).select("event_id", "ts"), "ts", F.lit(now).cast("timestamp"), 7)
    st.run_to_table(fresh, path, state)
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_silent_sources",
    """SELECT CAST(user_id AS VARCHAR) AS source, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOURS AS silent
    FROM events GROUP BY user_id""",
)
def _silent(spark, sf):
    path, state = scratch_path(spark, "stream-last"), scratch_path(spark, "state")
    talk = events(spark, sf).select(F.col("user_id").cast("string").alias("user"), "ts")
    st.run_batches(talk, st.track_last_seen(path, "user", "ts", "all"), state)
    quiet = st.silent_sources(spark.read.parquet(path), "12 HOURS")
    return quiet.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


# Arrival differs from event time here: every eleventh event comes two files after its own.
FILES = 5
_ARRIVED = f"""parts AS (SELECT *, least({FILES} - 1, event_id * {FILES} // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END) AS part FROM events),
marks AS (SELECT part, max(ts) AS newest FROM parts GROUP BY part),
horizons AS (SELECT p.part, (SELECT max(newest) FROM marks m WHERE m.part < p.part) AS before FROM marks p)"""


def arrive(spark, sf, folder, files, late_by):
    """Write the files of ``files`` one after the other, since a file stream goes by file time; returns the schema."""
    rows = table(spark, sf, "events")
    most = rows.agg(F.max("event_id") + 1).first()[0]
    part = F.least(F.lit(FILES - 1), F.expr(f"event_id * {FILES} div {most}") + late_by)
    for i in files:
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    return rows.schema


@query(
    "stream_late_items",
    f"""WITH {_ARRIVED} SELECT event_id, part AS batch, CASE WHEN ts < before - INTERVAL 2 DAY THEN 'late' END AS verdict,
      sum(CASE WHEN ts < before - INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY part)::BIGINT AS late_in_batch
    FROM parts JOIN horizons USING (part)""",
)
def _late(spark, sf):
    folder = scratch_path(spark, "arrivals")
    schema = arrive(spark, sf, folder, range(FILES), F.when(F.col("event_id") % 11 == 0, 2).otherwise(0))
    stream = st.read_events(spark, folder, "*.parquet", schema, "ts", files_per_batch=1).select("event_id", "ts")
    tables = ev.LateTables(scratch_path(spark, "late-rows"), scratch_path(spark, "late-marks"))
    st.run_batches(stream, ev.late_rule(tables, "ts", "2 DAYS", "items"), scratch_path(spark, "state"))
    rows = tables.read(spark, stream.schema)
    counts = ev.late_counts(rows).select("batch", F.col("late").alias("late_in_batch"))
    return rows.join(counts, "batch").select("event_id", "batch", "verdict", "late_in_batch")


@query(
    "stream_score_upsert",
    f"""WITH {_ARRIVED} SELECT uid, prompt_hash, relevance FROM (
      SELECT CAST(user_id AS VARCHAR) AS uid, event_type AS prompt_hash, value / 1000 AS relevance,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY part DESC, ts DESC, value DESC) AS r FROM parts) x WHERE r = 1""",
)
def _scores(spark, sf):
    """Verdicts that arrive late replace earlier ones: the file decides, inside it the time."""
    folder = scratch_path(spark, "arrivals")
    schema = arrive(spark, sf, folder, range(FILES), F.when(F.col("event_id") % 11 == 0, 2).otherwise(0))
    stream = st.read_events(spark, folder, "*.parquet", schema, "ts", files_per_batch=1).select(
        F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("prompt_hash"), F.lit("m").alias("model"),
        (F.col("value") / 1000).alias("relevance"), F.col("ts").alias("scored_at"),
    )
    ledger = ScoreLedger(scratch_path(spark, "stream-scores"), buckets=4)
    st.run_batches(stream, ledger.upsert_batch, scratch_path(spark, "state"))
    return ledger.read(spark, stream.schema).select("uid", "prompt_hash", "relevance")


# Files 0 to 2 belong to the first run, which ends with a batch of no data (slot 3); then the query
# starts again from its checkpoint. A timer can run out in every slot from the row's own to the last
# one before the source's next row, by the watermark of the slots before.
@query(
    "stream_silence_alerts",
    f"""WITH t AS (SELECT user_id, date_trunc('millisecond', ts) AS seen, event_id * {FILES} // (SELECT max(event_id) + 1 FROM events) AS part FROM events),
    s AS (SELECT CAST(user_id AS VARCHAR) AS source, seen, part + CASE WHEN part >= 3 THEN 1 ELSE 0 END AS slot FROM t),
    newest AS (SELECT slot, max(seen) AS w FROM s GROUP BY slot),
    turn AS (SELECT source, slot, max(seen) AS seen, lead(slot) OVER (PARTITION BY source ORDER BY slot) AS next_slot FROM s GROUP BY source, slot)
    SELECT source, seen AS last_seen, seen + INTERVAL 20 HOUR AS silent_since FROM turn
    WHERE seen + INTERVAL 20 HOUR < (SELECT max(w) FROM newest WHERE newest.slot <= coalesce(turn.next_slot - 2, {FILES + 1}))""",
)
def _silence(spark, sf):
    folder, path, state = (scratch_path(spark, x) for x in ("arrivals", "alerts", "state"))
    with ev.with_timers(spark):
        # The query runs over the first three files, stops, and starts again when the others have come.
        for files in (range(3), range(3, FILES)):
            schema = arrive(spark, sf, folder, files, F.lit(0))
            stream = st.read_events(spark, folder, "*.parquet", schema, "ts", files_per_batch=1)
            st.run_to_table(ev.silence_alerts(stream, "user_id", "ts", 20 * 3_600_000), path, state)
    alerts = spark.read.parquet(path)
    return alerts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_seen", "silent_since")})
