"""Stored issue runs: visible whole or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.plans import run as runs
from newsloom.session import scratch_path

NOW = dt.datetime(2026, 8, 20)
ITEMS = (
    "seq long, uid string, source_id string, source_name string, title string, category string, "
    "video_id string, published_at timestamp_ntz, raw_text string"
)
COMMUNITY = "source_id string"
SCORES = "uid string, category string, relevance double, is_promo int, gist string, beat string, prompt_hash string, model string, scored_at timestamp_ntz"


def items(spark, *ids, days=1):
    rows = [
        (i, f"u{i}", f"s{i % 2}", f"Outlet {i % 2}", f"alpha{i} beta{i} gamma{i}", "Events", None, NOW - dt.timedelta(days=days), f"text {i}")
        for i in ids
    ]
    return spark.createDataFrame(rows, ITEMS)


def by_number():
    """Relevance follows the uid; every fifth item is left out, every seventh out of range."""
    import pandas as pd

    def score(batch):
        n = batch["uid"].str[1:].astype(int)
        out = pd.DataFrame({
            "uid": batch["uid"], "category": "Events", "relevance": [2.0 if k % 7 == 0 else 0.2 if k % 2 else 0.9 for k in n],
            "is_promo": 0, "gist": "g", "beat": None,
        })
        return out[n % 5 != 0]

    return score


@pytest.fixture
def store(spark):
    return runs.RunStore(scratch_path(spark, "runs"), buckets=4, bits=1 << 15)


def go(spark, store, run, rows, **how):
    judge = runs.Scoring(by_number(), "p1", "m")
    community = spark.createDataFrame([], COMMUNITY)
    return runs.issue_run(store, run, rows, F.lit(NOW), judge, community, **how)


def uids(df):
    return sorted(r["uid"] for r in df.select("uid").collect())


def state(spark, store):
    seen = store.log(spark, "seen").read(spark, spark.createDataFrame([], "uid string").schema)
    published = store.log(spark, "published").read(spark, spark.createDataFrame([], "uid string").schema)
    scores = store.scores(spark, spark.createDataFrame([], SCORES).schema)
    issue = store.last(spark, "issue", spark.createDataFrame([], "uid string").schema)
    return uids(seen), uids(published), uids(scores), uids(issue)


def test_a_run_and_the_next_one(spark, store):
    assert state(spark, store) == ([], [], [], [])
    got = go(spark, store, "one", items(spark, *range(1, 9)))
    # 5 is left out by the scorer, 7 is out of range, odd ones are below the threshold.
    assert uids(got) == ["u2", "u4", "u6", "u8"]
    seen, published, scores, issue = state(spark, store)
    assert seen == [f"u{i}" for i in range(1, 9)] and published == issue == uids(got)
    assert scores == ["u1", "u2", "u3", "u4", "u6", "u8"]
    rejected = store.last(spark, "rejected", spark.createDataFrame([], "uid string, reject_reason string").schema)
    assert {tuple(r) for r in rejected.collect()} == {("u5", "omitted"), ("u7", "relevance not in [0, 1]")}
    line = store.manifest(spark).first()
    assert line["counts"] == {"seen": 8, "scores": 6, "rejected": 2, "issue": 4, "published": 4, "archive": 1}

    again = go(spark, store, "two", items(spark, *range(6, 14)), picks=items(spark, 2, 30))
    # 6 to 8 were seen; 2 was published, so it is no pick any more.
    assert uids(again) == ["u12", "u30"]
    assert store.complete(spark) == ("one", "two")
    with pytest.raises(ValueError):
        go(spark, store, "two", items(spark, 50))


@pytest.mark.parametrize("after", ["seen", "all but the manifest"])
def test_a_broken_run_leaves_no_trace_for_readers(spark, store, monkeypatch, after):
    go(spark, store, "one", items(spark, 1, 2))
    before = state(spark, store)

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        if after == "seen":
            m.setattr(runs.scoring, "score", stop)
        else:
            m.setattr(runs.RunStore, "commit", stop)
        with pytest.raises(RuntimeError):
            go(spark, store, "two", items(spark, 2, 4, 6))
    assert state(spark, store) == before and store.complete(spark) == ("one",)
    # Another run finds what the broken one had taken, and so does its own second attempt.
    assert uids(go(spark, store, "three", items(spark, 4))) == ["u4"]
    assert uids(go(spark, store, "two", items(spark, 2, 4, 6))) == ["u6"]
    assert state(spark, store)[0] == ["u1", "u2", "u4", "u6"]


def test_a_trial_run_publishes_nothing(spark, store):
    go(spark, store, "trial", items(spark, 2, 4), full_run=False)
    seen, published, _, issue = state(spark, store)
    assert (seen, published, issue) == (["u2", "u4"], [], ["u2", "u4"])
    got = go(spark, store, "full", items(spark, 2, 6), prefilter=lambda rows: rows.filter("uid <> 'u6'"), picks=items(spark, 4))
    assert uids(got) == ["u4"] and state(spark, store)[1] == ["u4"]


def test_a_later_run_has_the_last_word_on_a_score(spark, store):
    go(spark, store, "one", items(spark, 2))
    schema = spark.createDataFrame([], SCORES).schema
    first = store.scores(spark, schema).first()
    lower = spark.createDataFrame([tuple(first)], schema).withColumn("relevance", F.lit(0.1))
    store.write("scores", lower, "two")
    assert store.scores(spark, schema).first()["relevance"] == 0.9
    store.commit(spark, "two", True, {})
    assert store.scores(spark, schema).first()["relevance"] == 0.1


def test_a_run_over_nothing(spark, store):
    assert go(spark, store, "empty", items(spark)).count() == 0
    assert store.complete(spark) == ("empty",)


def test_items_are_made_once_and_texts_of_old_ones_stay_behind(spark, store):
    """Whatever the items come from is run once a run; only recent rows are handed on with their text."""
    made = spark.sparkContext.accumulator(0)

    def count(text):
        made.add(1)
        return text

    rows = items(spark, *range(1, 9)).unionByName(items(spark, 2, *range(20, 40), days=30))
    rows = rows.withColumn("source_name", F.udf(count, "string")("source_name"))
    got = go(spark, store, "one", rows)
    assert uids(got) == ["u2", "u4", "u6", "u8"] and "raw_text" not in got.columns
    assert made.value == 29
    assert state(spark, store)[0] == sorted(f"u{i}" for i in [*range(1, 9), *range(20, 40)])
