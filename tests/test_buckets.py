"""Bucketed ledgers: what is kept, what is opened, what survives retries."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.sinks.buckets import ScoreLedger, SeenLog, bit_number, bucket_of, has_bit

SCORES = "uid string, prompt_hash string, model string, relevance double, scored_at timestamp_ntz"
T0 = dt.datetime(2026, 8, 1)


def keys(spark, *ids):
    return spark.createDataFrame([(str(i), i, f"t{i}") for i in ids], "uid string, seq long, title string")


@pytest.fixture
def log(spark):
    return SeenLog(scratch_path(spark, "buckets"), buckets=8, bits=1 << 15)


def spoil(path):
    """Make a folder's files unreadable; returns how many there were."""
    files = [f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    for f in files:
        with open(f, "wb") as out:
            out.write(b"no parquet")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            with open(crc, "wb") as out:
                out.write(b"")
    return len(files)


def bucket_ids(spark, buckets, ids):
    rows = keys(spark, *ids).select("uid", bucket_of("uid", buckets).alias("b")).collect()
    return {int(r["uid"]): r["b"] for r in rows}


def test_first_write_wins_and_retries_change_nothing(spark, log):
    first = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "b"), (None, 4, "x")], "uid string, seq long, title string")
    second = spark.createDataFrame([("b", 4, "again"), ("c", 5, "c")], "uid string, seq long, title string")
    assert log.append(first, "r/1").count() == 2
    assert log.append(second, "r2").count() == 1
    assert log.append(second, "r2").count() == 1
    got = {r["uid"]: (r["title"], r["run"]) for r in log.read(spark, first.schema).collect()}
    assert got == {"a": ("early", "r/1"), "b": ("b", "r/1"), "c": ("c", "r2")}
    assert log.append(second.limit(0), "r2").count() == 0
    assert log.publish(second, "trial", full_run=False).count() == 0
    assert log.read(spark, first.schema).count() == 2


def test_an_empty_log_has_seen_nothing(spark, log):
    assert log.unseen(keys(spark, 1, 2)).count() == 2
    assert log.read(spark, keys(spark, 1).schema).count() == 0
    assert log.append(keys(spark), "r").count() == 0
    log.compact(spark)


def test_buckets_without_a_possible_hit_are_not_opened(spark, log):
    at = bucket_ids(spark, 8, range(400))
    low = [i for i in at if at[i] < 4]
    log.append(keys(spark, *range(400)), "r1")
    opened = sum(spoil(f"{log.path}/rows/run=r1/b8={b}") for b in range(4, 8))
    assert opened >= 4
    new = bucket_ids(spark, 8, range(1000, 1200))
    again = [*low[:20], *(i for i in new if new[i] < 4)][:40]
    assert {r["uid"] for r in log.unseen(keys(spark, *again)).collect()} == {str(i) for i in again if i >= 400}


def test_keys_whose_bit_is_unset_open_nothing(spark, log):
    log.append(keys(spark, *range(300)), "r1")
    maybe = log.maybe_seen(keys(spark, *range(5000, 9000)))
    clear = [int(r["uid"]) for r in maybe.filter(~F.col("_maybe")).collect()]
    # 300 of 32,768 bits are set, so about one new key in a hundred goes on to the exact comparison.
    assert 3900 < len(clear) < 4000
    assert spoil(f"{log.path}/rows") > 0
    assert log.unseen(keys(spark, *clear)).count() == len(clear)
    assert log.maybe_seen(keys(spark, *range(300))).filter("_maybe").count() == 300


def test_merged_bitmaps_know_the_same_keys(spark, log):
    for run, ids in (("a", range(100)), ("b", range(100, 180)), ("c", range(90, 260))):
        log.append(keys(spark, *ids), run)
    before = {r["map"]: bytes(r["bits"]) for r in log.known_bits(spark).collect()}
    log.compact(spark)
    log.compact(spark)
    assert {r["map"]: bytes(r["bits"]) for r in log.known_bits(spark).collect()} == before
    assert log.unseen(keys(spark, *range(250, 270))).count() == 10
    assert log.append(keys(spark, *range(90, 260)), "c").count() == 80


def test_bits_are_found_where_they_were_set(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("uid"))
    bit = bit_number("uid", 32768)
    even = rows.filter("cast(uid as int) % 2 = 0")
    bitmap = F.lit(bytes(even.agg(F.bitmap_construct_agg(bit)).first()[0]))
    set_ = {r[0] for r in even.select(bit).collect()}
    found = rows.select(bit.alias("p"), has_bit(bitmap, bit).alias("has")).collect()
    assert all(r["has"] == (r["p"] in set_) for r in found)


def test_another_layout_is_refused(spark, log):
    log.append(keys(spark, 1), "r1")
    with pytest.raises(ValueError):
        SeenLog(log.path, buckets=4, bits=log.bits).unseen(keys(spark, 1)).count()


def scores(spark, *rows):
    return spark.createDataFrame([(u, p, "m", x, T0 + dt.timedelta(days=d)) for u, p, x, d in rows], SCORES)


def test_upsert_rewrites_touched_buckets_only(spark):
    ledger = ScoreLedger(scratch_path(spark, "scores"), buckets=8)
    ledger.upsert(scores(spark, *[(str(i), p, 0.1, 0) for i in range(200) for p in ("p1", "p2")]))
    at = bucket_ids(spark, 8, range(200))
    mine = [i for i in at if at[i] == at[0]]

    def files():
        found = glob.glob(f"{ledger.path}/prompt_hash=*/b8=*/*.parquet")
        return {f: os.stat(f).st_mtime_ns for f in found}

    before = files()
    other = [f for f in before if f"prompt_hash=p1/b8={at[0]}/" not in f]
    out = ledger.upsert(scores(spark, *[(str(i), "p1", 0.9, 0) for i in mine[:5]], ("new", "p3", 0.4, 0)))
    after = files()
    assert all(after[f] == before[f] for f in other) and len(other) == 15
    got = {(r["uid"], r["prompt_hash"]): r["relevance"] for r in out.collect()}
    want = {(str(i), p): 0.1 for i in range(200) for p in ("p1", "p2")}
    assert got == want | {(str(i), "p1"): 0.9 for i in mine[:5]} | {("new", "p3"): 0.4}


def test_the_last_write_wins_whatever_it_says(spark):
    ledger = ScoreLedger(scratch_path(spark, "scores"), buckets=2)
    ledger.upsert(scores(spark, ("a", "p1", 0.9, 3), ("a", "p1", 0.2, 1)))
    assert [r["relevance"] for r in ledger.read(spark, scores(spark, ("a", "p", 0.1, 0)).schema).collect()] == [0.9]
    assert [r["relevance"] for r in ledger.upsert(scores(spark, ("a", "p1", 0.1, 0))).collect()] == [0.1]
