"""Joins, aggregates, ranking and evaluation on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import aggregates as ag
from newsloom.operators import gates, joins, mentions, ranking
from newsloom.plans import evaluation as ev
from newsloom.plans import issue as iss
from newsloom.plans import scoring

NOW = dt.datetime(2026, 8, 20, 12, 0, 0)


def days(n, seconds=0):
    return NOW - dt.timedelta(days=n, seconds=seconds)


def test_dedupe_keeps_newest_then_first(spark):
    rows = spark.createDataFrame(
        [("a", 0, days(3), "old"), ("a", 1, days(1), "new"), ("a", 2, days(1), "tie"), ("b", 3, days(9), "only")],
        "uid string, seq long, published_at timestamp_ntz, title string",
    )
    assert {r["uid"]: r["title"] for r in ag.dedupe_newest(rows).collect()} == {"a": "new", "b": "only"}


def test_recency_is_exact_and_volume_floors(spark):
    rows = spark.createDataFrame(
        [("x", days(7)), ("x", days(7, 1)), ("x", days(7, 86399)), ("x", days(8)), ("x", days(20)), ("x", NOW + dt.timedelta(hours=5))],
        "outlet string, published_at timestamp_ntz",
    )
    now = F.lit(NOW).cast("timestamp_ntz")
    assert gates.recent(rows, now, 7).count() == 2
    assert gates.recent(rows, now, 0).count() == 6
    report = {r["outlet"]: r for r in ag.volume_report(rows, "outlet", "published_at", now).collect()}
    assert (report["x"]["d7"], report["x"]["d14"], report["x"]["d30"]) == (4, 5, 6)
    assert report["ALL"]["total"] == 6
    assert report["x"]["newest_age"] == -1


def test_volume_counts_one_two_three(spark):
    rows = spark.createDataFrame([("x", days(1)), ("x", days(10)), ("x", days(25))], "outlet string, published_at timestamp_ntz")
    got = ag.volume_report(rows, "outlet", "published_at", F.lit(NOW).cast("timestamp_ntz")).filter("outlet = 'x'").first()
    assert (got["d7"], got["d14"], got["d30"]) == (1, 2, 3)


def test_recency_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(1, NOW)], "seq long, published_at timestamp_ntz").write.parquet(path)
    rows = gates.recent(spark.read.parquet(path), F.lit(NOW).cast("timestamp_ntz"), 7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published_at" in plan


@pytest.mark.parametrize(
    "xs, ys, want",
    [
        ([1, 2, 3, 4], [1, 2, 3, 4], 1.0),
        ([1, 2, 3, 4], [4, 3, 2, 1], -1.0),
        ([0.1, 0.2, 0.3, 0.4], [0, 0, 1, 1], 0.894427),
        ([1, 1, 1], [1, 2, 3], None),
        ([1], [1], None),
        ([], [], None),
    ],
)
def test_spearman(spark, xs, ys, want):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "x double, y double")
    got = ag.spearman(rows, "x", "y").first()
    assert got["n"] == len(xs)
    assert got["rho"] == want if want is None else got["rho"] == pytest.approx(want, abs=1e-6)


def test_spearman_random(spark):
    rng = random.Random(1)
    xs = [float(rng.randint(0, 9)) for _ in range(200)]
    ys = [float(rng.randint(0, 3)) + x / 5 for x in xs]
    rows = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    import pandas as pd

    want = pd.Series(xs).rank().corr(pd.Series(ys).rank())
    assert ag.spearman(rows, "x", "y").first()["rho"] == pytest.approx(want, abs=1e-9)


def test_average_rank_and_positions_match_a_plain_sort(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 20) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(7)
    got = {r["id"]: r["r"] for r in ag.average_rank(rows, "v", "r").collect()}
    s = sorted(values)
    assert all(got[i] == (s.index(v) + 1 + len(s) - s[::-1].index(v)) / 2 for i, v in enumerate(values))
    grouped = rows.withColumn("g", F.when(F.col("id") < 250, "hot"))
    placed = ranking.with_position(grouped, ["g"], [F.col("v").desc(), F.col("id")]).collect()
    for g in ("hot", None):
        mine = sorted((r for r in placed if r["g"] == g), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r["v"], r["id"]) for r in mine] == sorted((-r["v"], r["id"]) for r in mine)


@pytest.fixture
def many_partitions(spark):
    """Keep small partitions apart, so that offsets between them matter."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_positions_and_running_totals_across_partitions(spark, many_partitions):
    rng = random.Random(4)
    data = [(i, rng.randint(0, 40), "hot" if i % 3 else f"g{i % 5}") for i in range(900)]
    rows = spark.createDataFrame(data, "id long, v long, g string").repartition(6)
    placed = ranking.with_position(rows, ["g"], [F.col("v").desc(), F.col("id")])
    assert placed.select(F.spark_partition_id()).distinct().count() > 1
    got = {r["id"]: r["position"] for r in placed.collect()}
    want = {}
    for g in {d[2] for d in data}:
        mine = sorted(((-v, i) for i, v, h in data if h == g))
        want.update({i: n for n, (_, i) in enumerate(mine, 1)})
    assert got == want
    totals = ag.running_total(rows.groupBy("v").agg(F.count("*").alias("n")), "v", "n", "before").collect()
    assert all(r["before"] == sum(d[1] < r["v"] for d in data) for r in totals)
    counted = {r["id"]: r["position"] for r in ranking.with_position(rows, [], [F.col("id")]).collect()}
    assert counted == {i: i + 1 for i in range(900)}


def test_apply_scores(spark):
    items = spark.createDataFrame(
        [("a", "s1", "Events"), ("b", "s2", None), ("c", "s1", None), ("d", "s1", "Events"), ("e", "s1", None), ("f", "s1", None)],
        "uid string, source_id string, category string",
    )
    scores = spark.createDataFrame(
        [
            ("a", 0.125 + 0.5, "Events", 0, " short ", "Safety"),
            ("b", 0.9, "Events", 0, "w " * 41, None),
            ("c", 0.9, None, 0, "x", None),
            ("e", 0.9, "Events", 1, "x", None),
            ("f", 0.44, "Events", 0, "x", None),
        ],
        "uid string, relevance double, category string, is_promo int, gist string, beat string",
    )
    community = spark.createDataFrame([("s2",)], "source_id string")
    got = {r["uid"]: r for r in joins.apply_scores(items, scores, community).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["relevance"] == 0.62 and got["a"]["gist"] == "short"
    assert got["b"]["category"] == "Community" and got["b"]["gist"] is None
    loose = {r["uid"]: r for r in joins.apply_scores(items, scores, community, keep_unscored=True).collect()}
    assert set(loose) == {"a", "b", "d"} and loose["d"]["category"] == "Events"


def test_empty_allowlist_refuses_all(spark):
    mail = spark.createDataFrame([("A@x.org",), ("b@x.org",)], "sender string")
    allow = spark.createDataFrame([("a@X.org",)], "sender string")
    assert joins.allowed_senders(mail, allow).count() == 1
    assert joins.allowed_senders(mail, allow.limit(0)).count() == 0


def test_shorts_boundary_and_unknown_lengths(spark):
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    lengths = spark.createDataFrame([("a", 180), ("b", 181)], "video_id string, duration_s long")
    kept = {r["video_id"] for r in gates.drop_shorts(videos, lengths, "video_id").collect()}
    assert kept == {"b", "c"}
    assert gates.drop_shorts(videos, lengths.limit(0), "video_id").count() == 3


def test_resource_prefers_picks_then_instruction(spark):
    rows = spark.createDataFrame(
        [
            ("i", 1, "How to frag", 0.5, "v1", False),
            ("i", 2, "Tank tour", 0.9, "v2", False),
            ("i", 3, "No video", 1.0, None, True),
            ("j", 4, "How to frag", 0.9, "v4", True),
            ("j", 5, "Tank tour", 0.95, "v5", True),
            ("k", 6, "A", 0.5, "v6", False),
            ("k", 7, "B", 0.5, "v7", False),
        ],
        "issue string, seq long, title string, relevance double, video_id string, is_pick boolean",
    )
    got = {r["issue"]: r["seq"] for r in ranking.resource_slot(rows, ["issue"]).collect()}
    assert got == {"i": 1, "j": 5, "k": 6}


def test_summary_plurals(spark):
    rows = spark.createDataFrame([("d", 1, "T" * 100, "O")], "issue string, position long, title string, source_name string")
    got = iss.summaries(rows, ["issue"]).first()["description"]
    assert got == "1 item from 1 outlet, led by “" + "T" * 89 + "…”"


def labelled(spark, triples):
    return spark.createDataFrame(
        [(f"u{i}", i, "s", b, r) for i, (b, r) in enumerate(triples)],
        "uid string, seq long, source_id string, bucket string, relevance double",
    )


def test_outcomes_and_precision(spark):
    rows = labelled(
        spark,
        [("lead", 0.9), ("lead", 0.2), ("drop", 0.8), ("include", 0.1), ("borderline", 0.7), ("drop", 0.1), ("include", None)],
    )
    counts = {r["outcome"]: r["n"] for r in ev.outcome_counts(rows).collect()}
    assert counts == {"agreed": 2, "lead_missed": 1, "drop_admitted": 1, "include_below": 1, "borderline": 1, "unscored": 1}
    got = {r["k"]: (r["hits"], r["considered"]) for r in ev.precision_at(rows, (1, 3, 10)).collect()}
    assert got == {1: (1, 1), 3: (1, 3), 10: (3, 6)}
    assert {r["source_id"]: r["errors"] for r in ev.errors_by_source(rows).collect()} == {"s": 2}


def test_usage_cost_per_million(spark):
    usage = spark.createDataFrame(
        [("in", "m", 1_000_000, None, None, None), ("out", "m", None, 1_000_000, None, None), ("read", "m", 0, 0, 0, 1_000_000), ("x", "other", 5, 5, 5, 5)],
        "stage string, model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long",
    )
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, input_price double, output_price double")
    got = {r["stage"]: r for r in ag.usage_cost(usage, prices).collect()}
    assert [round(got[s]["cost_usd"], 9) for s in ("in", "out", "read", "x", "total")] == [1.0, 5.0, 0.1, 0.0, 6.1]
    assert got["read"]["cache_hit_rate"] == 1.0 and got["out"]["cache_hit_rate"] == 0.0


ALIASES = [("brs", "Bulk Reef Supply"), ("brs", "BRS"), ("reef", "Reef"), ("cpp", "C++"), ("eco", "EcoTech Marine"), ("dot", "A.B. Co")]


def test_mentions(spark):
    texts = spark.createDataFrame(
        [
            (1, "bulk REEF supply and brs."),
            (2, "reefs, not the entity"),
            (3, "we like c++; ecotech\nmarine too"),
            (4, "EcoTech Marine-grade, c+++ and A.B. Co!"),
            (5, "EcoTech  Marine with two spaces"),
            (6, "über_reef xreef reefx"),
        ],
        "doc_id long, text string",
    )
    aliases = spark.createDataFrame(ALIASES, "entity_id string, alias string")
    got = {}
    for r in mentions.mentions(texts, aliases).orderBy("doc_id", "mention_rank").collect():
        got.setdefault(r["doc_id"], []).append((r["entity_id"], r["alias"]))
    assert got == {
        1: [("brs", "Bulk Reef Supply"), ("reef", "Reef")],
        3: [("cpp", "C++")],
        4: [("eco", "EcoTech Marine"), ("dot", "A.B. Co"), ("cpp", "C++")],
    }


def test_mentions_agree_with_regex_search(spark):
    import re

    rng = random.Random(3)
    pool = ["red", "sea", "Reef", "tank", "co2", "x-1", "é"]
    texts = [" ".join(rng.choices(pool, k=12)) + rng.choice([".", "!", ""]) for _ in range(60)]
    names = sorted({" ".join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(12)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    aliases = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "entity_id string, alias string")
    got = {(r["doc_id"], r["entity_id"]) for r in mentions.mentions(docs, aliases).collect()}
    want = {
        (d, f"e{i}")
        for d, t in enumerate(texts)
        for i, n in enumerate(names)
        if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", t, re.I)
    }
    assert got == want


def test_ownership_chain_stops_on_cycles(spark):
    rows = spark.createDataFrame(
        [
            ("a", "A", "brand", "b", None), ("b", "B", "manufacturer", "c", None), ("c", "C", "sponsor", None, None),
            ("x", "X", "brand", "y", None), ("y", "Y", "brand", "x", None), ("t", "T", "parent", None, "TCK"),
            ("o", "O", "brand", "gone", None),
        ],
        "entity_id string, name string, kind string, parent string, ticker string",
    )
    got = {r["entity_id"]: r["statement"] for r in mentions.ownership_statements(rows).collect()}
    assert got == {
        "a": "A — parent: B — portfolio company of C",
        "b": "B — portfolio company of C",
        "c": "C",
        "x": "X — parent: Y",
        "y": "Y — parent: X",
        "t": "T — shareholder-owned, TCK",
        "o": "O",
    }
    assert [r["entity_id"] for r in joins.orphans(rows).collect()] == ["o"]


def test_scoring_accounts_for_every_item(spark):
    import pandas as pd

    rows = spark.createDataFrame(
        [(f"u{i}", "s", f"title {i}", "text", NOW) for i in range(50)],
        "uid string, source_name string, title string, raw_text string, published_at timestamp_ntz",
    ).coalesce(1)

    def scorer(batch):
        if "u25" in set(batch["uid"]):
            raise RuntimeError("down")
        uids = ["ghost" if u == "u3" else u for u in batch["uid"]]
        return pd.DataFrame(
            {"uid": uids, "category": "Events", "relevance": 0.5, "is_promo": 0, "gist": "g", "beat": None}
        )

    out = scoring.score(scoring.payload(rows), scorer, batch_size=10)
    counts = {r["outcome"].split(":")[0]: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert counts == {"scored": 39, "unknown": 1, "omitted": 1, "failed": 10}
    assert scoring.valid_verdicts(out).count() == 39


def test_publish_boundary_fails_on_uncredited_rows(spark):
    good = spark.createDataFrame([("t", "s", "https://a.com/x")], "title string, source_name string, url string")
    bad = good.union(spark.createDataFrame([(" ", "s", "https://a.com/x")], good.schema))
    assert gates.require_creditable(good).count() == 1
    assert gates.creditable(bad).count() == 1
    with pytest.raises(Exception, match="uncreditable"):
        gates.require_creditable(bad).collect()


def test_rows_without_a_key_are_not_copies(spark):
    rows = spark.createDataFrame([(1, None, NOW), (2, None, NOW), (3, "a", NOW), (4, "a", NOW)], "seq long, uid string, published_at timestamp_ntz")
    assert sorted(r["seq"] for r in ag.dedupe_newest(rows).collect()) == [1, 2, 3]


def test_ranks_keep_rows_without_a_value(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, v long")
    assert {r["id"]: r["r"] for r in ag.average_rank(rows, "v", "r").collect()} == {1: 1.0, 2: None, 3: 2.0}


def test_first_n_above_the_planners_limit(spark):
    rows = spark.range(3000).withColumn("g", F.lit("hot"))
    got = ranking.first_n(rows, ["g"], [F.col("id")], 1500).collect()
    assert sorted(r["id"] for r in got) == list(range(1500))


def test_resource_slot_ranks_two_decimals(spark):
    rows = spark.createDataFrame(
        [(1, "x", 0.571, "v1", False), (1, "y", 0.574, "v2", False)],
        "issue long, title string, relevance double, video_id string, is_pick boolean",
    ).withColumn("seq", F.when(F.col("title") == "x", 1).otherwise(2))
    assert ranking.resource_slot(rows, ["issue"]).first()["seq"] == 1
