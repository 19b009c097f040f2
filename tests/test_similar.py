"""The parallel collapse: literal cases and the property that defines it."""

import random

import pytest

from newsloom.functions.text import STOPWORDS
from newsloom.operators import similar as sm

TINY = sm.BlockBudget(pairs_per_set=2, floor=4, salt_rows=3)


def tokens(title):
    import re

    return frozenset(w for w in re.findall("[a-z0-9]+", title.lower()) if len(w) > 2 and w not in STOPWORDS)


def assert_collapsed(titles, leaders, threshold=0.40):
    """What defines the result: a headline merges into its first kept likeness, and a kept one has none before it."""
    sets = [tokens(t) for t in titles]
    kept = {i for i, leader in enumerate(leaders) if leader is None}

    def alike(i, j):
        return sets[i] and sets[j] and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= threshold

    for i, leader in enumerate(leaders):
        candidates = {j for j in kept if j < i and len(sets[i]) >= 3 and alike(i, j)}
        assert leader == min(candidates, default=None), titles[i]


def run(spark, titles, budget):
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string").repartition(5)
    got = sm.collapse_similar(rows, budget=budget).collect()
    assert len(got) == len(titles)
    return [r["leader"] for r in sorted(got, key=lambda r: r["seq"])]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("budget", [sm.BlockBudget(), TINY], ids=["one-block", "many-blocks"])
def test_result_is_the_ordered_collapse(spark, seed, budget):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(rng.choice([8, 14, 30]))]
    titles = [" ".join(rng.sample(vocabulary, rng.randint(1, 7))) for _ in range(45)]
    assert_collapsed(titles, run(spark, titles, budget))


def test_a_third_of_rows_are_copies_and_near_copies(spark):
    rng = random.Random(5)
    base = ["weekly", "stock", "update", "report"]
    titles = []
    for i in range(300):
        if i % 3 == 0:
            titles.append(" ".join(base + [f"store{i % 90}", f"city{i % 7}"]))
        elif i % 3 == 1:
            titles.append("breaking story about corals")
        else:
            titles.append(" ".join(f"term{rng.randint(0, 400)}" for _ in range(5)))
    budget = sm.BlockBudget(pairs_per_set=3, floor=30, salt_rows=20)
    assert_collapsed(titles, run(spark, titles, budget))


def test_near_copies_are_not_paired_with_each_other(spark):
    """A group of near copies leaves one row each, not all its pairs."""
    titles = [f"weekly stock update report store{i}" for i in range(400)]
    seen = []
    original = sm.materialize

    def counting(df, label):
        out = original(df, label)
        if label in ("collapse-edges", "collapse-removed"):
            seen.append(out.count())
        return out

    sm.materialize = counting
    try:
        leaders = run(spark, titles, sm.BlockBudget(pairs_per_set=1, floor=20))
    finally:
        sm.materialize = original
    assert leaders == [None] + [0] * 399
    assert sum(seen) < 20 * 20 + 400


def test_seahorse_headlines_collapse_to_one(spark):
    titles = [
        "New seahorse species discovered in Australia",
        "A new species of seahorse discovered off Australia",
        "Seahorse species new to science discovered",
        "Clownfish aquaculture prices rise",
    ]
    leaders = run(spark, titles, sm.BlockBudget())
    assert leaders == [None, 0, 0, None]
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    kept = sm.kept_with_counts(rows, sm.collapse_similar(rows)).orderBy("seq").collect()
    assert [(r["seq"], r["similar"]) for r in kept] == [(0, 2), (3, None)]


def test_short_headlines_stay_but_absorb(spark):
    titles = ["Coral", "Coral", "Coral bleaching event widespread", "", "the of"]
    assert run(spark, titles, sm.BlockBudget()) == [None, None, 0, None, None]


def test_empty_input(spark):
    rows = spark.createDataFrame([], "seq long, title string")
    assert sm.collapse_similar(rows).count() == 0


def test_no_nested_loop_in_the_pair_join(spark):
    sets = spark.createDataFrame([(1, [(1, "a")])], "rep long, words array<struct<df: long, token: string>>")
    plan = sm._matches(sets, sets, 0.4, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def chain(n, copies=1):
    """Each headline is like the next one only."""
    return [f"aa{i} bb{i} aa{i + 1} bb{i + 1} only{i}" for i in range(n) for _ in range(copies)]


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    jobs = []
    original = sm.materialize

    def counting(df, label):
        jobs.append(label)
        return original(df, label)

    monkeypatch.setattr(sm, "materialize", counting)
    got = run(spark, chain(2_000), sm.BlockBudget())
    assert got == [None if i % 2 == 0 else i - 1 for i in range(2_000)]
    assert len(jobs) < 40, len(jobs)


@pytest.mark.parametrize("seed", range(3))
def test_shortened_chains_give_the_ordered_collapse(spark, seed, monkeypatch):
    monkeypatch.setattr(sm, "PLAIN_JOBS", 0)
    rng = random.Random(seed)
    titles = chain(25) + [" ".join(rng.sample([f"word{i}" for i in range(12)], rng.randint(1, 7))) for _ in range(60)]
    titles += [f"aa{i} bb{i} aa{j} bb{j} only" for i, j in ((2, 9), (4, 5), (8, 20))]
    rng.shuffle(titles)
    assert_collapsed(titles, run(spark, titles, sm.BlockBudget()))


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_one_pass(spark, seed):
    from newsloom.session import scratch_path
    from newsloom.sinks.headlines import HeadlineIndex, collapse_next

    rng = random.Random(seed)
    words = [f"word{i}" for i in range(16)]
    titles = [" ".join(rng.sample(words, rng.randint(1, 7))) for _ in range(40)] + ["", "the of", "one two", None]
    titles += rng.sample(titles, 20) + [" ".join(rng.sample(words, rng.randint(1, 7))) for _ in range(20)]
    index = HeadlineIndex(scratch_path(spark, "index"), buckets=4)
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    cuts, got = [0, 30, 31, 70, len(titles)], {}
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = rows.filter(f"seq >= {low} and seq < {high}")
        if k == 2:
            collapse_next(part, index, f"run {k}")
        got |= {r["seq"]: r["leader"] for r in collapse_next(part, index, f"run {k}").collect()}
    assert_collapsed([t or "" for t in titles], [got[i] for i in range(len(titles))])
    with pytest.raises(ValueError):
        collapse_next(rows.filter("seq = 5"), index, "too late")
    assert collapse_next(rows.limit(0), index, "nothing").count() == 0


def test_a_batch_opens_only_the_buckets_of_its_words(spark):
    import glob

    from newsloom.session import scratch_path
    from newsloom.sinks.buckets import bucket_of
    from newsloom.sinks.headlines import HeadlineIndex, collapse_next

    index = HeadlineIndex(scratch_path(spark, "index"), buckets=64)
    rows = spark.createDataFrame([(i, f"aa{i} bb{i} cc{i}") for i in range(200)], "seq long, title string")
    collapse_next(rows, index, "one")
    words = spark.createDataFrame([(w,) for w in ("aa7", "bb7", "cc7")], "token string")
    mine = {r[0] for r in words.select(bucket_of("token", 64)).collect()}
    spoiled = 0
    for f in glob.glob(f"{index.path}/words/run=one/b64=*/*.parquet"):
        if int(f.split("b64=")[1].split("/")[0]) not in mine:
            open(f, "wb").write(b"no parquet")
            spoiled += 1
    assert spoiled > 40
    late = spark.createDataFrame([(500, "cc7 aa7 bb7")], "seq long, title string")
    assert [r["leader"] for r in collapse_next(late, index, "two").collect()] == [7]
