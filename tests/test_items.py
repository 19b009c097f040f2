"""Queries over the items: what their plans move, and what they return on rows of their own."""

import re
from datetime import datetime, timedelta

import pytest

import suite.catalog  # noqa: F401
from suite.registry import QUERIES
from suite.tables import identified, items, unique_items

WORDS = {0: "One two. Rest", 1: "No full stop", 2: None, 3: ". starts with it", 4: "x"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with events and labels; document 4 is there twice, one has no id."""
    root = tmp_path_factory.mktemp("tables")
    start = datetime(2024, 1, 1)
    docs = [(i, t, "en", "src1", len(t or "")) for i, t in [*WORDS.items(), (4, "x y x"), (5, "  "), (None, "null id null")]]
    events = [(i * 5, start + timedelta(days=4 * i), i, "click", 10.0 * i) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{root}/events.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def moves_text(df):
    """Whether a column of whole texts is handed on anywhere in the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.search(r"Project \[([^\n]*, )?text#\d+[,\]]", plan) is not None


def test_texts_do_not_go_through_the_joins(spark, tables):
    assert moves_text(items(spark, tables).select("seq", "raw_text"))
    assert not moves_text(items(spark, tables).select("seq", "title"))
    assert not moves_text(identified(spark, tables).select("uid", "seq", "source_id", "title", "url", "published_at", "category"))
    assert not moves_text(unique_items(spark, tables, "gist", "n", "title"))


def test_columns_made_of_texts(spark, tables):
    got = {r["seq"]: (r["title"], r["raw_text"]) for r in items(spark, tables).filter("seq < 4").collect()}
    assert got == {0: ("One two", "One two. Rest"), 1: ("No full stop", "No full stop"), 2: (None, None), 3: ("", ". starts with it")}
    made = {r["seq"]: (r["gist"], r["n"]) for r in unique_items(spark, tables, "gist", "n").filter("seq < 4").collect()}
    assert made == {0: ("Rest", 13), 1: ("", 12), 2: (None, None), 3: ("starts with it", 16)}


def test_inverted_texts_are_dealt_once_and_words_not_at_all(spark, tables):
    df = QUERIES["inverted_text_rebuild"](spark, tables)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    # Copies of an id share one index, where the later entry has a claimed position.
    assert got == {0: "† two. Rest", 1: "† full stop", 3: "† starts with it", 4: "† y x", None: "† id null"}


@pytest.mark.parametrize("name", ["similar_to_kept", "seen_log_append", "seen_log_buckets", "published_log_append"])
def test_items_are_joined_once(spark, tables, name, monkeypatch):
    """What the query works on is written down first: its joins are planned in one table only."""
    import suite.joins
    import suite.similarity

    joined = []
    for module in (suite.joins, suite.similarity):
        real = module.materialize

        def noted(df, label, real=real):
            joined.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join")))
            return real(df, label)

        monkeypatch.setattr(module, "materialize", noted)
    QUERIES[name](spark, tables).collect()
    assert [n > 0 for label, n in joined if label in ("headlines", "seen-items", "published-items")] == [True]
