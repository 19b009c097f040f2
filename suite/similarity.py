"""Near-duplicate headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.text import STOPWORDS, with_word_set
from newsloom.operators import similar as sm
from newsloom.session import materialize, scratch_path
from newsloom.sinks.headlines import HeadlineIndex, collapse_next
from suite.registry import query
from suite.tables import ITEMS, items

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

# The greedy loop, one recursion step per item that has earlier neighbours: unless all of those
# are `gone`, the item joins the lowest that is left and is gone itself.
TOKENS = """tok AS (SELECT pos, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'),
  lambda w: length(w) > 2 AND w NOT IN ({stop})))) AS t FROM visit)"""

GREEDY = (
    TOKENS.format(stop=STOP)
    + """,
long AS (SELECT pos, unnest(t) AS w, len(t) AS n FROM tok),
shared AS (SELECT a.pos AS early, b.pos AS late, count(*) / least(any_value(a.n), any_value(b.n)) AS overlap
  FROM long a JOIN long b ON a.w = b.w AND a.pos < b.pos AND b.n >= 3 GROUP BY 1, 2),
near AS (SELECT late, list_sort(list(early)) AS nbrs FROM shared WHERE overlap >= 0.4 GROUP BY 1),
seqd AS (SELECT late AS pos, row_number() OVER (ORDER BY late) AS i, nbrs FROM near),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT s.i, s.pos, list_min(list_filter(s.nbrs, lambda x: NOT list_contains(w.gone, x))),
    CASE WHEN len(list_filter(s.nbrs, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, s.pos) ELSE w.gone END
  FROM walk w JOIN seqd s ON s.i = w.i + 1),
verdict AS (SELECT tok.pos, leader FROM tok LEFT JOIN walk ON walk.pos = tok.pos)"""
)

VISIT = f"{ITEMS}, visit AS (SELECT seq AS pos, title FROM items_raw)"


@query(
    "headline_word_sets",
    f"WITH {VISIT}, {TOKENS.format(stop=STOP)} SELECT pos AS seq, array_to_string(t, ' ') AS words, len(t) AS n FROM tok",
)
def _fingerprints(spark, sf):
    rows = with_word_set(items(spark, sf).select("seq", "title"), "title")
    return rows.select("seq", F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("n"))


@query(
    "similar_to_kept",
    f"""WITH RECURSIVE {VISIT}, {GREEDY} SELECT v.pos AS seq, leader, overlap FROM verdict v
    JOIN shared s ON s.late = v.pos AND s.early = v.leader""",
)
def _pairs(spark, sf):
    rows = materialize(items(spark, sf).select("seq", "title"), "headlines")
    merged = sm.collapse_similar(rows).filter("leader IS NOT NULL")
    sets = materialize(with_word_set(rows, "title").select("seq", "tokens"), "word-sets")
    leaders = sets.select(F.col("seq").alias("leader"), F.col("tokens").alias("leader_tokens"))
    return (
        merged.join(sets, "seq").join(leaders, "leader")
        .select("seq", "leader", sm.overlap(F.col("tokens"), F.col("leader_tokens")).alias("overlap"))
    )


@query(
    "collapse_similar",
    f"WITH RECURSIVE {VISIT}, {GREEDY} SELECT pos AS seq, leader FROM verdict",
)
def _collapse(spark, sf):
    return sm.collapse_similar(items(spark, sf).select("seq", "title"))


@query(
    "collapse_in_batches",
    f"WITH RECURSIVE {VISIT}, {GREEDY} SELECT pos AS seq, leader FROM verdict",
)
def _batches(spark, sf):
    """Two batches against a stored index, the second one twice: as one pass over both."""
    rows = items(spark, sf).select("seq", "title")
    half = rows.agg(F.expr("max(seq) div 2")).first()[0]
    index = HeadlineIndex(scratch_path(spark, "headline-index"), buckets=16)
    first = collapse_next(rows.filter(F.col("seq") <= half), index, "one")
    collapse_next(rows.filter(F.col("seq") > half), index, "two")
    return first.unionByName(collapse_next(rows.filter(F.col("seq") > half), index, "two"))


@query(
    "merge_counts",
    f"WITH RECURSIVE {VISIT}, {GREEDY} SELECT leader AS seq, count(*) AS similar FROM verdict WHERE leader IS NOT NULL GROUP BY 1",
)
def _merged(spark, sf):
    return sm.merge_counts(sm.collapse_similar(items(spark, sf).select("seq", "title")))


@query(
    "token_overlap_with_benchmark",
    """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents),
    w AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)
    SELECT doc_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS share FROM w JOIN v USING (term) GROUP BY doc_id""",
)
def _tokens(spark, sf):
    from newsloom.functions.text import ascii_words
    from suite.tables import table

    words = table(spark, sf, "documents").select("doc_id", F.array_distinct(ascii_words(F.col("text"))).alias("t"))
    terms = table(spark, sf, "benchmark").select(F.explode(ascii_words(F.col("text"))).alias("term")).distinct()
    hits = words.select("doc_id", F.size("t").alias("n"), F.explode("t").alias("term")).join(terms, "term", "left_semi")
    return hits.groupBy("doc_id").agg(
        F.count("*").alias("shared"), F.round(F.count("*") / F.max("n"), 6).alias("share")
    )
