"""Whole plans: scoring, the issue build and source health."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import gates, joins
from newsloom.plans import health
from newsloom.plans import issue as iss
from newsloom.plans import run as runs
from newsloom.plans import scoring
from newsloom.session import materialize, scratch_path
from newsloom.sources.feeds import body_problems
from suite.aggregates import aged_entries
from suite.filters import VIDEO_TITLE
from suite.ingest import FOUND, feed_pages
from suite.joins import COMMUNITY, community
from suite.layout import RESOURCE
from suite.registry import query
from suite.similarity import GREEDY
from suite.tables import ITEMS, LEDGER, REGISTRY, UNIQUE, items, registry, score_ledger, unique_items, with_uid


def word_count_scorer():
    """A stand-in scorer: verdicts follow from the payload alone.

    Titles with a digit get no verdict, and the longest ones an invented uid. Made inside a
    function so that it ships to the workers by value.
    """
    import pandas as pd

    def score(batch):
        n = batch["title"].str.len()
        out = pd.DataFrame(
            {
                "uid": batch["uid"],
                "category": ["Events" if k % 2 else "Wild Reefs" for k in n],
                "relevance": (n % 100) / 100.0,
                "is_promo": 0,
                "gist": batch["title"],
                "beat": None,
            }
        )
        out.loc[n > 180, "uid"] = "invented"
        return out[~batch["title"].str.contains("[0-9]")]

    return score


@query(
    "batch_scoring",
    f"""WITH {UNIQUE}, n AS (SELECT *, length(title) AS n, regexp_matches(title, '[0-9]') AS d FROM uniq)
    SELECT uid, n % 100 / 100 AS relevance, CASE WHEN n % 2 = 1 THEN 'Events' ELSE 'Wild Reefs' END AS category, 'scored' AS outcome FROM n WHERE NOT d AND n <= 180
    UNION ALL SELECT 'invented', n % 100 / 100, CASE WHEN n % 2 = 1 THEN 'Events' ELSE 'Wild Reefs' END, 'unknown' FROM n WHERE NOT d AND n > 180
    UNION ALL SELECT uid, NULL, NULL, 'omitted' FROM n WHERE d OR n > 180""",
)
def _score(spark, sf):
    scored = scoring.score(scoring.payload(unique_items(spark, sf, "source_name", "title", "raw_text")), word_count_scorer())
    return scored.select("uid", "relevance", "category", "outcome")


@query(
    "rejected_verdicts",
    f"""WITH {UNIQUE}, n AS (SELECT *, length(title) AS n, regexp_matches(title, '[0-9]') AS d FROM uniq)
    SELECT 'invented' AS uid, 'unknown' AS reject_reason FROM n WHERE NOT d AND n > 180 UNION ALL SELECT uid, 'omitted' FROM n WHERE d OR n > 180""",
)
def _rejected(spark, sf):
    scored = scoring.score(scoring.payload(unique_items(spark, sf, "source_name", "title", "raw_text")), word_count_scorer())
    return scoring.rejected_verdicts(scored).select("uid", "reject_reason")


@query(
    "valid_verdicts",
    f"""WITH {UNIQUE} SELECT uid, length(title) % 100 / 100 AS relevance FROM uniq WHERE NOT regexp_matches(title, '[0-9]') AND length(title) <= 180""",
)
def _valid(spark, sf):
    scored = scoring.score(scoring.payload(unique_items(spark, sf, "source_name", "title", "raw_text")), word_count_scorer())
    return scoring.valid_verdicts(scored).select("uid", "relevance")


# One run: the last week, minus what earlier weeks saw, scored by prompt p1, behind hand picks.
ISSUE_BUILD = f"""{LEDGER}, {REGISTRY},
edge AS (SELECT max(published_at) - INTERVAL 7 DAY AS cut FROM items),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY published_at DESC, seq) AS r FROM items, edge WHERE published_at >= cut) x
  WHERE r = 1 AND uid NOT IN (SELECT uid FROM items, edge WHERE published_at < cut)),
scored AS (SELECT c.seq, c.uid, c.source_name, {VIDEO_TITLE.replace('category', 'c.category').replace('title', 'c.title')} AS title,
    CASE WHEN m.source_id IS NOT NULL THEN 'Community' ELSE l.category END AS category,
    CAST(format('{{:.2f}}', l.relevance) AS DOUBLE) AS relevance,
    false AS is_pick, CASE WHEN l.category <> 'Industry & Products' THEN 'v' || c.uid END AS video_id
  FROM cand c JOIN ledger l ON l.uid = c.uid AND l.prompt_hash = 'p1' LEFT JOIN ({COMMUNITY}) m ON m.source_id = c.source_id
  WHERE l.category IS NOT NULL AND l.is_promo = 0 AND l.relevance >= 0.45),
picks AS (SELECT seq, uid, source_name, {VIDEO_TITLE} AS title, category, CAST(NULL AS DOUBLE) AS relevance, true AS is_pick, CAST(NULL AS VARCHAR) AS video_id
  FROM uniq, edge WHERE bucket = 'lead' AND lang = 'en' AND published_at < cut),
pool AS (SELECT *, row_number() OVER (ORDER BY is_pick DESC, relevance DESC NULLS LAST, seq) AS position FROM (SELECT * FROM scored UNION ALL SELECT * FROM picks) x),
visit AS (SELECT position AS pos, title FROM pool),
{GREEDY},
sim AS (SELECT leader, count(*) AS "similar" FROM verdict WHERE leader IS NOT NULL GROUP BY 1),
iss AS (SELECT p.*, sim."similar", 1 AS issue_date FROM pool p JOIN verdict v ON v.pos = p.position AND v.leader IS NULL LEFT JOIN sim ON sim.leader = p.position),
{RESOURCE.replace('relevance DESC', 'coalesce(relevance, 0) DESC')}"""


@query(
    "issue_build",
    f"""WITH RECURSIVE {ISSUE_BUILD} SELECT CASE WHEN i.seq IN (SELECT seq FROM res) THEN 'Resource' ELSE coalesce(category, 'Elsewhere') END AS section,
      position, seq, title, relevance, "similar" FROM iss i""",
)
def _build(spark, sf):
    from suite.filters import video_titles

    rows = with_uid(video_titles(spark, sf)).withColumn(
        "video_id", F.when(F.col("category") != "Industry & Products", F.concat(F.lit("v"), "uid"))
    )
    rows = rows.select(
        "seq", "uid", "source_id", "source_name", "title", "category", "video_id", "published_at", "bucket", "lang"
    )
    edge = gates.newest(rows) - F.expr("INTERVAL 7 DAYS")
    seen = rows.filter(F.col("published_at") < edge)
    rules = iss.IssueRules()
    fresh = iss.candidates(rows, seen, gates.newest(rows), rules)
    from newsloom.operators.aggregates import dedupe_newest

    picks = (
        dedupe_newest(rows)
        .filter((F.col("bucket") == "lead") & (F.col("lang") == "en") & (F.col("published_at") < edge))
        .select("seq", "uid", "source_id", "source_name", "title", "category")
    )
    scores = joins.score_version(score_ledger(spark, sf), "p1", "m")
    cols = ["seq", "uid", "source_id", "source_name", "title", "category", "video_id"]
    issue = iss.ranked(fresh.select(cols), scores.drop("seq"), community(spark, sf), picks, rules)
    return iss.lay_out(issue).select("section", "position", "seq", "title", "relevance", "similar")


@query(
    "source_health",
    f"""WITH {ITEMS}, {REGISTRY}, {FOUND}, now AS (SELECT max(published_at) AS n FROM items_raw),
    e AS (SELECT source_id, published_at - to_days(CAST(replace(source_id, 'src', '') AS INT) * 5) AS p FROM items_raw),
    f AS (SELECT source_id, count(*) AS entries, max(CASE WHEN source_id <> 'src7' THEN p END) AS newest FROM e GROUP BY 1),
    j AS (SELECT r.source_id, coalesce(entries, 0) AS entries, CAST(floor((epoch_us(n) - epoch_us(newest)) / 86400000000.0) AS INT) AS age
      FROM (SELECT DISTINCT source_id FROM registry) r LEFT JOIN f USING (source_id), now)
    SELECT source_id AS target, CASE WHEN source_id = 'src3' THEN 'error' WHEN entries = 0 THEN 'empty' WHEN age <= 60 THEN 'ok' ELSE 'stale' END AS verdict,
      CASE WHEN source_id = 'src3' THEN 'unparseable feed' WHEN entries = 0 THEN 'has no entries' WHEN age IS NULL THEN 'unknown age' ELSE 'newest ' || age || 'd old' END AS detail, entries FROM j
    UNION ALL SELECT feed_url, 'discovered', 'advertised by ' || count(DISTINCT page_id) || ' page(s)', 0 FROM found WHERE feed_url IS NOT NULL GROUP BY 1
    UNION ALL SELECT url, 'no-feed', note, 0 FROM found JOIN pages USING (page_id) WHERE feed_url IS NULL""",
)
def _health(spark, sf):
    rows = items(spark, sf)
    sources = registry(spark, sf).select("source_id").distinct()
    # One source answers with a page instead of its feed.
    body = F.when(F.col("source_id") == "src3", "<html><body>moved</body></html>").otherwise(
        "<rss><channel><title>t</title><item><title>x</title></item></channel></rss>"
    )
    problems = body_problems(sources.withColumn("body", body), "rss")
    return health.health_report(sources, aged_entries(rows), feed_pages(spark, sf), gates.newest(rows), problems=problems)


# The stored run: what a trial run over the weeks before saw, then this week's run with the scorer.
ISSUE_RUN = ISSUE_BUILD.replace(
    "scored AS (SELECT c.seq",
    f"""payload AS (SELECT uid, {VIDEO_TITLE} AS t FROM cand),
verd AS (SELECT uid, length(t) % 100 / 100 AS relevance, CASE WHEN length(t) % 2 = 1 THEN 'Events' ELSE 'Wild Reefs' END AS category, 0 AS is_promo
  FROM payload WHERE NOT regexp_matches(t, '[0-9]') AND length(t) <= 180),
scored AS (SELECT c.seq""",
).replace("JOIN ledger l ON l.uid = c.uid AND l.prompt_hash = 'p1'", "JOIN verd l ON l.uid = c.uid")


@query(
    "issue_run",
    f"""WITH RECURSIVE {ISSUE_RUN} SELECT CASE WHEN i.seq IN (SELECT seq FROM res) THEN 'Resource' ELSE coalesce(category, 'Elsewhere') END AS section,
      position, seq, title, relevance, "similar" FROM iss i""",
)
def _run(spark, sf):
    from suite.filters import video_titles

    rows = with_uid(video_titles(spark, sf)).withColumn(
        "video_id", F.when(F.col("category") != "Industry & Products", F.concat(F.lit("v"), "uid"))
    )
    # The joins behind the items run once; what follows reads the columns that it needs.
    rows = materialize(rows, "run-items")
    shown = ["seq", "uid", "source_id", "source_name", "title", "category", "video_id", "published_at"]
    newest = gates.newest(rows)
    edge = newest - F.expr("INTERVAL 7 DAYS")
    late, before = rows.filter(F.col("published_at") >= edge), rows.filter(F.col("published_at") < edge)
    from newsloom.operators.aggregates import dedupe_newest

    own = ["seq", "uid", "source_id", "source_name", "title", "category", "published_at"]
    picks = dedupe_newest(rows.select(*own, "bucket", "lang")).filter((F.col("bucket") == "lead") & (F.col("lang") == "en") & (F.col("published_at") < edge))
    now = F.lit(rows.agg(F.max("published_at")).first()[0])
    store = runs.RunStore(scratch_path(spark, "runs"), buckets=8, bits=1 << 18)
    judge = runs.Scoring(word_count_scorer(), "p1", "m")
    landed = [*shown, "raw_text"]
    runs.issue_run(store, "trial", before.select(landed), now, judge, community(spark, sf), full_run=False)
    layout = runs.issue_run(store, "week", late.select(landed), now, judge, community(spark, sf), picks.select(own))
    return layout.select("section", "position", "seq", "title", "relevance", "similar")
