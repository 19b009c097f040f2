"""Ranking inside issues, sections, highlights and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import gates
from newsloom.operators import ranking as rk
from newsloom.plans import issue as iss
from suite.filters import VIDEO_TITLE
from suite.registry import query
from suite.tables import ITEMS_UID, UNIQUE, table, with_uid
from newsloom.operators.aggregates import dedupe_newest


def issue_items(spark, sf):
    """Publishable unique items by issue week; some are videos, some of those hand-picked."""
    from suite.filters import video_titles

    rows = with_uid(video_titles(spark, sf)).select(
        "seq", "uid", "source_id", "source_name", "title", "category", "relevance", "is_promo", "published_at", "bucket"
    )
    rows = dedupe_newest(rows).filter(gates.publishable())
    return rows.select(
        "seq", "uid", "source_id", "source_name", "title", "category", "relevance", "published_at",
        F.date_trunc("week", "published_at").cast("date").alias("issue_date"),
        F.when(F.col("category") != "Industry & Products", F.concat(F.lit("v"), "uid")).alias("video_id"),
        (F.col("bucket").eqNullSafe("lead")).alias("is_pick"),
    )


ISSUE = f"""{UNIQUE},
iss AS (SELECT seq, uid, source_id, source_name, {VIDEO_TITLE} AS title, category, relevance, published_at,
  CAST(date_trunc('week', published_at) AS DATE) AS issue_date,
  CASE WHEN category <> 'Industry & Products' THEN 'v' || uid END AS video_id, bucket IS NOT DISTINCT FROM 'lead' AS is_pick,
  CASE category WHEN 'Community' THEN 1 WHEN 'Industry & Products' THEN 2 WHEN 'Husbandry & Science' THEN 3 WHEN 'Livestock & Corals' THEN 4
       WHEN 'Wild Reefs' THEN 5 WHEN 'Events' THEN 6 ELSE 7 END AS section_order,
  CAST(format('{{:.2f}}', relevance) AS DOUBLE) AS rel2
  FROM uniq WHERE category IS NOT NULL AND is_promo = 0 AND relevance >= 0.45),
pos AS (SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY rel2 DESC, seq) AS position FROM iss)"""

RESOURCE = """res AS (SELECT issue_date, seq, title, video_id FROM (SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY
    CASE WHEN is_pick THEN 2 WHEN regexp_matches(title, '(?i)\\b(how[\\s-]?to|tips?|tricks?|resources?|mistakes?)\\b') THEN 1 ELSE 0 END DESC,
    CAST(format('{:.2f}', relevance) AS DOUBLE) DESC, seq) AS r FROM iss WHERE video_id IS NOT NULL) x WHERE r = 1)"""


def positioned(spark, sf):
    return rk.with_position(issue_items(spark, sf), ["issue_date"], rk.relevance_order())


@query("relevance_order", f"WITH {ISSUE} SELECT issue_date, seq, position FROM pos")
def _order(spark, sf):
    return positioned(spark, sf).select("issue_date", "seq", "position")


@query(
    "keep_first_per_key",
    f"""WITH {ITEMS_UID} SELECT uid, seq, title FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY seq) AS r FROM items) x WHERE r = 1""",
)
def _first(spark, sf):
    from suite.tables import identified

    rows = identified(spark, sf).select("uid", "seq", "title")
    return rk.first_n(rows, ["uid"], [F.col("seq")], 1).drop("position")


@query("resource_slot", f"WITH {ISSUE}, {RESOURCE} SELECT * FROM res")
def _resource(spark, sf):
    return rk.resource_slot(issue_items(spark, sf), ["issue_date"])


@query(
    "highlights",
    f"""WITH {ISSUE}, top AS (SELECT issue_date, string_agg(title, ' // ' ORDER BY position) AS titles FROM pos WHERE position <= 4 GROUP BY 1),
    area AS (SELECT issue_date, lower(category) AS a, count(*) AS n, min(position) AS p FROM pos WHERE position > 4 GROUP BY 1, 2),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY p) AS r FROM area),
    more AS (SELECT issue_date, 'Plus ' || CAST(sum(n) AS BIGINT) || ' more across ' || string_agg(a, ', ' ORDER BY p) FILTER (r <= 3) AS plus FROM numbered GROUP BY 1)
    SELECT issue_date, titles, plus FROM top LEFT JOIN more USING (issue_date)""",
)
def _highlights(spark, sf):
    return rk.highlights(positioned(spark, sf), ["issue_date"]).select(
        "issue_date", F.array_join("titles", " // ").alias("titles"), "plus"
    )


@query(
    "section_lead",
    f"""WITH {ISSUE}, {RESOURCE}, body AS (SELECT * FROM pos WHERE seq NOT IN (SELECT seq FROM res))
    SELECT issue_date, title AS lead FROM (SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY section_order, position) AS r FROM body) x WHERE r = 1""",
)
def _lead(spark, sf):
    rows = positioned(spark, sf)
    body = rk.sectioned(rows, rk.resource_slot(rows, ["issue_date"]))
    return rk.section_lead(body, ["issue_date"])


@query(
    "scoring_batches",
    f"""WITH {UNIQUE} SELECT seq, (row_number() OVER (ORDER BY published_at DESC, seq) - 1) // 20 AS batch_no FROM uniq""",
)
def _batch(spark, sf):
    from suite.tables import unique_items

    rows = unique_items(spark, sf).select("seq", "published_at")
    numbered = rk.with_position(rows, [], [F.col("published_at").desc(), F.col("seq")])
    return numbered.select("seq", F.expr("(position - 1) div 20").alias("batch_no"))


@query(
    "recent_per_sender",
    """SELECT user_id, event_id, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn <= 40""",
)
def _recent(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return rk.first_n(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 40).drop("ts")


@query(
    "issue_sections",
    f"""WITH {ISSUE}, {RESOURCE} SELECT issue_date, category AS section, section_order, position, seq, title FROM pos WHERE seq NOT IN (SELECT seq FROM res)""",
)
def _sections(spark, sf):
    rows = positioned(spark, sf)
    body = rk.sectioned(rows, rk.resource_slot(rows, ["issue_date"]))
    # A range sort: ordered output without a single-task stage.
    return body.select("issue_date", "section", "section_order", "position", "seq", "title").orderBy(
        "issue_date", "section_order", "position"
    )


@query(
    "top_by_score",
    f"WITH {UNIQUE} SELECT seq, uid, relevance FROM uniq WHERE category IS NOT NULL ORDER BY relevance DESC, seq LIMIT 20",
)
def _top(spark, sf):
    from suite.tables import unique_items

    rows = unique_items(spark, sf, "category", "relevance").filter("category IS NOT NULL").select("seq", "uid", "relevance")
    return rows.orderBy(F.col("relevance").desc(), "seq").limit(20)


_LEAD90 = "CASE WHEN length(title) > 90 THEN rtrim(substr(title, 1, 89)) || '…' ELSE title END"


@query(
    "issue_summaries",
    f"""WITH {ISSUE}, c AS (SELECT issue_date, count(*) AS items, count(DISTINCT source_name) AS outlets FROM pos GROUP BY 1),
    l AS (SELECT issue_date, {_LEAD90} AS lead FROM pos WHERE position = 1)
    SELECT issue_date, items, outlets, lead, items || ' item' || CASE WHEN items = 1 THEN '' ELSE 's' END || ' from ' || outlets || ' outlet'
      || CASE WHEN outlets = 1 THEN '' ELSE 's' END || ', led by “' || lead || '”' AS description FROM c JOIN l USING (issue_date)""",
)
def _summaries(spark, sf):
    return iss.summaries(positioned(spark, sf), ["issue_date"])


@query(
    "archive_index",
    f"""WITH {ISSUE}, {RESOURCE}, body AS (SELECT * FROM pos WHERE seq NOT IN (SELECT seq FROM res)),
    l AS (SELECT issue_date, title AS lead FROM (SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY section_order, position) AS r FROM body) x WHERE r = 1),
    c AS (SELECT issue_date, count(*) AS items, count(DISTINCT source_name) AS outlets FROM pos GROUP BY 1)
    SELECT issue_date, items, outlets, coalesce(lead, '') AS lead FROM c LEFT JOIN l USING (issue_date)""",
)
def _archive(spark, sf):
    return iss.archive_entries(positioned(spark, sf), ["issue_date"]).orderBy(F.col("issue_date").desc())
