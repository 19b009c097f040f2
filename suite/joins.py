"""History, scores, allowlists and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import gates, joins
from newsloom.session import materialize, scratch_path
from newsloom.sinks import buckets, ledgers
from newsloom.sources import forms
from suite.registry import query
from suite.tables import (
    ENTITIES,
    ITEMS_UID,
    LEDGER,
    LEDGER_COLUMNS,
    REGISTRY,
    UNIQUE,
    entities,
    identified,
    items,
    registry,
    score_ledger,
    table,
    unique_items,
)

# History splits the fixture in time: what came before the last week was seen in earlier runs.
CUT = "(SELECT max(published_at) - INTERVAL 7 DAY FROM items)"


def cut(rows):
    return gates.newest(rows) - F.expr("INTERVAL 7 DAYS")


def history(rows):
    return rows.filter(F.col("published_at") < cut(rows))


@query(
    "unseen_items",
    f"""WITH {ITEMS_UID} SELECT seq, uid FROM items i WHERE published_at >= {CUT}
    AND NOT EXISTS (SELECT 1 FROM items s WHERE s.uid = i.uid AND s.published_at < {CUT})""",
)
def _unseen(spark, sf):
    rows = identified(spark, sf).select("seq", "uid", "published_at")
    now = rows.filter(F.col("published_at") >= cut(rows))
    return joins.unseen(now, history(rows)).select("seq", "uid")


@query(
    "published_picks",
    f"""WITH {ITEMS_UID}, pub AS (SELECT DISTINCT uid FROM items WHERE published_at < {CUT} AND category IS NOT NULL
      AND is_promo = 0 AND relevance >= 0.45)
    SELECT seq, i.uid, pub.uid IS NOT NULL AS already_published FROM items i LEFT JOIN pub ON pub.uid = i.uid
    WHERE bucket = 'lead'""",
)
def _published(spark, sf):
    rows = identified(spark, sf)
    done = history(rows).filter(gates.publishable())
    return joins.split_published(rows.filter("bucket = 'lead'"), done).select("seq", "uid", "already_published")


COMMUNITY = "SELECT DISTINCT source_id FROM registry WHERE community OR type IN ('youtube','youtube_api','xenforo','reddit')"

_GIST = r"""regexp_replace(l.gist, '^\s+|\s+$', '', 'g')"""
APPLIED = f"""applied AS (
  SELECT u.seq, u.uid, CASE WHEN c.source_id IS NOT NULL THEN 'Community' ELSE l.category END AS category,
    CAST(format('{{:.2f}}', l.relevance) AS DOUBLE) AS relevance,
    CASE WHEN {_GIST} <> '' AND len(string_split_regex({_GIST}, '\\s+')) <= 40 THEN {_GIST} END AS gist
  FROM uniq u JOIN ledger l ON l.uid = u.uid AND l.prompt_hash = 'p2'
  LEFT JOIN ({COMMUNITY}) c ON c.source_id = u.source_id
  WHERE l.category IS NOT NULL AND l.is_promo = 0 AND l.relevance >= 0.45)"""


def community(spark, sf):
    r = registry(spark, sf)
    return r.filter(gates.is_community(F.col("type"), F.col("community"))).select("source_id")


@query(
    "apply_scores",
    f"WITH {LEDGER}, {REGISTRY}, {APPLIED} SELECT seq, category, relevance, gist FROM applied",
)
def _apply(spark, sf):
    scores = joins.score_version(score_ledger(spark, sf), "p2", "m")
    out = joins.apply_scores(unique_items(spark, sf, "source_id"), scores, community(spark, sf))
    return out.select("seq", "category", "relevance", "gist")


@query(
    "apply_scores_keep_unscored",
    f"""WITH {LEDGER}, {REGISTRY}, {APPLIED} SELECT u.seq, coalesce(a.category, CASE WHEN a.seq IS NULL THEN u.category END) AS category,
      a.relevance, a.gist FROM uniq u LEFT JOIN applied a ON a.seq = u.seq
      WHERE a.seq IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ledger l WHERE l.uid = u.uid AND l.prompt_hash = 'p2')""",
)
def _apply_all(spark, sf):
    scores = joins.score_version(score_ledger(spark, sf), "p2", "m")
    out = joins.apply_scores(
        unique_items(spark, sf, "source_id", "category"), scores, community(spark, sf), keep_unscored=True
    )
    return out.select("seq", "category", "relevance", "gist")


@query(
    "community_override",
    f"""WITH {UNIQUE}, {REGISTRY} SELECT seq, CASE WHEN source_id IN ({COMMUNITY}) THEN 'Community' ELSE category END AS category FROM uniq""",
)
def _community(spark, sf):
    flags = community(spark, sf).distinct().withColumn("c", F.lit(True))
    return unique_items(spark, sf, "source_id", "category").join(flags, "source_id", "left").select(
        "seq", F.when(F.col("c"), "Community").otherwise(F.col("category")).alias("category")
    )


@query(
    "sender_allowlist",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END AS sender FROM conversations)
    SELECT conv_id, turn, sender FROM m WHERE lower(sender) IN ('user', 'system')""",
)
def _allow(spark, sf):
    role = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role"))
    m = table(spark, sf, "conversations").select("conv_id", "turn", role.alias("sender"))
    allow = m.filter(F.lower("sender") != "assistant").select("sender")
    return joins.allowed_senders(m, allow)


@query(
    "duration_lookup",
    """SELECT e.event_id, CASE WHEN event_type = 'click' THEN floor(value)::BIGINT END AS duration_s FROM events e""",
)
def _lookup(spark, sf):
    from newsloom.functions.text import duration_seconds
    from suite.filters import durations

    known = durations(spark, sf).filter(F.col("iso").rlike(r"^PT\d+S$")).select(
        "event_id", duration_seconds(F.col("iso")).alias("duration_s")
    )
    return joins.with_durations(table(spark, sf, "events").select("event_id"), known, "event_id")


@query(
    "label_score_join",
    f"""WITH {LEDGER}, v AS (SELECT uid, relevance FROM ledger WHERE prompt_hash = 'p1')
    SELECT u.seq, u.uid, u.source_id, u.bucket, v.relevance FROM uniq u LEFT JOIN v ON v.uid = u.uid WHERE u.bucket IS NOT NULL""",
)
def _labels(spark, sf):
    rows = unique_items(spark, sf, "bucket", "title", "source_id", *LEDGER_COLUMNS)
    labels = rows.filter("bucket IS NOT NULL").select("uid", "bucket")
    scores = joins.score_version(score_ledger(spark, sf, rows), "p1", "m")
    return joins.labelled_scores(labels, scores, rows).select("seq", "uid", "source_id", "bucket", "relevance")


@query(
    "missing_verdicts",
    f"""WITH {LEDGER} SELECT uid, bucket FROM uniq u WHERE bucket IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.uid = u.uid AND l.prompt_hash = 'p1')""",
)
def _missing(spark, sf):
    labels = unique_items(spark, sf, "bucket").filter("bucket IS NOT NULL").select("uid", "bucket")
    return joins.missing_verdicts(labels, joins.score_version(score_ledger(spark, sf), "p1", "m"))


@query(
    "score_version_read",
    f"WITH {LEDGER} SELECT uid, relevance, category, is_promo FROM ledger WHERE prompt_hash = 'p2' AND model = 'm'",
)
def _version(spark, sf):
    return joins.score_version(score_ledger(spark, sf), "p2", "m").select("uid", "relevance", "category", "is_promo")


@query(
    "score_drift",
    f"""WITH {LEDGER}, a AS (SELECT uid, relevance AS old_relevance FROM ledger WHERE prompt_hash = 'p1'),
    b AS (SELECT uid, relevance AS new_relevance FROM ledger WHERE prompt_hash = 'p2')
    SELECT uid, old_relevance, new_relevance, CASE WHEN new_relevance IS NULL THEN 'dropped' WHEN old_relevance IS NULL THEN 'added'
      WHEN old_relevance >= 0.45 AND new_relevance < 0.45 THEN 'demoted'
      WHEN old_relevance < 0.45 AND new_relevance >= 0.45 THEN 'promoted' ELSE 'steady' END AS change
    FROM a FULL JOIN b USING (uid)""",
)
def _drift(spark, sf):
    ledger = score_ledger(spark, sf)
    return joins.score_drift(joins.score_version(ledger, "p1", "m"), joins.score_version(ledger, "p2", "m"))


@query(
    "hierarchy_orphans",
    f"WITH {ENTITIES} SELECT entity_id, parent FROM entities WHERE parent IS NOT NULL AND parent NOT IN (SELECT entity_id FROM entities)",
)
def _orphans(spark, sf):
    return joins.orphans(entities(spark, sf)).select("entity_id", "parent")


@query(
    "label_load",
    f"""WITH {UNIQUE}, raw AS (SELECT uid, CASE WHEN lang = 'es' THEN ' ' || upper(bucket) || ' ' WHEN lang = 'fr' THEN bucket || '?' ELSE bucket END AS b,
       published_at FROM uniq WHERE bucket IS NOT NULL)
    SELECT uid, lower(trim(b)) AS bucket, CASE WHEN lower(trim(b)) NOT IN ('lead','include','borderline','drop') THEN 'unknown bucket'
      WHEN published_at < (SELECT max(published_at) - INTERVAL 7 DAY FROM uniq) THEN 'labelled but not in the item set' END AS problem FROM raw""",
)
def _load(spark, sf):
    rows = unique_items(spark, sf, "bucket", "lang")
    spelled = (
        F.when(F.col("lang") == "es", F.concat(F.lit(" "), F.upper("bucket"), F.lit(" ")))
        .when(F.col("lang") == "fr", F.concat("bucket", F.lit("?")))
        .otherwise(F.col("bucket"))
    )
    raw = rows.filter("bucket IS NOT NULL").select("uid", spelled.alias("bucket"))
    return forms.load_labels(raw, rows.filter(F.col("published_at") >= cut(rows)))


@query(
    "registry_duplicates",
    f"WITH {REGISTRY} SELECT source_id, count(*) AS copies FROM registry WHERE enabled GROUP BY 1 HAVING count(*) > 1 "
    f"UNION ALL SELECT 'disabled', count(*) FROM registry WHERE NOT enabled",
)
def _registry(spark, sf):
    r = registry(spark, sf)
    off = r.filter(~F.col("enabled")).agg(F.lit("disabled").alias("source_id"), F.count("*").alias("copies"))
    return forms.registry_problems(forms.enabled_sources(r)).unionByName(off)


@query(
    "query_window",
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT CAST(max(ts) AS DATE) - 21 FROM events)",
)
def _window(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return e.filter(F.col("ts") >= forms.query_window(gates.newest(e, "ts")))


SEEN = ["uid", "seq", "source_id", "title", "url", "published_at", "category"]


@query(
    "seen_log_read",
    f"WITH {UNIQUE} SELECT {', '.join(SEEN)} FROM uniq",
)
def _seen_read(spark, sf):
    path = scratch_path(spark, "seen")
    ledgers.append_new(unique_items(spark, sf, *SEEN).select(SEEN), path, "run-1")
    return spark.read.schema("uid string, seq long, source_id string, title string, url string, "
                             "published_at timestamp_ntz, category string").parquet(path).select(SEEN)


@query(
    "seen_log_append",
    f"""WITH {ITEMS_UID}, old AS (SELECT uid, min(seq) AS seq FROM items WHERE published_at < {CUT} GROUP BY uid),
    fresh AS (SELECT uid, min(seq) AS seq FROM items WHERE published_at >= {CUT} AND uid NOT IN (SELECT uid FROM old) GROUP BY uid)
    SELECT 'run-1' AS run, uid, seq FROM old UNION ALL SELECT 'run-2', uid, seq FROM fresh""",
)
def _append(spark, sf):
    path = scratch_path(spark, "seen")
    rows = materialize(identified(spark, sf).select(SEEN), "seen-items")
    first = ledgers.append_new(history(rows), path, "run-1")
    ledgers.append_new(rows.filter(F.col("published_at") >= cut(rows)), path, "run-2")
    second = ledgers.append_new(rows.filter(F.col("published_at") >= cut(rows)), path, "run-2")
    return first.unionByName(second).select("run", "uid", "seq")


@query(
    "score_ledger_upsert",
    f"""WITH {LEDGER} SELECT uid, prompt_hash, model, CASE WHEN prompt_hash = 'p1' AND uid IN (SELECT uid FROM uniq WHERE lang = 'fr')
      THEN 1 - relevance ELSE relevance END AS relevance, category FROM ledger""",
)
def _upsert(spark, sf):
    path = scratch_path(spark, "scores")
    # The second run rescores French items from what the first one stored.
    ledger = ledgers.upsert_scores(score_ledger(spark, sf), path)
    french = unique_items(spark, sf, "lang").filter("lang = 'fr'").select("uid")
    again = (
        joins.score_version(ledger, "p1", "m")
        .join(french, "uid", "left_semi")
        .withColumn("relevance", 1 - F.col("relevance"))
        .withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 1 DAY"))
        .select(ledger.columns)
    )
    return ledgers.upsert_scores(again, path).select("uid", "prompt_hash", "model", "relevance", "category")


@query(
    "published_log_append",
    f"""WITH {ITEMS_UID} SELECT uid, min(seq) AS seq FROM items WHERE category IS NOT NULL AND is_promo = 0 AND relevance >= 0.45 GROUP BY uid""",
)
def _publish(spark, sf):
    path = scratch_path(spark, "published")
    rows = materialize(identified(spark, sf).filter(gates.publishable()).select(SEEN), "published-items")
    ledgers.publish(rows, path, "trial", full_run=False)
    ledgers.publish(rows, path, "full")
    return ledgers.publish(rows, path, "next").select("uid", "seq").unionByName(
        ledgers.publish(rows, path, "full").select("uid", "seq")
    )


@query(
    "archive_replace_date",
    f"""WITH {UNIQUE}, e AS (SELECT CAST(published_at AS DATE) AS issue_date, count(*) AS items, count(DISTINCT source_name) AS outlets FROM uniq GROUP BY 1),
    p AS (SELECT CAST(published_at AS DATE) AS issue_date, count(*) AS items, count(DISTINCT source_name) AS outlets FROM uniq
          WHERE relevance >= 0.45 AND published_at >= (SELECT max(published_at) - INTERVAL 7 DAY FROM uniq) GROUP BY 1)
    SELECT * FROM e WHERE issue_date NOT IN (SELECT issue_date FROM p) UNION ALL SELECT * FROM p""",
)
def _archive(spark, sf):
    path = scratch_path(spark, "archive")
    rows = unique_items(spark, sf, "source_name", "relevance")

    def entries(df):
        return df.groupBy(F.col("published_at").cast("date").alias("issue_date")).agg(
            F.count("*").alias("items"), F.count_distinct("source_name").alias("outlets")
        )

    ledgers.record_archive(entries(rows), path)
    redone = entries(rows.filter((F.col("relevance") >= 0.45) & (F.col("published_at") >= cut(rows))))
    return ledgers.record_archive(redone, path)


@query(
    "replace_by_date",
    f"""WITH {UNIQUE}, e AS (SELECT CAST(published_at AS DATE) AS issue_date, count(*) AS items FROM uniq GROUP BY 1),
    p AS (SELECT CAST(published_at AS DATE) AS issue_date, count(*) AS items FROM uniq WHERE relevance >= 0.95 GROUP BY 1)
    SELECT * FROM e WHERE issue_date NOT IN (SELECT issue_date FROM p) UNION ALL SELECT * FROM p""",
)
def _replace(spark, sf):
    day = F.col("published_at").cast("date").alias("issue_date")
    rows = unique_items(spark, sf, "relevance")
    old = rows.groupBy(day).agg(F.count("*").alias("items"))
    new = rows.filter("relevance >= 0.95").groupBy(day).agg(F.count("*").alias("items"))
    return ledgers.replace_dates(old, new)


@query(
    "quarantine_split",
    f"""WITH {ITEMS_UID} SELECT seq, CASE WHEN category IS NULL THEN 'no section' WHEN is_promo = 1 THEN 'promotion' END AS reject_reason FROM items""",
)
def _quarantine(spark, sf):
    rows = items(spark, sf).select("seq", "category", "is_promo")
    reason = F.when(F.col("category").isNull(), "no section").when(F.col("is_promo") == 1, "promotion")
    good, bad = ledgers.split_rejects(rows, reason, scratch_path(spark, "good"), scratch_path(spark, "bad"))
    return good.select("seq", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("seq", "reject_reason")
    )


@query(
    "picks_before_scored",
    f"""WITH {UNIQUE} SELECT uid, CASE WHEN bucket = 'lead' THEN 0 ELSE 1 END AS priority, title FROM uniq WHERE bucket = 'lead'
    UNION ALL SELECT uid, 1, title FROM uniq WHERE category IS NOT NULL AND is_promo = 0 AND relevance >= 0.45 AND bucket IS DISTINCT FROM 'lead'""",
)
def _picks_first(spark, sf):
    rows = unique_items(spark, sf, "bucket", "title", "relevance", "category", "is_promo")
    picks = rows.filter("bucket = 'lead'").select("uid", "title", F.lit(0).alias("priority"))
    rest = rows.filter(gates.publishable() & ~F.col("bucket").eqNullSafe("lead")).select("uid", "title", "relevance")
    return (
        picks.unionByName(rest.withColumn("priority", F.lit(1)), allowMissingColumns=True)
        .orderBy("priority", F.col("relevance").desc_nulls_last(), "uid")
        .select("uid", "priority", "title")
    )


@query(
    "source_set_difference",
    f"""WITH {REGISTRY} SELECT DISTINCT source_id, 'unregistered' AS side FROM (SELECT source AS source_id FROM documents) d
      WHERE source_id NOT IN (SELECT source_id FROM registry)
    UNION ALL SELECT DISTINCT source_id, 'without documents' FROM registry WHERE source_id NOT IN (SELECT source FROM documents)""",
)
def _difference(spark, sf):
    have = table(spark, sf, "documents").select(F.col("source").alias("source_id")).distinct()
    known = registry(spark, sf).select("source_id").distinct()
    return (
        have.join(known, "source_id", "left_anti").withColumn("side", F.lit("unregistered"))
        .unionByName(known.join(have, "source_id", "left_anti").withColumn("side", F.lit("without documents")))
    )


_UNSEEN_SQL = f"""WITH {ITEMS_UID}, old AS (SELECT uid, min(seq) AS seq FROM items WHERE published_at < {CUT} GROUP BY uid),
    fresh AS (SELECT uid, min(seq) AS seq FROM items WHERE published_at >= {CUT} AND uid NOT IN (SELECT uid FROM old) GROUP BY uid)"""


def small_log(spark, label):
    return buckets.SeenLog(scratch_path(spark, label), buckets=16, bits=1 << 18)


@query("seen_log_buckets", f"{_UNSEEN_SQL} SELECT 'run-1' AS run, uid, seq FROM old UNION ALL SELECT 'run-2', uid, seq FROM fresh")
def _append_buckets(spark, sf):
    log = small_log(spark, "seen-buckets")
    rows = materialize(identified(spark, sf).select(SEEN), "seen-items")
    late = rows.filter(F.col("published_at") >= cut(rows))
    log.append(history(rows), "run-1")
    log.append(late, "run-2")
    log.compact(spark)
    log.append(late, "run-2")
    return log.read(spark, rows.schema).select("run", "uid", "seq")


@query(
    "unseen_items_bitmap",
    f"""WITH {ITEMS_UID} SELECT seq, uid FROM items i WHERE published_at >= {CUT}
    AND NOT EXISTS (SELECT 1 FROM items s WHERE s.uid = i.uid AND s.published_at < {CUT})""",
)
def _unseen_bitmap(spark, sf):
    log = small_log(spark, "seen-bitmap")
    rows = identified(spark, sf).select("uid", "seq", "published_at")
    log.append(history(rows), "run-1")
    return log.unseen(rows.filter(F.col("published_at") >= cut(rows))).select("seq", "uid")


@query(
    "published_log_buckets",
    f"""WITH {ITEMS_UID} SELECT uid, min(seq) AS seq FROM items WHERE category IS NOT NULL AND is_promo = 0 AND relevance >= 0.45 GROUP BY uid""",
)
def _publish_buckets(spark, sf):
    log = small_log(spark, "published-buckets")
    rows = identified(spark, sf).filter(gates.publishable()).select(SEEN)
    log.publish(rows, "trial", full_run=False)
    log.publish(rows, "full")
    log.publish(rows, "next")
    return log.read(spark, rows.schema).select("uid", "seq")


@query(
    "score_ledger_buckets",
    f"""WITH {LEDGER} SELECT uid, prompt_hash, model, CASE WHEN prompt_hash = 'p1' AND uid IN (SELECT uid FROM uniq WHERE lang = 'fr')
      THEN 1 - relevance ELSE relevance END AS relevance, category FROM ledger""",
)
def _upsert_buckets(spark, sf):
    ledger = buckets.ScoreLedger(scratch_path(spark, "score-buckets"), buckets=16)
    first = ledger.upsert(score_ledger(spark, sf))
    french = unique_items(spark, sf, "lang").filter("lang = 'fr'").select("uid")
    again = (
        joins.score_version(first, "p1", "m")
        .join(french, "uid", "left_semi")
        .withColumn("relevance", 1 - F.col("relevance"))
        .withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 1 DAY"))
        .select(first.columns)
    )
    return ledger.upsert(again).select("uid", "prompt_hash", "model", "relevance", "category")
