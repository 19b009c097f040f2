"""Grouped reports and the evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import aggregates as ag
from newsloom.operators import gates, joins
from newsloom.plans import evaluation as ev
from newsloom.schema import CATEGORIES
from suite.registry import query
from suite.tables import ITEMS, ITEMS_UID, LEDGER, LEDGER_COLUMNS, REGISTRY, UNIQUE, identified, items, registry, score_ledger, table, unique_items


@query(
    "dedupe_newest",
    f"WITH {UNIQUE} SELECT uid, seq, title, published_at, relevance FROM uniq",
)
def _dedupe(spark, sf):
    rows = identified(spark, sf).select("uid", "seq", "title", "published_at", "relevance")
    return ag.dedupe_newest(rows)


def _volume_sql(source, outlet, when):
    return f"""now AS (SELECT max({when}) AS n FROM {source}),
    aged AS (SELECT {outlet} AS outlet, CAST(floor((epoch_us(n) - epoch_us({when})) / 86400000000.0) AS INT) AS age FROM {source}, now)
    SELECT coalesce(outlet, 'ALL') AS outlet, count(*) FILTER (age <= 7) AS d7, count(*) FILTER (age <= 14) AS d14,
      count(*) FILTER (age <= 30) AS d30, count(*) AS total, min(age) AS newest_age
    FROM aged GROUP BY ROLLUP (outlet)"""


@query("volume_by_outlet", f"WITH {ITEMS}, " + _volume_sql("items_raw", "source_name", "published_at"))
def _volume(spark, sf):
    rows = items(spark, sf).select("source_name", "published_at")
    return ag.volume_report(rows, "source_name", "published_at", gates.newest(rows))


@query("volume_by_event_type", "WITH " + _volume_sql("events", "event_type", "ts"))
def _volume_events(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "ts")
    return ag.volume_report(rows, "event_type", "ts", gates.newest(rows, "ts"))


@query("outlets_sorted", f"WITH {ITEMS} SELECT source_name, count(*) AS n FROM items_raw GROUP BY 1")
def _outlets(spark, sf):
    return ag.outlets(items(spark, sf))


_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(CATEGORIES)) + " ELSE 7 END"


@query(
    "categories_present",
    f"WITH {ITEMS} SELECT DISTINCT category, {_ORDER} AS section_order FROM items_raw WHERE category IS NOT NULL",
)
def _categories(spark, sf):
    return ag.categories_present(items(spark, sf))


@query(
    "section_counts",
    f"WITH {ITEMS} SELECT coalesce(category, 'Elsewhere') AS section, {_ORDER} AS section_order, count(*) AS n FROM items_raw GROUP BY ALL",
)
def _sections(spark, sf):
    from newsloom.operators.ranking import sectioned

    return sectioned(items(spark, sf).select("category")).groupBy("section", "section_order").agg(F.count("*").alias("n"))


@query(
    "sender_audit",
    """WITH m AS (SELECT lower(role) AS sender FROM conversations UNION ALL SELECT 'user' || user_id FROM events)
    SELECT sender, count(*) AS messages, sender IN ('user', 'system') AS allowed FROM m GROUP BY sender""",
)
def _senders(spark, sf):
    talk = table(spark, sf, "conversations")
    mail = talk.select(F.col("role").alias("sender")).unionByName(
        table(spark, sf, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("sender"))
    )
    return ag.sender_audit(mail, talk.filter("role <> 'assistant'").select(F.upper("role").alias("sender")))


@query(
    "batch_audit",
    f"""WITH {UNIQUE}, req AS (SELECT source_id AS batch_id, uid FROM uniq),
    ret AS (SELECT source_id AS batch_id, uid FROM uniq WHERE lang <> 'de' AND category IS NOT NULL
      UNION ALL SELECT source_id, 'x' || substr(uid, 2) FROM uniq WHERE lang = 'es'
      UNION ALL SELECT DISTINCT source_id, NULL FROM uniq WHERE lang = 'fr' AND relevance = 1.0)
    SELECT coalesce(q.batch_id, r.batch_id) AS batch_id, count(*) FILTER (q.uid IS NOT NULL AND r.uid IS NOT NULL) AS known,
      count(*) FILTER (q.uid IS NULL AND r.uid IS NOT NULL) AS unknown, count(*) FILTER (q.uid IS NOT NULL AND r.uid IS NULL) AS omitted,
      max(CASE WHEN r.batch_id IS NOT NULL AND r.uid IS NULL THEN 1 ELSE 0 END) AS failed
    FROM req q FULL JOIN ret r ON q.batch_id = r.batch_id AND q.uid = r.uid GROUP BY 1""",
)
def _batches(spark, sf):
    rows = unique_items(spark, sf, "source_id", "lang", "category", "relevance")
    asked = rows.select(F.col("source_id").alias("batch_id"), "uid")
    good = rows.filter((F.col("lang") != "de") & F.col("category").isNotNull()).select(F.col("source_id").alias("batch_id"), "uid")
    invented = rows.filter("lang = 'es'").select(
        F.col("source_id").alias("batch_id"), F.concat(F.lit("x"), F.substring("uid", 2, 15)).alias("uid")
    )
    failed = (
        rows.filter("lang = 'fr' AND relevance = 1.0").select(F.col("source_id").alias("batch_id")).distinct()
        .withColumn("uid", F.lit(None).cast("string"))
    )
    return ag.batch_audit(asked, good.unionByName(invented).unionByName(failed))


@query(
    "usage_cost",
    """WITH u AS (SELECT event_type AS stage, CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unlisted' END AS model,
      CAST(floor(value * 100) AS BIGINT) AS i, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS o,
      CASE WHEN event_type = 'view' THEN CAST(floor(value * 10) AS BIGINT) END AS w,
      CASE WHEN event_type <> 'view' THEN CAST(floor(value * 50) AS BIGINT) END AS r FROM events),
    c AS (SELECT *, CASE model WHEN 'small' THEN 1.0 WHEN 'large' THEN 5.0 ELSE 0.0 END AS pi,
      CASE model WHEN 'small' THEN 5.0 WHEN 'large' THEN 25.0 ELSE 0.0 END AS po FROM u)
    SELECT coalesce(stage, 'total') AS stage, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens,
      CAST(coalesce(sum(w), 0) AS BIGINT) AS cache_write_tokens, CAST(coalesce(sum(r), 0) AS BIGINT) AS cache_read_tokens,
      round(sum((i * pi + coalesce(w, 0) * pi * 1.25 + coalesce(r, 0) * pi * 0.1 + coalesce(o, 0) * po) / 1000000.0), 6) AS cost_usd,
      round(coalesce(sum(r), 0) / (sum(i) + coalesce(sum(w), 0) + coalesce(sum(r), 0)), 6) AS cache_hit_rate
    FROM c GROUP BY ROLLUP (stage)""",
)
def _usage(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "small").when(F.col("user_id") % 3 == 1, "large").otherwise("unlisted")

    def whole(c):
        return F.floor(c).cast("bigint")

    usage = e.select(
        F.col("event_type").alias("stage"),
        kind.alias("model"),
        whole(F.col("value") * 100).alias("input_tokens"),
        F.when(F.col("event_type") != "error", whole(F.col("value"))).alias("output_tokens"),
        F.when(F.col("event_type") == "view", whole(F.col("value") * 10)).alias("cache_write_tokens"),
        F.when(F.col("event_type") != "view", whole(F.col("value") * 50)).alias("cache_read_tokens"),
    )
    prices = spark.createDataFrame(
        [("small", 1.0, 5.0), ("large", 5.0, 25.0)], "model string, input_price double, output_price double"
    )
    return ag.usage_cost(usage, prices).withColumns(
        {"cost_usd": F.round("cost_usd", 6), "cache_hit_rate": F.round("cache_hit_rate", 6)}
    )


def labelled(spark, sf):
    # Labels, ledger and items come from one base, so that their common shuffle is run once.
    rows = unique_items(spark, sf, "bucket", "title", "source_id", *LEDGER_COLUMNS)
    labels = rows.filter("bucket IS NOT NULL").select("uid", "bucket")
    return joins.labelled_scores(labels, joins.score_version(score_ledger(spark, sf, rows), "p1", "m"), rows)


LABELLED = f"""{LEDGER}, v AS (SELECT uid, relevance FROM ledger WHERE prompt_hash = 'p1'),
lab AS (SELECT u.seq, u.uid, u.source_id, u.title, u.bucket, v.relevance FROM uniq u LEFT JOIN v ON v.uid = u.uid WHERE u.bucket IS NOT NULL),
cls AS (SELECT *, CASE WHEN relevance IS NULL THEN 'unscored' WHEN bucket = 'borderline' THEN 'borderline'
  WHEN bucket = 'lead' AND relevance < 0.45 THEN 'lead_missed' WHEN bucket = 'drop' AND relevance >= 0.45 THEN 'drop_admitted'
  WHEN bucket = 'include' AND relevance < 0.45 THEN 'include_below' ELSE 'agreed' END AS outcome FROM lab)"""


@query("errors_by_source", f"WITH {LABELLED} SELECT source_id, count(*) AS errors FROM cls WHERE outcome IN ('lead_missed', 'drop_admitted') GROUP BY 1")
def _errors(spark, sf):
    return ev.errors_by_source(labelled(spark, sf)).orderBy(F.col("errors").desc(), "source_id")


@query("outcome_classes", f"WITH {LABELLED} SELECT outcome, count(*) AS n FROM cls GROUP BY 1")
def _outcomes(spark, sf):
    return ev.outcome_counts(labelled(spark, sf))


PRECISION = """top AS (SELECT bucket, row_number() OVER (ORDER BY relevance DESC, seq) AS r FROM lab WHERE relevance IS NOT NULL),
prec AS (SELECT k, count(*) FILTER (bucket IN ('lead', 'include')) AS hits, count(*) AS considered
  FROM top, (VALUES (10), (20), (100)) d(k) WHERE r <= k GROUP BY k)"""


@query("precision_at_k", f"WITH {LABELLED}, {PRECISION} SELECT k, hits, considered, hits / considered AS precision FROM prec")
def _precision(spark, sf):
    return ev.precision_at(labelled(spark, sf), (10, 20, 100))


SPEARMAN = """lv AS (SELECT relevance AS x, list_position(['drop', 'borderline', 'include', 'lead'], bucket) AS y FROM lab WHERE relevance IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM lv)"""


@query("spearman_agreement", f"WITH {LABELLED}, {SPEARMAN} SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk")
def _spearman(spark, sf):
    return ev.agreement(labelled(spark, sf)).withColumn("rho", F.round("rho", 6))


@query(
    "spearman_events",
    """WITH rk AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rx,
      rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS ry FROM events)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk""",
)
def _spearman_events(spark, sf):
    return ag.spearman(table(spark, sf, "events"), "value", "user_id").withColumn("rho", F.round("rho", 6))


@query(
    "tie_averaged_rank",
    """SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS value_rank FROM events""",
)
def _ranks(spark, sf):
    return ag.average_rank(table(spark, sf, "events").select("event_id", "value"), "value", "value_rank").select(
        "event_id", "value_rank"
    )


@query(
    "source_liveness",
    f"""WITH {ITEMS}, {REGISTRY}, now AS (SELECT max(published_at) AS n FROM items_raw),
    e AS (SELECT source_id, published_at - to_days(CAST(replace(source_id, 'src', '') AS INT) * 5) AS p, category FROM items_raw),
    f AS (SELECT source_id, count(*) AS entries, max(CASE WHEN source_id <> 'src7' THEN p END) AS newest FROM e GROUP BY 1),
    j AS (SELECT r.source_id, coalesce(entries, 0) AS entries, CAST(floor((epoch_us(n) - epoch_us(newest)) / 86400000000.0) AS INT) AS newest_age
      FROM (SELECT DISTINCT source_id FROM registry) r LEFT JOIN f USING (source_id), now)
    SELECT *, CASE WHEN entries = 0 THEN 'empty' WHEN newest_age <= 60 THEN 'ok' ELSE 'stale' END AS verdict FROM j""",
)
def _liveness(spark, sf):
    rows = items(spark, sf)
    return ag.liveness(registry(spark, sf).select("source_id").distinct(), aged_entries(rows), gates.newest(rows))


def aged_entries(rows):
    """Entries of source k are 5k days older than the items; source 7 carries no dates."""
    back = F.make_dt_interval(days=(F.regexp_extract("source_id", r"\d+", 0).cast("int") * 5))
    return rows.select(
        "source_id", F.when(F.col("source_id") != "src7", F.col("published_at") - back).alias("published_at")
    )


@query(
    "admission_rate",
    f"""WITH {ITEMS_UID} SELECT coalesce(source_id, 'ALL') AS source_id, count(*) FILTER (bucket IN ('lead', 'include')) AS admitted,
      count(*) AS judged, count(*) FILTER (bucket IN ('lead', 'include')) / count(*) AS rate
    FROM items WHERE bucket <> 'borderline' GROUP BY ROLLUP (source_id)""",
)
def _admission(spark, sf):
    return ev.admission_rates(items(spark, sf))


@query(
    "score_histogram",
    f"""WITH {LEDGER} SELECT round(CASE WHEN (relevance * 10) - floor(relevance * 10) = 0.5 AND floor(relevance * 10) % 2 = 0
      THEN floor(relevance * 10) / 10 ELSE round(relevance, 1) END, 1) AS bin, count(*) AS n, count(*) FILTER (relevance = 0) AS exact_zeros
    FROM ledger GROUP BY 1""",
)
def _histogram(spark, sf):
    return ev.score_histogram(score_ledger(spark, sf))


@query(
    "error_lists",
    f"""WITH {LABELLED} SELECT outcome, seq, title, relevance FROM cls WHERE outcome IN ('lead_missed', 'drop_admitted', 'include_below')""",
)
def _error_lists(spark, sf):
    rows = labelled(spark, sf)
    kind = ev.outcome(F.col("bucket"), F.col("relevance"))
    wrong = rows.withColumn("outcome", kind).filter(F.col("outcome").isin("lead_missed", "drop_admitted", "include_below"))
    # Buried leads lowest score first, admitted drops highest first.
    key = F.when(F.col("outcome") == "drop_admitted", -F.col("relevance")).otherwise(F.col("relevance"))
    return wrong.orderBy("outcome", key, "seq").select("outcome", "seq", "title", "relevance")


@query(
    "evaluation_report",
    f"""WITH {LABELLED}, {PRECISION}, {SPEARMAN} SELECT 'n_' || outcome AS metric, CAST(count(*) AS DOUBLE) AS value FROM cls GROUP BY 1
    UNION ALL SELECT 'precision_at_' || k, hits / considered FROM prec WHERE k <= 20
    UNION ALL SELECT 'scored', count(*) FROM lv UNION ALL SELECT 'rho', round(corr(rx, ry), 6) FROM rk""",
)
def _report(spark, sf):
    return ev.report(labelled(spark, sf)).withColumn("value", F.round("value", 12)).withColumn(
        "value", F.when(F.col("metric") == "rho", F.round("value", 6)).otherwise(F.col("value"))
    )
