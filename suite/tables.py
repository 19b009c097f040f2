"""The working tables every query starts from, in Spark and as SQL for the comparison engine.

`items` gives each document a URL, a headline, a publication time, a section, a relevance and,
where labelled, an editor's bucket. Everything derives from the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import TRACKING_PARAMS, canonical_url, item_uid
from newsloom.operators.aggregates import dedupe_newest
from newsloom.schema import BEATS, SOURCE_TYPES, literal_array


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str, **of_text: Column) -> DataFrame:
    """The items; ``of_text`` adds columns made of the document's text.

    What comes from a text is computed before the joins, so that texts are shuffled only for queries that take raw_text.
    """
    d = table(spark, sf, "documents").withColumns(
        {"_title": F.trim(F.split_part("text", F.lit("."), F.lit(1))), **{f"_of_{n}": c for n, c in of_text.items()}}
    )
    e = table(spark, sf, "events").select(
        F.col("event_id"), "ts", "user_id", "event_type", "value"
    )
    l = table(spark, sf, "labels").withColumnRenamed("doc_id", "label_id")
    i = F.col("doc_id")
    site = F.concat(
        F.lit("https://"), F.when(i % 2 == 0, "WWW").otherwise("www"), F.lit("."), F.col("source"),
        F.lit(".example.com/post/"),
        F.when(i % 100 >= 80, i - 80).otherwise(i).cast("string"),
        F.when(i % 3 == 0, "/").otherwise(""),
        F.when(i % 5 == 0, "?utm_source=rss&id=7").when(i % 5 == 1, "?id=7&ref=x#top").otherwise("?id=7"),
    )
    category = (
        F.when(F.col("event_type") == "click", "Community")
        .when(F.col("event_type") == "purchase", "Industry & Products")
        .when(F.col("event_type") == "view", "Husbandry & Science")
        .when(F.col("event_type") == "signup", "Wild Reefs")
    )
    bucket = (
        F.when(F.col("label_id").isNull(), F.lit(None).cast("string"))
        .when(F.col("toxic") == 1, "drop")
        .when((F.col("quality") == 1) & (i % 4 == 0), "lead")
        .when(F.col("quality") == 1, "include")
        .when(i % 2 == 0, "borderline")
        .otherwise("drop")
    )
    outlet = F.concat(F.lit("Outlet "), F.col("source"))
    return (
        d.join(e, F.col("event_id") == F.col("doc_id") * 5)
        .join(l, F.col("label_id") == F.col("doc_id"), "left")
        .select(
            i.alias("seq"),
            F.col("source").alias("source_id"),
            outlet.alias("source_name"),
            "lang",
            site.alias("url"),
            F.col("_title").alias("title"),
            F.col("text").alias("raw_text"),
            F.col("ts").alias("published_at"),
            (F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 3600).cast("decimal(18,6)"))).alias(
                "first_seen_at"
            ),
            F.when(F.col("event_type") == "view", outlet)
            .when(F.col("event_type") != "error", F.concat(F.lit("user"), F.col("user_id").cast("string")))
            .alias("author"),
            category.alias("category"),
            F.when(F.col("value") >= 100, 1.0).otherwise(F.col("value") / 100).alias("relevance"),
            F.when(F.col("toxic") == 1, 1).otherwise(0).alias("is_promo"),
            F.get(literal_array([*BEATS, "Gossip"]), (i % 8).cast("int")).alias("beat"),
            bucket.alias("bucket"),
            *[F.col(f"_of_{n}").alias(n) for n in of_text],
        )
    )


ITEMS = """
items_raw AS (
  SELECT d.doc_id AS seq, d.source AS source_id, 'Outlet ' || d.source AS source_name, d.lang,
    'https://' || CASE WHEN d.doc_id % 2 = 0 THEN 'WWW' ELSE 'www' END || '.' || d.source || '.example.com/post/'
      || CAST(CASE WHEN d.doc_id % 100 >= 80 THEN d.doc_id - 80 ELSE d.doc_id END AS VARCHAR)
      || CASE WHEN d.doc_id % 3 = 0 THEN '/' ELSE '' END
      || CASE WHEN d.doc_id % 5 = 0 THEN '?utm_source=rss&id=7'
              WHEN d.doc_id % 5 = 1 THEN '?id=7&ref=x#top' ELSE '?id=7' END AS url,
    trim(split_part(d.text, '.', 1)) AS title, d.text AS raw_text, e.ts AS published_at,
    e.ts + to_seconds(CAST(round(e.value * 3600) AS BIGINT)) AS first_seen_at,
    CASE WHEN e.event_type = 'view' THEN 'Outlet ' || d.source
         WHEN e.event_type <> 'error' THEN 'user' || CAST(e.user_id AS VARCHAR) END AS author,
    CASE e.event_type WHEN 'click' THEN 'Community' WHEN 'purchase' THEN 'Industry & Products'
         WHEN 'view' THEN 'Husbandry & Science' WHEN 'signup' THEN 'Wild Reefs' END AS category,
    CASE WHEN e.value >= 100 THEN 1.0 ELSE e.value / 100 END AS relevance,
    CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS is_promo,
    (['Ownership','Leadership','Distribution','Product','Safety','Manufacturing','Financial','Gossip'])[CAST(d.doc_id % 8 AS INT) + 1] AS beat,
    CASE WHEN l.doc_id IS NULL THEN NULL
         WHEN l.toxic = 1 THEN 'drop'
         WHEN l.quality = 1 AND d.doc_id % 4 = 0 THEN 'lead'
         WHEN l.quality = 1 THEN 'include'
         WHEN d.doc_id % 2 = 0 THEN 'borderline' ELSE 'drop' END AS bucket
  FROM documents d JOIN events e ON e.event_id = d.doc_id * 5 LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_TRACKING = ",".join(f"'{p}'" for p in TRACKING_PARAMS)


def sql_canonical(u: str) -> str:
    def part(n: int) -> str:
        return f"regexp_extract(trim({u}), '{_URL}', {n})"

    def dec(x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    def enc(x: str) -> str:
        return f"replace(url_encode({x}), '%20', '+')"

    key = "split_part(p, '=', 1)"
    value = "regexp_extract(p, '^[^=]*=?(.*)$', 1)"
    query = (
        f"array_to_string(list_transform(list_filter(string_split({part(4)}, '&'), "
        f"lambda p: p <> '' AND lower({dec(key)}) NOT IN ({_TRACKING})), "
        f"lambda p: {enc(dec(key))} || '=' || {enc(dec(value))}), '&')"
    )
    path = f"rtrim({part(3)}, '/')"
    return (
        f"(lower({part(1)}) || '://' || lower({part(2)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END "
        f"|| CASE WHEN coalesce({query}, '') = '' THEN '' ELSE '?' || {query} END)"
    )


ITEMS_UID = (
    ITEMS
    + f""",
items_url AS (SELECT *, {sql_canonical("url")} AS canonical_url FROM items_raw),
items AS (SELECT *, substr(sha256(canonical_url), 1, 16) AS uid FROM items_url)"""
)

UNIQUE = (
    ITEMS_UID
    + """,
ranked_copies AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY published_at DESC, seq) AS copy_no FROM items),
uniq AS (SELECT * FROM ranked_copies WHERE copy_no = 1)"""
)


def with_uid(df: DataFrame) -> DataFrame:
    return df.withColumn("canonical_url", canonical_url(F.col("url"))).withColumn(
        "uid", item_uid(F.col("canonical_url"))
    )


def identified(spark: SparkSession, sf: str) -> DataFrame:
    return with_uid(items(spark, sf))


def unique_items(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Newest copy per uid, with uid, seq, published_at and the named columns.

    Columns are cut before the copies meet, so texts are shuffled only for queries that use them.
    """
    wanted = ["uid", "seq", "published_at", *[c for c in columns if c not in ("uid", "seq", "published_at")]]
    rows = with_uid(items(spark, sf, gist=second_sentence(F.col("text")), n=F.length("text")))
    return dedupe_newest(rows.select(wanted))


def second_sentence(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("."), F.lit(2)))


LEDGER_COLUMNS = ["lang", "relevance", "category", "is_promo", "gist", "n", "beat"]


def score_ledger(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Verdicts of two scoring prompts. Prompt p1 never judged German items, p2 no Spanish ones."""
    base = unique_items(spark, sf, *LEDGER_COLUMNS) if base is None else base
    p1 = base.filter("lang <> 'de'").select(
        "uid", F.lit("p1").alias("prompt_hash"), F.lit("m").alias("model"), "relevance", "category",
        "is_promo", "gist", "beat", F.col("published_at").alias("scored_at"), "seq",
    )
    p2 = base.filter("lang <> 'es'").select(
        "uid", F.lit("p2").alias("prompt_hash"), F.lit("m").alias("model"),
        F.least(F.round(F.col("n") / 5000, 3), F.lit(1.0)).alias("relevance"), "category",
        "is_promo", "gist", "beat", F.col("published_at").alias("scored_at"), "seq",
    )
    return p1.unionByName(p2)


LEDGER = (
    UNIQUE
    + """,
ledger AS (
  SELECT uid, 'p1' AS prompt_hash, 'm' AS model, relevance, category, is_promo,
         trim(split_part(raw_text, '.', 2)) AS gist, beat, published_at AS scored_at, seq
  FROM uniq WHERE lang <> 'de'
  UNION ALL
  SELECT uid, 'p2', 'm', least(round(length(raw_text) / 5000, 3), 1.0), category, is_promo,
         trim(split_part(raw_text, '.', 2)), beat, published_at, seq
  FROM uniq WHERE lang <> 'es'
)"""
)


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """One registered source per supplier; small ones fold onto shared ids, so ids can repeat."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("src"), F.when(F.col("s_acctbal") < 0, 0).otherwise(F.col("s_suppkey")).cast("string")).alias(
            "source_id"
        ),
        F.col("s_suppkey").alias("supplier"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, F.col("n_name")).alias("section"),
        F.get(literal_array(SOURCE_TYPES), (F.col("s_nationkey") % 9).cast("int")).alias("type"),
        (F.col("s_acctbal") > 9000).alias("community"),
        (F.col("s_acctbal") >= 1000).alias("enabled"),
    )


REGISTRY = """
registry AS (
  SELECT 'src' || CAST(CASE WHEN s_acctbal < 0 THEN 0 ELSE s_suppkey END AS VARCHAR) AS source_id,
    s_suppkey AS supplier, s_name AS name, CASE WHEN s_acctbal > 5000 THEN n_name END AS section,
    (['wordpress','xenforo','youtube','youtube_api','reddit','bluesky','imap','openalex','generic'])[s_nationkey % 9 + 1] AS type,
    s_acctbal > 9000 AS community, s_acctbal >= 1000 AS enabled
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """A forest: customers under suppliers' nations under regions, with some loose ends."""
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.col("c_name").alias("name"),
        F.lit("brand").alias("kind"),
        F.when(
            F.col("c_acctbal") >= 0,
            F.concat(F.lit("s"), (F.col("c_custkey") / 10).cast("bigint").cast("string")),
        ).alias("parent"),
        F.when(F.col("c_acctbal") < -500, F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).alias("ticker"),
    )
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.col("s_name").alias("name"),
        F.lit("manufacturer").alias("kind"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"),
        F.lit(None).cast("string").alias("ticker"),
    )
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"),
        F.col("n_name").alias("name"),
        F.lit("parent").alias("kind"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
        F.lit(None).cast("string").alias("ticker"),
    )
    r = table(spark, sf, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity_id"),
        F.col("r_name").alias("name"),
        F.lit("sponsor").alias("kind"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("ticker"),
    )
    return c.unionByName(s).unionByName(n).unionByName(r)


ENTITIES = """
entities AS (
  SELECT 'c' || c_custkey AS entity_id, c_name AS name, 'brand' AS kind,
         CASE WHEN c_acctbal >= 0 THEN 's' || (c_custkey // 10) END AS parent,
         CASE WHEN c_acctbal < -500 THEN 'T' || c_custkey END AS ticker FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'manufacturer', 'n' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'parent', 'r' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'sponsor', NULL, NULL FROM region
)"""
