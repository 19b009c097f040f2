"""Filters, verdicts and text shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import urls as ur
from newsloom.operators import gates
from newsloom.sources import pages as pg
from suite.registry import query
from suite.tables import ITEMS, ITEMS_UID, REGISTRY, identified, items, registry, sql_canonical, table


def lines(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    "canonical_url",
    f"""WITH {ITEMS}
    SELECT 'item' AS origin, seq AS id, {sql_canonical("url")} AS canonical_url FROM items_raw
    UNION ALL SELECT 'page', page_id, {sql_canonical("url")} FROM pages""",
)
def _canonical(spark, sf):
    a = items(spark, sf).select(F.lit("item").alias("origin"), F.col("seq").alias("id"), "url")
    b = table(spark, sf, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), "url")
    return a.unionByName(b).select("origin", "id", ur.canonical_url(F.col("url")).alias("canonical_url"))


@query(
    "item_uid",
    f"""WITH {ITEMS_UID} SELECT seq AS id, uid FROM items
    UNION ALL SELECT -1 - page_id, substr(sha256({sql_canonical("url")}), 1, 16) FROM pages""",
)
def _uid(spark, sf):
    a = identified(spark, sf).select(F.col("seq").alias("id"), "uid")
    b = table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("id"), ur.item_uid(ur.canonical_url(F.col("url"))).alias("uid")
    )
    return a.unionByName(b)


@query(
    "attribution_gate",
    """WITH a AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS url,
                 unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages),
    c AS (SELECT page_id, url, title FROM a
      UNION ALL SELECT page_id, page_url || url, title FROM a)
    SELECT page_id, url, CASE WHEN trim(title) = '' THEN 'missing title'
      WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'unresolvable url' END AS verdict FROM c""",
)
def _attribution(spark, sf):
    pages = table(spark, sf, "pages")
    links = pg.anchors(pages).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    raw = links.select("page_id", F.col("href").alias("url"), "text").unionByName(
        links.select("page_id", F.concat("page_url", "href").alias("url"), "text")
    )
    verdict = gates.attribution_verdict(F.col("text"), F.lit("crawl"), F.col("url"))
    return raw.select("page_id", "url", verdict.alias("verdict"))


@query(
    "recency_window",
    f"""WITH {ITEMS} SELECT seq, published_at FROM items_raw
    WHERE published_at >= (SELECT max(published_at) FROM items_raw) - INTERVAL 7 DAY""",
)
def _recent(spark, sf):
    rows = items(spark, sf).select("seq", "published_at")
    return gates.recent(rows, gates.newest(rows))


GATE_TERMS = [*tx.SUBJECT_TERMS, "which", "avec", "nicht", "this", "para", "from"]


@query(
    "vocabulary_gate",
    f"""SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[a-z]+'), [{lines(GATE_TERMS)}]) AS on_subject
    FROM documents""",
)
def _vocabulary(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.mentions_any(F.col("text"), GATE_TERMS).alias("on_subject"))


@query(
    "vocabulary_table_match",
    """WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),
    words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
    SELECT doc_id, count(*) AS n_terms FROM words JOIN terms USING (term) GROUP BY doc_id""",
)
def _vocabulary_table(spark, sf):
    terms = (
        table(spark, sf, "benchmark").select(F.explode(tx.ascii_words(F.col("text"))).alias("term")).distinct()
    )
    words = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.array_distinct(tx.ascii_words(F.col("text")))).alias("term")
    )
    return words.join(terms, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_terms"))


@query(
    "headline_length_gate",
    f"""WITH {ITEMS} SELECT seq, length(title) AS n FROM items_raw WHERE length(title) BETWEEN 25 AND 180""",
)
def _length(spark, sf):
    rows = items(spark, sf).select("seq", "title").filter(gates.headline_length_ok(F.col("title")))
    return rows.select("seq", F.length("title").alias("n"))


@query(
    "boilerplate_filter",
    f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)
    SELECT id, len(list_filter([{lines(tx.BOILERPLATE)}], lambda p: contains(lower(text), p))) > 0 AS is_boilerplate FROM t""",
)
def _boilerplate(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return a.unionByName(b).select("id", tx.contains_any(F.col("text")).alias("is_boilerplate"))


def durations(spark, sf):
    """ISO durations of the events, some unresolved or malformed."""
    e = table(spark, sf, "events")
    whole = F.floor("value").cast("string")
    cents = (F.round(F.col("value") * 100).cast("bigint") % 60).cast("string")
    iso = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("PT"), whole, F.lit("M"), cents, F.lit("S")))
        .when(F.col("event_type") == "click", F.concat(F.lit("PT"), whole, F.lit("S")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("P1DT"), whole, F.lit("H")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("P"), whole, F.lit("D")))
    )
    return e.select("event_id", iso.alias("iso"))


_DURATIONS = """d AS (SELECT event_id, event_type, CASE event_type
    WHEN 'view' THEN floor(value)::BIGINT * 60 + round(value * 100)::BIGINT % 60
    WHEN 'click' THEN floor(value)::BIGINT
    WHEN 'purchase' THEN 86400 + floor(value)::BIGINT * 3600 END AS duration_s FROM events)"""


@query("duration_parse", f"WITH {_DURATIONS} SELECT event_id, duration_s FROM d")
def _duration(spark, sf):
    return durations(spark, sf).select("event_id", tx.duration_seconds(F.col("iso")).alias("duration_s"))


@query(
    "short_video_filter",
    f"""WITH {_DURATIONS} SELECT e.event_id, duration_s FROM events e LEFT JOIN d USING (event_id)
    WHERE duration_s IS NULL OR duration_s > 180""",
)
def _shorts(spark, sf):
    lengths = durations(spark, sf).select(
        "event_id", tx.duration_seconds(F.col("iso")).alias("duration_s")
    ).filter("duration_s IS NOT NULL")
    videos = table(spark, sf, "events").select("event_id")
    return gates.drop_shorts(videos, lengths, "event_id")


@query(
    "publish_filter",
    f"""WITH {ITEMS} SELECT seq, category, relevance FROM items_raw
    WHERE category IS NOT NULL AND is_promo = 0 AND relevance >= 0.45""",
)
def _publish(spark, sf):
    return items(spark, sf).filter(gates.publishable()).select("seq", "category", "relevance")


# Words as the comparison engine sees them: its whitespace class is ASCII only.
WORDS = r"string_split_regex(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')"


@query(
    "gist_cap",
    f"""WITH g AS (SELECT doc_id, regexp_replace(split_part(text, '.', 2), '^\\s+|\\s+$', '', 'g') AS gist FROM documents)
    SELECT doc_id, CASE WHEN gist <> '' AND len({WORDS.format('gist')}) <= 40 THEN gist END AS gist FROM g""",
)
def _gist(spark, sf):
    second = F.split_part("text", F.lit("."), F.lit(2))
    return table(spark, sf, "documents").select("doc_id", tx.capped_gist(second).alias("gist"))


@query(
    "label_eligibility",
    f"""WITH {ITEMS} SELECT seq, published_at, first_seen_at FROM items_raw
    WHERE epoch(first_seen_at) - epoch(published_at) <= 7 * 86400 ORDER BY published_at DESC""",
)
def _eligible(spark, sf):
    rows = items(spark, sf).select("seq", "published_at", "first_seen_at")
    return gates.label_eligible(rows).orderBy(F.col("published_at").desc(), "seq")


@query(
    "item_cap",
    f"WITH {ITEMS} SELECT seq, published_at FROM items_raw ORDER BY published_at DESC, seq LIMIT 150",
)
def _cap(spark, sf):
    rows = items(spark, sf).select("seq", "published_at")
    return gates.newest_first(rows, 150)


@query(
    "label_sheet_excerpt",
    f"""SELECT doc_id, array_to_string(list_slice({WORDS.format('text')}, 1, 60), ' ')
      || CASE WHEN len({WORDS.format('text')}) > 60 THEN '…' ELSE '' END AS excerpt FROM documents""",
)
def _excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(
    "score_payload",
    f"""WITH {ITEMS_UID} SELECT seq, uid, source_name AS source, title, coalesce(raw_text, '') AS text,
    strftime(published_at, '%Y-%m-%d') AS published FROM items""",
)
def _payload(spark, sf):
    from newsloom.plans.scoring import payload

    rows = identified(spark, sf)
    # One row per uid and payload, so the position joins back on the whole payload row.
    return payload(rows.withColumn("uid", F.concat_ws("|", "uid", F.col("seq").cast("string")))).select(
        F.split_part("uid", F.lit("|"), F.lit(2)).cast("bigint").alias("seq"),
        F.split_part("uid", F.lit("|"), F.lit(1)).alias("uid"),
        "source", "title", "text", "published",
    )


_SHOUT = """CASE WHEN category = 'Community' THEN upper(replace(title, 'ß', 'ss')) ELSE title END"""
_BARE = r"""regexp_replace(w, '^[.,:;!?()\[\]"'']+|[.,:;!?()\[\]"'']+$', '', 'g')"""


@query(
    "headline_recase",
    f"""WITH {ITEMS}, s AS (SELECT seq, {_SHOUT} AS title FROM items_raw),
    m AS (SELECT *, length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) AS letters,
          length(regexp_replace(title, '[^\\p{{Lu}}]', '', 'g')) AS capitals FROM s)
    SELECT seq, CASE WHEN letters >= 12 AND capitals >= letters * 0.7 THEN
      array_to_string(list_transform({WORDS.format('title')}, lambda w, i:
        CASE WHEN upper({_BARE}) IN ({lines(tx.ACRONYMS)}) THEN upper(w)
             WHEN i > 1 AND lower({_BARE}) IN ({lines(tx.MINOR_WORDS)}) THEN lower(w)
             ELSE upper(w[1]) || lower(substr(w, 2)) END), ' ')
      ELSE title END AS title FROM m""",
)
def _recase(spark, sf):
    shouted = F.when(
        F.col("category") == "Community", F.upper(F.replace("title", F.lit("ß"), F.lit("ss")))
    ).otherwise(F.col("title"))
    return items(spark, sf).select("seq", shouted.alias("t")).select("seq", tx.recase(F.col("t")).alias("title"))


def video_titles(spark, sf):
    """Items with a title prefix that does or does not announce instruction."""
    prefix = (
        F.when(F.col("category") == "Community", "How to ")
        .when(F.col("category") == "Wild Reefs", "Multiple ")
        .when(F.col("category") == "Husbandry & Science", "Five TIPS: ")
        .otherwise("")
    )
    return items(spark, sf).withColumn("title", F.concat(prefix, "title"))


VIDEO_TITLE = """CASE category WHEN 'Community' THEN 'How to ' WHEN 'Wild Reefs' THEN 'Multiple '
    WHEN 'Husbandry & Science' THEN 'Five TIPS: ' ELSE '' END || title"""


@query(
    "instructional_titles",
    f"""WITH {ITEMS} SELECT seq, regexp_matches({VIDEO_TITLE},
    '(?i)\\b(how[\\s-]?to|tips?|tricks?|resources?|mistakes?)\\b') AS instructional FROM items_raw""",
)
def _instructional(spark, sf):
    return video_titles(spark, sf).select("seq", tx.is_instructional(F.col("title")).alias("instructional"))


@query(
    "source_display_names",
    f"""WITH {REGISTRY} SELECT supplier, CASE WHEN section IS NULL THEN name ELSE name || ' — ' || section END AS display_name,
    community OR type IN ('youtube','youtube_api','xenforo','reddit') AS is_community FROM registry""",
)
def _display(spark, sf):
    return registry(spark, sf).select(
        "supplier",
        gates.display_name(F.col("name"), F.col("section")).alias("display_name"),
        gates.is_community(F.col("type"), F.col("community")).alias("is_community"),
    )


def wrapped_links(spark, sf):
    """Page links as a newsletter would carry them: wrapped, opaque, look-alike or plain."""
    p = table(spark, sf, "pages")
    encoded = F.url_encode("url")
    link = (
        F.when(
            F.contains("url", F.lit("example.com")),
            F.concat(F.lit("https://CLICK.List-Manage.com/track?u=1&id=9&url="), encoded, F.lit("&r=https%3A%2F%2Fx.org")),
        )
        .when(F.contains("url", F.lit("example.net")), F.concat(F.lit("https://bit.ly/"), F.sha2("url", 256)))
        .when(F.contains("url", F.lit("/en/")), F.concat(F.lit("https://notbit.ly/?url="), encoded))
        .otherwise(F.col("url"))
    )
    return p.select("page_id", "url", link.alias("link"))


_WRAPPED = """w AS (SELECT page_id, url, CASE
      WHEN contains(url, 'example.com') THEN 'wrapped' WHEN contains(url, 'example.net') THEN 'opaque'
      WHEN contains(url, '/en/') THEN 'lookalike' ELSE 'plain' END AS shape FROM pages)"""


@query("tracker_hosts", f"WITH {_WRAPPED} SELECT page_id, shape IN ('wrapped', 'opaque') AS is_tracker FROM w")
def _tracker(spark, sf):
    return wrapped_links(spark, sf).select("page_id", ur.is_tracker(F.col("link")).alias("is_tracker"))


@query(
    "tracker_unwrap",
    f"""WITH {_WRAPPED} SELECT page_id, CASE shape WHEN 'wrapped' THEN url WHEN 'plain' THEN url
      WHEN 'lookalike' THEN 'https://notbit.ly/?url=' || replace(replace(url_encode(url), '%20', '+'), '~', '%7E') END AS target FROM w""",
)
def _unwrap(spark, sf):
    return wrapped_links(spark, sf).select("page_id", ur.unwrap_tracker(F.col("link")).alias("target"))


@query(
    "beat_priority",
    f"""WITH {ITEMS} SELECT seq, beat, nullif(list_position(['Ownership','Leadership','Distribution','Product','Safety',
      'Manufacturing','Financial'], beat), 0) AS beat_order FROM items_raw""",
)
def _beat(spark, sf):
    return items(spark, sf).select("seq", "beat", gates.beat_ordinal(F.col("beat")).alias("beat_order"))


@query("byline", f"WITH {ITEMS} SELECT seq, nullif(author, source_name) AS byline FROM items_raw")
def _byline(spark, sf):
    return items(spark, sf).select("seq", gates.byline(F.col("author"), F.col("source_name")).alias("byline"))
