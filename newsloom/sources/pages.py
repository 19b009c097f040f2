"""Links found in web pages and newsletters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import BOILERPLATE, contains_any, decode_entities, html_to_text, mentions_any, SUBJECT_TERMS
from newsloom.functions.urls import is_absolute_http, resolve_url, unwrap_tracker
from newsloom.operators.gates import headline_length_ok

# Advertised feeds that never carry stories, and feed file endings.
JUNK_FEEDS = ["/comments/feed", "wp-json", "oembed", "web-stories", "/feed/atom", "?attachment_id="]
FEED_FILES = r"(?i)^[^?]*\.(rss|xml|atom)(\?.*)?$"

_ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"
_LINK = r"(?is)<link\b[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted either way or bare, with entities decoded."""
    head = F.regexp_extract(tag, r"(?s)^<[^>]*>", 0)
    quoted = F.regexp_extract(head, rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s>"']+))""", 1)
    return decode_entities(F.regexp_replace(quoted, r"""^["']|["']$""", ""))


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles: links inside them are not links."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Every anchor with a target: link_pos, href as written, link text."""
    found = F.regexp_extract_all(visible(F.col("html")), F.lit(_ANCHOR), F.lit(0))
    return (
        pages.select(key, F.posexplode(found).alias("link_pos", "_tag"))
        .select(
            key,
            "link_pos",
            _attribute(F.col("_tag"), "href").alias("href"),
            F.coalesce(html_to_text(F.col("_tag")), F.lit("")).alias("text"),
        )
        .filter("href <> ''")
    )


def harvest_links(
    messages: DataFrame,
    key: str = "page_id",
    terms: list[str] | None = SUBJECT_TERMS,
    boilerplate: list[str] = BOILERPLATE,
) -> DataFrame:
    """Stories a message links to, once per target within the message.

    A link counts when it is absolute, its text is headline-sized, not boilerplate and on subject
    (``terms=None`` skips that test), and its click tracker, if any, names the target.
    """
    text = F.col("text")
    good = is_absolute_http(F.col("href")) & headline_length_ok(text) & ~contains_any(text, boilerplate)
    if terms is not None:
        good = good & mentions_any(text, terms)
    links = (
        anchors(messages, key)
        .filter(good)
        .withColumn("url", unwrap_tracker(F.col("href")))
        .filter(F.col("url").isNotNull())
    )
    return links.groupBy(key, "url").agg(
        F.min("link_pos").alias("link_pos"), F.min_by("text", "link_pos").alias("title")
    )


def discover_feeds(pages: DataFrame) -> DataFrame:
    """Feeds a crawled page points to: page_id, feed_pos, feed_url, note.

    Advertised feeds win; junk ones are left out. A page advertising none falls back to links to
    feed files, all of them; limit by ``feed_pos`` where fewer are wanted. A page with neither gives one row with a null feed and why.
    """
    html = visible(F.col("html"))
    tags = F.regexp_extract_all(html, F.lit(_LINK), F.lit(0))
    advertised = F.filter(
        tags,
        lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "alternate")
        & F.lower(_attribute(t, "type")).rlike("rss|atom|xml")
        & (_attribute(t, "href") != ""),
    )
    heads = F.transform(advertised, lambda t: resolve_url(F.col("url"), _attribute(t, "href")))

    def is_junk(u: Column) -> Column:
        return contains_any(u, JUNK_FEEDS)

    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>"), F.lit(0)), lambda t: _attribute(t, "href"))
    files = F.transform(
        F.filter(hrefs, lambda h: (h != "") & h.rlike(FEED_FILES)), lambda h: resolve_url(F.col("url"), h)
    )
    found = pages.select(
        "page_id",
        F.array_distinct(F.filter(heads, lambda u: ~is_junk(u))).alias("_head"),
        F.size(F.filter(heads, is_junk)).alias("_junk"),
        F.array_distinct(files).alias("_files"),
    )
    chosen = F.when(F.size("_head") > 0, F.col("_head")).otherwise(F.col("_files"))
    note = (
        F.when(F.size("_head") > 0, "")
        .when(F.size("_files") > 0, "found via linked feed files")
        .when(
            F.col("_junk") > 0,
            F.concat(F.lit("advertises "), F.col("_junk"), F.lit(" feed(s), all boilerplate")),
        )
        .otherwise("page loads but advertises no feed")
    )
    return found.select("page_id", note.alias("note"), F.posexplode_outer(chosen).alias("feed_pos", "feed_url"))
