"""Feed bodies in, item rows out.

A landing table holds one body per row (source_id, body). Each parser explodes bodies to
entries and adds ``reject_reason``: null for a usable item, else why it is not. Nothing is
dropped silently; `accepted` and `rejected` split the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import blank_to_null, headline, html_to_text, rfc822_timestamp
from newsloom.functions.urls import is_absolute_http
from newsloom.operators.gates import display_name

_RSS = """
    STRUCT<channel: STRUCT<title: STRING, item: ARRAY<STRUCT<
        title: STRING, link: STRING, guid: STRING, pubDate: STRING, description: STRING,
        author: STRING, `dc:creator`: STRING, `dc:date`: STRING>>>>
"""
_ATOM = """
    STRUCT<title: STRING, entry: ARRAY<STRUCT<
        id: STRING, title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>,
        published: STRING, updated: STRING, author: STRUCT<name: STRING>,
        summary: STRING, content: STRING, `yt:videoId`: STRING,
        `media:group`: STRUCT<`media:community`: STRUCT<`media:statistics`: STRUCT<_views: STRING>>>>>>
"""
_RDF = """
    STRUCT<item: ARRAY<STRUCT<
        `_rdf:about`: STRING, title: STRING, link: STRING, description: STRING,
        `dc:date`: STRING, `dc:creator`: STRING>>>
"""
_PLAYLIST = """
    STRUCT<error: STRUCT<code: INT, message: STRING>, items: ARRAY<STRUCT<snippet: STRUCT<
        title: STRING, description: STRING, publishedAt: STRING, channelTitle: STRING,
        videoOwnerChannelTitle: STRING, resourceId: STRUCT<videoId: STRING>>>>>
"""
_WORKS = """
    STRUCT<error: STRING, results: ARRAY<STRUCT<
        display_name: STRING, title: STRING, publication_date: STRING, doi: STRING,
        primary_location: STRUCT<landing_page_url: STRING,
            source: STRUCT<display_name: STRING, type: STRING>>,
        best_oa_location: STRUCT<landing_page_url: STRING>,
        authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>,
        abstract_inverted_index: MAP<STRING, ARRAY<INT>>>>>
"""

# Placeholder titles of videos nobody can watch, and venues that only host files.
UNWATCHABLE = ["Private video", "Deleted video"]
REPOSITORY_VENUES = ["repository", "other"]


def _first_reason(*tests: tuple[Column, str]) -> Column:
    reason = F
    for test, name in tests:
        reason = reason.when(test, name)
    return reason


def rss_items(landing: DataFrame, untitled: bool = False) -> DataFrame:
    """RSS 2.0 entries. ``untitled`` gives posts without a title a headline from their text."""
    feed = F.from_xml("body", _RSS.strip(), {"mode": "PERMISSIVE"})
    entries = landing.select("source_id", F.posexplode(feed["channel"]["item"]).alias("entry_pos", "e"))
    title = blank_to_null(F.col("e.title"))
    if untitled:
        title = F.coalesce(title, headline(F.col("e.description")))
    return _finish(
        entries,
        title=title,
        url=blank_to_null(F.col("e.link")),
        published=F.coalesce(rfc822_timestamp(F.col("e.pubDate")), rfc822_timestamp(F.col("e.`dc:date`"))),
        author=F.coalesce(blank_to_null(F.col("e.`dc:creator`")), blank_to_null(F.col("e.author"))),
        html=F.col("e.description"),
        guid=F.col("e.guid"),
        video_id=F.lit(None).cast("string"),
    )


def atom_items(landing: DataFrame) -> DataFrame:
    feed = F.from_xml("body", _ATOM.strip(), {"mode": "PERMISSIVE"})
    entries = landing.select("source_id", F.posexplode(feed["entry"]).alias("entry_pos", "e"))
    links = F.filter("e.link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return _finish(
        entries,
        title=blank_to_null(F.col("e.title")),
        url=blank_to_null(F.get(links, F.lit(0))["_href"]),
        published=F.coalesce(rfc822_timestamp(F.col("e.published")), rfc822_timestamp(F.col("e.updated"))),
        author=blank_to_null(F.col("e.author.name")),
        html=F.coalesce("e.summary", "e.content"),
        guid=F.col("e.id"),
        video_id=blank_to_null(F.col("e.`yt:videoId`")),
        views=F.col("e.`media:group`.`media:community`.`media:statistics`._views").try_cast("bigint"),
    )


def rdf_items(landing: DataFrame) -> DataFrame:
    """RSS 1.0 entries, which stand beside the channel under ``rdf:RDF`` and are dated by ``dc:date``."""
    feed = F.from_xml("body", _RDF.strip(), {"mode": "PERMISSIVE"})
    entries = landing.select("source_id", F.posexplode(feed["item"]).alias("entry_pos", "e"))
    return _finish(
        entries,
        title=blank_to_null(F.col("e.title")),
        url=F.coalesce(blank_to_null(F.col("e.link")), blank_to_null(F.col("e.`_rdf:about`"))),
        published=rfc822_timestamp(F.col("e.`dc:date`")),
        author=blank_to_null(F.col("e.`dc:creator`")),
        html=F.col("e.description"),
        guid=F.col("e.`_rdf:about`"),
        video_id=F.lit(None).cast("string"),
    )


def credited(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries with the name they are credited to: the outlet's, with its section where it has one.

    ``registry``: source_id, name, section, one row a source. Adds source_name and section; an entry
    of a source that is not registered, or has no name, cannot be credited and is rejected for that
    if for nothing else.
    """
    known = registry.select("source_id", F.nullif("name", F.lit("")).alias("_name"), F.nullif("section", F.lit("")).alias("section"))
    named = parsed.join(known, "source_id", "left").withColumn(
        "source_name", F.when(F.col("_name").isNotNull(), display_name(F.col("_name"), F.col("section")))
    )
    reason = F.when(F.col("_name").isNull(), "no outlet to credit")
    return named.withColumn("reject_reason", F.coalesce("reject_reason", reason)).drop("_name")


def _finish(entries, title, url, published, author, html, guid, video_id, **more) -> DataFrame:
    return entries.select(
        "source_id",
        "entry_pos",
        guid.alias("guid"),
        title.alias("title"),
        url.alias("url"),
        published.alias("published_at"),
        author.alias("author"),
        html_to_text(html).alias("raw_text"),
        video_id.alias("video_id"),
        *[column.alias(name) for name, column in more.items()],
    ).withColumn(
        "reject_reason",
        _first_reason(
            (F.col("url").isNull() | F.col("title").isNull(), "missing link or title"),
            (F.col("published_at").isNull(), "no date"),
            (~is_absolute_http(F.col("url")), "unresolvable url"),
        ),
    )


def playlist_items(landing: DataFrame) -> DataFrame:
    """Entries of a video playlist response."""
    payload = F.from_json("body", _PLAYLIST.strip(), {"mode": "PERMISSIVE"})
    entries = (
        landing.select("source_id", payload.alias("p"))
        .filter(F.col("p.error").isNull())
        .select("source_id", F.posexplode("p.items").alias("entry_pos", "e"))
        .select("source_id", "entry_pos", "e.snippet.*")
    )
    video = blank_to_null(F.col("resourceId.videoId"))
    title = blank_to_null(F.col("title"))
    return entries.select(
        "source_id",
        "entry_pos",
        title.alias("title"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("url"),
        F.try_to_timestamp("publishedAt").alias("published_at"),
        F.coalesce(blank_to_null(F.col("videoOwnerChannelTitle")), blank_to_null(F.col("channelTitle"))).alias("author"),
        html_to_text(F.col("description")).alias("raw_text"),
        video.alias("video_id"),
    ).withColumn(
        "reject_reason",
        _first_reason(
            (
                F.col("video_id").isNull() | F.col("title").isNull() | F.col("published_at").isNull(),
                "missing id, title or date",
            ),
            (F.col("title").isin(UNWATCHABLE), "not watchable"),
        ),
    )


def works_items(landing: DataFrame) -> DataFrame:
    """Entries of a literature index, each credited to its own journal."""
    payload = F.from_json("body", _WORKS.strip(), {"mode": "PERMISSIVE"})
    entries = (
        landing.select("source_id", payload.alias("p"))
        .filter(F.col("p.error").isNull())
        .select("source_id", F.posexplode("p.results").alias("entry_pos", "e"))
        .select("source_id", "entry_pos", "e.*")
    )
    first = F.get("authorships", F.lit(0))["author"]["display_name"]
    author = F.when(F.size("authorships") > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    venue = F.col("primary_location.source")
    return entries.select(
        "source_id",
        "entry_pos",
        blank_to_null(venue["display_name"]).alias("source_name"),
        F.coalesce(blank_to_null(F.col("display_name")), blank_to_null(F.col("title"))).alias("title"),
        F.coalesce(
            blank_to_null(F.col("best_oa_location.landing_page_url")),
            blank_to_null(F.col("doi")),
            blank_to_null(F.col("primary_location.landing_page_url")),
        ).alias("url"),
        F.try_to_timestamp("publication_date", F.lit("yyyy-MM-dd")).alias("published_at"),
        F.when(first.isNotNull(), author).alias("author"),
        html_to_text(inflate_index(F.col("abstract_inverted_index"))).alias("raw_text"),
        "doi",
        venue["type"].alias("venue_type"),
    ).withColumn(
        "reject_reason",
        _first_reason(
            (
                F.col("title").isNull() | F.col("published_at").isNull() | F.col("url").isNull(),
                "missing title, date or link",
            ),
            (F.col("source_name").isNull(), "no journal to credit"),
            (F.coalesce(F.col("venue_type").isin(REPOSITORY_VENUES), F.lit(False)), "repository deposit"),
            (~is_absolute_http(F.col("url")), "unresolvable url"),
        ),
    )


def inflate_index(index: Column) -> Column:
    """Text from {word: [positions]}. Where two words claim a position the later entry wins.

    Works inside the row: a position is sorted with its claimants and the last one is kept.
    """
    claims = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e, i: F.transform(
                e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))
            ),
        )
    )

    def last_claims(placed: Column) -> Column:
        following = F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0)))
        return F.filter(
            F.arrays_zip(placed.alias("a"), following.alias("b")),
            lambda z: z["b"].isNull() | (z["b"]["p"] != z["a"]["p"]),
        )

    last = let(F.sort_array(claims), last_claims)
    return F.nullif(F.array_join(F.transform(last, lambda z: z["a"]["w"]), " "), F.lit(""))


def body_problems(landing: DataFrame, kind: str) -> DataFrame:
    """Bodies that give no entries at all, and why. ``kind``: rss, atom, playlist or works.

    An API that reports an error answers with valid JSON and no results, which is not the same as
    a quiet week.
    """
    body = F.col("body")
    if kind in ("rss", "atom"):
        shape, inside = (_RSS, "channel") if kind == "rss" else (_ATOM, "entry")
        parsed = F.from_xml("body", shape.strip(), {"mode": "PERMISSIVE"})
        problem = F.when(parsed[inside].isNull(), "unparseable feed")
    else:
        field = "items" if kind == "playlist" else "results"
        parsed = F.try_parse_json(body)
        problem = (
            F.when(parsed.isNull(), "not JSON")
            .when(F.get_json_object(body, "$.error").isNotNull(), "API error")
            .when(F.get_json_object(body, f"$.{field}").isNull(), "no result list")
        )
    return landing.withColumn("problem", problem).filter("problem IS NOT NULL")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    """The quarantine side of a parser."""
    return parsed.filter(F.col("reject_reason").isNotNull())


def union_sources(*parsed: DataFrame) -> DataFrame:
    """Item tables of several dialects as one, aligned by name."""
    out = parsed[0]
    for other in parsed[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
