"""Parsers on inline bodies."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.sources import feeds, forms
from newsloom.sources import pages as pg


def landed(spark, body):
    return spark.createDataFrame([("s", body)], "source_id string, body string")


RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title>
<item><title><![CDATA[Fish & chips]]></title><link>https://a.com/1?utm_source=rss</link><dc:creator>Jo</dc:creator>
 <pubDate>Thu, 13 Aug 2026 09:31:00 +0000</pubDate><guid isPermaLink="false">g1</guid>
 <description><![CDATA[<p>Some <b>bold</b> text</p>]]></description></item>
<item><title>No date</title><link>https://a.com/2</link></item>
<item><link>https://a.com/3</link><pubDate>Thu, 13 Aug 2026 09:31:00 +0000</pubDate><description>First words. Then more.</description></item>
<item><title>Relative</title><link>/4</link><pubDate>13 Aug 2026 09:31:00 GMT</pubDate></item>
</channel></rss>"""


def test_rss(spark):
    rows = feeds.rss_items(landed(spark, RSS)).orderBy("entry_pos").collect()
    assert [r["reject_reason"] for r in rows] == [None, "no date", "missing link or title", "unresolvable url"]
    first = rows[0]
    assert (first["title"], first["author"], first["raw_text"], first["guid"]) == ("Fish & chips", "Jo", "Some bold text", "g1")
    assert first["published_at"] == dt.datetime(2026, 8, 13, 9, 31)
    named = feeds.accepted(feeds.rss_items(landed(spark, RSS), untitled=True)).filter("entry_pos = 2").first()
    assert named["title"] == "First words"


def test_malformed_bodies_give_no_rows_and_no_failure(spark):
    for body in ("<rss><channel><item>", "not a feed", "", "{"):
        assert feeds.rss_items(landed(spark, body)).count() == 0
        assert feeds.playlist_items(landed(spark, body)).count() == 0


def test_atom(spark):
    body = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="u"><title>c</title><entry><id>yt:1</id><yt:videoId>abc</yt:videoId>
      <title>Tank tour</title><link rel="self" href="https://x/self"/><link rel="alternate" href="https://x/watch?v=abc"/>
      <author><name>Chan</name></author><updated>2026-08-14T00:00:00+00:00</updated></entry></feed>"""
    row = feeds.atom_items(landed(spark, body)).first()
    assert (row["url"], row["video_id"], row["author"], row["reject_reason"]) == ("https://x/watch?v=abc", "abc", "Chan", None)
    assert row["published_at"] == dt.datetime(2026, 8, 14)


def test_playlist(spark):
    body = """{"items": [
      {"snippet": {"title": "A", "publishedAt": "2026-08-13T09:00:00Z", "channelTitle": "C", "resourceId": {"videoId": "v1"}, "description": "<b>d</b>"}},
      {"snippet": {"title": "Private video", "publishedAt": "2026-08-13T09:00:00Z", "resourceId": {"videoId": "v2"}}},
      {"snippet": {"title": "", "publishedAt": "2026-08-13T09:00:00Z", "resourceId": {"videoId": "v3"}}}]}"""
    rows = feeds.playlist_items(landed(spark, body)).orderBy("entry_pos").collect()
    assert [r["reject_reason"] for r in rows] == [None, "not watchable", "missing id, title or date"]
    assert (rows[0]["author"], rows[0]["raw_text"]) == ("C", "d")
    assert feeds.playlist_items(landed(spark, '{"error": {"code": 403, "message": "quota"}, "items": []}')).count() == 0


def test_works(spark):
    body = """{"results": [
      {"display_name": "P1", "publication_date": "2026-08-10", "doi": "https://doi.org/1",
       "primary_location": {"landing_page_url": "https://j/1", "source": {"display_name": "Journal", "type": "journal"}},
       "best_oa_location": {"landing_page_url": "https://oa/1"},
       "authorships": [{"author": {"display_name": "Ann"}}, {"author": {"display_name": "Bo"}}],
       "abstract_inverted_index": {"reefs": [1], "Coral": [0], "bleach": [2], "again": [2]}},
      {"title": "P2", "publication_date": "2026-08-10", "doi": "https://doi.org/2", "primary_location": {"source": {"display_name": "Zen", "type": "repository"}}},
      {"title": "P3", "publication_date": "2026-08-10", "doi": "https://doi.org/3", "primary_location": {"source": {"display_name": "J3"}}, "authorships": [{"author": {"display_name": "Solo"}}]},
      {"title": "P4", "publication_date": "2026-08-10", "doi": "https://doi.org/4"},
      {"title": "P5", "doi": "https://doi.org/5"}]}"""
    rows = feeds.works_items(landed(spark, body)).orderBy("entry_pos").collect()
    assert [r["reject_reason"] for r in rows] == [
        None, "repository deposit", None, "no journal to credit", "missing title, date or link",
    ]
    assert (rows[0]["url"], rows[0]["author"], rows[0]["raw_text"]) == ("https://oa/1", "Ann et al.", "Coral reefs again")
    assert (rows[2]["url"], rows[2]["author"], rows[2]["raw_text"]) == ("https://doi.org/3", "Solo", None)


def test_newsletter_links(spark):
    html = (
        '<a href="https://a.com/1">A long enough\n headline about <b>coral</b> reefs</a>'
        '<a href="https://a.com/1">The same coral target under another headline</a>'
        '<a href="https://x.list-manage.com/c?u=1&amp;url=https%3A%2F%2Fb.com%2F2">Another headline about coral health</a>'
        '<a href="https://bit.ly/zz">An opaque link about coral and fish tanks</a>'
        '<a href="https://a.com/3">Click here to read all about coral reefs</a>'
        '<a href="https://a.com/4">A headline on dogs and cats and retail</a>'
        '<a href="https://a.com/5">Coral</a><a href="/6">A relative link about coral and its reefs</a>'
    )
    mail = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = pg.harvest_links(mail).orderBy("link_pos").collect()
    assert [(r["url"], r["title"]) for r in got] == [
        ("https://a.com/1", "A long enough headline about coral reefs"),
        ("https://b.com/2", "Another headline about coral health"),
    ]
    assert pg.harvest_links(mail, terms=None).count() == 3


def test_feed_discovery(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://a.com/x", '<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="application/rss+xml" href="/comments/feed/">'),
            (2, "https://b.com/", "".join(f'<a href="/f{i}.xml">f</a>' for i in range(12))),
            (3, "https://c.com/", '<link rel="alternate" type="application/json+oembed" href="/wp-json/x">'),
            (4, "https://d.com/", '<link rel="alternate" type="text/xml+oembed" href="/wp-json/x">'),
        ],
        "page_id long, url string, html string",
    )
    got = {}
    for r in pg.discover_feeds(pages).orderBy("page_id", "feed_pos").collect():
        got.setdefault(r["page_id"], []).append((r["feed_url"], r["note"]))
    assert got[1] == [("https://a.com/feed", "")]
    assert len(got[2]) == 12 and got[2][0][0] == "https://b.com/f0.xml"
    assert got[3] == [(None, "page loads but advertises no feed")]
    assert got[4] == [(None, "advertises 1 feed(s), all boilerplate")]


def form(**fields):
    base = {"Headline": "H", "Link": "https://a.com/1", "Outlet": "O", "Category": "wild reefs", "Published": "2026-08-01"}
    base.update(fields)
    return "".join(f"### {k}\n\n{v}\n\n" for k, v in base.items())


def test_picks(spark):
    bodies = [
        form(**{"Why it matters": "Because.\nIt does.", "Industry beat": "Safety"}),
        form(Headline="_No response_", Outlet=""),
        form(Link="a.com/1"),
        form(**{"Why it matters": "w " * 41}),
        form(Category="Gossip"),
        form(Published="soon"),
        form(Published="_No response_"),
        "no sections at all",
        form() + "### Headline\n\nThe later one wins\n",
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "pick_id long, body string")
    now = F.lit("2026-08-20 00:00:00").cast("timestamp")
    got = {r["pick_id"]: r for r in forms.pick_items(rows, now).collect()}
    assert [got[i]["reject_reason"] for i in range(9)] == [
        None, "missing a headline, an outlet", "unusable link", "gist of 41 words", "unknown category", "unreadable date",
        None, "missing a headline, a link, an outlet", None,
    ]
    assert (got[0]["gist"], got[0]["beat"], got[0]["category"], got[0]["author"]) == ("Because.\nIt does.", "Safety", "Wild Reefs", None)
    assert got[6]["published_at"] == dt.datetime(2026, 8, 20)
    assert got[8]["title"] == "The later one wins"


def test_labels_with_drift(spark):
    raw = spark.createDataFrame([("a", " Lead "), ("b", "maybe"), ("z", "drop")], "uid string, bucket string")
    known = spark.createDataFrame([("a",), ("b",)], "uid string")
    got = {r["uid"]: (r["bucket"], r["problem"]) for r in forms.load_labels(raw, known).collect()}
    assert got == {"a": ("lead", None), "b": ("maybe", "unknown bucket"), "z": ("drop", "labelled but not in the item set")}


def test_body_problems(spark):
    bodies = ["{", '{"error": {"code": 403}}', '{"items": []}', "[1]", RSS, "<rss><channel><item>"]
    rows = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "source_id string, body string")
    got = {r["source_id"]: r["problem"] for r in feeds.body_problems(rows, "playlist").collect()}
    assert got == {"0": "not JSON", "1": "API error", "3": "no result list", "4": "not JSON", "5": "not JSON"}
    assert {r["source_id"] for r in feeds.body_problems(rows, "rss").collect()} == {"0", "1", "2", "3", "5"}
    assert "4" in {r["source_id"] for r in feeds.body_problems(rows, "atom").collect()}


def test_rdf_entries_are_credited_to_outlet_and_section(spark):
    body = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title></channel>'
        '<item rdf:about="https://a.example/1"><title> One </title><dc:date>2026-08-01T10:00:00Z</dc:date><dc:creator>Ann</dc:creator></item>'
        '<item rdf:about="https://a.example/2"><title>Two</title><link>https://a.example/two</link></item></rdf:RDF>'
    )
    landing = spark.createDataFrame([("s1", body), ("s2", body), ("s3", body), ("s4", "no xml")], "source_id string, body string")
    registry = spark.createDataFrame([("s1", "Outlet", "Reefs"), ("s2", "Other", ""), ("s4", "", None)], "source_id string, name string, section string")
    got = {(r["source_id"], r["title"]): r for r in feeds.credited(feeds.rdf_items(landing), registry).collect()}
    assert len(got) == 6
    one = got["s1", "One"]
    assert (one["url"], one["author"], one["source_name"], one["section"]) == ("https://a.example/1", "Ann", "Outlet — Reefs", "Reefs")
    assert one["reject_reason"] is None and got["s2", "One"]["source_name"] == "Other"
    assert got["s1", "Two"]["url"] == "https://a.example/two" and got["s1", "Two"]["reject_reason"] == "no date"
    assert got["s3", "One"]["reject_reason"] == "no outlet to credit"


def test_view_counts_of_videos(spark):
    stats = lambda v: f'<media:group><media:community><media:statistics views="{v}"/></media:community></media:group>'
    entries = "".join(f"<entry><id>{i}</id>{x}</entry>" for i, x in enumerate([stats(12), stats("x"), ""]))
    landing = spark.createDataFrame([("s", f"<feed>{entries}</feed>")], "source_id string, body string")
    assert {r["guid"]: r["views"] for r in feeds.atom_items(landing).collect()} == {"0": 12, "1": None, "2": None}


def test_caps_and_durations(spark):
    from newsloom.operators import gates, joins

    rows = spark.createDataFrame([(1, "2026-01-01", "a"), (2, None, "b"), (3, "2026-01-02", "c"), (4, "2026-01-02", None)], "seq long, published_at string, video_id string")
    assert [r["seq"] for r in gates.newest_first(rows, 3).collect()] == [3, 4, 1]
    known = spark.createDataFrame([("a", 5), ("a", 9), ("z", 1), (None, 3)], "video_id string, duration_s int")
    assert {r["seq"]: r["duration_s"] for r in joins.with_durations(rows, known).collect()} == {1: 9, 2: None, 3: None, 4: None}
