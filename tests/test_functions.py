"""Column expressions on literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import urls as ur


@pytest.mark.parametrize(
    "url, want",
    [
        (" https://WWW.Example.com/Post/One/?utm_source=rss&id=7#top ", "https://www.example.com/Post/One?id=7"),
        ("HTTP://example.com", "http://example.com/"),
        ("https://example.com///", "https://example.com/"),
        ("https://example.com/a?b=&c", "https://example.com/a?b=&c="),
        ("https://example.com/a?UTM_Medium=x&Ref=y", "https://example.com/a"),
        ("https://example.com/a?q=a%20b+c&z=%7E*", "https://example.com/a?q=a+b+c&z=~%2A"),
        ("https://example.com/a?p=100%&x=%C3%A9", "https://example.com/a?p=100%25&x=%C3%A9"),
        ("https://example.com/a?&&x=1&x=2", "https://example.com/a?x=1&x=2"),
        ("https://User@Example.com:8080/a", "https://user@example.com:8080/a"),
        ("mailto:someone@example.com", None),
        ("/relative", None),
    ],
)
def test_canonical_url(evaluate, url, want):
    assert evaluate(ur.canonical_url, url) == want


def test_same_story_by_three_feeds_has_one_uid(evaluate):
    spellings = [
        "https://example.com/story/?utm_source=a",
        "https://EXAMPLE.com/story#x",
        "https://example.com/story?fbclid=1",
    ]
    uids = {evaluate(lambda c: ur.item_uid(ur.canonical_url(c)), s) for s in spellings}
    assert uids == {hashlib.sha256(b"https://example.com/story").hexdigest()[:16]}


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://example.com/a", "https://example.com/a"),
        ("https://x.list-manage.com/c?u=abc&url=https%3A%2F%2Fa.com%2F1", "https://a.com/1"),
        ("https://list-manage.com/c?link=https://b.com/2&url=https://a.com/1", "https://b.com/2"),
        ("https://bit.ly/xyz", None),
        ("https://notbit.ly/xyz", "https://notbit.ly/xyz"),
        ("https://bit.ly/?URL=ftp://a", None),
    ],
)
def test_tracker_unwrap(evaluate, url, want):
    assert evaluate(ur.unwrap_tracker, url) == want


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("https://a.com/x/y?z=1", "/feed/", "https://a.com/feed/"),
        ("https://a.com/x/y", "f.rss", "https://a.com/x/f.rss"),
        ("https://a.com/x/y/", "../f.rss?a=1", "https://a.com/x/f.rss?a=1"),
        ("https://a.com", "./f.rss", "https://a.com/f.rss"),
        ("https://a.com/x", "//b.com/f", "https://b.com/f"),
        ("https://a.com/x", "http://c.com/f", "http://c.com/f"),
        ("https://a.com/x?q=1", "?q=2", "https://a.com/x?q=2"),
    ],
)
def test_resolve_url(evaluate, base, href, want):
    assert evaluate(ur.resolve_url, base, href) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("A new species was found. It is blue.", "A new species was found"),
        ("One sentence only.", "One sentence only."),
        ("Really? Yes.", "Really?"),
        ("The U.S. fleet sails. It is late.", "The U.S. fleet sails"),
        ("Our colleague Dr. Smith spoke. More soon.", "Our colleague Dr. Smith spoke"),
        ("By Amanda V. Smith today. Read on.", "By Amanda V. Smith today"),
        ("Work by Menkara et al. is out. See it.", "Work by Menkara et al. is out"),
        ("Line one\nline two. Then more", "Line one line two"),
        ("<p>Hello <b>there</b></p>", "Hello there"),
        ("word " * 40, ("word " * 22)[:110].rsplit(" ", 1)[0] + "…"),
        ("   ", None),
        (None, None),
    ],
)
def test_headline(evaluate, text, want):
    assert evaluate(lambda c: tx.headline(c.cast("string")), text) == want


@pytest.mark.parametrize(
    "iso, want",
    [
        ("PT4M13S", 253), ("PT0S", 0), ("PT1H", 3600), ("P1DT2H", 93600), ("PT3M", 180),
        ("P1D", None), ("", None), ("nonsense", None), ("PT99999999999S", 99999999999),
    ],
)
def test_duration(evaluate, iso, want):
    assert evaluate(tx.duration_seconds, iso) == want


@pytest.mark.parametrize(
    "title, want",
    [
        ("NEW DNA STUDY OF CORAL IN THE RED SEA", "New DNA Study of Coral in the Red Sea"),
        ("A Quiet headline stays", "A Quiet headline stays"),
        ("SHORT ONE", "SHORT ONE"),
        ("THE NOAA: OUTLOOK FOR REEFS", "The NOAA: Outlook for Reefs"),
    ],
)
def test_recase(evaluate, title, want):
    assert evaluate(tx.recase, title) == want


@pytest.mark.parametrize(
    "title, want",
    [
        ("How to frag", True), ("HOW-TO: frags", True), ("Howto frag", True), ("Tips for tanks", True),
        ("Multiple corals", False), ("Mistakes we made", True), ("Mistaken identity", False),
    ],
)
def test_instructional(evaluate, title, want):
    assert evaluate(tx.is_instructional, title) is want


def test_gist_cap_and_excerpt(evaluate):
    forty, more = " ".join(["w"] * 40), " ".join(["w"] * 41)
    assert evaluate(tx.capped_gist, f"  {forty}\n") == forty
    assert evaluate(tx.capped_gist, more) is None
    assert evaluate(tx.capped_gist, "   ") is None
    assert evaluate(tx.excerpt, " ".join(map(str, range(61)))) == " ".join(map(str, range(60))) + "…"
    assert evaluate(tx.excerpt, " a \n b ") == "a b"
    assert evaluate(lambda c: tx.excerpt(c.cast("string")), None) == ""


def test_unicode_whitespace_is_whitespace(evaluate):
    assert evaluate(tx.squeeze, " a 　b\x1cc ") == "a b c"
    assert evaluate(tx.strip, "  x y\u0085") == "x y"


def test_html_to_text(evaluate):
    html = '<style>p{x}</style><script>var t="</p>";</script><p>A &amp; B &lt;c&gt;</p><!-- no --> d'
    assert evaluate(tx.html_to_text, html) == "A & B <c> d"
    assert evaluate(lambda c: tx.html_to_text(c, 3), html) == "A &"
    assert evaluate(tx.html_to_text, "<br>") is None


def test_word_sets_fold_styled_letters(spark):
    styled = "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in "new seahorse species")
    rows = spark.createDataFrame([(0, "New Seahorse Species, the"), (1, styled), (2, "café Ünder"), (3, "ab of")], "id int, t string")
    got = {r["id"]: r["tokens"] for r in tx.with_word_set(rows, "t").collect()}
    assert got[0] == got[1] == ["seahorse", "species"]
    assert got[2] == ["caf", "nder"]
    assert got[3] == []


def test_feed_dates(evaluate):
    def shown(c):
        return F.date_format(tx.rfc822_timestamp(c), "yyyy-MM-dd HH:mm:ss")

    assert evaluate(shown, "Thu, 13 Aug 2026 09:31:00 +0200") == "2026-08-13 07:31:00"
    assert evaluate(shown, "13 Aug 2026 09:31:00 GMT") == "2026-08-13 09:31:00"
    assert evaluate(shown, "2026-08-13T09:31:00Z") == "2026-08-13 09:31:00"
    assert evaluate(shown, "next week") is None


@pytest.mark.parametrize("score", [0.125, 0.135, 0.575, 0.585, 0.005, 0.015, 0.995, 1.0, 0.0, 0.45, 0.625])
def test_two_decimals_agree_with_python_formatting(evaluate, score):
    assert evaluate(tx.two_decimals, score) == float(f"{score:.2f}")


@pytest.mark.parametrize(
    "text, want",
    [
        ("It&#8217;s caf&eacute; &amp; bar", "It’s café & bar"),
        ("&rsquo;&#x2019;&#39;", "’’'"),
        ("&amp;lt;b&amp;gt; &lt;i&gt;", "&lt;b&gt; <i>"),
        ("&unknownref; &#0; &#xD800; a & b", "&unknownref; &#0; &#xD800; a & b"),
        ("no references", "no references"),
    ],
)
def test_decode_entities(evaluate, text, want):
    assert evaluate(tx.decode_entities, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Thu, 13 Aug 2026 09:31:07 +0000", "2026-08-13 09:31:07"),
        ("Thu, 13 Aug 2026 09:31 +0000", "2026-08-13 09:31:00"),
        ("Thursday, 13 Aug 2026 9:31:07 +0200", "2026-08-13 07:31:07"),
        ("13 Aug 26 09:31 GMT", "2026-08-13 09:31:00"),
        ("1 Jan 99 00:00:00 +0000", "1999-01-01 00:00:00"),
        ("2026-08-13T09:31:07Z", "2026-08-13 09:31:07"),
        ("soon", None),
    ],
)
def test_feed_dates(evaluate, text, want):
    assert evaluate(lambda c: tx.rfc822_timestamp(c).cast("string"), text) == want


def test_two_decimals_above_a_thousand(evaluate):
    assert evaluate(tx.two_decimals, 1234.567) == 1234.57
    assert evaluate(tx.two_decimals, 0.575) == 0.57


def test_headline_with_a_long_limit(evaluate):
    words = "coral " * 200
    got = evaluate(lambda c: tx.headline(c, 600), words)
    assert got.endswith("…") and 590 < len(got) <= 601
