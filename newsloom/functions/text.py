"""Text shaping as column expressions: markup, headlines, excerpts, word sets."""

from __future__ import annotations

import json
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.binding import let
from newsloom.schema import GIST_MAX_WORDS, literal_array

# Words whose full stop does not end a sentence.
ABBREVIATIONS = [
    "dr", "prof", "mr", "mrs", "ms", "st", "sr", "jr", "vs", "etc", "al", "inc", "ltd", "co", "corp",
    "dept", "est", "fig", "no", "vol", "approx", "cf", "ca", "ie", "eg", "pp", "ed", "eds", "repr", "trans",
    "univ", "assoc",
]

# Words too common to show that two headlines tell one story.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "of", "in", "on", "at", "to", "for", "from", "by", "with", "as",
    "is", "are", "was", "were", "be", "been", "being", "it", "its", "this", "that", "these", "those", "has",
    "have", "had", "will", "would", "can", "could", "new", "now", "our", "your", "their", "his", "her",
    "out", "up", "more", "most", "just", "about", "after", "before", "over", "under", "into", "than",
    "then", "them", "they", "we", "you", "i", "not", "no", "all", "some", "any", "one", "two",
]

# Terms kept in capitals, and words kept small, when a headline is recased.
ACRONYMS = [
    "PAM", "RGB", "DNA", "RNA", "LED", "SPS", "LPS", "NOAA", "ENSO", "UV", "ICP", "MPA", "MPAS", "PAR",
    "GFO", "ATS", "CITES", "USA", "US", "UK", "AI", "API", "PH", "CO2", "SST", "ROV", "OA",
]
MINOR_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to", "vs",
    "via", "with", "from", "into",
]

# Vocabulary of the subject gate.
SUBJECT_TERMS = [
    "marine", "saltwater", "reef", "reefs", "coral", "corals", "aquaria", "aquarium", "aquariums",
    "aquatic", "aquatics", "aquaculture", "fish", "fishes", "livestock", "invertebrate", "invertebrates",
    "anemone", "clownfish", "tang", "wrasse", "angelfish", "frag", "fragging", "zoanthid", "acropora",
    "montipora", "cichlid", "seahorse", "ornamental", "mariculture", "quarantine", "salinity", "skimmer",
    "sump", "refugium", "cites", "bleaching",
]

# Link texts that are never a story.
BOILERPLATE = [
    "unsubscribe", "view in browser", "view this email", "privacy policy",
    "manage preferences", "update your preferences", "advertise", "contact us",
    "subscribe", "forward to a friend", "add us to your address book",
    "terms of service", "read more", "click here", "learn more", "sign up",
    "follow us", "share this", "download the app", "media kit",
]

# Titles that teach.
INSTRUCTIONAL = r"(?i)\b(how[\s-]?to|tips?|tricks?|resources?|mistakes?)\b"

HEADLINE_CHARS = 110
EXCERPT_WORDS = 60


# Whitespace, as characters to trim and as a pattern.
_SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The rarer spaces sit behind one range test, so that an ordinary letter costs two comparisons.
_SPACE_RUN = (
    r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]+"
)


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def words(text: Column, limit: int = -1) -> Column:
    """Whitespace-separated words; an empty array for blank text.

    With a positive ``limit`` splitting stops there and the last element holds the rest.
    """
    clean = strip(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, _SPACE_RUN, limit))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def _named_references() -> Column:
    """The standard's named character references, a constant map."""
    named = {name: char for name, char in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(named)), "map<string,string>")


def decode_entities(text: Column) -> Column:
    """Character references as characters: numeric, hexadecimal and named ones; unknown ones stay.

    The ampersand's own reference is decoded last, so that nothing is decoded twice.
    """

    def code_point(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        value = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        known = value.between(1, 0xD7FF) | value.between(0xE000, 0x10FFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32"))

    def character(ref: Column) -> Column:
        named = F.element_at(_named_references(), F.substring(ref, F.lit(2), F.length(ref)))
        return F.coalesce(F.when(ref.startswith("&#"), code_point(ref)).otherwise(named), ref)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    ampersand = ["&amp;", "&AMP;", "&#38;", "&#x26;", "&#X26;"]
    ordered = F.concat(F.filter(found, lambda r: ~r.isin(ampersand)), F.filter(found, lambda r: r.isin(ampersand)))
    decoded = F.aggregate(ordered, text, lambda done, r: F.replace(done, r, character(r)))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_to_text(html: Column, limit: int | None = None) -> Column:
    """Readable text of markup: scripts, styles, comments and tags out, entities decoded."""
    untagged = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ")
    plain = F.when(F.contains(html, F.lit("<")), untagged).otherwise(html)
    plain = squeeze(decode_entities(plain))
    if limit is not None:
        plain = F.substring(plain, 1, limit)
    return F.nullif(plain, F.lit(""))


_EDGE = ".,;:!?\"'()[]"


def _ends_in_abbreviation(head: Column) -> Column:
    """``head`` has lost its full stops already."""
    last = F.substring_index(head, " ", -1)
    bare = F.lower(F.btrim(last, F.lit(_EDGE)))
    return (bare != "") & (
        F.contains(last, F.lit(".")) | (F.length(bare) == 1) | bare.isin(ABBREVIATIONS)
    )


def headline(text: Column, limit: int = HEADLINE_CHARS) -> Column:
    """A headline for an untitled post: its first real sentence, else a clip at a word.

    Neither can reach beyond the limit, so only a few times as many characters are looked at.
    """

    def first_sentence(pieces: Column) -> Column:
        # Every start of the text that ends where a terminator is followed by whitespace.
        heads = F.transform(
            F.slice(F.sequence(F.lit(0), F.size(pieces)), F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
            lambda i: F.rtrim(strip(F.array_join(F.slice(pieces, F.lit(1), i), " ")), F.lit(".")),
        )
        fits = F.filter(heads, lambda h: (h != "") & (F.length(h) <= limit))
        return F.get(F.filter(fits, lambda h: ~_ends_in_abbreviation(h)), F.lit(0))

    def choose(plain: Column) -> Column:
        cut = F.regexp_replace(
            F.regexp_replace(F.substring(plain, 1, limit), " [^ ]*$", ""), "[,;:\\-—]+$", ""
        )
        return F.coalesce(
            let(F.split(plain, r"(?<=[.!?])\s", -1), first_sentence),
            F.when(F.length(plain) <= limit, plain).when(cut != "", F.concat(cut, F.lit("…"))),
        )

    return let(html_to_text(text, max(400, 4 * limit)), choose)


def excerpt(text: Column, count: int = EXCERPT_WORDS) -> Column:
    parts = words(F.coalesce(text, F.lit("")), count + 1)
    return F.concat(
        F.array_join(F.slice(parts, 1, count), " "), F.when(F.size(parts) > count, "…").otherwise("")
    )


def capped_gist(gist: Column, count: int = GIST_MAX_WORDS) -> Column:
    """The gist, or null when blank or over the word ceiling."""
    clean = strip(gist)
    return F.when((clean != "") & (F.size(words(clean, count + 1)) <= count), clean)


def clip(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit,
        F.concat(F.rtrim(F.substring(text, 1, limit - 1), F.lit(_SPACES)), F.lit("…")),
    ).otherwise(text)


def recase(title: Column) -> Column:
    """A shouted headline in title case; any other headline as it is."""
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(title, r"[^\p{Lu}]", ""))

    def one(word: Column, position: Column) -> Column:
        bare = F.btrim(word, F.lit(_EDGE))
        return (
            F.when(F.upper(bare).isin(ACRONYMS), F.upper(word))
            .when((position > 0) & F.lower(bare).isin(MINOR_WORDS), F.lower(word))
            .otherwise(
                F.concat(
                    F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word)))
                )
            )
        )

    shouted = (letters >= 12) & (capitals >= letters * F.lit(0.7))
    return F.when(shouted, F.array_join(F.transform(words(title), one), " ")).otherwise(title)


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def mentions_any(text: Column, terms: list[str]) -> Column:
    """Any whole ASCII word of the text in a term list."""
    return F.arrays_overlap(ascii_words(text), literal_array(terms))


def two_decimals(score: Column) -> Column:
    """A score on the two-decimal grid, decided on its binary value, exact ties to even.

    `round` and `bround` go by the shortest decimal spelling instead: they make 0.575 into 0.58,
    though the stored number is below the half.
    """
    return F.replace(F.format_number(score, 2), F.lit(","), F.lit("")).cast("double")


def contains_any(text: Column, phrases: list[str] = BOILERPLATE) -> Column:
    return F.lower(text).rlike("|".join(re.escape(p) for p in phrases))


def is_instructional(title: Column) -> Column:
    return title.rlike(INSTRUCTIONAL)


def duration_seconds(iso: Column) -> Column:
    """Seconds of an ISO-8601 duration; null when it does not parse (a time part is required)."""
    shape = r"^P(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"

    def number(group: int) -> Column:
        digits = F.nullif(F.regexp_extract(iso, shape, group), F.lit(""))
        return F.coalesce(digits.cast("bigint"), F.lit(0).cast("bigint"))

    total = number(1) * 86400 + number(2) * 3600 + number(3) * 60 + number(4)
    return F.when(iso.rlike(shape), total)


def rfc822_timestamp(text: Column) -> Column:
    """Feed dates: RFC-822 with or without weekday, else ISO-8601; null when unreadable."""
    bare = F.regexp_replace(strip(text), r"^[A-Za-z]{3,9},?\s+|^[A-Za-z]{3,9},", "")
    # The optional parts in full: seconds, and years of two digits, 69 and up in the last century.
    timed = F.regexp_replace(F.trim(bare), r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d+\s+\d{1,2}:\d{2})(\s|$)", "$1:00$2")
    dated = F.regexp_replace(timed, r"^(\d{1,2}\s+[A-Za-z]{3}\s+)([0-5]\d|6[0-8])(\s)", "$120$2$3")
    whole = F.regexp_replace(dated, r"^(\d{1,2}\s+[A-Za-z]{3}\s+)(\d{2})(\s)", "$119$2$3")
    whole = F.regexp_replace(whole, r"\s+", " ")
    return F.coalesce(
        F.try_to_timestamp(whole, F.lit("d MMM yyyy H:mm:ss Z")),
        F.try_to_timestamp(whole, F.lit("d MMM yyyy H:mm:ss z")),
        F.try_to_timestamp(strip(text)),
    )


def word_set(folded: Column) -> Column:
    """Content words of a folded headline, sorted and distinct, so that equal sets compare equal."""
    found = F.regexp_extract_all(F.lower(folded), F.lit("[a-z0-9]+"), F.lit(0))
    return F.sort_array(
        F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))
    )


def _nfkc():
    # Defined inside a function so that it ships to the workers by value.
    def fold(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(fold, T.StringType())


# ASCII and the precomposed letters of Latin-1 are their own NFKC form.
_MAY_FOLD = r"[^\x00-\x7FÀ-ÿ]"


def may_fold(text: Column) -> Column:
    """Whether Unicode folding could change the text; false for a null."""
    return F.coalesce(text.rlike(_MAY_FOLD), F.lit(False))


def with_word_set(df: DataFrame, title: str, into: str = "tokens") -> DataFrame:
    """Add the fingerprint of ``title``.

    Unicode folding has no Spark function, so it is the one Python step. Only rows holding a
    character that folding can change pass through it; all others stay in the JVM.
    """
    folds = may_fold(F.col(title))
    plain = df.filter(~folds).withColumn(into, word_set(F.col(title)))
    folded = (
        df.filter(folds)
        .withColumn("_folded", _nfkc()(F.col(title)))
        .withColumn(into, word_set(F.col("_folded")))
        .drop("_folded")
    )
    return plain.unionByName(folded)
