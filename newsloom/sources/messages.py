"""Raw newsletter messages: headers, nested parts and their encodings, in built-in expressions.

Messages are text as transferred: a head, an empty line, a body. Parts are cut at their boundary level by
level, so a message nested to `DEPTH` is flat after as many passes, each inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import rfc822_timestamp
from newsloom.sources.pages import harvest_links

#: Multiparts inside multiparts that are opened; deeper ones are not read.
DEPTH = 4

_ENCODED = r"=\?[^?\s]+\?[BbQq]\?[^?\s]*\?="

# Names of character sets, by how they are read.
LATIN = ["iso-8859-1", "latin1", "latin-1", "iso8859-1", "windows-1252", "cp1252"]


def header(head: Column, name: str) -> Column:
    """A header's value on one line, empty if there is none; the first of several."""
    unfolded = F.regexp_replace(head, r"\r?\n[ \t]+", " ")
    return F.regexp_extract(unfolded, rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)


def from_bytes(data: Column, charset: Column) -> Column:
    """Text of bytes: Latin-1 by its names, else UTF-8 with broken sequences replaced."""
    return F.when(F.lower(charset).isin(LATIN), F.decode(data, "ISO-8859-1")).otherwise(
        F.make_valid_utf8(data.cast("string"))
    )


def quoted_printable(text: Column) -> Column:
    """Bytes of quoted-printable text. An equals sign without two hex digits stands for itself."""
    joined = F.regexp_replace(text, r"=[ \t]*\r?\n", "")

    def piece(p: Column, i: Column) -> Column:
        coded = p.rlike("^[0-9A-Fa-f]{2}")
        return F.when(i == 0, F.hex(p)).when(coded, F.concat(F.upper(F.substring(p, 1, 2)), F.hex(F.substr(p, F.lit(3))))).otherwise(
            F.concat(F.lit("3D"), F.hex(p))
        )

    return F.unhex(F.array_join(F.transform(F.split(joined, "="), piece), ""))


def base64_bytes(text: Column) -> Column:
    """Bytes of base64 text, line breaks aside; null if it is none."""
    return F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64"))


def decoded_words(value: Column) -> Column:
    """A header value with its encoded words decoded; white space between two of them is no part of the text.

    A word that cannot be decoded stays as written.
    """
    pieces = F.regexp_extract_all(
        F.regexp_replace(value, rf"({_ENCODED})\s+(?={_ENCODED})", "$1"),
        F.lit(rf"{_ENCODED}|(?:(?!{_ENCODED})[\s\S])+"), F.lit(0),
    )

    def plain(p: Column) -> Column:
        part = lambda i: F.regexp_extract(p, r"=\?([^?\s]+)\?([BbQq])\?([^?\s]*)\?=", i)
        data = F.when(F.lower(part(2)) == "b", base64_bytes(part(3))).otherwise(quoted_printable(F.replace(part(3), F.lit("_"), F.lit(" "))))
        return F.when(p.rlike(f"^{_ENCODED}$"), F.coalesce(from_bytes(data, part(1)), p)).otherwise(p)

    return F.trim(F.array_join(F.transform(pieces, plain), ""))


def entity(text: Column) -> Column:
    """struct(head, body) of a message or part, cut at its first empty line."""
    halves = F.split(text, r"^\r?\n|\r?\n\r?\n", 2)
    return F.struct(F.get(halves, F.lit(0)).alias("head"), F.coalesce(F.get(halves, F.lit(1)), F.lit("")).alias("body"))


def is_multipart(part: Column) -> Column:
    return F.lower(header(part["head"], "Content-Type")).startswith("multipart/") & (boundary(part) != "")


def boundary(part: Column) -> Column:
    kind = header(part["head"], "Content-Type")
    quoted = F.regexp_extract(kind, r'(?i)boundary="([^"]+)"', 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(kind, r"(?i)boundary=([^\s;\"]+)", 1))


def children(part: Column) -> Column:
    """The entities between a multipart's boundary lines; what stands before the first and after the last is no part."""
    line = F.concat(F.lit(r"\r?\n--\Q"), boundary(part), F.lit(r"\E(?=[ \t]*(?:\r?\n|$)|--)"))
    pieces = F.split(F.concat(F.lit("\n"), part["body"]), line)

    def inside(p: Column) -> Column:
        ends = F.transform(p, lambda x, i: F.when((i > 0) & x.startswith("--"), i))
        last = F.coalesce(F.array_min(F.filter(ends, lambda i: i.isNotNull())), F.size(p))
        return F.slice(p, F.lit(2), F.greatest(last - 1, F.lit(0)))

    return F.transform(let(pieces, inside), lambda x: entity(F.regexp_replace(x, r"^[ \t]*\r?\n", "")))


def leaves(raw: Column) -> Column:
    """All parts of a message that are no multipart, in order."""
    parts = F.array(entity(raw))
    for _ in range(DEPTH):
        parts = F.flatten(F.transform(parts, lambda p: F.when(is_multipart(p), children(p)).otherwise(F.array(p))))
    return F.filter(parts, lambda p: ~is_multipart(p))


def part_text(part: Column) -> Column:
    """struct(html, text) of a part: text is null where the part is no text or its encoding is broken."""
    kind, way = F.lower(header(part["head"], "Content-Type")), F.lower(header(part["head"], "Content-Transfer-Encoding"))
    charset = F.regexp_extract(kind, r'charset="?([^\s;"]+)', 1)
    data = (
        F.when(way == "base64", base64_bytes(part["body"]))
        .when(way == "quoted-printable", quoted_printable(part["body"]))
    )
    plain = F.when(way.isin("base64", "quoted-printable"), from_bytes(data, charset)).otherwise(part["body"])
    textual = (kind == "") | kind.startswith("text/")
    return F.struct(kind.startswith("text/html").alias("html"), F.when(textual, plain).alias("text"))


def parse_messages(messages: DataFrame, key: str = "message_id", raw: str = "raw") -> DataFrame:
    """key, sender, subject, published_at, html, reason per message.

    ``html`` is the text of all HTML parts, of the plain ones if there is none, joined by line breaks.
    ``sender`` is the bare address in lower case. ``reason`` says why a message cannot be used, null if
    it can: no sender, no usable date, or no readable body. A null message has no sender.
    """
    one = messages.select(F.col(key), F.coalesce(F.col(raw), F.lit("")).alias("_raw"))
    parts = one.select(key, entity(F.col("_raw"))["head"].alias("_head"), F.transform(leaves(F.col("_raw")), part_text).alias("_parts"))
    said = header(F.col("_head"), "From")
    bare = F.regexp_extract(said, r"<([^<>]*)>", 1)
    address = F.lower(F.trim(F.when(bare != "", bare).otherwise(said)))
    texts = lambda html: F.transform(
        F.filter("_parts", lambda p: (p["html"] == html) & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"]
    )
    body = F.when(F.size(texts(True)) > 0, F.array_join(texts(True), "\n")).otherwise(F.array_join(texts(False), "\n"))
    read = parts.select(
        key,
        F.when(address.contains("@"), address).alias("sender"),
        decoded_words(header(F.col("_head"), "Subject")).alias("subject"),
        rfc822_timestamp(header(F.col("_head"), "Date")).alias("published_at"),
        F.nullif(body, F.lit("")).alias("html"),
    )
    return read.withColumn(
        "reason",
        F.when(F.col("sender").isNull(), "no sender")
        .when(F.col("published_at").isNull(), "no usable date")
        .when(F.col("html").isNull(), "no readable body"),
    )


def harvest_messages(messages: DataFrame, allow: DataFrame, key: str = "message_id", raw: str = "raw", **how) -> DataFrame:
    """Stories that messages of allowed senders link to: key, url, link_pos, title, sender, subject, published_at.

    ``allow``: sender. An empty list allows nobody. Unusable messages give none.
    """
    names = allow.select(F.lower("sender").alias("sender")).distinct()
    good = parse_messages(messages, key, raw).filter(F.col("reason").isNull()).join(names, "sender", "left_semi")
    links = harvest_links(good.select(key, "html"), key, **how)
    return links.join(good.drop("html", "reason"), key)
