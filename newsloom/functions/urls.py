"""URL identity and click-tracker unwrapping, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import strip
from newsloom.schema import literal_array

# Query parameters that name the referrer, not the resource.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid",
    "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source",
]

# Hosts that only count clicks.
TRACKER_HOSTS = [
    "list-manage.com", "sendgrid.net", "mailchimp.com", "cmail1.com",
    "cmail2.com", "hubspotlinks.com", "constantcontact.com", "mailgun.org",
    "sparkpostmail.com", "exacttarget.com", "salesforce-communications.com",
    "campaign-archive.com", "rs6.net", "bit.ly", "trk.klclick.com",
]

# Parameters of a tracker link that hold the real target.
DESTINATION_PARAMS = ["url", "u", "target", "redirect", "redirect_url", "link", "dest", "r"]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def is_absolute_http(url: Column) -> Column:
    """True for an http(s) URL with a host; never null."""
    return F.coalesce(strip(url).rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def _decode(text: Column) -> Column:
    # A stray % is literal text, so it is escaped before decoding.
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_params(url: Column) -> Column:
    """Decoded parameters in URL order: ARRAY<STRUCT<key, value>>, blank values kept."""
    pieces = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("key"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=?(.*)$", 1)).alias("value"),
        ),
    )


def canonical_url(url: Column) -> Column:
    """One spelling per resource: case, fragment, trailing slash and referrer parameters removed."""
    clean = strip(url)
    kept = F.filter(query_params(clean), lambda p: ~F.lower(p["key"]).isin(TRACKING_PARAMS))
    query = F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&"
    )
    query = F.when(_part(clean, 4) == "", "").otherwise(query)
    path = F.regexp_replace(_part(clean, 3), "/+$", "")
    return F.when(
        is_absolute_http(url),
        F.concat(
            scheme(clean),
            F.lit("://"),
            netloc(clean),
            F.when(path == "", "/").otherwise(path),
            F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def item_uid(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 16)


def is_tracker(url: Column, hosts: list[str] = TRACKER_HOSTS) -> Column:
    """Host equal to, or a subdomain of, a listed one: every suffix of the host is looked up."""
    suffixes = let(
        F.split(netloc(url), r"\."),
        lambda labels: F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )
    return F.arrays_overlap(suffixes, literal_array(hosts))


def unwrap_tracker(url: Column) -> Column:
    """Target behind a click tracker, the URL itself elsewhere, null when the target is not in it."""
    targets = F.filter(
        query_params(url),
        lambda p: F.lower(p["key"]).isin(DESTINATION_PARAMS) & p["value"].rlike("^https?://"),
    )
    return F.when(is_tracker(url), F.get(targets, F.lit(0))["value"]).otherwise(url)


def resolve_url(base: Column, href: Column) -> Column:
    """A link found on a page, made absolute."""
    origin = F.concat(scheme(base), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    path_only = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.regexp_extract(href, r"(?s)[?#].*$", 0)
    joined = F.when(F.startswith(href, F.lit("/")), path_only).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), path_only)
    )
    segments = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, s)),
    )
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, _part(base, 3), href))
        .when(
            (href == "") | F.startswith(href, F.lit("#")),
            F.concat(F.regexp_replace(base, "#.*$", ""), href),
        )
        .otherwise(F.concat(origin, F.array_join(segments, "/"), tail))
    )
