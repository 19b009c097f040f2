"""Closed vocabularies and table types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sections in page order.
CATEGORIES = [
    "Community",
    "Industry & Products",
    "Husbandry & Science",
    "Livestock & Corals",
    "Wild Reefs",
    "Events",
]
UNCATEGORISED = "Elsewhere"

# Style slugs of the sections above.
CATEGORY_SLUGS = ["community", "industry", "husbandry", "livestock", "wild-reefs", "events"]

# Industry beats in editorial priority.
BEATS = [
    "Ownership",
    "Leadership",
    "Distribution",
    "Product",
    "Safety",
    "Manufacturing",
    "Financial",
]

# Feed dialects, and those whose outlets are always the community itself.
SOURCE_TYPES = [
    "wordpress",
    "xenforo",
    "youtube",
    "youtube_api",
    "reddit",
    "bluesky",
    "imap",
    "openalex",
    "generic",
]
COMMUNITY_TYPES = ["youtube", "youtube_api", "xenforo", "reddit"]

# Label buckets from worst to best, and those that mean "belongs in the issue".
BUCKETS = ["drop", "borderline", "include", "lead"]
KEEP_BUCKETS = ["lead", "include"]

# Publishing rules.
RELEVANCE_THRESHOLD = 0.45
GIST_MAX_WORDS = 40
RECENCY_DAYS = 7
STALE_DAYS = 60
SHORTS_MAX_SECONDS = 180

SEEN_SCHEMA = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("category", T.StringType()),
        T.StructField("first_seen_date", T.DateType()),
    ]
)


def ordinal(value: Column, members: list[str]) -> Column:
    """Position of ``value`` in a closed list, from 1; null when it is not a member."""
    return F.nullif(F.array_position(F.array(*map(F.lit, members)), value), F.lit(0)).cast("int")


def category_ordinal(value: Column) -> Column:
    """Section order; a missing category sorts after every named one."""
    return F.coalesce(ordinal(value, CATEGORIES), F.lit(len(CATEGORIES) + 1))


def literal_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))
