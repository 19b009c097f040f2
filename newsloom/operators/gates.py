"""Row filters and verdict columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import blank_to_null
from newsloom.functions.urls import is_absolute_http
from newsloom.schema import (
    BEATS,
    COMMUNITY_TYPES,
    RECENCY_DAYS,
    RELEVANCE_THRESHOLD,
    SHORTS_MAX_SECONDS,
    ordinal,
)


def attribution_verdict(title: Column, source: Column, url: Column) -> Column:
    """Why a row cannot be credited, or null when it can."""
    return (
        F.when(blank_to_null(title).isNull(), "missing title")
        .when(blank_to_null(source).isNull(), "missing source")
        .when(~is_absolute_http(url), "unresolvable url")
    )


def creditable(items: DataFrame) -> DataFrame:
    return items.filter(
        attribution_verdict(F.col("title"), F.col("source_name"), F.col("url")).isNull()
    )


def require_creditable(items: DataFrame) -> DataFrame:
    """The publish boundary: the job fails on the first uncredited row instead of dropping it."""
    verdict = attribution_verdict(F.col("title"), F.col("source_name"), F.col("url"))
    return items.filter(
        F.assert_true(verdict.isNull(), F.concat(F.lit("uncreditable item: "), F.col("url"))).isNull()
    )


def newest(items: DataFrame, when: str = "published_at") -> Column:
    """The latest timestamp of a table as a scalar subquery, the usual stand-in for "now"."""
    return items.agg(F.max(when)).scalar()


def recent(items: DataFrame, now: Column, days: int = RECENCY_DAYS, when: str = "published_at") -> DataFrame:
    """Items no older than ``days`` exactly; ``days <= 0`` keeps all."""
    if days <= 0:
        return items
    return items.filter(F.col(when) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def newest_first(items: DataFrame, n: int, when: str = "published_at", order: str = "seq") -> DataFrame:
    """The item cap: the first ``n`` by time, newest first, the earliest position on ties."""
    return items.orderBy(F.col(when).desc_nulls_last(), F.col(order)).limit(n)


def publishable(threshold: float = RELEVANCE_THRESHOLD) -> Column:
    return F.col("category").isNotNull() & (F.col("is_promo") == 0) & (F.col("relevance") >= threshold)


def headline_length_ok(title: Column, low: int = 25, high: int = 180) -> Column:
    return F.length(title).between(low, high)


def drop_shorts(
    videos: DataFrame, durations: DataFrame, key: str, max_seconds: int = SHORTS_MAX_SECONDS
) -> DataFrame:
    """Join looked-up lengths and drop the short ones.

    An unknown length keeps its video. When no length at all was resolved nothing is dropped,
    which the same rule gives for free: every length is then null.
    """
    return videos.join(durations, key, "left").filter(
        F.col("duration_s").isNull() | (F.col("duration_s") > max_seconds)
    )


def label_eligible(items: DataFrame, days: int = RECENCY_DAYS) -> DataFrame:
    """Items first seen while still inside the recency window."""
    return items.filter(
        F.timestamp_diff("SECOND", F.col("published_at"), F.col("first_seen_at")) <= days * 86400
    )


def beat_ordinal(beat: Column) -> Column:
    return ordinal(beat, BEATS)


def is_community(kind: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | kind.isin(COMMUNITY_TYPES)


def display_name(name: Column, section: Column) -> Column:
    return F.concat_ws(" — ", name, F.nullif(section, F.lit("")))


def byline(author: Column, outlet: Column) -> Column:
    return F.nullif(author, outlet)
