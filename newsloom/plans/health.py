"""Source health: liveness of registered feeds beside feeds newly found on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.aggregates import liveness
from newsloom.schema import STALE_DAYS
from newsloom.sources.pages import discover_feeds


def health_report(
    registry: DataFrame,
    entries: DataFrame,
    pages: DataFrame,
    now: Column,
    stale_days: int = STALE_DAYS,
    problems: DataFrame | None = None,
) -> DataFrame:
    """target, verdict, detail, entries: one row per source, found feed, or page without one.

    ``problems``: source_id, problem, of sources whose body could not be used (`body_problems`). An
    unusable answer is an error, not a quiet source.
    """
    known = liveness(registry, entries, now, stale_days).select(
        F.col("source_id").alias("target"),
        "verdict",
        F.when(F.col("entries") == 0, "has no entries")
        .when(F.col("newest_age").isNull(), "unknown age")
        .otherwise(F.concat(F.lit("newest "), "newest_age", F.lit("d old")))
        .alias("detail"),
        "entries",
    )
    if problems is not None:
        worst = problems.groupBy(F.col("source_id").alias("_id")).agg(F.min("problem").alias("_problem"))
        failed = F.col("_problem").isNotNull()
        known = known.join(worst, F.col("target") == F.col("_id"), "left").select(
            "target",
            F.when(failed, "error").otherwise(F.col("verdict")).alias("verdict"),
            F.when(failed, F.col("_problem")).otherwise(F.col("detail")).alias("detail"),
            "entries",
        )
    found = discover_feeds(pages)
    feeds = (
        found.filter(F.col("feed_url").isNotNull())
        .groupBy(F.col("feed_url").alias("target"))
        .agg(F.count_distinct("page_id").alias("n"))
        .select(
            "target",
            F.lit("discovered").alias("verdict"),
            F.concat(F.lit("advertised by "), "n", F.lit(" page(s)")).alias("detail"),
            F.lit(0).cast("bigint").alias("entries"),
        )
    )
    dead_ends = (
        found.filter(F.col("feed_url").isNull())
        .join(pages.select("page_id", "url"), "page_id")
        .select(
            F.col("url").alias("target"),
            F.lit("no-feed").alias("verdict"),
            F.col("note").alias("detail"),
            F.lit(0).cast("bigint").alias("entries"),
        )
    )
    return known.unionByName(feeds).unionByName(dead_ends)
