"""Keyed joins: history, scores, allowlists, hierarchies.

No side carries a broadcast hint. The planner broadcasts a side whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise, splitting skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import capped_gist, two_decimals
from newsloom.schema import RELEVANCE_THRESHOLD


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    return items.join(seen.select("uid"), "uid", "left_anti")


def split_published(picks: DataFrame, published: DataFrame) -> DataFrame:
    """Flag picks that already ran, so that accepted and rejected come out of one pass."""
    flags = published.select("uid").distinct().withColumn("already_published", F.lit(True))
    return picks.join(flags, "uid", "left").withColumn(
        "already_published", F.coalesce("already_published", F.lit(False))
    )


def score_version(ledger: DataFrame, prompt_hash: str, model: str) -> DataFrame:
    """One (prompt, model) slice; the ledger is partitioned by prompt, so others are not read."""
    return ledger.filter((F.col("prompt_hash") == prompt_hash) & (F.col("model") == model))


def apply_scores(
    items: DataFrame,
    scores: DataFrame,
    community_sources: DataFrame,
    threshold: float = RELEVANCE_THRESHOLD,
    keep_unscored: bool = False,
) -> DataFrame:
    """Keep what the scorer would publish and take over its verdicts.

    ``items``: uid, source_id, ... ; ``scores``: uid, relevance, category, is_promo, gist, beat;
    ``community_sources``: source_id of outlets that speak for the community, whose section wins
    over the scored one. Relevance is put on the two-decimal grid, the ranking grain. Of several
    verdicts on a uid the newest by scored_at counts, where there is one, else the highest.
    """
    newest = [c for c in ("scored_at", "relevance", "category", "gist") if c in scores.columns]
    one = scores.groupBy("uid").agg(F.max_by(F.struct(*scores.columns), F.struct(*newest)).alias("_v")).select("_v.*")
    verdict = one.select(
        "uid",
        F.lit(True).alias("_scored"),
        F.col("category").alias("_category"),
        "relevance",
        "is_promo",
        capped_gist(F.col("gist")).alias("gist"),
        "beat",
    )
    dropped = ["category", "relevance", "is_promo", "gist", "beat"]
    hint = F.col("_hint") if "category" in items.columns else F.lit(None).cast("string")
    base = items.withColumnRenamed("category", "_hint").drop(*dropped)
    good = (
        F.col("_category").isNotNull()
        & (F.col("is_promo") == 0)
        & (F.col("relevance") >= threshold)
    )
    keep = (F.col("_scored") & good) | (F.col("_scored").isNull() & F.lit(keep_unscored))
    community = community_sources.select("source_id").distinct().withColumn("_community", F.lit(True))
    return (
        base.join(verdict, "uid", "left" if keep_unscored else "inner")
        .filter(keep)
        .join(community, "source_id", "left")
        .withColumn(
            "category",
            F.when(F.col("_scored").isNull(), hint)
            .when(F.col("_community"), F.lit("Community"))
            .otherwise(F.col("_category")),
        )
        .withColumn("relevance", two_decimals(F.col("relevance")))
        .drop("_scored", "_category", "_community", "_hint")
    )


def allowed_senders(messages: DataFrame, allow: DataFrame, sender: str = "sender") -> DataFrame:
    """Case-insensitive allowlist; an empty list refuses everything."""
    names = allow.select(F.lower("sender").alias("_key")).distinct()
    return (
        messages.withColumn("_key", F.lower(sender)).join(names, "_key", "left_semi").drop("_key")
    )


def with_durations(items: DataFrame, durations: DataFrame, key: str = "video_id") -> DataFrame:
    """Items with ``duration_s``; null where a video's duration is not known. ``durations``: key, duration_s.

    Of several durations of a video the longest counts, so no item is doubled.
    """
    one = durations.groupBy(key).agg(F.max("duration_s").alias("duration_s"))
    return items.join(one, key, "left")


def missing_verdicts(labels: DataFrame, version: DataFrame) -> DataFrame:
    return labels.join(version.select("uid"), "uid", "left_anti")


def score_drift(old: DataFrame, new: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """Full outer join of two score versions and what changed for each item."""
    a = old.select("uid", F.col("relevance").alias("old_relevance"))
    b = new.select("uid", F.col("relevance").alias("new_relevance"))
    was, now = F.col("old_relevance") >= threshold, F.col("new_relevance") >= threshold
    return a.join(b, "uid", "full").withColumn(
        "change",
        F.when(F.col("new_relevance").isNull(), "dropped")
        .when(F.col("old_relevance").isNull(), "added")
        .when(was & ~now, "demoted")
        .when(~was & now, "promoted")
        .otherwise("steady"),
    )


def orphans(entities: DataFrame) -> DataFrame:
    """Rows whose parent is not in the table."""
    ids = entities.select(F.col("entity_id").alias("parent"))
    return entities.filter(F.col("parent").isNotNull()).join(ids, "parent", "left_anti")


def labelled_scores(labels: DataFrame, scores: DataFrame, items: DataFrame) -> DataFrame:
    """Labels of known items beside their score; a null relevance means never scored."""
    return labels.join(items.select("uid", "title", "source_id", "seq"), "uid").join(
        scores.select("uid", "relevance"), "uid", "left"
    )
