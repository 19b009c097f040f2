"""From landed items to a laid-out issue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clip
from newsloom.operators.aggregates import dedupe_newest
from newsloom.operators.gates import recent
from newsloom.operators.joins import apply_scores, unseen
from newsloom.operators.ranking import (
    relevance_order,
    resource_slot,
    section_lead,
    sectioned,
    with_position,
)
from newsloom.operators.similar import SIMILARITY_THRESHOLD, BlockBudget, collapse_similar, kept_with_counts
from newsloom.schema import RECENCY_DAYS, RELEVANCE_THRESHOLD
from newsloom.session import materialize


@dataclass(frozen=True)
class IssueRules:
    days: int = RECENCY_DAYS
    threshold: float = RELEVANCE_THRESHOLD
    similarity: float = SIMILARITY_THRESHOLD
    keep_unscored: bool = False
    collapse: bool = True
    budget: BlockBudget = field(default_factory=BlockBudget)


def candidates(items: DataFrame, seen: DataFrame, now: Column, rules: IssueRules) -> DataFrame:
    """New, recent items. The recency filter runs before the joins so that it reaches the scan."""
    return unseen(dedupe_newest(recent(items, now, rules.days)), seen)


def ranked(
    fresh: DataFrame,
    scores: DataFrame,
    community_sources: DataFrame,
    picks: DataFrame | None,
    rules: IssueRules,
) -> DataFrame:
    """Picks first, then scored items by relevance, near-duplicates collapsed, numbered from 1."""
    scored = apply_scores(fresh, scores, community_sources, rules.threshold, rules.keep_unscored)
    scored = scored.withColumn("is_pick", F.lit(False))
    pool = scored if picks is None else picks.withColumn("is_pick", F.lit(True)).unionByName(scored, allowMissingColumns=True)
    order = [F.col("is_pick").desc(), *relevance_order()]
    numbered = with_position(pool, [], order)
    if not rules.collapse:
        return numbered.withColumn("similar", F.lit(None).cast("bigint"))
    decided = collapse_similar(numbered, "position", "title", rules.similarity, rules.budget)
    # Layout, resource slot and archive all read the issue, which is small by now.
    return materialize(kept_with_counts(numbered, decided, "position"), "issue")


def lay_out(issue: DataFrame) -> DataFrame:
    """Section every item in page order; the promoted video is in the section ``Resource``."""
    keyed = issue.withColumn("_issue", F.lit(1))
    resource = resource_slot(keyed, ["_issue"], "position").select("position")
    body = sectioned(issue, resource, "position")
    promoted = (
        issue.join(resource, "position", "left_semi")
        .withColumn("section", F.lit("Resource"))
        .withColumn("section_order", F.lit(99))
    )
    return body.unionByName(promoted)


def summaries(items: DataFrame, groups: list[str], position: str = "position") -> DataFrame:
    """One line per issue: item and outlet counts and the top item, with plural forms."""
    counted = items.groupBy(*groups).agg(
        F.count("*").alias("items"),
        F.count_distinct("source_name").alias("outlets"),
        F.min_by("title", position).alias("_lead"),
    )

    def plural(n: str, noun: str) -> Column:
        return F.concat(F.col(n), F.lit(f" {noun}"), F.when(F.col(n) == 1, "").otherwise("s"))

    return counted.withColumn("lead", clip(F.col("_lead"), 90)).withColumn(
        "description",
        F.concat(
            plural("items", "item"), F.lit(" from "), plural("outlets", "outlet"),
            F.lit(", led by “"), F.col("lead"), F.lit("”"),
        ),
    ).drop("_lead")


def archive_entries(items: DataFrame, groups: list[str], position: str = "position") -> DataFrame:
    """Archive index rows: counts of the whole issue, lead of what the page shows first."""
    counted = items.groupBy(*groups).agg(
        F.count("*").alias("items"), F.count_distinct("source_name").alias("outlets")
    )
    layout = sectioned(items, resource_slot(items, groups))
    return counted.join(section_lead(layout, groups, position), groups, "left").withColumn(
        "lead", F.coalesce("lead", F.lit(""))
    )
