"""Batch scoring with a caller-supplied scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import capped_gist
from newsloom.schema import BEATS, CATEGORIES

BATCH_SIZE = 20

SCORE_COLUMNS = "uid string, category string, relevance double, is_promo int, gist string, beat string"


def payload(items: DataFrame, entities: DataFrame | None = None, text_chars: int | None = None) -> DataFrame:
    """What a scorer sees of an item: no section hint, no earlier score.

    ``entities``: uid, statement — ownership lines of the entities an item names, ordered by
    ``mention_rank``. ``text_chars`` is the caller's limit on the text, for scorers billed by
    length; without it the whole text goes along.
    """
    text = F.coalesce("raw_text", F.lit(""))
    base = items.select(
        "uid",
        F.col("source_name").alias("source"),
        "title",
        (text if text_chars is None else F.substring(text, 1, text_chars)).alias("text"),
        F.date_format("published_at", "yyyy-MM-dd").alias("published"),
    )
    if entities is None:
        return base
    lines = entities.groupBy("uid").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("mention_rank", "statement"))), lambda s: s["statement"]
        ).alias("entities")
    )
    return base.join(lines, "uid", "left")


def score(
    items: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Run ``scorer`` on batches of payload rows inside the tasks that hold them.

    The scorer gets up to ``batch_size`` rows and returns verdicts. A batch that raises gives its
    uids back with an error instead of ending the job. Verdicts for uids that were not in the
    batch are marked unknown, and uids left out are marked omitted, so every item is accounted for.
    """

    columns = ["uid", "category", "relevance", "is_promo", "gist", "beat"]

    def plain(frame: pd.DataFrame, outcome) -> pd.DataFrame:
        # Plain object columns convert to Arrow whatever string type pandas chose.
        return frame.reindex(columns=columns).assign(outcome=outcome).astype(object).where(lambda f: f.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in batches:
            for start in range(0, len(chunk), batch_size):
                batch = chunk.iloc[start : start + batch_size]
                asked = set(batch["uid"])
                try:
                    out = scorer(batch)
                    outcome = ["scored" if uid in asked else "unknown" for uid in out["uid"]]
                    verdicts = plain(out, outcome)
                except Exception as exc:  # one failed call costs its batch, not the job
                    yield plain(batch[["uid"]], "failed: " + str(exc))
                    continue
                yield verdicts
                left = batch.loc[~batch["uid"].isin(set(out["uid"])), ["uid"]]
                if len(left):
                    yield plain(left, "omitted")

    return items.mapInPandas(run, SCORE_COLUMNS + ", outcome string")


def verdict_problem() -> Column:
    """Why a verdict cannot be stored; null for a good one."""
    category, beat = F.col("category"), F.col("beat")
    return (
        F.when(F.col("outcome") != "scored", F.col("outcome"))
        .when(~F.coalesce(F.col("relevance").between(0.0, 1.0), F.lit(False)), "relevance not in [0, 1]")
        .when(F.col("gist").isNull(), "no gist")
        .when(~F.coalesce(category.isin(CATEGORIES), F.lit(True)), "unknown category")
        .when(~F.coalesce(beat.isin(BEATS), F.lit(True)), "unknown beat")
    )


def valid_verdicts(scored: DataFrame) -> DataFrame:
    """Verdicts fit to store: known uid, relevance within [0, 1], closed vocabularies respected."""
    return (
        scored.filter(verdict_problem().isNull())
        .withColumn("gist", F.coalesce(capped_gist(F.col("gist")), F.lit("")))
        .drop("outcome")
    )


def rejected_verdicts(scored: DataFrame) -> DataFrame:
    """The verdicts that `valid_verdicts` leaves out, each with its reason."""
    return scored.withColumn("reject_reason", verdict_problem()).filter("reject_reason IS NOT NULL")
