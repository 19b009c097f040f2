"""How well scores agree with editors' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.aggregates import spearman
from newsloom.schema import BUCKETS, KEEP_BUCKETS, RELEVANCE_THRESHOLD, ordinal
from newsloom.session import materialize

PRECISION_DEPTHS = (10, 20)


def outcome(label: Column, relevance: Column, threshold: float = RELEVANCE_THRESHOLD) -> Column:
    """Class of one labelled item. Only leads missed and drops admitted are certain errors."""
    above = relevance >= threshold
    return (
        F.when(relevance.isNull(), "unscored")
        .when(label == "borderline", "borderline")
        .when((label == "lead") & ~above, "lead_missed")
        .when((label == "drop") & above, "drop_admitted")
        .when((label == "include") & ~above, "include_below")
        .otherwise("agreed")
    )


def outcome_counts(rows: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    return (
        rows.groupBy(outcome(F.col("bucket"), F.col("relevance"), threshold).alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


def precision_at(rows: DataFrame, depths: tuple[int, ...] = PRECISION_DEPTHS) -> DataFrame:
    """Hits among the top k scored items; ``considered`` is what was there, at most k.

    Only the deepest list is ever sorted: a top-k, merged from per-task heaps.
    """
    deepest = max(depths)
    top = (
        rows.filter(F.col("relevance").isNotNull())
        .select("relevance", "seq", "bucket")
        .orderBy(F.col("relevance").desc(), F.col("seq"))
        .limit(deepest)
    )
    # At most `deepest` rows are left, so one task may number them.
    numbered = top.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col("relevance").desc(), F.col("seq")))
    )
    wanted = F.explode(F.array(*[F.lit(k) for k in depths])).alias("k")
    return (
        numbered.select(wanted, "_rank", "bucket")
        .filter(F.col("_rank") <= F.col("k"))
        .groupBy("k")
        .agg(
            F.count_if(F.col("bucket").isin(KEEP_BUCKETS)).alias("hits"),
            F.count("*").alias("considered"),
        )
        .withColumn("precision", F.col("hits") / F.col("considered"))
    )


def errors_by_source(rows: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    wrong = outcome(F.col("bucket"), F.col("relevance"), threshold).isin("lead_missed", "drop_admitted")
    return rows.filter(wrong).groupBy("source_id").agg(F.count("*").alias("errors"))


def agreement(rows: DataFrame) -> DataFrame:
    """Rank agreement of relevance with the label scale over scored rows."""
    return spearman(rows.withColumn("_label", ordinal(F.col("bucket"), BUCKETS)), "relevance", "_label")


def report(rows: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """All metrics as (metric, value) rows. ``rows``: uid, seq, source_id, bucket, relevance."""
    rows = materialize(rows.select("uid", "seq", "source_id", "bucket", "relevance"), "labelled")
    counts = outcome_counts(rows, threshold).select(
        F.concat(F.lit("n_"), "outcome").alias("metric"), F.col("n").cast("double").alias("value")
    )
    precision = precision_at(rows).select(
        F.concat(F.lit("precision_at_"), F.col("k")).alias("metric"), F.col("precision").alias("value")
    )
    rho = agreement(rows)
    return (
        counts.unionByName(precision)
        .unionByName(rho.select(F.lit("scored").alias("metric"), F.col("n").cast("double").alias("value")))
        .unionByName(rho.select(F.lit("rho").alias("metric"), F.col("rho").alias("value")))
    )


def admission_rates(rows: DataFrame) -> DataFrame:
    """Share admitted by editors, borderline aside, per source and overall."""
    judged = rows.filter(F.col("bucket") != "borderline")
    return (
        judged.rollup("source_id")
        .agg(
            F.count_if(F.col("bucket").isin(KEEP_BUCKETS)).alias("admitted"),
            F.count("*").alias("judged"),
            F.grouping("source_id").alias("_all"),
        )
        .withColumn("source_id", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("source_id")))
        .withColumn("rate", F.col("admitted") / F.col("judged"))
        .drop("_all")
    )


def score_histogram(scores: DataFrame) -> DataFrame:
    """Scores in tenths, with the exact zeros counted on the side."""
    return scores.groupBy(F.bround("relevance", 1).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col("relevance") == 0).alias("exact_zeros")
    )
