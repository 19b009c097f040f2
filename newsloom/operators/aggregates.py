"""Grouped computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from newsloom.schema import STALE_DAYS, category_ordinal
from newsloom.session import materialize

VOLUME_WINDOWS = (7, 14, 30)
ALL = "ALL"


def dedupe_newest(items: DataFrame, key: str = "uid", order: str = "seq") -> DataFrame:
    """The newest row of each key, the earliest input position on ties.

    An aggregate, not a window: copies of one key collapse inside each map task, so a key that
    holds a large share of the rows never meets in one place. Rows without a key cannot be copies
    of each other and all stay.
    """
    best = F.max_by(F.struct(*items.columns), F.struct(F.col("published_at"), -F.col(order)))
    known = items.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_row")).select("_row.*")
    return known.unionByName(items.filter(F.col(key).isNull()))


def whole_days(now: Column, then: Column) -> Column:
    """Days between two timestamps, floored (also below zero)."""
    return F.floor(F.timestamp_diff("MICROSECOND", then, now) / F.lit(86_400_000_000.0)).cast("int")


def volume_report(items: DataFrame, outlet: str, when: str, now: Column) -> DataFrame:
    """Counts per outlet in the last 7, 14 and 30 days, age of the newest, and an ALL row."""
    age = whole_days(now, F.col(when))
    counts = [F.count_if(F.col("_age") <= w).alias(f"d{w}") for w in VOLUME_WINDOWS]
    aged = items.select(F.col(outlet).alias("outlet"), age.alias("_age"))
    return (
        aged.rollup("outlet")
        .agg(*counts, F.count("*").alias("total"), F.min("_age").alias("newest_age"), F.grouping("outlet").alias("_all"))
        .withColumn("outlet", F.when(F.col("_all") == 1, ALL).otherwise(F.col("outlet")))
        .drop("_all")
    )


def outlets(items: DataFrame, outlet: str = "source_name") -> DataFrame:
    """(outlet, n) in name order, a row an outlet: a single list would meet in one task."""
    return items.groupBy(outlet).agg(F.count("*").alias("n")).orderBy(outlet)


def categories_present(items: DataFrame) -> DataFrame:
    """(category, section_order) of the sections that have items, in page order."""
    named = items.select("category").filter("category IS NOT NULL").distinct()
    return named.select("category", category_ordinal(F.col("category")).alias("section_order")).orderBy("section_order")


def sender_audit(messages: DataFrame, allow: DataFrame) -> DataFrame:
    names = allow.select(F.lower("sender").alias("sender")).distinct().withColumn("_ok", F.lit(True))
    return (
        messages.groupBy(F.lower("sender").alias("sender"))
        .agg(F.count("*").alias("messages"))
        .join(names, "sender", "left")
        .select("sender", "messages", F.coalesce("_ok", F.lit(False)).alias("allowed"))
    )


def batch_audit(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Per scoring batch: matched, invented and omitted items, and whether the call failed.

    ``requested``: batch_id, uid; ``returned``: batch_id, uid, with a null uid for a failed call.
    """
    failed = F.max(F.when(F.col("_answered") & F.col("uid").isNull(), 1).otherwise(0))
    asked = requested.select("batch_id", "uid", F.lit(True).alias("_asked"))
    answered = returned.select("batch_id", "uid", F.lit(True).alias("_answered"))
    a, r = F.col("_asked").isNotNull(), F.col("_answered").isNotNull()
    return (
        asked.join(answered, ["batch_id", "uid"], "full")
        .groupBy("batch_id")
        .agg(
            F.count_if(a & r).alias("known"),
            F.count_if(~a & r & F.col("uid").isNotNull()).alias("unknown"),
            F.count_if(a & ~r).alias("omitted"),
            failed.alias("failed"),
        )
    )


# Price of cache writes and reads relative to plain input.
CACHE_WRITE_FACTOR = 1.25
CACHE_READ_FACTOR = 0.10


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Token sums, cost and cache hit rate per stage, with a total row.

    ``usage``: stage, model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens
    (any may be null); ``prices``: model, input_price, output_price per million. An unlisted
    model costs nothing.
    """
    tokens = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in tokens]
    per_model = usage.groupBy("stage", "model").agg(F.count("*").alias("calls"), *sums)
    price_in = F.coalesce("input_price", F.lit(0.0)) / 1_000_000
    price_out = F.coalesce("output_price", F.lit(0.0)) / 1_000_000
    cost = (
        F.col("input_tokens") * price_in
        + F.col("cache_write_tokens") * price_in * CACHE_WRITE_FACTOR
        + F.col("cache_read_tokens") * price_in * CACHE_READ_FACTOR
        + F.col("output_tokens") * price_out
    )
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return (
        per_model.join(prices, "model", "left")
        .withColumn("cost_usd", cost)
        .rollup("stage")
        .agg(
            F.sum("calls").alias("calls"),
            *[F.sum(c).alias(c) for c in tokens],
            F.sum("cost_usd").alias("cost_usd"),
            F.grouping("stage").alias("_all"),
        )
        .withColumn("stage", F.when(F.col("_all") == 1, "total").otherwise(F.coalesce("stage", F.lit("unknown"))))
        .drop("_all")
        .withColumn(
            "cache_hit_rate",
            F.when(prompt > 0, F.col("cache_read_tokens") / prompt).otherwise(F.lit(0.0)),
        )
    )


def liveness(registry: DataFrame, entries: DataFrame, now: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """Verdict per registered source from its entries.

    ``entries``: source_id, published_at (null = undated). Undated or old entries are stale;
    a source without entries is empty.
    """
    found = entries.groupBy("source_id").agg(
        F.count("*").alias("entries"), F.max("published_at").alias("newest_at")
    )
    age = whole_days(now, F.col("newest_at"))
    return (
        registry.select("source_id")
        .join(found, "source_id", "left")
        .withColumn("entries", F.coalesce("entries", F.lit(0)))
        .withColumn("newest_age", age)
        .withColumn(
            "verdict",
            F.when(F.col("entries") == 0, "empty")
            .when(F.col("newest_age") <= stale_days, "ok")
            .otherwise("stale"),
        )
        .drop("newest_at")
    )


def average_rank(df: DataFrame, value: str, into: str) -> DataFrame:
    """Add tie-averaged ranks from the value histogram.

    The running count is taken over distinct values only, after they were counted, so no single
    task sorts the rows. Distinct values are themselves range-partitioned first: each partition
    sums its own part and gets the total of the partitions before it. Rows without a value keep
    their place in the table and get no rank.
    """
    histogram = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranked = running_total(histogram, value, "_n", "_before").select(
        value, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(into)
    )
    return df.join(ranked, value, "left")


def running_total(df: DataFrame, order: str, amount: str, into: str) -> DataFrame:
    """Sum of ``amount`` over all rows before this one in ``order``, without a one-task window."""
    placed = materialize(
        df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "running-total"
    )
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    # One row per partition: a few thousand at most, whatever the table holds.
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, "_part")
        .withColumn(into, F.col("_offset") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop("_part", "_offset")
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rho, the Pearson correlation of tie-averaged ranks.

    Rho is null for fewer than two rows or a constant series. Joint values are counted first:
    ranks join onto distinct (x, y) pairs and the moments are weighted by their counts.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("x"), F.col(y).alias("y")
    )
    cells = materialize(pairs.groupBy("x", "y").agg(F.count("*").alias("w")), "rank-cells")
    rank_x = _weighted_ranks(cells, "x", "rx")
    rank_y = _weighted_ranks(cells, "y", "ry")
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    moments = (
        cells.join(rank_x, "x")
        .join(rank_y, "y")
        .agg(
            F.sum("w").alias("n"),
            F.sum(w * rx).alias("sx"),
            F.sum(w * ry).alias("sy"),
            F.sum(w * rx * rx).alias("sxx"),
            F.sum(w * ry * ry).alias("syy"),
            F.sum(w * rx * ry).alias("sxy"),
            F.count_distinct("x").alias("_dx"),
            F.count_distinct("y").alias("_dy"),
        )
    )
    n = F.col("n")
    num = F.col("sxy") - F.col("sx") * F.col("sy") / n
    dx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    dy = F.col("syy") - F.col("sy") * F.col("sy") / n
    measurable = (n >= 2) & (F.col("_dx") > 1) & (F.col("_dy") > 1)
    return moments.select(
        F.coalesce(n, F.lit(0)).alias("n"), F.when(measurable, num / F.sqrt(dx * dy)).alias("rho")
    )


def _weighted_ranks(cells: DataFrame, value: str, into: str) -> DataFrame:
    histogram = cells.groupBy(value).agg(F.sum("w").alias("_n"))
    return running_total(histogram, value, "_n", "_before").select(
        value, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(into)
    )
