"""Positions, best-of-group picks and page layout."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import is_instructional, two_decimals
from newsloom.schema import UNCATEGORISED, category_ordinal
from newsloom.session import materialize


def with_position(df: DataFrame, groups: list[str], order: list[Column], into: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in ``order``, however large a group is.

    A window would sort a whole group in one task. Here rows are range-partitioned by group and
    order, sorted in place and numbered per partition; a small table with one row per
    (group, partition) supplies the offsets. The sorted rows are written once, because a second
    evaluation could draw other range bounds.
    """
    keys = [F.col(g) for g in groups]
    sort = keys + order
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = materialize(placed.withColumn("_part", F.shiftright("_id", 33)), "positions")
    runs = placed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    runs = runs.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_part").alias("_run"),
        (offset - F.col("_first") + 1).alias("_shift"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return placed.join(runs, reduce(and_, same, F.col("_part") == F.col("_run"))).select(
        *df.columns, (F.col("_id") + F.col("_shift")).alias(into)
    )


def first_n(df: DataFrame, groups: list[str], order: list[Column], n: int, into: str = "position") -> DataFrame:
    """First ``n`` rows of each group.

    Up to the planner's limit on group limits every map task is cut to its own first ``n`` per
    group before the shuffle, so a hot group sends at most ``n`` rows from each task. Beyond it
    rows are numbered by a range sort, which spreads a hot group as well.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return with_position(df, groups, order, into).filter(F.col(into) <= n)
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(into, F.row_number().over(window)).filter(F.col(into) <= n)


def relevance_order(relevance: Column | None = None, order: str = "seq") -> list[Column]:
    score = two_decimals(F.col("relevance")) if relevance is None else relevance
    return [score.desc_nulls_last(), F.col(order).asc()]


def resource_slot(items: DataFrame, groups: list[str], order: str = "seq") -> DataFrame:
    """The one video each issue promotes.

    A pick beats an instructional title, which beats any video; among picks the title does not
    count. Best relevance on the two-decimal grid wins inside a level and the earliest position
    breaks ties. A single aggregate, combined on the map side.
    """
    level = F.when(F.col("is_pick"), 2).when(is_instructional(F.col("title")), 1).otherwise(0)
    best = F.struct(level, two_decimals(F.coalesce("relevance", F.lit(0.0))), -F.col(order))
    return (
        items.filter(F.col("video_id").isNotNull())
        .groupBy(*groups)
        .agg(F.max_by(F.struct(order, "title", "video_id"), best).alias("_r"))
        .select(*groups, "_r.*")
    )


def highlights(items: DataFrame, groups: list[str], position: str = "position", top: int = 4) -> DataFrame:
    """Lead titles of each issue and a line on what the rest covers.

    ``position`` numbers the items of each issue from 1. Areas are listed by first appearance.
    """
    lead = items.filter(F.col(position) <= top)
    titles = lead.groupBy(*groups).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("title").alias("t")))),
            lambda s: s["t"],
        ).alias("titles")
    )
    area = F.lower(F.coalesce("category", F.lit("more")))
    rest = (
        items.filter(F.col(position) > top)
        .groupBy(*groups, area.alias("area"))
        .agg(F.count("*").alias("n"), F.min(position).alias("p"))
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p", "area"))), lambda s: s["area"])
    plus = rest.groupBy(*groups).agg(
        F.sum("n").alias("n_more"), F.array_join(F.slice(listed, 1, 3), ", ").alias("areas")
    )
    return titles.join(plus, groups, "left").withColumn(
        "plus",
        F.when(F.col("n_more") > 0, F.concat(F.lit("Plus "), F.col("n_more"), F.lit(" more across "), F.col("areas"))),
    )


def sectioned(items: DataFrame, resource: DataFrame | None = None, key: str = "seq") -> DataFrame:
    """Add section and its order; leave out the item promoted to the resource slot."""
    kept = items if resource is None else items.join(resource.select(key), key, "left_anti")
    return kept.withColumn("section_order", category_ordinal(F.col("category"))).withColumn(
        "section", F.coalesce("category", F.lit(UNCATEGORISED))
    )


def section_lead(layout: DataFrame, groups: list[str], position: str = "position") -> DataFrame:
    """First item of the first section of each issue."""
    return layout.groupBy(*groups).agg(
        F.min_by("title", F.struct("section_order", position)).alias("lead")
    )
