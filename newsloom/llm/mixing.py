"""Mixing sources to target weights.

Every document gets a hash-random key. Rows are range-sorted by (source, key), word counts are
summed before each row by a distributed prefix sum, and each source is cut at its exact budget;
a budget above the source's own size repeats it in further epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from newsloom.llm.common import query, ship, table
from newsloom.operators.ranking import with_position
from newsloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    # A split yields an empty piece before leading and after trailing space; nothing else is empty.
    edge = lambda i: F.when(F.element_at(words, i) == "", 1).otherwise(0)
    return F.when(F.size(words) == 1, 1 - edge(1)).otherwise(F.size(words) - edge(1) - edge(-1)).cast("bigint")


def random_key(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def prefix_sums(df: DataFrame, group: str, order: list[str], amount: str, into: str) -> DataFrame:
    """Sum of ``amount`` over the earlier rows of the same ``group`` (not null), in ``order``.

    Rows are range-partitioned by group and order, so a hot group spreads over many partitions.
    Each partition sums its own rows as they stream by; one row per (group, partition) carries
    the totals over. The placed rows are written once.
    """
    schema = df.withColumn("_part", F.spark_partition_id()).withColumn(into, F.lit(0).cast("bigint")).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, total = None, 0
        for b in batches:
            g = b.column(b.schema.names.index(group)).to_numpy(zero_copy_only=False)
            a = b.column(b.schema.names.index(amount)).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(g):
                continue
            upto = np.cumsum(a) - a
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            base = upto[starts]
            if g[0] == last:
                base[0] -= total
            out = upto - np.repeat(base, np.diff(np.r_[starts, len(g)]))
            last, total = g[-1], int(out[-1] + a[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, into])

    placed = (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_part", F.spark_partition_id())
        .mapInArrow(run, schema)
    )
    placed = materialize(placed, "prefix")
    sums = placed.groupBy(group, "_part").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_o")
    )
    return (
        placed.join(offsets, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
        .withColumn(into, F.col(into) + F.col("_o"))
        .drop("_g", "_p", "_o", "_part")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also number, weight, target.

    Sources in code-point order, null last, take the weights in turn. A source whose share would
    exceed ``most`` times its size stops there; what it leaves goes to the others by weight. With
    sources ordered by cap over weight, the water level is the largest of
    (budget - caps before) / (weights from here on), so one prefix sum replaces the repeated resharing.
    """
    n = len(weights)
    numbered = with_position(sizes, [], [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("number") - 1) % n + 1).cast("int"))
    ready = materialize(
        numbered.withColumn("weight", weight.cast("bigint"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("_all", F.lit(0))
        .withColumn("_ratio", F.col("cap") / F.col("weight")),
        "sources",
    )
    order = ["_ratio", "number"]
    summed = prefix_sums(ready, "_all", order, "cap", "_caps")
    summed = prefix_sums(summed, "_all", order, "weight", "_weights")
    whole = ready.agg(
        (F.sum("source_size") * F.lit(float(share))).alias("_budget"), F.sum("weight").alias("_weight")
    ).withColumn("_one", F.lit(0))
    level = (
        summed.join(whole, F.col("_all") == F.col("_one"))
        .agg(F.max((F.col("_budget") - F.col("_caps")) / (F.col("_weight") - F.col("_weights"))).alias("_level"))
        .withColumn("_one", F.lit(0))
    )
    return ready.join(level, F.col("_all") == F.col("_one")).select(
        "source", "source_size", "number",
        F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, epochs, cut, taken.

    ``epochs`` whole passes over the source are taken, then rows in key order until the rest of
    the budget is used up; ``cut`` is how many words of this row the last, partial pass takes (the
    row at the border is taken in part). A null text has size 0 and takes nothing; an empty table
    gives an empty result; repeated rows count each; a null source is a source of its own, last.
    The key hashes doc_id and size, so reruns agree and equal rows are interchangeable.
    """
    sized = materialize(
        docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most), "mix-targets")
    keyed = sized.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("_key", random_key(seed, "doc_id"))
    placed = prefix_sums(keyed, "number", ["_key", "doc_id", "size"], "size", "_before")
    budget = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    placed = placed.withColumn("epochs", whole).withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))
    cut = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    return placed.withColumn("cut", cut).select(
        "doc_id", "source", *carry, "size", "source_size", "target", "epochs", "cut", "_before", "_rest",
        (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken.

    The document at the border of a budget is kept whole if at least half of it fits, so a source
    misses its target by half a document at most. Empty documents follow the whole passes. Equal
    rows share one identity and are told apart by their number only.
    """
    rows = docs.withColumn("__row", F.xxhash64(*docs.columns))
    keep = (F.col("_before") + F.floor(F.col("size") / 2) < F.col("_rest")).cast("bigint")
    taken = (
        mix(rows, carry=("__row",), **how)
        .groupBy(F.col("__row").alias("__of"))
        .agg(F.max("epochs").alias("__epochs"), F.sum(keep).alias("__more"))
        .filter("__epochs + __more > 0")
    )
    nth = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    copies = F.col("__epochs") + (F.col("__nth") <= F.col("__more")).cast("bigint")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), copies))
    return (
        rows.withColumn("__nth", nth)
        .join(taken, F.col("__row") == F.col("__of"))
        .filter(copies > 0)
        .select(*docs.columns, each.alias("__epoch"))
        .drop("__epoch")
    )


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s),
w AS (SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM n),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / weight AS ratio FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weight_total
      FROM r WINDOW before AS (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((CAST(total AS DOUBLE) * 1.5 - caps) / (weight_total - weights)) AS level FROM b),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM r, l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', coalesce(CAST(d.doc_id AS VARCHAR), ''))), d.doc_id NULLS FIRST, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM k
"""


@query("op7_mixing", SQL)
def op7(spark, sf):
    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ship(__name__)
