"""Headline collapse over batches: a stored index of what was kept.

A batch meets the kept headlines through their words and never the history behind them. Word
sets that an earlier one absorbs leave at once; the rest is collapsed among itself. The result is that
of one pass over all batches in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import similar
from newsloom.session import materialize
from newsloom.sinks.buckets import bucket_of, stored, touched
from newsloom.sinks.ledgers import write_partition

BUCKETS = 64
POSTING = "token string, rep long, tokens array<string>, first boolean, run string"


@dataclass(frozen=True)
class HeadlineIndex:
    """Kept word sets by their words: ``path``/words/run=…/b<buckets>=…, with each run's last position.

    A posting says whether its word is in the set's prefix (``first``), the words one of which a larger
    set must share. A run's rows replace that run's only, so a retry changes nothing.
    """

    path: str
    threshold: float = similar.SIMILARITY_THRESHOLD
    buckets: int = BUCKETS
    budget: similar.BlockBudget = field(default_factory=similar.BlockBudget)

    @property
    def part(self) -> str:
        return f"b{self.buckets}"

    def postings(self, spark: SparkSession, run: str) -> DataFrame | None:
        schema = T.StructType.fromDDL(f"{POSTING}, {self.part} int")
        found = stored(spark, f"{self.path}/words", schema, self.part)
        return None if found is None else found.filter(F.col("run") != run)

    def last_position(self, spark: SparkSession, run: str) -> int | None:
        """The greatest position of all runs but ``run``."""
        marks = stored(spark, f"{self.path}/last", T.StructType.fromDDL("last long, run string"), "run")
        return None if marks is None else marks.filter(F.col("run") != run).agg(F.max("last")).first()[0]

    def absorbed(self, sets: DataFrame, run: str) -> DataFrame:
        """(rep, leader) of the ``sets`` (rep, words rare first) that a kept set absorbs, by its first such.

        The smaller of two sets must share one of its first words with the larger one's words, so
        either first words meet all words, or the other way round. Only buckets of words that the
        batch has are opened.
        """
        spark = sets.sparkSession
        none = spark.createDataFrame([], "rep long, leader long")
        index = self.postings(spark, run)
        if index is None:
            return none
        words = F.transform("words", lambda w: w["token"])
        prefix = similar._prefix_length(F.size("words"), self.threshold)
        mine = sets.filter(F.size("words") >= similar.MIN_WORDS).select(
            F.col("rep").alias("late"), words.alias("late_tokens"), F.posexplode(words).alias("_at", "token"),
            prefix.alias("_prefix"),
        )
        mine = mine.withColumn("late_first", F.col("_at") < F.col("_prefix")).drop("_at", "_prefix")
        mine = materialize(mine.withColumn("_bucket", bucket_of("token", self.buckets)), "headline-words")
        here = touched(mine, "_bucket")
        if not here:
            return none
        kept = index.filter(F.col(self.part).isin(here)).select("token", "rep", "tokens", "first")
        shared = F.array_intersect("tokens", "late_tokens")
        smaller: Column = F.least(F.size("tokens"), F.size("late_tokens"))
        pairs = kept.join(mine.drop("_bucket"), "token").filter(
            F.when(F.size("tokens") <= F.size("late_tokens"), F.col("first")).otherwise(F.col("late_first"))
            & (F.size(shared) / smaller >= self.threshold)
        )
        return pairs.groupBy(F.col("late").alias("rep")).agg(F.min("rep").alias("leader"))

    def add(self, kept: DataFrame, run: str, last: int | None) -> None:
        """Store the ``kept`` sets (rep, words rare first) of a run and the position it went up to."""
        words = F.transform("words", lambda w: w["token"])
        rows = kept.select(
            F.posexplode(words).alias("_at", "token"), "rep", words.alias("tokens"),
            similar._prefix_length(F.size("words"), self.threshold).alias("_prefix"),
        ).select("token", "rep", "tokens", (F.col("_at") < F.col("_prefix")).alias("first"))
        (
            rows.withColumn(self.part, bucket_of("token", self.buckets))
            .repartition(self.part).write.mode("overwrite").partitionBy(self.part)
            .parquet(f"{self.path}/words/run={quote(run, safe='')}")
        )
        spark = kept.sparkSession
        write_partition(spark.createDataFrame([(last,)], "last long").coalesce(1), f"{self.path}/last", run=run)


def collapse_next(items: DataFrame, index: HeadlineIndex, run: str, position: str = "seq", title: str = "title") -> DataFrame:
    """Decide a batch of items whose positions come after all earlier runs': position, leader (null when kept).

    A leader may be of this batch or an earlier one. The kept word sets are added to the index under
    ``run``. Empty batches, titles without words and repeated titles are as in `collapse_similar`;
    positions that are not later than the index's are refused.
    """
    spark = items.sparkSession
    low, high = items.agg(F.min(position), F.max(position)).first()
    before = index.last_position(spark, run)
    if before is not None and low is not None and low <= before:
        raise ValueError(f"position {low} is not after {before}, where earlier runs end")
    tokens = materialize(similar._fingerprints(items, position, title), "headline-tokens")
    sets = materialize(similar.word_sets(tokens), "headline-sets")
    gone = materialize(index.absorbed(sets, run), "headline-absorbed")
    rest = similar.collapse_sets(sets.join(gone, "rep", "left_anti"), index.threshold, index.budget)
    decided = materialize(gone.unionByName(rest), "headline-decided")
    index.add(sets.join(decided.filter(F.col("leader").isNull()), "rep", "left_semi"), run, high)
    return similar.spread(tokens, decided, position)
