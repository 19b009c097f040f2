"""A whole issue run over stored state, all of it visible at once or not at all.

A run writes each of its tables into a folder of its own. The last thing it writes is its line in the
manifest; readers take the tables of runs that have one. A run that breaks off leaves folders that
nobody reads and that its next attempt overwrites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.aggregates import dedupe_newest, volume_report
from newsloom.operators.gates import recent
from newsloom.operators.joins import split_published
from newsloom.plans import scoring
from newsloom.plans.issue import IssueRules, archive_entries, lay_out, ranked
from newsloom.session import materialize
from newsloom.sinks.buckets import SeenLog, stored
from newsloom.sinks.ledgers import write_partition

MANIFEST = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("full_run", T.BooleanType()),
    T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("run", T.StringType()),
])


@dataclass(frozen=True)
class RunStore:
    """The tables of an issue under ``root``: a folder a table, in it one a run, and the manifest."""

    root: str
    buckets: int = 64
    bits: int = 1 << 24

    def manifest(self, spark: SparkSession) -> DataFrame:
        """One row per complete run: number, full_run, counts per table, run."""
        rows = stored(spark, f"{self.root}/manifest", MANIFEST, "run")
        return spark.createDataFrame([], MANIFEST) if rows is None else rows

    def complete(self, spark: SparkSession) -> tuple[str, ...]:
        """The complete runs in the order they were finished; one name a run."""
        return tuple(r["run"] for r in self.manifest(spark).orderBy("number").select("run").collect())

    def log(self, spark: SparkSession, name: str) -> SeenLog:
        return SeenLog(f"{self.root}/{name}", self.buckets, self.bits, complete=self.complete(spark))

    def write(self, name: str, rows: DataFrame, run: str) -> DataFrame:
        """Store a run's table; returns it as stored."""
        write_partition(rows, f"{self.root}/{name}", run=run)
        full = T.StructType([*rows.schema.fields, T.StructField("run", T.StringType())])
        return rows.sparkSession.read.schema(full).parquet(f"{self.root}/{name}").filter(F.col("run") == run).drop("run")

    def read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        """A table's rows of all complete runs, with the run and its number."""
        full = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        rows = stored(spark, f"{self.root}/{name}", full, "run")
        rows = spark.createDataFrame([], full) if rows is None else rows
        return rows.filter(F.col("run").isin(*self.complete(spark))).join(self.manifest(spark).select("run", "number"), "run")

    def last(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        """A table as the last complete run left it."""
        runs = self.complete(spark)
        return self.read(spark, name, schema).filter(F.col("run") == (runs[-1] if runs else "")).drop("run", "number")

    def scores(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The score ledger: per (uid, prompt, model) what the last run that scored it said."""
        rows = self.read(spark, "scores", schema)
        newest = F.max_by(F.struct(*schema.names), F.struct("number", "scored_at", "relevance"))
        return rows.groupBy("uid", "prompt_hash", "model").agg(newest.alias("_r")).select("_r.*")

    def commit(self, spark: SparkSession, run: str, full_run: bool, counts: dict[str, int]) -> None:
        number = (self.manifest(spark).agg(F.max("number")).first()[0] or 0) + 1
        line = spark.createDataFrame([(number, full_run, counts)], T.StructType(MANIFEST.fields[:-1]))
        write_partition(line.coalesce(1), f"{self.root}/manifest", run=run)


@dataclass(frozen=True)
class Scoring:
    """Who judges: a scorer of payload batches and the version its verdicts are stored under."""

    scorer: Callable
    prompt_hash: str
    model: str
    batch_size: int = scoring.BATCH_SIZE


def issue_run(
    store: RunStore,
    run: str,
    items: DataFrame,
    now: Column,
    judge: Scoring,
    community_sources: DataFrame,
    picks: DataFrame | None = None,
    rules: IssueRules | None = None,
    prefilter: Callable[[DataFrame], DataFrame] | None = None,
    full_run: bool = True,
) -> DataFrame:
    """One run from landed items to a laid-out issue; returns the stored layout.

    ``items``: seq, uid, source_id, source_name, title, raw_text, published_at and what the layout
    shows; ``picks`` likewise, ahead of the scored items unless an earlier full run published them.
    The seen log is asked before this run's items are recorded; verdicts are stored, also those that
    drop an item, before the threshold cuts. ``prefilter`` cuts candidates before the scorer is
    paid for (short videos, an item cap). Only a full run marks items as published and enters the
    archive. A run that is complete is refused; one that broke off is done again from its start.
    """
    spark, rules = items.sparkSession, rules or IssueRules()
    done = store.complete(spark)
    if run in done:
        raise ValueError(f"run {run} is complete")

    # Landed once. Texts go on with recent items only: the newest copy of a key is recent if any of its copies is.
    landed = materialize(items, "run-landed")
    seen = store.log(spark, "seen")
    fresh = materialize(seen.unseen(dedupe_newest(recent(landed, now, rules.days)), run), "run-fresh")
    logged = seen.append(dedupe_newest(landed.select("uid", "seq", "source_id", "title", "published_at")), run)
    store.write("volume", volume_report(landed, "source_name", "published_at", now), run)

    asked = fresh if prefilter is None else prefilter(fresh)
    answers = materialize(scoring.score(scoring.payload(asked), judge.scorer, judge.batch_size), "run-answers")
    version = [F.lit(judge.prompt_hash).alias("prompt_hash"), F.lit(judge.model).alias("model"), now.cast("timestamp_ntz").alias("scored_at")]
    verdicts = store.write("scores", scoring.valid_verdicts(answers).select("*", *version), run)
    rejected = store.write("rejected", scoring.rejected_verdicts(answers), run)

    published = store.log(spark, "published")
    if picks is not None:
        before = published.read(spark, T.StructType.fromDDL("uid string"))
        picks = split_published(dedupe_newest(picks), before).filter(~F.col("already_published")).drop("already_published")
        picks = picks.drop("raw_text")
    # The scorer has had the texts; neither the layout nor the archive shows them.
    issue = ranked(asked.drop("raw_text"), verdicts, community_sources, picks, rules)
    layout = store.write("issue", lay_out(issue), run)

    counts = {"seen": logged.count(), "scores": verdicts.count(), "rejected": rejected.count(), "issue": layout.count()}
    if full_run:
        counts["published"] = published.append(layout.select("uid", F.col("position").alias("seq")), run).count()
        entry = archive_entries(issue.withColumn("issue_date", now.cast("date")), ["issue_date"])
        counts["archive"] = store.write("archive", entry, run).count()
    store.commit(spark, run, full_run, {k: int(v) for k, v in counts.items()})
    return layout
