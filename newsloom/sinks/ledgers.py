"""Persistent tables: seen items, scores, published items, the archive index.

Tables are Parquet folders. Appends carry the run id they belong to and replace exactly their own
run's partition, so a retried run never doubles its rows. Every reader takes its snapshot before
the run writes.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import materialize


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_partition(rows: DataFrame, path: str, **part: object) -> None:
    """Replace one partition of a table as a whole, also by nothing."""
    folder = "/".join(f"{name}={quote(str(value), safe='')}" for name, value in part.items())
    rows.write.mode("overwrite").parquet(f"{path}/{folder}")


def append_new(rows: DataFrame, path: str, run: str, key: str = "uid") -> DataFrame:
    """Insert-or-ignore: write the rows whose key the table lacks, first write wins.

    Returns the rows of this run as written. Duplicate keys inside the input keep the lowest seq.
    """
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField("run", T.StringType())])
    known = read_table(spark, path, schema).filter(F.col("run") != run).select(key)
    one = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "seq").alias("_r")).select("_r.*")
    write_partition(one.join(known, key, "left_anti"), path, run=run)
    return spark.read.schema(schema).parquet(path).filter(F.col("run") == run)


def publish(rows: DataFrame, path: str, run: str, full_run: bool = True) -> DataFrame:
    """Record published items, for full runs only: a trial run must not mark anything as published."""
    if not full_run:
        return rows.limit(0).withColumn("run", F.lit(run))
    return append_new(rows, path, run)


def latest_scores(*ledgers: DataFrame) -> DataFrame:
    """Replace on (uid, prompt, model): the last write wins, whatever it says and whenever it was scored.

    A later ledger replaces an earlier one. Inside one ledger the newest verdict counts, at equal
    times the higher one.
    """
    ranked = [rows.withColumn("_write", F.lit(i)) for i, rows in enumerate(ledgers)]
    rows = ranked[0]
    for other in ranked[1:]:
        rows = rows.unionByName(other)
    keys = ["uid", "prompt_hash", "model"]
    newest = F.max_by(F.struct(*rows.columns), F.struct("_write", "scored_at", "relevance"))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select("_r.*").drop("_write")


def upsert_scores(scores: DataFrame, path: str) -> DataFrame:
    """Merge verdicts into the ledger, rewriting only the prompt versions they belong to.

    The verdicts are written down first: they are read twice here, and a scorer must not be
    called again. The merged rows are staged too, since a folder cannot be read and overwritten
    by one job.
    """
    spark = scores.sparkSession
    fresh = materialize(scores, "score-verdicts")
    old = read_table(spark, path, scores.schema).join(
        fresh.select("prompt_hash").distinct(), "prompt_hash", "left_semi"
    )
    merged = materialize(latest_scores(old.select(scores.columns), fresh), "score-upsert")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("prompt_hash")
        .parquet(path)
    )
    return spark.read.schema(scores.schema).parquet(path)


def replace_dates(index: DataFrame, entries: DataFrame, key: str = "issue_date") -> DataFrame:
    """One row per date: new entries replace those of the same date."""
    return index.join(entries.select(key), key, "left_anti").unionByName(entries)


def record_archive(entries: DataFrame, path: str) -> DataFrame:
    """Store archive entries, overwriting the partitions of their dates only."""
    (
        entries.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("issue_date")
        .parquet(path)
    )
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def split_rejects(rows: DataFrame, reason: Column, good_path: str, reject_path: str) -> tuple[DataFrame, DataFrame]:
    """Write usable rows and quarantined rows side by side, parsing the input once."""
    spark = rows.sparkSession
    tagged = materialize(rows.withColumn("reject_reason", reason), "tagged")
    tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason").write.parquet(good_path)
    tagged.filter(F.col("reject_reason").isNotNull()).write.partitionBy("reject_reason").parquet(reject_path)
    return spark.read.schema(rows.schema).parquet(good_path), spark.read.schema(tagged.schema).parquet(reject_path)
