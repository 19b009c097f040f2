"""Ledgers dealt into hash buckets, so that a run opens the buckets it touches and no others.

A row's bucket follows from its key and stands in the path. The seen log also keeps bitmaps of its
keys' hashes: a key whose bit is not set has never been seen, and only the rest is compared with the
log itself. The number of buckets and of bits is part of a ledger's layout and of its folders' names,
so a ledger opened with other numbers is refused instead of read wrongly.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import materialize
from newsloom.sinks.ledgers import latest_scores, write_partition

BUCKETS = 64
#: Bits of a seen log's bitmaps. At 16 bits a key about one new key in 16 is compared in vain.
BITS = 1 << 24
#: The run that merged bitmaps are kept under.
MERGED = "merged bits"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, bucket: str) -> list[int]:
    """The buckets that rows fall into: never more than the ledger has."""
    return sorted(r[0] for r in rows.select(bucket).distinct().collect())


def stored(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame | None:
    """The table at ``path``, None while it has no rows; it must be dealt by the column ``part``.

    Only folder names are looked at here, no file is opened.
    """
    try:
        found = spark.read.schema("_none string").parquet(path).columns
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if found == ["_none"]:
        return None
    if part not in found:
        raise ValueError(f"{path} has another layout: no {part} in its folders")
    return spark.read.schema(schema).parquet(path)


def bit_number(key: str, bits: int) -> Column:
    """The key's place among ``bits``; a hash with another seed than the bucket's."""
    return F.pmod(F.xxhash64(F.lit("bit"), F.col(key)), F.lit(bits))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether bit ``position`` of a bitmap is set; bits of a byte count from its lowest."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


@dataclass(frozen=True)
class SeenLog:
    """Insert-or-ignore by key: the first write wins, a run's rows replace that run's only.

    Folders: ``path``/rows/run=…/b<buckets>=… and ``path``/bits/run=…/. A run writes its bitmaps
    before its rows: a crash in between leaves bits too many, which cost a comparison and no row.
    Rows without a key are not logged. ``key`` and ``order`` name columns of the rows. With
    ``complete``, a list of runs, only their rows count, so what a broken run left is as if unwritten.
    """

    path: str
    buckets: int = BUCKETS
    bits: int = BITS
    key: str = "uid"
    order: str = "seq"
    complete: tuple[str, ...] | None = None

    @property
    def part(self) -> str:
        return f"b{self.buckets}"

    def counts(self) -> Column:
        return F.lit(True) if self.complete is None else F.col("run").isin(*self.complete)

    @property
    def maps(self) -> str:
        return f"{self.path}/bits{self.bits}"

    def read(self, spark: SparkSession, schema: T.StructType, run: str | None = None) -> DataFrame:
        """Rows of all runs, with ``run``; with a run given, those of it."""
        own = [T.StructField("run", T.StringType()), T.StructField(self.part, T.IntegerType())]
        full = T.StructType([*schema.fields, *own])
        rows = stored(spark, f"{self.path}/rows", full, self.part)
        rows = spark.createDataFrame([], full) if rows is None else rows.filter(self.counts() if run is None else F.lit(True))
        return (rows if run is None else rows.filter(F.col("run") == run)).drop(self.part)

    def bitmaps(self, keys: DataFrame) -> DataFrame:
        """(map, bits): a bitmap of 32,768 bits per ``map`` number that the keys fall into."""
        bit = keys.select((bit_number(self.key, self.bits) + 1).alias("bit"))
        return bit.groupBy(F.bitmap_bucket_number("bit").alias("map")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
        )

    def known_bits(self, spark: SparkSession, run: str | None = None) -> DataFrame | None:
        """The bitmaps of all runs but ``run``, one per map number; None before the first write."""
        schema = T.StructType([T.StructField("map", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("run", T.StringType())])
        maps = stored(spark, self.maps, schema, "run")
        if maps is None:
            return None
        other = maps if run is None else maps.filter(F.col("run") != run)
        return other.groupBy("map").agg(F.bitmap_or_agg("bits").alias("bits"))

    def compact(self, spark: SparkSession) -> None:
        """Put the bitmaps of all runs into those of one run without rows, so that readers have less to merge.

        The merged ones are written before the others are emptied. A run that is written again
        finds its own bits set, which costs a comparison with the other runs' rows.
        """
        merged = self.known_bits(spark)
        if merged is None:
            return
        runs = [r[0] for r in spark.read.schema("run string").parquet(self.maps).distinct().collect()]
        merged = materialize(merged, "seen-bits")
        write_partition(merged, self.maps, run=MERGED)
        for run in runs:
            if run != MERGED:
                write_partition(merged.limit(0), self.maps, run=run)

    def maybe_seen(self, rows: DataFrame, run: str | None = None) -> DataFrame:
        """``rows`` with ``_maybe``: false means that no earlier run holds the key for certain.

        The bitmaps meet the rows by map number; what is read is a bit a key, whatever a row holds.
        """
        maps = self.known_bits(rows.sparkSession, run)
        if maps is None:
            return rows.withColumn("_maybe", F.lit(False))
        bit = bit_number(self.key, self.bits) + 1
        keyed = rows.withColumn("_map", F.bitmap_bucket_number(bit)).withColumn("_bit", F.bitmap_bit_position(bit))
        joined = keyed.join(maps, F.col("_map") == F.col("map"), "left")
        return joined.withColumn("_maybe", F.coalesce(has_bit(F.col("bits"), F.col("_bit")), F.lit(False))).drop("_map", "_bit", "map", "bits")

    def unseen(self, rows: DataFrame, run: str | None = None) -> DataFrame:
        """The rows whose key no run but ``run`` has logged, columns and copies as they are.

        Rows that the bitmaps clear go through as they are. The others are compared with the
        buckets that they fall into; no other bucket is opened.
        """
        spark = rows.sparkSession
        keyed = rows.filter(F.col(self.key).isNotNull()).withColumn("_bucket", bucket_of(self.key, self.buckets))
        keyed = materialize(self.maybe_seen(keyed, run), "seen-maybe")
        new, maybe = keyed.filter(~F.col("_maybe")), keyed.filter("_maybe")
        hit = touched(maybe, "_bucket")
        if hit:
            key = T.StructType([rows.schema[self.key]])
            own = [T.StructField("run", T.StringType()), T.StructField(self.part, T.IntegerType())]
            log = stored(spark, f"{self.path}/rows", T.StructType([*key.fields, *own]), self.part)
            if log is not None:
                log = log.filter(F.col(self.part).isin(hit) & self.counts())
                log = log if run is None else log.filter(F.col("run") != run)
                new = new.unionByName(maybe.join(log.select(self.key), self.key, "left_anti"))
        return new.select(rows.columns)

    def append(self, rows: DataFrame, run: str) -> DataFrame:
        """Log the unseen rows under ``run``; returns them as written. Of equal keys the lowest order counts."""
        one = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(
            F.min_by(F.struct(*rows.columns), self.order).alias("_r")
        )
        new = materialize(self.unseen(one.select("_r.*"), run), "seen-new")
        write_partition(self.bitmaps(new), self.maps, run=run)
        dealt = new.withColumn(self.part, bucket_of(self.key, self.buckets))
        (
            dealt.repartition(self.part).write.mode("overwrite").partitionBy(self.part)
            .parquet(f"{self.path}/rows/run={quote(run, safe='')}")
        )
        return self.read(rows.sparkSession, rows.schema, run)

    def publish(self, rows: DataFrame, run: str, full_run: bool = True) -> DataFrame:
        """`append` for full runs only: a trial run must not mark anything as published."""
        return self.append(rows, run) if full_run else rows.limit(0).withColumn("run", F.lit(run))


@dataclass(frozen=True)
class ScoreLedger:
    """Replace on (uid, prompt, model): the last write wins, and rewrites its buckets only.

    Folders: ``path``/prompt_hash=…/b<buckets>=…/.
    """

    path: str
    buckets: int = BUCKETS

    @property
    def part(self) -> str:
        return f"b{self.buckets}"

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField(self.part, T.IntegerType())])
        rows = stored(spark, self.path, full, self.part)
        return spark.createDataFrame([], schema) if rows is None else rows.drop(self.part)

    def upsert(self, scores: DataFrame) -> DataFrame:
        """Merge verdicts in; returns the whole ledger.

        The verdicts are written down first, so that a scorer is not called again. Read back and
        rewritten are the buckets of the prompts that verdicts fall into, each replaced as a whole;
        others keep their very files.
        """
        spark = scores.sparkSession
        fresh = materialize(scores.withColumn(self.part, bucket_of("uid", self.buckets)), "score-verdicts")
        full = T.StructType([*scores.schema.fields, T.StructField(self.part, T.IntegerType())])
        old = stored(spark, self.path, full, self.part)
        places = fresh.select("prompt_hash", self.part).distinct()
        if old is not None:
            # One literal per prompt and bucket list: the scan is cut to these folders before it starts.
            by_prompt: dict[str | None, list[int]] = {}
            for prompt, bucket in places.collect():
                by_prompt.setdefault(prompt, []).append(bucket)
            here = F.lit(False)
            for prompt, buckets in by_prompt.items():
                here = here | (F.col("prompt_hash").eqNullSafe(F.lit(prompt)) & F.col(self.part).isin(buckets))
            fresh = materialize(latest_scores(old.filter(here).select(fresh.columns), fresh), "score-upsert")
        else:
            fresh = latest_scores(fresh)
        (
            fresh.repartition("prompt_hash", self.part).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("prompt_hash", self.part)
            .parquet(self.path)
        )
        return self.read(spark, scores.schema)

    def upsert_batch(self, batch: DataFrame, batch_id: int) -> None:
        """A batch handler for streams of verdicts.

        A replay of the last micro-batch writes the same verdicts over themselves, and streams replay
        no other one, so later batches keep the last word.
        """
        self.upsert(batch)
