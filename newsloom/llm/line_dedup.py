"""Line dedup that can be taken back.

The store of known lines has three tables in the shared folder:

* holders: one row per (line key, document), the exact references;
* refs: the exact reference count and smallest holder per line key;
* filters: one cuckoo filter per shard over the keys with two or more holders.

Adding documents adds holders; deleting documents removes exactly theirs. Counts are re-made for
the touched keys only, and the filters gain the keys whose count reaches two and lose those whose
count falls below. Cutting lines from documents asks the shard's filter first; the few keys that
pass are confirmed against the exact counts, so a false positive of a filter never drops a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import ASCII_SPACE, map_rows, query, ship, table
from newsloom.session import materialize

MIN_CHARS = 10
#: Keys a shard's filter should hold, and rows one task should ask it about.
SHARD_KEYS = 100_000
TASK_ROWS = 100_000

SLOTS = 4
MAX_KICKS = 500


class Cuckoo:
    """A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four slots a bucket.

    A key has two buckets, each found from the other and the fingerprint, so that entries can be
    moved and deleted without the key. A full filter doubles; for that the hashes of the entries
    are needed again, which the exact table has.
    """

    def __init__(self, buckets: int, cells=None):
        self.buckets = buckets
        self.cells = cells if cells is not None else [0] * (buckets * SLOTS)

    @classmethod
    def of(cls, hashes) -> Cuckoo:
        buckets = 1
        while buckets * SLOTS * 0.9 < len(hashes):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.add(int(h)) for h in hashes):
                return made
            buckets *= 2

    def places(self, h: int) -> tuple[int, int, int]:
        print_ = (h & 0xFFFF) or 1
        one = (h >> 16) & (self.buckets - 1)
        return print_, one, one ^ self.jump(print_)

    def jump(self, print_: int) -> int:
        return (print_ * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def put(self, bucket: int, print_: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.cells[at]:
                self.cells[at] = print_
                return True
        return False

    def add(self, h: int) -> bool:
        print_, one, two = self.places(h)
        if self.put(one, print_) or self.put(two, print_):
            return True
        bucket = two
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (print_ + kick) % SLOTS
            print_, self.cells[at] = self.cells[at], print_
            bucket ^= self.jump(print_)
            if self.put(bucket, print_):
                return True
        return False

    def remove(self, h: int) -> bool:
        print_, one, two = self.places(h)
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.cells[at] == print_:
                    self.cells[at] = 0
                    return True
        return False

    def dump(self) -> bytes:
        import numpy as np

        return np.array(self.cells, dtype="<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        import numpy as np

        cells = np.frombuffer(raw, dtype="<u2").tolist()
        return cls(len(cells) // SLOTS, cells)

    @staticmethod
    def ask(raw: bytes, hashes):
        """Which of a numpy array of unsigned hashes may be in the filter."""
        import numpy as np

        cells = np.frombuffer(raw, dtype="<u2").reshape(-1, SLOTS)
        mask = np.uint64(len(cells) - 1)
        print_ = np.maximum(hashes & np.uint64(0xFFFF), np.uint64(1))
        one = (hashes >> np.uint64(16)) & mask
        two = one ^ ((print_ * np.uint64(0x5BD1E995) >> np.uint64(7)) & mask)
        want = print_.astype(np.uint16)[:, None]
        return ((cells[one] == want) | (cells[two] == want)).any(axis=1)


@dataclass
class Store:
    """The tables of a line store, and how many shards its keys are spread over."""

    holders: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line stripped of ASCII space at both ends, A-Z lower-cased; None if too short to count."""
    core = line.strip(ASCII_SPACE)
    return core.encode().lower() if len(core) >= min_chars else None


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (hi, lo, doc_id): the 128-bit hash of every countable line of every document."""

    def run(batches):
        import xxhash

        for b in batches:
            out = {"hi": [], "lo": [], "doc_id": []}
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                keys = {line_key(x, min_chars) for x in split_lines(text)} - {None}
                for k in keys:
                    h = xxhash.xxh3_128_digest(k)
                    out["hi"].append(int.from_bytes(h[:8], "little", signed=True))
                    out["lo"].append(int.from_bytes(h[8:], "little", signed=True))
                    out["doc_id"].append(doc)
            yield out

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), "hi bigint, lo bigint, doc_id bigint", run)


def count_refs(holders: DataFrame) -> DataFrame:
    return holders.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def shard_of(shards: int):
    return F.pmod("lo", F.lit(shards)).cast("int")


def build_filters(refs: DataFrame, shards: int) -> DataFrame:
    """(shard, cells) over the keys with two or more holders."""

    def build(key, pdf):
        import pandas as pd

        made = Cuckoo.of(pdf["hi"].to_numpy().astype("uint64"))
        return pd.DataFrame({"shard": [key[0]], "cells": [made.dump()]})

    shared = refs.filter("n_docs >= 2").select(shard_of(shards).alias("shard"), "hi")
    return shared.groupBy("shard").applyInPandas(build, "shard int, cells binary")


def empty_store(spark: SparkSession, shards: int) -> Store:
    return Store(
        spark.createDataFrame([], "hi bigint, lo bigint, doc_id bigint"),
        spark.createDataFrame([], "hi bigint, lo bigint, n_docs bigint, first_doc bigint"),
        spark.createDataFrame([], "shard int, cells binary"),
        shards,
    )


def open_store(docs: DataFrame, min_chars: int = MIN_CHARS) -> Store:
    """A store of these documents. The number of shards follows the number of references."""
    holders = materialize(line_keys(docs, min_chars).distinct(), "line-holders")
    shards = 1 + holders.count() // SHARD_KEYS
    refs = materialize(count_refs(holders), "line-refs")
    return Store(holders, refs, materialize(build_filters(refs, shards), "line-filters"), shards)


def _change(store: Store, holders: DataFrame, touched: DataFrame) -> Store:
    """The store after ``holders`` replaced the old ones; ``touched`` lists the keys that changed."""
    key = ["hi", "lo"]
    fresh = count_refs(holders.join(touched, key, "left_semi"))
    was = store.refs.join(touched, key, "left_semi")
    refs = materialize(store.refs.join(touched, key, "left_anti").unionByName(fresh), "line-refs")
    moves = (
        was.select(*key, F.lit(-1).alias("step"), "n_docs")
        .unionByName(fresh.select(*key, F.lit(1).alias("step"), "n_docs"))
        .filter("n_docs >= 2")
        .groupBy(*key)
        .agg(F.sum("step").alias("step"))
        .filter("step != 0")
        .select(shard_of(store.shards).alias("shard"), "hi", "step")
    )

    def update(key, old, steps):
        import pandas as pd

        made = Cuckoo.load(old["cells"].iloc[0]) if len(old) else Cuckoo(1)
        full = False
        for h, step in zip(steps["hi"].to_numpy().astype("uint64"), steps["step"], strict=True):
            if step < 0:
                made.remove(int(h))
            elif not full:
                full = not made.add(int(h))
        return pd.DataFrame({"shard": [key[0]], "cells": [None if full else made.dump()]})

    updated = store.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(
        update, "shard int, cells binary"
    )
    updated = materialize(updated, "line-filters")
    # A filter that overflowed is built anew, larger, from the exact table.
    full = updated.filter("cells IS NULL").select("shard")
    again = refs.withColumn("shard", shard_of(store.shards)).join(full, "shard", "left_semi")
    filters = updated.filter("cells IS NOT NULL").unionByName(build_filters(again, store.shards))
    return Store(holders, refs, materialize(filters, "line-filters"), store.shards)


def insert(store: Store, docs: DataFrame, min_chars: int = MIN_CHARS) -> Store:
    """The store with these documents added. Documents it already holds change nothing."""
    new = materialize(line_keys(docs, min_chars).distinct(), "line-new")
    holders = materialize(store.holders.unionByName(new).distinct(), "line-holders")
    return _change(store, holders, new.select("hi", "lo").distinct())


def delete(store: Store, doc_ids: DataFrame) -> Store:
    """The store as if the documents in ``doc_ids`` (doc_id) had never been added."""
    gone = doc_ids.select("doc_id").distinct()
    touched = store.holders.join(gone, "doc_id", "left_semi").select("hi", "lo").distinct()
    holders = materialize(store.holders.join(gone, "doc_id", "left_anti"), "line-holders")
    return _change(store, holders, materialize(touched, "line-touched"))


def repeated_lines(store: Store) -> DataFrame:
    """(doc_id, hi, lo) of the lines to drop: held by several documents, this not being the first.

    References go to their shard's filter in tasks of bounded size: a shard whose keys have many
    references is salted and its filter, a few hundred kB, repeated per salt.
    """
    asked = store.holders.withColumn("shard", shard_of(store.shards))
    sizes = asked.groupBy("shard").agg((F.count("*") / TASK_ROWS).cast("int").alias("salts"))
    sizes = materialize(sizes.withColumnRenamed("shard", "_s"), "line-salts")
    salted = F.pmod(F.xxhash64("doc_id"), F.col("salts") + 1).cast("int")
    asked = asked.join(sizes, F.col("shard") == F.col("_s")).withColumn("salt", salted).drop("_s", "salts")
    copies = store.filters.join(sizes, F.col("shard") == F.col("_s")).select(
        "shard", "cells", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt")
    )

    def ask(key, rows, cells):
        if not len(cells):
            return rows.iloc[:0][["hi", "lo", "doc_id"]]
        may = Cuckoo.ask(cells["cells"].iloc[0], rows["hi"].to_numpy().astype("uint64"))
        return rows.loc[may, ["hi", "lo", "doc_id"]]

    by = ["shard", "salt"]
    maybe = asked.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(ask, "hi bigint, lo bigint, doc_id bigint")
    exact = store.refs.filter("n_docs >= 2").select(F.col("hi").alias("_h"), F.col("lo").alias("_l"), "first_doc")
    return maybe.join(exact, (F.col("hi") == F.col("_h")) & (F.col("lo") == F.col("_l"))).filter(
        ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    ).select("doc_id", "hi", "lo")


def cut_lines(docs: DataFrame, store: Store, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with columns n_lines, n_dropped and kept (the text without its repeated lines).

    A null or empty text is one empty line and stays one. Lines shorter than ``min_chars`` stay.
    Rows that repeat a doc_id are one document: they keep what that document keeps. A null doc_id
    counts as one document that is never the first holder of a line another document holds.
    An empty table gives an empty result; further columns pass through, but for those named like
    one of the new ones.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    drops = repeated_lines(store).groupBy(F.col("doc_id").alias("__of")).agg(
        F.collect_list(F.struct("hi", "lo")).alias("__drop")
    )
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("__of")), "left").drop("__of")
    names = docs.columns

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kept = [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())]
    schema = StructType([*docs.schema.fields, *kept])

    def run(batches):
        import pyarrow as pa
        import xxhash

        def lines_of(text, drop):
            lines = split_lines(text)
            if not drop:
                return len(lines), 0, text or ""
            gone = {(d["hi"], d["lo"]) for d in drop}
            stay = []
            for x in lines:
                k = line_key(x, min_chars)
                if k is not None:
                    h = xxhash.xxh3_128_digest(k)
                    pair = int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)
                    if pair in gone:
                        continue
                stay.append(x)
            return len(lines), len(lines) - len(stay), "\n".join(stay)

        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            out = [
                lines_of(t, d)
                for t, d in zip(b.column(at["text"]).to_pylist(), b.column(at["__drop"]).to_pylist(), strict=True)
            ]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(at[n]) for n in names]
                + [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                names=[*names, "n_lines", "n_dropped", "kept"],
            )

    return joined.select(*names, "__drop").mapInArrow(run, schema)


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
l AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p),
s AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.first_doc AS dropped FROM l LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op10_line_dedup", SQL)
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cut_lines(docs, open_store(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ship(__name__)
