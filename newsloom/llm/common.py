"""What the operators of this package share: registration, batch mapping, hashing, links to components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words are runs of anything but these six characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def ship(module: str) -> None:
    """Send the functions of a module to Python workers by value.

    Executors then need no copy of this library on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def map_rows(df: DataFrame, schema: str, fn: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``fn`` sees the columns of each Arrow batch as lists and yields columns of the result."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def plain():
            for b in batches:
                yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for out in fn(plain()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def components(links: DataFrame, label: str, rounds: int | None = None) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b): the smallest id it is connected with.

    Alternates two steps: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours. Each keeps connectivity and the number of rounds grows with the logarithm
    of the largest component. Minima combine on the map side, the join back is on the node and
    left to skew splitting; every round is a table in the shared folder. With ``rounds`` it stops
    early: equal labels then still mean connected, different ones may be connected too.
    """

    def state(edges):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = materialize(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{label}-links",
    )
    before, done = state(edges), 0
    while before[0] and done != rounds:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large, f"{label}-large")
        parent = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(parent, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        own = parent.select(F.col("n").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(own).distinct(), f"{label}-small")
        now, done = state(edges), done + 1
        if now == before:
            break
        before = now
    named = edges.select(F.col("u").alias("id"), "v").unionByName(edges.select(F.col("v").alias("id"), "v"))
    return named.groupBy("id").agg(F.min("v").alias("component_id"))


ship(__name__)
