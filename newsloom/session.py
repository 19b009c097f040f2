"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE with skew joins, UTC)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only where that is unset, and only
    for a local master, is a temporary folder chosen, once per session; it goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = spark.conf.get("newsloom.local.scratch", None)
    if not made:
        made = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("newsloom.local.scratch", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place under the run's own folder, which can be dropped whole once the run's results are stored."""
    return f"{scratch_root(spark)}/newsloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, most: int):
    """Jobs run inside send Python batches of about ``most`` bytes; the session's own bound comes back after them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in iterative operators. The files survive the loss of any executor, and the
    reread table carries true sizes, so the planner picks broadcast or sort-merge from facts.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

