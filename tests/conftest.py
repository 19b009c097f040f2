import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from newsloom.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression built on literal inputs."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        df = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
        return df.select(fn(*[F.col(f"v{i}") for i in range(len(values))])).first()[0]

    return run
