import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "ledgerloom-tests")
    yield session
    session.stop()


SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def one_value(spark):
    """Evaluate a column function over a list of inputs."""

    def run(fn, values, schema="v string"):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        out = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return run
