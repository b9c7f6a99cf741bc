import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tools")):
    sys.path.insert(0, path)

import __spark_entry__  # noqa: E402,F401  (registers the package for Python workers)
from quireflow.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests")
        .master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression on one string value."""
    from pyspark.sql import functions as F

    def run(value, make):
        return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first()["r"]

    return run


@pytest.fixture
def many(spark):
    """Evaluate a column expression on many string values, in order."""
    from pyspark.sql import functions as F

    def run(values, make):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, c string")
        return [r["r"] for r in rows.select("i", make(F.col("c")).alias("r")).orderBy("i").collect()]

    return run
