"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# The last setting stops PySpark from recording a call site for every column
# expression, which is most of the driver's time on long expressions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app_name: str = "quireflow") -> SparkSession.Builder:
    """A builder with the settings the operators assume (UTC and adaptive plans)."""
    b = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh path that every executor can reach, removed when the session's JVM ends.

    It lies below the folder that the cluster names in ``spark.checkpoint.dir``.
    There is no fallback to a machine-local folder: executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder shared by all executors")
    path = "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once and go on from its written result.

    For results that must not be computed twice, such as generated text: the
    written table survives the loss of executors and cuts the lineage.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
