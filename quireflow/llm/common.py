"""What the operators share: scratch tables, column names, word and line expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The six characters that part words (0x20 and 0x09 to 0x0D).
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach, removed when the session's JVM ends.

    It lies below ``spark.checkpoint.dir``; where that is unset (as in tests),
    below the warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    path = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Run ``df`` once; go on from its table in the shared folder, which outlives executors.

    ``by`` names its last column, by whose values the table's files are parted.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots included; ``run`` goes by the places of columns."""
    names = [f"c{i}" for i in range(len(schema))]

    def named(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(named, plain).toDF(*schema.names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text, as an array; of a null text, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines of a text, parted by newlines only; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def unit_key(unit: Column) -> Column:
    """A 128-bit digest of a line or paragraph, lower-cased, white space trimmed and folded."""
    return F.unhex(F.md5(F.regexp_replace(F.lower(F.btrim(unit, F.lit(BLANKS))), BLANK + "+", " ")))


def has_word(unit: Column) -> Column:
    return F.btrim(unit, F.lit(BLANKS)) != ""
