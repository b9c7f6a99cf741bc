"""Chapters kept as a table that is patched in place: a state in buckets, and texts that are only added.

A chapter's state (all but its texts, with flags and the versions of its texts) lies in
one of a fixed number of buckets, by a hash of its id. A patch rewrites the buckets
that hold a chapter it names, and reads no other. Texts are never rewritten or
moved: a patch adds its new texts under a version of its own, from the tasks
that hold them, and the state names the version that counts. What no state names
is dead, be it replaced or left by a patch that failed half-way, until ``compact``.

    <path>/settings                         number of buckets
    <path>/state/bucket=<b>                 one file
    <path>/<text>/version=<v>/bucket=<b>    for each column of texts
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quireflow.functions.text import has
from quireflow.operators.mutations import SET, patch_rows
from quireflow.session import settle
from quireflow.sources.tables import TEXTS

AT = "_at"


class ChapterStore:
    """Stored chapters; see the module. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.buckets = spark.read.parquet(f"{path}/settings").first()["buckets"]

    @classmethod
    def create(cls, chapters: DataFrame, path: str, buckets: int) -> ChapterStore:
        """Stores whole chapters; the number of buckets stays."""
        spark = chapters.sparkSession
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/settings")
        store = cls(spark, path)
        store.add(chapters)
        return store

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _add_texts(self, rows: DataFrame, column: str, version: str) -> None:
        """Texts of (id, column) where there are any; each task writes its own, by bucket."""
        kept = rows.where(F.col(column).isNotNull()).select("id", F.col(column).alias("text"), self._bucket(F.col("id")))
        kept.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{column}/version={version}")

    def _versioned(self, rows: DataFrame, version: str, known: Sequence[str] = ()) -> DataFrame:
        """Rows with versions in place of texts; ``known`` have a flag that says whether they are set."""
        out = rows
        for c in (c for c in TEXTS if c in rows.columns):
            out = out.withColumn(c + AT, F.when(F.col(c).isNotNull(), F.lit(version)))
            if c == "content":
                out = out.withColumn("has_content", has(F.col(c)))
            if c in known:
                out = out.withColumn(SET + c + AT, F.col(SET + c))
                out = out.withColumn(SET + "has_content", F.col(SET + c)) if c == "content" else out
        return out.drop(*TEXTS, *[SET + c for c in TEXTS])

    def add(self, chapters: DataFrame) -> None:
        """Adds chapters that are not stored yet."""
        version = uuid.uuid4().hex
        for c in TEXTS:
            self._add_texts(chapters.select("id", c), c, version)
        state = self._versioned(chapters.drop("has_content"), version)
        rows = state.withColumn("bucket", self._bucket(F.col("id"))).repartition("bucket")
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/state")

    def state(self) -> DataFrame:
        """The state of all chapters, with ``has_content``; no text is read."""
        return self.spark.read.parquet(f"{self.path}/state")

    def chapters(self, texts: Sequence[str] = TEXTS) -> DataFrame:
        """Chapters with these of their texts; others are not read."""
        rows = self.state()
        for c in texts:
            kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType()),
                                 T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
            told = self.spark.read.schema(kind).parquet(f"{self.path}/{c}").select(
                F.col("id").alias("_id"), F.col("text").alias(c), F.col("version").alias("_version"), F.col("bucket").alias("_bucket")
            )
            own = (F.col("id") == F.col("_id")) & (F.col(c + AT) == F.col("_version")) & (F.col("bucket") == F.col("_bucket"))
            rows = rows.join(told, own, "left").drop("_id", "_version", "_bucket")
        return rows.drop("bucket", *[c + AT for c in TEXTS])

    def patch(self, patches: DataFrame, as_of: Column | None = None) -> None:
        """``patch_rows`` on the stored chapters, one patch per id; ``patches`` is read more than once.

        Texts of ids that are not stored are written, and are dead.
        """
        version = uuid.uuid4().hex
        for c in (c for c in TEXTS if c in patches.columns):
            on = F.col(SET + c) if SET + c in patches.columns else F.lit(True)
            self._add_texts(patches.where(on).select("id", c), c, version)
        flagged = [c for c in TEXTS if SET + c in patches.columns]
        narrow = settle(self._versioned(patches, version, flagged), "patches")
        # At most as many numbers as there are buckets.
        touched = [r["bucket"] for r in narrow.select(self._bucket(F.col("id"))).distinct().collect()]
        if not touched:
            return
        after = self.patched(narrow, touched, as_of)
        after = settle(after.repartition("bucket"), "patched")
        writer = after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.path}/state")

    def patched(self, narrow: DataFrame, buckets: Sequence[int], as_of: Column | None = None) -> DataFrame:
        """The state rows of these buckets, after a patch without texts."""
        return patch_rows(self.state().where(F.col("bucket").isin(list(buckets))), narrow, as_of)

    def compact(self, path: str, buckets: int | None = None) -> ChapterStore:
        """A new store of what counts, with as many buckets as asked for; the old one stays as it is."""
        return ChapterStore.create(self.chapters(), path, buckets or self.buckets)
