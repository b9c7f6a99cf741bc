"""The training-data pipeline: stages over `documents`, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of `documents`. Null ids and texts pass through
every stage that does not reject them; what each stage does with them is in its
operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quireflow.llm import bpe, decontaminate, lines, near, quality
from quireflow.llm.common import col, documents, fresh, settle


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the byte network rejects; it learns outside the held-out fold."""
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.add_scores(docs, network)
    score = scored.columns[-1]
    return scored.where(F.col(score) >= quality.ACCEPT).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines; the count of characters follows the text."""
    out = lines.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([col(docs, c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate class."""
    return near.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests that show they decode to the text."""
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    keep = [c for c in docs.columns if c != "text"]
    plain = docs.select(*[col(docs, c).alias(f"c{i}") for i, c in enumerate(keep)], "text")
    out = bpe.encode_documents(plain, tokens, public_tokenizers.PATTERN, keep=plain.columns[:-1], ids=True)
    # What is made gets a longer name where a column has its own already.
    return out.toDF(*keep, *fresh(docs.select(*[col(docs, c) for c in keep]), *out.columns[len(keep) :]))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]

# The classifier, the signatures and BPE are beyond SQL; tests/llm/test_pipeline.py
# has the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage applied to what the one before kept."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
