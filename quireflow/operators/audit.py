"""Constraints as queries: domains, keys, required columns, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quireflow.schemas import DOMAINS, REQUIRED


def domain_violations(rows: DataFrame, table: str) -> DataFrame:
    """Values outside the allowed lists with their counts; NULL passes."""
    columns = [c for c in DOMAINS[table] if c in rows.columns]
    bad = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(c).isin(list(DOMAINS[table][c])),
                    F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")),
                )
                for c in columns
            ]
        )
    )
    return (
        rows.select(F.explode(bad).alias("v"))
        .groupBy(F.lit(table).alias("table_name"), F.col("v.column_name"), F.col("v.value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def duplicate_keys(rows: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(
            F.lit(table).alias("table_name"),
            F.lit("+".join(keys)).alias("key_name"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key_value"),
            "n",
        )
    )


def missing_required(rows: DataFrame, table: str) -> DataFrame:
    """Number of NULLs in each required column, one row per column."""
    columns = [c for c in REQUIRED[table] if c in rows.columns]
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n").select(
        F.lit(table).alias("table_name"), "column_name", "n"
    )


def orphans(children: DataFrame, books: DataFrame) -> DataFrame:
    """Rows that name a book that does not exist."""
    ids = books.select(F.col("id").alias("book_id"))
    return children.where(F.col("book_id").isNotNull()).join(ids, "book_id", "left_anti")
