"""Cleaning, validating and deduplicating title submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireflow.functions.text import has, strip, title_key

# Fixed value: the reason recorded on a submission without notes.
MISSING_NOTES = "Missing notes_on_outline_before - required before generating outline"


def clean_submissions(submissions: DataFrame) -> DataFrame:
    """Drop rows without a title; trim titles and notes."""
    notes = F.col("notes_on_outline_before")
    return submissions.where(has(F.col("title"))).select(
        "row_number",
        strip(F.col("title")).alias("title"),
        F.when(has(notes), strip(notes)).otherwise(notes).alias("notes_on_outline_before"),
    )


def validate_submissions(cleaned: DataFrame) -> DataFrame:
    """Add ``_error``: NULL for valid rows, the reason for invalid ones."""
    return cleaned.withColumn(
        "_error", F.when(~has(F.col("notes_on_outline_before")), F.lit(MISSING_NOTES))
    )


def valid_submissions(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(has(F.col("notes_on_outline_before")))


def dedupe_submissions(valid: DataFrame, library: DataFrame) -> DataFrame:
    """Label each submission ``created`` or ``skipped``.

    A title is created exactly once, by its first row in the order of row
    number and then of the other columns, and only if the library does not hold
    it. Row numbers restart in every sheet, so rows may agree in all columns;
    these are counted together and all but one of them are skipped. The first
    row per title comes from a two-phase minimum and is joined back on the whole
    row, so a title that fills a third of the submissions is spread over all
    tasks in both steps.
    """
    columns = valid.columns
    rows = valid.groupBy(*columns).agg(F.count("*").alias("_n"))
    order = F.struct("row_number", *[c for c in columns if c != "row_number"])
    keyed = rows.withColumn("_key", title_key(F.col("title"))).withColumn("_row", order)
    # Only titles that the sheet names are looked for, so the sheet's keys are the side that is broadcast or, where
    # they are too many, that filters the library's scan before its shuffle.
    asked = valid.select(title_key(F.col("title")).alias("_key"))
    held = library.select(title_key(F.col("title")).alias("_key")).join(asked, "_key", "left_semi").distinct()
    first = (
        keyed.groupBy("_key")
        .agg(F.min("_row").alias("_first"))
        .join(held, "_key", "left_anti")
        .select(F.col("_key").alias("_first_key"), "_first")
    )
    same = (F.col("_key") == F.col("_first_key")) & F.col("_row").eqNullSafe(F.col("_first"))
    created = F.col("_first_key").isNotNull() & (F.col("_copy") == 1)
    return (
        keyed.join(first, same, "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
        .select(*columns, F.when(created, "created").otherwise("skipped").alias("label"))
    )


def ingest_summary(cleaned: DataFrame, library: DataFrame) -> DataFrame:
    """How many submissions were created, skipped and invalid."""
    labelled = dedupe_submissions(valid_submissions(cleaned), library).select("label")
    invalid = cleaned.where(~has(F.col("notes_on_outline_before"))).select(F.lit("invalid").alias("label"))
    return labelled.unionByName(invalid).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
