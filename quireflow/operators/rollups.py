"""Per-book and whole-corpus counts.

Chapters are always reduced to one row per book before they meet the books
table. The reduction starts on the map side, so one very long book costs one
partial row per task. The flags are computed from ``content`` below the
shuffle; the text itself never travels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireflow.functions.text import has, written
from quireflow.operators.queues import APPROVED, attach_chapters, is_status, newest_first

PROGRESS = ("total", "generated", "approved", "pending", "waiting_review")


def chapter_counts(chapters: DataFrame) -> DataFrame:
    """Counts per book that has chapters."""
    full = written(chapters)
    return chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(full).alias("generated"),
        F.count_if(is_status("status", "approved")).alias("approved"),
        F.count_if(~full).alias("pending"),
        F.count_if(is_status("notes_status", "yes")).alias("waiting_review"),
    )


def with_counts(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every book with its counts under ``book_id``; zero without chapters."""
    joined = books.withColumnRenamed("id", "book_id").join(chapter_counts(chapters), "book_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in PROGRESS})


def book_progress(books: DataFrame, chapters: DataFrame) -> DataFrame:
    return with_counts(books.select("id", "title"), chapters).select("book_id", "title", *PROGRESS)


def progress_chapters(chapters: DataFrame) -> DataFrame:
    """The chapter list that accompanies the progress of a book."""
    return chapters.select(
        "book_id",
        F.col("chapter_number").alias("number"),
        F.coalesce("title", F.lit("")).alias("title"),
        "status",
        "notes_status",
        written(chapters).alias("has_content"),
        has(F.col("summary")).alias("has_summary"),
    )


def workflow_counts(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Totals by the ``status`` column, where pending means that status."""
    counts = chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total_chapters"),
        F.count_if(is_status("status", "approved")).alias("completed_chapters"),
        F.count_if(is_status("status", "pending")).alias("pending_chapters"),
    )
    joined = books.select(F.col("id").alias("book_id")).join(counts, "book_id", "left")
    names = ("total_chapters", "completed_chapters", "pending_chapters")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in names})


def workflow_status(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Book, counts and chapters: one row per chapter, in long form.

    A chapter list per book as one array would gather a long book in a single
    task; rows keep it spread out.
    """
    counts = workflow_counts(books, chapters)
    lines = chapters.select("book_id", "chapter_number", "title", "status", "notes_status")
    return attach_chapters(counts, lines, "total_chapters")


def status_report(books: DataFrame, chapters: DataFrame) -> DataFrame:
    report = with_counts(books, chapters).select(
        F.col("book_id").alias("id"),
        "title",
        has(F.col("outline")).alias("outline_done"),
        "status_outline_notes",
        "book_output_status",
        "generated",
        "total",
        "approved",
        *[
            F.col(c) if c in books.columns else F.lit(None).cast("string").alias(c)
            for c in ("output_docx_path", "output_pdf_path", "output_txt_path")
        ],
        "created_at",
    )
    return newest_first(report)


def progress_ratio(books: DataFrame, chapters: DataFrame) -> DataFrame:
    ratio = F.when(F.col("total") > 0, F.col("generated") / F.col("total")).otherwise(F.lit(0.0))
    return book_progress(books, chapters).select("book_id", "generated", "total", ratio.alias("ratio"))


def books_needing_chapters(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Approved books with no chapters, or with a chapter lacking content."""
    approved = books.where(F.col("status_outline_notes") == APPROVED)
    counted = with_counts(approved, chapters)
    return counted.where((F.col("total") == 0) | (F.col("pending") > 0)).withColumnRenamed("book_id", "id")


def compile_summary(results: DataFrame) -> DataFrame:
    """Per book: formats tried, succeeded, failed, and whether all succeeded."""
    ok = F.col("error").isNull()
    return results.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("formats"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.bool_and(ok).alias("all_ok"),
    )
