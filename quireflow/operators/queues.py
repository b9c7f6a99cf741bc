"""Lookups, work queues, orderings and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireflow.functions.text import clip, has, head, title_or_default, written

APPROVED = "no_notes_needed"


def is_status(name: str, value: str):
    """Null-safe equality: NULL is a status like any other, just not this one."""
    return F.col(name).eqNullSafe(F.lit(value))


def by_id(rows: DataFrame, key) -> DataFrame:
    return rows.where(F.col("id") == F.lit(key))


def by_ids(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("id").distinct(), "id", "left_semi")


def books_by_status(books: DataFrame, status: str) -> DataFrame:
    return books.where(F.col("book_output_status") == status)


def newest_first(books: DataFrame) -> DataFrame:
    return books.orderBy(F.col("created_at").desc(), "id")


def next_book(books: DataFrame) -> DataFrame:
    return newest_first(books).limit(1)


def chapters_in_order(chapters: DataFrame, book_id=None) -> DataFrame:
    """Chapters by number: of one book, or of all books."""
    if book_id is not None:
        return chapters.where(F.col("book_id") == F.lit(book_id)).orderBy("chapter_number")
    return chapters.orderBy("book_id", "chapter_number")


def summaries_before(chapters: DataFrame, book_id, up_to: int) -> DataFrame:
    """Summaries of chapters 1 to ``up_to`` of one book."""
    return (
        chapters.where((F.col("book_id") == F.lit(book_id)) & (F.col("chapter_number") < up_to + 1))
        .select("chapter_number", "title", "summary")
        .orderBy("chapter_number")
    )


def book_notifications(log: DataFrame, book_id=None) -> DataFrame:
    newest = [F.col("sent_at").desc(), F.col("id")]
    if book_id is not None:
        return log.where(F.col("book_id") == F.lit(book_id)).orderBy(*newest)
    return log.orderBy("book_id", *newest)


def outline_queue(books: DataFrame) -> DataFrame:
    """Why each book is queued for an outline, or is not."""
    reason = (
        F.when(has(F.col("outline")), "has_outline")
        .when(~has(F.col("notes_on_outline_before")), "no_notes")
        .otherwise("queued")
    )
    return books.withColumn("reason", reason)


def queued_for_outline(books: DataFrame) -> DataFrame:
    return books.where(~has(F.col("outline")) & has(F.col("notes_on_outline_before")))


def pending_reviews(books: DataFrame) -> DataFrame:
    return books.where(has(F.col("outline")) & (F.col("status_outline_notes") == "yes")).select(
        "id",
        "title",
        F.col("status_outline_notes").alias("status"),
        has(F.col("outline")).alias("has_outline"),
        has(F.col("notes_on_outline_after")).alias("has_post_notes"),
    )


def ready_for_chapters(books: DataFrame, require_outline: bool = True) -> DataFrame:
    ready = books.where(F.col("status_outline_notes") == APPROVED)
    return ready.where(has(F.col("outline"))) if require_outline else ready


def pending_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.where(~written(chapters))


def unapproved_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.where(written(chapters) & ~is_status("status", "approved"))


def ready_to_compile(books: DataFrame) -> DataFrame:
    return books.where(
        ~is_status("book_output_status", "completed") & is_status("status_outline_notes", APPROVED)
    )


def book_previews(books: DataFrame) -> DataFrame:
    return books.where(has(F.col("outline"))).select(
        "id", clip(F.col("outline"), 500, always_mark=True).alias("outline_preview")
    )


def chapter_previews(chapters: DataFrame) -> DataFrame:
    title = title_or_default(F.col("title"))
    return chapters.select(
        "id",
        head(title, 40).alias("title_card"),
        head(F.coalesce("title", F.lit("")), 30).alias("title_progress"),
        F.when(written(chapters), clip(F.col("content"), 3000)).alias("content_preview"),
        head(F.col("content"), 8000).alias("content_for_summary"),
        F.concat(head(F.col("summary"), 100), F.lit("...")).alias("summary_preview"),
    )


def attach_chapters(books: DataFrame, chapters: DataFrame, total: str) -> DataFrame:
    """Books with their chapters, keeping books without any.

    ``books`` carries its chapter count in ``total``. An inner join plus the
    books whose count is zero equals a left join, but lets the adaptive plan
    split a book that holds a large share of all chapters; a left join cannot
    split its right side.
    """
    joined = books.join(chapters, "book_id", "inner")
    return joined.unionByName(books.where(F.col(total) == 0), allowMissingColumns=True)


def book_details(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per chapter with the flags and statuses of its book."""
    counts = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_chapters"))
    head_cols = books.select(
        F.col("id").alias("book_id"),
        F.col("title").alias("book_title"),
        "created_at",
        has(F.col("notes_on_outline_before")).alias("has_pre_notes"),
        has(F.col("outline")).alias("has_outline"),
        has(F.col("notes_on_outline_after")).alias("has_post_notes"),
        "status_outline_notes",
        "final_review_notes_status",
        "book_output_status",
    )
    counted = head_cols.join(counts, "book_id", "left").withColumn(
        "total_chapters", F.coalesce("total_chapters", F.lit(0).cast("bigint"))
    )
    lines = chapters.select(
        "book_id",
        "chapter_number",
        head(title_or_default(F.col("title")), 40).alias("chapter_title"),
        F.when(is_status("status", "approved"), "approved")
        .when(written(chapters), "in_progress")
        .otherwise("pending")
        .alias("mark"),
        F.col("status").alias("chapter_status"),
        "notes_status",
    )
    return attach_chapters(counted, lines, "total_chapters")
