"""What happens next to a book, a chapter, or the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.functions.outline import outline_chapters
from quireflow.functions.text import has, written
from quireflow.operators.queues import APPROVED, is_status
from quireflow.operators.rollups import with_counts

# The messages that go with each decision.
OUTLINE_MESSAGES = {
    "regenerate": "Post-outline notes found. Ready to regenerate outline.",
    "wait": "Waiting for editor to review and add notes.",
    "proceed": "Ready to proceed to chapter generation.",
    "pause": "Workflow paused. Status: ",
}
CHAPTER_MESSAGES = {
    "skip": "Chapter already approved",
    "regenerate": "Notes provided. Ready to regenerate.",
    "wait": "Waiting for editor review/notes",
    "generate": "Ready for generation",
    "pause": "Paused. Status: ",
}
FINAL_REVIEW_OPEN = "Waiting for final review notes"
NO_CHAPTERS = "No chapters found"
NOT_GENERATED = " chapters not generated"
STEP_MESSAGES = {
    "no_books": "Let's start by adding your first book!",
    "needs_outline": " book(s) need outlines generated.",
    "needs_approval": " outline(s) ready for your review!",
    "needs_chapters": " book(s) ready for chapter generation!",
    "needs_compile": " book(s) ready to be compiled!",
    "complete": "All books are complete!",
}


def _message(action: Column, messages: dict[str, str], status: Column) -> Column:
    out = F.when(
        action == "pause", F.concat(F.lit(messages["pause"]), F.coalesce(status, F.lit("None")))
    )
    for name, text in messages.items():
        if name != "pause":
            out = out.when(action == name, text)
    return out


def outline_action() -> Column:
    status = F.col("status_outline_notes")
    return (
        F.when((status == "yes") & has(F.col("notes_on_outline_after")), "regenerate")
        .when(status == "yes", "wait")
        .when(status == APPROVED, "proceed")
        .otherwise("pause")
    )


def chapter_action(chapters: DataFrame) -> Column:
    full, asked = written(chapters), F.col("notes_status") == "yes"
    return (
        F.when((F.col("notes_status") == APPROVED) | (F.col("status") == "approved"), "skip")
        .when(full & has(F.col("notes")) & asked, "regenerate")
        .when(full & asked, "wait")
        .when(~full, "generate")
        .otherwise("pause")
    )


def outline_gate(books: DataFrame) -> DataFrame:
    status = F.col("status_outline_notes")
    return books.withColumn("action", outline_action()).withColumn(
        "message", _message(F.col("action"), OUTLINE_MESSAGES, status)
    )


def chapter_gate(chapters: DataFrame) -> DataFrame:
    """Adds action, message and the status the decision refers to."""
    gate_status = F.when(F.col("action") == "generate", F.col("status")).otherwise(F.col("notes_status"))
    return (
        chapters.withColumn("action", chapter_action(chapters))
        .withColumn("message", _message(F.col("action"), CHAPTER_MESSAGES, F.col("notes_status")))
        .withColumn("gate_status", gate_status)
    )


def batch_plan(books: DataFrame, chapters: DataFrame, auto_approve: bool = False) -> DataFrame:
    """Chapters the batch run works on, in order, per approved book.

    A run ends at the first chapter that waits for an editor. The first
    waiting number per book is a two-phase minimum, joined to the approved
    books while both have one row per book; chapters then meet that small
    side once. A window over each book would put a long book in one task.
    """
    gated = chapters.select(
        "book_id",
        "chapter_number",
        chapter_action(chapters).alias("action"),
        written(chapters).alias("_written"),
    )
    runs = books.where(F.col("status_outline_notes") == APPROVED).select(F.col("id").alias("book_id"))
    due = F.col("action") != "skip"
    if not auto_approve:
        stops = (
            gated.where(F.col("action") == "wait")
            .groupBy("book_id")
            .agg(F.min("chapter_number").alias("_stop"))
        )
        runs = runs.join(stops, "book_id", "left")
        due = due & (F.col("_stop").isNull() | (F.col("chapter_number") < F.col("_stop")))
    work = F.when(F.col("_written"), "keep_existing").otherwise("generate")
    return (
        gated.join(runs, "book_id", "inner")
        .where(due)
        .select("book_id", "chapter_number", "action", work.alias("work"))
    )


def batch_blocked(books: DataFrame) -> DataFrame:
    """Books the batch run refuses, with the reason."""
    status = F.col("status_outline_notes")
    return books.where(~is_status("status_outline_notes", APPROVED)).select(
        F.col("id").alias("book_id"),
        F.concat(F.lit("Book outline not approved. Status: "), F.coalesce(status, F.lit("None"))).alias("error"),
    )


def compile_gate(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Whether each book may be compiled, and what stands in the way."""
    counted = with_counts(books.select("id", "final_review_notes_status"), chapters)
    issues = F.array_compact(
        F.array(
            F.when(is_status("final_review_notes_status", "yes"), F.lit(FINAL_REVIEW_OPEN)),
            F.when(F.col("total") == 0, F.lit(NO_CHAPTERS)),
            F.when(
                F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(NOT_GENERATED))
            ),
        )
    )
    return counted.select(
        "book_id",
        issues.alias("issues"),
        F.col("total").alias("total_chapters"),
        "generated",
        "approved",
        F.col("final_review_notes_status").alias("final_status"),
    ).withColumn("can_compile", F.size("issues") == 0)


def corpus_step(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row: the step the whole corpus is at and how many books wait there."""
    counted = with_counts(books, chapters)
    approved = is_status("status_outline_notes", APPROVED)
    outlined = has(F.col("outline"))
    totals = counted.agg(
        F.count(F.lit(1)).alias("books"),
        F.count_if(~outlined).alias("outline"),
        F.count_if(outlined & is_status("status_outline_notes", "yes")).alias("approval"),
        F.count_if(approved & ((F.col("total") == 0) | (F.col("pending") > 0))).alias("chapters"),
        F.count_if(approved & ~is_status("book_output_status", "completed")).alias("compile"),
    )
    kind = (
        F.when(F.col("books") == 0, "no_books")
        .when(F.col("outline") > 0, "needs_outline")
        .when(F.col("approval") > 0, "needs_approval")
        .when(F.col("chapters") > 0, "needs_chapters")
        .when(F.col("compile") > 0, "needs_compile")
        .otherwise("complete")
    )
    step = {"no_books": 1, "needs_outline": 2, "needs_approval": 2, "needs_chapters": 3, "needs_compile": 4}
    count = {
        "needs_outline": "outline",
        "needs_approval": "approval",
        "needs_chapters": "chapters",
        "needs_compile": "compile",
    }
    step_col, count_col = F.lit(5), F.lit(0).cast("bigint")
    message = F.lit(None).cast("string")
    for name, text in STEP_MESSAGES.items():
        here = F.col("kind") == name
        if name in step:
            step_col = F.when(here, step[name]).otherwise(step_col)
        if name in count:
            count_col = F.when(here, F.col(count[name])).otherwise(count_col)
            message = F.when(here, F.concat(F.col(count[name]).cast("string"), F.lit(text))).otherwise(message)
        else:
            message = F.when(here, F.lit(text)).otherwise(message)
    return totals.withColumn("kind", kind).select(
        step_col.alias("step"), "kind", count_col.alias("pending_books"), message.alias("message")
    )


def _cards(books: DataFrame, chapters: DataFrame) -> DataFrame:
    return with_counts(
        books.select("id", "title", "outline", "status_outline_notes", "book_output_status"), chapters
    )


def book_card(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """The one-line status of each book."""
    ratio = F.concat(
        F.lit("Chapters: "), F.col("generated").cast("string"), F.lit("/"), F.col("total").cast("string")
    )
    text = (
        F.when(is_status("book_output_status", "completed"), F.lit("Complete"))
        .when((F.col("generated") == F.col("total")) & (F.col("total") > 0), F.lit("Ready to Compile"))
        .when(is_status("status_outline_notes", APPROVED), ratio)
        .when(has(F.col("outline")), F.lit("Outline Ready for Review"))
        .otherwise(F.lit("Needs Outline"))
    )
    return _cards(books, chapters).select("book_id", "title", "generated", "total", text.alias("card"))


def book_action(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """The one thing a user can do to each book now."""
    action = (
        F.when(~has(F.col("outline")), "outline")
        .when(~is_status("status_outline_notes", APPROVED), "approve")
        .when((F.col("total") == 0) | (F.col("generated") < F.col("total")), "chapters")
        .when(~is_status("book_output_status", "completed"), "compile")
        .otherwise("none")
    )
    return _cards(books, chapters).select("book_id", action.alias("user_action"))


def run_route(books: DataFrame, chapters: DataFrame, auto_approve: bool = False) -> DataFrame:
    """The next step of an unattended run for each book.

    Approved equal to total sends a book to compilation, zero of zero
    included; a book without chapters is generated first if its outline names
    any.
    """
    cards = _cards(books, chapters)
    approved = is_status("status_outline_notes", APPROVED)
    to_write = F.when(
        F.col("total") == 0, F.size(outline_chapters(F.col("outline"))) > 0
    ).otherwise(F.col("generated") < F.col("total"))
    unapproved = F.lit("approve_outline" if auto_approve else "stop")
    step = (
        F.when(~has(F.col("outline")), F.lit("outline"))
        .when(~approved, unapproved)
        .when(to_write, F.lit("generate"))
        .when(F.col("approved") == F.col("total"), F.lit("compile"))
        .otherwise(F.lit("wait"))
    )
    message = F.when(
        F.col("step") == "wait",
        F.concat(
            F.lit("Chapters not fully approved: "),
            F.col("approved").cast("string"),
            F.lit("/"),
            F.col("total").cast("string"),
        ),
    )
    return cards.withColumn("step", step).select("book_id", "step", message.alias("message"))


def chapter_label(chapters: DataFrame) -> DataFrame:
    label = (
        F.when(is_status("status", "approved"), F.lit("Approved"))
        .when(written(chapters), F.lit("Ready for Review"))
        .otherwise(F.lit("Pending"))
    )
    return chapters.withColumn("label", label)
