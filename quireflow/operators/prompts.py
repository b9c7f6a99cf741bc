"""Prompts for every generation step, one per row, as plain columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from quireflow.functions.templates import fill
from quireflow.functions.text import has, head, title_or_default, written
from quireflow.operators.context import SEGMENT, prompt_context
from quireflow.operators.queues import queued_for_outline

# Token limits and temperature of the generation calls.
OUTLINE_TOKENS = 4096
CHAPTER_TOKENS = 8192
SUMMARY_TOKENS = 500
TEMPERATURE = 0.7

TEMPLATES = {
    "outline": (
        "Plan a complete book.\n\nTitle: {title}\n\nWhat the editor asks for:\n{notes}\n\n"
        "Answer in Markdown. Open with an introduction, then 8 to 12 headings of the form "
        "'## Chapter N: Title', each with a short description, then a conclusion."
    ),
    "outline_revision": (
        "Improve the outline of the book '{title}'.\n\nCurrent outline:\n{outline}\n\n"
        "The editor's remarks:\n{feedback}\n\nKeep the Markdown structure and answer every remark."
    ),
    "chapter": (
        "Write one chapter of the book '{title}'.\n\nOutline of the book:\n{outline}\n\n{context}\n\n"
        "Chapter {number}: {chapter_title}\n{notes_section}\n"
        "Continue from the earlier chapters, follow the outline, explain with examples, keep the "
        "tone of the book, and aim for 2000 to 3000 words."
    ),
    "notes_section": "\nThe editor's notes for this chapter:\n{notes}\n",
    "summary": (
        "Sum up this chapter in 3 to 5 sentences, with its main points and conclusions.\n\n"
        "Book: {title}\nChapter {number}: {chapter_title}\n\n{content}"
    ),
    "chapter_revision": (
        "Revise a chapter of the book '{title}'.\n\nChapter {number}: {chapter_title}\n\n"
        "Current text:\n{content}\n\nThe editor's remarks:\n{feedback}\n\n"
        "Answer every remark and keep the style of the rest."
    ),
}

# Why a revision cannot start.
NO_OUTLINE_FEEDBACK = "No post-outline notes to use for regeneration"
NO_OUTLINE = "No existing outline to regenerate"
NO_CHAPTER_NOTES = "No notes provided for regeneration"


def outline_prompts(books: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    slots = {"title": F.col("title"), "notes": F.col("notes_on_outline_before")}
    return queued_for_outline(books).select("id", fill(templates["outline"], slots).alias("prompt"))


def outline_revision_prompts(books: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """A prompt, or the error that prevents one."""
    error = F.when(~has(F.col("notes_on_outline_after")), F.lit(NO_OUTLINE_FEEDBACK)).when(
        ~has(F.col("outline")), F.lit(NO_OUTLINE)
    )
    slots = {
        "title": F.col("title"),
        "outline": F.col("outline"),
        "feedback": F.col("notes_on_outline_after"),
    }
    return books.withColumn("error", error).select(
        "id",
        F.when(F.col("error").isNull(), fill(templates["outline_revision"], slots)).alias("prompt"),
        "error",
    )


def chapter_prompts(
    books: DataFrame,
    chapters: DataFrame,
    segment: int | None = SEGMENT,
    templates: Mapping[str, str] = TEMPLATES,
) -> DataFrame:
    """A prompt per chapter still without content, with all that came before.

    Contexts are built from narrow columns; ``content`` is reduced to a flag
    first so that it is never shuffled. Only due chapters get a context, and only books that have some
    are read for what came before. The book's title and outline join
    before the contexts exist, so that the contexts, the large part of a
    prompt, are not shuffled either.
    """
    narrow = chapters.select(
        "book_id",
        "chapter_number",
        "title",
        "summary",
        "notes",
        written(chapters).alias("_written"),
    )
    owners = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"), "outline")
    waiting = narrow.where(~F.col("_written")).drop("_written")
    history = narrow.select("book_id", "chapter_number", "title", "summary")
    if segment is None:
        # One window over a book's rows needs all of them.
        due = prompt_context(narrow, None).where(~F.col("_written")).drop("_written").join(owners, "book_id")
    else:
        history = history.join(waiting.select("book_id").distinct(), "book_id", "left_semi")
        due = prompt_context(waiting.join(owners, "book_id"), segment, history=history)
    notes = F.when(has(F.col("notes")), fill(templates["notes_section"], {"notes": F.col("notes")}))
    slots = {
        "title": F.col("book_title"),
        "outline": F.col("outline"),
        "context": F.col("prompt_context"),
        "number": F.col("chapter_number"),
        "chapter_title": title_or_default(F.col("title")),
        "notes_section": notes,
    }
    return due.select("book_id", "chapter_number", fill(templates["chapter"], slots).alias("prompt"))


def _with_owner(chapters: DataFrame, books: DataFrame) -> DataFrame:
    owners = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    return chapters.join(owners, "book_id", "inner")


def summary_prompts(
    books: DataFrame,
    chapters: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    summary_input: int | None = None,
) -> DataFrame:
    """A prompt per written chapter, over its whole text.

    ``summary_input`` bounds the characters given to a backend that takes no more.
    """
    content = F.col("content") if summary_input is None else head(F.col("content"), summary_input)
    rows = chapters.where(written(chapters)).select(
        "book_id", "chapter_number", "title", content.alias("content")
    )
    slots = {
        "title": F.col("book_title"),
        "number": F.col("chapter_number"),
        "chapter_title": title_or_default(F.col("title")),
        "content": F.col("content"),
    }
    return _with_owner(rows, books).select(
        "book_id", "chapter_number", fill(templates["summary"], slots).alias("prompt")
    )


def chapter_revision_prompts(
    books: DataFrame, chapters: DataFrame, templates: Mapping[str, str] = TEMPLATES
) -> DataFrame:
    """A prompt per chapter with notes; the others get an error."""
    noted = has(F.col("notes"))
    rows = chapters.select(
        "book_id",
        "chapter_number",
        "title",
        "notes",
        F.when(noted, F.col("content")).alias("content"),
    )
    slots = {
        "title": F.col("book_title"),
        "number": F.col("chapter_number"),
        "chapter_title": title_or_default(F.col("title")),
        "content": F.col("content"),
        "feedback": F.col("notes"),
    }
    return _with_owner(rows, books).select(
        "book_id",
        "chapter_number",
        F.when(noted, fill(templates["chapter_revision"], slots)).alias("prompt"),
        F.when(~noted, F.lit(NO_CHAPTER_NOTES)).alias("error"),
    )
