"""The three stages of production as whole-corpus jobs.

Each takes the current tables and returns the changed ones; the caller writes
them. Generated text is settled once before it is used (see ``settle``), so
a retry never asks the backend twice for rows that are already written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.functions.text import has, written
from quireflow.operators import gates, generate, ingest, mutations, notify, prompts, queues, rollups
from quireflow.operators.context import initial_chapters
from quireflow.plans import render
from quireflow.session import settle
from quireflow.sources.stored import ChapterStore
from quireflow.sources.tables import TEXTS, append_with_defaults


def ingest_titles(submissions: DataFrame, books: DataFrame, as_of: Column | None = None) -> DataFrame:
    """New book rows for the submissions that are valid and not yet held."""
    valid = ingest.valid_submissions(ingest.clean_submissions(submissions))
    created = ingest.dedupe_submissions(valid, books).where(F.col("label") == "created")
    return append_with_defaults(created, "books", ["title"], books.schema["id"].dataType, as_of)


def outline_batch(books: DataFrame, backend: generate.Backend, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Books with outlines generated for the queue, and an event for each of these."""
    made = settle(
        generate.generate_text(prompts.outline_prompts(books), backend, prompts.OUTLINE_TOKENS), "outlines"
    )
    return mutations.patch_rows(books, mutations.outline_results(made), as_of), notify.outline_events(made)


def write_outlines(books: DataFrame, backend: generate.Backend, as_of: Column) -> DataFrame:
    """Books with outlines generated for the queue."""
    return outline_batch(books, backend, as_of)[0]


def revise_outlines(books: DataFrame, backend: generate.Backend, as_of: Column) -> DataFrame:
    """Books whose outline gate says regenerate, with revised outlines."""
    asked = prompts.outline_revision_prompts(books.where(gates.outline_action() == "regenerate"))
    made = settle(generate.generate_text(asked, backend, prompts.OUTLINE_TOKENS), "outline-revisions")
    return mutations.patch_rows(books, mutations.outline_results(made, regenerated=True), as_of)


def start_chapters(books: DataFrame, chapters: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Chapters, with rows added from the outlines of approved books."""
    return initial_chapters(queues.ready_for_chapters(books), chapters, as_of=as_of)


def chapter_batch(
    books: DataFrame,
    chapters: DataFrame,
    backend: generate.Backend,
    as_of: Column,
    auto_approve: bool = False,
    by_number: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Chapters after one batch run over all approved books, and the events of these.

    Chapters are made one number over all books at a time, so a book may be of any length; without
    ``by_number`` whole books are, each in one task, which takes one job for corpora of short books. Results and approvals are joined as narrow patches, and the chapters, texts
    included, are patched once.
    """
    started = start_chapters(books, chapters, as_of)
    plan = settle(gates.batch_plan(books, started, auto_approve), "batch-plan")
    make = generate.generate_by_number if by_number else generate.generate_chapters
    made = settle(make(plan, books, started, backend), "chapters")
    keyed = started.select("id", "book_id", "chapter_number")
    results = made.join(keyed, ["book_id", "chapter_number"]).select("id", "content", "summary", "error")
    patches = mutations.chapter_results(results)
    if auto_approve:
        failed = made.where(F.col("error").isNotNull()).groupBy("book_id").agg(F.min("chapter_number").alias("_at"))
        done = (
            plan.join(failed, "book_id", "left")
            .where(F.col("_at").isNull() | (F.col("chapter_number") < F.col("_at")))
            .join(keyed, ["book_id", "chapter_number"])
        )
        patches = mutations.approved_too(patches, done)
    return mutations.patch_rows(started, patches, as_of), notify.chapter_batch_events(made)


def write_chapters(
    books: DataFrame,
    chapters: DataFrame,
    backend: generate.Backend,
    as_of: Column,
    auto_approve: bool = False,
) -> DataFrame:
    """Chapters after one batch run over all approved books."""
    return chapter_batch(books, chapters, backend, as_of, auto_approve)[0]


def write_stored_chapters(
    books: DataFrame, store: ChapterStore, backend: generate.Backend, as_of: Column, auto_approve: bool = False
) -> DataFrame:
    """``chapter_batch`` on stored chapters, changed in place; returns the events.

    New texts go from the tasks that make them to the store. The gates read the state, contexts the
    summaries, and no step reads or moves the content of a chapter that was there.
    """
    state = store.state()
    started = start_chapters(books, state, as_of)
    new = settle(started.join(state.select("id"), "id", "left_anti").select(*state.drop("bucket").columns), "new-chapters")
    if not new.isEmpty():
        store.add(new.drop("has_content", "content_at", "summary_at").withColumns({c: F.lit(None).cast("string") for c in TEXTS}))
    told = store.chapters(("summary",))
    plan = settle(gates.batch_plan(books, told, auto_approve), "batch-plan")
    made = generate.generate_by_number(plan, books, told, backend, carry=("id",))
    done = None
    if auto_approve:
        failed = made.where(F.col("error").isNotNull()).groupBy("book_id").agg(F.min("chapter_number").alias("_at"))
        due = plan.join(failed, "book_id", "left").where(F.col("_at").isNull() | (F.col("chapter_number") < F.col("_at")))
        done = settle(due.join(told.select("id", "book_id", "chapter_number"), ["book_id", "chapter_number"]).select("id"), "approved")
    store.patch(mutations.chapter_results(made.select("id", "content", "summary", "error")), as_of)
    if done is not None:
        store.patch(mutations.chapter_approvals(done), as_of)
    return notify.chapter_batch_events(made.drop("id"))


def revise_chapters(
    books: DataFrame, chapters: DataFrame, backend: generate.Backend, as_of: Column
) -> DataFrame:
    """Chapters whose gate says regenerate, revised, with new summaries."""
    due = chapters.where(gates.chapter_action(chapters) == "regenerate")
    asked = prompts.chapter_revision_prompts(books, due)
    texts = settle(generate.generate_text(asked, backend, prompts.CHAPTER_TOKENS), "chapter-revisions")
    keyed = due.select("id", "book_id", "chapter_number", "title")
    revised = texts.join(keyed, ["book_id", "chapter_number"]).withColumnRenamed("text", "content")
    wanted = prompts.summary_prompts(books, revised)
    sums = settle(generate.generate_text(wanted, backend, prompts.SUMMARY_TOKENS), "chapter-summaries")
    results = revised.join(
        sums.select("book_id", "chapter_number", F.col("text").alias("summary"), F.col("error").alias("_e")),
        ["book_id", "chapter_number"],
        "left",
    ).select("id", "content", "summary", F.coalesce("error", "_e").alias("error"))
    return mutations.patch_rows(chapters, mutations.chapter_results(results, regenerated=True), as_of)


@dataclass
class Compiled:
    texts: DataFrame
    word_rows: DataFrame
    page_rows: DataFrame
    results: DataFrame
    books: DataFrame


def compile_books(books: DataFrame, chapters: DataFrame, as_of: Column, force: bool = False) -> Compiled:
    """All formats of every book that may be compiled, and the changed books."""
    gate = settle(gates.compile_gate(books, chapters), "compile-gate")
    chosen, kept = books, chapters.where(written(chapters))
    if not force:
        chosen = render.compilable(books, gate)
        kept = render.chapters_of(chosen, kept)
    results = render.compile_results(books, gate, force)
    patched = mutations.patch_rows(books, render.path_patches(results), as_of)
    completed = mutations.completed_books(books, results)
    return Compiled(
        texts=render.compile_text(chosen, kept, as_of),
        word_rows=render.render_rows_word(chosen, kept, as_of),
        page_rows=render.render_rows_pdf(chosen, kept, as_of),
        results=results,
        books=mutations.patch_rows(patched, completed, as_of),
    )


@dataclass
class Run:
    books: DataFrame
    chapters: DataFrame
    compiled: Compiled
    events: DataFrame


def run_unattended(
    books: DataFrame,
    chapters: DataFrame,
    backend: generate.Backend,
    as_of: Column,
    auto_approve: bool = False,
) -> Run:
    """All stages for every book, each going as far as its gates allow.

    A book is compiled when its approved chapters equal its chapters, none of
    none included, provided its outline is approved and chapters could be
    started at all.
    """
    outlined, outline_news = outline_batch(books, backend, as_of)
    if auto_approve:
        waiting = outlined.where(~queues.is_status("status_outline_notes", queues.APPROVED))
        asked = waiting.select("id", F.lit(False).alias("needs_notes"))
        outlined = mutations.patch_rows(outlined, mutations.outline_approvals(asked), as_of)
    outlined = settle(outlined, "run-books")
    finished, chapter_news = chapter_batch(outlined, chapters, backend, as_of, auto_approve)
    finished = settle(finished, "run-chapters")
    counted = rollups.with_counts(outlined, finished).withColumnRenamed("book_id", "id")
    ready = counted.where(
        queues.is_status("status_outline_notes", queues.APPROVED)
        & (has(F.col("outline")) | (F.col("total") > 0))
        & (F.col("approved") == F.col("total"))
    ).select(*outlined.columns)
    compiled = compile_books(ready, render.chapters_of(ready, finished), as_of, force=True)
    others = outlined.join(ready.select("id"), "id", "left_anti")
    drafts = render.compile_events(compiled.results)
    done = ready.select(
        F.col("id").alias("book_id"),
        F.lit("book_completed").alias("event_type"),
        F.lit(None).cast(drafts.schema["paths"].dataType).alias("paths"),
    )
    return Run(
        books=others.unionByName(compiled.books),
        chapters=finished,
        compiled=compiled,
        events=drafts.unionByName(done)
        .unionByName(outline_news, allowMissingColumns=True)
        .unionByName(chapter_news, allowMissingColumns=True),
    )
