"""Running a caller-supplied text generator over prompts and over books.

These are the only places outside ``llm`` where Python workers see rows. A backend is any
zero-argument callable that returns an object with
``generate(prompt, max_tokens, temperature) -> str``; it is opened once per
task, and a failing row yields an error instead of failing the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quireflow.functions.templates import fill
from quireflow.functions.text import UNTITLED, has, title_or_default
from quireflow.operators.context import CONTEXT_HEADER, NO_SUMMARY
from quireflow.operators.prompts import (
    CHAPTER_TOKENS,
    SUMMARY_TOKENS,
    TEMPERATURE,
    TEMPLATES,
)
from quireflow.session import settle, shared_dir

Backend = Callable[[], object]


class DigestBackend:
    """Deterministic stand-in for a text generator: the digest of the prompt."""

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        return "text " + hashlib.md5(prompt.encode("utf-8")).hexdigest()


def _attempt(backend, prompt: str, max_tokens: int, temperature: float) -> tuple[str | None, str | None]:
    try:
        return backend.generate(prompt, max_tokens, temperature), None
    except Exception as problem:  # one bad row must not end the job
        return None, str(problem) or type(problem).__name__


def generate_text(
    prompts: DataFrame,
    backend: Backend,
    max_tokens: int,
    temperature: float = TEMPERATURE,
    tasks: int | None = None,
) -> DataFrame:
    """Replaces ``prompt`` by ``text`` and ``error``; other columns pass through.

    Rows that already carry an error are passed on untouched. A backend is
    slow next to a scan: ``tasks`` deals the prompts out evenly over that many
    tasks, where the files would give fewer or uneven ones.
    """
    if tasks is not None:
        prompts = prompts.repartition(tasks)
    keep = [f for f in prompts.schema.fields if f.name not in ("prompt", "error", "text")]
    schema = T.StructType(
        keep + [T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]
    )
    names = [f.name for f in keep]
    guarded = "error" in prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = backend()
        for rows in batches:
            texts, errors = [], []
            prior = rows["error"] if guarded else [None] * len(rows)
            for prompt, known in zip(rows["prompt"], prior):
                pair = (None, known) if known is not None else _attempt(opened, prompt, max_tokens, temperature)
                texts.append(pair[0])
                errors.append(pair[1])
            out = rows[names].copy()
            out["text"] = pd.Series(texts, index=out.index, dtype=object)
            out["error"] = pd.Series(errors, index=out.index, dtype=object)
            yield out

    return prompts.mapInPandas(run, schema)


def generate_chapters(
    plan: DataFrame,
    books: DataFrame,
    chapters: DataFrame,
    backend: Backend,
    templates: Mapping[str, str] = TEMPLATES,
    tasks: int | None = None,
    summary_input: int | None = None,
) -> DataFrame:
    """Writes the planned chapters of every book, each aware of the ones before.

    A chapter's prompt holds the summary that was generated for the chapter
    before it, so a book is sequential by nature and the parallelism is across
    books. Rows are sorted by (book, number) inside hash partitions and
    streamed: a task holds one Arrow batch and the running context of one
    book, never a whole group. Only books with work enter, without their
    existing texts. A failure ends that book; its earlier chapters are kept.

    The rows are few bytes and much work, so their number of tasks is set
    (``tasks``, by default the shuffle partitions, at least one per core) and
    not left to adaptive coalescing, which goes by bytes. Summaries are made from
    whole chapters unless ``summary_input`` bounds their characters.
    """
    spark = chapters.sparkSession
    tasks = tasks or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    work = plan.where(F.col("work") == "generate").select("book_id", "chapter_number")
    active = work.select("book_id").distinct()
    owners = books.join(active.withColumnRenamed("book_id", "id"), "id", "left_semi").select(
        F.col("id").alias("book_id"), F.col("title").alias("book_title"), "outline"
    )
    rows = (
        chapters.select("book_id", "chapter_number", "title", "summary", "notes")
        .join(work.withColumn("_due", F.lit(True)), ["book_id", "chapter_number"], "left")
        .join(owners, "book_id", "inner")
        .withColumn("_due", F.coalesce("_due", F.lit(False)))
    )
    key_type = chapters.schema["book_id"].dataType
    schema = T.StructType(
        [
            T.StructField("book_id", key_type),
            T.StructField("chapter_number", chapters.schema["chapter_number"].dataType),
            T.StructField("content", T.StringType()),
            T.StructField("summary", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )
    templates = dict(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = backend()
        book, parts, any_summary, stopped = None, [], False, False
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                if book is None or r.book_id != book:
                    book, parts, any_summary, stopped = r.book_id, [], False, False
                title = UNTITLED if r.title is None else r.title
                number, summary = int(r.chapter_number), r.summary
                if r.due and not stopped:
                    context = CONTEXT_HEADER + "".join(parts) if any_summary and number > 1 else ""
                    notes = templates["notes_section"].format(notes=r.notes) if r.notes else ""
                    shared = {"title": r.book_title or "", "number": number, "chapter_title": title}
                    prompt = templates["chapter"].format(
                        outline=r.outline or "", context=context, notes_section=notes, **shared
                    )
                    content, error = _attempt(opened, prompt, CHAPTER_TOKENS, TEMPERATURE)
                    written = None
                    if error is None:
                        request = templates["summary"].format(content=content[:summary_input], **shared)
                        written, error = _attempt(opened, request, SUMMARY_TOKENS, TEMPERATURE)
                    if error is None:
                        summary = written
                        made.append((book, number, content, summary, None))
                    else:
                        made.append((book, number, None, None, error))
                        stopped = True
                parts.append(f"\nChapter {number}: {title}\n{NO_SUMMARY if summary is None else summary}\n")
                any_summary = any_summary or bool(summary)
            yield pd.DataFrame(made, columns=schema.names)

    return (
        rows.withColumnRenamed("_due", "due")
        .repartition(tasks, "book_id")
        .sortWithinPartitions("book_id", "chapter_number")
        .mapInPandas(run, schema)
    )


def generate_by_number(
    plan: DataFrame,
    books: DataFrame,
    chapters: DataFrame,
    backend: Backend,
    templates: Mapping[str, str] = TEMPLATES,
    tasks: int | None = None,
    summary_input: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The same chapters as ``generate_chapters``, one chapter number over all books at a time.

    For corpora with very long books: no task holds a book, and no running
    context lives in Python. The context of a book is kept as one row. A step takes
    the next number that is due in some book: it adds to the contexts what lies between
    the number before and this one, which is the chapter just made and those that were there already, asks for
    the chapters and then for their summaries, and writes all three. So a step reads the last contexts and the rows
    of its own numbers, whichever step it is; a book leaves when it fails or has no more due chapters. The
    steps are as many as there are due numbers. ``carry`` names columns of ``chapters`` that results have as well,
    such as an id, so that texts need no join to get it.
    """
    keys, spark = ["book_id", "chapter_number"], chapters.sparkSession
    number = F.col("chapter_number")
    work = settle(plan.where(F.col("work") == "generate").select(*keys), "work")
    owners = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"), "outline")
    until = work.groupBy("book_id").agg(F.max("chapter_number").alias("_until"))
    told = chapters.select(*keys, title_or_default(F.col("title")).alias("title"), "summary", "notes", *carry)
    told = told.join(until.select("book_id"), "book_id", "left_semi")
    # In order of number, so that a step's rows lie in few files.
    told = settle(told.repartitionByRange("chapter_number").sortWithinPartitions("chapter_number"), "told")
    contexts = settle(until.withColumns({"_before": F.lit(""), "_any": F.lit(False)}), "contexts")
    base, made, before = shared_dir(spark, "by-number"), None, None
    kinds = {f.name: f.dataType for f in chapters.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in [*keys, *carry]] + [T.StructField(c, T.StringType()) for c in ("content", "summary", "error")])

    # One row for each number that is due in some book.
    due_numbers = [r["chapter_number"] for r in work.select("chapter_number").distinct().orderBy("chapter_number").collect()]
    for step, at in enumerate(due_numbers):
        between = told.where(number < at if before is None else (number >= before) & (number < at))
        summary = F.col("summary")
        if made is not None:
            good = made.where(F.col("error").isNull()).select(*keys, F.col("summary").alias("_new"), F.lit(True).alias("_made"))
            between = between.join(good, keys, "left")
            summary = F.when(F.col("_made"), F.col("_new")).otherwise(summary)
            contexts = contexts.join(made.where(F.col("error").isNotNull()).select("book_id"), "book_id", "left_anti")
        entry = F.concat(
            F.lit("\nChapter "), number.cast("string"), F.lit(": "), F.col("title"), F.lit("\n"), F.coalesce(summary, F.lit(NO_SUMMARY)), F.lit("\n")
        )
        listed = F.array_sort(F.collect_list(F.struct("chapter_number", entry.alias("entry"))))
        added = between.groupBy("book_id").agg(
            F.array_join(F.transform(listed, lambda e: e["entry"]), "").alias("_text"), F.bool_or(has(summary)).alias("_has")
        )
        contexts = contexts.where(F.col("_until") >= at).join(added, "book_id", "left").select(
            "book_id", "_until", F.concat("_before", F.coalesce("_text", F.lit(""))).alias("_before"),
            (F.col("_any") | F.coalesce("_has", F.lit(False))).alias("_any"),
        )
        contexts = settle(contexts, "contexts")
        rows = work.where(number == at).join(contexts, "book_id").join(told.where(number == at), keys).join(owners, "book_id")
        context = F.when((number > 1) & F.col("_any"), F.concat(F.lit(CONTEXT_HEADER), F.col("_before")))
        notes = F.when(has(F.col("notes")), fill(templates["notes_section"], {"notes": F.col("notes")}))
        shared = {"title": F.col("book_title"), "number": number, "chapter_title": F.col("title")}
        slots = {**shared, "outline": F.col("outline"), "context": context, "notes_section": notes}
        asked = rows.select(*keys, *carry, "book_title", "title", fill(templates["chapter"], slots).alias("prompt"))
        texts = settle(generate_text(asked, backend, CHAPTER_TOKENS, tasks=tasks), "by-number-texts")
        given = F.col("content") if summary_input is None else F.substring("content", 1, summary_input)
        wanted = texts.withColumnRenamed("text", "content").withColumn("prompt", fill(templates["summary"], {**shared, "content": given}))
        ok = F.col("error").isNull()
        ended = generate_text(wanted, backend, SUMMARY_TOKENS, tasks=tasks)
        ended = ended.select(*keys, *carry, F.when(ok, F.col("content")).alias("content"), F.when(ok, F.col("text")).alias("summary"), "error")
        ended.write.parquet(f"{base}/step={step}")
        made, before = spark.read.schema(schema).parquet(f"{base}/step={step}"), at
    if made is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(base).select(schema.names)
