"""Row changes as snapshot transforms: patches, change logs, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.functions.text import has
from quireflow.operators.queues import APPROVED

SET = "set_"


def patch_rows(rows: DataFrame, patches: DataFrame, as_of: Column | None = None, key: str = "id") -> DataFrame:
    """Update the patched columns of matching rows and stamp ``updated_at``.

    A patch column is written whenever the key matches, NULL included. With a
    boolean companion ``set_<column>`` it is written only where that is true,
    which tells "set to NULL" from "leave alone". Patches hold one row per
    key (see ``merge_patches``); unknown keys change nothing. A stored
    ``has_content`` follows the content.
    """
    columns = [c for c in patches.columns if c != key and not c.startswith(SET)]
    unknown = [c for c in columns if c not in rows.columns]
    if unknown:
        raise ValueError(f"patch has columns the table lacks: {unknown}")
    renamed = patches.select(
        F.col(key),
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in columns],
        *[F.col(SET + c).alias(f"_set_{c}") for c in columns if SET + c in patches.columns],
    )
    joined = rows.join(renamed, key, "left")
    out = []
    for c in rows.columns:
        if c in columns:
            on = F.col("_hit") & (F.col(f"_set_{c}") if SET + c in patches.columns else F.lit(True))
            out.append(F.when(on, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "has_content" and "content" in columns:
            new, old = F.col("_new_content"), F.col(c)
            on = F.col("_hit") & (F.col("_set_content") if SET + "content" in patches.columns else F.lit(True))
            out.append(F.when(on, has(new)).otherwise(old).alias(c))
        elif c == "updated_at" and as_of is not None:
            out.append(F.when(F.col("_hit"), as_of).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(out)


def merge_patches(patches: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One patch per key: for each column the last value that was set."""
    columns = [c for c in patches.columns if c not in (key, order) and not c.startswith(SET)]
    aggs = []
    for c in columns:
        on = F.col(SET + c) if SET + c in patches.columns else F.lit(True)
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")), F.when(on, F.col(order))).alias(c))
        aggs.append(F.bool_or(on).alias(SET + c))
    merged = patches.groupBy(key).agg(*aggs)
    return merged.select(
        key, *[F.col(c)["v"].alias(c) for c in columns], *[SET + c for c in columns]
    )


def latest_by_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows of an append-only change log.

    ``max_by`` keeps one candidate per key and task before the shuffle, so a
    key with very many changes is cheap.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def outline_approvals(requests: DataFrame) -> DataFrame:
    """Patches from (id, needs_notes) requests on outlines."""
    again = F.col("needs_notes")
    return requests.select(
        "id",
        F.when(again, "yes").otherwise(APPROVED).alias("status_outline_notes"),
        F.when(again, "pending").otherwise("in_progress").alias("book_output_status"),
    )


def dashboard_outline_approvals(requests: DataFrame) -> DataFrame:
    """Approval that leaves the output status as it is."""
    return requests.select("id", F.lit(APPROVED).alias("status_outline_notes"))


def chapter_approvals(requests: DataFrame) -> DataFrame:
    return requests.select(
        "id", F.lit(APPROVED).alias("notes_status"), F.lit("approved").alias("status")
    )


def final_review_approvals(requests: DataFrame) -> DataFrame:
    return requests.select("id", F.lit(APPROVED).alias("final_review_notes_status"))


def _patch_where(results: DataFrame, ok: dict[str, Column], failed: dict[str, Column]) -> DataFrame:
    """Patch columns that apply on success or on failure only."""
    good = F.col("error").isNull()
    cols: list[Column] = [F.col("id")]
    for name in {**ok, **failed}:
        a, b = ok.get(name), failed.get(name)
        null = F.lit(None).cast("string")
        cols.append(F.when(good, null if a is None else a).otherwise(null if b is None else b).alias(name))
        if a is None or b is None:
            cols.append((good if b is None else ~good).alias(SET + name))
    return results.select(cols)


def outline_results(results: DataFrame, regenerated: bool = False) -> DataFrame:
    """Patches from generated outlines (id, text, error).

    A failed first outline marks the book; a failed revision changes nothing.
    """
    ok = {"outline": F.col("text"), "status_outline_notes": F.lit("yes")}
    if regenerated:
        return _patch_where(
            results.where(F.col("error").isNull()),
            {**ok, "notes_on_outline_after": F.lit(None).cast("string")},
            {},
        )
    return _patch_where(results, ok, {"book_output_status": F.lit("error")})


def chapter_results(results: DataFrame, regenerated: bool = False) -> DataFrame:
    """Patches from generated chapters (id, content, summary, error)."""
    ok = {
        "content": F.col("content"),
        "summary": F.col("summary"),
        "notes_status": F.lit("yes"),
        "status": F.lit("generated"),
    }
    if regenerated:
        return _patch_where(
            results.where(F.col("error").isNull()), {**ok, "notes": F.lit(None).cast("string")}, {}
        )
    return _patch_where(results, ok, {"status": F.lit("error")})


def approved_too(results: DataFrame, approved: DataFrame) -> DataFrame:
    """Patches of ``chapter_results``, with the chapters of ``approved`` (id) approved by the same patch."""
    joined = results.join(approved.select("id", F.lit(True).alias("_approved")), "id", "full")
    yes, given = F.coalesce("_approved", F.lit(False)), set(results.columns)
    to = {"status": F.lit("approved"), "notes_status": F.lit(APPROVED)}
    out = [F.col("id")]
    for c in (c for c in results.columns if c != "id" and not c.startswith(SET)):
        was_set = F.coalesce(F.col(SET + c), F.lit(False)) if SET + c in given else F.col("status").isNotNull()
        out += [F.when(yes, to[c]).otherwise(F.col(c)).alias(c), (was_set | yes).alias(SET + c)] if c in to else [c, was_set.alias(SET + c)]
    return joined.select(out)


def completed_books(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Patches for requested books without a failed format.

    A request for no format at all has no failure and completes the book.
    """
    failed = results.where(F.col("error").isNotNull()).select(F.col("book_id").alias("id")).distinct()
    return requested.select("id").join(failed, "id", "left_anti").select(
        "id", F.lit("completed").alias("book_output_status")
    )


def cascade_delete(
    books: DataFrame, chapters: DataFrame, log: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the doomed books; log rows of no book stay."""
    ids = doomed.select("id").distinct()
    refs = ids.withColumnRenamed("id", "book_id")
    return (
        books.join(ids, "id", "left_anti"),
        chapters.join(refs, "book_id", "left_anti"),
        log.join(refs, "book_id", "left_anti"),
    )
