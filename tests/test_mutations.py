import datetime as dt

import pytest
from pyspark.sql import functions as F

from quireflow.operators import audit, mutations

def as_of():
    return F.lit("2024-01-02").cast("timestamp_ntz")
WHEN = dt.datetime(2024, 1, 2)


def table(spark):
    return spark.createDataFrame(
        [(1, "a", "x", None), (2, "b", "y", None), (3, "c", None, None)],
        "id int, status string, notes string, updated_at timestamp_ntz",
    )


def rows(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def test_null_clears_and_unset_keeps(spark):
    patches = spark.createDataFrame(
        [(1, None, "new", False), (2, None, "ignored", None), (9, "z", "z", True)],
        "id int, notes string, status string, set_status boolean",
    )
    got = rows(mutations.patch_rows(table(spark), patches, as_of()))
    assert got == {1: ("a", None, WHEN), 2: ("b", None, WHEN), 3: ("c", None, None)}


def test_unknown_column_is_refused(spark):
    with pytest.raises(ValueError, match="nope"):
        mutations.patch_rows(table(spark), spark.createDataFrame([(1, 1)], "id int, nope int"))


def test_two_patches_for_one_key(spark):
    patches = spark.createDataFrame(
        [(1, 1, "s1", True, "n1", True), (1, 2, None, False, None, True), (2, 1, "s2", True, None, False)],
        "id int, seq int, status string, set_status boolean, notes string, set_notes boolean",
    )
    merged = mutations.merge_patches(patches, "seq")
    got = rows(mutations.patch_rows(table(spark), merged, as_of()))
    assert got[1][:2] == ("s1", None)
    assert got[2][:2] == ("s2", "y")


def test_latest_by_key(spark):
    log = spark.createDataFrame(
        [(1, 1, "a"), (1, 3, None), (1, 2, "b"), (2, 1, "c")], "id int, seq int, v string"
    )
    got = rows(mutations.latest_by_key(log, ["id"], ["seq"]))
    assert got == {1: (3, None), 2: (1, "c")}


def test_outline_failure_marks_the_book_only(spark):
    books = spark.createDataFrame(
        [(1, None, "pending", "pending"), (2, None, "pending", "pending")],
        "id int, outline string, status_outline_notes string, book_output_status string",
    )
    made = spark.createDataFrame([(1, "o", None), (2, None, "boom")], "id int, text string, error string")
    got = rows(mutations.patch_rows(books, mutations.outline_results(made)))
    assert got == {1: ("o", "yes", "pending"), 2: (None, "pending", "error")}


def test_regeneration_clears_notes_and_failure_changes_nothing(spark):
    chapters = spark.createDataFrame(
        [(1, "old", "s", "n", "yes", "reviewed"), (2, "old", "s", "n", "yes", "reviewed")],
        "id int, content string, summary string, notes string, notes_status string, status string",
    )
    made = spark.createDataFrame(
        [(1, "new", "s2", None), (2, None, None, "boom")],
        "id int, content string, summary string, error string",
    )
    got = rows(mutations.patch_rows(chapters, mutations.chapter_results(made, regenerated=True)))
    assert got[1] == ("new", "s2", None, "yes", "generated")
    assert got[2] == ("old", "s", "n", "yes", "reviewed")


def test_approvals_of_both_kinds(spark):
    asked = spark.createDataFrame([(1, True), (2, False)], "id int, needs_notes boolean")
    got = rows(mutations.outline_approvals(asked))
    assert got == {1: ("yes", "pending"), 2: ("no_notes_needed", "in_progress")}
    assert mutations.dashboard_outline_approvals(asked).columns == ["id", "status_outline_notes"]


def test_no_format_completes_a_book(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    results = spark.createDataFrame(
        [(2, "txt", None), (3, "txt", None), (3, "pdf", "boom")], "book_id int, format string, error string"
    )
    got = {r["id"] for r in mutations.completed_books(asked, results).collect()}
    assert got == {1, 2}


def test_cascade_keeps_log_rows_of_no_book(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, book_id int")
    books, chapters, log = mutations.cascade_delete(
        ids, children.where("book_id is not null"), children, ids.where("id = 1")
    )
    assert [r["id"] for r in books.collect()] == [2]
    assert [r["id"] for r in chapters.collect()] == [11]
    assert {r["id"] for r in log.collect()} == {11, 12}


def test_audits(spark):
    log = spark.createDataFrame(
        [(1, 1, "chapters_generated", "sent"), (1, None, "chapter_ready", None), (None, 7, None, "lost")],
        "id int, book_id int, event_type string, status string",
    )
    bad = {(r["column_name"], r["value"]): r["n"] for r in audit.domain_violations(log, "notifications_log").collect()}
    assert bad == {("event_type", "chapters_generated"): 1, ("status", "lost"): 1}
    assert [tuple(r) for r in audit.duplicate_keys(log, "notifications_log", ["id"]).collect()] == [
        ("notifications_log", "id", "1", 2)
    ]
    missing = {r["column_name"]: r["n"] for r in audit.missing_required(log, "notifications_log").collect()}
    assert missing == {"id": 1, "event_type": 1}
    books = spark.createDataFrame([(1,)], "id int")
    assert [r["book_id"] for r in audit.orphans(log, books).collect()] == [7]
