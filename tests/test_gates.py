import itertools

from pyspark.sql import functions as F

from quireflow.operators import gates, queues, rollups

REVIEW = [None, "pending", "yes", "no", "no_notes_needed"]
STATUS = [None, "pending", "generating", "generated", "reviewed", "approved", "error"]
TEXT = [None, "", "x"]


def test_outline_truth_table(spark):
    cases = list(itertools.product(REVIEW, TEXT))
    df = spark.createDataFrame(
        [(i, s, t) for i, (s, t) in enumerate(cases)],
        "id int, status_outline_notes string, notes_on_outline_after string",
    )
    got = {r["id"]: (r["action"], r["message"]) for r in gates.outline_gate(df).collect()}
    for i, (status, notes) in enumerate(cases):
        want = {"yes": "regenerate" if notes else "wait", "no_notes_needed": "proceed"}.get(status, "pause")
        assert got[i][0] == want
        if want == "pause":
            assert got[i][1] == f"Workflow paused. Status: {status}"


def test_chapter_truth_table(spark):
    cases = list(itertools.product(REVIEW, STATUS, TEXT, TEXT))
    assert len(cases) == 315
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "id int, notes_status string, status string, content string, notes string",
    )
    got = {r["id"]: r["action"] for r in gates.chapter_gate(df).collect()}
    for i, (review, status, content, notes) in enumerate(cases):
        if "no_notes_needed" == review or "approved" == status:
            want = "skip"
        elif not content:
            want = "generate"
        elif review == "yes":
            want = "regenerate" if notes else "wait"
        else:
            want = "pause"
        assert got[i] == want, cases[i]


CH = "id int, book_id int, chapter_number int, content string, notes string, notes_status string, status string"


def chapters(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CH)


def books(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "id int, title string, outline string, status_outline_notes string, book_output_status string, "
        "final_review_notes_status string",
    )


def test_batch_stops_at_first_wait(spark):
    b = books(spark, (1, "A", "o", "no_notes_needed", None, None), (2, "B", "o", "yes", None, None))
    c = chapters(
        spark,
        (1, 1, "x", None, "no_notes_needed", None),
        (1, 2, None, None, "pending", "pending"),
        (1, 3, "x", None, "no", "generated"),
        (1, 4, "x", None, "yes", "generated"),
        (1, 5, None, None, "pending", "pending"),
        (2, 1, None, None, "pending", "pending"),
    )
    plan = [tuple(r) for r in gates.batch_plan(b, c).orderBy("chapter_number").collect()]
    assert plan == [(1, 2, "generate", "generate"), (1, 3, "pause", "keep_existing")]
    auto = gates.batch_plan(b, c, auto_approve=True).orderBy("chapter_number").collect()
    assert [r["chapter_number"] for r in auto] == [2, 3, 4, 5]
    assert [tuple(r) for r in gates.batch_blocked(b).collect()] == [
        (2, "Book outline not approved. Status: yes")
    ]


def test_compile_gate_follows_content_not_approval(spark):
    b = books(
        spark,
        (1, "A", "o", "x", None, None),
        (2, "B", "o", "x", None, "yes"),
        (3, "C", "o", "x", None, None),
    )
    c = chapters(spark, (1, 1, "x", None, None, None), (2, 1, "", None, None, None))
    got = {r["book_id"]: (r["can_compile"], r["issues"]) for r in gates.compile_gate(b, c).collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, ["Waiting for final review notes", "1 chapters not generated"])
    assert got[3] == (False, ["No chapters found"])


def step(spark, b, c):
    r = gates.corpus_step(b, c).first()
    return r["step"], r["pending_books"]


def test_corpus_steps(spark):
    ok = "no_notes_needed"
    none = chapters(spark, (99, 1, "x", None, None, None))
    done = chapters(spark, (1, 1, "x", None, None, None))
    assert step(spark, books(spark, (1, "", "", "", "", "")).limit(0), none) == (1, 0)
    assert step(spark, books(spark, (1, "A", "", ok, None, None)), none) == (2, 1)
    assert step(spark, books(spark, (1, "A", "o", "yes", None, None)), none) == (2, 1)
    assert step(spark, books(spark, (1, "A", "o", ok, None, None)), none) == (3, 1)
    assert step(spark, books(spark, (1, "A", "o", ok, None, None)), done) == (4, 1)
    assert step(spark, books(spark, (1, "A", "o", ok, "completed", None)), done) == (5, 0)


def test_run_route_compiles_zero_of_zero(spark):
    ok = "no_notes_needed"
    b = books(
        spark,
        (1, "A", "no headings", ok, None, None),
        (2, "B", "## Chapter 1: x", ok, None, None),
        (3, "C", None, ok, None, None),
        (4, "D", "o", None, None, None),
        (5, "E", "o", ok, None, None),
        (6, "F", "o", ok, None, None),
    )
    c = chapters(spark, (5, 1, "x", None, None, "generated"), (6, 1, "x", None, None, "approved"))
    got = {r["book_id"]: (r["step"], r["message"]) for r in gates.run_route(b, c).collect()}
    assert got == {
        1: ("compile", None),
        2: ("generate", None),
        3: ("outline", None),
        4: ("stop", None),
        5: ("wait", "Chapters not fully approved: 0/1"),
        6: ("compile", None),
    }


def test_two_meanings_of_pending(spark):
    b = books(spark, (1, "A", "o", None, None, None))
    c = chapters(spark, (1, 1, "x", None, None, "pending"), (1, 2, "", None, None, "generated"))
    assert rollups.book_progress(b, c).first()["pending"] == 1
    assert rollups.workflow_counts(b, c).first()["pending_chapters"] == 1
    p = rollups.book_progress(b, c).first()
    assert p["pending"] + p["generated"] == p["total"] == 2


def test_null_status_is_not_approved(spark):
    c = chapters(spark, (1, 1, "x", None, None, None), (1, 2, "x", None, None, "approved"))
    assert [r["id"] for r in queues.unapproved_chapters(c).collect()] == [0]
    b = books(spark, (1, "A", "o", "no_notes_needed", None, None))
    assert queues.ready_to_compile(b).count() == 1


def test_book_without_chapters_keeps_its_row(spark):
    b = books(spark, (1, "A", "o", None, None, None)).withColumns(
        {
            "created_at": F.lit(None).cast("timestamp"),
            "notes_on_outline_before": F.lit(""),
            "notes_on_outline_after": F.lit("x"),
        }
    )
    c = chapters(spark, (2, 1, "x", None, None, None)).withColumn("title", F.lit(None).cast("string"))
    rows = queues.book_details(b, c).collect()
    assert len(rows) == 1 and rows[0]["chapter_number"] is None and rows[0]["total_chapters"] == 0
    assert (rows[0]["has_pre_notes"], rows[0]["has_post_notes"]) == (False, True)
