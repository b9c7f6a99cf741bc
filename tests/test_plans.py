"""What the physical plans of single operators must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from __spark_entry__ import queries
from quireflow.operators import context, gates, mutations, prompts, queues, rollups
from quireflow.operators.queues import by_id
from quireflow.plans import render
from quireflow.sources.tables import save_by_book, scan_state, scan_stored, store_apart, store_chapters, with_texts

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when both sides of every join are large."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return [re.sub(r"#\d+L?", "", e) for e in re.findall(r"Exchange (hashpartitioning\([^)]*\))", plan)]


def test_key_lookup_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("event_id", "id")
    assert "EqualTo(event_id,5)" in plan_of(by_id(df, 5))


def test_batch_plan_reads_only_its_columns(spark):
    plan = plan_of(queries()["batch_plan_wide"](spark, SF))
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_no_window_over_a_book(spark, no_broadcast):
    for name in ("batch_plan", "dedupe_submissions", "book_progress", "compile_text", "render_rows_word"):
        assert "Window" not in plan_of(queries()[name](spark, SF)), name


def test_context_is_grouped_by_segment(spark, no_broadcast):
    df = spark.range(10).selectExpr(
        "id AS book_id", "CAST(id AS INT) AS chapter_number", "'t' AS title", "'s' AS summary"
    )
    found = exchanges(plan_of(context.chapter_context(df, 4)))
    by_segment = [e for e in found if "_seg" in e]
    assert len(by_segment) >= 2, found


def test_prompts_are_not_shuffled(spark, no_broadcast):
    plan = plan_of(queries()["chapter_prompts"](spark, SF))
    # Contexts are made above the first join, where what came before meets the due rows.
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")] and "Window" not in plan


def test_contexts_need_no_window(spark, no_broadcast):
    for name in ("chapter_context", "prompt_context", "chapter_prompts"):
        assert "Window" not in plan_of(queries()[name](spark, SF)), name


def test_rendering_rows_needs_no_shuffle(spark):
    books = spark.range(5).selectExpr("id", "'t' AS title")
    chapters = spark.range(5).selectExpr(
        "id AS book_id", "1 AS chapter_number", "'t' AS title", "CAST(id AS STRING) AS content"
    )
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    for make in (render.render_rows_word, render.render_rows_pdf, render.text_sections, render.compile_text):
        assert "Exchange" not in plan_of(make(books, chapters, as_of))


def test_rendering_rows_cleans_each_block_once(spark):
    for name, nested in (("render_rows_word", 1), ("render_rows_pdf", 0)):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # One projection cleans the texts of blocks; Word cleans the runs of bold paragraphs as well.
        assert plan.count("\\*\\*([^*]+)\\*\\*, $1") == 1 + nested, name


def test_gate_shuffles_flags_not_texts(spark, no_broadcast):
    plan = plan_of(queries()["compile_gate"](spark, SF))
    for line in plan.splitlines():
        if "Exchange" in line or "partial_count" in line:
            assert "content" not in line


def stored(spark, tmp_path):
    rows = queries()["scan_chapters"](spark, SF)
    path = str(tmp_path / "chapters")
    store_chapters(rows, path)
    return rows, scan_stored(spark, path, T.LongType())


def test_stored_flag_keeps_texts_on_disk(spark, tmp_path):
    rows, flagged = stored(spark, tmp_path)
    books = queries()["scan_books"](spark, SF)
    for make in (
        rollups.book_progress,
        gates.batch_plan,
        gates.compile_gate,
        gates.corpus_step,
        gates.book_card,
        prompts.chapter_prompts,
        queues.book_details,
    ):
        plan = plan_of(make(books, flagged))
        scans = [s for s in plan.splitlines() if "FileScan" in s and "has_content" in s]
        assert scans and not any(re.search(r"[\[,]content#", s) for s in scans), make.__name__
        plain = make(books, rows)
        assert sorted(map(repr, make(books, flagged).select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_stored_flag_follows_the_content(spark, tmp_path):
    _, flagged = stored(spark, tmp_path)
    wiped = flagged.where("has_content").select("id", F.lit(None).cast("string").alias("content"))
    after = mutations.patch_rows(flagged, wiped)
    assert after.where("has_content").count() == 0
    assert flagged.where("has_content").count() > 0


def test_tables_bucketed_by_book_meet_without_shuffle(spark, tmp_path, no_broadcast):
    books = queries()["scan_books"](spark, SF)
    save_by_book(books, "bucketed_books", str(tmp_path / "b"), 4, "id")
    save_by_book(queries()["scan_chapters"](spark, SF), "bucketed_chapters", str(tmp_path / "c"), 4)
    plan = plan_of(rollups.book_progress(spark.table("bucketed_books"), spark.table("bucketed_chapters")))
    assert "Exchange" not in plan, plan
    spark.sql("DROP TABLE bucketed_books")
    spark.sql("DROP TABLE bucketed_chapters")


def test_status_patches_move_no_text(spark, tmp_path, no_broadcast):
    rows, path = queries()["scan_chapters"](spark, SF), str(tmp_path / "apart")
    store_apart(rows, path)
    state = scan_state(spark, path)
    asked = mutations.chapter_approvals(queues.unapproved_chapters(state))
    after = mutations.patch_rows(state, asked, F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = plan_of(after)
    assert "Exchange" in plan and not re.search(r"[\[,](content|summary)#", plan)
    want = mutations.patch_rows(rows, mutations.chapter_approvals(queues.unapproved_chapters(rows)), F.lit("2024-01-01").cast("timestamp_ntz"))
    columns = ["id", "content", "summary", "status", "notes_status", "updated_at"]
    got = with_texts(after, path).select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want.select(columns).collect()))


def test_a_small_sheet_does_not_shuffle_the_library(spark, tmp_path, no_broadcast):
    """With broadcasts off, the sheet's titles filter the library's scan before it is shuffled."""
    from quireflow.operators import ingest

    spark.range(20_000).selectExpr("concat('Title ', id) AS title").write.parquet(str(tmp_path / "library"))
    rows = [(2, "title 7 ", "n"), (3, "New", "n"), (4, "new", "n")]
    spark.createDataFrame(rows, "row_number int, title string, notes_on_outline_before string").write.parquet(str(tmp_path / "sheet"))
    conf = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        valid = spark.read.parquet(str(tmp_path / "sheet")).where("notes_on_outline_before = 'n'")
        out = ingest.dedupe_submissions(valid, spark.read.parquet(str(tmp_path / "library")))
        plan = plan_of(out)
        got = {r["row_number"]: r["label"] for r in out.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {2: "skipped", 3: "created", 4: "skipped"}
    assert "might_contain" in plan or "bloom" in plan.lower(), plan
