import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quireflow.operators import gates, generate, prompts
from quireflow.plans import stages

CH = "id string, book_id string, chapter_number int, title string, content string, summary string, notes string, notes_status string, status string, updated_at timestamp_ntz"
BK = "id string, title string, outline string, status_outline_notes string, notes_on_outline_before string, notes_on_outline_after string, book_output_status string, updated_at timestamp_ntz"

# Workers cannot import this test module; ship its backends by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky:
    """Echoes a digest of the prompt; fails on prompts that hold a word."""

    word = "forbidden"

    def generate(self, prompt, max_tokens, temperature):
        if self.word in prompt:
            raise RuntimeError("refused")
        return generate.DigestBackend().generate(prompt, max_tokens, temperature) + f" {max_tokens}"


def tables(spark):
    books = spark.createDataFrame(
        [
            ("b1", "One", "## Chapter 1: A\n## Chapter 2: B\n## Chapter 3: C", "no_notes_needed", "n", None, None, None),
            ("b2", "Two", "## Chapter 1: A\n## Chapter 2: forbidden\n## Chapter 3: C", "no_notes_needed", "n", None, None, None),
            ("b3", "Three", "## Chapter 1: A", "yes", "n", "more", None, None),
            ("b4", "Four", None, "pending", "n", None, None, None),
            ("b5", "forbidden", None, "pending", "n", None, "pending", None),
            ("b6", "Six", "o", "no_notes_needed", "n", None, None, None),
        ],
        BK,
    )
    chapters = spark.createDataFrame(
        [("c1", "b6", 1, "Old", "text", None, "fix", "yes", "generated", None)], CH
    )
    return books, chapters


def as_of():
    return F.lit("2024-01-02").cast("timestamp_ntz")


def test_one_bad_row_does_not_fail_the_job(spark):
    asked = spark.createDataFrame(
        [(1, "fine", None), (2, "forbidden", None), (3, None, "known")], "id int, prompt string, error string"
    )
    rows = {r["id"]: r for r in generate.generate_text(asked, Picky, 10).collect()}
    assert rows[1]["text"].endswith(" 10") and rows[1]["error"] is None
    assert rows[2]["text"] is None and rows[2]["error"] == "refused"
    assert rows[3]["text"] is None and rows[3]["error"] == "known"


def test_chapters_depend_on_the_summaries_before(spark):
    books, chapters = tables(spark)
    books = books.withColumn("outline", F.when(F.col("id") == "b2", "## Chapter 1: A").otherwise(F.col("outline")))
    started = stages.start_chapters(books, chapters).where("book_id = 'b1'")
    plan = gates.batch_plan(books, started)
    rows = generate.generate_chapters(plan, books, started, Picky).orderBy("chapter_number").collect()
    assert [r["chapter_number"] for r in rows] == [1, 2, 3]
    # With the first two chapters stored, the third prompt as a column must
    # lead to the same text.
    stored = started.join(
        spark.createDataFrame([(r["chapter_number"], r["content"], r["summary"]) for r in rows[:2]], "n int, c string, s string"),
        F.col("chapter_number") == F.col("n"),
        "left",
    ).select("id", "book_id", "chapter_number", "title", F.col("c").alias("content"), F.col("s").alias("summary"), "notes")
    third = prompts.chapter_prompts(books, stored)
    text = generate.generate_text(third, Picky, prompts.CHAPTER_TOKENS).first()["text"]
    assert text == rows[2]["content"]


def test_batch_run_stops_a_book_at_its_first_error(spark):
    books, chapters = tables(spark)
    books = books.withColumn("outline", F.replace("outline", F.lit("forbidden"), F.lit("Bad")))
    Failing = type("Failing", (Picky,), {"word": "Chapter 2: Bad\n"})
    out = stages.write_chapters(
        books.withColumn("outline", F.when(F.col("id") == "b2", F.lit("## Chapter 1: A\n## Chapter 2: Bad\n\n## Chapter 3: C")).otherwise(F.col("outline"))),
        chapters,
        Failing,
        as_of(),
    )
    got = {(r["book_id"], r["chapter_number"]): (r["status"], bool(r["content"])) for r in out.collect()}
    assert got["b1", 1] == got["b1", 2] == got["b1", 3] == ("generated", True)
    # The failing words are in the outline, so the first prompt fails already.
    assert got["b2", 1] == ("error", False)
    assert got["b2", 2] == got["b2", 3] == ("pending", False)
    # Existing content is left alone.
    assert got["b6", 1] == ("generated", True)
    assert ("b3", 1) not in got


def test_auto_approve_approves_what_was_processed(spark):
    books, chapters = tables(spark)
    out = stages.write_chapters(books, chapters, Picky, as_of(), auto_approve=True)
    got = {(r["book_id"], r["chapter_number"]): (r["status"], r["notes_status"]) for r in out.collect()}
    assert got["b1", 3] == ("approved", "no_notes_needed")
    assert got["b6", 1] == ("approved", "no_notes_needed")
    # The second book's outline holds the refused word: nothing is approved.
    assert got["b2", 1][0] == "error" and got["b2", 2][0] == "pending"


def test_outline_stage(spark):
    books, _ = tables(spark)
    rows = {r["id"]: r for r in stages.write_outlines(books, Picky, as_of()).collect()}
    assert rows["b4"]["outline"].endswith("4096") and rows["b4"]["status_outline_notes"] == "yes"
    assert rows["b5"]["outline"] is None and rows["b5"]["book_output_status"] == "error"
    assert rows["b1"]["updated_at"] is None and rows["b4"]["updated_at"] is not None
    revised = {r["id"]: r for r in stages.revise_outlines(books, Picky, as_of()).collect()}
    assert revised["b3"]["notes_on_outline_after"] is None and revised["b3"]["outline"].endswith("4096")


def test_revised_chapters_get_new_summaries(spark):
    books, chapters = tables(spark)
    row = stages.revise_chapters(books, chapters, Picky, as_of()).first()
    assert row["content"].endswith("8192") and row["summary"].endswith("500")
    assert (row["notes"], row["notes_status"], row["status"]) == (None, "yes", "generated")


def test_long_book_streams_in_order(spark):
    """A book with most of the rows, in several Arrow batches."""
    n = 300
    books = spark.createDataFrame([("b", "T", "o", "no_notes_needed", None, None, None, None)], BK)
    chapters = spark.createDataFrame(
        [(str(i), "b", i, f"t{i}", None, None, None, None, None, None) for i in range(n, 0, -1)], CH
    )
    plan = gates.batch_plan(books, chapters)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = generate.generate_chapters(plan, books, chapters, generate.DigestBackend).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["chapter_number"] for r in rows) == list(range(1, n + 1))
    assert len({r["content"] for r in rows}) == n


def test_ingest_stage(spark):
    books, _ = tables(spark)
    sheet = spark.createDataFrame(
        [(2, "ONE ", "n"), (3, "New", "n"), (4, "new", "n"), (5, "No notes", None)],
        "row_number int, title string, notes_on_outline_before string",
    )
    made = stages.ingest_titles(sheet, books).collect()
    assert [(r["title"], r["status_outline_notes"]) for r in made] == [("New", "pending")]


def test_unattended_run(spark):
    books, chapters = tables(spark)
    paths = {c: F.lit(None).cast("string") for c in ("output_docx_path", "output_pdf_path", "output_txt_path")}
    books = books.withColumns({**paths, "final_review_notes_status": F.lit(None).cast("string")})
    run = stages.run_unattended(books, chapters, Picky, as_of(), auto_approve=True)
    got = {r["id"]: r for r in run.books.collect()}
    assert len(got) == 6
    # b3 is approved and written; b4 gets an outline of digests, which names no chapter.
    assert {i for i, r in got.items() if r["book_output_status"] == "completed"} == {"b1", "b3", "b4", "b6"}
    assert got["b1"]["output_pdf_path"] == "b1/One.pdf"
    # b2 fails in its first chapter, b5 has no outline.
    assert got["b2"]["output_txt_path"] is None and got["b5"]["outline"] is None
    events = {(r["book_id"], r["event_type"]) for r in run.events.collect()}
    assert ("b1", "final_draft_ready") in events and ("b1", "book_completed") in events
    assert ("b1", "outline_ready") in events or ("b1", "chapters_generated") in events
    assert {e[1] for e in events if e[0] in ("b2", "b5")} == {"error_pause"}
    held = stages.run_unattended(books, chapters, Picky, as_of())
    kept = {r["id"]: r["book_output_status"] for r in held.books.collect()}
    assert "completed" not in kept.values()


def test_shared_folder_is_required(spark):
    from quireflow.session import shared_dir

    kept = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark, "x").startswith(kept)
    with pytest.raises(ValueError):
        class NoConf:
            conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        shared_dir(NoConf(), "x")


def test_chapter_numbers_one_at_a_time_give_the_same(spark):
    """Failures, stored summaries in between, titles that are NULL, and gaps in numbers."""
    books = spark.createDataFrame([(1, "A", "o1"), (2, None, None), (3, "C", "o3")], "id long, title string, outline string")
    rows = [(b, n, None if n == 3 else f"t{n}", "kept" if n == 2 else None, "be brief" if n == 4 else "") for b in (1, 2) for n in (1, 2, 3, 4, 7)]
    rows += [(3, 1, "forbidden", None, None), (3, 2, "after", None, None)]
    chapters = spark.createDataFrame(rows, "book_id long, chapter_number int, title string, summary string, notes string")
    plan = chapters.select("book_id", "chapter_number", F.when(F.col("summary").isNull(), "generate").otherwise("keep_existing").alias("work"))
    one = generate.generate_chapters(plan, books, chapters, Picky).collect()
    two = generate.generate_by_number(plan, books, chapters, Picky).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and len(one) == 9
    assert any(r["error"] for r in one)


def test_chapters_by_number_over_gaps_and_a_long_written_part(spark):
    """Contexts are folded over written chapters, books that start late or fail, and numbers below 1."""
    import random

    rng = random.Random(5)
    books = spark.createDataFrame([(b, f"B{b}", f"o{b}") for b in range(1, 8)], "book_id long, title string, outline string").withColumnRenamed("book_id", "id")
    rows = []
    for b in range(1, 7):
        for n in (-1, 0, 1, 2, 5, 6):
            due = (b * 7 + n) % 3 != 0
            title = "forbidden" if (b, n) == (4, 2) else rng.choice([None, f"t{b} {n}"])
            rows.append((b, n, title, None if due else rng.choice([None, "", f"kept {b} {n}"]), rng.choice([None, "", "note"]), due))
    rows += [(7, n, f"t{n}", f"s{n}", None, n == 60) for n in range(1, 61)]
    df = spark.createDataFrame(rows, "book_id long, chapter_number long, title string, summary string, notes string, due boolean")
    plan = df.select("book_id", "chapter_number", F.when(F.col("due"), "generate").otherwise("keep_existing").alias("work"))
    Failing = type("Failing", (Picky,), {"word": "Chapter 2: forbidden\n"})
    one = generate.generate_chapters(plan, books, df.drop("due"), Failing).collect()
    out = generate.generate_by_number(plan, books, df.drop("due"), Failing)
    assert sorted(map(repr, one)) == sorted(map(repr, out.collect())) and sum(r["error"] is not None for r in one) == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
    assert generate.generate_by_number(plan.where("false"), books, df.drop("due"), Failing).count() == 0


def test_stage_by_book_and_by_number_agree(spark):
    books, chapters = tables(spark)
    one, news_one = stages.chapter_batch(books, chapters, Picky, as_of(), by_number=True)
    two, news_two = stages.chapter_batch(books, chapters, Picky, as_of(), by_number=False)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert sorted(map(repr, news_one.collect())) == sorted(map(repr, news_two.collect()))
