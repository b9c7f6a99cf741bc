import random

import pytest


from quireflow.operators import context, prompts

ROW = "book_id long, chapter_number int, title string, summary string, content string, notes string"


def corpus(spark):
    """A long book holding a third of all rows, short books, NULLs, and gaps."""
    rng = random.Random(11)
    rows = []
    for n in range(1, 61):
        rows.append((1, n * 3, rng.choice([None, f"T{n}"]), rng.choice([None, "", f"s{n}"]), None, None))
    for book in range(2, 32):
        for n in range(-1, 3):
            rows.append((book, n, f"t{n}", rng.choice([None, f"sum {book} {n}"]), "text", "note"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, ROW), rows


def plain(rows, number, book):
    before = sorted(r for r in rows if r[0] == book and r[1] < number)
    return "\n\n".join(f"Chapter {r[1]}: {r[2] or 'Untitled'}\n{r[3]}" for r in before if r[3])


@pytest.mark.parametrize("segment", [None, 4, 256])
def test_context_equals_brute_force(spark, segment):
    df, rows = corpus(spark)
    got = {(r["book_id"], r["chapter_number"]): r["context"] for r in context.chapter_context(df, segment).collect()}
    assert len(got) == len(rows)
    for book, number, *_ in rows:
        assert got[book, number] == (plain(rows, number, book) if number > 1 else "")


@pytest.mark.parametrize("segment", [2, 3])
def test_levels_of_a_long_book(spark, segment):
    """A book of many segments and groups, among short ones; few due rows give the same texts as all."""
    rows = [(1, n, f"T{n}", None if n % 5 == 0 else f"s{n}", "x" if n % 7 else None, None) for n in range(-3, 60)]
    rows += [(b, n, None, f"s{b} {n}", None, None) for b in range(2, 8) for n in (1, 2, 5)]
    df = spark.createDataFrame(rows, ROW)
    got = {(r["book_id"], r["chapter_number"]): r["context"] for r in context.chapter_context(df, segment).collect()}
    assert got == {(r[0], r[1]): plain(rows, r[1], r[0]) if r[1] > 1 else "" for r in rows}
    whole = {(r["book_id"], r["chapter_number"]): r["prompt_context"] for r in context.prompt_context(df, None).collect()}
    some = context.prompt_context(df.where("content IS NULL AND chapter_number <> 5"), segment, history=df)
    few = {(r["book_id"], r["chapter_number"]): r["prompt_context"] for r in some.collect()}
    assert few == {k: whole[k] for k in few} and len(few) == 21 and any(few.values())


@pytest.mark.parametrize("segment", [None, 4, 256])
def test_prompt_context_lists_all_once_any_summary_exists(spark, segment):
    df, rows = corpus(spark)
    out = context.prompt_context(df, segment).collect()
    for r in out:
        before = sorted(x for x in rows if x[0] == r["book_id"] and x[1] < r["chapter_number"])
        want = ""
        if r["chapter_number"] > 1 and any(x[3] for x in before):
            want = context.CONTEXT_HEADER + "".join(
                f"\nChapter {x[1]}: {x[2] or 'Untitled'}\n{context.NO_SUMMARY if x[3] is None else x[3]}\n"
                for x in before
            )
        assert r["prompt_context"] == want


def test_context_grows_by_extension(spark):
    df, _ = corpus(spark)
    rows = context.chapter_context(df, 4).where("book_id = 1").orderBy("chapter_number").collect()
    for a, b in zip(rows, rows[1:]):
        assert b["context"].startswith(a["context"])


def test_contents_skip_empty_chapters(spark):
    df = spark.createDataFrame(
        [(1, 1, None, None, "x", None), (1, 2, "B", None, "", None), (1, 3, "C", None, None, None)], ROW
    )
    assert [r["entry"] for r in context.table_of_contents(df).collect()] == ["Chapter 1: Untitled"]


def test_initial_chapters_only_where_none_exist(spark):
    books = spark.createDataFrame(
        [(1, "## Chapter 1: A"), (2, "## Chapter 1: B\n## Chapter 2: C"), (3, ""), (4, None)], "id long, outline string"
    )
    existing = spark.createDataFrame([(1, 7, "old", None, None, None)], ROW)
    rows = context.initial_chapters(books, existing).orderBy("book_id", "chapter_number").collect()
    assert [(r["book_id"], r["chapter_number"], r["title"]) for r in rows] == [(1, 7, "old"), (2, 1, "B"), (2, 2, "C")]


def test_summary_prompt_uses_the_whole_chapter(spark):
    books = spark.createDataFrame([(1, "T")], "id long, title string")
    chapters = spark.createDataFrame([(1, 1, "t", None, "y" * 20000, None)], ROW)
    own = prompts.TEMPLATES["summary"].count("y")
    assert prompts.summary_prompts(books, chapters).first()["prompt"].count("y") - own == 20000
    assert prompts.summary_prompts(books, chapters, summary_input=8000).first()["prompt"].count("y") - own == 8000


def test_revision_guards(spark):
    books = spark.createDataFrame(
        [(1, "T", "o", "f"), (2, "T", "o", ""), (3, "T", None, "f")],
        "id long, title string, outline string, notes_on_outline_after string",
    )
    rows = {r["id"]: r for r in prompts.outline_revision_prompts(books).collect()}
    assert rows[1]["error"] is None and rows[1]["prompt"]
    assert rows[2]["error"] == prompts.NO_OUTLINE_FEEDBACK and rows[2]["prompt"] is None
    assert rows[3]["error"] == prompts.NO_OUTLINE


def test_notes_section_only_with_notes(spark):
    books = spark.createDataFrame([(1, "T", "o")], "id long, title string, outline string")
    chapters = spark.createDataFrame(
        [(1, 1, "a", None, None, "more maps"), (1, 2, "b", None, None, ""), (1, 3, "c", None, "done", None)], ROW
    )
    rows = {r["chapter_number"]: r["prompt"] for r in prompts.chapter_prompts(books, chapters).collect()}
    assert set(rows) == {1, 2}
    assert "more maps" in rows[1] and "notes for this chapter" not in rows[2]

