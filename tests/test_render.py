import pytest
from pyspark.sql import functions as F

from quireflow.operators import gates
from quireflow.plans import render, stages
from quireflow.sources import tables

def as_of():
    return F.lit("2024-03-05 10:00:00").cast("timestamp_ntz")
CH = "id long, book_id long, chapter_number int, title string, content string, summary string, notes string, notes_status string, status string"
BK = "id long, title string, outline string, status_outline_notes string, final_review_notes_status string, book_output_status string, notes_on_outline_before string, notes_on_outline_after string, output_docx_path string, output_pdf_path string, output_txt_path string, updated_at timestamp_ntz"

CONTENT = (
    "# Head **one**\n\n### Sub\n\n- a\n- *b*\n\n1. x\n2. y\n\n> said\n> so\n\n```\nc = 1\n```\n\n"
    + "word " * 20
    + "\n\n***"
)
RULE, DASH = "=" * 72, "-" * 72


def book(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (12 - len(r))) for r in rows], BK)


def chapters(spark, *rows):
    return spark.createDataFrame(
        [(i, b, n, t, c, None, None, None, None) for i, (b, n, t, c) in enumerate(rows)], CH
    )


def whole(parts):
    rows = sorted(parts.collect(), key=lambda r: (r["section"], r["chapter_number"] or 0))
    return "\n".join(r["text"] for r in rows)


EXPECTED = "\n".join(
    [
        "",
        RULE,
        "",
        "My Book".center(72),
        "",
        RULE,
        "",
        "Generated on March 05, 2024".center(72),
        "",
        "",
        "",
        DASH,
        "TABLE OF CONTENTS".center(72),
        DASH,
        "",
        "    Chapter 1: Straße",
        "    Chapter 2: Untitled",
        "",
        "",
        RULE,
        "CHAPTER 1",
        "STRASSE",
        RULE,
        "",
        "",
        "HEAD ONE",
        "--------",
        "",
        "",
        "  Sub",
        "",
        "    • a",
        "    • b",
        "",
        "    1. x",
        "    2. y",
        "",
        '    "said\nso"',
        "",
        "    c = 1",
        "",
        "    " + " ".join(["word"] * 13),
        "    " + " ".join(["word"] * 7),
        "",
        "",
        "",
        RULE,
        "CHAPTER 2",
        "UNTITLED",
        RULE,
        "",
        "    plain",
        "",
        "",
        "",
    ]
)


def test_golden_text(spark):
    b = book(spark, (1, "My Book"))
    c = chapters(spark, (1, 2, None, "plain"), (1, 3, "Empty", ""), (1, 1, "Straße", CONTENT))
    assert whole(render.compile_text(b, c, as_of())) == EXPECTED


def test_book_without_chapters_has_only_front_matter(spark):
    text = whole(render.compile_text(book(spark, (1, "T")), chapters(spark, (2, 1, "x", None)), as_of()))
    assert text.endswith(DASH + "\n" + "\n\n") and "CHAPTER" not in text


def test_text_files_read_in_order(spark, tmp_path):
    b = book(spark, (1, "A"), (2, "B"))
    many = [(1, n, f"t{n}", f"text {n}") for n in range(1, 41)] + [(2, 1, "only", "x")]
    parts = render.compile_text(b, chapters(spark, *many), as_of())
    patches = tables.write_text_books(spark, parts, b, str(tmp_path / "out"), files=True)
    assert {r["id"] for r in patches.collect()} == {1, 2}
    for i in (1, 2):
        files = sorted((tmp_path / "out" / "files" / f"book_id={i}").glob("*.txt"))
        text = "".join(f.read_text() for f in files)
        assert text == whole(parts.where(F.col("book_id") == i)) + "\n"


def test_word_rows(spark):
    b = book(spark, (1, "T"))
    c = chapters(spark, (1, 1, "C", "#### Deep *x*\n\n- **i**\n\n```\n**raw**\n```\n\na **b** c\n\n> _q_"))
    rows = render.render_rows_word(b, c, as_of()).orderBy("section", "chapter_number", "seq", "item").collect()
    got = [(r["kind"], r["style"], [tuple(x) for x in r["runs"]]) for r in rows]
    assert [g[0] for g in got[:10]] == ["blank"] * 6 + ["title", "blank", "date", "page_break"]
    assert got[6][2] == [("T", True)]
    assert got[10:] == [
        ("heading", "Heading 1", [("Table of Contents", False)]),
        ("blank", "Normal", []),
        ("toc", "Normal", [("Chapter 1: C", False)]),
        ("page_break", "Normal", []),
        ("heading", "Heading 1", [("Chapter 1: C", False)]),
        ("h4", "Normal", [("Deep x", True)]),
        ("list", "List Bullet", [("i", False)]),
        ("code", "Normal", [("**raw**", False)]),
        ("paragraph", "Normal", [("a", False), ("b", True), ("c", False)]),
        ("quote", "Normal", [("q", False)]),
        ("page_break", "Normal", []),
    ]


def test_rows_of_chapters_without_blocks_and_lists_without_items(spark):
    b = book(spark, (1, "T"))
    c = chapters(spark, (1, 1, "space", " \n\n "), (1, 2, "empty list", "1.\nfoo\n\nlast"), (1, 3, "none", None))
    for make in (render.render_rows_word, render.render_rows_pdf):
        rows = make(b, c, as_of()).where("chapter_number IS NOT NULL")
        got = {(r["chapter_number"], r["section"], r["seq"], r["item"], r["kind"]) for r in rows.collect()}
        assert {g[:4] for g in got if g[0] == 1} == {(1, 2, 0, 0), (1, 4, 0, 0), (1, 4, 1, 0)}
        assert {g[:4] for g in got if g[0] == 2} == {(2, 2, 0, 0), (2, 4, 0, 0), (2, 4, 2, 0), (2, 4, 3, 0)}
        assert (2, 4, 3, 0, "page_break") in got and len(got) == 7
    flagged = c.withColumn("has_content", F.lit(True))
    assert render.render_rows_pdf(b, flagged, as_of()).where("chapter_number = 3").count() == 3


def test_page_rows_escape_blocks_only(spark):
    b = book(spark, (1, "A & B"))
    c = chapters(spark, (1, 1, "x < y", "## a & b\n\n1. <i>\n2. z\n\n***\n\n```\n1 < 2\n```"))
    rows = render.render_rows_pdf(b, c, as_of()).orderBy("section", "chapter_number", "seq", "item").collect()
    got = [(r["kind"], r["runs"][0]["text"] if r["runs"] else None) for r in rows]
    assert got == [
        ("spacer", None),
        ("title", "A & B"),
        ("spacer", None),
        ("date", "Generated on March 05, 2024"),
        ("page_break", None),
        ("contents_title", "Table of Contents"),
        ("spacer", None),
        ("toc", "Chapter 1: x < y"),
        ("page_break", None),
        ("chapter_title", "Chapter 1: x < y"),
        ("heading2", "a &amp; b"),
        ("body", "1. &lt;i&gt;"),
        ("body", "2. z"),
        ("body", "1 &lt; 2"),
        ("page_break", None),
    ]


def test_paths_are_keyed_by_book(spark):
    b = book(spark, (1, "A/B"), (2, "AB"), (3, None))
    c = chapters(spark, (1, 1, "x", "x"), (2, 1, "x", "x"))
    gate = gates.compile_gate(b, c)
    got = {(r["book_id"], r["format"]): (r["path"], r["error"]) for r in render.compile_results(b, gate).collect()}
    assert got[1, "pdf"] == ("1/AB.pdf", None) and got[2, "pdf"] == ("2/AB.pdf", None)
    assert got[3, "txt"] == (None, "Cannot compile: No chapters found")
    forced = {r["path"] for r in render.compile_results(b, gate, force=True, formats=["txt"]).collect()}
    assert forced == {"1/AB.txt", "2/AB.txt", "3/Untitled.txt"}


def test_compile_stage(spark):
    b = book(spark, (1, "A"), (2, "B"))
    c = chapters(spark, (1, 1, "x", "x"), (2, 1, "x", None))
    out = stages.compile_books(b, c, as_of())
    rows = {r["id"]: r for r in out.books.collect()}
    assert rows[1]["book_output_status"] == "completed" and rows[1]["output_txt_path"] == "1/A.txt"
    assert rows[2]["book_output_status"] is None and rows[2]["output_txt_path"] is None
    assert {r["book_id"] for r in out.texts.collect()} == {1}
    assert {r["book_id"] for r in out.word_rows.collect()} == {1}


def test_packed_books_read_through_their_manifest(spark, tmp_path):
    """Few files for many books; books across files; wide characters, empty texts and line breaks inside."""
    rows = [(b, s, n, f"bük {b} {s} {n}\n" + "x" * (b % 5)) for b in range(40) for s, n in ((0, None), (1, 1), (3, 1), (3, 2))]
    rows += [(99, 3, n, "" if n % 3 else "lang " * 20) for n in range(60)]
    texts = spark.createDataFrame(rows, "book_id long, section int, chapter_number long, text string").repartition(5)
    path = str(tmp_path / "packed")
    patches = tables.write_packed_books(spark, texts, path, size=1500)
    assert {r["id"] for r in patches.collect()} == {*range(40), 99}
    files = [f for f in (tmp_path / "packed" / "files").rglob("part-*.txt")]
    assert 2 <= len(files) <= 10 and all(f.stat().st_size for f in files)
    pieces = sorted((r["book_id"], r["piece"], r["text"]) for r in tables.read_packed_books(spark, path).collect())
    got = {b: "".join(t for x, _, t in pieces if x == b) for b in {p[0] for p in pieces}}
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)
    want: dict = {}
    for b, _, _, t in sorted(rows, key=key):
        want[b] = want.get(b, "") + t + "\n"
    assert got == want and len(pieces) > len(got)
    one = tables.read_packed_books(spark, path, spark.createDataFrame([(7,)], "book_id long")).collect()
    assert "".join(r["text"] for r in sorted(one, key=lambda r: r["piece"])) == want[7]
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    for r in manifest[:20]:
        data = open(r["file"].removeprefix("file:"), "rb").read()
        assert want[r["book_id"]].encode().find(data[r["offset"] : r["offset"] + r["length"]]) >= 0
