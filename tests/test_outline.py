from pyspark.sql import functions as F

from quireflow.functions.outline import outline_chapters, short_headings, unreadable_numbers


def parsed(one, text):
    return [(c["chapter_number"], c["title"]) for c in one(text, outline_chapters)]


def test_five_heading_forms(one):
    assert parsed(one, "## Chapter 2: Two\nx\n## Chapter 1 - One") == [(1, "One"), (2, "Two")]
    assert parsed(one, "### chapter 3: Three") == [(3, "Three")]
    assert parsed(one, "## 4. Four\n##5.Five") == [(4, "Four"), (5, "Five")]
    assert parsed(one, "**Chapter 6: Six**") == [(6, "Six")]
    assert parsed(one, "## First part\n## Second part") == [(1, "First part"), (2, "Second part")]


def test_first_form_with_a_match_wins(one):
    assert parsed(one, "**Chapter 1: Bold**\n## 2. Two") == [(2, "Two")]
    assert parsed(one, "## 2. Two\n## Chapter 9: Nine") == [(9, "Nine")]


def test_first_title_per_number(one):
    assert parsed(one, "## Chapter 1: A\n## Chapter 1: B\n## Chapter 0: Z") == [(0, "Z"), (1, "A")]


def test_missing_title_takes_the_next_line(one):
    assert parsed(one, "## Chapter 1:\n\n## Chapter 2: Two") == [(1, "## Chapter 2: Two")]
    assert parsed(one, "## Chapter 12") == [(1, "2")]


def test_only_ascii_dash_is_a_separator(one):
    assert parsed(one, "## Chapter 1 — Dash") == [(1, "— Dash")]


def test_trailing_stars_and_line_ends(one):
    assert parsed(one, "## Chapter 1: Bold **") == [(1, "Bold")]
    assert parsed(one, "## Chapter 1: a b\rc") == [(1, "a b\rc")]


def test_fallback(one):
    assert parsed(one, "### Heading three:") == [(1, "# Heading three")]
    # Short titles leave gaps in the numbering.
    assert parsed(one, "## abc\n## long title") == [(2, "long title")]
    many = "\n".join(f"## heading {i}" for i in range(15))
    assert len(parsed(one, many)) == 15
    assert len(one(many, lambda c: outline_chapters(c, max_unnumbered=10))) == 10
    assert one("## abc\n## long title", short_headings) == 1 and one("## Chapter 1: a", short_headings) == 0


def test_large_numbers_and_digits_of_other_scripts(one):
    assert parsed(one, "## Chapter 99999999999: Big\n## Chapter 1: One") == [(1, "One"), (99999999999, "Big")]
    assert parsed(one, "## Chapter ٣: Hello\n## Chapter １２: Wide") == [(3, "Hello"), (12, "Wide")]
    text = "## Chapter 99999999999999999999: Beyond\n## Chapter 2: Two"
    assert parsed(one, text) == [(2, "Two"), (None, "Beyond")]
    assert one(text, unreadable_numbers) == 1


def test_nothing(one):
    assert parsed(one, None) == []
    assert parsed(one, "") == []
    assert parsed(one, "no headings") == []


def test_description_is_empty(one):
    assert one("## Chapter 1: One", lambda c: F.element_at(outline_chapters(c), 1))["description"] == ""


def test_numbers_beyond_int_name_chapters(spark):
    from quireflow.operators.context import initial_chapters
    from quireflow.schemas import table_schema

    books = spark.createDataFrame([("b", "## Chapter 99999999999: Big\n## Chapter 1: One")], "id string, outline string")
    for kind in ("int", "bigint"):
        chapters = spark.createDataFrame([("c", "a", 1)], f"id string, book_id string, chapter_number {kind}")
        rows = initial_chapters(books, chapters).where("book_id = 'b'").orderBy("chapter_number").collect()
        assert [(r["chapter_number"], r["title"]) for r in rows] == [(1, "One"), (99999999999, "Big")]
    assert table_schema("chapters")["chapter_number"].dataType.simpleString() == "bigint"
