"""Rendering whole books: plain text and ordered rows for page writers.

A chapter is rendered without a shuffle: its blocks are parsed into an array
and turned into lines inside its own row, or become narrow rows first where
rows are the result. What is ordered across
chapters is given by sort keys (section, chapter_number, seq, item) and not by
numbering a book's rows, so no step needs a book in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.functions.markdown import (
    block_items,
    block_text,
    block_type,
    blocks,
    bold_runs,
    clean_markdown,
    paragraphs,
    with_clean_markdown,
)
from quireflow.functions.text import (
    center_line,
    escape_markup,
    safe_title,
    title_or_default,
    word_wrap,
    written,
)
from quireflow.operators.context import chapter_name

# The layout of the compiled text.
WIDTH = 72
INDENT = "    "
TITLE, CONTENTS, GAP, CHAPTER = 0, 1, 2, 3
FORMATS = ("docx", "pdf", "txt")
LISTS = ("bullet_list", "numbered_list")


def date_line(as_of: Column) -> Column:
    return F.concat(F.lit("Generated on "), F.date_format(as_of, "MMMM dd, yyyy"))


def render_blocks(content: Column) -> Column:
    """Blocks of a text: type, raw text, cleaned text, cleaned items."""
    return F.transform(
        blocks(content),
        lambda b: F.struct(
            b["type"].alias("type"),
            b["text"].alias("raw"),
            clean_markdown(b["text"]).alias("text"),
            F.transform(b["items"], clean_markdown).alias("items"),
        ),
    )


def _block_lines(b: Column) -> Column:
    kind, text, items = b["type"], b["text"], b["items"]
    blank = F.array(F.lit(""))
    bullets = F.transform(items, lambda i: F.concat(F.lit(INDENT + "• "), i))
    numbers = F.transform(
        items,
        lambda i, at: F.concat(F.lit(INDENT), (at + 1).cast("string"), F.lit(". "), i),
    )
    heading = F.array(F.lit(""), F.upper(text), F.repeat(F.lit("-"), F.length(text)), F.lit(""))
    wrapped = F.transform(word_wrap(text, WIDTH - 4), lambda s: F.concat(F.lit(INDENT), s))
    return (
        F.when(kind.isin("h1", "h2"), heading)
        .when(kind.isin("h3", "h4"), F.array(F.lit(""), F.concat(F.lit("  "), text), F.lit("")))
        .when(kind == "bullet_list", F.concat(bullets, blank))
        .when(kind == "numbered_list", F.concat(numbers, blank))
        .when(kind == "quote", F.array(F.concat(F.lit(INDENT + '"'), text, F.lit('"')), F.lit("")))
        .when(text != "", F.concat(wrapped, blank))
        .otherwise(F.array().cast("array<string>"))
    )


def chapter_lines(number: Column, title: Column, content: Column) -> Column:
    """Array of the plain-text lines of one chapter, banner included."""
    rule = F.lit("=" * WIDTH)
    banner = F.array(
        rule,
        F.concat(F.lit("CHAPTER "), number.cast("string")),
        F.upper(title_or_default(title)),
        rule,
        F.lit(""),
    )
    body = F.flatten(F.transform(render_blocks(content), _block_lines))
    return F.concat(banner, body, F.array(F.lit(""), F.lit("")))


def title_page(title: Column, as_of: Column) -> Column:
    rule, dashes, blank = F.lit("=" * WIDTH), F.lit("-" * WIDTH), F.lit("")
    lines = [
        blank,
        rule,
        blank,
        center_line(title_or_default(title), WIDTH),
        blank,
        rule,
        blank,
        center_line(date_line(as_of), WIDTH),
        blank,
        blank,
        blank,
        dashes,
        center_line(F.lit("TABLE OF CONTENTS"), WIDTH),
        dashes,
        blank,
    ]
    return F.array_join(F.array(*lines), "\n")


def compilable(books: DataFrame, gate: DataFrame) -> DataFrame:
    """Books whose gate lets them through; skip this step to force."""
    return books.join(
        gate.where(F.col("can_compile")).select(F.col("book_id").alias("id")), "id", "left_semi"
    )


def chapters_of(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of the given books; needed only when compiling some of them."""
    return chapters.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")


def text_sections(books: DataFrame, chapters: DataFrame, as_of: Column) -> DataFrame:
    """Rows (book_id, section, chapter_number, text) of every book.

    Read in the order of (section, chapter_number) and joined by newlines they
    are the text of the book. Nothing here is grouped, joined or shuffled.
    """
    number, title = F.col("chapter_number"), F.col("title")
    per_book = F.array(
        F.struct(F.lit(TITLE).alias("section"), title_page(title, as_of).alias("text")),
        F.struct(F.lit(GAP).alias("section"), F.lit("\n").alias("text")),
    )
    per_chapter = F.array(
        F.struct(
            F.lit(CONTENTS).alias("section"),
            F.concat(F.lit(INDENT), chapter_name(number, title)).alias("text"),
        ),
        F.struct(
            F.lit(CHAPTER).alias("section"),
            F.array_join(chapter_lines(number, title, F.col("content")), "\n").alias("text"),
        ),
    )
    fixed = books.select(
        F.col("id").alias("book_id"), F.lit(None).cast("int").alias("chapter_number"), F.explode(per_book).alias("s")
    )
    flowing = chapters.where(written(chapters)).select(
        "book_id", "chapter_number", F.explode(per_chapter).alias("s")
    )
    return fixed.unionByName(flowing).select("book_id", "s.section", "chapter_number", "s.text")


def compile_text(books: DataFrame, chapters: DataFrame, as_of: Column) -> DataFrame:
    """Compiled texts as ordered rows: (book_id, section, chapter_number, text).

    Rows in the order of (section, chapter_number), joined by newlines, are the
    text of a book. A chapter is rendered in its own row, so nothing is shuffled
    here and a book of any length has bounded rows; only a sink sorts.
    """
    return text_sections(books, chapters, as_of)


def compile_results(books: DataFrame, gate: DataFrame, force: bool = False, formats=FORMATS) -> DataFrame:
    """One row per book and format: the path, or why there is none.

    Paths are keyed by book id, since titles that differ in punctuation give
    the same file name.
    """
    issues = gate.select(
        "book_id",
        F.when(
            ~F.col("can_compile"), F.concat(F.lit("Cannot compile: "), F.array_join("issues", ", "))
        ).alias("_issue"),
    )
    error = F.lit(None).cast("string") if force else F.col("_issue")
    name = safe_title(title_or_default(F.col("title")))
    return (
        books.select(F.col("id").alias("book_id"), "title")
        .join(issues, "book_id", "left")
        .select("book_id", name.alias("_name"), error.alias("error"))
        .select(
            "book_id",
            F.explode(F.array(*[F.lit(f) for f in formats])).alias("format"),
            "_name",
            "error",
        )
        .select(
            "book_id",
            "format",
            F.when(
                F.col("error").isNull(),
                F.concat(
                    F.col("book_id").cast("string"), F.lit("/"), F.col("_name"), F.lit("."), F.col("format")
                ),
            ).alias("path"),
            "error",
        )
    )


def compile_events(results: DataFrame) -> DataFrame:
    """A final-draft event, with its paths, per book all of whose formats worked.

    A book has one row per format, so the array of paths is short.
    """
    paths = F.array_sort(F.collect_list(F.struct("format", "path")))
    return (
        results.groupBy("book_id")
        .agg(paths.alias("paths"), F.bool_and(F.col("error").isNull()).alias("_ok"))
        .where(F.col("_ok"))
        .select("book_id", F.lit("final_draft_ready").alias("event_type"), "paths")
    )


def path_patches(results: DataFrame) -> DataFrame:
    """Output paths of successful formats as patches of the books table."""
    cols = []
    for f in FORMATS:
        on = (F.col("format") == f) & F.col("error").isNull()
        cols.append(F.max(F.when(on, F.col("path"))).alias(f"output_{f}_path"))
        cols.append(F.bool_or(on).alias(f"set_output_{f}_path"))
    return results.groupBy(F.col("book_id").alias("id")).agg(*cols)


# -- rows for page writers ----------------------------------------------------

RUN = "struct<text:string,bold:boolean>"


def _run(text: Column, bold: Column | bool = False) -> Column:
    bold = bold if isinstance(bold, Column) else F.lit(bold)
    return F.array(F.struct(text.alias("text"), bold.alias("bold")).cast(RUN))


def _row(kind: str, style: str, runs: Column | None = None) -> Column:
    """One render row; ``runs`` is an array of (text, bold)."""
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(style).alias("style"),
        (F.array().cast(f"array<{RUN}>") if runs is None else runs).alias("runs"),
    )


def _fixed_rows(books: DataFrame, front: list[Column], before: list[Column], page: Column) -> DataFrame:
    """The rows of a book that stand around its contents: they have no chapter number."""
    groups = ((0, front), (1, before), (3, [page]))
    laid = [
        F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), row.alias("r"))
        for section, rows in groups
        for item, row in enumerate(rows)
    ]
    return books.select(F.col("id").alias("book_id"), F.explode(F.array(*laid)).alias("x")).select(
        "book_id",
        "x.section",
        F.lit(None).cast("int").alias("chapter_number"),
        F.lit(0).alias("seq"),
        "x.item",
        "x.r.kind",
        "x.r.style",
        "x.r.runs",
    )


def _block_pieces(chapters: DataFrame) -> DataFrame:
    """A narrow row for each thing that a chapter lays out, texts cleaned.

    A chapter's contents entry comes first, its opening second, then a row for
    each block or list item, and at last its page break; the three that are not
    blocks have no ``type``. Blocks become rows before any work is done on
    them, so that their types, texts and marks are plain columns, computed once
    each in generated code. ``seq`` and ``item`` number the rows of a chapter;
    nothing is shuffled for that.
    """
    none = F.lit(None).cast("string")
    raw, kind = F.col("_raw"), F.col("type")
    pieces = (
        chapters.where(written(chapters))
        .select(
            "book_id",
            "chapter_number",
            chapter_name(F.col("chapter_number"), F.col("title")).alias("name"),
            F.posexplode(F.concat(F.array(none, none), paragraphs(F.coalesce("content", F.lit(""))), F.array(none))).alias("_at", "_raw"),
        )
        .withColumn("type", F.when(raw.isNotNull(), block_type(raw)))
        .withColumn("_text", block_text(raw, kind))
        .select(
            "book_id",
            "chapter_number",
            "name",
            "_at",
            "type",
            F.posexplode(
                F.when(kind.isin(*LISTS), block_items(raw, kind)).otherwise(F.array(F.col("_text")))
            ).alias("item", "raw"),
        )
    )
    return with_clean_markdown(pieces, "raw", "text")


def _assemble(
    books: DataFrame,
    chapters: DataFrame,
    front: list[Column],
    before: list[Column],
    entry: tuple[str, str],
    opening: tuple[str, str],
    block: tuple[Column, Column, Column],
    shown: Column | None,
    page: tuple[str, str],
) -> DataFrame:
    """Lay out documents: front page, contents, chapters, a page break after each.

    Rows are ordered by (section, chapter_number, seq, item); the fixed rows
    around the contents have sections of their own. The rows of a book come
    from one pass over books, those of a chapter, contents entry included, from
    one pass over chapters. ``block`` gives the kind, style and runs of a
    block's row from its ``type``, ``raw`` and cleaned ``text``; blocks that
    are not ``shown`` have none (None: all are).
    """
    at, other = F.col("_at"), F.col("type").isNull()
    fixed_kinds = (entry, opening, page)

    def of(i: int) -> Column:
        first, second, last = (F.lit(names[i]) for names in fixed_kinds)
        return F.when(other, F.when(at == 0, first).when(at == 1, second).otherwise(last)).otherwise(block[i])

    runs = (
        F.when(other & (at < 2), _run(F.col("name")))
        .when(other, F.array().cast(f"array<{RUN}>"))
        .otherwise(block[2])
    )
    pieces = _block_pieces(chapters)
    if shown is not None:
        # A filter on the cleaned text would be moved below the cleaning, which it then repeats;
        # one on what an outer explode makes stays where it is.
        rest = [c for c in pieces.columns if c != "text"]
        pieces = pieces.select(*rest, F.explode_outer(F.array("text")).alias("text")).where(other | shown)
    flowing = pieces.select(
        "book_id",
        F.when(at == 0, 2).otherwise(4).alias("section"),
        "chapter_number",
        F.greatest(at - 1, F.lit(0)).alias("seq"),
        "item",
        of(0).alias("kind"),
        of(1).alias("style"),
        runs.alias("runs"),
    )
    return _fixed_rows(books, front, before, _row(*page)).unionByName(flowing)


def _by_type(default: str, **names: str) -> Column:
    """A name for each block type, ``default`` for those not listed."""
    kind = F.col("type")
    out = None
    for block, name in names.items():
        out = F.when(kind == block, name) if out is None else out.when(kind == block, name)
    return out.otherwise(default)


def render_rows_word(books: DataFrame, chapters: DataFrame, as_of: Column) -> DataFrame:
    """The paragraphs a Word writer would emit, in order."""
    title = title_or_default(F.col("title"))
    page = ("page_break", "Normal")
    blank = _row("blank", "Normal")
    front = [blank] * 6 + [
        _row("title", "Normal", _run(title, True)),
        blank,
        _row("date", "Normal", _run(date_line(as_of))),
        _row(*page),
    ]
    before = [_row("heading", "Heading 1", _run(F.lit("Table of Contents"))), blank]

    kind, raw, text = F.col("type"), F.col("raw"), F.col("text")
    bold = F.transform(
        bold_runs(raw),
        lambda r: F.struct(clean_markdown(r["text"]).alias("text"), r["bold"].alias("bold")).cast(RUN),
    )
    runs = (
        F.when((kind == "paragraph") & F.contains(raw, F.lit("**")), bold)
        .when(kind == "code", _run(raw))
        .otherwise(_run(text, kind == "h4"))
    )
    kinds = _by_type(
        "paragraph", h1="heading", h2="heading", h3="heading", h4="h4",
        bullet_list="list", numbered_list="list", quote="quote", code="code",
    )
    styles = _by_type(
        "Normal", h1="Heading 1", h2="Heading 2", h3="Heading 3",
        bullet_list="List Bullet", numbered_list="List Number",
    )
    return _assemble(
        books, chapters, front, before, ("toc", "Normal"), ("heading", "Heading 1"),
        (kinds, styles, runs), None, page,
    )


def render_rows_pdf(books: DataFrame, chapters: DataFrame, as_of: Column) -> DataFrame:
    """The flowables a page writer would emit, in order.

    Texts of blocks are escaped for its markup; titles and contents are not.
    """
    title = title_or_default(F.col("title"))
    space, page = _row("spacer", "Spacer"), ("page_break", "PageBreak")
    front = [
        space,
        _row("title", "BookTitle", _run(title)),
        space,
        _row("date", "Date", _run(date_line(as_of))),
        _row(*page),
    ]
    before = [_row("contents_title", "ChapterTitle", _run(F.lit("Table of Contents"))), space]

    kind, text = F.col("type"), escape_markup(F.col("text"))
    lead = F.when(kind == "bullet_list", "\u2022 ").otherwise(F.concat((F.col("item") + 1).cast("string"), F.lit(". ")))
    runs = _run(F.when(kind.isin(*LISTS), F.concat(lead, text)).otherwise(text))
    kinds = _by_type("body", h1="heading2", h2="heading2", h3="heading3", h4="heading3", quote="quote")
    styles = _by_type(
        "BookBody", h1="Heading2Custom", h2="Heading2Custom", h3="Heading3Custom", h4="Heading3Custom", quote="Quote"
    )
    shown = ~kind.isin("paragraph", "code") | (F.col("text") != "")
    return _assemble(
        books, chapters, front, before, ("toc", "TOC"), ("chapter_title", "ChapterTitle"),
        (kinds, styles, runs), shown, page,
    )
