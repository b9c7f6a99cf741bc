"""Markdown as nested columns: cleaning, blocks, list items, bold runs.

Blocks of a text stay inside its row as an array, so parsing a corpus is a
map-only job; explode only where rows per block are the wanted result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.functions.text import SPACE, has, let, strip

BOLD = r"\*\*([^*]+)\*\*"

# The ordered replacements that turn Markdown into plain text.
# Each group is preceded by marks; a text without any of them cannot match.
CLEANUPS = (
    (("*",), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1")),
    (("_",), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1")),
    (("`",), (r"`([^`]+)`", "$1")),
    (("](",), (r"\[([^\]]+)\]\([^)]+\)", "$1")),
    (("--", "**", "-*", "*-"), (r"(?md)^[-*]{3,}$", "")),
    (("\n\n\n",), (r"\n{3,}", "\n\n")),
)

HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### "}
BLOCK_TYPE = "array<struct<type:string,text:string,items:array<string>>>"


def _holds(c: Column, marks: tuple[str, ...]) -> Column:
    found = F.contains(c, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(c, F.lit(mark))
    return found


def clean_markdown(c: Column) -> Column:
    """Plain text of Markdown; empty for NULL.

    A byte search for the marks of each group comes first. Most blocks hold
    few marks, and a replacement that is skipped saves a whole pass.
    """

    def from_group(i: int, text: Column) -> Column:
        if i == len(CLEANUPS):
            return F.coalesce(strip(text), F.lit(""))
        marks, *replacements = CLEANUPS[i]
        done = text
        for pattern, replacement in replacements:
            done = F.regexp_replace(done, pattern, replacement)
        step = F.when(_holds(text, marks), done).otherwise(text)
        return let(step, lambda t: from_group(i + 1, t))

    return let(c, lambda t: from_group(0, t))


def with_clean_markdown(df: DataFrame, source: str, name: str) -> DataFrame:
    """``df`` with ``clean_markdown`` of its column ``source`` as column ``name``.

    A projection per group of marks: each step is computed once and in
    generated code, where a nested expression would be interpreted.
    """
    df = df.withColumn(name, F.col(source))
    for marks, *replacements in CLEANUPS:
        done = F.col(name)
        for pattern, replacement in replacements:
            done = F.regexp_replace(done, pattern, replacement)
        df = df.withColumn(name, F.when(_holds(F.col(name), marks), done).otherwise(F.col(name)))
    return df.withColumn(name, F.coalesce(strip(F.col(name)), F.lit("")))


def paragraphs(content: Column) -> Column:
    """Non-empty stripped pieces between blank lines, in order."""
    return F.filter(F.transform(F.split(content, "\n\n"), strip), lambda p: p != "")


def block_type(p: Column) -> Column:
    kind = None
    for name, mark in HEADINGS.items():
        kind = F.when(p.startswith(mark), name) if kind is None else kind.when(p.startswith(mark), name)
    return (
        kind.when(p.startswith("- ") | p.startswith("* "), "bullet_list")
        .when(p.rlike(rf"^\p{{Nd}}+\.{SPACE}"), "numbered_list")
        .when(p.startswith("> "), "quote")
        .when(p.startswith("```"), "code")
        .otherwise("paragraph")
    )


def quote_text(p: Column) -> Column:
    return F.regexp_replace(p, "(?md)^> ", "")


def code_text(p: Column) -> Column:
    """Fence and outer space removed; a first line of letters only is dropped."""
    body = strip(F.btrim(p, F.lit("`")))
    return F.regexp_replace(body, r"(?d)\A\p{L}+(?:\n|\z)", "")


def block_text(p: Column, kind: Column) -> Column:
    """Text of a block; NULL for the two list types, which have items."""
    text = F.when(kind == "paragraph", p)
    for name, mark in HEADINGS.items():
        text = text.when(kind == name, strip(F.substr(p, F.lit(len(mark) + 1))))
    return text.when(kind == "quote", quote_text(p)).when(kind == "code", code_text(p))


def block_items(p: Column, kind: Column) -> Column:
    """Items of a list block; NULL for every other type."""
    lines = F.transform(F.split(p, "\n"), strip)
    bullets = F.transform(
        F.filter(lines, lambda s: s.startswith("- ") | s.startswith("* ")),
        lambda s: F.substr(s, F.lit(3)),
    )
    numbered = F.filter(
        F.transform(lines, lambda s: F.regexp_extract(s, rf"(?d)^\p{{Nd}}+\.{SPACE}*(.+)", 1)),
        lambda s: s != "",
    )
    return F.when(kind == "bullet_list", bullets).when(kind == "numbered_list", numbered)


def blocks(content: Column) -> Column:
    """Array of typed blocks of one text; empty for NULL or empty text."""
    typed = F.transform(
        paragraphs(content), lambda p: F.struct(block_type(p).alias("type"), p.alias("raw"))
    )
    parsed = F.transform(
        typed,
        lambda b: F.struct(
            b["type"].alias("type"),
            block_text(b["raw"], b["type"]).alias("text"),
            block_items(b["raw"], b["type"]).alias("items"),
        ),
    )
    return F.when(has(content), parsed).otherwise(F.array().cast(BLOCK_TYPE))


def bold_runs(text: Column) -> Column:
    """Array of (text, bold) runs; one plain run if nothing is bold."""
    plain = F.transform(
        F.split(text, BOLD), lambda s: F.struct(s.alias("text"), F.lit(False).alias("bold"))
    )
    bold = F.transform(
        F.regexp_extract_all(text, F.lit(BOLD), 1),
        lambda s: F.struct(s.alias("text"), F.lit(True).alias("bold")),
    )
    pairs = F.flatten(F.zip_with(plain, bold, lambda a, b: F.array(a, b)))
    runs = F.filter(pairs, lambda r: r.isNotNull() & (r["text"] != ""))
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("bold")))
    return F.when(text == "", whole).otherwise(runs)
