"""Text expressions with one definition of presence and whitespace.

All of them are built-in Spark expressions, so nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The 29 code points that count as whitespace.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression character class. Code
# points beyond Latin-1 sit behind one range test, which keeps the class cheap
# on ordinary text.
_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_RARE_SET = r"\x0b\f\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE
SPACE_SET = r"\t\n\r\x20" + _RARE_SET
SPACE = f"[{SPACE_SET}]"

UNTITLED = "Untitled"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def has(c: Column) -> Column:
    """Present text: neither NULL nor empty. Whitespace counts as present."""
    return c.isNotNull() & (c != "")


def written(chapters: DataFrame) -> Column:
    """Whether a chapter has content.

    Stored chapters carry the answer in ``has_content`` (see
    ``store_chapters``), so that gates and rollups read a flag and leave the
    text, which is nearly all of the corpus, on disk.
    """
    if "has_content" in chapters.columns:
        return chapters["has_content"]
    return has(chapters["content"])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def title_key(c: Column) -> Column:
    """The key under which two titles are the same book."""
    return strip(F.lower(c))


def title_or_default(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNTITLED))


def clip(c: Column, n: int, always_mark: bool = False) -> Column:
    """First ``n`` characters; ``...`` follows if text was cut, or always."""
    head = F.substring(c, 1, n)
    if always_mark:
        return F.concat(head, F.lit("..."))
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(c)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def center_line(c: Column, width: int = 72) -> Column:
    """Centre in ``width`` columns; in an even width an odd space goes right."""
    gap = F.lit(width) - F.length(c)
    left = F.floor(gap / 2).cast("int") + gap.bitwiseAND(F.lit(width & 1))
    return F.when(gap <= 0, c).otherwise(
        F.concat(F.repeat(F.lit(" "), left), c, F.repeat(F.lit(" "), gap - left))
    )


def single_spaced(c: Column) -> Column:
    """Every run of whitespace as one space, none at the ends.

    Common line ends and tabs are replaced as plain text; the regular
    expressions run only on texts that hold something they would change.
    """
    for mark in ("\n", "\t", "\r"):
        c = F.replace(c, F.lit(mark), F.lit(" "))
    collapsed = let(
        c,
        lambda t: F.when(t.rlike(f"[{_RARE_SET}]"), F.regexp_replace(t, SPACE + "+", " "))
        .when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " "))
        .otherwise(t),
    )
    return F.trim(collapsed)


def word_wrap(c: Column, width: int) -> Column:
    """Greedy wrap to an array of lines; words longer than a line stay whole.

    The first line holds one column less than the others. A greedy bounded
    match up to the next space picks the same words as counting lengths does,
    in one linear pass, and needs no accumulator.
    """
    if width < 2:
        raise ValueError("width must be at least 2")
    first = rf"\A(?:[^ ]{{{width},}}|.{{1,{width - 1}}})"
    later = rf"[^ ]{{{width + 1},}}|.{{1,{width}}}"
    pattern = F.lit(rf"({first}|{later})(?: |\z)")
    return let(
        single_spaced(c),
        lambda t: F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, pattern, 1)),
    )


def safe_title(c: Column) -> Column:
    """Letters, digits, space, ``-`` and ``_`` only, as used in file names."""
    return strip(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""))


def event_heading(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def escape_markup(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))
