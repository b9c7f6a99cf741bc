"""Outline Markdown -> array of chapters, without leaving the row."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from quireflow.functions.text import SPACE, SPACE_SET, has, let, strip

# The heading forms that name a chapter, most preferred first.
# The first form with any match is used for the whole outline. A separate
# three-hash form is not listed: the first one already matches inside it.
HEADING_FORMS = (
    rf"(?dmi)##{SPACE}*Chapter{SPACE}*(\p{{Nd}}+)[:{SPACE_SET}-]*(.+?)(?=\n|$)",
    rf"(?dmi)##{SPACE}*(\p{{Nd}}+)\.{SPACE}*(.+?)(?=\n|$)",
    rf"(?dmi)\*\*Chapter{SPACE}*(\p{{Nd}}+)[:{SPACE_SET}-]*(.+?)\*\*",
)
ANY_HEADING = rf"(?d)##{SPACE}*(.+)"
# A heading of the last form must have so many characters to name a chapter;
# shorter ones leave a gap in the numbering and are counted in the audit.
MIN_UNNUMBERED_LENGTH = 4

# Every decimal digit beyond ASCII, and the ASCII digit of the same value.
DIGITS = "".join(map(chr, (c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")))
ASCII_DIGITS = "".join(str(unicodedata.decimal(d)) for d in DIGITS)

CHAPTER_TYPE = "array<struct<chapter_number:bigint,title:string,description:string>>"


def _chapter(number: Column, title: Column) -> Column:
    return F.struct(
        number.alias("chapter_number"), title.alias("title"), F.lit("").alias("description")
    )


def _ascii(number: Column) -> Column:
    """Decimal digits of any script as ASCII ones."""
    return F.when(number.rlike("^[0-9]*$"), number).otherwise(F.translate(number, DIGITS, ASCII_DIGITS))


def _numbered(outline: Column, pattern: str) -> Column:
    numbers = F.regexp_extract_all(outline, F.lit(pattern), 1)
    titles = F.regexp_extract_all(outline, F.lit(pattern), 2)
    return F.zip_with(
        numbers,
        titles,
        lambda n, t: F.struct(_ascii(n).try_cast("bigint").alias("n"), strip(F.rtrim(strip(t), F.lit("*"))).alias("t")),
    )


def _first_per_number(found: Column) -> Column:
    """Sorted by number, the first occurrence of each; then those beyond bigint, in order, with no number."""
    placed = F.transform(found, lambda m, i: F.struct(m["n"].alias("n"), i.alias("i"), m["t"].alias("t")))
    ordered = F.array_sort(F.filter(placed, lambda m: m["n"].isNotNull()))
    first = let(
        ordered,
        lambda all_: F.filter(
            F.zip_with(
                all_,
                F.concat(F.array(F.lit(None).cast("bigint")), F.transform(all_, lambda m: m["n"])),
                lambda m, before: F.struct(m["n"].alias("n"), m["t"].alias("t"), before.alias("before")),
            ),
            lambda p: p["n"].isNotNull() & ~p["n"].eqNullSafe(p["before"]),
        ),
    )
    beyond = F.filter(found, lambda m: m["n"].isNull())
    return F.concat(*[F.transform(c, lambda p: _chapter(p["n"], p["t"])) for c in (first, beyond)])


def _headings(outline: Column) -> Column:
    titles = F.regexp_extract_all(outline, F.lit(ANY_HEADING), 1)
    return F.transform(titles, lambda t, i: _chapter((i + 1).cast("bigint"), strip(F.rtrim(strip(t), F.lit(":")))))


def _long_enough(chapter: Column) -> Column:
    return F.length(chapter["title"]) >= MIN_UNNUMBERED_LENGTH


def _unnumbered(outline: Column, most: int | None) -> Column:
    headings = _headings(outline)
    return F.filter(headings if most is None else F.slice(headings, 1, most), _long_enough)


def _chosen_form(outline: Column, use: Callable[[Column], Column], none: Column) -> Column:
    """``use`` on the matches of the first form that has any, else ``none``."""

    def from_form(i: int) -> Column:
        if i == len(HEADING_FORMS):
            return none
        return let(
            _numbered(outline, HEADING_FORMS[i]),
            lambda found: F.when(F.size(found) > 0, use(found)).otherwise(from_form(i + 1)),
        )

    return from_form(0)


def outline_chapters(outline: Column, max_unnumbered: int | None = None) -> Column:
    """Array of (chapter_number, title, description) of one outline.

    ``max_unnumbered`` bounds the headings taken where none has a number. A
    number beyond bigint is NULL, and its chapter stands at the end.
    """
    chapters = _chosen_form(outline, _first_per_number, _unnumbered(outline, max_unnumbered))
    return F.when(has(outline), chapters).otherwise(F.array().cast(CHAPTER_TYPE))


def unreadable_numbers(outline: Column) -> Column:
    """How many headings of the chosen form carry a number beyond bigint."""
    lost = _chosen_form(
        outline, lambda found: F.size(F.filter(found, lambda m: m["n"].isNull())), F.lit(0)
    )
    return F.when(has(outline), lost).otherwise(F.lit(0))


def short_headings(outline: Column) -> Column:
    """How many headings are too short to name a chapter, in outlines without numbers."""
    short = F.size(F.filter(_headings(outline), lambda c: ~_long_enough(c)))
    return F.when(has(outline), _chosen_form(outline, lambda found: F.lit(0), short)).otherwise(F.lit(0))
