"""Text templates with named slots, filled by column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, functions as F


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(literal, slot) pairs; the slot of the last pair may be None."""
    return [(text, slot) for text, slot, _, _ in Formatter().parse(template)]


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    """The template with its slots filled; a NULL slot is empty text."""
    pieces = []
    for text, slot in template_parts(template):
        if text:
            pieces.append(F.lit(text))
        if slot:
            pieces.append(F.coalesce(slots[slot].cast("string"), F.lit("")))
    return F.concat(*pieces)
