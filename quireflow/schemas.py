"""Declared schemas, value domains and row defaults of the three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The status domains and defaults that rows must follow.
REVIEW_STATUSES = ("pending", "yes", "no", "no_notes_needed")
OUTPUT_STATUSES = ("pending", "in_progress", "completed", "paused", "error")
CHAPTER_STATUSES = ("pending", "generating", "generated", "reviewed", "approved", "error")
DELIVERY_STATUSES = ("sent", "failed", "pending")
EVENT_TYPES = (
    "outline_ready",
    "waiting_chapter_notes",
    "chapter_ready",
    "final_draft_ready",
    "error_pause",
    "book_completed",
)

DOMAINS = {
    "books": {
        "status_outline_notes": REVIEW_STATUSES,
        "final_review_notes_status": REVIEW_STATUSES,
        "book_output_status": OUTPUT_STATUSES,
    },
    "chapters": {"notes_status": REVIEW_STATUSES, "status": CHAPTER_STATUSES},
    "notifications_log": {"event_type": EVENT_TYPES, "status": DELIVERY_STATUSES},
}

REQUIRED = {
    "books": ("id", "title"),
    "chapters": ("id", "book_id", "chapter_number"),
    "notifications_log": ("id", "event_type"),
}

DEFAULTS = {
    "books": {
        "status_outline_notes": "pending",
        "final_review_notes_status": "pending",
        "book_output_status": "pending",
    },
    "chapters": {"notes_status": "pending", "status": "pending"},
    "notifications_log": {"status": "sent"},
}


def _struct(id_type: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("id", id_type)] + [T.StructField(n, t) for n, t in fields])


def table_schema(table: str, id_type: T.DataType | None = None) -> T.StructType:
    """Schema of one table; ids are strings unless another type is given."""
    key = id_type or T.StringType()
    text, stamp = T.StringType(), T.TimestampType()
    if table == "books":
        return _struct(
            key,
            ("title", text),
            ("notes_on_outline_before", text),
            ("outline", text),
            ("notes_on_outline_after", text),
            ("status_outline_notes", text),
            ("final_review_notes", text),
            ("final_review_notes_status", text),
            ("book_output_status", text),
            ("output_docx_path", text),
            ("output_pdf_path", text),
            ("output_txt_path", text),
            ("created_at", stamp),
            ("updated_at", stamp),
        )
    if table == "chapters":
        return _struct(
            key,
            ("book_id", key),
            ("chapter_number", T.LongType()),
            ("title", text),
            ("content", text),
            ("summary", text),
            ("notes", text),
            ("notes_status", text),
            ("status", text),
            ("created_at", stamp),
            ("updated_at", stamp),
        )
    if table == "notifications_log":
        return _struct(
            key,
            ("book_id", key),
            ("event_type", text),
            ("message", text),
            ("recipient", text),
            ("status", text),
            ("sent_at", stamp),
        )
    raise ValueError(f"unknown table: {table}")


def conform(
    df: DataFrame, table: str, id_type: T.DataType | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Exactly the declared columns, in order; absent ones are typed NULLs."""
    have = set(df.columns)
    return df.select(
        [
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in table_schema(table, id_type)
        ]
        + [F.col(c) for c in extra]
    )
