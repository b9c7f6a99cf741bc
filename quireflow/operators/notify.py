"""Notifications as data: messages, mail rows, webhook cards, log rows.

Nothing is sent from here. A caller delivers the rows and hands back a
delivered flag, which becomes the status of the log row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.functions.templates import fill
from quireflow.functions.text import event_heading, strip

UNKNOWN_BOOK = "Unknown Book"  # fixed value

MESSAGES = {
    "outline_ready": (
        "The outline of \"{title}\" is ready for review.\n\n"
        "- Put remarks into notes_on_outline_after.\n"
        "- Set status_outline_notes to no_notes_needed to start the chapters, or to yes to take more time.\n\n"
        "Book ID: {book_id}"
    ),
    "waiting_chapter_notes": (
        "Chapter {number} of \"{title}\" waits for review.\n\n"
        "- Put remarks into its notes.\n- Set its notes_status to no_notes_needed to approve it.\n\n"
        "Book ID: {book_id}"
    ),
    "chapter_ready": (
        "Chapter {number} of \"{title}\" has been written and can be reviewed.\n\nBook ID: {book_id}"
    ),
    "final_draft_ready": (
        "\"{title}\" has been compiled.\n\nFiles:\n{paths}\n\nBook ID: {book_id}"
    ),
    "error_pause": "Production of this book has stopped:\n\n{error}\n\nResolve it to continue.\n\nBook ID: {book_id}",
    "book_completed": (
        "\"{title}\" is complete: all chapters are reviewed and the final draft is compiled.\n\n"
        "Book ID: {book_id}"
    ),
}

# The parts of a webhook address that mark the newer card form,
# and the identifiers each card form must carry.
WORKFLOW_URL = r"logic\.azure\.com|prod-|powerplatform\.com"
PLACEHOLDER_URL = "your-webhook"
CARD_CONTENT_TYPE = "application/vnd.microsoft.card.adaptive"
CARD_SCHEMA = "http://adaptivecards.io/schemas/adaptive-card.json"
LEGACY_CONTEXT = "http://schema.org/extensions"
LEGACY_COLOR = "0076D7"


def with_title(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of a log or event feed with their book's title.

    The feed is the left side, so that a book (or NULL) with a large share of
    all events can be split by the adaptive plan.
    """
    titles = books.select(F.col("id").alias("book_id"), F.col("title").alias("_title"))
    return (
        rows.join(titles, "book_id", "left")
        .withColumn("book_title", F.coalesce("_title", F.lit(UNKNOWN_BOOK)))
        .drop("_title")
    )


def paths_text(paths: Column) -> Column:
    """Lines ``- FORMAT: path`` from an array of (format, path)."""
    return F.array_join(
        F.transform(
            paths, lambda p: F.concat(F.lit("- "), F.upper(p["format"]), F.lit(": "), p["path"])
        ),
        "\n",
    )


def notification_messages(
    events: DataFrame, books: DataFrame, templates: Mapping[str, str] = MESSAGES
) -> DataFrame:
    """Adds ``book_title`` and ``message`` to events.

    Events carry book_id, event_type and whatever their template needs:
    chapter_number, paths (array of format and path), or error. An event of a
    type without a template keeps the ``message`` that its caller gave it.
    """
    rows = with_title(events, books)
    have = set(rows.columns)
    slots = {
        "title": F.col("book_title"),
        "book_id": F.col("book_id"),
        "number": F.col("chapter_number") if "chapter_number" in have else F.lit(None),
        "paths": paths_text(F.col("paths")) if "paths" in have else F.lit(None),
        "error": F.col("error") if "error" in have else F.lit(None),
    }
    message = None
    for name, template in templates.items():
        here = F.col("event_type") == name
        text = strip(fill(template, slots))
        message = F.when(here, text) if message is None else message.when(here, text)
    if "message" in have:
        message = F.coalesce(message, F.col("message"))
    return rows.withColumn("message", message)


def outline_events(results: DataFrame) -> DataFrame:
    """An event per generated outline (id, error): ready for review, or a stop with its error."""
    return results.select(
        F.col("id").alias("book_id"),
        F.when(F.col("error").isNull(), "outline_ready").otherwise("error_pause").alias("event_type"),
        "error",
        F.lit(None).cast("string").alias("message"),
    )


def chapter_batch_events(results: DataFrame) -> DataFrame:
    """Per book of a batch (book_id, error): how many chapters it made, and the error it stopped at.

    A book stops at its first error, so it has one at most.
    """
    made = results.groupBy("book_id").agg(F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("error"))
    count = F.when(F.col("n") > 0, F.lit("chapters_generated"))
    stop = F.when(F.col("error").isNotNull(), F.lit("error_pause"))
    kinds = F.filter(F.array(count, stop), lambda e: e.isNotNull())
    said = F.concat(F.col("n").cast("string"), F.lit(" chapters generated."))
    return made.select("book_id", F.explode(kinds).alias("event_type"), "error", "n").select(
        "book_id",
        "event_type",
        F.when(F.col("event_type") == "error_pause", F.col("error")).alias("error"),
        F.when(F.col("event_type") == "chapters_generated", said).alias("message"),
    )


def notification_log_rows(messages: DataFrame, recipient: str, as_of: Column) -> DataFrame:
    """Log rows; anything not delivered, or never attempted, counts as failed.

    ``messages`` may carry a boolean ``delivered``.
    """
    delivered = F.col("delivered") if "delivered" in messages.columns else F.lit(False)
    return messages.select(
        "book_id",
        "event_type",
        "message",
        F.lit(recipient).alias("recipient"),
        F.when(delivered, "sent").otherwise("failed").alias("status"),
        as_of.alias("sent_at"),
    )


def email_rows(messages: DataFrame, sender_name: str = "Book Desk") -> DataFrame:
    """Adds the subject and the plain and HTML bodies."""
    heading = event_heading(F.col("event_type"))
    html = fill(
        '<html><body style="font-family: sans-serif"><h2>{heading}</h2>'
        "<p><strong>Book:</strong> {title}</p><hr><p>{message}</p></body></html>",
        {"heading": heading, "title": F.col("book_title"), "message": F.col("message")},
    )
    subject = F.concat(F.lit(f"[{sender_name}] "), heading, F.lit(": "), F.col("book_title"))
    return messages.withColumns({"subject": subject, "text_body": F.col("message"), "html_body": html})


def webhook_configured(url: Column) -> Column:
    return F.coalesce((url != "") & ~F.contains(F.lower(url), F.lit(PLACEHOLDER_URL)), F.lit(False))


def webhook_payloads(messages: DataFrame, url: Column, sender_name: str = "Book Desk") -> DataFrame:
    """Adds ``card`` (adaptive or legacy) and its JSON ``payload``.

    Rows without a usable address get an error and no payload.
    """
    title = event_heading(F.col("event_type"))
    text = F.concat(F.lit("**"), F.col("book_title"), F.lit("**\n\n"), F.col("message"))

    def block(content: Column, **style) -> Column:
        return F.struct(
            F.lit("TextBlock").alias("type"),
            content.alias("text"),
            *[F.lit(v).alias(k) for k, v in style.items()],
        )

    first = F.to_json(block(title, weight="Bolder", size="Large", wrap=True, color="Accent"))
    second = F.to_json(block(text, wrap=True, spacing="Medium"))
    third = F.to_json(block(F.lit(sender_name), size="Small", color="Light", spacing="Large"))
    adaptive = F.concat(
        F.lit(
            '{"type":"message","attachments":[{"contentType":"' + CARD_CONTENT_TYPE + '",'
            '"contentUrl":null,"content":{"$schema":"' + CARD_SCHEMA + '",'
            '"type":"AdaptiveCard","version":"1.4","body":['
        ),
        F.concat_ws(",", first, second, third),
        F.lit("]}}]}"),
    )
    legacy = F.to_json(
        F.struct(
            F.lit("MessageCard").alias("@type"),
            F.lit(LEGACY_CONTEXT).alias("@context"),
            title.alias("summary"),
            F.lit(LEGACY_COLOR).alias("themeColor"),
            title.alias("title"),
            text.alias("text"),
        )
    )
    usable = webhook_configured(url)
    card = F.when(~usable, F.lit(None)).when(url.rlike(WORKFLOW_URL), "adaptive").otherwise("legacy")
    payload = F.when(F.col("card") == "adaptive", adaptive).when(F.col("card") == "legacy", legacy)
    error = F.when(~usable, F.lit("webhook not configured"))
    return messages.withColumn("card", card).withColumns({"payload": payload, "error": error})
