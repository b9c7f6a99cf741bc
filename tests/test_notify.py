import json

from pyspark.sql import functions as F

from quireflow.operators import notify


def events(spark):
    books = spark.createDataFrame([(1, 'The "A"')], "id int, title string")
    rows = spark.createDataFrame(
        [
            (1, 1, "outline_ready", None, None, None, True),
            (2, 1, "waiting_chapter_notes", 4, None, None, None),
            (3, 1, "final_draft_ready", None, [("docx", "a.docx"), ("txt", "a.txt")], None, False),
            (4, None, "error_pause", None, None, "disk full", True),
            (5, 9, "book_completed", None, None, None, True),
            (6, 1, "chapters_generated", None, None, None, True),
        ],
        "id int, book_id int, event_type string, chapter_number int, "
        "paths array<struct<format:string,path:string>>, error string, delivered boolean",
    )
    return notify.notification_messages(rows, books)


def test_messages(spark):
    got = {r["id"]: r for r in events(spark).collect()}
    assert 'The outline of "The "A"" is ready' in got[1]["message"] and got[1]["message"].endswith("Book ID: 1")
    assert got[2]["message"].startswith("Chapter 4 of")
    assert "- DOCX: a.docx\n- TXT: a.txt" in got[3]["message"]
    assert "disk full" in got[4]["message"] and got[4]["book_title"] == notify.UNKNOWN_BOOK
    assert got[5]["book_title"] == notify.UNKNOWN_BOOK
    assert got[6]["message"] is None
    assert all(r["message"] is None or r["message"] == r["message"].strip() for r in got.values())


def test_not_attempted_counts_as_failed(spark):
    rows = notify.notification_log_rows(events(spark).orderBy("id"), "e@x", F.lit(None).cast("timestamp"))
    assert [r["status"] for r in rows.collect()] == ["sent", "failed", "failed", "sent", "sent", "sent"]
    never = notify.notification_log_rows(events(spark).drop("delivered"), "e@x", F.lit(None).cast("timestamp"))
    assert {r["status"] for r in never.collect()} == {"failed"}


def test_mail(spark):
    row = notify.email_rows(events(spark)).where("id = 1").first()
    assert row["subject"] == '[Book Desk] Outline Ready: The "A"'
    assert row["text_body"] == row["message"] and "<h2>Outline Ready</h2>" in row["html_body"]


def test_cards(spark):
    url = F.element_at(
        F.array(
            F.lit("https://prod-1.x/hook"),
            F.lit("https://x.logic.azure.com/h"),
            F.lit("https://hook.example.com"),
            F.lit("https://YOUR-WEBHOOK/x"),
            F.lit(""),
            F.lit(None),
        ),
        F.col("id"),
    )
    got = {r["id"]: r for r in notify.webhook_payloads(events(spark), url).collect()}
    assert [got[i]["card"] for i in range(1, 7)] == ["adaptive", "adaptive", "legacy", None, None, None]
    card = json.loads(got[1]["payload"])
    assert card["type"] == "message" and card["attachments"][0]["contentType"] == notify.CARD_CONTENT_TYPE
    body = card["attachments"][0]["content"]["body"]
    assert body[0] == {
        "type": "TextBlock", "text": "Outline Ready", "weight": "Bolder", "size": "Large", "wrap": True, "color": "Accent"
    }
    assert body[1]["text"].startswith('**The "A"**\n\n')
    legacy = json.loads(got[3]["payload"])
    assert legacy["@type"] == "MessageCard" and legacy["title"] == "Final Draft Ready"
    assert got[4]["payload"] is None and got[4]["error"]
