"""One query per operator, each over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quireflow.functions import markdown as md, text as tx
from quireflow.functions.outline import short_headings, unreadable_numbers
from quireflow.operators import audit, context, gates, generate, ingest, mutations, notify, prompts, queues, rollups
from quireflow.plans import render
from quireflow.schemas import conform
from quireflow.session import settle, shared_dir
from quireflow.sources import tables, views as v
from quireflow.sources.stored import ChapterStore
from quireflow.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LONG = T.LongType()
BOOK, CHAPTER, UP_TO = 7, 702, 3


def as_of():
    return F.lit("2024-06-30 12:00:00").cast("timestamp_ntz")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _flat(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the supplied tables have them."""
    return df.select(
        [
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# -- sources and sinks ---------------------------------------------------------


@query
def read_submissions(spark, sf):
    path = shared_dir(spark, "submissions-csv")
    sheet = v.submissions(spark, sf).select(
        F.col("row_number").alias("Row_Number"),
        F.lit("unused").alias("extra"),
        F.col("title").alias(" Title "),
        F.col("notes_on_outline_before").alias("NOTES_ON_OUTLINE_BEFORE"),
    )
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    sheet.write.option("header", True).option("escape", '"').options(**keep).csv(path)
    return tables.read_submissions(spark, path)


@query
def read_plain_sheet(spark, sf):
    """A sheet of titles and notes alone; its rows are numbered by place."""
    path = shared_dir(spark, "plain-sheet")
    sheet = v.submissions(spark, sf).repartitionByRange(1, "row_number").sortWithinPartitions("row_number")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    sheet.drop("row_number").write.option("header", True).option("escape", '"').options(**keep).csv(path)
    return tables.read_submissions(spark, path)


@query
def dedupe_two_sheets(spark, sf):
    """Two sheets with the same row numbers, the second in another spelling."""
    sheet = v.submissions(spark, sf)
    other = sheet.withColumn("title", F.lower("title"))
    valid = ingest.valid_submissions(ingest.clean_submissions(sheet.unionByName(other)))
    return ingest.dedupe_submissions(valid, v.library(spark, sf))


@query
def clean_submissions(spark, sf):
    return ingest.clean_submissions(v.submissions(spark, sf))


@query
def validate_submissions(spark, sf):
    return ingest.validate_submissions(clean_submissions(spark, sf))


@query
def scan_books(spark, sf):
    return _flat(conform(v.books(spark, sf), "books", LONG))


@query
def scan_chapters(spark, sf):
    return _flat(conform(v.chapters(spark, sf), "chapters", LONG))


@query
def scan_log(spark, sf):
    return _flat(conform(v.notifications_log(spark, sf), "notifications_log", LONG))


@query
def append_with_defaults(spark, sf):
    created = dedupe_submissions(spark, sf).where("label = 'created'")
    rows = _flat(tables.append_with_defaults(created, "books", ["title"], as_of=as_of()))
    return rows.select(
        "id",
        "title",
        "notes_on_outline_before",
        "status_outline_notes",
        "final_review_notes_status",
        "book_output_status",
        "created_at",
        "updated_at",
    )


def _compiled(spark, sf):
    books, chapters = v.markdown_books(spark, sf), v.markdown_chapters(spark, sf)
    gate = settle(gates.compile_gate(books, chapters).select("book_id", "can_compile"), "gate")
    ready = render.compilable(books, gate)
    return ready, render.compile_text(ready, render.chapters_of(ready, chapters), as_of())


@query
def write_text_books(spark, sf):
    books, texts = _compiled(spark, sf)
    path = shared_dir(spark, "text-books")
    patches = tables.write_text_books(spark, texts, books, path, files=True)
    # The files of a book read in the order of their names.
    pages = spark.read.text(f"{path}/files", wholetext=True).select("book_id", "value", F.col("_metadata.file_path").alias("file"))
    whole = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("file", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "")
    return whole.join(patches, whole.book_id.cast("bigint") == patches.id).select(
        "id", F.col("output_txt_path").isNotNull().alias("has_path"), F.sha2(text, 256).alias("text_sha256")
    )


@query
def write_packed_books(spark, sf):
    _, texts = _compiled(spark, sf)
    path = shared_dir(spark, "packed-books")
    patches = tables.write_packed_books(spark, texts, path, size=1 << 20)
    pieces = tables.read_packed_books(spark, path).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: p["text"]), "")
    return pieces.join(patches, pieces.book_id == patches.id).select(
        "id", F.col("output_txt_path").isNotNull().alias("has_path"), F.sha2(text, 256).alias("text_sha256")
    )


# -- lookups and queues --------------------------------------------------------


@query
def book_by_id(spark, sf):
    return queues.by_id(v.books(spark, sf), BOOK)


@query
def chapter_by_id(spark, sf):
    return queues.by_id(v.chapters(spark, sf), CHAPTER)


@query
def books_by_ids(spark, sf):
    wanted = v.chapters(spark, sf).where("status = 'error'").select(F.col("book_id").alias("id"))
    return queues.by_ids(v.books(spark, sf), wanted)


@query
def books_by_status(spark, sf):
    return queues.books_by_status(v.books(spark, sf), "pending")


@query
def books_newest_first(spark, sf):
    return queues.newest_first(v.books(spark, sf)).select("id", "title", "created_at")


@query
def book_chapters(spark, sf):
    return queues.chapters_in_order(v.chapters(spark, sf)).select("book_id", "chapter_number", "title", "status")


@query
def one_book_chapters(spark, sf):
    return queues.chapters_in_order(v.chapters(spark, sf), BOOK)


@query
def summaries_before(spark, sf):
    return queues.summaries_before(v.chapters(spark, sf), BOOK, UP_TO)


@query
def book_notifications(spark, sf):
    return queues.book_notifications(v.notifications_log(spark, sf))


@query
def outline_queue(spark, sf):
    return queues.outline_queue(v.books(spark, sf)).select("id", "title", "reason")


@query
def pending_reviews(spark, sf):
    return queues.pending_reviews(v.books(spark, sf))


@query
def ready_for_chapters(spark, sf):
    return queues.ready_for_chapters(v.books(spark, sf)).select("id", "title")


@query
def ready_for_chapters_dashboard(spark, sf):
    return queues.ready_for_chapters(v.books(spark, sf), require_outline=False).select("id", "title")


@query
def pending_chapters(spark, sf):
    return queues.pending_chapters(v.chapters(spark, sf)).select("id", "book_id", "chapter_number")


@query
def unapproved_chapters(spark, sf):
    return queues.unapproved_chapters(v.chapters(spark, sf)).select("id", "book_id", "chapter_number", "status")


@query
def ready_to_compile(spark, sf):
    return queues.ready_to_compile(v.books(spark, sf)).select("id", "book_output_status")


@query
def next_book(spark, sf):
    return queues.next_book(v.books(spark, sf)).select("id", "title", "created_at")


@query
def previews(spark, sf):
    docs = v.table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "lang || ' ' || text AS title", "text AS content", "text AS summary"
    )
    return queues.chapter_previews(docs)


@query
def outline_previews(spark, sf):
    docs = v.table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS outline")
    return queues.book_previews(docs)


@query
def book_details(spark, sf):
    return queues.book_details(v.books(spark, sf), v.chapters(spark, sf))


# -- gates -----------------------------------------------------------------------


@query
def outline_gate(spark, sf):
    return gates.outline_gate(v.books(spark, sf)).select("id", "status_outline_notes", "action", "message")


@query
def chapter_gate(spark, sf):
    return gates.chapter_gate(v.chapters(spark, sf)).select("id", "gate_status", "action", "message")


@query
def batch_plan(spark, sf):
    return gates.batch_plan(v.books(spark, sf), v.chapters(spark, sf))


@query
def batch_plan_auto(spark, sf):
    return gates.batch_plan(v.books(spark, sf), v.chapters(spark, sf), auto_approve=True)


@query
def batch_plan_wide(spark, sf):
    return gates.batch_plan(v.wide_books(spark, sf), v.wide_chapters(spark, sf))


@query
def batch_blocked(spark, sf):
    return gates.batch_blocked(v.books(spark, sf))


@query
def compile_gate(spark, sf):
    gate = gates.compile_gate(v.books(spark, sf), v.chapters(spark, sf))
    return gate.withColumn("issues", F.array_join("issues", "; "))


@query
def corpus_step(spark, sf):
    return gates.corpus_step(v.books(spark, sf), v.chapters(spark, sf))


@query
def book_card(spark, sf):
    return gates.book_card(v.books(spark, sf), v.chapters(spark, sf))


@query
def run_route(spark, sf):
    return gates.run_route(v.books(spark, sf), v.chapters(spark, sf))


@query
def run_route_auto(spark, sf):
    return gates.run_route(v.books(spark, sf), v.chapters(spark, sf), auto_approve=True)


@query
def chapter_label(spark, sf):
    return gates.chapter_label(v.chapters(spark, sf)).select("id", "label")


@query
def book_action(spark, sf):
    return gates.book_action(v.books(spark, sf), v.chapters(spark, sf))


# -- joins -----------------------------------------------------------------------


@query
def dedupe_submissions(spark, sf):
    valid = ingest.valid_submissions(clean_submissions(spark, sf))
    return ingest.dedupe_submissions(valid, v.library(spark, sf))


@query
def books_needing_chapters(spark, sf):
    need = rollups.books_needing_chapters(v.books(spark, sf), v.chapters(spark, sf))
    return need.select("id", "title", "total", "pending")


@query
def workflow_status(spark, sf):
    return rollups.workflow_status(v.books(spark, sf), v.chapters(spark, sf))


@query
def log_with_title(spark, sf):
    return notify.with_title(v.notifications_log(spark, sf), v.books(spark, sf))


def _deleted(spark, sf):
    books = v.books(spark, sf)
    doomed = queues.books_by_status(books, "error")
    return mutations.cascade_delete(books, v.chapters(spark, sf), v.notifications_log(spark, sf), doomed)


@query
def cascade_delete(spark, sf):
    books, chapters, log = _deleted(spark, sf)
    return (
        books.select(F.lit("books").alias("table_name"), "id")
        .unionByName(chapters.select(F.lit("chapters").alias("table_name"), "id"))
        .unionByName(log.select(F.lit("notifications_log").alias("table_name"), "id"))
    )


@query
def orphans(spark, sf):
    return audit.orphans(v.notifications_log(spark, sf), v.books(spark, sf))


@query
def init_chapters(spark, sf):
    made = F.col("book_id") * 100 + F.col("chapter_number") - 1
    rows = context.initial_chapters(v.books(spark, sf), v.chapters(spark, sf), made)
    return rows.select("id", "book_id", "chapter_number", "title", "status", "notes_status")


# -- row changes -----------------------------------------------------------------


@query
def patch_rows(spark, sf):
    books = v.books(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    patches = queues.books_by_status(books, "paused").select(
        "id",
        F.lit(None).cast("string").alias("notes_on_outline_after"),
        F.lit("revised").alias("outline"),
        (F.col("status_outline_notes") == "yes").alias("set_outline"),
    )
    return mutations.patch_rows(books, patches, as_of())


@query
def merge_patches(spark, sf):
    changes = v.chapter_changes(spark, sf)
    patches = changes.select(
        F.col("book_id").alias("id"),
        "seq",
        "content",
        "status",
        (F.col("status") == "approved").alias("set_status"),
    )
    return mutations.merge_patches(patches, "seq")


@query
def latest_by_key(spark, sf):
    return mutations.latest_by_key(v.chapter_changes(spark, sf), ["book_id", "chapter_number"], ["changed_at", "seq"])


@query
def apply_approvals(spark, sf):
    books = v.books(spark, sf)
    asked = queues.pending_reviews(books).select("id", F.col("has_post_notes").alias("needs_notes"))
    done = mutations.patch_rows(books, mutations.outline_approvals(asked))
    final = mutations.final_review_approvals(books.where("final_review_notes_status = 'yes'"))
    return mutations.patch_rows(done, final)


@query
def dashboard_approvals(spark, sf):
    """Approval of reviewed outlines that leaves the output status as it is."""
    books = v.books(spark, sf)
    asked = mutations.dashboard_outline_approvals(queues.pending_reviews(books))
    return mutations.patch_rows(books, asked).select("id", "status_outline_notes", "book_output_status")


@query
def apply_chapter_approvals(spark, sf):
    chapters = v.chapters(spark, sf)
    bulk = mutations.chapter_approvals(queues.unapproved_chapters(chapters))
    return mutations.patch_rows(chapters, bulk).select("id", "status", "notes_status")


def _chapter_results(chapters):
    failed = F.col("notes") == "tighten"
    return queues.pending_chapters(chapters).select(
        "id",
        F.when(~F.coalesce(failed, F.lit(False)), F.concat(F.lit("new "), F.col("id"))).alias("content"),
        F.when(~F.coalesce(failed, F.lit(False)), F.lit("sum")).alias("summary"),
        F.when(failed, "backend failed").alias("error"),
    )


@query
def apply_generation(spark, sf):
    chapters = v.chapters(spark, sf)
    return mutations.patch_rows(chapters, mutations.chapter_results(_chapter_results(chapters)))


@query
def patch_stored(spark, sf):
    """The patches of generation on chapters stored in buckets, which are then read back."""
    chapters = v.chapters(spark, sf)
    store = ChapterStore.create(chapters, shared_dir(spark, "stored"), 8)
    store.patch(mutations.chapter_results(_chapter_results(chapters)))
    return store.chapters().select(chapters.columns)


@query
def apply_outlines(spark, sf):
    books = v.books(spark, sf)
    made = queues.queued_for_outline(books).select(
        "id",
        F.when(F.col("book_output_status") != "paused", F.concat(F.lit("# "), F.col("title"))).alias("text"),
        F.when(F.col("book_output_status") == "paused", "backend failed").alias("error"),
    )
    return mutations.patch_rows(books, mutations.outline_results(made)).select(
        "id", "outline", "status_outline_notes", "book_output_status"
    )


@query
def apply_regeneration(spark, sf):
    chapters = v.chapters(spark, sf)
    made = chapters.where(gates.chapter_action(chapters) == "regenerate").select(
        "id",
        F.lit("revised").alias("content"),
        F.lit("sum").alias("summary"),
        F.when(F.col("status") == "error", "backend failed").alias("error"),
    )
    return mutations.patch_rows(chapters, mutations.chapter_results(made, regenerated=True))


def _results(spark, sf):
    books, chapters = v.books(spark, sf), v.chapters(spark, sf)
    return render.compile_results(books, gates.compile_gate(books, chapters))


@query
def complete_books(spark, sf):
    books = v.books(spark, sf)
    done = mutations.completed_books(books, _results(spark, sf))
    return mutations.patch_rows(books, done).select("id", "book_output_status")


@query
def compile_results(spark, sf):
    return _results(spark, sf)


@query
def output_paths(spark, sf):
    return render.path_patches(_results(spark, sf))


# -- rollups and audits ------------------------------------------------------------


@query
def book_progress(spark, sf):
    return rollups.book_progress(v.books(spark, sf), v.chapters(spark, sf))


@query
def book_progress_wide(spark, sf):
    return rollups.book_progress(v.wide_books(spark, sf), v.wide_chapters(spark, sf))


@query
def progress_chapters(spark, sf):
    return rollups.progress_chapters(v.chapters(spark, sf))


@query
def workflow_counts(spark, sf):
    return rollups.workflow_counts(v.books(spark, sf), v.chapters(spark, sf))


@query
def status_report(spark, sf):
    return rollups.status_report(v.books(spark, sf), v.chapters(spark, sf))


@query
def progress_ratio(spark, sf):
    return rollups.progress_ratio(v.books(spark, sf), v.chapters(spark, sf))


@query
def ingest_summary(spark, sf):
    return ingest.ingest_summary(clean_submissions(spark, sf), v.library(spark, sf))


@query
def domain_violations(spark, sf):
    out = audit.domain_violations(v.notifications_log(spark, sf), "notifications_log")
    out = out.unionByName(audit.domain_violations(v.chapters(spark, sf), "chapters"))
    return out.unionByName(audit.domain_violations(v.books(spark, sf), "books"))


@query
def key_violations(spark, sf):
    wide = audit.duplicate_keys(v.wide_chapters(spark, sf), "chapters", ["book_id", "chapter_number"])
    return wide.unionByName(audit.duplicate_keys(v.notifications_log(spark, sf), "notifications_log", ["id"]))


@query
def missing_required(spark, sf):
    out = audit.missing_required(v.books(spark, sf), "books")
    out = out.unionByName(audit.missing_required(v.chapters(spark, sf), "chapters"))
    return out.unionByName(audit.missing_required(v.notifications_log(spark, sf), "notifications_log"))


@query
def compile_summary(spark, sf):
    return rollups.compile_summary(_results(spark, sf))


# -- windows -----------------------------------------------------------------------


@query
def chapter_context(spark, sf):
    return context.chapter_context(v.chapters(spark, sf)).select("book_id", "chapter_number", "context")


@query
def chapter_context_split(spark, sf):
    return context.chapter_context(v.chapters(spark, sf), segment=2).select("book_id", "chapter_number", "context")


@query
def prompt_context(spark, sf):
    return context.prompt_context(v.chapters(spark, sf)).select("book_id", "chapter_number", "prompt_context")


@query
def prompt_context_split(spark, sf):
    rows = context.prompt_context(v.chapters(spark, sf), segment=2)
    return rows.select("book_id", "chapter_number", "prompt_context")


@query
def table_of_contents(spark, sf):
    return context.table_of_contents(v.chapters(spark, sf))


# -- text and Markdown ---------------------------------------------------------------


@query
def parse_outline(spark, sf):
    return context.parse_outlines(v.outlines(spark, sf))


@query
def outline_number_audit(spark, sf):
    outline = F.col("outline")
    return v.outlines(spark, sf).select(
        "book_id", unreadable_numbers(outline).alias("unreadable"), short_headings(outline).alias("too_short")
    )


@query
def clean_markdown(spark, sf):
    return v.markdown(spark, sf).select("doc_id", md.clean_markdown(F.col("content")).alias("plain"))


def _blocks(spark, sf):
    return (
        v.markdown(spark, sf)
        .select("doc_id", F.posexplode(md.blocks(F.col("content"))).alias("seq", "b"))
        .select("doc_id", "seq", "b.type", "b.text", "b.items")
    )


@query
def markdown_blocks(spark, sf):
    return _blocks(spark, sf).select("doc_id", "seq", "type", "text")


@query
def block_items(spark, sf):
    return _blocks(spark, sf).select("doc_id", "seq", F.posexplode("items").alias("item_no", "item"))


@query
def quote_text(spark, sf):
    return _blocks(spark, sf).where("type = 'quote'").select("doc_id", "seq", "text")


@query
def code_text(spark, sf):
    return _blocks(spark, sf).where("type = 'code'").select("doc_id", "seq", "text")


@query
def bold_runs(spark, sf):
    return (
        _blocks(spark, sf)
        .where("type = 'paragraph'")
        .select("doc_id", "seq", F.posexplode(md.bold_runs(F.col("text"))).alias("run_no", "r"))
        .select("doc_id", "seq", "run_no", F.col("r.text").alias("run_text"), F.col("r.bold").alias("bold"))
    )


@query
def word_wrap(spark, sf):
    docs = v.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(tx.word_wrap(F.col("text"), 68)).alias("line_no", "line"))


@query
def safe_title(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.safe_title(F.col("url")).alias("file_title"))


@query
def center_line(spark, sf):
    return v.table(spark, sf, "customer").select(
        "c_custkey",
        tx.center_line(F.col("c_name")).alias("centered"),
        tx.center_line(F.col("c_mktsegment"), 11).alias("narrow"),
    )


@query
def event_heading(spark, sf):
    return v.notifications_log(spark, sf).select("id", tx.event_heading(F.col("event_type")).alias("heading"))


@query
def compile_text(spark, sf):
    return _compiled(spark, sf)[1]


def _printed(rows: DataFrame) -> DataFrame:
    runs = F.array_join(
        F.transform(
            "runs", lambda r: F.concat(F.when(r["bold"], "B:").otherwise("P:"), r["text"])
        ),
        "|",
    )
    return rows.withColumn("runs", runs)


@query
def render_rows_word(spark, sf):
    return _printed(
        render.render_rows_word(v.markdown_books(spark, sf), v.markdown_chapters(spark, sf), as_of())
    )


@query
def render_rows_pdf(spark, sf):
    return _printed(
        render.render_rows_pdf(v.markdown_books(spark, sf), v.markdown_chapters(spark, sf), as_of())
    )


# -- prompts and generation -------------------------------------------------------------


@query
def outline_prompts(spark, sf):
    return prompts.outline_prompts(v.books(spark, sf))


@query
def outline_revision_prompts(spark, sf):
    return prompts.outline_revision_prompts(v.books(spark, sf))


@query
def chapter_prompts(spark, sf):
    return prompts.chapter_prompts(v.books(spark, sf), v.chapters(spark, sf))


@query
def summary_prompts(spark, sf):
    return prompts.summary_prompts(v.markdown_books(spark, sf), v.markdown_chapters(spark, sf))


@query
def chapter_revision_prompts(spark, sf):
    return prompts.chapter_revision_prompts(v.books(spark, sf), v.chapters(spark, sf))


@query
def generate_text(spark, sf):
    asked = prompts.outline_revision_prompts(v.books(spark, sf))
    return generate.generate_text(asked, generate.DigestBackend, prompts.OUTLINE_TOKENS)


@query
def generate_chapters(spark, sf):
    books, chapters = v.books(spark, sf), v.chapters(spark, sf)
    plan = gates.batch_plan(books, chapters)
    return generate.generate_chapters(plan, books, chapters, generate.DigestBackend)


@query
def generate_by_number(spark, sf):
    books, chapters = v.books(spark, sf), v.chapters(spark, sf)
    plan = gates.batch_plan(books, chapters)
    return generate.generate_by_number(plan, books, chapters, generate.DigestBackend)


# -- notifications ------------------------------------------------------------------------


def _messages(spark, sf):
    name = F.col("id").cast("string")
    events = v.notifications_log(spark, sf).select(
        "id",
        "book_id",
        F.when(F.col("event_type") != "chapters_generated", F.col("event_type"))
        .when(F.col("status") == "sent", "chapter_ready")
        .otherwise("waiting_chapter_notes")
        .alias("event_type"),
        (F.col("status") == "sent").alias("delivered"),
        (F.col("id") % 12 + 1).cast("int").alias("chapter_number"),
        F.concat(F.lit("code "), name).alias("error"),
        F.array(
            F.struct(F.lit("docx").alias("format"), F.concat(name, F.lit(".docx")).alias("path")),
            F.struct(F.lit("txt").alias("format"), F.concat(name, F.lit(".txt")).alias("path")),
        ).alias("paths"),
    )
    return notify.notification_messages(events, v.books(spark, sf))


@query
def notification_messages(spark, sf):
    return _messages(spark, sf).select("id", "event_type", "message")


@query
def given_messages(spark, sf):
    """Events of a type without a template, with the message that their caller gives."""
    log = v.notifications_log(spark, sf).where("event_type = 'chapters_generated'")
    events = log.select("id", "book_id", "event_type", F.concat(F.lit("batch "), F.col("id").cast("string")).alias("message"))
    return notify.notification_messages(events, v.books(spark, sf)).select("id", "event_type", "message", "book_title")


@query
def outline_events(spark, sf):
    asked = prompts.outline_revision_prompts(v.books(spark, sf))
    made = generate.generate_text(asked, generate.DigestBackend, prompts.OUTLINE_TOKENS)
    return notify.outline_events(made)


@query
def chapter_batch_events(spark, sf):
    return notify.chapter_batch_events(generate_chapters(spark, sf))


@query
def notification_log_rows(spark, sf):
    return notify.notification_log_rows(_messages(spark, sf), "editor@example.com", as_of())


@query
def email_rows(spark, sf):
    return notify.email_rows(_messages(spark, sf)).select("id", "subject", "text_body", "html_body")


@query
def webhook_payloads(spark, sf):
    url = (
        F.when(F.col("event_type") == "outline_ready", "https://prod-7.example.com/hook")
        .when(F.col("event_type") == "chapter_ready", "https://example.com/hook")
        .when(F.col("event_type") == "error_pause", "https://Your-Webhook.example.com")
    )
    cards = notify.webhook_payloads(_messages(spark, sf), url)
    body = "$.attachments[0].content.body"
    return cards.select(
        "id",
        "card",
        "error",
        F.coalesce(
            F.get_json_object("payload", f"{body}[0].text"), F.get_json_object("payload", "$.title")
        ).alias("card_title"),
        F.coalesce(
            F.get_json_object("payload", f"{body}[1].text"), F.get_json_object("payload", "$.text")
        ).alias("card_text"),
    )


# -- streams ------------------------------------------------------------------------------


def _ran(query) -> None:
    query.awaitTermination()


# Batches, their least number of files, and rows of a file beyond that.
BATCHES, FILES, FILE_ROWS = 4, 2, 250_000


def _fed(spark, sf, name, key, out):
    """A table as a stream of four batches of files, in the order of its key.

    All batches have as many files, by the rows of the smallest, so that none is read with another's rows.
    """
    df = v.table(spark, sf, name)
    low, high = df.agg(F.min(key), F.max(key)).first()
    step = (high - low) // BATCHES + 1
    parts = [df.where((F.col(key) >= low + k * step) & (F.col(key) < low + (k + 1) * step)) for k in range(BATCHES)]
    files = max(FILES, min(part.count() for part in parts) // FILE_ROWS)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{out}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/in")


@query
def stream_submissions(spark, sf):
    out = shared_dir(spark, "stream-submissions")
    source = v.as_submissions(_fed(spark, sf, "part", "p_partkey", out))
    _ran(streams.stream_submissions(source, v.library(spark, sf), out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/submissions").drop("batch_id")


@query
def stream_transitions(spark, sf):
    out = shared_dir(spark, "stream-transitions")
    source = v.as_chapter_changes(_fed(spark, sf, "events", "event_id", out))
    _ran(streams.stream_transitions(source, out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/events").drop("batch_id")


@query
def stream_book_transitions(spark, sf):
    out = shared_dir(spark, "stream-books")
    source = v.as_book_changes(_fed(spark, sf, "events", "event_id", out))
    books = v.wide_books(spark, sf)
    _ran(streams.stream_book_transitions(source, out, f"{out}/checkpoint", books=books))
    return spark.read.parquet(f"{out}/events").select("seq", "book_id", "event_type", "message")


@query
def stream_progress(spark, sf):
    out = shared_dir(spark, "stream-progress")
    source = v.as_chapter_changes(_fed(spark, sf, "events", "event_id", out))
    _ran(streams.stream_progress(source, out, f"{out}/checkpoint", snapshot_every=2))
    return streams.current_progress(spark, out)
