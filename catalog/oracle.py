"""Reference SQL for the registered queries, in DuckDB's dialect.

Written apart from the Spark code: the views are restated, and text work is
done by unnesting and re-aggregating where Spark stays inside arrays.
"""

from __future__ import annotations

import re

from catalog.wording import MESSAGES, TEMPLATES

NL = "chr(10)"
# White space, as code points.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
AS_OF = "TIMESTAMP '2024-06-30 12:00:00'"

VIEWS = {
    "chapters": """
SELECT conv_id * 100 + turn AS id, conv_id AS book_id, CAST(turn + 1 AS BIGINT) AS chapter_number,
  CASE WHEN (conv_id + turn) % 9 = 8 THEN NULL ELSE replace(text, chr(10), ' ') END AS title,
  CASE WHEN (conv_id + turn) % 4 = 3 THEN NULL WHEN (conv_id + turn) % 11 = 10 THEN '' ELSE text END AS content,
  CASE WHEN (conv_id + turn) % 4 = 3 OR (conv_id + turn) % 7 = 0 THEN NULL ELSE text END AS summary,
  CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN 'tighten' WHEN (conv_id * 3 + turn) % 5 = 1 THEN '' END AS notes,
  CASE (conv_id * 5 + turn * 3) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'yes' WHEN 2 THEN 'no'
    WHEN 3 THEN 'no_notes_needed' END AS notes_status,
  CASE (conv_id + turn * 5) % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'generating' WHEN 2 THEN 'generated'
    WHEN 3 THEN 'reviewed' WHEN 4 THEN 'approved' WHEN 5 THEN 'error' END AS status
FROM conversations""",
    "books": """
SELECT book_id AS id, 'Book ' || CAST(book_id AS VARCHAR) || ': a/b' AS title,
  CASE WHEN book_id % 6 = 5 THEN '' ELSE 'notes ' || CAST(book_id AS VARCHAR) END AS notes_on_outline_before,
  CASE WHEN book_id % 5 = 4 THEN NULL ELSE outline END AS outline,
  CASE WHEN book_id % 3 = 0 THEN 'shorter' END AS notes_on_outline_after,
  CASE book_id % 5 WHEN 0 THEN 'no_notes_needed' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'pending' END
    AS status_outline_notes,
  CASE book_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'yes' WHEN 2 THEN 'no_notes_needed' END
    AS final_review_notes_status,
  CASE book_id % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'paused' WHEN 3 THEN 'error'
    ELSE 'pending' END AS book_output_status,
  CAST(DATE '2024-01-01' + CAST(book_id % 300 AS INT) AS TIMESTAMP) AS created_at
FROM (SELECT book_id, outline FROM outlines UNION ALL SELECT CAST(n_nationkey + 1000000 AS BIGINT),
      '## Chapter 1: ' || n_name || chr(10) || chr(10) || '## Chapter 2: Region ' || n_regionkey FROM nation) b""",
    "submissions": """
SELECT CAST(p_partkey + 2 AS BIGINT) AS row_number,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN '' WHEN p_partkey % 17 = 2 THEN '  '
    WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || chr(9) ELSE p_name END AS title,
  CASE p_partkey % 4 WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE ' ' || p_type || ' ' END
    AS notes_on_outline_before
FROM part""",
    "library": "SELECT p_name AS title FROM part GROUP BY p_name HAVING count(*) % 2 = 0",
    "outlines": """
SELECT book_id, string_agg(h, chr(10) || chr(10) ORDER BY k) AS outline FROM (
  SELECT book_id, k, CASE book_id % 5
      WHEN 0 THEN '## Chapter ' || n || ': ' || t WHEN 1 THEN '### Chapter ' || n || ' - ' || t
      WHEN 2 THEN '## ' || n || '. ' || t WHEN 3 THEN '**Chapter ' || n || ': ' || t || '**'
      ELSE '## ' || t END || chr(10) || 'about ' || n AS h
  FROM (SELECT conv_id AS book_id, turn AS k, CAST(turn % 5 + 1 AS VARCHAR) AS n,
          replace(replace(text, chr(10), ' '), '*', '') AS t FROM conversations) x) y
GROUP BY book_id""",
    "markdown": """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
  CASE (i - 1) % 10
    WHEN 0 THEN '# ' || l
    WHEN 1 THEN '## ' || l
    WHEN 2 THEN '- ' || l || chr(10) || '* second' || chr(10) || 'dropped'
    WHEN 3 THEN '1. ' || l || chr(10) || '2. second'
    WHEN 4 THEN '> ' || l || chr(10) || 'tail'
    WHEN 5 THEN '```python' || chr(10) || l || chr(10) || '```'
    WHEN 6 THEN '### ' || l
    WHEN 7 THEN 'a **b** _c_ ' || l
    WHEN 8 THEN '#### ' || l
    ELSE l END), chr(10) || chr(10)) AS content
FROM documents""",
    "md_chapters": """
SELECT doc_id AS id, doc_id // 8 AS book_id, CAST(doc_id % 8 + 1 AS BIGINT) AS chapter_number,
  CASE WHEN doc_id % 9 = 4 THEN NULL ELSE 'Part ' || CAST(doc_id AS VARCHAR) || ' <&>' END AS title,
  CASE WHEN doc_id % 10 = 9 THEN NULL ELSE content END AS content
FROM markdown""",
    "md_books": """
SELECT id, 'Volume ' || CAST(id AS VARCHAR) || ': tales' AS title,
  CASE WHEN id % 3 = 0 THEN 'yes' ELSE 'pending' END AS final_review_notes_status
FROM (SELECT DISTINCT doc_id // 8 AS id FROM documents) d""",
    "log": """
SELECT event_id AS id, user_id AS book_id,
  CASE event_type WHEN 'view' THEN 'outline_ready' WHEN 'purchase' THEN 'final_draft_ready'
    WHEN 'signup' THEN 'book_completed' WHEN 'error' THEN 'error_pause' ELSE 'chapters_generated' END AS event_type,
  CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'sent' END AS status, ts AS sent_at
FROM events""",
    "wide_books": """
SELECT o_orderkey AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
  CASE o_orderstatus WHEN 'F' THEN 'no_notes_needed' WHEN 'O' THEN 'yes' ELSE 'pending' END AS status_outline_notes
FROM orders""",
    "wide_chapters": """
SELECT l_orderkey AS book_id, CAST(l_linenumber AS BIGINT) AS chapter_number,
  CASE WHEN l_linestatus = 'O' THEN 'text' END AS content,
  CASE WHEN l_quantity > 40 THEN 'notes' END AS notes,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'generated' END AS status,
  CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'pending' END AS notes_status
FROM lineitem""",
    "changes": """
SELECT event_id AS seq, user_id AS book_id, CAST(event_id % 4 + 1 AS BIGINT) AS chapter_number,
  CASE WHEN event_type <> 'error' THEN 'text ' || CAST(event_id AS VARCHAR) END AS content,
  CASE event_type WHEN 'view' THEN 'generated' WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'reviewed'
    WHEN 'error' THEN 'error' ELSE 'generated' END AS status,
  CASE event_type WHEN 'view' THEN 'yes' WHEN 'purchase' THEN 'no_notes_needed' ELSE 'pending' END AS notes_status,
  ts AS changed_at
FROM events""",
}
NEEDS = {"md_chapters": ("markdown",), "books": ("outlines",)}

ORACLE: dict[str, str] = {}


def views(*names: str, recursive: bool = False) -> str:
    order: list[str] = []
    for n in names:
        for m in (*NEEDS.get(n, ()), n):
            if m not in order:
                order.append(m)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def put(name: str, needs: tuple[str, ...], sql: str, recursive: bool = False) -> None:
    """Register one query; ``sql`` may start with further CTEs after a comma."""
    ORACLE[name] = views(*needs, recursive=recursive) + sql


def has(c: str) -> str:
    return f"coalesce({c} <> '', false)"


def strip(c: str) -> str:
    return f"trim({c}, '{SPACES}')"


def upper(c: str) -> str:
    return f"upper(replace({c}, 'ß', 'SS'))"


def fill(template: str, **slots: str) -> str:
    pieces = []
    # Odd pieces are the names of slots.
    parts = re.split(r"\{(\w+)\}", template)
    for text, slot in zip(parts[::2], [*parts[1::2], None]):
        if text:
            pieces.append("'" + text.replace("'", "''") + "'")
        if slot:
            pieces.append(f"coalesce(CAST({slots[slot]} AS VARCHAR), '')")
    return "(" + " || ".join(pieces) + ")"


def clean(c: str) -> str:
    for pattern, repl in (
        (r"\*\*([^*]+)\*\*", r"\1"),
        (r"\*([^*]+)\*", r"\1"),
        (r"__([^_]+)__", r"\1"),
        (r"_([^_]+)_", r"\1"),
        (r"`([^`]+)`", r"\1"),
        (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
        (r"(?m)^[-*]{3,}$", ""),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{repl}', 'g')"
    c = f"regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"coalesce({strip(c)}, '')"


def wrapped(c: str, width: int) -> str:
    """Greedy fold over words; the first line counts one column more."""
    words = (
        f"list_filter(regexp_split_to_array({c}, "
        "'[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+'), lambda w: w <> '')"
    )
    line = "length(regexp_extract(a, '[^\\n]*$'))"
    first = "CASE WHEN contains(a, chr(10)) THEN 0 ELSE 1 END"
    return (
        f"CASE WHEN len({words}) = 0 THEN '' ELSE list_reduce({words}, lambda a, w: "
        f"CASE WHEN {line} + {first} + length(w) + 1 <= {width} THEN a || ' ' || w "
        f"ELSE a || chr(10) || w END) END"
    )


COUNTS = f"""
counts AS (SELECT book_id, count(*) AS total, count(*) FILTER ({has('content')}) AS generated,
  count(*) FILTER (coalesce(status = 'approved', false)) AS approved,
  count(*) FILTER (NOT {has('content')}) AS pending,
  count(*) FILTER (coalesce(notes_status = 'yes', false)) AS waiting_review
  FROM chapters GROUP BY book_id),
cards AS (SELECT b.*, b.id AS book_id, coalesce(c.total, 0) AS total, coalesce(c.generated, 0) AS generated,
  coalesce(c.approved, 0) AS approved, coalesce(c.pending, 0) AS pending,
  coalesce(c.waiting_review, 0) AS waiting_review
  FROM books b LEFT JOIN counts c ON c.book_id = b.id)
"""
BC = ("books", "chapters")

# -- sources -----------------------------------------------------------------
# An empty cell of a CSV sheet is a missing value.
put(
    "read_submissions",
    ("submissions",),
    """ SELECT row_number, nullif(title, '') AS title, nullif(notes_on_outline_before, '') AS notes_on_outline_before
  FROM submissions""",
)
put(
    "read_plain_sheet",
    ("submissions",),
    """ SELECT row_number, nullif(title, '') AS title, nullif(notes_on_outline_before, '') AS notes_on_outline_before
  FROM submissions""",
)
CLEANED = f""",
cleaned AS (SELECT row_number, {strip('title')} AS title,
  CASE WHEN notes_on_outline_before <> '' THEN {strip('notes_on_outline_before')}
    ELSE notes_on_outline_before END AS notes_on_outline_before
  FROM submissions WHERE {has('title')})"""
put("clean_submissions", ("submissions",), CLEANED + " SELECT * FROM cleaned")
MISSING = "'Missing notes_on_outline_before - required before generating outline'"
put(
    "validate_submissions",
    ("submissions",),
    CLEANED + f" SELECT *, CASE WHEN NOT {has('notes_on_outline_before')} THEN {MISSING} END AS _error FROM cleaned",
)
put(
    "scan_books",
    ("books",),
    """ SELECT id, title, notes_on_outline_before, outline, notes_on_outline_after, status_outline_notes,
  CAST(NULL AS VARCHAR) AS final_review_notes, final_review_notes_status, book_output_status,
  CAST(NULL AS VARCHAR) AS output_docx_path, CAST(NULL AS VARCHAR) AS output_pdf_path,
  CAST(NULL AS VARCHAR) AS output_txt_path, created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM books""",
)
put(
    "scan_chapters",
    ("chapters",),
    " SELECT *, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM chapters",
)
put(
    "scan_log",
    ("log",),
    """ SELECT id, book_id, event_type, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS recipient,
  status, sent_at FROM log""",
)
DEDUPED = (
    CLEANED
    + f""",
valid AS (SELECT *, lower({strip('title')}) AS k FROM cleaned WHERE {has('notes_on_outline_before')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_number) AS rn FROM valid),
labelled AS (SELECT row_number, title, notes_on_outline_before,
  CASE WHEN rn = 1 AND k NOT IN (SELECT lower({strip('title')}) FROM library) THEN 'created' ELSE 'skipped' END AS label
  FROM ranked)"""
)
SUB = ("submissions", "library")
put(
    "dedupe_two_sheets",
    SUB,
    CLEANED.replace("FROM submissions", "FROM (SELECT * FROM submissions UNION ALL SELECT row_number, lower(title), notes_on_outline_before FROM submissions) s")
    + f""",
valid AS (SELECT *, lower({strip('title')}) AS k FROM cleaned WHERE {has('notes_on_outline_before')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_number, title, notes_on_outline_before) AS rn FROM valid)
SELECT row_number, title, notes_on_outline_before,
  CASE WHEN rn = 1 AND k NOT IN (SELECT lower({strip('title')}) FROM library) THEN 'created' ELSE 'skipped' END AS label FROM ranked""",
)
put("dedupe_submissions", SUB, DEDUPED + " SELECT * FROM labelled")
put(
    "append_with_defaults",
    SUB,
    DEDUPED
    + """ SELECT sha256('{"title":"' || title || '"}') AS id, title, notes_on_outline_before, 'pending' AS status_outline_notes,
  'pending' AS final_review_notes_status, 'pending' AS book_output_status, TIMESTAMP '2024-06-30 12:00:00' AS created_at,
  TIMESTAMP '2024-06-30 12:00:00' AS updated_at FROM labelled WHERE label = 'created'""",
)
put(
    "ingest_summary",
    SUB,
    DEDUPED
    + f""" SELECT label, count(*) AS n FROM (SELECT label FROM labelled UNION ALL
  SELECT 'invalid' FROM cleaned WHERE NOT {has('notes_on_outline_before')}) x GROUP BY label""",
)

# -- lookups and queues ------------------------------------------------------
put("book_by_id", ("books",), " SELECT * FROM books WHERE id = 7")
put("chapter_by_id", ("chapters",), " SELECT * FROM chapters WHERE id = 702")
put("books_by_ids", BC, " SELECT * FROM books WHERE id IN (SELECT book_id FROM chapters WHERE status = 'error')")
put("books_by_status", ("books",), " SELECT * FROM books WHERE book_output_status = 'pending'")
put("books_newest_first", ("books",), " SELECT id, title, created_at FROM books ORDER BY created_at DESC, id")
put(
    "book_chapters",
    ("chapters",),
    " SELECT book_id, chapter_number, title, status FROM chapters ORDER BY book_id, chapter_number",
)
put("one_book_chapters", ("chapters",), " SELECT * FROM chapters WHERE book_id = 7 ORDER BY chapter_number")
put(
    "summaries_before",
    ("chapters",),
    " SELECT chapter_number, title, summary FROM chapters WHERE book_id = 7 AND chapter_number <= 3",
)
put("book_notifications", ("log",), " SELECT * FROM log ORDER BY book_id, sent_at DESC, id")
put(
    "outline_queue",
    ("books",),
    f""" SELECT id, title, CASE WHEN {has('outline')} THEN 'has_outline'
  WHEN NOT {has('notes_on_outline_before')} THEN 'no_notes' ELSE 'queued' END AS reason FROM books""",
)
put(
    "pending_reviews",
    ("books",),
    f""" SELECT id, title, status_outline_notes AS status, true AS has_outline,
  {has('notes_on_outline_after')} AS has_post_notes
  FROM books WHERE {has('outline')} AND status_outline_notes = 'yes'""",
)
put(
    "ready_for_chapters",
    ("books",),
    f" SELECT id, title FROM books WHERE status_outline_notes = 'no_notes_needed' AND {has('outline')}",
)
put(
    "ready_for_chapters_dashboard",
    ("books",),
    " SELECT id, title FROM books WHERE status_outline_notes = 'no_notes_needed'",
)
put("pending_chapters", ("chapters",), f" SELECT id, book_id, chapter_number FROM chapters WHERE NOT {has('content')}")
put(
    "unapproved_chapters",
    ("chapters",),
    f""" SELECT id, book_id, chapter_number, status FROM chapters
  WHERE {has('content')} AND status IS DISTINCT FROM 'approved'""",
)
put(
    "ready_to_compile",
    ("books",),
    """ SELECT id, book_output_status FROM books WHERE book_output_status IS DISTINCT FROM 'completed'
  AND status_outline_notes IS NOT DISTINCT FROM 'no_notes_needed'""",
)
put("next_book", ("books",), " SELECT id, title, created_at FROM books ORDER BY created_at DESC, id LIMIT 1")
ORACLE["previews"] = """
SELECT doc_id AS id, substr(title, 1, 40) AS title_card, substr(title, 1, 30) AS title_progress,
  CASE WHEN text = '' THEN NULL WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '...' ELSE text END
    AS content_preview,
  substr(text, 1, 8000) AS content_for_summary, substr(text, 1, 100) || '...' AS summary_preview
FROM (SELECT *, lang || ' ' || text AS title FROM documents) d"""
ORACLE["outline_previews"] = (
    "SELECT doc_id AS id, substr(text, 1, 500) || '...' AS outline_preview FROM documents WHERE text <> ''"
)
put(
    "book_details",
    BC,
    f""" SELECT b.id AS book_id, b.title AS book_title, b.created_at,
  {has('b.notes_on_outline_before')} AS has_pre_notes, {has('b.outline')} AS has_outline,
  {has('b.notes_on_outline_after')} AS has_post_notes, b.status_outline_notes, b.final_review_notes_status,
  b.book_output_status, (SELECT count(*) FROM chapters x WHERE x.book_id = b.id) AS total_chapters,
  c.chapter_number, CASE WHEN c.id IS NOT NULL THEN substr(coalesce(c.title, 'Untitled'), 1, 40) END AS chapter_title,
  CASE WHEN c.id IS NULL THEN NULL WHEN c.status = 'approved' THEN 'approved' WHEN c.content <> '' THEN 'in_progress'
    ELSE 'pending' END AS mark,
  c.status AS chapter_status, c.notes_status
  FROM books b LEFT JOIN chapters c ON c.book_id = b.id""",
)

# -- gates ---------------------------------------------------------------------
put(
    "outline_gate",
    ("books",),
    """ SELECT id, status_outline_notes, action, CASE action
    WHEN 'regenerate' THEN 'Post-outline notes found. Ready to regenerate outline.'
    WHEN 'wait' THEN 'Waiting for editor to review and add notes.'
    WHEN 'proceed' THEN 'Ready to proceed to chapter generation.'
    ELSE 'Workflow paused. Status: ' || coalesce(status_outline_notes, 'None') END AS message
  FROM (SELECT *, CASE WHEN status_outline_notes = 'yes' AND notes_on_outline_after <> '' THEN 'regenerate'
    WHEN status_outline_notes = 'yes' THEN 'wait' WHEN status_outline_notes = 'no_notes_needed' THEN 'proceed'
    ELSE 'pause' END AS action FROM books) x""",
)
ACTED = f""",
acted AS (SELECT *, CASE WHEN notes_status = 'no_notes_needed' OR status = 'approved' THEN 'skip'
  WHEN {has('content')} AND {has('notes')} AND notes_status = 'yes' THEN 'regenerate'
  WHEN {has('content')} AND notes_status = 'yes' THEN 'wait'
  WHEN NOT {has('content')} THEN 'generate' ELSE 'pause' END AS action FROM chapters)"""
put(
    "chapter_gate",
    ("chapters",),
    ACTED
    + """ SELECT id, CASE WHEN action = 'generate' THEN status ELSE notes_status END AS gate_status, action,
  CASE action WHEN 'skip' THEN 'Chapter already approved' WHEN 'regenerate' THEN 'Notes provided. Ready to regenerate.'
    WHEN 'wait' THEN 'Waiting for editor review/notes' WHEN 'generate' THEN 'Ready for generation'
    ELSE 'Paused. Status: ' || coalesce(notes_status, 'None') END AS message FROM acted""",
)
PLANNED = (
    ACTED
    + f""",
running AS (SELECT *, max(CASE WHEN action = 'wait' THEN 1 ELSE 0 END) OVER
    (PARTITION BY book_id ORDER BY chapter_number) AS stopped FROM acted),
plan AS (SELECT book_id, chapter_number, action, CASE WHEN {has('content')} THEN 'keep_existing' ELSE 'generate' END AS work,
    stopped FROM running WHERE action <> 'skip'
    AND book_id IN (SELECT id FROM books WHERE status_outline_notes = 'no_notes_needed'))"""
)
put("batch_plan", BC, PLANNED + " SELECT book_id, chapter_number, action, work FROM plan WHERE stopped = 0")
put("batch_plan_auto", BC, PLANNED + " SELECT book_id, chapter_number, action, work FROM plan")
ORACLE["batch_plan_wide"] = (
    views("wide_books", "wide_chapters")
    + ", books AS (SELECT * FROM wide_books), chapters AS (SELECT * FROM wide_chapters)"
    + PLANNED
    + " SELECT book_id, chapter_number, action, work FROM plan WHERE stopped = 0"
)
put(
    "batch_blocked",
    ("books",),
    """ SELECT id AS book_id, 'Book outline not approved. Status: ' || coalesce(status_outline_notes, 'None') AS error
  FROM books WHERE status_outline_notes IS DISTINCT FROM 'no_notes_needed'""",
)
GATE = (
    ","
    + COUNTS
    + """,
gate AS (SELECT book_id, title, total AS total_chapters, generated, approved, final_review_notes_status AS final_status,
  concat_ws('; ', CASE WHEN final_review_notes_status = 'yes' THEN 'Waiting for final review notes' END,
    CASE WHEN total = 0 THEN 'No chapters found' END,
    CASE WHEN pending > 0 THEN pending || ' chapters not generated' END) AS issues FROM cards)"""
)
put(
    "compile_gate",
    BC,
    GATE
    + """ SELECT book_id, issues, total_chapters, generated, approved, final_status, issues = '' AS can_compile
  FROM gate""",
)
put(
    "corpus_step",
    BC,
    ","
    + COUNTS
    + f""",
t AS (SELECT count(*) AS n, count(*) FILTER (NOT {has('outline')}) AS a,
  count(*) FILTER ({has('outline')} AND coalesce(status_outline_notes = 'yes', false)) AS b,
  count(*) FILTER (coalesce(status_outline_notes = 'no_notes_needed', false) AND (total = 0 OR pending > 0)) AS c,
  count(*) FILTER (coalesce(status_outline_notes = 'no_notes_needed', false)
    AND book_output_status IS DISTINCT FROM 'completed') AS d FROM cards)
SELECT CASE WHEN n = 0 THEN 1 WHEN a > 0 OR b > 0 THEN 2 WHEN c > 0 THEN 3 WHEN d > 0 THEN 4 ELSE 5 END AS step,
  CASE WHEN n = 0 THEN 'no_books' WHEN a > 0 THEN 'needs_outline' WHEN b > 0 THEN 'needs_approval'
    WHEN c > 0 THEN 'needs_chapters' WHEN d > 0 THEN 'needs_compile' ELSE 'complete' END AS kind,
  CASE WHEN n = 0 THEN 0 WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c WHEN d > 0 THEN d ELSE 0 END
    AS pending_books,
  CASE WHEN n = 0 THEN 'Let''s start by adding your first book!' WHEN a > 0 THEN a || ' book(s) need outlines generated.'
    WHEN b > 0 THEN b || ' outline(s) ready for your review!'
    WHEN c > 0 THEN c || ' book(s) ready for chapter generation!'
    WHEN d > 0 THEN d || ' book(s) ready to be compiled!' ELSE 'All books are complete!' END AS message FROM t""",
)
put(
    "book_card",
    BC,
    ","
    + COUNTS
    + f""" SELECT book_id, title, generated, total, CASE WHEN book_output_status = 'completed' THEN 'Complete'
  WHEN generated = total AND total > 0 THEN 'Ready to Compile'
  WHEN status_outline_notes = 'no_notes_needed' THEN 'Chapters: ' || generated || '/' || total
  WHEN {has('outline')} THEN 'Outline Ready for Review' ELSE 'Needs Outline' END AS card FROM cards""",
)
for name, blocked in (("run_route", "stop"), ("run_route_auto", "approve_outline")):
    put(
        name,
        BC,
        ","
        + COUNTS
        + f""" SELECT book_id, step, CASE WHEN step = 'wait' THEN
    'Chapters not fully approved: ' || approved || '/' || total END AS message FROM (SELECT *,
  CASE WHEN NOT {has('outline')} THEN 'outline'
    WHEN status_outline_notes IS DISTINCT FROM 'no_notes_needed' THEN '{blocked}'
    WHEN (total = 0 AND regexp_matches(outline, '##')) OR generated < total THEN 'generate'
    WHEN approved = total THEN 'compile' ELSE 'wait' END AS step FROM cards) x""",
    )
put(
    "chapter_label",
    ("chapters",),
    """ SELECT id, CASE WHEN status = 'approved' THEN 'Approved' WHEN content <> '' THEN 'Ready for Review'
  ELSE 'Pending' END AS label FROM chapters""",
)
put(
    "book_action",
    BC,
    ","
    + COUNTS
    + f""" SELECT book_id, CASE WHEN NOT {has('outline')} THEN 'outline'
  WHEN status_outline_notes IS DISTINCT FROM 'no_notes_needed' THEN 'approve'
  WHEN total = 0 OR generated < total THEN 'chapters'
  WHEN book_output_status IS DISTINCT FROM 'completed' THEN 'compile' ELSE 'none' END AS user_action FROM cards""",
)

# -- joins -----------------------------------------------------------------------
put(
    "books_needing_chapters",
    BC,
    ","
    + COUNTS
    + """ SELECT id, title, total, pending FROM cards WHERE status_outline_notes = 'no_notes_needed'
  AND (total = 0 OR pending > 0)""",
)
WORKFLOW = """ SELECT b.id AS book_id, count(c.id) AS total_chapters,
  count(*) FILTER (coalesce(c.status = 'approved', false)) AS completed_chapters,
  count(*) FILTER (coalesce(c.status = 'pending', false)) AS pending_chapters
  FROM books b LEFT JOIN chapters c ON c.book_id = b.id GROUP BY b.id"""
put("workflow_counts", BC, WORKFLOW)
put(
    "workflow_status",
    BC,
    f""", w AS ({WORKFLOW}) SELECT w.*, c.chapter_number, c.title, c.status, c.notes_status
  FROM w LEFT JOIN chapters c ON c.book_id = w.book_id""",
)
put(
    "log_with_title",
    ("log", "books"),
    " SELECT l.*, coalesce(b.title, 'Unknown Book') AS book_title FROM log l LEFT JOIN books b ON b.id = l.book_id",
)
put(
    "cascade_delete",
    ("books", "chapters", "log"),
    """, doomed AS (SELECT id FROM books WHERE book_output_status = 'error')
SELECT 'books' AS table_name, id FROM books WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'chapters', id FROM chapters WHERE book_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'notifications_log', id FROM log WHERE book_id IS NULL OR book_id NOT IN (SELECT id FROM doomed)""",
)
put(
    "orphans",
    ("log", "books"),
    " SELECT * FROM log WHERE book_id IS NOT NULL AND book_id NOT IN (SELECT id FROM books)",
)
put(
    "init_chapters",
    BC,
    f""" SELECT id, book_id, chapter_number, title, status, notes_status FROM chapters
UNION ALL SELECT b.id * 100 + k, b.id, k + 1, CASE k WHEN 0 THEN n_name ELSE 'Region ' || n_regionkey END, 'pending', 'pending'
  FROM books b JOIN nation ON b.id = n_nationkey + 1000000, (VALUES (0), (1)) v(k)
  WHERE {has('b.outline')} AND b.id NOT IN (SELECT book_id FROM chapters)""",
)

# -- row changes -------------------------------------------------------------------
put(
    "patch_rows",
    ("books",),
    f""" SELECT id, title, notes_on_outline_before,
  CASE WHEN p AND coalesce(status_outline_notes = 'yes', false) THEN 'revised' ELSE outline END AS outline,
  CASE WHEN p THEN NULL ELSE notes_on_outline_after END AS notes_on_outline_after, status_outline_notes,
  final_review_notes_status, book_output_status, created_at, CASE WHEN p THEN {AS_OF} END AS updated_at
  FROM (SELECT *, book_output_status = 'paused' AS p FROM books) x""",
)
put(
    "merge_patches",
    ("changes",),
    """ SELECT book_id AS id, arg_max_null(content, seq) AS content,
  arg_max(status, seq) FILTER (status = 'approved') AS status, true AS set_content,
  bool_or(status = 'approved') AS set_status FROM changes GROUP BY book_id""",
)
put(
    "latest_by_key",
    ("changes",),
    """ SELECT book_id, chapter_number, seq, content, status, notes_status, changed_at FROM (SELECT *, row_number() OVER
  (PARTITION BY book_id, chapter_number ORDER BY changed_at DESC, seq DESC) AS rn FROM changes) x WHERE rn = 1""",
)
put(
    "apply_approvals",
    ("books",),
    f""" SELECT id, title, notes_on_outline_before, outline, notes_on_outline_after,
  CASE WHEN NOT r THEN status_outline_notes WHEN {has('notes_on_outline_after')} THEN 'yes'
    ELSE 'no_notes_needed' END AS status_outline_notes,
  CASE WHEN final_review_notes_status = 'yes' THEN 'no_notes_needed' ELSE final_review_notes_status END
    AS final_review_notes_status,
  CASE WHEN NOT r THEN book_output_status WHEN {has('notes_on_outline_after')} THEN 'pending' ELSE 'in_progress' END
    AS book_output_status, created_at
  FROM (SELECT *, {has('outline')} AND coalesce(status_outline_notes = 'yes', false) AS r FROM books) x""",
)
put(
    "dashboard_approvals",
    ("books",),
    f""" SELECT id, CASE WHEN {has('outline')} AND status_outline_notes = 'yes' THEN 'no_notes_needed' ELSE status_outline_notes END
    AS status_outline_notes, book_output_status FROM books""",
)
put(
    "apply_chapter_approvals",
    ("chapters",),
    f""" SELECT id, CASE WHEN u THEN 'approved' ELSE status END AS status,
  CASE WHEN u THEN 'no_notes_needed' ELSE notes_status END AS notes_status
  FROM (SELECT *, {has('content')} AND status IS DISTINCT FROM 'approved' AS u FROM chapters) x""",
)
put(
    "apply_generation",
    ("chapters",),
    f""" SELECT id, book_id, chapter_number, title, CASE WHEN g THEN 'new ' || id ELSE content END AS content,
  CASE WHEN g THEN 'sum' ELSE summary END AS summary, notes,
  CASE WHEN g THEN 'yes' ELSE notes_status END AS notes_status,
  CASE WHEN g THEN 'generated' WHEN e THEN 'error' ELSE status END AS status
  FROM (SELECT *, NOT {has('content')} AND coalesce(notes <> 'tighten', true) AS g,
    NOT {has('content')} AND coalesce(notes = 'tighten', false) AS e FROM chapters) x""",
)
# The same patches, on a stored table.
ORACLE["patch_stored"] = ORACLE["apply_generation"]
put(
    "apply_outlines",
    ("books",),
    f""" SELECT id, CASE WHEN q AND NOT e THEN '# ' || title ELSE outline END AS outline,
  CASE WHEN q AND NOT e THEN 'yes' ELSE status_outline_notes END AS status_outline_notes,
  CASE WHEN q AND e THEN 'error' ELSE book_output_status END AS book_output_status
  FROM (SELECT *, NOT {has('outline')} AND {has('notes_on_outline_before')} AS q,
    book_output_status = 'paused' AS e FROM books) x""",
)
put(
    "apply_regeneration",
    ("chapters",),
    ACTED
    + """ SELECT id, book_id, chapter_number, title, CASE WHEN r THEN 'revised' ELSE content END AS content,
  CASE WHEN r THEN 'sum' ELSE summary END AS summary, CASE WHEN r THEN NULL ELSE notes END AS notes,
  CASE WHEN r THEN 'yes' ELSE notes_status END AS notes_status, CASE WHEN r THEN 'generated' ELSE status END AS status
  FROM (SELECT *, action = 'regenerate' AND status IS DISTINCT FROM 'error' AS r FROM acted) x""",
)
RESULTS = (
    GATE
    + r""",
results AS (SELECT book_id, format, CASE WHEN issues = '' THEN book_id || '/' ||
    trim(regexp_replace(title, '[^\p{L}\p{N} _-]', '', 'g')) || '.' || format END AS path,
  CASE WHEN issues <> '' THEN 'Cannot compile: ' || replace(issues, '; ', ', ') END AS error
  FROM gate, (VALUES ('docx'), ('pdf'), ('txt')) f(format))"""
)
put("compile_results", BC, RESULTS + " SELECT * FROM results")
put(
    "complete_books",
    BC,
    RESULTS
    + """ SELECT id, CASE WHEN id IN (SELECT book_id FROM gate WHERE issues = '') THEN 'completed'
  ELSE book_output_status END AS book_output_status FROM books""",
)
put(
    "output_paths",
    BC,
    RESULTS
    + " SELECT book_id AS id, "
    + ", ".join(
        f"max(path) FILTER (format = '{f}') AS output_{f}_path, "
        f"bool_or(format = '{f}' AND error IS NULL) AS set_output_{f}_path"
        for f in ("docx", "pdf", "txt")
    )
    + " FROM results GROUP BY book_id",
)
put(
    "compile_summary",
    BC,
    RESULTS
    + """ SELECT book_id, count(*) AS formats, count(*) FILTER (error IS NULL) AS ok,
  count(*) FILTER (error IS NOT NULL) AS failed, bool_and(error IS NULL) AS all_ok FROM results GROUP BY book_id""",
)

# -- rollups and audits --------------------------------------------------------------
PROGRESS = " SELECT book_id, title, total, generated, approved, pending, waiting_review FROM cards"
put("book_progress", BC, "," + COUNTS + PROGRESS)
ORACLE["book_progress_wide"] = (
    views("wide_books", "wide_chapters")
    + ", books AS (SELECT * FROM wide_books), chapters AS (SELECT * FROM wide_chapters),"
    + COUNTS
    + PROGRESS
)
put(
    "progress_chapters",
    ("chapters",),
    f""" SELECT book_id, chapter_number AS number, coalesce(title, '') AS title, status, notes_status,
  {has('content')} AS has_content, {has('summary')} AS has_summary FROM chapters""",
)
put(
    "status_report",
    BC,
    ","
    + COUNTS
    + f""" SELECT id, title, {has('outline')} AS outline_done, status_outline_notes, book_output_status, generated, total,
  approved, CAST(NULL AS VARCHAR) AS output_docx_path, CAST(NULL AS VARCHAR) AS output_pdf_path,
  CAST(NULL AS VARCHAR) AS output_txt_path, created_at FROM cards ORDER BY created_at DESC, id""",
)
put(
    "progress_ratio",
    BC,
    ","
    + COUNTS
    + """ SELECT book_id, generated, total, CASE WHEN total > 0 THEN CAST(generated AS DOUBLE) / total ELSE 0.0 END
  AS ratio FROM cards""",
)
STATUS4 = "('pending', 'yes', 'no', 'no_notes_needed')"
put(
    "domain_violations",
    ("books", "chapters", "log"),
    f""" SELECT table_name, column_name, value, count(*) AS n FROM (
  SELECT 'books' AS table_name, 'status_outline_notes' AS column_name, status_outline_notes AS value FROM books
    WHERE status_outline_notes NOT IN {STATUS4}
  UNION ALL SELECT 'books', 'final_review_notes_status', final_review_notes_status FROM books
    WHERE final_review_notes_status NOT IN {STATUS4}
  UNION ALL SELECT 'books', 'book_output_status', book_output_status FROM books
    WHERE book_output_status NOT IN ('pending', 'in_progress', 'completed', 'paused', 'error')
  UNION ALL SELECT 'chapters', 'notes_status', notes_status FROM chapters WHERE notes_status NOT IN {STATUS4}
  UNION ALL SELECT 'chapters', 'status', status FROM chapters
    WHERE status NOT IN ('pending', 'generating', 'generated', 'reviewed', 'approved', 'error')
  UNION ALL SELECT 'notifications_log', 'event_type', event_type FROM log
    WHERE event_type NOT IN ('outline_ready', 'waiting_chapter_notes', 'chapter_ready', 'final_draft_ready',
      'error_pause', 'book_completed')
  UNION ALL SELECT 'notifications_log', 'status', status FROM log WHERE status NOT IN ('sent', 'failed', 'pending')
  ) x GROUP BY table_name, column_name, value""",
)
put(
    "key_violations",
    ("wide_chapters", "log"),
    """ SELECT 'chapters' AS table_name, 'book_id+chapter_number' AS key_name, book_id || '|' || chapter_number AS key_value,
  count(*) AS n FROM wide_chapters GROUP BY book_id, chapter_number HAVING count(*) > 1
UNION ALL SELECT 'notifications_log', 'id', CAST(id AS VARCHAR), count(*) FROM log GROUP BY id HAVING count(*) > 1""",
)
put(
    "missing_required",
    ("books", "chapters", "log"),
    "".join(
        f"{' UNION ALL' if i else ''} SELECT '{t if t != 'log' else 'notifications_log'}' AS table_name, "
        f"'{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n FROM {t}"
        for i, (t, c) in enumerate(
            [
                ("books", "id"),
                ("books", "title"),
                ("chapters", "id"),
                ("chapters", "book_id"),
                ("chapters", "chapter_number"),
                ("log", "id"),
                ("log", "event_type"),
            ]
        )
    ),
)

# -- windows -------------------------------------------------------------------------
CONTEXT = f""" SELECT c.book_id, c.chapter_number, CASE WHEN c.chapter_number <= 1 THEN '' ELSE coalesce((
  SELECT string_agg('Chapter ' || e.chapter_number || ': ' || coalesce(e.title, 'Untitled') || {NL} || e.summary,
    {NL} || {NL} ORDER BY e.chapter_number) FROM chapters e
  WHERE e.book_id = c.book_id AND e.chapter_number < c.chapter_number AND e.summary <> ''), '') END AS context
  FROM chapters c"""
put("chapter_context", ("chapters",), CONTEXT)
put("chapter_context_split", ("chapters",), CONTEXT)
PCTX = f"""
pctx AS (SELECT c.book_id, c.chapter_number, CASE WHEN c.chapter_number <= 1 THEN '' ELSE coalesce((
  SELECT CASE WHEN bool_or({has('e.summary')}) THEN 'SUMMARY OF PREVIOUS CHAPTERS:' || {NL} ||
    string_agg({NL} || 'Chapter ' || e.chapter_number || ': ' || coalesce(e.title, 'Untitled') || {NL} ||
      coalesce(e.summary, 'No summary available.') || {NL}, '' ORDER BY e.chapter_number) END FROM chapters e
  WHERE e.book_id = c.book_id AND e.chapter_number < c.chapter_number), '') END AS prompt_context
  FROM chapters c)"""
put("prompt_context", ("chapters",), "," + PCTX + " SELECT * FROM pctx")
put("prompt_context_split", ("chapters",), "," + PCTX + " SELECT * FROM pctx")
put(
    "table_of_contents",
    ("chapters",),
    """ SELECT book_id, chapter_number, 'Chapter ' || chapter_number || ': ' || coalesce(title, 'Untitled') AS entry
  FROM chapters WHERE content <> ''""",
)

# -- text and Markdown -----------------------------------------------------------------
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INNER = WS[1:-1]
FORMS = (
    rf"(?i)##{WS}*Chapter{WS}*(\p{{Nd}}+)[:{INNER}-]*([^\n]+)",
    rf"(?i)##{WS}*(\p{{Nd}}+)\.{WS}*([^\n]+)",
    rf"(?i)\*\*Chapter{WS}*(\p{{Nd}}+)[:{INNER}-]*([^\n]+?)\*\*",
)
form_union = " UNION ALL ".join(
    f"""SELECT book_id, {i} AS form, unnest(regexp_extract_all(outline, '{p}', 1)) AS n,
  unnest(regexp_extract_all(outline, '{p}', 2)) AS t,
  unnest(range(len(regexp_extract_all(outline, '{p}', 1)))) AS pos FROM outlines"""
    for i, p in enumerate(FORMS)
)
PARSED = f""",
found AS ({form_union}),
best AS (SELECT *, min(form) OVER (PARTITION BY book_id) AS chosen FROM found),
numbered AS (SELECT book_id, TRY_CAST(n AS BIGINT) AS chapter_number, t, pos FROM best WHERE form = chosen),
generic AS (SELECT book_id, unnest(h) AS t, unnest(range(1, len(h) + 1)) AS pos FROM (
    SELECT book_id, regexp_extract_all(outline, '##{WS}*([^\\n]+)', 1) AS h FROM outlines
    WHERE book_id NOT IN (SELECT book_id FROM found)) g),
parsed AS (
  SELECT book_id, chapter_number, {strip("rtrim(" + strip("arg_min(t, pos)") + ", '*')")} AS title
    FROM numbered WHERE chapter_number IS NOT NULL GROUP BY book_id, chapter_number
  UNION ALL SELECT book_id, CAST(pos AS BIGINT), title FROM (
    SELECT book_id, pos, {strip("rtrim(" + strip("t") + ", ':')")} AS title FROM generic) q WHERE length(title) > 3)"""
put("parse_outline", ("outlines",), PARSED + " SELECT *, '' AS description FROM parsed")
put(
    "outline_number_audit",
    ("outlines",),
    PARSED
    + """ SELECT o.book_id, CAST(count(n.book_id) FILTER (n.chapter_number IS NULL) AS INT) AS unreadable,
  CAST((SELECT count(*) FROM generic g WHERE g.book_id = o.book_id AND length("""
    + strip("rtrim(" + strip("g.t") + ", ':')")
    + """) <= 3) AS INT) AS too_short
  FROM outlines o LEFT JOIN numbered n ON n.book_id = o.book_id GROUP BY o.book_id""",
)
put("clean_markdown", ("markdown",), f" SELECT doc_id, {clean('content')} AS plain FROM markdown")


def split_blocks(source: str, key: str) -> str:
    """CTEs ending in ``blocks``: key, seq, p (raw), type, text, items of every block."""
    return f""",
pieces AS (SELECT {key}, list_filter(list_transform(string_split(content, chr(10) || chr(10)),
    lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM {source} WHERE content <> ''),
raw AS (SELECT {key}, unnest(ps) AS p, unnest(range(len(ps))) AS seq FROM pieces),
typed AS (SELECT *, CASE WHEN starts_with(p, '# ') THEN 'h1' WHEN starts_with(p, '## ') THEN 'h2'
    WHEN starts_with(p, '### ') THEN 'h3' WHEN starts_with(p, '#### ') THEN 'h4'
    WHEN starts_with(p, '- ') OR starts_with(p, '* ') THEN 'bullet_list'
    WHEN regexp_matches(p, '^\\p{{Nd}}+\\.{WS}') THEN 'numbered_list'
    WHEN starts_with(p, '> ') THEN 'quote' WHEN starts_with(p, '```') THEN 'code' ELSE 'paragraph' END AS type
  FROM raw),
blocks AS (SELECT {key}, CAST(seq AS INT) AS seq, p, type, CASE type WHEN 'h1' THEN {strip('substr(p, 3)')}
    WHEN 'h2' THEN {strip('substr(p, 4)')} WHEN 'h3' THEN {strip('substr(p, 5)')} WHEN 'h4' THEN {strip('substr(p, 6)')}
    WHEN 'quote' THEN regexp_replace(p, '(?m)^> ', '', 'g')
    WHEN 'code' THEN CASE WHEN regexp_full_match(string_split(code, chr(10))[1], '\\p{{L}}+')
      THEN array_to_string(string_split(code, chr(10))[2:], chr(10)) ELSE code END
    WHEN 'paragraph' THEN p END AS text,
    CASE type WHEN 'bullet_list' THEN list_transform(list_filter(list_transform(string_split(p, chr(10)),
        lambda x: {strip('x')}), lambda x: starts_with(x, '- ') OR starts_with(x, '* ')), lambda x: substr(x, 3))
      WHEN 'numbered_list' THEN list_filter(list_transform(string_split(p, chr(10)),
        lambda x: regexp_extract({strip('x')}, '^\\p{{Nd}}+\\.{WS}*([^\\n]+)', 1)), lambda x: x <> '') END AS items
  FROM (SELECT *, {strip("trim(p, '`')")} AS code FROM typed) t)"""


MD = split_blocks("markdown", "doc_id")
put("markdown_blocks", ("markdown",), MD + " SELECT doc_id, seq, type, text FROM blocks")
put(
    "block_items",
    ("markdown",),
    MD
    + """ SELECT doc_id, seq, CAST(item_no AS INT) AS item_no, item FROM (SELECT doc_id, seq, unnest(items) AS item,
  unnest(range(len(items))) AS item_no FROM blocks WHERE items IS NOT NULL) x""",
)
put("quote_text", ("markdown",), MD + " SELECT doc_id, seq, text FROM blocks WHERE type = 'quote'")
put("code_text", ("markdown",), MD + " SELECT doc_id, seq, text FROM blocks WHERE type = 'code'")
BOLD = r"\*\*([^*]+)\*\*"
put(
    "bold_runs",
    ("markdown",),
    MD
    + f""",
runs AS (
  SELECT doc_id, seq, unnest(a) AS run_text, false AS bold, 2 * unnest(range(len(a))) AS pos FROM
    (SELECT doc_id, seq, regexp_split_to_array(text, '{BOLD}') AS a FROM blocks WHERE type = 'paragraph') x
  UNION ALL SELECT doc_id, seq, unnest(b), true, 2 * unnest(range(len(b))) + 1 FROM
    (SELECT doc_id, seq, regexp_extract_all(text, '{BOLD}', 1) AS b FROM blocks WHERE type = 'paragraph') y)
SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id, seq ORDER BY pos) - 1 AS INT) AS run_no, run_text, bold
FROM runs WHERE run_text <> ''""",
)
ORACLE["word_wrap"] = f"""
SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM (SELECT doc_id, unnest(ls) AS line,
  unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split({wrapped('text', 68)}, chr(10)) AS ls
  FROM documents) w) x"""
ORACLE["safe_title"] = (
    r"SELECT page_id, trim(regexp_replace(url, '[^\p{L}\p{N} _-]', '', 'g')) AS file_title FROM pages"
)
ORACLE["center_line"] = """
SELECT c_custkey, CASE WHEN length(c_name) >= 72 THEN c_name ELSE repeat(' ', (72 - length(c_name)) // 2) || c_name ||
    repeat(' ', (72 - length(c_name) + 1) // 2) END AS centered,
  CASE WHEN length(c_mktsegment) >= 11 THEN c_mktsegment ELSE repeat(' ', (11 - length(c_mktsegment) + 1) // 2) ||
    c_mktsegment || repeat(' ', (11 - length(c_mktsegment)) // 2) END AS narrow
FROM customer"""
HEADING = (
    "array_to_string(list_transform(string_split(event_type, '_'), "
    "lambda w: upper(w[1]) || substr(w, 2)), ' ')"
)
put("event_heading", ("log",), f" SELECT id, {HEADING} AS heading FROM log")

RULE, DASH = "repeat('=', 72)", "repeat('-', 72)"


def centered(c: str) -> str:
    return (
        f"(CASE WHEN length({c}) >= 72 THEN {c} ELSE repeat(' ', (72 - length({c})) // 2) || {c} || "
        f"repeat(' ', (72 - length({c}) + 1) // 2) END)"
    )


DATE = f"'Generated on ' || strftime({AS_OF}, '%B %d, %Y')"
TITLE_PAGE = " || ".join(
    [
        NL, RULE, NL, NL, centered("title"), NL, NL, RULE, NL, NL, centered(f"({DATE})"),
        NL, NL, NL, NL, DASH, NL, centered("'TABLE OF CONTENTS'"), NL, DASH, NL,
    ]
)
MD_GATE = f""",
ready AS (SELECT b.* FROM md_books b JOIN md_chapters c ON c.book_id = b.id
  GROUP BY ALL HAVING b.final_review_notes_status <> 'yes' AND count(*) FILTER (NOT {has('c.content')}) = 0)"""
CH = split_blocks("md_chapters", "book_id, chapter_number, title")
MD_ITEMS = f"list_transform(items, lambda x: {clean('x')})"
TEXTS = (
    CH
    + f""",
cleaned AS (SELECT book_id, chapter_number, title, seq, type, {clean('text')} AS t, {MD_ITEMS} AS its FROM blocks),
lined AS (SELECT book_id, chapter_number, title, seq, CASE
    WHEN type IN ('h1', 'h2') THEN {NL} || {upper('t')} || {NL} || repeat('-', length(t)) || {NL}
    WHEN type IN ('h3', 'h4') THEN {NL} || '  ' || t || {NL}
    WHEN type = 'bullet_list' THEN array_to_string(list_concat(list_transform(its, lambda x: '    • ' || x), ['']), {NL})
    WHEN type = 'numbered_list' THEN array_to_string(list_concat(
      list_transform(its, lambda x, i: '    ' || i || '. ' || x), ['']), {NL})
    WHEN type = 'quote' THEN '    "' || t || '"' || {NL}
    WHEN t <> '' THEN '    ' || replace({wrapped('t', 68)}, {NL}, {NL} || '    ') || {NL} END AS ls FROM cleaned),
bodies AS (SELECT book_id, chapter_number, {RULE} || {NL} || 'CHAPTER ' || chapter_number || {NL} ||
    {upper("coalesce(title, 'Untitled')")} || {NL} || {RULE} || {NL} ||
    coalesce({NL} || string_agg(ls, {NL} ORDER BY seq), '') || {NL} || {NL} AS body
  FROM lined GROUP BY book_id, chapter_number, title)"""
    + MD_GATE
    + f""",
texts AS (
  SELECT id AS book_id, 0 AS section, CAST(NULL AS BIGINT) AS chapter_number, {TITLE_PAGE} AS text FROM ready
  UNION ALL SELECT book_id, 1, chapter_number, '    Chapter ' || chapter_number || ': ' || coalesce(title, 'Untitled')
    FROM md_chapters WHERE content <> '' AND book_id IN (SELECT id FROM ready)
  UNION ALL SELECT id, 2, NULL, {NL} FROM ready
  UNION ALL SELECT book_id, 3, chapter_number, body FROM bodies WHERE book_id IN (SELECT id FROM ready))"""
)
MDV = ("md_chapters", "md_books")
put("compile_text", MDV, TEXTS + " SELECT * FROM texts")
put(
    "write_text_books",
    MDV,
    TEXTS
    + """ SELECT book_id AS id, true AS has_path,
  sha256(string_agg(text, chr(10) ORDER BY section, chapter_number) || chr(10)) AS text_sha256 FROM texts GROUP BY book_id""",
)

ORACLE["write_packed_books"] = ORACLE["write_text_books"]


def rendered(front: list, before: list, head: str, toc: str, block_rows: str, page: str) -> str:
    """Render rows from per-book rows, a chapter head, and a block-row select."""

    def fixed(section: int, rows: list) -> str:
        return " UNION ALL ".join(
            f"SELECT id AS book_id, {section} AS section, CAST(NULL AS BIGINT) AS chapter_number, 0 AS seq, {i} AS item, "
            f"'{k}' AS kind, '{s}' AS style, {r} AS runs FROM md_books"
            for i, (k, s, r) in enumerate(rows)
        )

    name = "'P:Chapter ' || chapter_number || ': ' || coalesce(title, 'Untitled')"
    one = "FROM md_chapters WHERE content <> ''"
    pk, ps, _ = page
    return (
        CH
        + f""", sized AS (SELECT book_id, chapter_number, max(seq) + 1 AS n FROM blocks GROUP BY 1, 2),
rows AS ({fixed(0, front)} UNION ALL {fixed(1, before)} UNION ALL {fixed(3, [page])}
UNION ALL SELECT book_id, 2, chapter_number, 0, 0, 'toc', '{toc}', {name} {one}
UNION ALL SELECT book_id, 4, chapter_number, 0, 0, {head}, {name} {one}
UNION ALL {block_rows}
UNION ALL SELECT c.book_id, 4, c.chapter_number, coalesce(s.n, 0) + 1, 0, '{pk}', '{ps}', '' FROM md_chapters c
  LEFT JOIN sized s ON s.book_id = c.book_id AND s.chapter_number = c.chapter_number WHERE c.content <> '')
SELECT book_id, CAST(section AS INT) AS section, chapter_number, CAST(seq AS INT) AS seq, CAST(item AS INT) AS item,
  kind, style, runs FROM rows"""
    )


PARTS = f"regexp_split_to_array(text, '{BOLD}')"
BOLDS = f"regexp_extract_all(text, '{BOLD}', 1)"
RUNS = (
    f"array_to_string(list_filter(flatten(list_transform({PARTS}, lambda x, i: "
    f"[CASE WHEN x <> '' THEN 'P:' || {clean('x')} END, "
    f"CASE WHEN i <= len({BOLDS}) THEN 'B:' || {clean(BOLDS + '[i]')} END])), lambda x: x IS NOT NULL), '|')"
)
WORD_BLOCKS = f"""SELECT book_id, 4, chapter_number, seq + 1, 0,
    CASE type WHEN 'h4' THEN 'h4' WHEN 'quote' THEN 'quote' WHEN 'code' THEN 'code' WHEN 'paragraph' THEN 'paragraph'
      ELSE 'heading' END,
    CASE type WHEN 'h1' THEN 'Heading 1' WHEN 'h2' THEN 'Heading 2' WHEN 'h3' THEN 'Heading 3' ELSE 'Normal' END,
    CASE type WHEN 'paragraph' THEN {RUNS} WHEN 'code' THEN 'P:' || text
      WHEN 'h4' THEN 'B:' || {clean('text')} ELSE 'P:' || {clean('text')} END
  FROM blocks WHERE items IS NULL
UNION ALL SELECT book_id, 4, chapter_number, seq + 1, k, 'list',
    CASE type WHEN 'bullet_list' THEN 'List Bullet' ELSE 'List Number' END, 'P:' || {clean('x')}
  FROM (SELECT *, unnest(items) AS x, unnest(range(len(items))) AS k FROM blocks WHERE items IS NOT NULL) i"""
put(
    "render_rows_word",
    MDV,
    rendered(
        [("blank", "Normal", "''")] * 6
        + [
            ("title", "Normal", "'B:' || title"),
            ("blank", "Normal", "''"),
            ("date", "Normal", f"'P:' || {DATE}"),
            ("page_break", "Normal", "''"),
        ],
        [("heading", "Heading 1", "'P:Table of Contents'"), ("blank", "Normal", "''")],
        "'heading', 'Heading 1'",
        "Normal",
        WORD_BLOCKS,
        ("page_break", "Normal", "''"),
    ),
)


def escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


PAGE_BLOCKS = f"""SELECT book_id, 4, chapter_number, seq + 1, 0,
    CASE WHEN type IN ('h1', 'h2') THEN 'heading2' WHEN type IN ('h3', 'h4') THEN 'heading3'
      WHEN type = 'quote' THEN 'quote' ELSE 'body' END,
    CASE WHEN type IN ('h1', 'h2') THEN 'Heading2Custom' WHEN type IN ('h3', 'h4') THEN 'Heading3Custom'
      WHEN type = 'quote' THEN 'Quote' ELSE 'BookBody' END, 'P:' || t
  FROM (SELECT *, {escaped(clean('text'))} AS t FROM blocks WHERE items IS NULL) b
  WHERE t <> '' OR type NOT IN ('paragraph', 'code')
UNION ALL SELECT book_id, 4, chapter_number, seq + 1, k, 'body', 'BookBody',
    'P:' || CASE type WHEN 'bullet_list' THEN '• ' ELSE (k + 1) || '. ' END || {escaped(clean('x'))}
  FROM (SELECT *, unnest(items) AS x, unnest(range(len(items))) AS k FROM blocks WHERE items IS NOT NULL) i"""
put(
    "render_rows_pdf",
    MDV,
    rendered(
        [
            ("spacer", "Spacer", "''"),
            ("title", "BookTitle", "'P:' || title"),
            ("spacer", "Spacer", "''"),
            ("date", "Date", f"'P:' || {DATE}"),
            ("page_break", "PageBreak", "''"),
        ],
        [("contents_title", "ChapterTitle", "'P:Table of Contents'"), ("spacer", "Spacer", "''")],
        "'chapter_title', 'ChapterTitle'",
        "TOC",
        PAGE_BLOCKS,
        ("page_break", "PageBreak", "''"),
    ),
)

# -- prompts and generation ---------------------------------------------------------------
put(
    "outline_prompts",
    ("books",),
    f""" SELECT id, {fill(TEMPLATES['outline'], title='title', notes='notes_on_outline_before')} AS prompt FROM books
  WHERE NOT {has('outline')} AND {has('notes_on_outline_before')}""",
)
REVISIONS = f""",
revisions AS (SELECT id, CASE WHEN {has('notes_on_outline_after')} AND {has('outline')} THEN
    {fill(TEMPLATES['outline_revision'], title='title', outline='outline', feedback='notes_on_outline_after')} END AS prompt,
  CASE WHEN NOT {has('notes_on_outline_after')} THEN 'No post-outline notes to use for regeneration'
    WHEN NOT {has('outline')} THEN 'No existing outline to regenerate' END AS error FROM books)"""
put("outline_revision_prompts", ("books",), REVISIONS + " SELECT * FROM revisions")
put(
    "generate_text",
    ("books",),
    REVISIONS + " SELECT id, 'text ' || md5(prompt) AS text, error FROM revisions",
)
TITLED = "coalesce(c.title, 'Untitled')"
NOTES_SECTION = f"CASE WHEN {has('c.notes')} THEN {fill(TEMPLATES['notes_section'], notes='c.notes')} END"
put(
    "chapter_prompts",
    BC,
    ","
    + PCTX
    + f""" SELECT c.book_id, c.chapter_number, {fill(
        TEMPLATES['chapter'], title='b.title', outline='b.outline', context='p.prompt_context',
        number='c.chapter_number', chapter_title=TITLED, notes_section=NOTES_SECTION)} AS prompt
  FROM chapters c JOIN books b ON b.id = c.book_id
  JOIN pctx p ON p.book_id = c.book_id AND p.chapter_number = c.chapter_number WHERE NOT {has('c.content')}""",
)
put(
    "summary_prompts",
    MDV,
    f""" SELECT c.book_id, c.chapter_number, {fill(
        TEMPLATES['summary'], title='b.title', number='c.chapter_number', chapter_title=TITLED,
        content='c.content')} AS prompt
  FROM md_chapters c JOIN md_books b ON b.id = c.book_id WHERE c.content <> ''""",
)
put(
    "chapter_revision_prompts",
    BC,
    f""" SELECT c.book_id, c.chapter_number, CASE WHEN {has('c.notes')} THEN {fill(
        TEMPLATES['chapter_revision'], title='b.title', number='c.chapter_number', chapter_title=TITLED,
        content='c.content', feedback='c.notes')} END AS prompt,
  CASE WHEN NOT {has('c.notes')} THEN 'No notes provided for regeneration' END AS error
  FROM chapters c JOIN books b ON b.id = c.book_id""",
)
CHAIN_PROMPT = fill(
    TEMPLATES["chapter"],
    title="c.book_title",
    outline="c.outline",
    context="CASE WHEN r.seen AND c.chapter_number > 1 THEN 'SUMMARY OF PREVIOUS CHAPTERS:' || chr(10) || r.ctx END",
    number="c.chapter_number",
    chapter_title=TITLED,
    notes_section=NOTES_SECTION,
)
CHAIN_SUMMARY = fill(
    TEMPLATES["summary"], title="book_title", number="chapter_number", chapter_title="title_or", content="made"
)
put(
    "generate_chapters",
    BC,
    PLANNED
    + f""",
due AS (SELECT book_id, chapter_number FROM plan WHERE stopped = 0 AND work = 'generate'),
ordered AS (SELECT c.*, b.title AS book_title, b.outline,
    (c.book_id, c.chapter_number) IN (SELECT (book_id, chapter_number) FROM due) AS is_due,
    row_number() OVER (PARTITION BY c.book_id ORDER BY c.chapter_number) AS rn
  FROM chapters c JOIN books b ON b.id = c.book_id),
chain AS (
  SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS chapter_number, CAST(NULL AS VARCHAR) AS content,
    CAST(NULL AS VARCHAR) AS summary, '' AS ctx, false AS seen FROM due
  UNION ALL
  SELECT book_id, rn, chapter_number, made, new_summary,
    ctx || chr(10) || 'Chapter ' || chapter_number || ': ' || title_or || chr(10) ||
      coalesce(now_summary, 'No summary available.') || chr(10),
    seen OR {has('now_summary')}
  FROM (SELECT *, coalesce(new_summary, old_summary) AS now_summary FROM (
    SELECT *, 'text ' || md5(CASE WHEN made IS NOT NULL THEN {CHAIN_SUMMARY} END) AS new_summary FROM (
      SELECT c.book_id, c.rn, c.chapter_number, c.book_title, {TITLED} AS title_or, c.summary AS old_summary, r.ctx, r.seen,
        CASE WHEN c.is_due THEN 'text ' || md5({CHAIN_PROMPT}) END AS made
      FROM chain r JOIN ordered c ON c.book_id = r.book_id AND c.rn = r.rn + 1) x) y) z)
SELECT book_id, chapter_number, content, summary, CAST(NULL AS VARCHAR) AS error FROM chain WHERE content IS NOT NULL""",
    recursive=True,
)

# -- notifications --------------------------------------------------------------------------
message_cases = " ".join(
    f"WHEN '{name}' THEN "
    + strip(
        fill(
            template,
            title="book_title",
            book_id="book_id",
            number="id % 12 + 1",
            paths="'- DOCX: ' || id || '.docx' || chr(10) || '- TXT: ' || id || '.txt'",
            error="'code ' || id",
        )
    )
    for name, template in MESSAGES.items()
)
SENT = f""",
sent AS (SELECT *, CASE event_type {message_cases} END AS message, {HEADING} AS heading FROM (
  SELECT l.id, l.book_id, CASE WHEN l.event_type <> 'chapters_generated' THEN l.event_type
    WHEN l.status = 'sent' THEN 'chapter_ready' ELSE 'waiting_chapter_notes' END AS event_type, l.status,
    coalesce(b.title, 'Unknown Book') AS book_title FROM log l LEFT JOIN books b ON b.id = l.book_id) x)"""
LB = ("log", "books")
# One number at a time or book by book, the texts are the same.
ORACLE["generate_by_number"] = ORACLE["generate_chapters"]

put(
    "given_messages",
    LB,
    """ SELECT l.id, event_type, 'batch ' || l.id AS message, coalesce(b.title, 'Unknown Book') AS book_title
  FROM log l LEFT JOIN books b ON b.id = l.book_id WHERE event_type = 'chapters_generated'""",
)
put(
    "outline_events",
    ("books",),
    REVISIONS
    + """ SELECT id AS book_id, CASE WHEN error IS NULL THEN 'outline_ready' ELSE 'error_pause' END AS event_type, error,
  CAST(NULL AS VARCHAR) AS message FROM revisions""",
)
ORACLE["chapter_batch_events"] = f"""SELECT book_id, 'chapters_generated' AS event_type, CAST(NULL AS VARCHAR) AS error,
  count(*) || ' chapters generated.' AS message FROM ({ORACLE['generate_chapters']}) g GROUP BY book_id"""
put("notification_messages", LB, SENT + " SELECT id, event_type, message FROM sent")
put(
    "notification_log_rows",
    LB,
    SENT
    + f""" SELECT book_id, event_type, message, 'editor@example.com' AS recipient,
  CASE WHEN status = 'sent' THEN 'sent' ELSE 'failed' END AS status, {AS_OF} AS sent_at FROM sent""",
)
put(
    "email_rows",
    LB,
    SENT
    + """ SELECT id, '[Book Desk] ' || heading || ': ' || book_title AS subject, message AS text_body,
  '<html><body style="font-family: sans-serif"><h2>' || heading || '</h2><p><strong>Book:</strong> ' || book_title ||
  '</p><hr><p>' || message || '</p></body></html>' AS html_body FROM sent""",
)
put(
    "webhook_payloads",
    LB,
    SENT
    + """ SELECT id, card, CASE WHEN card IS NULL THEN 'webhook not configured' END AS error,
  CASE WHEN card IS NOT NULL THEN heading END AS card_title,
  CASE WHEN card IS NOT NULL THEN '**' || book_title || '**' || chr(10) || chr(10) || message END AS card_text
  FROM (SELECT *, CASE event_type WHEN 'outline_ready' THEN 'adaptive' WHEN 'chapter_ready' THEN 'legacy' END AS card
    FROM sent) x""",
)

# -- streams ----------------------------------------------------------------------------------
put(
    "stream_submissions",
    SUB,
    DEDUPED
    + f""" SELECT row_number, title, notes_on_outline_before, label, CAST(NULL AS VARCHAR) AS _error FROM labelled
UNION ALL SELECT row_number, title, notes_on_outline_before, 'invalid', {MISSING} FROM cleaned
  WHERE NOT {has('notes_on_outline_before')}""",
)
put(
    "stream_transitions",
    ("changes",),
    """ SELECT CASE WHEN status = 'error' THEN 'error_pause' WHEN notes_status = 'yes' THEN 'waiting_chapter_notes'
    ELSE 'chapter_ready' END AS event_type, seq, book_id, chapter_number, status, notes_status
  FROM (SELECT *, lag(status) OVER (PARTITION BY book_id, chapter_number ORDER BY seq) AS before FROM changes) x
  WHERE status IN ('generated', 'error') AND status IS DISTINCT FROM before""",
)
put(
    "stream_progress",
    ("changes",),
    f""" SELECT book_id, count(*) AS total, count(*) FILTER ({has('content')}) AS generated,
  count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (NOT {has('content')}) AS pending,
  count(*) FILTER (notes_status = 'yes') AS waiting_review
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY seq DESC) AS rn FROM changes) x
  WHERE rn = 1 GROUP BY book_id""",
)
put(
    "stream_book_transitions",
    ("wide_books",),
    """,
reached AS (SELECT event_id AS seq, user_id AS book_id, 'out/' || event_id AS path,
  CASE event_type WHEN 'signup' THEN 'book_completed' WHEN 'purchase' THEN 'final_draft_ready' WHEN 'error' THEN NULL
    ELSE 'outline_ready' END AS event_type FROM events),
moved AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY book_id ORDER BY seq) AS before FROM reached) x
  WHERE event_type IS NOT NULL AND event_type IS DISTINCT FROM before)
SELECT seq, m.book_id, event_type, CASE event_type
  WHEN 'outline_ready' THEN 'The outline of "' || coalesce(title, 'Unknown Book') || '" is ready for review.' || chr(10) || chr(10) ||
    '- Put remarks into notes_on_outline_after.' || chr(10) ||
    '- Set status_outline_notes to no_notes_needed to start the chapters, or to yes to take more time.' || chr(10) || chr(10) ||
    'Book ID: ' || m.book_id
  WHEN 'final_draft_ready' THEN '"' || coalesce(title, 'Unknown Book') || '" has been compiled.' || chr(10) || chr(10) ||
    'Files:' || chr(10) || '- PDF: ' || path || chr(10) || chr(10) || 'Book ID: ' || m.book_id
  ELSE '"' || coalesce(title, 'Unknown Book') || '" is complete: all chapters are reviewed and the final draft is compiled.' ||
    chr(10) || chr(10) || 'Book ID: ' || m.book_id END AS message
FROM moved m LEFT JOIN wide_books b ON b.id = m.book_id""",
)
