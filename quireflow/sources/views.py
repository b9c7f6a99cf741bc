"""Views of the supplied tables under this package's schemas.

They stand in for production tables in queries, tests and the bench. Every
view is a projection that Spark runs over the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 100 + turn AS id",
        "conv_id AS book_id",
        "CAST(turn + 1 AS BIGINT) AS chapter_number",
        """CASE WHEN (conv_id + turn) % 9 = 8 THEN NULL
                ELSE replace(text, chr(10), ' ') END AS title""",
        """CASE WHEN (conv_id + turn) % 4 = 3 THEN NULL
                WHEN (conv_id + turn) % 11 = 10 THEN '' ELSE text END AS content""",
        """CASE WHEN (conv_id + turn) % 4 = 3 OR (conv_id + turn) % 7 = 0 THEN NULL
                ELSE text END AS summary""",
        """CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN 'tighten'
                WHEN (conv_id * 3 + turn) % 5 = 1 THEN '' END AS notes""",
        """CASE (conv_id * 5 + turn * 3) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'yes'
                WHEN 2 THEN 'no' WHEN 3 THEN 'no_notes_needed' END AS notes_status""",
        """CASE (conv_id + turn * 5) % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'generating'
                WHEN 2 THEN 'generated' WHEN 3 THEN 'reviewed' WHEN 4 THEN 'approved'
                WHEN 5 THEN 'error' END AS status""",
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey + 1000000 AS BIGINT) AS book_id",
        "'## Chapter 1: ' || n_name || '\\n\\n## Chapter 2: Region ' || n_regionkey AS outline",
    )
    return (
        outlines(spark, sf_dir)
        .unionByName(without)
        .selectExpr(
            "book_id AS id",
            "'Book ' || CAST(book_id AS STRING) || ': a/b' AS title",
            """CASE WHEN book_id % 6 = 5 THEN '' ELSE 'notes ' || CAST(book_id AS STRING) END
               AS notes_on_outline_before""",
            "CASE WHEN book_id % 5 = 4 THEN NULL ELSE outline END AS outline",
            "CASE WHEN book_id % 3 = 0 THEN 'shorter' END AS notes_on_outline_after",
            """CASE book_id % 5 WHEN 0 THEN 'no_notes_needed' WHEN 1 THEN 'yes' WHEN 2 THEN 'no'
               WHEN 3 THEN 'pending' END AS status_outline_notes""",
            """CASE book_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'yes' WHEN 2 THEN 'no_notes_needed' END
               AS final_review_notes_status""",
            """CASE book_id % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'paused'
               WHEN 3 THEN 'error' ELSE 'pending' END AS book_output_status""",
            """CAST(date_add(DATE '2024-01-01', CAST(book_id % 300 AS INT)) AS TIMESTAMP_NTZ)
               AS created_at""",
        )
    )


def as_submissions(part: DataFrame) -> DataFrame:
    """Parts as title submissions; also used on a stream of parts."""
    return part.selectExpr(
        "CAST(p_partkey + 2 AS BIGINT) AS row_number",
        """CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN ''
                WHEN p_partkey % 17 = 2 THEN '  '
                WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || chr(9) ELSE p_name END AS title""",
        """CASE p_partkey % 4 WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN NULL
                ELSE ' ' || p_type || ' ' END AS notes_on_outline_before""",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_submissions(table(spark, sf_dir, "part"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names that an even number of parts has."""
    named = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).count()
    return named.where("count % 2 = 0").select("title")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "conversations")
        .selectExpr(
            "conv_id AS book_id",
            "turn AS k",
            "CAST(turn % 5 + 1 AS STRING) AS n",
            "replace(replace(text, chr(10), ' '), '*', '') AS t",
        )
        .selectExpr(
            "book_id",
            "k",
            """CASE book_id % 5
                 WHEN 0 THEN '## Chapter ' || n || ': ' || t
                 WHEN 1 THEN '### Chapter ' || n || ' - ' || t
                 WHEN 2 THEN '## ' || n || '. ' || t
                 WHEN 3 THEN '**Chapter ' || n || ': ' || t || '**'
                 ELSE '## ' || t END || chr(10) || 'about ' || n AS h""",
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("k", "h")))
    return lines.groupBy("book_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["h"]), "\n\n").alias("outline")
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed line by line in every Markdown block form."""
    dressed = """array_join(transform(split(text, '\\n'), (l, i) -> CASE i % 10
        WHEN 0 THEN '# ' || l
        WHEN 1 THEN '## ' || l
        WHEN 2 THEN '- ' || l || '\\n* second\\ndropped'
        WHEN 3 THEN '1. ' || l || '\\n2. second'
        WHEN 4 THEN '> ' || l || '\\ntail'
        WHEN 5 THEN '```python\\n' || l || '\\n```'
        WHEN 6 THEN '### ' || l
        WHEN 7 THEN 'a **b** _c_ ' || l
        WHEN 8 THEN '#### ' || l
        ELSE l END), '\\n\\n')"""
    return documents(spark, sf_dir).selectExpr("doc_id", f"{dressed} AS content")


def markdown_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown documents as chapters, eight to a book."""
    return markdown(spark, sf_dir).selectExpr(
        "doc_id AS id",
        "doc_id div 8 AS book_id",
        "CAST(doc_id % 8 + 1 AS BIGINT) AS chapter_number",
        "CASE WHEN doc_id % 9 = 4 THEN NULL ELSE 'Part ' || CAST(doc_id AS STRING) || ' <&>' END AS title",
        "CASE WHEN doc_id % 10 = 9 THEN NULL ELSE content END AS content",
        "'generated' AS status",
        "'pending' AS notes_status",
    )


def markdown_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id div 8 AS id")
        .distinct()
        .selectExpr(
            "id",
            "'Volume ' || CAST(id AS STRING) || ': tales' AS title",
            "CASE WHEN id % 3 = 0 THEN 'yes' ELSE 'pending' END AS final_review_notes_status",
        )
    )


def notifications_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "user_id AS book_id",
        """CASE event_type WHEN 'view' THEN 'outline_ready' WHEN 'purchase' THEN 'final_draft_ready'
             WHEN 'signup' THEN 'book_completed' WHEN 'error' THEN 'error_pause'
             ELSE 'chapters_generated' END AS event_type""",
        "CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'sent' END AS status",
        "ts AS sent_at",
    )


def wide_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "'Order ' || CAST(o_orderkey AS STRING) AS title",
        """CASE o_orderstatus WHEN 'F' THEN 'no_notes_needed' WHEN 'O' THEN 'yes' ELSE 'pending' END
           AS status_outline_notes""",
        "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) AS created_at",
    )


def wide_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS book_id",
        "CAST(l_linenumber AS BIGINT) AS chapter_number",
        "CASE WHEN l_linestatus = 'O' THEN 'text' END AS content",
        "CASE WHEN l_quantity > 40 THEN 'notes' END AS notes",
        """CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'generated' END
           AS status""",
        "CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'pending' END AS notes_status",
    )


def as_chapter_changes(events: DataFrame) -> DataFrame:
    """A change feed: each event sets the state of one chapter of one book."""
    return events.selectExpr(
        "event_id AS seq",
        "user_id AS book_id",
        "CAST(event_id % 4 + 1 AS BIGINT) AS chapter_number",
        "CASE WHEN event_type <> 'error' THEN 'text ' || CAST(event_id AS STRING) END AS content",
        """CASE event_type WHEN 'view' THEN 'generated' WHEN 'purchase' THEN 'approved'
             WHEN 'signup' THEN 'reviewed' WHEN 'error' THEN 'error' ELSE 'generated' END AS status""",
        """CASE event_type WHEN 'view' THEN 'yes' WHEN 'purchase' THEN 'no_notes_needed'
             ELSE 'pending' END AS notes_status""",
        "ts AS changed_at",
    )


def chapter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chapter_changes(table(spark, sf_dir, "events"))


def as_book_changes(events: DataFrame) -> DataFrame:
    """A change feed: each event sets the state of one book."""
    return events.selectExpr(
        "event_id AS seq",
        "user_id AS book_id",
        "CASE WHEN event_type <> 'error' THEN 'outline ' || CAST(event_id AS STRING) END AS outline",
        "CASE WHEN event_type = 'signup' THEN 'completed' ELSE 'in_progress' END AS book_output_status",
        "CASE WHEN event_type = 'purchase' THEN 'out/' || CAST(event_id AS STRING) END AS output_pdf_path",
    )
