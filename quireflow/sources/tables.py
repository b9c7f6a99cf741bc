"""Reading submissions and tables, appending rows, writing outputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quireflow.functions.text import has
from quireflow.schemas import DEFAULTS, conform, table_schema
from quireflow.session import settle

SUBMISSION_REQUIRED = ("title",)
SUBMISSION_OPTIONAL = ("notes_on_outline_before",)


class MissingColumn(ValueError):
    """A submission table lacks a required column."""


def _by_kind(spark: SparkSession, path: str) -> list[tuple[bool, list[str]]]:
    """The files of sheets in two lists: without cells that go over lines, and (True) with some.

    In a file with such a cell some line has an odd number of quotes; a quote inside
    a quoted cell is written as two, so others count even.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    told = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_or(quotes % 2 == 1).alias("broken"))
    files = sorted((unquote(r["file"]), r["broken"]) for r in told.collect())
    kinds = [(kind, [f for f, broken in files if broken == kind]) for kind in (False, True)]
    return [(kind, own) for kind, own in kinds if own]


def _source_headers(columns: Sequence[str]) -> list[str]:
    """Lowercased, trimmed headers, with the reader's duplicate marks removed.

    A CSV header that repeats comes back as the name followed by its position
    (``title0``, ``title3``); such a pair is folded to the shared name.
    """
    names = [c.lower() for c in columns]
    bases = [n[: -len(str(i))] if n.endswith(str(i)) else None for i, n in enumerate(names)]
    repeated = {b for b in bases if b is not None and bases.count(b) > 1}
    return [(b if b in repeated else n).strip() for n, b in zip(names, bases)]


def normalize_submissions(raw: DataFrame, row_number: str = "row_number") -> DataFrame:
    """Known submission columns under their normal names; the rest is dropped.

    Of repeated headers the last one counts. The check of required columns
    looks at names only, so it fails before any job starts.
    """
    headers = _source_headers(raw.columns)
    at = {name: i for i, name in enumerate(headers)}
    for name in (*SUBMISSION_REQUIRED, row_number):
        if name not in at:
            raise MissingColumn(f"Missing required column: {name}")
    flat = raw.toDF(*[f"c{i}" for i in range(len(headers))])
    picked = [F.col(f"c{at[row_number]}").cast("bigint").alias("row_number")]
    picked += [F.col(f"c{at[n]}").cast("string").alias(n) for n in SUBMISSION_REQUIRED]
    picked += [
        (F.col(f"c{at[n]}").cast("string") if n in at else F.lit("")).alias(n) for n in SUBMISSION_OPTIONAL
    ]
    return flat.select(picked)


def _numbered(raw: DataFrame, name: str) -> DataFrame:
    """Adds the number of each row in its file, the first row below the header being 2.

    Rows are numbered inside the file's splits; the counts of the splits before,
    one row each, give where a split starts. No task sorts or holds a file.
    """
    at = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_sheet"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = at.groupBy("_sheet", "_from").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_sheet").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_sheet", "_from", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_id") - F.col("_first") + 2
    return at.join(starts, ["_sheet", "_from"]).select(*raw.columns, number.alias(name))


def read_submissions(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    row_number: str = "row_number",
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a header-first table of submissions from CSV, JSON or Parquet.

    A sheet needs a title column only. Where it has no column of row numbers,
    they follow from each row's place in its file. CSV sheets are split, but those with
    cells that go over lines are read a file per task; a pass over the lines finds out
    which. ``multi_line`` states it of all files beforehand.
    Files whose headers disagree with the first one are refused. An empty CSV
    cell is NULL.
    """
    if fmt != "csv":
        raw = spark.read.format(fmt).load(path)
        return normalize_submissions(raw if row_number in _source_headers(raw.columns) else _numbered(raw, row_number), row_number)
    parts = [(multi_line, path)] if multi_line is not None else _by_kind(spark, path)
    reader = spark.read.options(header=True, escape='"')
    # Of one file at least, for the header, also where there is none with rows.
    schema = reader.option("multiLine", any(kind for kind, _ in parts)).csv(path).schema
    headers = _source_headers(schema.names)
    # The reader renames repeated headers, so it cannot compare them.
    checked = {"enforceSchema": len(set(headers)) < len(headers)}
    read = [spark.read.options(header=True, escape='"', multiLine=kind, **checked).schema(schema).csv(own) for kind, own in parts or [(False, path)]]
    if row_number not in headers:
        read = [_numbered(raw, row_number) for raw in read]
    return normalize_submissions(reduce(DataFrame.unionByName, read), row_number)


def scan(
    spark: SparkSession, path: str, table: str, id_type: T.DataType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Typed scan of one table; columns absent from the files are NULL."""
    return conform(spark.read.format(fmt).load(path), table, id_type)


def row_id(id_type: T.DataType, **key: Column) -> Column:
    """Deterministic id: the same key gives the same id on every run.

    The key is hashed as JSON, so parts that hold separators or are NULL stay
    apart. Text ids are SHA-256; numeric ones are 64-bit hashes, whose clashes
    ``key_violations`` reports.
    """
    spelled = F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in key.items()]), {"ignoreNullFields": "false"})
    return F.sha2(spelled, 256) if isinstance(id_type, T.StringType) else F.xxhash64(spelled).cast(id_type)


def append_with_defaults(
    rows: DataFrame,
    table: str,
    id_key: Sequence[str],
    id_type: T.DataType | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """New rows ready to append: ids filled from a key, defaults for NULLs.

    ``as_of`` stamps the rows where the table has times of creation and change.
    """
    full = conform(rows, table, id_type)
    made = row_id(full.schema["id"].dataType, **{k: F.col(k) for k in id_key})
    full = full.withColumn("id", F.coalesce("id", made))
    for name, value in DEFAULTS[table].items():
        full = full.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    for name in ("created_at", "updated_at"):
        if as_of is not None and name in full.columns:
            full = full.withColumn(name, F.coalesce(F.col(name), as_of.cast(full.schema[name].dataType)))
    return full


def append(rows: DataFrame, path: str, table: str) -> None:
    rows.select(table_schema(table).names).write.mode("append").parquet(path)


def store_chapters(chapters: DataFrame, path: str) -> None:
    """Write chapters with a presence flag beside the text.

    ``scan_stored`` hands the flag on and ``written`` uses it, so gates and
    rollups prune the text from their scans.
    """
    flagged = chapters.drop("has_content").withColumn("has_content", has(F.col("content")))
    flagged.write.mode("overwrite").parquet(path)


def scan_stored(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Typed scan of stored chapters, flag included."""
    raw = spark.read.parquet(path)
    return conform(raw, "chapters", id_type, extra=("has_content",))


# The columns that a chapter's state does without.
TEXTS = ("content", "summary")


def store_apart(chapters: DataFrame, path: str) -> None:
    """Write chapters as two tables: a narrow state, patched often, and texts by id.

    The state keeps the presence flag, so gates, rollups and status patches run
    on ``scan_state`` and move no text.
    """
    state = chapters.drop("has_content").withColumn("has_content", has(F.col("content"))).drop(*TEXTS)
    state.write.mode("overwrite").parquet(f"{path}/state")
    chapters.select("id", *TEXTS).write.mode("overwrite").parquet(f"{path}/texts")


def scan_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of chapters stored apart; texts are not read."""
    return spark.read.parquet(f"{path}/state")


def with_texts(state: DataFrame, path: str) -> DataFrame:
    """State rows with their texts, for the steps that need them."""
    return state.join(state.sparkSession.read.parquet(f"{path}/texts"), "id", "left")


def save_by_book(rows: DataFrame, name: str, path: str, buckets: int, key: str = "book_id") -> None:
    """Save a table bucketed and sorted by book.

    Tables saved with the same number of buckets meet without a shuffle in
    every per-book join and rollup. Use it for tables read many times; a book
    with a large share of all rows makes its bucket large, and such corpora
    are better left unbucketed, where adaptive execution can split the book.
    """
    order = [key] + [c for c in ("chapter_number",) if c in rows.columns]
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(*order).saveAsTable(name)


def write_text_books(
    spark: SparkSession, texts: DataFrame, books: DataFrame, path: str, files: bool = False
) -> DataFrame:
    """Write compiled texts; returns (id, output_txt_path) to patch books with.

    ``texts`` are the ordered rows of ``compile_text``. The table under
    ``<path>/table`` is the output. With ``files`` the rows are also written
    as plain text, one directory per book: they are range-sorted by
    (book, section, chapter), so a very long book spreads over several tasks and
    its files still read in order. Sorting reads the written table back, so
    the rendering is not run twice for the sampling.
    """
    table = f"{path}/table"
    texts.write.mode("overwrite").parquet(table)
    written = spark.read.parquet(table)
    if files:
        order = ["book_id", "section", "chapter_number"]
        (
            written.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select("book_id", "text")
            .write.mode("overwrite")
            .partitionBy("book_id")
            .text(f"{path}/files")
        )
    done = written.select(F.col("book_id").alias("id")).distinct()
    where = F.lit(f"{path}/files/book_id=") if files else F.lit(f"{table}#book_id=")
    return done.select("id", F.concat(where, F.col("id").cast("string")).alias("output_txt_path"))


# Bytes of text in a packed file, as aimed at.
PACKED = 64 << 20


def write_packed_books(spark: SparkSession, texts: DataFrame, path: str, size: int = PACKED) -> DataFrame:
    """Write compiled texts into few files, and where each book lies in them; returns (id, output_txt_path).

    The rows of ``compile_text`` are dealt by ranges of (book, section, chapter), as many as their bytes ask
    for; each range is one plain file, in order. ``<path>/manifest`` has the file, offset and length of
    each piece of a book, in bytes; a book is one piece, but for those that lie across ranges.
    ``read_packed_books`` reads through it.
    """
    order = ["book_id", "section", "chapter_number"]
    n = (F.octet_length("text") + 1).cast("bigint").alias("n")
    total = texts.agg(F.sum(n)).first()[0] or 0
    dealt = texts.select(*order, "text").repartitionByRange(max(1, -(-total // size)), *order)
    table = settle(dealt.withColumn("part", F.spark_partition_id()), "packed")
    rows = table.repartition("part").sortWithinPartitions("part", *order)
    rows.select("part", "text").write.mode("overwrite").partitionBy("part").text(f"{path}/files")
    files = spark.read.format("binaryFile").load(f"{path}/files").select(F.col("part").cast("int").alias("part"), F.col("path").alias("file"))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = table.select("part", *order, n).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = placed.groupBy("book_id", "part").agg(F.min("at").alias("offset"), F.sum("n").alias("length"))
    manifest = pieces.join(files, "part").select("book_id", F.col("part").alias("piece"), "file", "offset", "length")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    done = spark.read.parquet(f"{path}/manifest").select(F.col("book_id").alias("id")).distinct()
    return done.select("id", F.concat(F.lit(f"{path}/manifest#book_id="), F.col("id").cast("string")).alias("output_txt_path"))


def read_packed_books(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(book_id, piece, text) of packed books, all or those of ``wanted`` (book_id); pieces in order make a book."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if wanted is not None:
        manifest = manifest.join(wanted.select("book_id").distinct(), "book_id", "left_semi")
    files = spark.read.format("binaryFile").load(f"{path}/files").select(F.col("path").alias("file"), "content")
    cut = F.expr("substring(content, CAST(offset + 1 AS INT), CAST(length AS INT))")
    return manifest.join(files, "file").select("book_id", "piece", cut.cast("string").alias("text"))
