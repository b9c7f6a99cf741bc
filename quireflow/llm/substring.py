"""Removing repeated lines or paragraphs, of which the earliest ranked occurrence stays.

Units are normalised (lower case, white space trimmed and folded) and hashed;
digests are grouped over the whole corpus. Partial aggregation leaves one row of
a common line per task, and only digests that occur again are joined back.

Rules: occurrences are ranked by (rank column, document id, position), nulls
first. Blank units stay. A run of repeated units goes if it has ``min_words``
words in all, so that a long passage goes whole, its short lines included, and a
short line that two documents share by chance stays. A blank unit ends a run, as in
the reference SQL; with ``over_blanks`` runs go on over blank units. A null text stays null.
Rows equal in id and text count as one document. An empty table gives an empty
table. Columns of any name pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quireflow.llm.common import BLANK, col, documents, fresh, has_word, mapped, settle, unit_key

MIN_WORDS = 8
# The separators of the two kinds of unit; a paragraph ends at an empty line.
UNITS = {"line": "\n", "paragraph": "\n\n"}
SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("unit", "start", "length")])


def _parts(text: Column, unit: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), UNITS[unit])


def repeated_units(
    docs: DataFrame, doc_id: str, text: str, rank: str | None, unit: str, min_words: int, over_blanks: bool = False
) -> DataFrame:
    """Rows (row, pos) of the units to remove; ``row`` is (id, hash of the text)."""
    parts, nth = _parts(col(docs, text), unit), ["nth"] if over_blanks else []
    if over_blanks:
        numbered = F.transform(F.col("parts"), lambda u, i: F.struct(i.alias("pos"), u.alias("unit")))
        exploded = F.posexplode(F.filter(numbered, lambda x: has_word(x["unit"]))).alias("nth", "x")
    else:
        exploded = F.posexplode("parts").alias("pos", "unit")
    # The text is hashed and cut before its units are rows, which then carry neither.
    whole = docs.select(
        F.struct(col(docs, doc_id).alias("i"), F.xxhash64(col(docs, text)).alias("h")).alias("row"),
        (col(docs, rank) if rank else F.lit(0)).alias("rank"),
        parts.alias("parts"),
    )
    units = (
        whole.select("row", "rank", exploded)
        .select("row", "rank", *(["nth", "x.pos", "x.unit"] if over_blanks else ["pos", "unit"]))
        .where(has_word(F.col("unit")))
        .select(
            "row",
            F.struct("rank", "row", "pos").alias("place"),
            "pos",
            *nth,
            unit_key(F.col("unit")).alias("key"),
            F.size(F.split(F.btrim("unit", F.lit(" \t\n\x0b\x0c\r")), BLANK + "+")).alias("n_words"),
        )
    )
    firsts = (
        units.groupBy("key")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("key", "first")
    )
    again = units.join(firsts, "key").where(~F.col("place").eqNullSafe(F.col("first")))
    again = again.groupBy("row", "pos").agg(F.first("n_words").alias("n_words"), *[F.first(c).alias(c) for c in nth])
    by_row = Window.partitionBy("row")
    runs = again.withColumn("run", F.col("nth" if over_blanks else "pos") - F.row_number().over(by_row.orderBy("pos")))
    total = F.sum("n_words").over(Window.partitionBy("row", "run"))
    return runs.withColumn("run_words", total).where(F.col("run_words") >= min_words).select("row", "pos")


def drop_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rank: str | None = None,
    unit: str = "line",
    min_words: int = MIN_WORDS,
    spans: str = "removed_spans",
    over_blanks: bool = False,
) -> DataFrame:
    """``docs`` without repeated units, and their places in the original text.

    ``spans`` (or a longer name, if that is taken) holds an array of (unit, start, length), in code points of the
    original text. Both come from one pass over a text's units, however many there are.
    """
    row, gone, spans = fresh(docs, "gone_row", "gone_units", spans)
    repeated = settle(repeated_units(docs, doc_id, text, rank, unit, min_words, over_blanks), "repeats")
    found = repeated.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    same = (F.col(row)["i"].eqNullSafe(col(docs, doc_id))) & (F.col(row)["h"] == F.xxhash64(col(docs, text)))
    told = docs.join(found, same, "left").select(*[col(docs, c) for c in docs.columns], gone)
    at, last, sep = docs.columns.index(text), len(docs.columns), UNITS[unit]
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(SPAN))])

    def run(batches):
        for batch in batches:
            lists = batch.column(last)
            hit = lists.is_valid()
            pairs = zip(batch.column(at).filter(hit).to_pylist(), lists.filter(hit).to_pylist())
            cut = [_without(t, positions, sep) for t, positions in pairs]
            texts = pa.array([t for t, _ in cut], batch.column(at).type)
            columns = list(batch.columns[:last])
            columns[at] = pa.compute.replace_with_mask(batch.column(at), hit, texts)
            places = iter([p for _, p in cut])
            rows = [next(places) if h else [] for h in hit.to_pylist()]
            kind = pa.list_(pa.struct([(c, pa.int32()) for c in SPAN.names]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*batch.schema.names[:last], spans])

    return mapped(told, run, schema)


def _without(text: str, positions: list[int], sep: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without these units, in rising order, and their (unit, start, length); one pass over its units."""
    kept, places, start, due = [], [], 0, iter([*positions, -1])
    gone = next(due)
    for k, part in enumerate(text.split(sep)):
        if k == gone:
            places.append((k, start, len(part)))
            gone = next(due)
        else:
            kept.append(part)
        start += len(part) + len(sep)
    return sep.join(kept), places


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's removed lines, their places and the digest of what stays."""
    out = drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("removed_spans")
    place = F.transform(spans, lambda s: F.concat_ws(":", s["unit"], s["start"], s["length"]))
    return out.select(
        "doc_id",
        F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("removed_chars"),
        F.sha2(F.array_join(place, ","), 256).alias("spans_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH u AS (
  SELECT doc_id, line, i, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS t,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
k AS (SELECT *, md5(regexp_replace(lower(t), '[\x20\x09-\x0D]+', ' ', 'g')) AS key,
        len(string_split_regex(t, '[\x20\x09-\x0D]+')) AS n_words FROM u WHERE t <> ''),
again AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run
          FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
gone AS (SELECT doc_id, i FROM (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS n FROM again) WHERE n >= 8),
f AS (SELECT u.*, g.i IS NOT NULL AS g FROM u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i)
SELECT doc_id, CAST(count(*) FILTER (g) AS BIGINT) AS n_removed, CAST(coalesce(sum(length(line)) FILTER (g), 0) AS BIGINT) AS removed_chars,
  sha256(coalesce(string_agg(i || ':' || CAST(start AS BIGINT) || ':' || length(line), ',' ORDER BY i) FILTER (g), '')) AS spans_sha256,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT g), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
