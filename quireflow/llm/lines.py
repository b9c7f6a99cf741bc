"""Removing boilerplate lines by how many sites they stand on.

Every line hash carries a HyperLogLog sketch of its sites, merged by partial
aggregation, so a line that stands on every page is a few bytes per task. Lines
whose estimate lies near the threshold are counted exactly before the decision.

Rules: a null text stays null; blank lines are never removed; a null site counts
as one site of its own; a line repeated on one site has one site however often
it occurs. Rows that are equal in id and text are treated alike. An empty table
gives an empty table. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quireflow.functions.text import let
from quireflow.llm.common import col, documents, fresh, has_word, lines, settle, unit_key

MIN_SITES = 10
# Log2 of a sketch's registers: an error of about 1.04 / sqrt(4096) = 1.6 %.
LG_K = 12
# Estimates within this share of the threshold, some 12 standard errors, are counted exactly.
NEAR = 0.2


def _units(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    # The text is hashed and cut before its lines are rows, which then carry neither.
    row = docs.select(
        F.struct(col(docs, doc_id).alias("i"), F.xxhash64(col(docs, text)).alias("h")).alias("row"),
        F.coalesce(F.concat(F.lit("="), col(docs, site).cast("string")), F.lit("")).alias("site"),
        lines(col(docs, text)).alias("lines"),
    ).select("row", "site", F.posexplode("lines").alias("pos", "line"))
    return row.where(has_word(F.col("line"))).select("row", "site", "pos", unit_key(F.col("line")).alias("key"))


def site_spread(units: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """The keys of ``units`` (key, site) that stand on ``min_sites`` sites or more.

    Sketches decide far from the threshold, exact distinct counts near it.
    """
    estimated = (
        units.groupBy("key")
        .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
        .select("key", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= (1 - near) * min_sites)
    )
    estimated = settle(estimated, "spread")
    sure = estimated.where(F.col("sites") > (1 + near) * min_sites).select("key")
    close = estimated.where(F.col("sites") <= (1 + near) * min_sites).select("key")
    counted = (
        units.join(close, "key", "left_semi")
        .groupBy("key", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count("one").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("key")
    )
    return sure.unionByName(counted)


def drop_boilerplate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` without the lines that stand on ``min_sites`` sites or more.

    ``removed`` names an optional column for the positions of the lines that went (a longer name, if that is taken).
    """
    units = _units(docs, doc_id, text, site)
    spread = settle(site_spread(units.select("key", "site"), min_sites), "boilerplate")
    row, hits, named = fresh(docs, "hit_row", "hit_lines", removed or "removed")
    found = units.join(spread, "key", "left_semi").groupBy(F.col("row").alias(row)).agg(
        F.sort_array(F.collect_set("pos")).alias(hits)
    )
    same = (F.col(row)["i"].eqNullSafe(col(docs, doc_id))) & (F.col(row)["h"] == F.xxhash64(col(docs, text)))
    # Places that stay, by a hash of those that go: in proportion to the lines, however many they are.
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(hits))
    kept = F.array_join(let(lines(col(docs, text)), lambda ls: F.transform(stay(ls), lambda i: F.get(ls, i))), "\n")
    out = docs.join(found, same, "left")
    columns = [
        F.when(F.col(hits).isNull(), col(docs, c)).otherwise(kept).alias(c) if c == text else col(docs, c)
        for c in docs.columns
    ]
    if removed:
        columns.append(F.coalesce(F.col(hits), F.array().cast("array<int>")).alias(named))
    return out.select(columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's line counts and the digest of what stays."""
    out = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"), removed="removed_lines")
    kept: Column = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.size("removed_lines") + F.size(F.filter(lines(F.col("text")), has_word))
         ).cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH u AS (
  SELECT doc_id, source, line, i,
    md5(regexp_replace(lower(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), '[\x20\x09-\x0D]+', ' ', 'g')) AS k,
    trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> '' AS word
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
s AS (SELECT k FROM u WHERE word GROUP BY k HAVING count(DISTINCT coalesce('=' || source, '')) >= 10),
f AS (SELECT u.*, word AND k IN (SELECT k FROM s) AS gone FROM u)
SELECT doc_id, CAST(count(*) FILTER (word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
