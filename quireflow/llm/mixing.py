"""Mixing sources to target weights by systematic sampling.

Every source has a weight and a size, the words of its documents. The targets share a
given part of all sizes by weight; none is above ``CAP`` times its source's size, and
what is left over is shared again by weight among the others, until none is above.

A document's expected copies are its source's target over its source's size. In
the order of size, the expected copies are summed up within each source, one
random offset is added, and a document is taken once for each whole number that
the sum crosses on it. So each is taken floor or ceil of its expectation,
with the right chance, and as neighbours are of like size, the words taken from
a source are off its target by no more than its largest document.

Sums run over the whole table without a window over a source: rows are dealt by ranges
of (source, size, id) and written; each range adds up its own, and what came before a
range follows from one row per range and source. Expectations are whole numbers of
2^-``BITS``, so sums do not depend on the ranges.

Rules: a null text has no words. A null source is a source of its own, the last; an
empty one is a source. Null ids and repeated rows are documents, which come in the order of their ids, nulls
first; rows alike in source, size and id may be taken in either's place. Documents without words are
taken by the same rule and add nothing; a source without words has target 0 and is not taken. The offset
follows from the seed and the source, so reruns agree. An empty table gives an empty
table. Extra columns pass through ``mixed``, under their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quireflow.llm.common import col, documents, fresh, settle

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
CAP = 2
SEED = 13
BITS = 31
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words of a text, as a long; of a null text, 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def offset(source: Column, seed: int = SEED) -> Column:
    """A source's random offset, of ``BITS`` bits from a digest; a null source has its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), 32 - BITS)


def crossed(rows: Column, expected: Column, start: Column) -> Column:
    """The whole part of start + rows * expected, both in 2^-``BITS``; in parts that fit a long."""
    upper, lower = F.shiftright(rows, BITS), rows.bitwiseAND(F.lit((1 << BITS) - 1))
    whole, rest = F.shiftright(expected, BITS), expected.bitwiseAND(F.lit((1 << BITS) - 1))
    return rows * whole + upper * rest + F.shiftright(start + lower * rest, BITS)


def _ranged(rows: DataFrame, name: str, *keys: Column) -> DataFrame:
    """``rows`` in ranges of their keys, with the number of the range as ``part``; written, so that it stays."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(dealt.withColumn("part", F.spark_partition_id()), name)


def _before(ranged: DataFrame, group: Sequence[str], order: Column, told: DataFrame | None = None) -> DataFrame:
    """Adds ``upto``, a row's number within its group, in the order of ranges and then of ``order``.

    The rows of a range meet in a task, those of a group do not: a window runs over a
    range's rows, and another over one row for each range. ``told`` has one row per
    group, whose columns go to the ranges' rows first and so to the group's without
    gathering it.
    """
    each = ranged.groupBy("part", *group).agg(F.count("*").alias("own"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("start", F.coalesce(F.sum("own").over(earlier), F.lit(0))).drop("own")
    if told is not None:
        named = told.select(*[F.col(g).alias("t_" + g) for g in group], *[c for c in told.columns if c not in group])
        starts = starts.join(named, _alike(group, "", "t_")).drop(*["t_" + g for g in group])
    keys = ["part", *group]
    starts = starts.select(*[F.col(k).alias("s_" + k) for k in keys], *[c for c in starts.columns if c not in keys])
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint")
    summed = ranged.withColumn("within", within).join(starts, _alike(keys, "", "s_"))
    return summed.withColumn("upto", F.col("start") + F.col("within")).drop("start", "within", *["s_" + k for k in keys])


def _alike(names: Sequence[str], one: str, two: str) -> Column:
    """Equality of columns under two prefixes; nulls are equal."""
    same = F.lit(True)
    for n in names:
        same = same & F.col(one + n).eqNullSafe(F.col(two + n))
    return same


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) of ``sizes`` (source, source_size), one row per source.

    Sources are numbered over ranges, so there may be very many. Each round shares
    what is left among the sources below their cap; only sums come to the driver.
    """
    ranged = _ranged(sizes, "sources", F.asc_nulls_last("source"))
    place = F.struct(F.col("source").isNull().alias("last"), "source")
    numbered = _before(ranged, [], place)
    k = F.pmod(F.col("upto") - 1, F.lit(len(weights))).cast("int")
    weighed = numbered.select("source", "source_size", F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), k).alias("weight"))
    weighed = settle(weighed, "weights")
    limit = F.col("source_size") * cap
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    capped, level = -1, None
    while True:
        # A source is at its cap once its share of what the others leave is no less.
        full = F.lit(False) if level is None else limit <= F.col("weight") * level
        n, taken, left = weighed.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not left:
            break
        capped, level = n, float(share * whole - taken) / left
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level)) if level is not None else F.lit(0.0)
    return weighed.withColumn("target", target)


def planned(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    cap: int = CAP,
    seed: int = SEED,
    row: Column | None = None,
) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) of every document; texts are only counted.

    ``row`` is an expression that tells rows apart, if they are to be found again.
    """
    sized = docs.select(
        (F.lit(None).cast("bigint") if row is None else row).alias("row"),
        col(docs, doc_id).alias("doc_id"),
        col(docs, source).cast("string").alias("source"),
        n_words(col(docs, text)).alias("size"),
        # Spreads rows that are alike over ranges; they may stand in for each other.
        F.monotonically_increasing_id().alias("nth"),
    )
    # Written first, so that texts are counted once and not again for the bounds of ranges.
    sized = settle(sized, "sized")
    ranged = _ranged(sized, "sizes", F.asc_nulls_last("source"), F.col("size"), F.asc_nulls_first("doc_id"), F.col("nth"))
    sizes = ranged.groupBy("source").agg(F.sum("size").alias("source_size"))
    told = settle(targets(sizes, weights, share, cap), "targets")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << BITS))).otherwise(0).cast("bigint")
    told = told.select("source", "source_size", "target", expected.alias("expected"), offset(F.col("source"), seed).alias("offset"))
    counted = _before(ranged, ["source"], F.struct("size", "doc_id", "nth"), told)
    reached = lambda k: crossed(k, F.col("expected"), F.col("offset"))
    copies = reached(F.col("upto")) - reached(F.col("upto") - 1)
    return counted.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, copy: str = "copy", **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, with the number of the copy from 1."""
    row, of, n, copy = fresh(docs, "row", "of", "copies", copy)
    named = settle(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    plan = planned(named, row=F.col(row), **options).select(F.col("row").alias(of), F.col("copies").alias(n)).where(F.col(n) > 0)
    out = named.join(plan, F.col(row) == F.col(of)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return out.select(*[col(docs, c) for c in docs.columns], copy)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its source's target, and the words that the mix takes of it."""
    plan = planned(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
-- Sources by how soon they reach their cap; those before one are at theirs when it is reached.
o AS (SELECT *,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER (ORDER BY 2.0 * source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    sum(source_size) OVER () AS whole FROM w),
l AS (SELECT max(CAST(1.5 * whole - taken AS DOUBLE) / open) FILTER (2 * source_size > weight * (CAST(1.5 * whole - taken AS DOUBLE) / open)) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(2 * source_size AS DOUBLE), weight * level) END AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 2147483648) AS HUGEINT) ELSE 0 END AS expected,
    CAST('0x' || substr(md5('13:' || coalesce('=' || source, '')), 1, 8) AS HUGEINT) // 2 AS start FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS nth FROM d)
SELECT doc_id, size, source_size, target,
  CAST((((start + nth * expected) // 2147483648) - ((start + (nth - 1) * expected) // 2147483648)) * size AS BIGINT) AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
"""
