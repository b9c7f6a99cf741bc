"""Mining hard negatives: integer scores by Strassen's multiplication, kept in heaps that merge.

Anchors and candidates are dealt into units, each a block of ``ANCHORS`` anchors and one
of ``CANDIDATES`` candidates, so that every anchor meets every candidate in exactly
one unit. A task holds the anchors of a unit and takes its candidates tile by
tile: a tile's scores are one product of whole numbers, by Strassen's seven
products of halves, recursively, with zeros around what does not halve evenly.
Nothing is rounded, and sums that overflow on the way are right again at the end, as
all is modulo 2^64.

There are two passes over the tiles. The first keeps, for each anchor, a heap of
the best candidates of its own label: its positives. The second keeps, for each
anchor and positive, a heap of the best candidates of other labels whose score
lies in the positive's window. A unit emits its heaps, a few rows whatever its
number of candidates, and heaps of one owner merge by taking the best of all.

Rules: rows with a null label, a null vector or a component that is null or not finite take no part,
nor do those with one of ``LARGEST`` or more on the grid, whose scores might not fit 64 bits. Vectors of
different lengths meet as if the shorter ended in zeros. Ids keep their type; a
null id is a candidate and comes last among equals. Rows are told apart by themselves, not by their id:
a row that repeats an anchor's id is another row to it, and each of two anchors
of one id is one. Without anchors, positives or rows in a window there are no rows of them. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quireflow.llm.common import col, settle

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
# The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100
LARGEST = 1 << 25
ANCHORS, CANDIDATES, TILE = 4096, 4096, 512
# Products with a side of at most this are not halved again.
LEAF = 16
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit whole numbers, exact modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _plain(a, b)
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product without recursion: by doubles where these hold every sum exactly."""
    if a.size and b.size and (float(np.abs(a).max()) + 1) * (float(np.abs(b).max()) + 1) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class Heaps:
    """For each of ``n`` owners its best ``k`` by (score, falling; place among candidates)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.owner, self.score, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, LEAST)

    def offer(self, owners: np.ndarray, scores: np.ndarray, allowed: np.ndarray, start: int) -> None:
        """Takes what is allowed of ``scores`` (owners x a tile), whose columns are the places from ``start`` on."""
        allowed = allowed & (scores >= self.floor[owners][:, None])
        if scores.shape[1] > self.k:
            # What is below the tile's own k-th best of an owner is in no heap.
            kth = np.partition(np.where(allowed, scores, LEAST), -self.k, axis=1)[:, -self.k]
            allowed &= scores >= kth[:, None]
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        owner = np.concatenate([self.owner, owners[row]])
        score = np.concatenate([self.score, scores[row, column]])
        place = np.concatenate([self.place, column + start])
        order = np.lexsort((place, ~score, owner))  # ~score falls as score grows, without overflow
        owner, score, place = owner[order], score[order], place[order]
        first = np.searchsorted(owner, owner)
        best = np.arange(len(owner)) - first < self.k
        self.owner, self.score, self.place = owner[best], score[best], place[best]
        full = np.flatnonzero(np.arange(len(owner)) - first == self.k - 1)
        self.floor[owner[full]] = score[full]


def _matrix(lists, width: int) -> np.ndarray:
    """Lists as a matrix, with zeros after the shorter ones."""
    sizes = np.asarray(lists.value_lengths())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _units(batches):
    """The batches of each unit, one unit after the other; rows come in order of unit."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for at, stop in zip(cuts, cuts[1:]):
            if held and tuple(keys[at]) != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = tuple(keys[at])
            held.append(batch.slice(at, stop - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(table, name: str):
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _mined(keep: int, allowed: Callable):
    """A task over units: tiles' scores go to heaps, which are emitted by owner (unit row, slot)."""

    def run(batches):
        for unit in _units(batches):
            anchors = unit.filter(pa.compute.equal(unit.column("anchor"), pa.scalar(True)))
            others = unit.filter(pa.compute.equal(unit.column("anchor"), pa.scalar(False)))
            if not anchors.num_rows or not others.num_rows:
                continue
            width = int(max(pa.compute.max(pa.compute.list_value_length(t.column("x"))).as_py() for t in (anchors, others)))
            a = _matrix(_flat(anchors, "x"), width)
            rows, slots = allowed(anchors)
            heaps = Heaps(len(rows), keep)
            for at in range(0, others.num_rows, TILE):
                tile = others.slice(at, TILE)
                scores = strassen(a, np.ascontiguousarray(_matrix(_flat(tile, "x"), width).T))
                for owners, of, mask in slots(scores, tile):
                    heaps.offer(owners, scores[of], mask, at)
            names = _flat(others, "id").take(pa.array(heaps.place))
            at = rows[heaps.owner]
            columns = [_flat(anchors, "uid").take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)), names, pa.array(heaps.score)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "slot", "other_id", "score"])

    return run


def _labels(table) -> np.ndarray:
    return _flat(table, "label").to_numpy()


def _same_label(anchors):
    """An anchor is one owner; other rows of its label are allowed."""
    n, own, uids = anchors.num_rows, _labels(anchors), _flat(anchors, "uid").to_numpy()
    rows = np.stack([np.arange(n), np.zeros(n, np.int64)], 1)

    def slots(scores, tile):
        same = (own[:, None] == _labels(tile)) & (uids[:, None] != _flat(tile, "uid").to_numpy())
        yield np.arange(n), slice(None), same

    return rows, slots


def _in_window(low: int, high: int):
    def allowed(anchors):
        """An anchor's every positive is an owner; rows of other labels in its window are allowed."""
        lists, own = _flat(anchors, "positives").to_pylist(), _labels(anchors)
        rows = np.array([(i, j) for i, ps in enumerate(lists) for j in range(len(ps))], np.int64).reshape(-1, 2)
        # Bounds in whole numbers: low*p <= 100*s <= high*p.
        least = np.array([-(-low * p // 100) for ps in lists for p in ps], np.int64)
        most = np.array([high * p // 100 for ps in lists for p in ps], np.int64)

        def slots(scores, tile):
            differ = own[:, None] != _labels(tile)
            for j in range(rows[:, 1].max(initial=-1) + 1):
                owners = np.flatnonzero(rows[:, 1] == j)
                of = rows[owners, 0]
                s = scores[of]
                yield owners, of, differ[of] & (s >= least[owners, None]) & (s <= most[owners, None])

        return rows, slots

    return allowed


def _dealt(taken: DataFrame, anchors: DataFrame, n_anchors: int, n: int) -> DataFrame:
    """Anchors and candidates by unit (block of anchors, block of candidates), candidates in order of id."""
    blocks, groups = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n // CANDIDATES))
    part = lambda k: F.pmod(F.xxhash64("uid"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = anchors.select(part(blocks).alias("i"), every(groups).alias("j"), F.lit(True).alias("anchor"), "uid", "id", "label", "x", "positives")
    c = taken.select(
        every(blocks).alias("i"), part(groups).alias("j"), F.lit(False).alias("anchor"), "uid", "id", "label", "x",
        F.lit(None).cast("array<bigint>").alias("positives"),
    )
    both = a.unionByName(c).repartition("i", "j")
    return both.sortWithinPartitions("i", "j", F.desc("anchor"), F.asc_nulls_last("id"), "uid")


def _merged(heaps: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` of each owner's heaps, with their rank; an owner has ``keep`` rows a unit at most."""
    best = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells which of ``rows`` are anchors. Labels are whole numbers. A
    negative's score s and its positive's p satisfy low*p <= 100*s <= high*p.
    """
    doubles = col(rows, vector).cast("array<double>")
    real = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    taken = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        col(rows, vec_id).alias("id"),
        col(rows, label).cast("bigint").alias("label"),
        F.when(real, F.transform(doubles, lambda c: F.floor(c * scale))).alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    taken = settle(taken.where(F.col("label").isNotNull() & F.col("x").isNotNull()), "candidates")
    n, n_anchors = taken.agg(F.count("*"), F.count_if("is_anchor")).first()
    chosen = taken.where("is_anchor").drop("is_anchor")
    kind = f"uid bigint, slot int, other_id {taken.schema['id'].dataType.simpleString()}, score bigint"

    first = _dealt(taken, chosen.withColumn("positives", F.lit(None).cast("array<bigint>")), n_anchors, n)
    found = settle(_merged(first.mapInArrow(_mined(positives, _same_label), kind), positives), "positives")
    lists = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    owners = chosen.join(lists.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of")).select(
        "uid", "id", "label", "x", F.col("p.score").alias("positives")
    )
    second = _dealt(taken, owners, n_anchors, n)
    mined = _merged(second.mapInArrow(_mined(negatives, _in_window(low, high)), kind), negatives)

    names = chosen.select(F.col("uid").alias("a_uid"), F.col("id").alias("anchor_id"))
    best = found.select(
        F.col("uid").alias("p_uid"), F.col("rank").alias("positive_rank"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    out = mined.join(best, (F.col("uid") == F.col("p_uid")) & (F.col("slot") == F.col("positive_rank") - 1))
    return out.join(names, F.col("uid") == F.col("a_uid")).select(
        "anchor_id", "positive_id", "positive_rank", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (
  SELECT a.row AS arow, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arow ORDER BY score DESC, other_id) AS pr FROM s WHERE same) WHERE pr <= 5),
w AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.arow, p.pr ORDER BY n.score DESC, n.other_id) AS rank
  FROM p JOIN s n ON n.arow = p.arow AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
"""
