"""Whitening of embeddings by a weighted covariance over distinct vectors.

Vectors are put on a grid of whole numbers, so that equal ones are equal exactly
and sums are exact. Identical vectors are grouped first, which partial
aggregation does before anything is shuffled, and a group is a vector with a
weight: its count, or one. From here on work is done once per distinct vector:

1. each task sums its vectors by weight, in two halves of a number, so no sum overflows;
2. vectors are centred by the exact mean, and each task multiplies its own by their
   weighted selves (one product of matrices per batch); the tasks' matrices are
   added on the executors, row by row, and one matrix of dimension x dimension
   comes to the driver, whatever the number of vectors;
3. the eigenvectors with the greatest eigenvalues whiten each distinct vector, which is
   checked by the covariance of what came out, taken the same way;
4. results are joined back to the rows by vector. Vectors with more than one in
   ``SHARE`` of all rows, of which there are fewer than ``SHARE``, are broadcast; every
   other one is a small part of the rows, so no task gathers a hot one.

Rules: a row whose vector is null, or holds a null, a NaN, an infinity or an
entry that is beyond ``LARGEST`` in size on the grid, is left out, and so is one whose
vector has another length than most have (of lengths equally common, the
longest). Null ids and repeated rows are rows. A component whose eigenvalue is zero within rounding
cannot be divided by: its value is null. Dimensions fewer than the components asked for give as many
as there are. A deviation is exact, in 38 digits, and null beyond these. An empty table gives an empty
table. Other columns pass through, and new ones get names that no column has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quireflow.llm.common import col, fresh, settle

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Whole numbers up to here are exact as doubles, and so are sums of their halves.
LARGEST = 1 << 50
HALF = 1 << 25
SHARE = 1000
# Rows of a batch that are multiplied at once.
ROWS = 4096


def on_grid(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector in whole numbers, floor(scale * c) + shift; null if some entry has none."""
    bound = (LARGEST - abs(shift)) / scale
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound)
    doubles = vector.cast("array<double>")
    whole = F.transform(doubles, lambda c: F.floor(c * scale) + shift)
    return F.when(vector.isNotNull() & F.forall(doubles, real), whole)


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches):
    """(matrix, weights) of at most ``ROWS`` rows each, of batches (vector, weight)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield _matrix(part.column(0)), part.column(1).to_numpy()


def _lists(rows: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _whole_sums(batches):
    """One row per task: the weighted sums of the upper and lower halves by dimension."""
    high = low = 0
    for x, w in _slices(batches):
        high, low = high + w @ (x // HALF), low + w @ (x % HALF)
    if not isinstance(high, int):
        yield pa.RecordBatch.from_arrays([_lists(high[None], pa.int64()), _lists(low[None], pa.int64())], ["high", "low"])


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The weight of all ``vectors`` (x, weight), and their exact sums by dimension."""
    each = vectors.select("x", "weight").mapInArrow(_whole_sums, "high array<bigint>, low array<bigint>")
    at = each.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = at.groupBy("i").agg(exact("s.high").alias("high"), exact("s.low").alias("low")).orderBy("i").collect()
    n = vectors.agg(F.sum("weight")).first()[0] or 0
    return n, [int(r["high"]) * HALF + int(r["low"]) for r in rows]


def _added(batches):
    """Matrix rows (i, values) added up by i."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
            total[i] = total[i] + v if i in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _lists(np.stack(list(total.values())), pa.float64())], ["i", "row"])


def covariance(vectors: DataFrame, n: int, centred) -> np.ndarray:
    """The covariance over ``vectors`` (array, weight), divisor ``n``, of what ``centred`` makes of them.

    Each task makes one matrix of all its rows; these are added in as many tasks as
    the matrix has rows, so that neither a task nor the driver holds more than one of them.
    """

    def products(batches):
        total = 0
        for x, w in _slices(batches):
            c = centred(x)
            total = total + c.T @ (c * w[:, None])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), _lists(total, pa.float64())], ["i", "row"])

    kind = "i int, row array<double>"
    rows = vectors.mapInArrow(products, kind).repartition("i").mapInArrow(_added, kind).collect()
    rows.sort(key=lambda r: r["i"])
    return np.array([r["row"] for r in rows]) / n if rows else np.zeros((0, 0))


@dataclass
class Whitening:
    """What the vectors gave: their number, exact sums, eigenvalues and eigenvectors by column."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        """The shares of the components in the trace."""
        total = self.values.sum()
        return [float(v / total) if total > 0 else None for v in self.values]

    @property
    def solid(self) -> np.ndarray:
        """Which components have an eigenvalue above rounding."""
        return self.values > len(self.values) * np.finfo(float).eps * self.values.max(initial=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts first, which is exact, then the rest of the mean."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sums over dimensions of (n*x - S)^2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        # In 64 bits wherever they are enough.
        large = (np.abs(near).max(initial=0) + 1) * float(self.n)
        if large < 2.0**31 and large * large * x.shape[1] < 2.0**62:
            d = near * self.n - rest
            return (d * d).sum(1).tolist()
        d = near.astype(object) * int(self.n) - rest.astype(object)
        return (d * d).sum(1).tolist()

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        scale = np.full(k, np.nan)
        solid = self.solid[:k]
        scale[solid] = 1 / np.sqrt(self.values[:k][solid])
        return (self.centred(x) @ self.vectors[:, :k]) * scale


def fit(distinct: DataFrame) -> Whitening:
    """The whitening of distinct vectors (x, weight), all of one length."""
    n, s = sums(distinct)
    fitted = Whitening(n, s, np.zeros(len(s)), np.zeros((len(s), len(s))))
    if n and s:
        values, vectors = np.linalg.eigh(covariance(distinct.select("x", "weight"), n, fitted.centred))
        fitted.values, fitted.vectors = values[::-1].clip(0), vectors[:, ::-1].copy()
    return fitted


def whiten(
    rows: DataFrame,
    vector: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "count",
    scale: int = SCALE,
    shift: int = SHIFT,
    whitened: str = "whitened",
    deviation: str = "deviation",
) -> tuple[DataFrame, Whitening]:
    """``rows`` with two more columns, the whitened vector and its deviation; and what was fitted.

    ``weights`` is "count", so that the fit is over all rows, or "one", over distinct vectors.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights must be count or one, not {weights}")
    whitened, deviation, x = fresh(rows, whitened, deviation, "x")
    grid = rows.withColumn(x, on_grid(col(rows, vector), scale, shift)).where(F.col(x).isNotNull())
    groups = grid.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"))
    groups = settle(groups, "vectors")
    # One row for each length that occurs; the most common one counts.
    length = groups.groupBy(F.size("x").alias("d")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension, total = (length["d"], length["n"]) if length else (0, 0)
    own = groups.where(F.size("x") == dimension)
    fitted = fit(own.select("x", (F.col("n") if weights == "count" else F.lit(1).cast("bigint")).alias("weight")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = _matrix(part.column(0))
                exact = pa.array([str(v) for v in fitted.deviations(m)], pa.string())
                z = fitted.whitened(m, components)
                filled = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), filled)
                yield pa.RecordBatch.from_arrays([*part.columns, exact, lists], ["x", "n", "d", "z"])

    if not dimension:  # only empty vectors, or none: nothing to multiply
        done = own.select("x", "n", F.lit("0").alias("d"), F.array().cast("array<double>").alias("z"))
    else:
        done = settle(own.mapInArrow(run, "x array<bigint>, n bigint, d string, z array<double>"), "whitened")
        solid = int(fitted.solid[:components].sum())
        if solid:
            weight = F.col("n") if weights == "count" else F.lit(1).cast("bigint")
            z = done.select(F.slice("z", 1, solid).alias("z"), weight.alias("weight"))
            means = z.select("weight", F.posexplode("z").alias("i", "v")).groupBy("i").agg(
                (F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("m")
            )
            mean = np.array([r["m"] for r in means.orderBy("i").collect()])
            seen = covariance(z, fitted.n, lambda m: m - mean)
            fitted.identity_error = float(np.abs(seen - np.eye(solid)).max())

    done = done.select(
        F.col("x").alias(x), "n", F.col("d").try_cast("decimal(38,0)").alias(deviation), F.col("z").alias(whitened)
    )
    # At most SHARE - 1 vectors can each have more than one in SHARE of the rows.
    often = F.col("n") * SHARE > total
    hot = F.broadcast(done.where(often).drop("n"))
    cold = done.where(~often).drop("n")
    out = grid.join(hot, x).unionByName(grid.join(hot, x, "left_anti").join(cold, x))
    return out.select(*[col(out, c) for c in rows.columns], whitened, deviation), fitted


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; deviations beyond a long are null."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out, fitted = whiten(rows)
    shares = F.array(*[F.lit(e) for e in fitted.explained[:COMPONENTS]]).cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
