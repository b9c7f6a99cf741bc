"""Whitening and hard negatives against brute force in whole numbers."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from check_oracle import compare, connect

from quireflow.llm import negatives, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def valid(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def grid(v, scale=1024, shift=100_000):
    return [math.floor(float(np.float32(c)) * scale) + shift for c in v]


def brute_whitening(rows, k=8):
    """(by id and component: deviation, whitened, explained), the sums being exact."""
    kept = [(i, grid(v)) for i, v, _ in rows if valid(v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    m = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for _, x in kept])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    out = {}
    for (i, x), c in zip(kept, m):
        dev = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        for p in range(min(k, d)):
            e, u = values[-1 - p], vectors[:, -1 - p]
            out[i, p + 1] = (dev, abs(c @ u) / math.sqrt(e), e / values.sum())
    return n, out


def check_whitening(got, rows):
    n, want = brute_whitening(rows)
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        dev, z, share = want[r["vec_id"], r["component"]]
        assert r["n"] == n and r["deviation"] == dev
        assert abs(abs(r["whitened"]) - z) < 1e-6 * max(1, z)
        assert abs(r["explained"] - share) <= 1e-9 * share and r["identity_error"] < 1e-8


def test_op11_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = whiten.op11_embedding_whitening(spark, SF)
    got = out.collect()
    check_whitening(got, rows)
    assert dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double",
        "identity_error": "double",
    }
    # One sign for all rows: the whitened values of a component keep their inner products.
    kept = [(i, np.array(grid(v), float)) for i, v, _ in rows if valid(v)]
    m = np.array([x for _, x in kept])
    m -= m.mean(0)
    for p in (1, 8):
        z = {r["vec_id"]: r["whitened"] for r in got if r["component"] == p}
        z = np.array([z[i] for i, _ in kept])
        back = m.T @ z / len(z)  # the covariance with a component is the eigenvector times its root
        assert np.allclose(np.cov(m.T, bias=True) @ back, (back @ back) * back, rtol=1e-6, atol=1e-6 * np.abs(back).max() ** 3)


def written(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_whitening_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, s) for s in (3, 2, 1)], 0) for i in range(40)]
    rows += [(100 + i, [1.5, -2.0, 0.25], 1) for i in range(30)]  # a hot vector
    rows += [(100, [1.5, -2.0, 0.25], 1)] * 2  # rows that repeat
    sf = written(spark, tmp_path, [*rows, (7000, None, 1), (7001, [1.0, None, 2.0], 1), (7002, [1.0, float("nan"), 2.0], 1),
                                   (7003, [1.0, float("inf"), 2.0], 1), (7004, [1.0, 2.0], 1), (7005, [], 1), (7006, [1e30, 0.0, 0.0], 1)])
    got = whiten.op11_embedding_whitening(spark, sf).collect()
    assert len(got) == 3 * len(rows)
    unique = {(r["vec_id"], r["component"]): r for r in got}.values()
    n, want = brute_whitening(rows)
    for r in unique:
        dev, z, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev) and abs(abs(r["whitened"]) - z) < 1e-8 and abs(r["explained"] - share) < 1e-12


def test_whitening_weights_names_and_empty(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [0.0, 0.0], "b"), (None, [1.0, 0.0], None), (4, [0.0, 2.0], "d"), (4, [0.0, 2.0], "d")]
    df = spark.createDataFrame(rows, "x bigint, embedding array<double>, whitened string")
    out, fitted = whiten.whiten(df, weights="one")
    assert out.columns == ["x", "embedding", "whitened", "whitened_", "deviation"] and out.count() == 5 and fitted.n == 3
    assert fitted.identity_error < 1e-12
    out, fitted = whiten.whiten(df)
    assert fitted.n == 5 and fitted.sums == [500_000 + 1024, 500_000 + 4096]
    for none in (df.limit(0), df.where("embedding IS NULL")):
        out, fitted = whiten.whiten(none)
        assert fitted.n == 0 and out.count() == 0
    with pytest.raises(ValueError):
        whiten.whiten(df, weights="two")


def test_whitening_without_spread(spark, tmp_path):
    """Equal vectors have no covariance to divide by, and large entries keep exact deviations."""
    sf = written(spark, tmp_path / "a", [(i, [0.5, 0.5, 1.0], 0) for i in range(5)])
    got = whiten.op11_embedding_whitening(spark, sf).collect()
    assert len(got) == 15 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in got)
    line = [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(6)]
    got = whiten.op11_embedding_whitening(spark, written(spark, tmp_path / "b", line)).collect()
    assert len(got) == 18
    for r in got:
        assert (r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-12
    big = spark.createDataFrame([(1, [2.0**39, 0.0]), (2, [-(2.0**39), 1.0])], "vec_id bigint, embedding array<double>")
    out, _ = whiten.whiten(big)
    xs = [grid64(v) for v in ([2.0**39, 0.0], [-(2.0**39), 1.0])]
    s = [sum(c) for c in zip(*xs)]
    assert {int(r["deviation"]) for r in out.collect()} == {sum((2 * c - t) ** 2 for c, t in zip(x, s)) for x in xs}


def grid64(v):
    return [math.floor(c * 1024) + 100_000 for c in v]


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (17, 33, 65), (40, 64, 20), (128, 64, 96), (3, 200, 70), (51, 0, 9)])
def test_strassen_is_exact(m, k, n):
    rng = np.random.default_rng(m * 100 + n)
    for bound in (10, 1 << 25, 1 << 31):
        a, b = rng.integers(-bound, bound, (m, k)), rng.integers(-bound, bound, (k, n))
        want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), object)
        if k:
            want = (want + (1 << 63)) % (1 << 64) - (1 << 63)
        assert (negatives.strassen(a, b, 8) == want.astype(np.int64)).all()


def brute_negatives(rows, anchors, low=80, high=100, k=5, scale=256):
    kept = [(n, i, l, [math.floor(float(np.float32(c)) * scale) for c in v]) for n, (i, v, l) in enumerate(rows) if l is not None and valid(v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, i, l, x in kept:
        if i is None or not anchors(i):
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), j, m) for o, j, m, y in kept if o != n]
        scored.sort(key=lambda t: (-t[0], last(t[1])))
        for p, j in [(s, j) for s, j, m in scored if m == l][:k]:
            window = [(s, j2) for s, j2, m in scored if m != l and low * p <= 100 * s <= high * p][:k]
            out += [(i, j, r + 1, j2, p, s) for r, (s, j2) in enumerate(window)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def moved(rows):
    return [(i, v, (l + 1) % 10 if i is not None and l is not None and i % 7 == 0 else l) for i, v, l in rows]


def test_op12_against_sql_and_brute_force(spark):
    df = negatives.op12_hard_negatives(spark, SF)
    assert compare(connect(SF), "op12_hard_negatives", df) is None
    rows = moved([tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    want = brute_negatives(rows, lambda i: i % 100 == 0)
    assert result(df) == want and want


@pytest.mark.parametrize("anchors,candidates,tile", [(4096, 4096, 512), (3, 7, 4), (2, 1000, 1)])
def test_negatives_in_blocks(spark, monkeypatch, anchors, candidates, tile):
    """Many units and tiles give what one gives; ties, null ids, repeated rows and odd vectors included."""
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "CANDIDATES", candidates)
    monkeypatch.setattr(negatives, "TILE", tile)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.5]) for _ in range(4)], rng.randrange(3)) for i in range(60)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(15)]  # one vector often
    rows += [(0, [0.5, 0.5, 0.0, 0.5], 0)] * 2 + [(None, [0.5, 0.5, 0.5, 0.25], 1), (None, [0.5, 0.5, 0.5, 0.5], 0)]
    rows += [(300, [0.5, 0.5], 1), (301, [], 1), (302, None, 1), (303, [0.5, None], 1), (304, [float("nan")], 1), (305, [0.1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert result(got) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_text_ids_and_empty(spark):
    from pyspark.sql import functions as F

    rows = [("a", [1.0, 0.0], 1), ("b", [0.75, 0.0], 1), ("c", [0.7, 0.5], 2), ("d", [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int").withColumn("slot", F.lit(1))
    assert result(negatives.hard_negatives(df, F.col("vec_id") == "a")) == [("a", "b", 1, "c", 192 * 256, 179 * 256)]
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") == "a").count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") == "z").count() == 0


def test_heaps_merge():
    """Heaps over tiles in any cut equal one sort, ties by place."""
    rng = np.random.default_rng(4)
    scores, allowed = rng.integers(-3, 3, (6, 50)), rng.random((6, 50)) < 0.6
    want = defaultdict(list)
    for i in range(6):
        best = sorted((-scores[i, c], c) for c in range(50) if allowed[i, c])[:4]
        want[i] = [(-s, c) for s, c in best]
    for cut in (1, 7, 50):
        heaps = negatives.Heaps(6, 4)
        for at in range(0, 50, cut):
            heaps.offer(np.arange(6), scores[:, at : at + cut], allowed[:, at : at + cut], at)
        got = defaultdict(list)
        for o, s, p in zip(heaps.owner.tolist(), heaps.score.tolist(), heaps.place.tolist()):
            got[o].append((s, p))
        assert got == want
