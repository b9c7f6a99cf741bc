"""Systematic sampling against brute force in fractions, and its targets."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from quireflow.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """Shares what is left by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        rest = [s for s in names if s not in capped]
        for s in rest:
            target[s] = left * weight[s] / sum(weight[r] for r in rest)
        more = [s for s in rest if target[s] >= cap * sizes[s]]
        for s in more:
            target[s] = Fraction(cap * sizes[s])
        if not more:
            return target
        capped.update(more)


def brute_mix(docs):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    target = brute_targets(sizes)
    out = []
    for s in sizes:
        rate = target[s] / sizes[s] if sizes[s] else 0
        digest = hashlib.md5(("13:" + ("" if s is None else "=" + s)).encode()).hexdigest()
        at = Fraction(int(digest[:8], 16) // 2, 1 << 31)
        rate = Fraction(int(rate * (1 << 31)), 1 << 31)
        for i, _, n in sorted((d for d in sized if d[1] == s), key=lambda d: (d[2], d[0] is not None, d[0] or 0)):
            out.append((i, n, sizes[s], float(target[s]), (int(at + rate) - int(at)) * n))
            at += rate
    return sorted(out, key=repr)


def rows_of(plan):
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return sorted((tuple(r) for r in plan.select("doc_id", "size", "source_size", "target", taken).collect()), key=repr)


def close(got, want):
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 * max(1, w[3]) for g, w in zip(got, want))


def test_op13_against_sql_and_brute_force(spark):
    df = mixing.op13_mixing(spark, SF)
    assert compare(connect(SF), "op13_mixing", df) is None
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    close(got, brute_mix(docs))
    # Near the targets: off by the largest document of the source at most, and one word of rounding.
    sums, most = defaultdict(int), defaultdict(int)
    of = dict((i, s) for i, _, s in docs)
    for i, size, _, target, taken in got:
        sums[of[i], target] += taken
        most[of[i]] = max(most[of[i]], size)
        assert taken in (0, size, 2 * size)
    for (s, target), taken in sums.items():
        assert abs(taken - target) <= most[s] + 1


def odd_rows():
    rows = [(i, "w " * (i % 9), ["b", "a", None, ""][i % 4]) for i in range(80)]
    rows += [(500 + i, "hot copy of five words", "b") for i in range(60)]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a"), (900, None, "empty"), (901, " \t\n", "empty")]
    rows += [(902, "long " * 30_000, "z"), (903, "é  wide spaces are no blanks", "\U0001f600"), (904, "p q", "￿")]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_mixing_odd_rows(spark, parts):
    """Nulls, ties, repeated rows, wordless sources, a very long text; however the rows are dealt."""
    rows = odd_rows()
    plan = mixing.planned(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    close(rows_of(plan), brute_mix(rows))


def test_mixing_over_many_ranges(spark):
    """Prefix sums over ranges that split sources equal those of one range."""
    rows = odd_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(mixing.planned(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    close(got, brute_mix(rows))


def test_targets(spark):
    for sizes in ({"a": 10, "b": 10, "c": 1000}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 7}, {"a": 5, None: 5}, {}, {"a": 0},
                  {f"s{i:02d}": (i * 37) % 11 * 10 ** (i % 4) for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want), sizes


def test_crossed_in_longs(spark):
    cases = [(k, e, s) for k in (0, 1, 2, (1 << 31) - 1, 1 << 31, (1 << 40) + 12345) for e in (0, 1, (1 << 31) - 1, 1 << 31, (1 << 32) - 7) for s in (0, (1 << 31) - 1)]
    df = spark.createDataFrame(cases, "k bigint, e bigint, s bigint")
    got = df.select("k", "e", "s", mixing.crossed(F.col("k"), F.col("e"), F.col("s")).alias("r")).collect()
    assert all(r["r"] == (r["s"] + r["k"] * r["e"]) >> 31 for r in got)


def test_mixed_emits_copies(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("kept")).withColumn("row", F.lit(5))
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "copy_"]
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    want = Counter()
    for r in mixing.planned(df).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    assert got == +want
    none = df.limit(0)
    assert mixing.mixed(none).count() == 0 and mixing.planned(none).count() == 0
