"""Every stage on nulls, empty and very long texts, repeated rows, an empty table, and columns whose names stages use."""

from collections import Counter

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
EXTRA = ["score", "row", "of", "items", "lower", "gone_id", "hit_row", "hit_lines", "id", "class_id", "ids", "a.b"]


def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = "a long text with words that go on and on without an end so far\n" * 3000
    rows = [(None, "text without an id, of some words that nobody else has said here", "en", "s1", 64), (900001, None, None, None, None),
            (900002, "", "en", "s1", 0), (900003, long, "en", "s2", len(long)), (900003, long, "en", "s2", len(long)), (900004, " \n ", "en", None, 3)]
    more = spark.createDataFrame(rows, docs.schema)
    out = docs.unionByName(more)
    return out.selectExpr("*", *[f"'{c}' AS `{c}`" for c in EXTRA])


@pytest.mark.parametrize("k", range(5), ids=[n for n, _ in cp.STAGES])
def test_odd_rows(spark, k):
    docs = cp.settle(odd(spark).repartition(3), "odd")
    stage = cp.STAGES[k][1]
    out = stage(spark, docs, SF)
    rows = out.collect()
    before, after = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in rows)
    assert not after - before
    if k < 4:
        assert out.columns == docs.columns and all(r["a.b"] == "a.b" and r["score"] == "score" for r in rows)
    if k in (1, 4):
        assert after == before
    if k in (2, 3):
        assert after[None] == 1 and after[900003] == (2 if k == 3 else after[900003]) and after[900003] > 0
    if k == 2:  # texts without words are one class
        assert sum(after[i] for i in (900001, 900002, 900004)) == 1
    by = {r["doc_id"]: r for r in rows}
    if k == 1:
        assert by[900001]["text"] is None and by[900002]["text"] == ""
    if k == 4:
        assert by[900001]["n_tokens"] == by[900002]["n_tokens"] == 0 and by[900003]["n_tokens"] > 3000
    none = docs.where("false")
    assert stage(spark, none, SF).count() == 0


def test_without_a_count_of_characters(spark):
    docs = odd(spark).drop("n_chars")
    assert cp.line_dedup(spark, docs, SF).columns == docs.columns
