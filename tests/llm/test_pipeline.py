"""The pipeline's stages against brute force, one after the other."""

import hashlib
from collections import defaultdict

import check_oracle
import duckdb
import pytest
from test_native import norm
from test_near import brute

import corpus_pipeline as cp
from quireflow.llm import quality
from quireflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = cp.settle(stage(spark, docs, SF), "t")
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_columns_and_ids(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for k, (_, before, rows, got) in enumerate(stages):
        assert k == 4 or got == columns
        assert {r["doc_id"] for r in rows} <= set(before) and len(rows) == len({r["doc_id"] for r in rows})


def test_quality_keeps_good_documents(stages):
    _, before, rows, _ = stages[0]
    kept = {r["doc_id"] for r in rows}
    labels = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) < 0.5 * len(bad)
    assert quality.ACCEPT == 0.3


def test_line_dedup(stages):
    _, before, rows, _ = stages[1]
    sites = defaultdict(set)
    for r in before.values():
        for x in r["text"].split("\n"):
            sites[norm(x)].add(r["source"])
    for r in rows:
        kept = "\n".join(x for x in before[r["doc_id"]]["text"].split("\n") if not norm(x) or len(sites[norm(x)]) < 10)
        assert r["text"] == kept and r["n_chars"] == len(kept)
    assert len(rows) == len(before)


def test_near_dedup(stages):
    _, before, rows, _ = stages[2]
    classes = brute([(i, r["text"]) for i, r in before.items()])
    assert {r["doc_id"] for r in rows} == {i for i, c in classes.items() if i == c}


def test_decontamination(stages):
    _, before, rows, _ = stages[3]
    items = [t for (t,) in duckdb.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    held = {i for i, r in before.items() if any(" ".join(t.split()) in " ".join(r["text"].split()) for t in items)}
    assert {r["doc_id"] for r in rows} == set(before) - held


def test_encoding(stages):
    _, before, rows, _ = stages[4]
    assert len(rows) == len(before)
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]]["text"].encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])


def test_run_equals_its_stages(spark, stages):
    assert sorted(cp.run(spark, SF).collect()) == sorted(stages[4][2])


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries(spark, name):
    """They run, and equal their SQL where it can say them."""
    df = QUERIES[name](spark, SF)
    assert check_oracle.compare(check_oracle.connect(SF), name, df) is None
    assert df.count() > 0
