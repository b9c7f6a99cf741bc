"""BM25 with block-max bounds against scoring every pair, and planted items."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quireflow.llm import decontaminate as dc
from quireflow.llm.arrays import flat, run_hash, word_bounds

PLANTED = "which river runs under the old stone bridge of the northern town? the quiet silver river does so since the great flood of that year."


def item(rng, n):
    return " ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(900)}"]) for _ in range(n)) + ". " + " ".join(f"w{rng.randrange(900)}" for _ in range(8))


def test_retrieval_equals_scoring_every_pair(monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 4)
    rng = random.Random(11)
    items = [(i, item(rng, rng.randrange(2, 60))) for i in range(60)]
    texts = []
    for _ in range(80):
        w = [rng.choice(["the", "of", "and", f"w{rng.randrange(900)}"]) for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.5:
            at, own = rng.randrange(len(w) + 1), rng.choice(items)[1].split()
            w[at:at] = [x if rng.random() < 0.85 else "changed" for x in own]
        texts.append(" ".join(w))
    counts = Counter(w for _, t in items for w in set(t.split()))
    index = dc.Index(items, {int(dc._hash_words([w])[0].astype(np.int64)): n for w, n in counts.items()}, len(items))
    data, offsets = flat(pa.array(texts))
    begin, end, row = word_bounds(data, offsets)
    got = set(zip(*map(np.ndarray.tolist, index.retrieve(run_hash(data, begin, end)[0], row))))

    parts = []
    for k, (_, t) in enumerate(items):
        q, a = dc.question_and_answer(t)
        parts += [(k, Counter((q + a)[x : x + dc.PART])) for x in range(0, len(q + a), dc.PART)]
    mean = sum(sum(p.values()) for _, p in parts) / len(parts)
    idf = {w: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for w, n in counts.items()}
    want = set()
    for r, t in enumerate(texts):
        w = t.split()
        for at in range(0, len(w), dc.PART):
            near = set(w[at : at + 2 * dc.PART])
            for k, p in parts:
                size = sum(p.values())
                score = {x: idf[x] * n * (dc.K1 + 1) / (n + dc.K1 * (1 - dc.B + dc.B * size / mean)) for x, n in p.items()}
                if sum(s for x, s in score.items() if x in near) >= dc.SHARE * sum(score.values()) - 1e-9:
                    want.add((r, at, k))
    assert want and got == want


def test_items_in_documents(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choice(["the", "of", "old", f"f{rng.randrange(500)}"]) for _ in range(n))
    long_item = filler(150)
    items = [(7, PLANTED), (8, "short question here ok? yes it is so"), (9, None), (10, ""), (11, long_item), (None, "an item of no id and of some words"), (7, "another text with this very id and words")]
    rows = [
        (1, filler(300) + " " + PLANTED.upper() + "$$$ " + filler(50), [7]),
        (2, PLANTED, [7]),
        (3, filler(5000) + " " + PLANTED.replace(" ", "\n") + " " + long_item, [7, 11]),
        (4, "which river runs under the old stone bridge of the northern town? " + filler(60), []),
        (5, filler(60) + " the quiet silver river does so since the great flood of that year.", []),
        (6, None, []), (None, "", []), (2, PLANTED, [7]),
        (12, filler(400), []),
        (13, "so short question here ok? yes it is so then", [8]),
        (14, "now another text with this very id and words", [7]),
    ]
    df = spark.createDataFrame([r[:2] + ("x",) for r in rows], "doc_id bigint, text string, lower_ string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = dc.add_items(df, bench)
    assert out.columns == ["doc_id", "text", "lower_", "items"]
    assert sorted(map(str, ((r["doc_id"], r["items"]) for r in out.collect()))) == sorted(map(str, ((r[0], r[2]) for r in rows)))
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not r[2] for r in rows)
    assert dc.drop_contaminated(df, bench.where("false")).count() == len(rows)
    assert dc.drop_contaminated(df.where("false"), bench).count() == 0


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(dc, "SHARD", 12)
    rng = random.Random(13)
    items = [(i, item(rng, 20)) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(dc.indexes(bench))) == 4
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id bigint, text string")
    assert all(r["items"] == [r["doc_id"]] for r in dc.add_items(df, bench).collect())


def test_long_items_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(dc, "SHARD", 4)
    monkeypatch.setattr(dc, "SHARD_WORDS", 8000)
    rng = random.Random(14)
    long = item(rng, 12_000)
    bench = spark.createDataFrame([(1, long)] + [(2, PLANTED)] * 30 + [(i, item(rng, 30)) for i in range(3, 9)], "item_id bigint, text string")
    rows = [(1, f"before {long} after"), (2, f"so {PLANTED} then"), (3, long[: len(long) // 3]), (4, "none of them")]
    got = {r["doc_id"]: r["items"] for r in dc.add_items(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: []}
    indexes = list(dc.indexes(bench))
    assert sum(len(x.items) for x in indexes) == 8 and all(len(x.items) <= 4 for x in indexes)


def test_one_index_at_a_time(spark, monkeypatch):
    """40 items in shards of 4: a job for each shard, one Arrow step a plan, names and text ids kept."""
    monkeypatch.setattr(dc, "SHARD", 4)
    items = [(f"i{k:02d}", " ".join(f"q{k}w{j}" for j in range(20)) + ". " + " ".join(f"a{k}w{j}" for j in range(12))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(k, f"before {t} after", 1, 2) for k, (_, t) in enumerate(items)] + [(90, items[3][1] + " and " + items[7][1], 1, 2), (None, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, items int, row int")
    shards = dc.Shards(bench)
    assert len(shards.names) >= 10 and sum(len(shards.index(s).items) for s in shards.names) == 40
    out = dc.add_items(df, bench)
    assert out.columns == [*df.columns, "items_"]
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["items_"] for r in out.collect()}
    assert got == {**{k: [f"i{k:02d}"] for k in range(40)}, 90: ["i03", "i07"], None: []}
    assert sorted((r["doc_id"] for r in dc.drop_contaminated(df, bench).collect()), key=repr) == [None]
