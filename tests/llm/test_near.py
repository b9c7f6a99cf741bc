"""DartMinHash: its estimates, and classes against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quireflow.llm import near
from quireflow.llm.arrays import flat, mix, word_bounds


def test_estimates_weighted_similarity():
    a = {i: 1 + i % 7 for i in range(60)}
    b = {i: 1 + (3 * i) % 5 for i in range(20, 90)}
    c, d = {i: 0.3 for i in range(9)}, {i: 0.2 + 0.05 * i for i in range(9)}
    sets = [a, b, c, d]
    h = mix(np.array([k for s in sets for k in s], np.uint64))
    r = np.array([i for i, s in enumerate(sets) for _ in s])
    w = np.array([x for s in sets for x in s.values()], float)
    got = near.dart_minhash(h, r, w, 4, k=4000)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        x, y = sets[i], sets[j]
        want = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        assert abs((got[i] == got[j]).mean() - want) < 0.035


def test_words_and_shingles():
    import pyarrow as pa
    import re

    texts = ["", None, "a", " b c ", "d\te\x0bf g h i", "ü é", "x y z u v", "\n"]
    data, offsets = flat(pa.array(texts))
    begin, end, row = word_bounds(data, offsets)
    got = [(int(r), bytes(data[b:e])) for b, e, r in zip(begin, end, row)]
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert got == want
    _, rows = near.shingles(*near.word_hashes(data, offsets), len(texts))
    assert Counter(rows.tolist()) == {2: 1, 3: 1, 4: 2, 5: 1, 6: 1}


def brute(rows, similarity=0.8):
    """Classes by all pairs of multisets of shingles."""
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").lower().split()
            s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
            sets.setdefault(i, []).append(Counter(s))
    ids = sorted(sets)
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    def alike(x, y):
        if not x or not y:
            return not x and not y
        return sum((x & y).values()) >= similarity * sum((x | y).values())

    for i in ids:
        for j in ids:
            if i < j and any(alike(x, y) for x in sets[i] for y in sets[j]):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return {i: root(i) for i in ids}


def test_classes(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, i = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "x"), (None, "x"), (None, None)], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) * len(base) // 120):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(2000, " ".join(["the end"] * 300)), (2001, " ".join(["the end"] * 310)), (3, "one two"), (3, "one two")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, label int, class_id int")
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(df).collect()}
    assert got.pop(None, None) is None  # a row without an id is in no class
    assert got == brute(rows)
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {i for i, c in got.items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want | {None}


@pytest.mark.parametrize("block", [1024, 16])
def test_large_group_of_variants(spark, monkeypatch, block):
    """Every two of many variants share a base; links run through it and each other."""
    monkeypatch.setattr(near, "BLOCK_DOCS", block)
    rng = random.Random(7)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"v{i}_{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in near.near_classes(df).collect()} == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near.near_classes(df).count() == 0 and near.drop_near_duplicates(df).count() == 0


def thue_morse(bits):
    """Two words that any polynomial hash modulo 2^64 takes for one."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_structured_words_apart():
    import pyarrow as pa

    from quireflow.llm.arrays import run_hash, runs

    words = [w for bits in range(1, 14) for w in thue_morse(bits)] + ["x" * n for n in (1, 7, 8, 9, 16, 511, 512, 513, 5000)] + ["", "é"]
    words = list(dict.fromkeys(words))
    data, offsets = flat(pa.array([" ".join(words + words), None, "ab"]))
    begin, end, row = word_bounds(data, offsets)
    for hashes in run_hash(data, begin, end, lanes=2):
        n = len(words) - 1
        assert len(set(hashes[:n].tolist())) == n and (hashes[:n] == hashes[n : 2 * n]).all()
        assert hashes[-1] == hashes[words.index("ab")]
    assert [w.decode() for w in runs(data, begin, end).to_pylist()] == [w for w in words + words if w] + ["ab"]


def classes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_structured_words_are_unlike(spark):
    one, two = thue_morse(10)
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id bigint, text string")
    assert classes(near.near_classes(df)) == [(1, 1), (2, 2), (3, 1)]


def test_null_ids_text_ids_and_names(spark):
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(None, same), (None, None), (2, same), (1, same), (7, other), (7, other)], "doc_id int, text string")
    assert classes(near.near_classes(df)) == sorted([(None, None), (None, None), (2, 1), (1, 1), (7, 7)], key=repr)
    assert dict(near.near_classes(df).dtypes) == {"doc_id": "int", "class_id": "int"}
    clash = df.selectExpr("*", "0 AS gone_id", "1 AS gone_id_", "2 AS class_id", "3 AS id")
    kept = near.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 7, 7, None, None]
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert classes(near.near_classes(named)) == sorted([(None, None), (None, None), ("d2", "d1"), ("d1", "d1"), ("d7", "d7")], key=repr)
    assert near.near_classes(df.limit(0)).count() == 0 and near.near_classes(named.limit(0)).count() == 0


def test_op2_against_brute_force(spark):
    """All of the small table: links by whole shingle sets, then components."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        sets[r["doc_id"]] = Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = sum((sets[i] & sets[j]).values())
            if common >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near.op2_minhash_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (find(i), find(i) == i) for i in ids}
