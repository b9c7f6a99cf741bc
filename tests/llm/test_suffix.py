"""Induced sorting against plain sorting, and removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quireflow.llm import suffix


def texts(rng):
    for n in (1, 2, 3, 10, 80, 400):
        for k in (1, 2, 4, 200):
            for _ in range(4):
                yield bytes(rng.randrange(k) + 32 for _ in range(n))
    yield b"abracadabra" * 20
    yield b"mississippi" + b"\xff" + b"mississippi\xff"


@pytest.fixture(params=[(1 << 20, 1 << 28), (3, 64)])
def bounds(request, monkeypatch):
    """As in production, and with recursion to the end and queues on disk."""
    monkeypatch.setattr(suffix, "BASE", request.param[0])
    monkeypatch.setattr(suffix, "MEMORY", request.param[1])


def test_order_and_common_prefixes(bounds):
    rng = random.Random(14)
    for raw in texts(rng):
        text, most = np.frombuffer(raw, np.uint8), 7
        types = suffix.s_types(text)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        seeds = suffix.sorted_seeds(text, types)
        assert seeds.tolist() == [i for i in want if i and types[i] and not types[i - 1]], raw
        lcps = np.zeros(len(seeds), np.int64)
        if len(seeds) > 1:
            lcps[1:] = suffix.common_prefix(text, seeds[:-1], seeds[1:], most)
        got, found = [], []
        suffix.induce(text, types, seeds, lcps, most, lambda p, x: (got.extend(p.tolist()), found.extend(x.tolist())))
        assert got[::-1] == want, raw

        def lcp(a, b):
            k = 0
            while k < most and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            return k

        assert found[1:] == [lcp(a, b) for a, b in zip(got, got[1:])], raw


def test_repeated_starts(bounds):
    rng = random.Random(15)
    for raw in texts(rng):
        for length in (1, 3, 9):
            count = Counter(raw[i : i + length] for i in range(len(raw) - length + 1))
            want = [i + length <= len(raw) and count[raw[i : i + length]] > 1 for i in range(len(raw))]
            assert suffix.repeated_starts(np.frombuffer(raw, np.uint8), length).tolist() == want, (raw, length)


def brute(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len([1 for x in bytes(gone).split(b"\0") if x])
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def result(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, h int, piece string")
    out = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("k"))
    return [tuple(r) for r in out.collect()]


def test_removal(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 4000)
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 60, 120)]
    rows = [(1, None), (2, ""), (3, "short"), (None, passages[2] * 2), (4, "a" * 1000), (5, "b" * 201), (5, "b" * 201), (6, "c" * 200)]
    for i in range(10, 60):
        body = [word() for _ in range(rng.randrange(5, 160))]
        if rng.random() < 0.7:
            body.insert(rng.randrange(len(body)), rng.choice(passages))
        rows.append((i, " ".join(body)))
    for i in range(60, 90):
        body = list(rows[rng.randrange(10, 50)][1])
        for _ in range(rng.randrange(0, 4)):
            body[rng.randrange(len(body))] = "#"
        rows.append((i, "".join(body)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(result(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix.remove_repeats(df).count() == 0


def test_common_anchors_are_in_no_shard(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 1000)
    monkeypatch.setattr(suffix, "SHARD", 4000)
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    body = lambda n: " ".join(word() for _ in range(n))
    hot, long = "common string of 32 bytes, or so!", body(60)
    rows = [(i, f"{body(40)} {hot} {body(40)}") for i in range(120)]
    rows += [(i, f"{body(40)} {hot} {long} {body(10)}") for i in range(200, 260)]
    rows += [(i, f"{body(40)}{long[-90:]} {hot} {long} {body(10)}") for i in range(300, 330)]
    rows += [(i, rows[i][1][:200] + "#" + rows[i][1][201:]) for i in range(20)] + rows[:5]
    counted, inner = [], suffix._counted_repeats

    def seen(cut):
        counted.append(cut.groupBy("h").count().count())
        return inner(cut)

    monkeypatch.setattr(suffix, "_counted_repeats", seen)
    key = lambda r: (r[0], r[4])
    assert sorted(result(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert counted and counted[0] > 0


def test_common_prefixes_by_words_of_eight_bytes(monkeypatch):
    """Zeros and the end of the text are not taken for each other; fewer passes than bytes."""
    monkeypatch.setattr(suffix, "MANY", 1)
    rng = np.random.default_rng(4)
    for case in range(60):
        n = int(rng.integers(1, 300))
        text = (rng.integers(0, 2, n) * 255).astype(np.uint8) if case % 3 else np.zeros(n, np.uint8)
        a, b, most = rng.integers(0, n, 50), rng.integers(0, n, 50), int(rng.choice([1, 8, 13, 200]))
        want = []
        for i, j in zip(a.tolist(), b.tolist()):
            k = 0
            while k < most and max(i, j) + k < n and text[i + k] == text[j + k]:
                k += 1
            want.append(k)
        assert suffix.common_prefix(text, a, b, most).tolist() == want
        names = text.astype(np.int64)
        assert suffix.common_prefix(names, a, b, most).tolist() == want
