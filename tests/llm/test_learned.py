"""The byte network and BPE: held-out accuracy, exact encodings, edge cases."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import bpe, quality

P = pytest.importorskip("public_tokenizers")


def test_gradients():
    """The written-out gradients agree with differences."""
    net = quality.Network(3)
    rng = np.random.default_rng(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["last"] = rng.normal(0, 1, net.w["last"].shape)
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (10, 300, 900)]
    offsets = np.cumsum([0, *map(len, texts)])
    data, want = np.frombuffer(b"".join(texts), np.uint8), np.array([0.0, 1.0, 0.0])

    def loss():
        p = net.score(data, offsets)
        return -np.mean(want * np.log(p) + (1 - want) * np.log(1 - p))

    grads = net._gradients(data, offsets, want)
    for name, at in (("last", (3,)), ("bias", (0,)), ("filters", (5, 2)), ("embed", (77, 1)), ("shift", (4,))):
        old = net.w[name][at]
        net.w[name][at] = old + 1e-6
        up = loss()
        net.w[name][at] = old - 1e-6
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-4, name


def test_scores_do_not_depend_on_company():
    net, rng = quality.Network(4), np.random.default_rng(2)
    net.w["last"][:] = rng.normal(0, 1, 3 * quality.FILTERS)
    texts = [b"", b"abc", bytes(rng.integers(1, 255, 5000).astype(np.uint8)), b"x" * 256]
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def test_quality_end_to_end(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "under", "lamp", "quiet"]) for _ in range(rng.randrange(30, 90)))
    bad = lambda: " | ".join(rng.choice(["river", "stone", "under"]) + "$$" for _ in range(rng.randrange(30, 90)))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows] + [(None, "a", 0.1), (900, None, 0.1), (901, "", 0.1), (1, "a", 0.2)], "doc_id bigint, text string, good double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    out = quality.add_scores(df, quality.fit(df, labels)).withColumn("held", quality.held_out(F.col("doc_id"), 5)).collect()
    held = [r for r in out if r["held"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 40 and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 > 0) for r in held]) > 0.95
    null, empty = (next(r["score"] for r in out if r["doc_id"] == i) for i in (900, 901))
    assert null == empty and 0 <= null <= 1 and len(out) == 404
    assert {r["score"] for r in quality.add_scores(df, quality.fit(df, labels.where("false"))).collect()} == {0.5}
    assert quality.add_scores(df.where("false"), quality.Network()).count() == 0


TEXTS = [
    None, "", "a", " ", "\n\n  \t x", "don't we'll I'M", "Ünïcödé straße 東京 🙂🙂 ٣٤ x²", "the the the unthinkable", "ab" * 300, "a\u0085b c 　 d",
    "x" * 1200, "".join(random.Random(9).choice("abcdefgh é") for _ in range(3000)), "\x1c\x1d \x00\x7f",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    lines = (row.split() for row in open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_documents_encode_as_the_library_does(spark, vocabulary, reference):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] * 2, "doc_id bigint, text string, codes string")
    out = bpe.encode_documents(df, vocabulary, P.PATTERN, ids=True).collect()
    assert len(out) == 2 * len(TEXTS)
    for r in out:
        text = TEXTS[r["doc_id"]] or ""
        ids = reference(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(df.where("false"), vocabulary, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(df.withColumn("n_tokens", F.lit(1)), vocabulary, P.PATTERN)


def test_column_fold(spark, vocabulary, reference):
    tokenizer = bpe.Tokenizer(vocabulary)
    words = ["unthinkable", " straße", "a", "", "zzzzzzzz", "été"]
    df = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<int>")
    out = df.select("w", tokenizer.encode(F.col("b")).alias("ids")).withColumn("back", tokenizer.decode(F.col("ids"))).collect()
    assert [r["ids"] for r in out] == [reference(w) for w in words]
    assert [bytes(r["back"]).decode() for r in out] == words
