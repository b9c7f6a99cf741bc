"""The language model: counts against brute force, normalisation, gradients' effect."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from quireflow.llm import lm


def tokens(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lower), b""]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 20)
    monkeypatch.setattr(lm, "SYMBOLS", 21 + lm.CLASSES)
    rng = random.Random(20)
    word = lambda: f"W{int(rng.expovariate(0.08))}é"
    rows = [(i, " ".join("the cat" if rng.random() < 0.4 else word() for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(None, "the cat"), (900, None), (901, ""), (902, "\x85 \x0b\tOnce-only ÀÉ"), (5, "the the"), (5, "the the")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, text string, held boolean")
    got = lm.score_documents(df).collect()
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        ws = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, base))
    key = lambda r: (str(r[0]), r[5])
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5]))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1 and all(r["score"] < 0 for r in got)


def test_no_training_rows_and_no_rows(spark):
    only = next(i for i in range(1000) if held(i))
    df = spark.createDataFrame([(only, "a b")], "doc_id bigint, text string")
    (row,) = lm.score_documents(df).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] < 0
    assert lm.score_documents(df.where("false")).count() == 0


def test_model_is_normalised_and_learns():
    noise = np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)
    model, rng = lm.Model(noise), np.random.default_rng(1)
    one = rng.integers(0, 50, 40000)
    two, target = rng.integers(0, 50, 40000), (one * 7 + 3) % 50
    for at in range(0, 40000, 2000):
        k = slice(at, at + 2000)
        for _ in range(3):
            model.learn(one[k], two[k], target[k], rng)
    q = model.predicted(one[:64], two[:64])
    logs = q @ model.w["out"].T + model.w["bias"] - model.log_norms(one[:64], two[:64])[:, None]
    assert np.allclose(np.exp(logs.astype(float)).sum(1), 1, atol=1e-4)
    assert logs[np.arange(64), target[:64]].mean() > math.log(1 / lm.SYMBOLS) + 1


def test_contexts_do_not_cross_texts():
    one, two = lm._contexts(np.array([5, 6, 7, 0, 8, 0, 0, 9, 9, 0]), np.array([4, 6, 7, 10]))
    assert one.tolist() == [0, 5, 6, 7, 0, 8, 0, 0, 9, 9]
    assert two.tolist() == [0, 0, 5, 6, 0, 0, 0, 0, 0, 9]


def test_epochs_do_not_follow_size(spark, monkeypatch):
    seen, trainer = [], lm._trainer
    monkeypatch.setattr(lm, "_trainer", lambda model, epochs, seed: seen.append(epochs) or trainer(model, epochs, seed))
    few = spark.createDataFrame([(i, "a b c") for i in range(30)], "doc_id bigint, text string")
    lm.score_documents(few).count()
    lm.score_documents(spark.createDataFrame([(i, "a b c d " * 4000) for i in range(30)], "doc_id bigint, text string")).count()
    assert len(set(seen)) == 1 and seen[0] == lm.EPOCHS


def test_structured_words_count_apart_and_ids_keep_their_type(spark):
    """Words that a polynomial hash modulo 2^64 takes for one are two words."""
    import math

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([("u1", f"{word} {word}"), ("u2", other), (None, word)], "doc_id string, text string")
    held = {r[0] for r in df.where(lm.held_out(df["doc_id"], 10)).select("doc_id").collect()}
    got = {r["doc_id"]: r for r in lm.score_documents(df).collect()}
    learned = [i for i in ("u1", "u2") if i not in held]
    counts = {word: 2 * ("u1" in learned), other: 1 * ("u2" in learned), "": len(learned)}
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    base = lambda ws: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    for i, ws in (("u1", [word, word, ""]), ("u2", [other, ""]), (None, [word, ""])):
        assert got[i]["train_tokens"] == n and got[i]["n_known"] == sum(counts[w] > 0 for w in ws)
        assert abs(got[i]["base_score"] - base(ws)) < 1e-9


def test_a_step_over_coded_rows_is_the_plain_gradient():
    rng = np.random.default_rng(2)
    noise = rng.random(lm.SYMBOLS) + 0.1
    noise /= noise.sum()
    model = lm.Model(noise)
    one, two, target = rng.integers(0, lm.SYMBOLS, (3, 3000))
    w = {k: v.astype(float) for k, v in model.w.items()}
    drawn = np.random.default_rng(7).choice(lm.SYMBOLS, lm.NOISE, p=noise)
    q = w["context"][one] @ w["one"] + w["context"][two] @ w["two"]
    bias = w["bias"] - np.log(lm.NOISE * noise)
    d_true = -1 / (1 + np.exp((q * w["out"][target]).sum(1) + bias[target]))
    d_false = 1 / (1 + np.exp(-(q @ w["out"][drawn].T + bias[drawn])))
    d_q = d_true[:, None] * w["out"][target] + d_false @ w["out"][drawn]
    want = {k: np.zeros_like(v) for k, v in w.items()}
    np.add.at(want["out"], target, d_true[:, None] * q)
    np.add.at(want["out"], drawn, d_false.T @ q)
    np.add.at(want["bias"], target, d_true)
    np.add.at(want["bias"], drawn, d_false.sum(0))
    np.add.at(want["context"], one, d_q @ w["one"].T)
    np.add.at(want["context"], two, d_q @ w["two"].T)
    want["one"], want["two"] = w["context"][one].T @ d_q, w["context"][two].T @ d_q
    codes = lm._coded(one, two, target)
    before = codes.copy()
    model.step(codes, np.random.default_rng(7))
    assert (codes == before).all()
    for k, g in want.items():
        g = g / 3000 * (lm.SYMBOLS / 64 if k in ("out", "bias", "context") else 1)
        assert np.allclose(model.w[k], w[k] - 0.15 * g / np.sqrt(0.1 + g * g), atol=1e-5), k


def test_rows_of_one_context_share_their_noise(monkeypatch):
    """3,000 rows of 60 contexts: the plain gradient, from one row of noise for each context."""
    rng = np.random.default_rng(3)
    noise = rng.random(lm.SYMBOLS) + 0.1
    noise /= noise.sum()
    model = lm.Model(noise)
    at, target = rng.integers(0, 60, 3000), rng.integers(0, lm.SYMBOLS, 3000)
    one, two = rng.integers(0, lm.SYMBOLS, (2, 60))
    one[:20], two[20:40] = 7, 9
    one, two = one[at], two[at]
    w = {k: v.astype(float) for k, v in model.w.items()}
    drawn = np.random.default_rng(7).choice(lm.SYMBOLS, lm.NOISE, p=noise)
    q = w["context"][one] @ w["one"] + w["context"][two] @ w["two"]
    bias = w["bias"] - np.log(lm.NOISE * noise)
    d_true = -1 / (1 + np.exp((q * w["out"][target]).sum(1) + bias[target]))
    d_false = 1 / (1 + np.exp(-(q @ w["out"][drawn].T + bias[drawn])))
    d_q = d_true[:, None] * w["out"][target] + d_false @ w["out"][drawn]
    want = {k: np.zeros_like(v) for k, v in w.items()}
    np.add.at(want["out"], target, d_true[:, None] * q)
    np.add.at(want["out"], drawn, d_false.T @ q)
    np.add.at(want["bias"], target, d_true)
    np.add.at(want["bias"], drawn, d_false.sum(0))
    np.add.at(want["context"], one, d_q @ w["one"].T)
    np.add.at(want["context"], two, d_q @ w["two"].T)
    want["one"], want["two"] = w["context"][one].T @ d_q, w["context"][two].T @ d_q
    codes, exps, exp = lm._coded(one, two, target), [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *rest, **named: exps.append(np.size(x)) or exp(x, *rest, **named))
    model.step(codes, np.random.default_rng(7))
    monkeypatch.undo()
    assert max(exps) <= 3000 and sum(exps) <= 3000 + 60 * lm.NOISE
    for k, g in want.items():
        g = g / 3000 * (lm.SYMBOLS / 64 if k in ("out", "bias", "context") else 1)
        assert np.allclose(model.w[k], w[k] - 0.15 * g / np.sqrt(0.1 + g * g), atol=1e-5), k
