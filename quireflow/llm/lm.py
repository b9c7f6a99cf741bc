"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

1. Texts become blocks: tokens as codes into the block's own distinct words, so
   that a frequent word is one row per block from here on.
2. Words are counted over all training documents, by blocks and then globally.
   The ``WORDS`` most frequent ones are symbols of their own, the end of a text
   too; all others share ``CLASSES`` symbols, by their last two bytes.
3. Counts and symbols go back to the blocks that hold the word.
4. The model predicts a symbol's vector from the two symbols before it. Each task
   trains a copy over one block with shared noise samples; copies are averaged,
   weighted by tokens, and the next of ``ROUNDS`` rounds goes on from the average.
   The rounds part the blocks, so every training token is used once in an epoch;
   there are ``EPOCHS`` of them at every size.
5. Scores are normalised: the softmax over all symbols, by matrix products, once
   for each distinct context, times a word's share of its class, in which one
   unseen word has the weight of ``ADD``.

The model has a fixed size; counts grow with the corpus and stay in tables.

Rules: A-Z are lower-cased, other letters are not; a null text is empty and has
one token, its end. Words are told apart by their bytes. Ids keep their type; a null id is held out. Rows are scored one by one. Without
training rows, N and V are 0 and every base score is 0. An empty table gives an
empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quireflow.llm.arrays import flat, pieces, runs, word_bounds
from quireflow.llm.common import col, documents, settle
from quireflow.llm.quality import held_out

WORDS, CLASSES = 383, 128
SYMBOLS = WORDS + 1 + CLASSES  # symbol 0 is the end of a text
ADD = 0.1
DIM = 24
NOISE = 32
BATCH = 8192
ROUNDS = 3
EPOCHS = 6  # at every size
BLOCK = 16 << 20

BLOCKS = "block bigint, doc_ids array<{id}>, held array<boolean>, ends array<int>, codes binary, words array<binary>, counts array<bigint>"


def _to_blocks(batches):
    """Rows (doc_id, held, text) as blocks; code 0 is the end of a text, spelled as no bytes."""
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() << 32) - 1
    for big in pieces(batches, 2, BLOCK):
        number += 1
        codes, words, row, shift = [], pa.array([], pa.binary()), [], 0
        for batch in pieces([big], 2):
            data, offsets = flat(batch.column(2))
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            begin, end, own = word_bounds(data, offsets)
            told = runs(data, begin, end).dictionary_encode()
            codes.append(told.indices.to_numpy())
            row.append((own + shift).astype(np.int32))
            shift += batch.num_rows
            words = pa.concat_arrays([words, told.dictionary])
        # Pieces' words into one list of the block's, which is compared by bytes.
        merged = words.dictionary_encode()
        places = merged.indices.to_numpy() + 1
        words = pa.concat_arrays([pa.array([b""], pa.binary()), merged.dictionary])
        starts = np.cumsum([0, *(int(c.max(initial=-1)) + 1 for c in codes)])
        codes = np.concatenate([places[s + c] for s, c in zip(starts, codes)])
        row = np.concatenate(row)
        n = big.num_rows
        # The end of each row after its words.
        sizes = np.bincount(row, minlength=n)
        ends = np.cumsum(sizes + 1)
        tokens = np.zeros(ends[-1], np.int32)
        tokens[np.arange(len(codes), dtype=np.int32) + row] = codes
        held = big.column(1).to_numpy(zero_copy_only=False).astype(bool)
        learned = np.repeat(~held, sizes + 1)
        counts = np.bincount(tokens[learned], minlength=len(words))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        packed = pa.compress(tokens.tobytes(), "zstd", asbytes=True)
        del merged, places, codes, row, learned
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]), whole(big.column(0)), whole(pa.array(held)), whole(pa.array(ends.astype(np.int32))),
                pa.array([packed], pa.binary()), whole(words), whole(pa.array(counts.astype(np.int64))),
            ],
            ["block", "doc_ids", "held", "ends", "codes", "words", "counts"],
        )


class Model:
    """The log-bilinear model's arrays."""

    def __init__(self, noise: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.chances = np.cumsum(noise) / np.sum(noise)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        first = {
            "context": rng.normal(0, 0.3, (SYMBOLS, DIM)),
            "one": np.eye(DIM),
            "two": 0.3 * np.eye(DIM),
            "out": rng.normal(0, 0.05, (SYMBOLS, DIM)),
            "bias": np.log(noise),
        }
        self.shapes = {k: v.shape for k, v in first.items()}
        # All arrays in one, so that a step changes them at once.
        self.values = np.concatenate([v.ravel() for v in first.values()]).astype(np.float32)
        self.squares = np.full_like(self.values, 0.1)
        self.scales = np.concatenate([np.full(v.size, 1 if k in ("one", "two") else SYMBOLS / 64, np.float32) for k, v in first.items()])

    @property
    def w(self) -> dict[str, np.ndarray]:
        """The arrays by name, as views."""
        parts = np.split(self.values, np.cumsum([math.prod(x) for x in self.shapes.values()])[:-1])
        return {k: part.reshape(x) for (k, x), part in zip(self.shapes.items(), parts)}

    def set(self, values: np.ndarray) -> None:
        self.values[:] = values

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The vectors predicted after symbols ``two``, ``one``; products are taken by symbol."""
        w = self.w
        q = (w["context"] @ w["one"]).take(one, 0)
        q += (w["context"] @ w["two"]).take(two, 0)
        return q

    def learn(self, one, two, target, rng, rate: float = 0.15) -> None:
        """A step over rows of a target and the two symbols before it."""
        self.step(_coded(one, two, target), rng, rate)

    def step(self, codes, rng, rate: float = 0.15) -> None:
        """A step of noise-contrastive estimation over coded rows; the batch shares its noise samples."""
        w = self.w
        noise = self.chances.searchsorted(rng.random(NOISE), "right")
        # By context: rows of one context share its vector and what noise adds, which are worked out once.
        codes = np.sort(codes)
        context = codes // SYMBOLS
        target = codes - context * SYMBOLS
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sizes = np.diff(starts, append=len(codes))
        context = context[starts]
        one = context // SYMBOLS
        two = context - one * SYMBOLS
        # Rows of one symbol share what follows from it, so products are taken by symbol.
        by_one, by_two = w["context"] @ w["one"], w["context"] @ w["two"]
        q = by_one.take(one, 0)
        q += by_two.take(two, 0)
        away, bias = w["out"][noise], w["bias"] - self.log_noise
        d_false = (by_one @ -away.T - bias[noise]).take(one, 0)
        d_false += (by_two @ -away.T).take(two, 0)
        np.clip(d_false, -30, 30, out=d_false)
        np.exp(d_false, out=d_false)
        d_false += 1
        np.divide(sizes.astype(np.float32)[:, None], d_false, out=d_false)
        d_q, d_away, d_noise = d_false @ away, d_false.T @ q, np.ones(len(q), np.float32) @ d_false
        q, out = np.repeat(q, sizes, 0), w["out"].take(target, 0)
        true = np.einsum("ij,ij->i", q, out) + bias.take(target)
        d_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        out *= d_true[:, None]
        d_q += out.take(starts, 0)
        more = np.flatnonzero(sizes > 1)
        if len(more):
            later = np.ones(len(codes), bool)
            later[starts] = False
            at = np.cumsum(sizes[more] - 1) - (sizes[more] - 1)
            d_q[more] += _segments(out.take(np.flatnonzero(later), 0), at)
        q *= d_true[:, None]
        d_out = _gathered(target, q)
        np.add.at(d_out, noise, d_away)
        d_bias = np.bincount(target, d_true, SYMBOLS) + np.bincount(noise, d_noise, SYMBOLS)
        g1, g2 = _summed(one, d_q), _gathered(two, d_q)
        d_context = g1 @ w["one"].T + g2 @ w["two"].T
        g = {"context": d_context, "one": w["context"].T @ g1, "two": w["context"].T @ g2, "out": d_out, "bias": d_bias}
        g = np.concatenate([g[k].ravel() for k in self.shapes], dtype=np.float32, casting="same_kind")
        g *= self.scales
        g /= np.float32(len(codes))
        self.squares += g * g
        self.values -= rate * g / np.sqrt(self.squares)

    def log_norms(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the softmax's sum over all symbols, for each context."""
        out = np.empty(len(one))
        for at in range(0, len(one), 8192):
            s = self.predicted(one[at : at + 8192], two[at : at + 8192]) @ self.w["out"].T + self.w["bias"]
            top = s.max(1, keepdims=True)
            out[at : at + 8192] = np.log(np.exp(s - top).sum(1)) + top[:, 0]
        return out


def _coded(one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rows of three symbols as numbers that sort by context."""
    return (one.astype(np.int32) * SYMBOLS + two) * SYMBOLS + target


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of the runs of ``values``, whose rows have an even size, from each start to the next."""
    # As complex numbers two neighbours are added at once, which halves the time.
    return np.add.reduceat(values.view(np.complex64), starts).view(np.float32)


def _summed(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of ``values``, whose rows come by symbol, by symbol."""
    out = np.zeros((SYMBOLS, values.shape[1]), np.float32)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out[rows[starts]] = _segments(values, starts)
    return out


def _gathered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of ``values`` by symbol."""
    order = np.argsort(rows.astype(np.int16), kind="stable")
    return _summed(rows[order], values.take(order, 0))


def _opened(batch, b):
    """A block's tokens, their row ends, held flags, and by local word its count and symbol."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[b]
    ends = get("ends").values.to_numpy().astype(np.int64)
    tokens = np.frombuffer(pa.decompress(get("codes").as_py(), int(ends[-1]) * 4, "zstd", asbytes=True), np.int32)
    counts = get("cs").values.to_numpy(zero_copy_only=False)
    symbols = get("symbols").values.to_numpy(zero_copy_only=False).astype(np.int32)
    held = get("held").values.to_numpy(zero_copy_only=False).astype(bool)
    return tokens, ends, held, counts, symbols


def _contexts(symbols: np.ndarray, ends: np.ndarray):
    """The symbol before each token, and the one before that; before a text stands its end."""
    one, two = np.zeros_like(symbols), np.zeros_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    starts = np.concatenate([[0], ends[:-1]])
    one[starts] = 0
    two[starts] = 0
    two[np.minimum(starts + 1, len(two) - 1)] = 0
    return one, two


def _trainer(model: Model, epochs: int, seed: int):
    def run(batches):
        rng, n = np.random.default_rng(seed), 0
        for batch in batches:
            for b in range(batch.num_rows):
                tokens, ends, held, _, symbols = _opened(batch, b)
                s = symbols[tokens]
                one, two = _contexts(s, ends)
                own = _coded(one, two, s)[np.repeat(~held, np.diff(ends, prepend=0))]
                n += len(own)
                for _ in range(epochs):
                    rng.shuffle(own)
                    for at in range(0, len(own), BATCH):
                        model.step(own[at : at + BATCH], rng)
        if n:
            values = pa.array(model.values.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["n", "w"])

    return run


def _scorer(model: Model, total: int, distinct: int, shares: np.ndarray):
    """Scores of a block's documents; ``shares``: log of each symbol's whole weight, 0 for single words."""

    def run(batches):
        known = np.full(SYMBOLS * SYMBOLS, np.nan)
        for batch in batches:
            for b in range(batch.num_rows):
                tokens, ends, held, counts, symbols = _opened(batch, b)
                s = symbols[tokens]
                one, two = _contexts(s, ends)
                within = np.where(symbols > WORDS, np.log(counts + ADD) - shares[symbols], 0.0)
                unigram = np.log10((counts + ADD) / (total + ADD * (distinct + 1)))
                logs = np.empty(len(s))
                for at in range(0, len(s), 1 << 17):
                    k = slice(at, at + (1 << 17))
                    place = one[k] * SYMBOLS + two[k]
                    seen = np.zeros(len(known), bool)
                    seen[place] = True
                    new = np.flatnonzero(seen & np.isnan(known))
                    known[new] = model.log_norms(new // SYMBOLS, new % SYMBOLS)
                    q, w = model.predicted(one[k], two[k]), model.w
                    logs[k] = np.einsum("ij,ij->i", q, w["out"].take(s[k], 0)) + w["bias"][s[k]] + within[tokens[k]] - known[place]
                base = unigram[tokens]
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("doc_ids"))[b].values,
                        pa.array(held),
                        pa.array(np.diff(ends, prepend=0)),
                        pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)),
                        pa.array(np.full(len(ends), total, np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(logs, starts) / np.log(10)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _averaged(trained: DataFrame) -> list[float] | None:
    """The mean of the tasks' arrays, weighted by tokens; summed by position on the executors."""
    at = trained.select("n", F.posexplode("w").alias("i", "x"))
    rows = at.groupBy("i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows] or None


def score_documents(docs: DataFrame, folds: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and model scores of all documents; learned outside the held-out fold."""
    taken = docs.select(
        col(docs, doc_id).alias("doc_id"),
        held_out(col(docs, doc_id), folds).alias("held"),
        F.coalesce(col(docs, text), F.lit("")).alias("text"),
    )
    kind = taken.schema["doc_id"].dataType.simpleString()
    blocks = settle(taken.mapInArrow(_to_blocks, BLOCKS.format(id=kind)), "lm-blocks")
    local = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x")).select(
        "block", "i", F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    counted = settle(local.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")

    # At most WORDS frequent words, so the broadcast is bounded.
    ends = F.col("word") == F.lit(b"")
    often = counted.where(~ends).orderBy(F.desc("c"), "word").limit(WORDS).collect()
    top = docs.sparkSession.createDataFrame(
        [(bytearray(b""), 0)] + [(r["word"], i + 1) for i, r in enumerate(often)], "top_word binary, top int"
    )
    last = F.when(F.octet_length("word") > 2, F.expr("substring(word, -2, 2)")).otherwise(F.col("word"))
    symbol = F.coalesce("top", F.lit(WORDS + 1) + F.pmod(F.crc32(last), F.lit(CLASSES))).cast("int").alias("symbol")
    named = lambda df: df.join(F.broadcast(top), F.col("word") == F.col("top_word"), "left")
    sums = named(counted).select(symbol, "c").groupBy("symbol").agg(F.sum("c").alias("c"), F.count("c").alias("v")).collect()
    total, distinct = sum(r["c"] for r in sums), sum(r["v"] for r in sums)
    shares, noise = np.log(np.full(SYMBOLS, ADD)), np.full(SYMBOLS, ADD)
    for r in sums:
        shares[r["symbol"]] = np.log(r["c"] + ADD * (r["v"] + 1))
        noise[r["symbol"]] += r["c"]

    told = named(local.join(counted, "word", "left")).select("block", F.struct("i", F.coalesce("c", F.lit(0)).alias("c"), symbol).alias("x"))
    # Far more partitions than blocks, so that few blocks meet in one.
    told = told.repartition(4 * max(1, blocks.count()), "block").groupBy(F.col("block").alias("b"))
    told = told.agg(F.sort_array(F.collect_list("x")).alias("x"))
    ready = blocks.drop("words", "counts").join(told, F.col("block") == F.col("b")).select(
        "block", "doc_ids", "held", "ends", "codes", F.col("x.c").alias("cs"), F.col("x.symbol").alias("symbols"),
        F.pmod(F.xxhash64("block"), F.lit(ROUNDS)).cast("int").alias("round"),
    )
    ready = settle(ready, "lm-ready", by="round")

    model = Model(noise / noise.sum())
    for round_ in range(ROUNDS):
        part = ready.where(F.col("round") == round_)
        # A task trains on one block, so a round lasts as long as a block whatever their number.
        part = part.repartitionByRange(max(1, part.count()), "block")
        mean = _averaged(part.mapInArrow(_trainer(model, EPOCHS, round_), "n bigint, w array<double>"))
        if mean is not None:
            model.set(np.array(mean))
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return ready.mapInArrow(_scorer(model, total, distinct, shares), schema)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
