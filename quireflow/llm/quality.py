"""A quality classifier: a convolutional network over bytes, written in numpy.

Bytes are embedded, and learned filters of ``WIDTH`` bytes slide over them in
steps of ``STEP``. A document is covered whole by chunks of two hops of ``HOP``
bytes that overlap by one hop; each filter is max-pooled within a chunk. The
means, maxima and minima over a document's chunks give one probability.

The network is fitted on the driver from at most ``SAMPLE`` labelled documents
of at most ``SAMPLE_BYTES`` bytes each, those with the least id hashes; neither
bound touches scoring, which reads every whole text in one narrow pass.

Rules: a null text scores as an empty one; an empty text is one chunk of
padding. Rows that share an id are scored one by one; labels that disagree are
averaged and count as good from one half up. A null id is held out. Without
labels every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quireflow.llm.arrays import flat, pieces
from quireflow.llm.common import col, documents, fresh, mapped

SAMPLE = 3000
SAMPLE_BYTES = 1 << 16
STEPS = 700
BATCH = 32
FILTERS = 32
DIM, WIDTH, STEP, HOP = 8, 8, 4, 256
REACH = WIDTH - STEP
ACCEPT = 0.3


class Network:
    """The learned arrays: byte embedding, filters, and the last layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, 0.18, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "last": np.zeros(3 * FILTERS, np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def _padded(self, data: np.ndarray, offsets: np.ndarray):
        """Hops of whole documents, padded with zero bytes, each with the bytes that its last
        filter reaches over; the first hop of each document."""
        sizes = np.diff(offsets)
        first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-sizes // HOP)))])
        out = np.zeros(first[-1] * HOP, np.uint8)
        shift = np.repeat(first[:-1] * HOP - offsets[:-1], sizes)
        out[np.arange(len(data)) + shift] = data
        hops = np.zeros((first[-1], HOP + REACH), np.uint8)
        hops[:, :HOP] = out.reshape(-1, HOP)
        hops[:-1, HOP:] = hops[1:, :REACH]
        hops[first[1:] - 1, HOP:] = 0
        return hops, first

    def _hops(self, padded: np.ndarray, argmax: bool = False):
        """Activations max-pooled by hop, and where each maximum lies."""
        half = STEP * DIM
        rows = self.w["embed"][padded].reshape(-1, half)
        left = (rows @ self.w["filters"][:half]).reshape(len(padded), -1, FILTERS)
        right = (rows @ self.w["filters"][half:]).reshape(len(padded), -1, FILTERS)
        act = left[:, :-1] + right[:, 1:]
        return np.maximum(act.max(1) + self.w["shift"], 0), act.argmax(1) if argmax else None

    def _pooled(self, hops: np.ndarray, first: np.ndarray):
        """Chunks of two hops each, and per document their mean, maximum and minimum."""
        last = np.repeat(first[1:] - 1, np.diff(first))
        after = np.minimum(np.arange(len(hops)) + 1, last)
        chunks = np.maximum(hops, hops[after])
        starts, counts = first[:-1], np.diff(first)[:, None]
        mean = np.add.reduceat(chunks, starts) / counts
        return chunks, after, np.concatenate(
            [mean, np.maximum.reduceat(chunks, starts), np.minimum.reduceat(chunks, starts)], 1
        )

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability per document."""
        if len(offsets) < 2:
            return np.zeros(0)
        padded, first = self._padded(data, offsets)
        top = []
        for at in range(0, first[-1], 1024):  # so that activations stay small
            stop = min(first[-1], at + 1024)
            top.append(self._hops(padded[at:stop])[0])
        features = self._pooled(np.concatenate(top), first)[2]
        z = (features @ self.w["last"] + self.w["bias"]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _gradients(self, data, offsets, want):
        padded, first = self._padded(data, offsets)
        hops, at = self._hops(padded, argmax=True)
        chunks, after, features = self._pooled(hops, first)
        z = features @ self.w["last"] + self.w["bias"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(want)).astype(np.float32)
        d = dz[:, None] * self.w["last"]
        doc = np.repeat(np.arange(len(want)), np.diff(first))
        mean, high, low = d[:, :FILTERS], d[:, FILTERS : 2 * FILTERS], d[:, 2 * FILTERS :]
        d_chunk = (mean / np.diff(first)[:, None])[doc]
        d_chunk += high[doc] * (chunks == features[doc, FILTERS : 2 * FILTERS])
        d_chunk += low[doc] * (chunks == features[doc, 2 * FILTERS :])
        own = hops >= hops[after]
        d_hop = np.where(own, d_chunk, 0)
        np.add.at(d_hop, after, np.where(own, 0, d_chunk))
        d_hop *= hops > 0
        # Only the byte window of each maximum takes part.
        windows = padded[np.arange(len(hops))[:, None, None], (at * STEP)[:, :, None] + np.arange(WIDTH)]
        seen = self.w["embed"][windows].reshape(len(hops), FILTERS, WIDTH * DIM)
        d_filters = np.einsum("hf,hfk->kf", d_hop, seen)
        d_seen = (d_hop[:, :, None] * self.w["filters"].T).reshape(-1, DIM)
        flat_bytes = windows.reshape(-1)
        d_embed = np.stack([np.bincount(flat_bytes, d_seen[:, k], 256) for k in range(DIM)], 1)
        return {
            "embed": d_embed, "filters": d_filters, "shift": d_hop.sum(0), "last": dz @ features, "bias": dz.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, rate: float = 3e-3, seed: int = 11):
        """Adam over random batches; the order depends on the seed only."""
        if not texts:
            return self
        rng = np.random.default_rng(seed)
        want = np.array(labels, np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.w["bias"][:] = np.log((want.sum() + 1) / (len(want) - want.sum() + 1))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(texts), BATCH)
            chosen = [texts[i] for i in pick]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in chosen])])
            grads = self._gradients(np.frombuffer(b"".join(chosen), np.uint8), offsets, want[pick])
            speed = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                change = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                self.w[k] -= (speed * change).astype(np.float32)
        return self


def held_out(doc_id, folds: int):
    """Whether a row lies in the fold that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = 5, sample: int = SAMPLE) -> Network:
    """A network fitted on the labels outside the held-out fold (of all, if ``folds`` is None)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if folds:
        rows = rows.where(~held_out(F.col("doc_id"), folds))
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(
        F.col("doc_id").alias("chosen_id"), F.col("quality").alias("good")
    )
    # At most `sample` narrow rows, so the broadcast is bounded.
    texts = docs.select(col(docs, "doc_id").alias("doc_id"), F.coalesce(col(docs, "text"), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    # Rows that repeat an id may be more than the sample; of these the first by id and text are taken.
    got = texts.select("doc_id", "text", "good").orderBy("doc_id", "text").limit(2 * sample).collect()
    return Network().fit([r["text"].encode() for r in got], [r["good"] for r in got])


def add_scores(docs: DataFrame, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a last column of scores, called ``score`` or longer if that is taken; one narrow pass over whole texts."""
    at, (score,) = docs.columns.index(text), fresh(docs, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in pieces(batches, at):
            found = network.score(*flat(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, score])

    return mapped(docs, run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = add_scores(docs.select("doc_id", "text"), network)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
