"""Finding benchmark items in training texts: BM25 retrieval with block-max WAND, then verification.

Test items are indexed in parts of at most ``PART`` words, with impacts divided
by the score that a passage must reach: ``SHARE`` of what the whole part would
score. Every text is a row of passages of two half windows, overlapping by one,
so any part that a text holds lies whole within some passage. All passages are
queries. The postings of a term lie in blocks of ``BLOCK`` parts on one grid, and
each block knows its greatest impact: a passage first adds the greatest impacts
of its terms, then those of each block, and only in blocks where the sum reaches
the threshold are postings read and scores taken. As sums of maxima are never
below a score, every pair above the threshold is found.

What is retrieved is verified near the place: of the item's question (its words
before the last sentences) and of its answer (the last sentences, a quarter of
the words at least) ``COVER`` of all word trigrams or more must occur, punctuation
left out.

The index is sent to the tasks in shards, a job over the texts for each, with counts of
terms taken over all items; so one shard is held at a time, by the driver and by a task. A shard has at most ``SHARD`` items, and ends with the
item that reaches ``SHARD_WORDS`` words. An item lies whole in one shard, since
verification needs all its places; it may be as long as a text may be.

Rules: words are lower-cased and parted by white space. Null and empty texts
hold no item; items without words or without an id are left out. Items that repeat an id are
indexed one by one, equal rows once; ids keep their type. Each row of the texts is judged by itself, so repeated rows
and null ids do no harm. Without items no text is contaminated. Extra columns
pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quireflow.llm.arrays import flat, pieces, run_hash, word_bounds
from quireflow.llm.common import col, documents, fresh, mapped, scratch, settle, words

K1, B = 1.2, 0.75
PART = 32
SHARE = 0.6
COVER = 0.5
BLOCK = 64
SHARD, SHARD_WORDS = 20_000, 1_000_000
# Scores are divided by the threshold, so this is the threshold, but for rounding.
ENOUGH = 1 - 1e-9
# How many sums by (passage, block) are held at once.
SUMS = 1 << 22


def _hash_words(ws: list[str]) -> np.ndarray:
    data = " ".join(ws).encode()
    data, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    begin, end, _ = word_bounds(data, offsets)
    return run_hash(data, begin, end)[0]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and those of it.

    A last sentence of under a quarter of the words takes the one before it as
    well, and so on; where no question is left, the words are halved.
    """
    whole = text.split()
    text, n, end = text.strip(), 0, None
    for m in reversed(list(re.finditer(r"[.!?]\s+|\n", text))):
        n += len(text[m.end() : end].split())
        end = m.end()
        if 4 * n > 3 * len(whole):
            break
        if n and 4 * n >= len(whole):
            return whole[:-n], whole[-n:]
    half = (len(whole) + 1) // 2
    return whole[:half], whole[half:]


class Index:
    """An impact-ordered inverted index of items' parts, in blocks, for one shard."""

    def __init__(self, items: list[tuple[int, str]], counts: dict[int, int], n_items: int):
        self.items = [(i, *question_and_answer(t)) for i, t in items]
        parts, lengths, owner = [], [], []
        for k, (_, q, a) in enumerate(self.items):
            ws = q + a
            for at in range(0, len(ws), PART):
                parts.append(np.unique(_hash_words(ws[at : at + PART]), return_counts=True))
                lengths.append(parts[-1][1].sum())
                owner.append(k)
        self.owner = np.array(owner, np.int64)
        mean = np.mean(lengths) if lengths else 1.0
        terms = [h for h, _ in parts]
        self.terms = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        df = np.array([counts.get(int(h.astype(np.int64)), 1) for h in self.terms], float)
        idf = np.log(1 + (n_items - np.minimum(df, n_items) + 0.5) / (np.minimum(df, n_items) + 0.5))
        rows = []
        for p, (h, tf) in enumerate(parts):
            t = np.searchsorted(self.terms, h)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[p] / mean))
            rows.append(np.stack([t, np.full(len(t), p), impact / (SHARE * impact.sum())]))
        at = np.concatenate(rows, 1) if rows else np.zeros((3, 0))
        order = np.lexsort((at[1], at[0]))
        term, part, self.impact = at[0][order].astype(np.int64), at[1][order].astype(np.int64), at[2][order]
        self.part = part
        n = len(self.terms)
        self.best = np.zeros(n)
        np.maximum.at(self.best, term, self.impact)
        # Blocks: runs of postings of one term within one block of parts.
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (part[1:] // BLOCK != part[:-1] // BLOCK)
        self.block_start = np.append(np.flatnonzero(new), len(term))
        self.block_no = part[self.block_start[:-1]] // BLOCK
        self.block_best = np.maximum.reduceat(self.impact, self.block_start[:-1]) if len(term) else np.zeros(0)
        self.blocks_of = np.searchsorted(term[self.block_start[:-1]], np.arange(n + 1))
        self.n_blocks = len(parts) // BLOCK + 1

    def search(self, passage: np.ndarray, term: np.ndarray):
        """(passage, part) of all scores at the threshold or above; the input pairs are distinct and in order."""
        alive = np.bincount(passage, self.best[term])[passage] >= ENOUGH if len(passage) else np.zeros(0, bool)
        passage, term = passage[alive], term[alive]
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else passage
        found = [(passage[:0], passage[:0])]
        # Sums by (passage, block) are a dense array, so few passages at a time if there are many blocks.
        step = max(1, SUMS // self.n_blocks)
        for at in range(0, len(first), step):
            own = slice(first[at], first[at + step] if at + step < len(first) else len(passage))
            names = passage[first[at : at + step]]
            number = np.searchsorted(names, passage[own])
            which, block = _expand(self.blocks_of[term[own]], self.blocks_of[term[own] + 1])
            place = number[which] * self.n_blocks + self.block_no[block]
            sums = np.bincount(place, self.block_best[block], len(names) * self.n_blocks)
            hot = np.flatnonzero(sums >= ENOUGH)
            nth = np.full(len(sums), -1)
            nth[hot] = np.arange(len(hot))
            kept = nth[place] >= 0
            which, posting = _expand(self.block_start[block[kept]], self.block_start[block[kept] + 1])
            slot = nth[place[kept]][which] * BLOCK + self.part[posting] % BLOCK
            hits = np.flatnonzero(np.bincount(slot, self.impact[posting], len(hot) * BLOCK) >= ENOUGH)
            at_block = hot[hits // BLOCK]
            found.append((names[at_block // self.n_blocks], at_block % self.n_blocks * BLOCK + hits % BLOCK))
        return tuple(np.concatenate(x) for x in zip(*found))

    def retrieve(self, hashes: np.ndarray, row: np.ndarray):
        """(row, first word of the passage, item) of all passages retrieved."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(hashes):
            return none, none, none
        first = np.searchsorted(row, np.arange(row[-1] + 2))
        halves = -(-np.diff(first) // PART)
        base = np.concatenate([[0], np.cumsum(halves + 1)])  # a spare half after each row
        half = base[row] + (np.arange(len(row)) - first[row]) // PART
        t = np.searchsorted(self.terms, hashes)
        t[t == len(self.terms)] = 0
        known = self.terms[t] == hashes
        key = _distinct(half[known] * len(self.terms) + t[known])
        half, t = key // len(self.terms), key % len(self.terms)
        # A passage is a half and the next one, so a half is in its own and in the one before.
        later = half > base[np.searchsorted(base, half, "right") - 1]
        both = _distinct(np.concatenate([key, key[later] - len(self.terms)]))
        passage, part = self.search(both // len(self.terms), both % len(self.terms))
        r = np.searchsorted(base, passage, "right") - 1
        return r, (passage - base[r]) * PART, self.owner[part]

    def verified(self, text: str, places: list[tuple[int, int]]) -> list[int]:
        """The ids of the items whose question and answer both stand near where they were found."""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        out, by_item = [], {}
        for w, k in places:
            by_item.setdefault(k, set()).add(w)
        for k in sorted(by_item):
            item, q, a = self.items[k]
            near = PART + len(q) + len(a)
            spans: list[list[int]] = []
            for at in sorted(by_item[k]):
                lo, hi = max(0, at - near), at + 2 * PART + near
                # Spans that share two words have no other trigrams when put together.
                if spans and lo <= spans[-1][1] - 2:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            seen = set()
            for lo, hi in spans:
                seen.update(_trigrams(ws[lo:hi]))
            if all(_covered(x, seen) for x in (q, a)):
                out.append(item)
        return out


def _trigrams(ws: list[str]) -> list[tuple]:
    """Runs of three words, punctuation left out."""
    ws = [re.sub(r"\W+", "", w) for w in ws]
    return [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]


def _covered(ws: list[str], seen: set) -> bool:
    """Whether enough trigrams are seen; fewer than three words have none to look for."""
    grams = _trigrams(ws)
    return sum(g in seen for g in grams) >= COVER * len(grams)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, in order."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _expand(start: np.ndarray, stop: np.ndarray):
    """For ranges: the number of the range, and each value in it."""
    size = stop - start
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


class Shards:
    """The items in shards of bounded size; one index at a time is made from them."""

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text"):
        lower = items.select(col(items, item_id).alias("id"), F.lower(F.coalesce(col(items, text), F.lit(""))).alias("text"))
        lower = lower.where(F.col("id").isNotNull() & (F.size(words(F.col("text"))) > 0))
        lower = lower.distinct().select("*", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("id", "text").alias("h"))
        self.n, total = lower.agg(F.count("*"), F.sum("size")).first()
        # Hashed ids fill shards unevenly, so half is aimed at, and what is above the bounds is cut off.
        slots = max(1, -(-self.n // max(1, SHARD // 2)), -(-(total or 0) // max(1, SHARD_WORDS // 2)))
        before = Window.partitionBy("slot").orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, -1)
        sharded = lower.withColumn("slot", F.pmod("h", F.lit(slots))).select(
            "id", "text", F.concat_ws(
                ":", "slot", F.floor(F.coalesce(F.count("*").over(before), F.lit(0)) / SHARD),
                F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / SHARD_WORDS),
            ).alias("shard"),
        )
        self.sharded = settle(sharded, "items")
        self.pairs = self.sharded.select("shard", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
        self.counted = settle(self.pairs.groupBy("word").agg(F.count("*").alias("df")), "terms")
        self.names = sorted(r["shard"] for r in self.sharded.select("shard").distinct().collect())

    def index(self, shard: str) -> Index:
        """The index of a shard, with counts of terms taken over all items."""
        own = self.sharded.where(F.col("shard") == shard).orderBy("id", "text").collect()
        mine = self.pairs.where(F.col("shard") == shard).select("word").distinct()
        counts = self.counted.join(mine, "word", "left_semi").collect()
        hashed = [int(_hash_words([r["word"]])[0].astype(np.int64)) for r in counts]
        return Index([(r["id"], r["text"]) for r in own], dict(zip(hashed, (r["df"] for r in counts))), self.n)


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The index of every shard, one after the other."""
    shards = Shards(items, item_id, text)
    for name in shards.names:
        yield shards.index(name)


def _hits(index: Index, batch: pa.RecordBatch, at: int) -> dict[int, list]:
    """The items that each row of a batch holds, by row; ``at`` is the place of the lower-cased texts."""
    data, offsets = flat(batch.column(at))
    begin, end, row = word_bounds(data, offsets)
    rows, first, item = index.retrieve(run_hash(data, begin, end)[0], row)
    places: dict[int, list] = {}
    for r, w, k in zip(rows.tolist(), first.tolist(), item.tolist()):
        places.setdefault(r, []).append((w, k))
    held = {r: index.verified(bytes(data[offsets[r] : offsets[r + 1]]).decode(), at) for r, at in places.items()}
    return {r: sorted(set(ids)) for r, ids in held.items() if ids}


def add_items(docs: DataFrame, items: DataFrame, text: str = "text", found: str = "items", item_id: str = "item_id") -> DataFrame:
    """``docs`` with the sorted ids of the items that each text holds, as ``found``, or a longer name if that is taken."""
    lower, row, of, found = fresh(docs, "lower", "row", "of", found)
    kind = T.ArrayType(items.schema[item_id].dataType)
    shards = Shards(items, item_id)
    lowered = F.lower(F.coalesce(col(docs, text), F.lit(""))).alias(lower)
    whole = [col(docs, c) for c in docs.columns]
    if not shards.names:
        return docs.withColumn(found, F.array().cast(kind))
    if len(shards.names) == 1:
        index, at = shards.index(shards.names[0]), len(docs.columns)

        def run(batches):
            for batch in pieces(batches, at):
                hits = _hits(index, batch, at)
                lists = pa.array([hits.get(r, []) for r in range(batch.num_rows)], batch.schema.field(at + 1).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], lists], batch.schema.names)

        out = docs.select(*whole, lowered).withColumn(found, F.array().cast(kind))
        return mapped(out, run, T.StructType(list(out.schema.fields))).drop(lower)

    # Several shards: a job for each, which keeps only what it found, so that one index is held at a time.
    named = settle(docs.select(*whole, F.monotonically_increasing_id().alias(row)), "texts")
    path = scratch(docs.sparkSession, "hits")
    schema = T.StructType([T.StructField(of, T.LongType()), T.StructField(found, kind)])

    def finder(index: Index):
        def run(batches):
            for batch in pieces(batches, 1):
                hits = _hits(index, batch, 1)
                at, lists = pa.array(list(hits), pa.int64()), pa.array(list(hits.values()), batch.schema.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), lists], [of, found])

        return run

    for shard in shards.names:
        texts = named.select(row, F.lower(F.coalesce(col(named, text), F.lit(""))), F.array().cast(kind))
        texts.mapInArrow(finder(shards.index(shard)), schema).write.mode("append").parquet(path)
    hits = docs.sparkSession.read.schema(schema).parquet(path)
    hits = hits.groupBy(of).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias(found))
    out = named.join(hits, F.col(row) == F.col(of), "left")
    return out.select(*[col(named, c) for c in docs.columns], F.coalesce(found, F.array().cast(kind)).alias(found))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the texts that hold an item."""
    out = add_items(docs, items, text)
    found = out.columns[-1]
    return out.where(F.size(found) == 0).drop(found)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whether it holds a benchmark item, and which."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = add_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items")
