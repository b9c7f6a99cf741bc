"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set: its shingles of five words, lower-cased, weighted
by their counts. Every shingle owns a strip of the plane (weight x time) on
which hashed darts fall as a Poisson process; the darts below its weight are
the document's. Each dart belongs to one of ``COORDINATES`` coordinates, and the
earliest of each is kept, so that two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Strips and times are parted
into cells that double in size, and a cell's darts depend on the shingle and the
cell alone, so only cells that matter are looked at.

Texts with the same words are one class before anything is compared. Bands of
equal coordinates put the others into buckets. In each bucket all are compared
with one member, drawn anew in every band, exactly and by their whole shingle
sets; classes are the components of links of ``SIMILARITY`` or more. Where a
bucket still holds several classes, its members are compared in blocks, by matrix
products within a task that emit only links between classes, so a link between
documents that share any band is never lost and pairs are never listed.

Rules: a document of fewer than five words has one shingle, all its words.
Documents without words, null texts too, are one class. Rows of one id are one
document. A row with a null id is alone in its class (null), and stays. The class id is
the least document id of the class; ids keep their type. An empty table gives an empty table. Extra
columns are ignored, and pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quireflow.llm.arrays import BASE, flat, mix, pieces, run_hash, word_bounds
from quireflow.llm.common import col, documents, fresh, settle

SHINGLE = 5
SIMILARITY = 0.8
# 24 bands of 5: a pair of similarity 0.8 is missed with a chance of 7e-5.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
# The width of the first time slab; slabs double.
FIRST_SLAB = 2.0**-7
# Documents, and shingles in all, of a block in which all are compared.
BLOCK_DOCS, BLOCK_ELEMENTS = 1024, 2 << 20
# Shingles whose counts are multiplied at once.
COLUMNS = 2048


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all words, and the row of each."""
    begin, end, row = word_bounds(data, offsets)
    return run_hash(data, begin, end)[0], row


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int = SHINGLE):
    """(hash, row) of every run of ``size`` words; a shorter row is one run."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    counts = np.diff(first)
    step = [mix(np.array([k + 1], np.uint64) * BASE)[0] for k in range(size)]
    at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += mix(hashes[at + k] ^ step[k])
    out, rows = [mix(total)], [row[at]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        total = np.full(len(short), n, np.uint64)
        for k in range(n):
            total += mix(hashes[first[short] + k] ^ step[k])
        out.append(mix(total))
        rows.append(short)
    return np.concatenate(out), np.concatenate(rows)


def weighted(hashes: np.ndarray, row: np.ndarray):
    """Distinct (hash, row) with counts, in order of row and hash."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def _poisson_steps(mean: float) -> np.ndarray:
    """P(count <= k), for k from 0 to far beyond the mean."""
    k = np.arange(1, int(mean + 12 * mean**0.5 + 20))
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    return np.cumsum(np.exp(logs - mean))


def dart_minhash(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures (n_rows x k) of weighted sets; a row without elements is all zero."""
    best = np.zeros(n_rows * k, np.uint64)
    # One entry for each element and each strip of weights that it reaches into.
    strips = np.floor(np.log2(np.maximum(weight, 1e-300) + 1)).astype(int)
    strips = np.where(2.0**strips - 1 < weight, strips + 1, strips).clip(1)
    which = np.repeat(np.arange(len(hashes)), strips)
    strip = np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)
    h, r, w = hashes[which], row[which], np.asarray(weight, float)[which]
    slab = 0
    while len(h):
        for s in np.unique(strip):
            of = np.flatnonzero(strip == s)
            seed = mix(h[of] ^ mix(np.array([(int(s) << 16) + slab + 1], np.uint64))[0])
            chance = (seed >> np.uint64(11)) * 2.0**-53
            steps = _poisson_steps(FIRST_SLAB * 2.0 ** (slab + int(s)))
            some = np.flatnonzero(chance >= steps[0])
            count = np.searchsorted(steps, chance[some], "right")
            src = np.repeat(some, count)
            nth = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(seed[src] + (nth + 1).astype(np.uint64) * BASE)
            more = mix(dart ^ BASE)
            height = 2.0 ** int(s) - 1 + 2.0 ** int(s) * ((more >> np.uint64(11)) * 2.0**-53)
            slot = r[of][src] * k + ((dart & np.uint64(0xFFFFFF)) % np.uint64(k)).astype(np.int64)
            keep = np.flatnonzero(height < w[of][src])
            if s == 0:
                slots, darts, times = [slot[keep]], [dart[keep]], [mix(more)[keep]]
            else:
                slots.append(slot[keep]), darts.append(dart[keep]), times.append(mix(more)[keep])
        slot, dart, time = np.concatenate(slots), np.concatenate(darts), np.concatenate(times)
        open_ = np.flatnonzero(best[slot] == 0)  # earlier slabs come first
        late_first = open_[np.argsort(time[open_])[::-1]]
        best[slot[late_first]] = dart[late_first] | np.uint64(1)
        unfilled = (best.reshape(n_rows, k) == 0).any(1)
        left = unfilled[r]
        h, r, w, strip = h[left], r[left], w[left], strip[left]
        slab += 1
    return best.reshape(n_rows, k)


def _signatures(batches):
    """(id, k1, k2, bands) per document: a 128-bit key of its words, and a hash of each band."""
    for batch in pieces(batches, 1):
        data, offsets = flat(batch.column(1))
        n = batch.num_rows
        begin, end, row = word_bounds(data, offsets)
        lanes = run_hash(data, begin, end, lanes=2)
        hashes = lanes[0]
        first = np.searchsorted(row, np.arange(n + 1))
        place = (np.arange(len(row)) - first[row]).astype(np.uint64)
        keys = []
        for salt, lane in zip((1, 2), lanes):
            scattered = mix(lane ^ mix(place * BASE + np.uint64(salt)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scattered, dtype=np.uint64)])
            keys.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
        h, r, w = weighted(*shingles(hashes, row, n))
        signed = dart_minhash(h, r, w, n).reshape(n, BANDS, ROWS)
        bands = np.zeros((n, BANDS), np.uint64)
        for j in range(ROWS):
            bands = mix(bands + signed[:, :, j] * BASE)
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * BASE).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[0]), pa.array(keys[1]), lists], ["id", "k1", "k2", "bands"])


def _elements(batches):
    """(id, elements) per document: a hash of every (shingle, how many times before)."""
    for batch in pieces(batches, 1):
        n = batch.num_rows
        h, r, w = weighted(*shingles(*word_hashes(*flat(batch.column(1))), n))
        which = np.repeat(np.arange(len(h)), w)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)
        values = mix(h[which] + nth.astype(np.uint64) * BASE).view(np.int64)
        ends = np.searchsorted(r[which], np.arange(n + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "elements"])


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the least id that it is connected with.

    Labels spread along links and then jump to their label's label, until none
    changes; each round is a table in the shared folder.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("n_id")).agg(F.min("label").alias("n_label"))
        spread = labels.join(near, F.col("id") == F.col("n_id")).select(
            "id", F.col("label").alias("old"), F.least("label", "n_label").alias("label")
        )
        jump = labels.select(F.col("id").alias("j_id"), F.col("label").alias("j_label"))
        new = spread.join(jump, F.col("label") == F.col("j_id")).select("id", "old", F.least("label", "j_label").alias("label"))
        new = settle(new, "labels")
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = elements.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    two = elements.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("common", common)
    union = F.size("ea") + F.size("eb") - F.col("common")
    return joined.where(F.col("common") >= F.lit(similarity) * union).select("a", "b")


def _with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    found = members.join(labels, members["doc"] == labels["id"], "left")
    return found.select("bucket", "doc", F.coalesce("label", "doc").alias("label"))


def _cross_links(labelled: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of one bucket (bucket, doc, label) whose labels differ.

    Buckets of several labels are compared in blocks: every two blocks of a
    bucket meet as one unit of bounded size, where shared elements are counted
    by a matrix product. Only links that join classes are emitted.
    """
    split = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("bucket")
    sized = elements.withColumnRenamed("id", "e_id").withColumn("size", F.size("elements"))
    rows = labelled.join(split, "bucket", "left_semi").join(sized, F.col("doc") == F.col("e_id")).drop("e_id")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int")
    large = labelled.join(sized.select("e_id", "size"), F.col("doc") == F.col("e_id")).groupBy("bucket").agg(parts.alias("parts"))
    rows = rows.join(large.where("parts > 1"), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    # A block meets itself and every other one; the unit is named by the two.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select(
        "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc", "label", "elements"
    )
    units = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc")

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for at, stop in zip(cuts, cuts[1:]):
                if at == stop:
                    continue
                if key is not None and tuple(keys[at]) != key:
                    yield from _unit_links(held, similarity)
                    held = []
                key = tuple(keys[at])
                held.append(batch.slice(at, stop - at))
        yield from _unit_links(held, similarity)

    return units.mapInArrow(run, "a bigint, b bigint").distinct()


def _unit_links(held: list[pa.RecordBatch], similarity: float):
    """Links that join different labels, among the documents of two blocks (or one)."""
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    doc, label = table.column("doc").to_numpy(), table.column("label").to_numpy()
    if len(np.unique(label)) < 2:
        return
    lists = table.column("elements").combine_chunks()
    size = np.asarray(lists.value_lengths())
    values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(doc)), size)
    # Elements of one document alone are in no intersection.
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    common = np.zeros((len(doc), len(doc)), np.float32)
    for at in range(0, int(number.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(number, [at, at + COLUMNS])
        grid = np.zeros((len(doc), COLUMNS), np.float32)
        grid[owner[lo:hi], number[lo:hi] - at] = 1
        common += grid @ grid.T
    union = size[:, None] + size[None, :] - common
    alike = (common >= np.float32(similarity) * union - 1e-3) & (label[:, None] < label[None, :])
    of: dict = {}

    def root(x):
        while of.get(x, x) != x:
            x = of[x]
        return x

    pairs = []
    for x, y in zip(*map(np.ndarray.tolist, np.nonzero(alike))):
        # The exact test once more, in whole numbers.
        both = int(common[x, y])
        if both < similarity * (int(size[x]) + int(size[y]) - both):
            continue
        p, q = root(int(label[x])), root(int(label[y]))
        if p != q:
            of[max(p, q)] = min(p, q)
            pairs.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): one row of every document id, and one of every row without an id."""
    kind = docs.schema[doc_id].dataType
    taken = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    none = F.lit(None).cast(kind)
    unnamed = taken.where("doc_id IS NULL").select(none.alias("doc_id"), none.alias("class_id"))
    if isinstance(kind, T.IntegralType):
        found = _classes(taken, similarity)
        return found.select(F.col("doc_id").cast(kind), F.col("class_id").cast(kind)).unionByName(unnamed)
    # Ids that are no whole numbers are numbered; the least id of a class then is looked up.
    names = taken.where("doc_id IS NOT NULL").select("doc_id").distinct().select("doc_id", F.monotonically_increasing_id().alias("n"))
    names = settle(names, "names")
    found = _classes(taken.join(names, "doc_id").select(F.col("n").alias("doc_id"), "text"), similarity)
    named = settle(found.join(names.withColumnRenamed("doc_id", "name"), F.col("doc_id") == F.col("n")).select("name", "class_id"), "named")
    least = named.groupBy(F.col("class_id").alias("of")).agg(F.min("name").alias("class_name"))
    out = named.join(least, F.col("class_id") == F.col("of"))
    return out.select(F.col("name").alias("doc_id"), F.col("class_name").alias("class_id")).unionByName(unnamed)


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, class_id) of every id, all whole numbers; null ids are left out."""
    lower = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    lower = lower.where("id IS NOT NULL")
    signed = settle(lower.mapInArrow(_signatures, "id bigint, k1 bigint, k2 bigint, bands array<bigint>"), "signatures")
    same = settle(signed.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("id").alias("n")), "same")

    rows = signed.join(same.select("first").distinct(), F.col("id") == F.col("first"), "left_semi")
    spread = rows.select(F.explode("bands").alias("bucket"), F.col("id").alias("doc"))
    crowded = spread.groupBy("bucket").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    members = settle(spread.join(crowded, "bucket", "left_semi").distinct(), "members")
    compared = lower.join(members.select("doc").distinct(), F.col("id") == F.col("doc"), "left_semi")
    elements = settle(compared.mapInArrow(_elements, "id bigint, elements array<bigint>"), "elements")

    # Everyone against one member of each bucket, drawn by a hash that the bucket salts.
    drawn = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc", "bucket").alias("h"), "doc")).alias("c"))
    pairs = members.join(drawn.select("bucket", F.col("c.doc").alias("centre")), "bucket").where("doc <> centre")
    pairs = settle(pairs.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct(), "pairs")
    links = settle(_verified(pairs, elements, similarity), "links")
    # A class of equal words is linked through its least id; ids with two texts join two such classes.
    copies = signed.join(same.where("n > 1"), ["k1", "k2"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    labels = components(links)

    # What the drawn members did not settle: members of one bucket and different classes.
    labelled = settle(_with_labels(members, labels), "labelled")
    more = settle(_cross_links(labelled, elements, similarity), "more")
    # Each class so far is a star around its label, which connects what its many links do.
    stars = labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    labels = components(stars.unionByName(more).unionByName(copies))
    ids = signed.select("id").distinct()
    found = ids.join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    return found.select(F.col("id").alias("doc_id"), F.coalesce("label", "id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every class, that of the least id; rows of null id stay."""
    (gone_id,) = fresh(docs, "gone_id")
    gone = near_classes(docs, doc_id, text).where("doc_id <> class_id").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, col(docs, doc_id) == F.col(gone_id), "left_anti")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class, and whether it is the one that stays."""
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
