"""Removing repeated byte strings by external induced suffix sorting.

Which strings can repeat at all is found first. In every string of ``LENGTH``
bytes the gram of ``GRAM`` bytes with the least hash is its anchor (the leftmost
of equals), so equal strings have equal anchors at equal offsets. Neighbouring
starts share an anchor; such a run of starts, with the bytes it covers, is a
piece. Only pieces whose anchor occurs again go on, and equal pieces are counted
and go on once, so that copies of a text, however many, are one.

Where an anchor has several pieces, they are put together in shards (all pieces
of an anchor in one) and their suffixes are sorted by induction: the leftmost
S-type suffixes are sorted by recursion on their names; all L-type and then all
S-type suffixes follow from them through queues by first symbol, which hold
tuples of place and common prefix, and write themselves to unlinked scratch
files beyond ``MEMORY`` bytes. Neighbours in suffix order with a common prefix of
``LENGTH`` or more are repeats. An anchor with one piece needs no sorting: that
piece repeats whole.

A shard has at most twice ``SHARD`` + ``HOT`` bytes. The pieces of an anchor that has more
than ``HOT`` are in no shard. Equal strings have equal offsets from the anchor, so
their starts are parted by ranges of offsets, and by the hash of the bytes that all
strings of a range cover; what is alone there cannot repeat. The strings of the rest
are hashed and counted over all tasks.

Rules: texts are UTF-8 bytes, a null text has none; matches never cross
documents; strings are judged on the input. Rows that repeat are documents like
any others, so both lose what they share. Null ids are ids. An empty table gives
an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quireflow.llm.arrays import flat, mix, pieces, prefix_sums, span_hash
from quireflow.llm.common import col, documents, settle

LENGTH = 200
GRAM = 32
# Bytes of pieces in a shard, as aimed at.
SHARD = 2 << 20
# Bytes that a task's queues hold in memory before they write to disk.
MEMORY = 256 << 20
# Distinct pieces of an anchor that have more bytes than this are counted, not sorted.
HOT = 2 << 20
# How many offsets from the anchor are in a range.
OFFSETS = 43
# Recursion ends in memory up to so many names, which is beyond any shard.
BASE = 1 << 22
# Pairs of suffixes from which a copy of the text as words of eight bytes pays.
MANY = 1 << 12
# Never a byte of UTF-8, so pieces parted by it share nothing across it.
PART = 0xFF


# -- anchors -------------------------------------------------------------------


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from two running minima over blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of starts with one anchor: (row, first start, last start, anchor hash, piece hash)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    bits = np.uint64(len(data).bit_length())
    packed = (hashes >> bits << bits) | at.astype(np.uint64)
    place = (_sliding_min(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    good = np.arange(len(place)) + length <= offsets[row + 1]
    new = good.copy()
    new[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
    first = np.flatnonzero(new)
    # A run ends before the next one, or at the last start of its row.
    last = np.minimum(np.append(first[1:], len(place)) - 1, offsets[row[first] + 1] - length)
    return row[first], first, last, hashes[place[first]], span_hash(sums, first, last + length)


def _anchor_rows(batches):
    """(id, th, starts, last, h, ph) of every text that is long enough."""
    for batch in pieces(batches, 2):
        data, offsets = flat(batch.column(2))
        row, first, last, h, ph = anchors(data, offsets)
        if not len(row):
            continue
        rows = np.unique(row)
        cuts = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
        lists = lambda a, t: pa.ListArray.from_arrays(pa.array(cuts), pa.array(a, t))
        taken = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(taken), batch.column(1).take(taken), lists((first - offsets[row]).astype(np.int32), pa.int32()),
                lists((last - offsets[row]).astype(np.int32), pa.int32()), lists(h.view(np.int64), pa.int64()),
                lists(ph.view(np.int64), pa.int64()),
            ],
            ["id", "th", "s1", "s2", "h", "ph"],
        )


# -- sorting -------------------------------------------------------------------


class Queue:
    """A first-in-first-out list of (place, common prefix) that can lie on disk.

    Induction pushes to each symbol in order, so queues by symbol together are a
    priority queue. The scratch file is unlinked as it is made.
    """

    held = 0  # bytes in the memory of all queues of this task

    def __init__(self):
        self.parts, self.size, self.file, self.read = [], 0, None, 0

    def push(self, places: np.ndarray, lcps: np.ndarray) -> None:
        if len(places):
            part = np.stack([places, lcps])
            Queue.held += part.nbytes
            self.parts.append(part)
            self.size += len(places)
            if Queue.held > MEMORY:
                self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for part in self.parts:
            self.file.write(part.T.tobytes())
            Queue.held -= part.nbytes
        self.parts = []

    def pull(self, most: int = 1 << 20):
        """The next tuples, or None."""
        if self.file:
            self.file.seek(self.read)
            got = np.frombuffer(self.file.read(16 * most), np.int64).reshape(-1, 2).T
            if got.size:
                self.read += 16 * got.shape[1]
                return got
            self.file.close()
            self.file, self.read = None, 0
        return self._held_parts()

    def _held_parts(self):
        """What lies in memory as one array, or None."""
        if not self.parts:
            return None
        part = np.concatenate(self.parts, 1)
        Queue.held -= part.nbytes
        self.parts = []
        return part

    def backwards(self, most: int = 1 << 20):
        """All tuples from the last to the first."""
        part = self._held_parts()
        if part is not None:
            yield part[:, ::-1]
        if self.file:
            end = self.file.seek(0, 2)
            while end > self.read:
                start = max(self.read, end - 16 * most)
                self.file.seek(start)
                yield np.frombuffer(self.file.read(end - start), np.int64).reshape(-1, 2).T[:, ::-1]
                end = start
            self.file.close()


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to ``most``."""
    n, out = len(text), np.zeros(len(a), np.int64)
    most_each = np.minimum(n - np.maximum(a, b), most)
    # Where pairs are many, bytes are compared eight at a time; what lies past the end is cut off at last.
    step = 8 if text.dtype == np.uint8 and most >= 8 and len(a) >= MANY else 1
    words = np.concatenate([text, np.zeros(most + step, text.dtype)]) if step == 8 else text
    if step == 8:
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, 8)).view("<u8")[:, 0]
    live = np.arange(len(a))
    for k in range(0, most, step):
        if step == 1:
            live = live[most_each[live] > k]
        x, y = words[a[live] + k], words[b[live] + k]
        same = x == y
        out[live[same]] = k + step
        if step == 8:
            # The first byte that differs has the lowest bit that does.
            last = (x ^ y)[~same]
            out[live[~same]] = k + (np.frexp((last & (~last + np.uint64(1))).astype(np.float64))[1] - 1) // 8
        live = live[same]
        if not len(live):
            break
    return np.minimum(out, most_each)


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the last one is not (it precedes only the end)."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    up = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(up, np.diff(ends, prepend=-1))


def induce(text, types, seeds, seed_lcps, most, visit):
    """All suffixes from the sorted leftmost S-type ones, greatest first.

    ``visit(places, lcps)`` gets them in turn; a common prefix is with the suffix
    visited before, and counts up to ``most``.
    """
    alphabet = np.unique(text)
    queues = {int(c): Queue() for c in alphabet}
    kept = {}
    by_symbol = np.searchsorted(text[seeds], alphabet), np.searchsorted(text[seeds], alphabet, "right")
    seed_range = {int(c): (int(i), int(j)) for c, i, j in zip(alphabet, *by_symbol)}

    def push(places, lcps, small, least, since):
        """Push what precedes each place, with 1 + the least common prefix since the last push to its queue."""
        before = places - 1
        symbols = text[before]
        fits = (before >= 0) & (types[before] == small)
        fits &= symbols <= text[places] if small else symbols >= text[places]
        index = np.flatnonzero(fits)
        target = symbols[index]
        order = np.argsort(target, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(target[order]) != 0])) if len(order) else []
        overall, seen = lcps.min(), []
        for e, f in zip(edges, [*edges[1:], len(order)]):
            at = index[order[e:f]]
            c = int(target[order[e]])
            # Least values over (previous push, this push], for each push.
            cuts = np.concatenate([[0], at[:-1] + 1])
            low = np.minimum.reduceat(lcps[: at[-1] + 1], cuts)
            low[0] = min(low[0], since.get(c, least[0]))
            queues[c].push(before[at], np.minimum(low + 1, most))
            tail = lcps[at[-1] + 1 :]
            since[c] = tail.min() if len(tail) else most
            seen.append(c)
        for c in since:
            if c not in seen:
                since[c] = min(since[c], overall)
        least[0] = min(least[0], overall)

    # L-type suffixes, least first. The end of the text, less than all, brings in the last suffix.
    since, least, previous = {}, [-1], None
    n = len(text)
    queues[int(text[-1])].push(np.array([n - 1]), np.array([0]))
    since[int(text[-1])] = 0
    for c in map(int, alphabet):
        store = kept[c] = Queue()
        fresh_bucket = True
        while (got := queues[c].pull()) is not None:
            places, lcps = got[0], got[1].copy()
            if fresh_bucket:
                lcps[0], fresh_bucket = 0, False
            store.push(places, lcps)
            previous = places[-1]
            push(places, lcps, False, least, since)
        i, j = seed_range[c]
        for at in range(i, j, 1 << 20):
            places, lcps = seeds[at : min(j, at + (1 << 20))], seed_lcps[at : min(j, at + (1 << 20))].copy()
            if at == i:
                lcps[0] = 0 if fresh_bucket else common_prefix(text, np.array([previous]), places[:1], most)[0]
            push(places, lcps, False, least, since)

    # S-type suffixes, greatest first; a common prefix is now with the greater neighbour.
    since, least = {}, [-1]
    queues = {int(c): Queue() for c in alphabet}
    for c in map(int, alphabet[::-1]):
        fresh_bucket, previous = True, None
        while (got := queues[c].pull()) is not None:
            places, lcps = got[0], got[1].copy()
            if fresh_bucket:
                lcps[0], fresh_bucket = 0, False
            visit(places, lcps)
            previous = places[-1]
            push(places, lcps, True, least, since)
        carry = None
        for part in kept[c].backwards():
            places = part[0]
            # What the store has with the lesser neighbour goes to that neighbour.
            lcps = np.concatenate([[0], part[1][:-1]])
            if carry is not None:
                lcps[0] = carry
            else:
                lcps[0] = 0 if fresh_bucket else common_prefix(text, np.array([previous]), places[:1], most)[0]
            carry = part[1][-1]
            visit(places, lcps)
            push(places, lcps, True, least, since)


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string of names in memory, by doubling."""
    n, rank, step = len(names), names.astype(np.int64), 1
    if n and (names.min() < 0 or names.max() >= n):
        rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)  # equal keys get equal ranks
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def leftmost(types: np.ndarray) -> np.ndarray:
    """The S-type places that follow an L-type one."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def sorted_seeds(text: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The leftmost S-type suffixes in order: their substrings by induction, equal ones by recursion."""
    places = leftmost(types)
    if len(places) < 2:
        return places
    is_seed = np.zeros(len(text), bool)
    is_seed[places] = True
    found = []
    unsorted = places[np.argsort(text[places], kind="stable")]
    induce(text, types, unsorted, np.zeros(len(places), np.int64), 1, lambda p, _: found.append(p[is_seed[p]]))
    order = np.concatenate(found)[::-1]
    # Names: equal for equal substrings, each up to and with the next seed.
    ends = np.append(places[1:], len(text) - 1)
    nth = np.zeros(len(text), np.int32)
    nth[places] = np.arange(len(places))
    nth = nth[order]
    size = ends[nth] - order + 1
    same = np.zeros(len(order), bool)
    like = np.flatnonzero(size[1:] == size[:-1]) + 1
    for k in range(int(size.max())):
        like = like[(k >= size[like]) | (text[np.minimum(order[like] + k, len(text) - 1)] == text[np.minimum(order[like - 1] + k, len(text) - 1)])]
        done = size[like] <= k + 1
        same[like[done]] = True
        like = like[~done]
        if not len(like):
            break
    same[1:] &= (order[1:] + size[1:] < len(text)) & (order[:-1] + size[:-1] < len(text))
    names = np.empty(len(order), np.int64)
    names[nth] = np.cumsum(~same) - 1
    if names.max() == len(names) - 1:
        return order
    return places[suffix_order(names)]


def suffix_order(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string of names, by recursion while it is large."""
    if len(names) <= BASE:
        return _doubled(names)
    types = s_types(names)
    seeds = sorted_seeds(names, types)
    found = []
    induce(names, types, seeds, np.zeros(len(seeds), np.int64), 1, lambda p, _: found.append(p))
    return np.concatenate(found)[::-1]


def repeated_starts(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the string of ``length`` bytes at each place also starts elsewhere in ``text``."""
    out = np.zeros(len(text), bool)
    if len(text) < 2:
        return out
    types = s_types(text)
    seeds = sorted_seeds(text, types)
    lcps = np.zeros(len(seeds), np.int64)
    if len(seeds) > 1:
        lcps[1:] = common_prefix(text, seeds[:-1], seeds[1:], length)
    last = [0]

    def visit(places, lcps):
        hit = lcps >= length
        out[places[hit]] = True
        out[np.concatenate([last, places[:-1]])[hit]] = True
        last[0] = places[-1]

    induce(text, types, seeds, lcps, length, visit)
    return out


def _sort_shard(table: pa.Table) -> pa.Table:
    """(h, ph, runs) of a shard's pieces: runs of repeated starts, from the piece's first."""
    table = table.combine_chunks()
    data, offsets = flat(table.column("piece"))
    n = table.num_rows
    many = table.column("n").to_numpy() > 1
    text = np.full(len(data) + n, PART, np.uint8)
    starts = offsets[:-1] + np.arange(n)
    text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    again = repeated_starts(text)
    runs = []
    for k in range(n):
        m = int(offsets[k + 1] - offsets[k]) - LENGTH + 1
        own = np.ones(m, bool) if many[k] else again[starts[k] : starts[k] + m]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        runs.append(edge.tolist())
    return pa.table({"h": table.column("h"), "ph": table.column("ph"), "runs": pa.array(runs, pa.list_(pa.int32()))})


# -- the job -------------------------------------------------------------------


def _cut(batches):
    """(h, ph, n, shard, piece) from texts with the pieces wanted of each."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        data, offsets = flat(batch.column(0))
        rows = [(p["h"], p["ph"], p["n"], p["shard"], bytes(data[o + p["s1"] : o + p["s2"] + LENGTH])) for o, ps in zip(offsets.tolist(), wanted) for p in ps]
        columns = list(zip(*rows)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["h", "ph", "n", "shard", "piece"])


def _ranges(batches):
    """(h, ph, n, s, e, w, sh) from (h, ph, n, piece): starts [s, e) of a range of offsets from the anchor.

    ``w`` is the hash of the bytes that every string of the range covers, ``sh`` that of all the starts' bytes.
    """
    for batch in pieces(batches, 3):
        data, offsets = flat(batch.column(3))
        sums, size = prefix_sums(data), np.diff(offsets)
        at = np.arange(len(data) - GRAM + 1)
        row = np.repeat(np.arange(batch.num_rows), size)[: len(at)]
        hit = np.flatnonzero(span_hash(sums, at, at + GRAM) == batch.column(0).to_numpy().view(np.uint64)[row])
        # The anchor is the leftmost of equals.
        place = hit[np.unique(row[hit], return_index=True)[1]]
        for low in range(0, LENGTH - GRAM + 1, OFFSETS):
            high = min(low + OFFSETS - 1, LENGTH - GRAM)
            first, last = np.maximum(offsets[:-1], place - high), np.minimum(offsets[1:] - LENGTH, place - low)
            k = np.flatnonzero(first <= last)
            w = mix(span_hash(sums, place[k] - low, place[k] - high + LENGTH) + np.uint64(low))
            sh = span_hash(sums, first[k], last[k] + LENGTH)
            start = offsets[:-1][k]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(k)) for i in range(3)), pa.array((first[k] - start).astype(np.int32)),
                    pa.array((last[k] + 1 - start).astype(np.int32)), pa.array(w.view(np.int64)), pa.array(sh.view(np.int64)),
                ],
                ["h", "ph", "n", "s", "e", "w", "sh"],
            )


def _string_hashes(batches):
    """(w, sh, n, i, x) from (w, sh, n, s, e, piece): the hash of each start's string, the first start being 0."""
    for batch in pieces(batches, 5):
        data, offsets = flat(batch.column(5))
        s, e = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        size = e - s
        row = np.repeat(np.arange(len(s)), size)
        i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        start = offsets[row] + s[row] + i
        x = span_hash(prefix_sums(data), start, start + LENGTH)
        taken = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(taken) for c in range(3)), pa.array(i.astype(np.int32)), pa.array(x.view(np.int64))], ["w", "sh", "n", "i", "x"]
        )


def _counted_repeats(cut: DataFrame) -> DataFrame:
    """(h, ph, runs) of the pieces of common anchors, a row for each range of offsets; no task holds an anchor."""
    parted = cut.select("h", "ph", "n", "piece").mapInArrow(
        _ranges, "h bigint, ph bigint, n bigint, s int, e int, w bigint, sh bigint"
    )
    parted = settle(parted, "ranges")
    alike = parted.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w")
    live = settle(parted.join(alike, "w", "left_semi"), "live-ranges")
    distinct = live.groupBy("w", "sh").agg(F.sum("n").alias("n"), F.min(F.struct("h", "ph", "s", "e")).alias("at"))
    own = distinct.select("w", "sh", "n", "at.*").join(cut.select("h", "ph", "piece"), ["h", "ph"])
    strings = own.select("w", "sh", "n", "s", "e", "piece").mapInArrow(_string_hashes, "w bigint, sh bigint, n bigint, i int, x bigint")
    strings = settle(strings, "strings")
    twice = strings.groupBy("x").agg(F.sum("n").alias("n")).where("n > 1").select("x")
    found = strings.join(twice, "x", "left_semi").groupBy("w", "sh").agg(F.collect_set("i").alias("is"))
    begin = F.array_sort(F.filter("is", lambda i: ~F.array_contains("is", i - 1)))
    end = F.array_sort(F.filter("is", lambda i: ~F.array_contains("is", i + 1)))
    runs = F.flatten(F.zip_with(begin, end, lambda a, b: F.array(F.col("s") + a, F.col("s") + b + 1)))
    return live.join(found, ["w", "sh"]).select("h", "ph", runs.alias("runs"))


def _removed(batches):
    """Each text's bytes without those that repeated starts cover; starts as ranges [from, to)."""
    for batch in pieces(batches, 1):
        data, offsets = flat(batch.column(1))
        out = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
        for k, ranges in enumerate(batch.column(2).to_pylist()):
            own = data[offsets[k] : offsets[k + 1]]
            step = np.zeros(len(own) + 1, np.int64)
            for r in ranges or ():
                step[r["a"]] += 1
                step[r["b"] - 1 + LENGTH] -= 1
            gone = np.cumsum(step)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            out["n_bytes"].append(len(own))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            out["kept"].append(own[~gone].tobytes())
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["doc_id", *out])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every document; spans are byte ranges removed."""
    taken = docs.select(
        col(docs, doc_id).cast("bigint").alias("id"), F.xxhash64(col(docs, text)).alias("th"), F.coalesce(col(docs, text), F.lit("")).alias("text")
    )
    listed = settle(
        taken.mapInArrow(_anchor_rows, "id bigint, th bigint, s1 array<int>, s2 array<int>, h array<bigint>, ph array<bigint>"), "anchors"
    )
    twice = listed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    runs = listed.select("id", "th", F.inline(F.arrays_zip("s1", "s2", "h", "ph")))
    hits = settle(runs.join(twice, "h", "left_semi"), "hits")
    counted = hits.groupBy("h", "ph").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "s1", "s2")).alias("at"))
    counted = settle(counted, "pieces")
    kinds = settle(counted.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.col("at.s2") - F.col("at.s1") + LENGTH).alias("size")), "kinds")
    hot = F.col("size") > HOT
    several = kinds.where("kinds > 1")
    size, hottest = several.agg(F.sum(F.when(~hot, F.col("size"))), F.max("size")).first()
    # Shards by hash, each cut where it has twice SHARD bytes.
    slots = 1 + (size or 0) // SHARD
    slot = F.pmod(F.xxhash64("h"), F.lit(slots))
    before = F.sum("size").over(Window.partitionBy(slot).orderBy("h")) - F.col("size")
    dealt = several.where(~hot).select("h", (F.floor(before / (2 * SHARD)) * slots + slot).alias("shard"))
    dealt = dealt.unionByName(several.where(hot).select("h", F.lit(None).cast("bigint").alias("shard")))
    one = counted.join(kinds.where("kinds = 1").select("h"), "h", "left_semi").where("n > 1")
    # A piece of the only kind repeats at every start.
    whole = one.select("h", "ph", F.array(F.lit(0), F.col("at.s2") - F.col("at.s1") + 1).alias("runs"))

    wanted = counted.join(dealt, "h").groupBy(F.col("at.id").alias("w_id"), F.col("at.th").alias("w_th")).agg(
        F.collect_list(F.struct("h", "ph", "n", "shard", F.col("at.s1").alias("s1"), F.col("at.s2").alias("s2"))).alias("ps")
    )
    same = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))
    found = taken.join(wanted, same).select("text", "ps")
    cut = settle(found.mapInArrow(_cut, "h bigint, ph bigint, n bigint, shard bigint, piece binary").dropDuplicates(["h", "ph"]), "cut")
    sorted_ = cut.where("shard is not null").groupBy("shard").applyInArrow(_sort_shard, "h bigint, ph bigint, runs array<int>")
    if (hottest or 0) > HOT:
        sorted_ = sorted_.unionByName(_counted_repeats(cut.where("shard is null")))
    again = settle(whole.unionByName(sorted_).where(F.size("runs") > 0), "repeated")

    edges = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(
        (F.col("s1") + F.get("runs", i)).alias("a"), (F.col("s1") + F.get("runs", i + 1)).alias("b")))
    ranges = hits.join(again, ["h", "ph"]).select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), F.explode(edges).alias("r"))
    ranges = ranges.groupBy("r_id", "r_th").agg(F.collect_set("r").alias("rs"))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))
    out = taken.join(ranges, same, "left").select("id", "text", "rs")
    return out.mapInArrow(_removed, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
