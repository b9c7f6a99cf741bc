"""Incremental ingest, notifications and progress on file streams.

What a stream remembers is keyed state in Spark's state store, partitioned by
key and kept on disk (RocksDB), so a batch looks up and changes the keys that it
touches, and reads nothing else, however long the stream has run. The store is
versioned by batch: a batch that is replayed after a failure starts from the
state before it.

A stream's rows and its state's answers to them are one streaming DataFrame, a
union of two branches of the same source (see ``_answered``). A batch of it is
written once, under its own ``batch_id`` directory in overwrite mode, and what
comes of it is made from that table, by the operators of the batch jobs. So
lineage never crosses a batch and nothing is added twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quireflow.functions.text import has, title_key
from quireflow.operators.ingest import clean_submissions, dedupe_submissions, validate_submissions
from quireflow.operators.mutations import latest_by_key
from quireflow.operators.notify import notification_messages
from quireflow.operators.rollups import PROGRESS
from quireflow.schemas import EVENT_TYPES

SEQ_BLOCK = 4096
SNAPSHOT_EVERY = 32
# Chapter numbers whose newest rows are one entry of the state.
SEGMENT = 64
# Entries of a change feed's state, which its keys share; a stream's checkpoint goes with the number.
GROUPS = 1 << 14
BUCKETS = 16
STORE = "spark.sql.streaming.stateStore"
# A store that keeps its rows on disk and uploads what a batch has changed.
STATE_STORE = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
BOOK_PATHS = ("output_docx_path", "output_pdf_path", "output_txt_path")


def _fs(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _exists(spark: SparkSession, path: str) -> bool:
    fs, there = _fs(spark, path)
    return fs.exists(there)


class State:
    """Rows by batch, in buckets by a hash of their key, folded into snapshots.

    A batch reads the last snapshot before it and the batches since, whose
    folders follow from its number alone, and of these the buckets it touches.
    Nothing lists or reads the whole history, and a folder that is missing fails
    the batch. The interval of snapshots is stored with the state, so a restart
    with another setting goes on with the stored one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], every: int, compact):
        self.path, self.keys, self.compact = path, keys, compact
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        self.columns = schema.names
        if not _exists(spark, f"{path}_settings"):
            spark.range(1).select(F.lit(every).alias("every")).write.parquet(f"{path}_settings")
        self.every = spark.read.parquet(f"{path}_settings").first()["every"]

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int"))

    def _save(self, rows: DataFrame, path: str, batch_id: int) -> None:
        rows = self._bucketed(rows.select(self.columns)).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={batch_id}")

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        parts = [spark.read.schema(self.schema).parquet(f) for f in folders]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def folders(self, batch_id: int) -> list[str]:
        """Where the state before a batch lies."""
        last = batch_id // self.every * self.every - 1
        recent = [f"{self.path}/batch_id={b}" for b in range(last + 1, batch_id)]
        return recent + ([f"{self.path}_snapshots/batch_id={last}"] if last >= 0 else [])

    def earlier(self, spark: SparkSession, batch_id: int, touched: DataFrame | None = None) -> DataFrame:
        """Rows of the batches before this one, in the buckets of the keys touched."""
        rows = self._read(spark, self.folders(batch_id))
        if touched is not None:
            # At most BUCKETS numbers come to the driver.
            wanted = [r["bucket"] for r in self._bucketed(touched).select("bucket").distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted))
        return rows.select(self.columns)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's rows; every so many batches, fold the state so far."""
        spark = rows.sparkSession
        self._save(rows, self.path, batch_id)
        if (batch_id + 1) % self.every == 0:
            mine = self._read(spark, [f"{self.path}/batch_id={batch_id}"]).select(self.columns)
            self._save(self.compact(self.earlier(spark, batch_id).unionByName(mine)), f"{self.path}_snapshots", batch_id)

    def current(self, spark: SparkSession) -> DataFrame:
        """The state after the last batch, from the last snapshot on."""
        snapshots, last = f"{self.path}_snapshots", -1
        if _exists(spark, snapshots):
            fs, there = _fs(spark, snapshots)
            last = max(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(there) if "=" in f.getPath().getName())
        after = last + 1
        while _exists(spark, f"{self.path}/batch_id={after}"):
            after += 1
        folders = [f"{self.path}/batch_id={b}" for b in range(last + 1, after)]
        return self.compact(self._read(spark, folders + ([f"{snapshots}/batch_id={last}"] if last >= 0 else [])).select(self.columns))


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state on disk; the session's own setting comes back after."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(rows: DataFrame, handle, checkpoint: str, mode: str = "append") -> StreamingQuery:
    with _state_store(rows.sparkSession):
        started = rows.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
        return started.trigger(availableNow=True).start()


def _answered(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows and the state's answers as one stream; ``_answer`` tells them apart."""
    return rows.withColumn("_answer", F.lit(False)).unionByName(answers.withColumn("_answer", F.lit(True)), allowMissingColumns=True)


def _arrived(batch: DataFrame, path: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """A batch's rows and answers, run once: the write is what moves the state on."""
    _write(batch, path, batch_id)
    written = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch_id={batch_id}")
    return written.where(~F.col("_answer")), written.where("_answer")


def _as_key(keys: list[str]) -> Column:
    """A row's key as text, whatever its types; nulls are keys too."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")


def _library_keys(spark: SparkSession, library: DataFrame, path: str) -> DataFrame:
    """The title keys of the library as a stream; those that a start finds new are added to it."""
    keys = library.select(title_key(F.col("title")).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    if _exists(spark, path):
        keys = keys.join(spark.read.schema(keys.schema).parquet(path), "_key", "left_anti")
    keys.write.mode("append").parquet(path)
    return spark.readStream.schema(keys.schema).parquet(path)


def stream_submissions(source: DataFrame, library: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Clean, validate and deduplicate submissions as they arrive.

    The state counts, for every title, its valid rows so far and whether the library holds it. A
    title whose rows so far are all in this batch is new, and is created by its first row. The library
    enters the state with the first batch; no later batch reads it, or any earlier title that it does not repeat.

    Results go to ``out/submissions`` (with ``_error`` and ``label``), new
    title keys to ``out/keys``.
    """
    spark = source.sparkSession
    checked = validate_submissions(clean_submissions(source)).withColumn("_key", title_key(F.col("title")))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    seen = checked.where(F.col("_error").isNull()).select("_key", one.alias("_rows"), none.alias("_held"))
    held = _library_keys(spark, library, f"{out}/library").select("_key", none.alias("_rows"), one.alias("_held"))
    counted = seen.unionByName(held).groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.sum("_held").alias("_held"))
    columns = ["row_number", "title", "notes_on_outline_before"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows, answers = _arrived(batch, f"{out}/arrived", batch_id)
        valid = rows.where(F.col("_error").isNull())
        here = valid.groupBy("_key").agg(F.count(F.lit(1)).alias("_here"))
        old = answers.select("_key", "_rows", "_held").join(here, "_key").where("_held > 0 OR _rows > _here")
        labelled = dedupe_submissions(valid.select(columns), old.select(F.col("_key").alias("title")))
        labelled = labelled.withColumn("_error", F.lit(None).cast("string"))
        invalid = rows.where(F.col("_error").isNotNull()).select(*columns, "_error", F.lit("invalid").alias("label"))
        _write(labelled.unionByName(invalid), f"{out}/submissions", batch_id)
        written = batch.sparkSession.read.parquet(f"{out}/submissions/batch_id={batch_id}")
        _write(written.where("label = 'created'").select(title_key(F.col("title")).alias("title")), f"{out}/keys", batch_id)

    return _start(_answered(checked, counted.where("_rows > 0")), handle, checkpoint, "update")


def transitions(changes: DataFrame, keys: list[str], value: str, block: int = SEQ_BLOCK) -> DataFrame:
    """Changes whose value differs from the one before, by sequence number.

    ``lag`` runs inside blocks of sequence numbers; the value a block starts
    from is the last one of the block before, taken from one row per key and
    block. A key with very many changes is spread over its blocks, by a stated
    layout: an earlier join by key would otherwise serve the window as well.
    """
    rows = changes.withColumn("_block", F.floor(F.col("seq") / block)).repartition(*keys, "_block")
    inside = Window.partitionBy(*keys, "_block").orderBy("seq")
    local = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_prev", F.lag(value).over(inside))
    lasts = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(value), F.col("seq")).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    starts = lasts.select(*keys, "_block", F.lag("_last").over(across)[value].alias("_start"))
    return (
        local.join(starts, [*keys, "_block"], "left")
        .withColumn("previous", F.when(F.col("_n") == 1, F.col("_start")).otherwise(F.col("_prev")))
        .where(~F.col(value).eqNullSafe(F.col("previous")))
        .drop("_block", "_n", "_prev", "_start")
    )


def notifying_events(changes: DataFrame) -> DataFrame:
    """Chapter transitions as notification events; others are dropped.

    A chapter that has been generated waits for notes if its notes_status
    asks for review, and is simply ready otherwise; an error stops the book.
    """
    event = (
        F.when((F.col("status") == "generated") & (F.col("notes_status") == "yes"), EVENT_TYPES[1])
        .when(F.col("status") == "generated", EVENT_TYPES[2])
        .when(F.col("status") == "error", EVENT_TYPES[4])
    )
    return changes.withColumn("event_type", event).where(F.col("event_type").isNotNull())


def book_events(changes: DataFrame) -> DataFrame:
    """The furthest point a book has reached, as an event; NULL before its outline."""
    paths = [F.col(c) for c in BOOK_PATHS if c in changes.columns]
    compiled = F.coalesce(*[F.when(has(p), F.lit(True)) for p in paths], F.lit(False))
    event = (
        F.when(F.col("book_output_status") == "completed", EVENT_TYPES[5])
        .when(compiled, EVENT_TYPES[3])
        .when(has(F.col("outline")), EVENT_TYPES[0])
    )
    return changes.withColumn("event_type", event)


def _moves(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The keys and sequence numbers at which values change; the state is each key's last number and value."""
    held = {k: (seq, value) for k, seq, value in zip(*state.get)} if state.exists else {}
    rows: dict[tuple[str, int], str | None] = {}
    for part in batches:
        rows.update(zip(zip(part["_key"].tolist(), part["seq"].tolist()), part["_value"].tolist()))
    moved, changed = [], False
    for key, seq in sorted(rows):
        known, last = held.get(key, (None, None))
        if known is None or seq > known:
            value = rows[key, seq]
            if value != last:
                moved.append((key, seq))
            held[key], changed = (seq, value), True
    if changed:
        seqs, values = zip(*held.values())
        state.update((list(held), list(seqs), list(values)))
    if moved:
        yield pd.DataFrame(moved, columns=["_key", "seq"])


def _change_stream(source, out, checkpoint, keys, columns, value, to_events, books) -> StreamingQuery:
    """Events for rows of a change feed whose ``value`` differs from the one before.

    The state holds a number and a value for each key. Keys share ``GROUPS`` entries of the state by
    hash, so a batch makes at most so many calls, however many keys it has, and one that touches few keys
    reads and writes their entries only. Python sees the key, number and value of
    a row; the rows themselves meet its answers by key and number.
    """
    rows = value(source).select(*columns, "_value", _as_key(keys)).where(F.col("seq").isNotNull())
    group = F.pmod(F.xxhash64("_key"), F.lit(GROUPS)).alias("_group")
    told = rows.select(group, "_key", F.col("seq").cast("bigint").alias("seq"), "_value")
    kind = "keys array<string>, seqs array<bigint>, last array<string>"
    moved = told.groupBy("_group").applyInPandasWithState(
        _moves, "_key string, seq bigint", kind, "append", GroupStateTimeout.NoTimeout
    )
    kept = rows.drop("_value")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows, answers = _arrived(batch, f"{out}/arrived", batch_id)
        # A change that came twice in a batch is one.
        changes = rows.join(answers.select("_key", "seq"), ["_key", "seq"], "left_semi").dropDuplicates(["_key", "seq"])
        made = to_events(changes.select(kept.drop("_key").columns))
        if books is not None:
            made = with_messages(made, books)
        wanted = dict.fromkeys(["event_type", *columns, *(["message"] if books is not None else [])])
        _write(made.select(*wanted), f"{out}/events", batch_id)

    return _start(_answered(kept.withColumn("seq", F.col("seq").cast("bigint")), moved), handle, checkpoint)


def with_messages(events: DataFrame, books: DataFrame) -> DataFrame:
    """Events with the message that each is to send."""
    if "chapter_number" in events.columns:
        events = events.withColumn(
            "error", F.concat(F.lit("Chapter "), F.col("chapter_number").cast("string"), F.lit(" could not be written."))
        )
    paths = [c for c in BOOK_PATHS if c in events.columns]
    if paths:
        kind = lambda c: F.lit(c.removeprefix("output_").removesuffix("_path"))
        listed = F.array(*[F.when(has(F.col(c)), F.struct(kind(c).alias("format"), F.col(c).alias("path"))) for c in paths])
        events = events.withColumn("paths", F.filter(listed, lambda p: p.isNotNull()))
    return notification_messages(events, books)


def stream_transitions(source: DataFrame, out: str, checkpoint: str, books: DataFrame | None = None) -> StreamingQuery:
    """Notification events for chapters entering a notifying state.

    ``source`` has seq, book_id, chapter_number, status, notes_status. A
    change is ignored if its sequence number is not above the last one
    known for its chapter, or if it has none. Events go to ``out/events``, with their messages if
    ``books`` is given.
    """
    keys = ["book_id", "chapter_number"]
    columns = ["seq", *keys, "status", "notes_status"]
    value = lambda rows: rows.withColumn("_value", F.col("status"))
    return _change_stream(source, out, checkpoint, keys, columns, value, notifying_events, books)


def stream_book_transitions(source: DataFrame, out: str, checkpoint: str, books: DataFrame | None = None) -> StreamingQuery:
    """Notification events for books that get an outline, are compiled, or completed.

    ``source`` has seq, book_id, outline, book_output_status and any of the
    output paths. Otherwise as ``stream_transitions``. Of an outline only its presence goes on.
    """
    paths = [c for c in BOOK_PATHS if c in source.columns]
    columns = ["seq", "book_id", "event_type", "book_output_status", *paths]
    reached = lambda rows: book_events(rows).withColumn("_value", F.col("event_type"))
    named = lambda rows: rows.where(F.col("event_type").isNotNull())
    return _change_stream(source, out, checkpoint, ["book_id"], columns, reached, named, books)


class Chained:
    """Two streams of which the second reads what the first has written; started one after the other."""

    def __init__(self, first: StreamingQuery, then: Callable[[], StreamingQuery | None]):
        self.running, self.then = first, then

    def awaitTermination(self) -> None:  # noqa: N802
        """Waits for both; an error of either is raised."""
        self.running.awaitTermination()
        if self.then is not None:
            self.running, self.then = self.then() or self.running, None
            self.running.awaitTermination()

    def stop(self) -> None:
        self.then = None
        self.running.stop()


def _flags() -> Column:
    """What a chapter counts for, in bits: written, approved, waiting for review."""
    return (
        F.when(has(F.col("content")), 1).otherwise(0)
        + F.when(F.col("status") == "approved", 2).otherwise(0)
        + F.when(F.col("notes_status") == "yes", 4).otherwise(0)
    ).cast("bigint")


def _newest_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest row of each chapter among those at hand, so that a chapter with very many changes is few rows."""
    for rows in batches:
        yield rows.sort_values("seq", kind="stable").drop_duplicates(["_key", "chapter"], keep="last")


def _counts(flags: np.ndarray) -> np.ndarray:
    """The counts of ``PROGRESS`` over chapters of these flags."""
    full, approved, waiting = (np.count_nonzero(flags & bit) for bit in (1, 2, 4))
    return np.array([len(flags), full, approved, len(flags) - full, waiting])


def _deltas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What new rows change in the counts of some chapters of a book.

    The state is the newest number and flags of each of these chapters, ``SEGMENT`` at most.
    """
    before = np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(-1, 3)
    held = {chapter: (seq, flags) for chapter, seq, flags in before.tolist()}
    changed = False
    for rows in batches:
        for chapter, seq, flags in zip(*(rows[c].tolist() for c in ("chapter", "seq", "flags"))):
            if chapter not in held or seq > held[chapter][0]:
                held[chapter], changed = (seq, flags), True
    if changed:
        after = np.array([(c, *v) for c, v in held.items()], np.int64)
        state.update((after.tobytes(),))
        yield pd.DataFrame([[key[0], *(_counts(after[:, 2]) - _counts(before[:, 2]))]], columns=["_key", *PROGRESS])


def _progress_state(spark: SparkSession, out: str, every: int = SNAPSHOT_EVERY, book_id: T.DataType | None = None) -> State:
    kinds = [T.StructField("batch", T.LongType()), T.StructField("book_id", book_id or T.LongType())]
    schema = T.StructType(kinds + [T.StructField(c, T.LongType()) for c in PROGRESS])
    return State(spark, f"{out}/progress", schema, ["book_id"], every, lambda rows: latest_by_key(rows, ["book_id"], ["batch"]))


def stream_progress(source: DataFrame, out: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> Chained:
    """Progress counts kept current as chapter changes arrive.

    ``source`` has seq, book_id, chapter_number, content, status and
    notes_status. The first stream's state holds the newest number and three flags of each chapter, in
    segments of ``SEGMENT`` chapter numbers, and a change gives what its row adds to the counts of the book less
    what the replaced row had added, to ``out/deltas``. The second adds these up by book in its own state. So a
    batch reads and writes the segments and counts that it touches, however long a book is. The new counts of
    the touched books go to ``out/progress``; ``current_progress`` reads them. A change without a number is older
    than any other.
    """
    spark, book_id = source.sparkSession, source.schema["book_id"].dataType
    low = F.lit(-(1 << 63))
    chapter = F.col("chapter_number").cast("bigint")
    place = F.struct("book_id", F.floor(chapter / SEGMENT).alias("segment"))
    told = source.select(
        F.to_json(place, {"ignoreNullFields": "false"}).alias("_key"),
        F.coalesce(chapter, low).alias("chapter"),
        F.coalesce(F.col("seq").cast("bigint"), low).alias("seq"),
        _flags().alias("flags"),
    )
    newest = told.mapInPandas(_newest_here, told.schema).groupBy("_key")
    kind = ", ".join(["_key string", *[f"{c} bigint" for c in PROGRESS]])
    changed = newest.applyInPandasWithState(_deltas, kind, "chapters binary", "append", GroupStateTimeout.NoTimeout)
    book = F.from_json("_key", T.StructType([T.StructField("book_id", book_id)]))["book_id"].alias("book_id")
    deltas = changed.select(book, *PROGRESS)
    with _state_store(spark):
        # The file sink commits a batch's files as one, and once.
        sink = deltas.writeStream.format("parquet").option("path", f"{out}/deltas").option("checkpointLocation", f"{checkpoint}/chapters")
        first = sink.outputMode("append").trigger(availableNow=True).start()

    def then() -> StreamingQuery | None:
        if not _exists(spark, f"{out}/deltas"):
            return None  # no changes so far
        progress = _progress_state(spark, out, snapshot_every, book_id)
        added = spark.readStream.schema(deltas.schema).parquet(f"{out}/deltas").groupBy("book_id").agg(*[F.sum(c).alias(c) for c in PROGRESS])

        def handle(batch: DataFrame, batch_id: int) -> None:
            progress.write(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

        return _start(added, handle, f"{checkpoint}/books", "update")

    return Chained(first, then)


def current_progress(spark: SparkSession, out: str, book_id: T.DataType | None = None) -> DataFrame:
    """The newest counts of every book the stream has seen."""
    return _progress_state(spark, out, book_id=book_id).current(spark).select("book_id", *PROGRESS)
