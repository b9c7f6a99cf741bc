import random

import pytest
from pyspark.sql import functions as F

from quireflow.operators import rollups
from quireflow.operators.mutations import latest_by_key
from quireflow.streaming import streams

SUB = "row_number int, title string, notes_on_outline_before string"
CHG = "seq long, book_id long, chapter_number int, content string, status string, notes_status string"


def feed(spark, folder, rows, schema, cuts):
    """Write rows as one file per slice; files are read one per batch."""
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_submissions_in_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (i + 2, rng.choice(["Hot", " hot ", f"Title {rng.randint(0, 30)}", None, " "]), rng.choice(["n", "n", None]))
        for i in range(120)
    ]
    library = spark.createDataFrame([("title 3",)], "title string")
    source = feed(spark, tmp_path / "in", rows, SUB, [0, 10, 50, 90, 120])
    out = str(tmp_path / "out")
    streams.stream_submissions(source, library, out, f"{out}/cp").awaitTermination()
    got = spark.read.parquet(f"{out}/submissions")
    usable = [r for r in rows if r[1]]
    assert got.count() == len(usable)
    created = [r["title"].strip().lower() for r in got.where("label = 'created'").collect()]
    wanted = {r[1].strip().lower() for r in usable if r[2]} - {"title 3"}
    assert sorted(created) == sorted(wanted)
    keys = [r["title"] for r in spark.read.parquet(f"{out}/keys").collect()]
    assert sorted(keys) == sorted(wanted)


def test_submissions_restart_and_replay_add_nothing_twice(spark, tmp_path):
    rows = [(i + 2, f"T{i % 7}", "n") for i in range(40)]
    library = spark.createDataFrame([], "title string")
    out = str(tmp_path / "out")
    source = feed(spark, tmp_path / "in", rows[:20], SUB, [0, 10, 20])
    streams.stream_submissions(source, library, out, f"{out}/cp").awaitTermination()
    source = feed(spark, tmp_path / "in", rows[20:], SUB, [0, 10, 20])
    streams.stream_submissions(source, library, out, f"{out}/cp").awaitTermination()
    first = spark.read.parquet(f"{out}/submissions")
    assert first.count() == 40
    assert first.where("label = 'created'").count() == 7
    # Replay everything into the same folders, as after a lost checkpoint.
    source = spark.readStream.schema(SUB).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_submissions(source, library, out, f"{out}/cp2").awaitTermination()
    again = spark.read.parquet(f"{out}/submissions")
    assert again.count() == 40
    assert again.where("label = 'created'").count() == 7


def changes(seed, n=200):
    """A third of all changes hit one chapter; some come late or twice."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        book, number = (1, 1) if seq % 3 == 0 else (rng.randint(1, 4), rng.randint(1, 3))
        status = rng.choice(["generated", "error", "approved", "reviewed"])
        rows.append((seq, book, number, rng.choice([None, "", "x"]), status, rng.choice(["yes", "pending"])))
    return rows


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_transitions_equal_brute_force(spark, block):
    rows = changes(1)
    df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), CHG)
    got = {r["seq"] for r in streams.transitions(df, ["book_id", "chapter_number"], "status", block).collect()}
    last, want = {}, set()
    for seq, book, number, _, status, _ in rows:
        if last.get((book, number)) != status:
            want.add(seq)
        last[book, number] = status
    assert got == want


def test_transition_stream_ignores_late_and_repeated_changes(spark, tmp_path):
    rows = changes(4)
    late = [rows[0], rows[5]]
    fed = rows[:60] + rows[60:120] + late + rows[110:]
    source = feed(spark, tmp_path / "in", fed, CHG, [0, 60, 122, len(fed)])
    out = str(tmp_path / "out")
    streams.stream_transitions(source, out, f"{out}/cp").awaitTermination()
    got = {(r["seq"], r["event_type"]) for r in spark.read.parquet(f"{out}/events").collect()}
    last, want = {}, set()
    for seq, book, number, _, status, review in rows:
        if last.get((book, number)) != status:
            if status == "generated":
                want.add((seq, "waiting_chapter_notes" if review == "yes" else "chapter_ready"))
            elif status == "error":
                want.add((seq, "error_pause"))
        last[book, number] = status
    assert got == want
    assert spark.read.parquet(f"{out}/events").count() == len(want)


@pytest.mark.parametrize("every", [2, 32])
def test_progress_stream_equals_batch(spark, tmp_path, every):
    rows = changes(6)
    source = feed(spark, tmp_path / "in", rows, CHG, [0, 50, 51, 140, 200])
    out = str(tmp_path / "out")
    streams.stream_progress(source, out, f"{out}/cp", snapshot_every=every).awaitTermination()
    df = spark.createDataFrame(rows, CHG)
    batch = rollups.chapter_counts(latest_by_key(df, ["book_id", "chapter_number"], ["seq"]))
    columns = ["book_id", *rollups.PROGRESS]
    got = sorted(tuple(r) for r in streams.current_progress(spark, out).select(columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())


def test_two_sheets_in_one_batch_create_a_title_once(spark, tmp_path):
    for title in ("A", "a"):
        spark.createDataFrame([(2, title, "n")], SUB).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SUB).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.stream_submissions(source, spark.createDataFrame([], "title string"), out, f"{out}/cp").awaitTermination()
    got = spark.read.parquet(f"{out}/submissions")
    assert got.count() == 2 and got.where("label = 'created'").count() == 1


def test_lost_state_fails(spark, tmp_path):
    import shutil

    rows = [(i + 2, f"T{i}", "n") for i in range(30)]
    library = spark.createDataFrame([], "title string")
    out = str(tmp_path / "out")
    source = feed(spark, tmp_path / "in", rows[:20], SUB, [0, 10, 20])
    streams.stream_submissions(source, library, out, f"{out}/cp").awaitTermination()
    shutil.rmtree(f"{out}/cp/state")
    source = feed(spark, tmp_path / "in", rows[20:], SUB, [0, 10])
    with pytest.raises(Exception, match="STATE_STORE|state"):
        streams.stream_submissions(source, library, out, f"{out}/cp").awaitTermination()


def test_the_interval_of_snapshots_is_kept_and_a_lost_one_fails(spark, tmp_path):
    import shutil

    rows, out = changes(3, 40), str(tmp_path / "out")
    for k, every in ((0, 2), (1, 7), (2, 7)):
        source = feed(spark, tmp_path / "in", rows[k * 10 : k * 10 + 10], CHG, [0, 10])
        streams.stream_progress(source, out, f"{out}/cp", snapshot_every=every).awaitTermination()
    assert spark.read.parquet(f"{out}/progress_settings").first()["every"] == 2
    streams.current_progress(spark, out).collect()
    shutil.rmtree(f"{out}/progress_snapshots/batch_id=1")
    source = feed(spark, tmp_path / "in", rows[30:], CHG, [0, 10])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        streams.stream_progress(source, out, f"{out}/cp").awaitTermination()


def test_batches_read_what_they_touch_and_no_history(spark, tmp_path):
    """Over 20 equal batches of new titles, rows handled in a batch stay the same; the library is read once."""
    library = spark.createDataFrame([(f"held {i}",) for i in range(500)], "title string")
    out = str(tmp_path / "out")
    rows = [(i + 2, f"title {i}" if i % 10 else "Held 7", "n") for i in range(400)]
    source = feed(spark, tmp_path / "in", rows, SUB, list(range(0, 401, 20)))
    query = streams.stream_submissions(source, library, out, f"{out}/cp")
    query.awaitTermination()
    runs = [p for p in query.recentProgress if p["numInputRows"]]
    # Both branches read a batch's 20 rows; the first batch has the library's keys as well.
    assert [p["numInputRows"] for p in runs] == [540] + [40] * 19
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in runs] == [518] + [19] * 19
    kept = [spark.read.parquet(f"{out}/arrived/batch_id={k}").count() for k in range(20)]
    assert kept == [39] * 20
    got = spark.read.parquet(f"{out}/submissions")
    assert got.where("label = 'created'").count() == 360 and got.count() == 400


def test_progress_batches_touch_their_segments_only(spark, tmp_path):
    """One book of 300 chapters in 5 segments; a batch that changes two chapters handles one segment and one count."""
    rows = [(i, 1, i, "x", "generated", "pending") for i in range(300)]
    rows += [(300, 1, 5, None, "approved", "yes"), (301, 1, 7, "x", "approved", "pending"), (302, 1, 7, "x", "approved", "pending")]
    source = feed(spark, tmp_path / "in", rows, CHG, [0, 300, 303])
    out = str(tmp_path / "out")
    first = streams.stream_progress(source, out, f"{out}/cp")
    chapters = first.running
    first.awaitTermination()
    assert spark.read.parquet(f"{out}/deltas").count() == 6
    runs = [p["stateOperators"][0]["numRowsUpdated"] for p in chapters.recentProgress if p["numInputRows"]]
    assert runs == [5, 1]
    assert [tuple(r) for r in streams.current_progress(spark, out).collect()] == [(1, 300, 299, 2, 1, 1)]


def test_library_titles_added_between_runs_count(spark, tmp_path):
    out, none = str(tmp_path / "out"), spark.createDataFrame([], "title string")
    source = feed(spark, tmp_path / "in", [(2, "A", "n")], SUB, [0, 1])
    streams.stream_submissions(source, none, out, f"{out}/cp").awaitTermination()
    source = feed(spark, tmp_path / "in", [(3, "b", "n"), (4, "c", "n"), (5, "a ", "n")], SUB, [0, 3])
    library = spark.createDataFrame([("B",), ("A",), (None,)], "title string")
    streams.stream_submissions(source, library, out, f"{out}/cp").awaitTermination()
    got = {r["row_number"]: r["label"] for r in spark.read.parquet(f"{out}/submissions").collect()}
    assert got == {2: "created", 3: "skipped", 4: "created", 5: "skipped"}


def test_book_transitions_keep_no_outline(spark, tmp_path):
    schema = "seq long, book_id long, outline string, book_output_status string, output_pdf_path string"
    rows = [(1, 1, None, "x", None), (2, 1, "long", "x", None), (3, 1, "longer", "x", None), (4, 1, "l", "x", "p"), (5, 1, None, "x", None),
            (6, 1, "l", "completed", "p"), (7, None, "l", "x", None), (None, 1, "l", "x", None)]
    source = feed(spark, tmp_path / "in", rows, schema, [0, 2, 3, 8])
    out = str(tmp_path / "out")
    streams.stream_book_transitions(source, out, f"{out}/cp").awaitTermination()
    got = spark.read.parquet(f"{out}/events")
    assert "outline" not in got.columns and "outline" not in spark.read.parquet(f"{out}/arrived").columns
    assert sorted((r["seq"], r["event_type"]) for r in got.collect()) == [
        (2, "outline_ready"), (4, "final_draft_ready"), (6, "book_completed"), (7, "outline_ready")
    ]


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType())])
    state = streams.State(spark, str(tmp_path / "s"), schema, ["k"], 32, lambda rows: rows)
    state.write(spark.range(500).toDF("k"), 0)
    read = state.earlier(spark, 1, spark.range(1).toDF("k"))
    assert 0 < read.count() < 100 and state.earlier(spark, 1).count() == 500
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString()


def test_keys_of_a_change_feed_share_entries_of_the_state(spark, tmp_path, monkeypatch):
    """Calls and entries of the state do not grow with the chapters; a chapter's changes are its own."""
    monkeypatch.setattr(streams, "GROUPS", 8, raising=False)
    rng = random.Random(3)
    rows = [(i, i * 7 % 40, i % 4, None, rng.choice(["generated", "error", "approved", None]), "yes") for i in range(600)]
    rows.append((600, None, None, None, "generated", "yes"))
    source = feed(spark, tmp_path / "in", rows, CHG, [0, 200, 201, 400, len(rows)])
    out = str(tmp_path / "out")
    query = streams.stream_transitions(source, out, f"{out}/cp")
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    last, want = {}, []
    for seq, book, number, _, status, _ in rows:
        if last.get((book, number)) != status and status in ("generated", "error"):
            want.append(seq)
        last[book, number] = status
    assert sorted(r["seq"] for r in spark.read.parquet(f"{out}/events").collect()) == want


def test_larger_tables_are_fed_in_more_files(spark, tmp_path, monkeypatch):
    from catalog import queries

    spark.range(400).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "FILE_ROWS", 20, raising=False)
    out = tmp_path / "out"
    queries._fed(spark, str(tmp_path), "events", "event_id", str(out))
    assert len(list((out / "in").glob("*.parquet"))) == 4 * 5
    # Rows that crowd at one end: the smallest batch sets the number.
    spark.range(400).select((F.col("id") * F.col("id") * F.col("id")).alias("event_id")).write.parquet(str(tmp_path / "odd" / "events.parquet"))
    fed = queries._fed(spark, str(tmp_path / "odd"), "events", "event_id", f"{out}2")
    query = fed.writeStream.format("memory").queryName("fed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("fed").count() == 400 and [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [252, 65, 46, 37]
