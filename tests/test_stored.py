"""Chapters stored in buckets: patches equal those on whole tables, and touch what they name only."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quireflow.operators import generate, mutations
from quireflow.plans import stages
from quireflow.sources.stored import ChapterStore
from test_generate import Picky, as_of, tables

ROW = "id long, book_id long, chapter_number int, title string, content string, summary string, notes string, notes_status string, status string"


def rows(n=60):
    return [(i, i // 6, i % 6, f"t{i}", None if i % 4 == 0 else ("" if i % 5 == 0 else f"c{i}"), None if i % 3 else f"s{i}", None, "pending", "pending") for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    df = spark.createDataFrame(rows(), ROW)
    return df, ChapterStore.create(df, str(tmp_path / "chapters"), 8)


def same(one, two, columns):
    assert sorted(map(repr, one.select(columns).collect())) == sorted(map(repr, two.select(columns).collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_stored_reads_back(store):
    df, stored = store
    same(stored.chapters(), df, df.columns)
    flags = {r["id"]: r["has_content"] for r in stored.state().collect()}
    assert flags == {r[0]: bool(r[4]) for r in rows()}


def test_patches_equal_those_on_the_table(spark, store):
    df, stored = store
    patch = [
        (1, "new", None, True, True, "generated"), (2, None, "kept out", True, False, "x"), (4, "first", "s", True, True, "generated"),
        (5, "ignored", "only this", False, True, None), (999, "nobody", "n", True, True, "y"),
    ]
    patches = spark.createDataFrame(patch, "id long, content string, summary string, set_content boolean, set_summary boolean, status string")
    stored.patch(patches)
    want = mutations.patch_rows(df, patches)
    same(stored.chapters(), want, df.columns)
    more = spark.createDataFrame([(1, None), (4, "again"), (7, "")], "id long, content string")
    stored.patch(more)
    want = mutations.patch_rows(want, more)
    same(stored.chapters(), want, df.columns)
    flags = {r["id"]: r["has_content"] for r in stored.state().collect()}
    assert flags == {r["id"]: bool(r["content"]) for r in want.collect()}
    compacted = stored.compact(stored.path + "-2", 3)
    same(compacted.chapters(), want, df.columns)
    stored.patch(more.where("false"))
    same(stored.chapters(), want, df.columns)


def test_a_patch_leaves_other_buckets_and_all_texts_alone(spark, store):
    _, stored = store
    before = files(stored.path)
    bucket = stored.state().where("id = 9").first()["bucket"]
    stored.patch(spark.createDataFrame([(9, "approved")], "id long, status string"))
    after = files(stored.path)
    gone, kept = set(before) - set(after), {f for f in before if before[f] == after.get(f)}
    assert all(f"/state/bucket={bucket}/" in f for f in gone) and len(gone) == 1
    assert kept == set(before) - gone
    plan = stored.patched(spark.createDataFrame([(9, "x")], "id long, status string"), [bucket])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and not re.search(r"[\[,](content|summary)#", plan)


def test_stage_on_stored_chapters_equals_the_stage(spark, tmp_path):
    books, chapters = tables(spark)
    for auto in (False, True):
        stored = ChapterStore.create(chapters, str(tmp_path / f"chapters-{auto}"), 4)
        news = stages.write_stored_chapters(books, stored, Picky, as_of(), auto)
        want, want_news = stages.chapter_batch(books, chapters, Picky, as_of(), auto)
        same(stored.chapters(), want, [c for c in want.columns if c not in ("id", "has_content")])
        same(news, want_news, want_news.columns)


def test_generation_carries_the_id(spark):
    books = spark.createDataFrame([(1, "A", "o")], "id long, title string, outline string")
    chapters = spark.createDataFrame([("x", 1, 1, "t", None, None)], "id string, book_id long, chapter_number int, title string, summary string, notes string")
    plan = chapters.select("book_id", "chapter_number", F.lit("generate").alias("work"))
    made = generate.generate_by_number(plan, books, chapters, generate.DigestBackend, carry=("id",)).collect()
    assert [r["id"] for r in made] == ["x"]
