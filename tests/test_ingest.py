import pytest

from quireflow.operators import ingest
from quireflow.sources import tables

ROW = "row_number int, title string, notes_on_outline_before string"


def test_sheet_headers(spark, tmp_path):
    path = str(tmp_path / "sheet")
    (tmp_path / "sheet").mkdir()
    (tmp_path / "sheet" / "a.csv").write_text(
        'title,ROW_NUMBER, Notes_On_Outline_Before ,extra,title\nfirst,2,"line one\nline two",x,last\n,3,n,x,\n'
    )
    rows = tables.read_submissions(spark, path, multi_line=True).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [(2, "last", "line one\nline two"), (3, None, "n")]


def test_sheets_with_another_header_are_refused(spark, tmp_path):
    for name, text in (("a", "row_number,title\n2,x\n"), ("b", "title,row_number\ny,3\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(Exception, match="CSV header"):
        tables.read_submissions(spark, str(tmp_path)).collect()


def test_sheet_without_title_fails_before_any_job(spark):
    with pytest.raises(tables.MissingColumn, match="title"):
        tables.normalize_submissions(spark.createDataFrame([(1, "x")], "row_number int, name string"))


def test_sheet_without_notes_column_gives_empty_notes(spark):
    rows = tables.normalize_submissions(spark.createDataFrame([(2, "x")], "row_number int, Title string")).collect()
    assert rows[0]["notes_on_outline_before"] == ""


def test_plain_sheets_are_numbered_by_place(spark, tmp_path):
    """Over many splits of a file, and from 2 in every file."""
    for name, n in (("a", 500), ("b", 3)):
        (tmp_path / f"{name}.csv").write_text("Title,Notes_On_Outline_Before\n" + "".join(f"{name} {i},n{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = tables.read_submissions(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["title"], r["row_number"]) for r in rows) == sorted(
        (f"{name} {i}", i + 2) for name, n in (("a", 500), ("b", 3)) for i in range(n)
    )


def test_one_title_in_two_sheets_is_created_once(spark):
    rows = [(2, "A", "n"), (2, "a", "n"), (3, " a ", "n"), (2, "B", "n"), (2, "B", "n"), (2, "B", "n"), (4, "held", "n")]
    out = ingest.dedupe_submissions(spark.createDataFrame(rows, ROW), spark.createDataFrame([("Held",)], "title string"))
    got = [(r["title"].strip().lower(), r["label"]) for r in out.collect()]
    assert len(got) == 7 and sorted(t for t, label in got if label == "created") == ["a", "b"]


def test_long_ids_and_stamps(spark):
    from pyspark.sql import functions as F, types as T

    rows = spark.createDataFrame([("a|b", None), ("a", "b"), ("a", None)], "title string, notes_on_outline_before string")
    key = ["title", "notes_on_outline_before"]
    out = tables.append_with_defaults(rows, "books", key, T.LongType(), F.lit("2024-01-01").cast("timestamp")).collect()
    assert len({r["id"] for r in out}) == 3 and all(isinstance(r["id"], int) for r in out)
    assert all(r["created_at"] is not None and r["created_at"] == r["updated_at"] for r in out)


def test_clean_and_validate(spark):
    raw = spark.createDataFrame(
        [(2, " A\xa0", " n "), (3, None, "n"), (4, "", "n"), (5, "  ", "n"), (6, "B", "  "), (7, "C", None)], ROW
    )
    cleaned = ingest.clean_submissions(raw)
    rows = {r["row_number"]: r for r in ingest.validate_submissions(cleaned).collect()}
    assert set(rows) == {2, 5, 6, 7}
    assert rows[2]["title"] == "A" and rows[2]["notes_on_outline_before"] == "n" and rows[2]["_error"] is None
    assert rows[5]["title"] == ""
    assert rows[6]["_error"] == rows[7]["_error"] == ingest.MISSING_NOTES


def test_one_title_in_a_third_of_all_rows(spark):
    rows = [(i, "Hot Title" if i % 3 == 0 else f"t{i}", "n") for i in range(2, 602)]
    valid = spark.createDataFrame(rows, ROW)
    library = spark.createDataFrame([(" T4 ",), ("t4",)], "title string")
    got = {r["row_number"]: r["label"] for r in ingest.dedupe_submissions(valid, library).collect()}
    assert len(got) == 600
    assert got[3] == "created" and got[4] == "skipped" and got[6] == "skipped"
    assert sum(v == "created" for v in got.values()) == 1 + 400 - 1


def test_defaults_and_ids(spark):
    rows = spark.createDataFrame([("A", None), ("B", "yes")], "title string, status_outline_notes string")
    a, b = tables.append_with_defaults(rows, "books", ["title"]).orderBy("title").collect()
    assert a["status_outline_notes"] == "pending" and b["status_outline_notes"] == "yes"
    assert a["id"] and a["id"] != b["id"]
    again = tables.append_with_defaults(rows, "books", ["title"]).orderBy("title").first()
    assert again["id"] == a["id"]


def test_append_and_scan(spark, tmp_path):
    path = str(tmp_path / "books")
    rows = tables.append_with_defaults(spark.createDataFrame([("A",)], "title string"), "books", ["title"])
    tables.append(rows, path, "books")
    tables.append(rows, path, "books")
    back = tables.scan(spark, path, "books")
    assert back.count() == 2 and back.first()["book_output_status"] == "pending"


def test_cells_with_line_breaks_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,notes_on_outline_before\nfirst,"one\ntwo, ""so"""\nsecond,n\n')
    rows = tables.read_submissions(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [(2, "first", 'one\ntwo, "so"'), (3, "second", "n")]


def test_only_sheets_with_cells_over_lines_are_read_whole(spark, tmp_path):
    """Of two sheets one has a cell that goes over lines; names with blanks, a header alone, and rows in order."""
    folder = tmp_path / "two sheets"
    folder.mkdir()
    (folder / "a b.csv").write_text("title,notes_on_outline_before\n" + "".join(f'"T ""{i}""",n{i}\n' for i in range(50)))
    (folder / "c.csv").write_text('title,notes_on_outline_before\n"Over\nlines","x\n\ny"\nPlain,"1,2"\n')
    (folder / "d.csv").write_text("title,notes_on_outline_before\n")
    kinds = tables._by_kind(spark, str(folder))
    assert [(kind, [f.rsplit("/", 1)[1] for f in files]) for kind, files in kinds] == [(False, ["a b.csv", "d.csv"]), (True, ["c.csv"])]
    rows = sorted(tuple(r) for r in tables.read_submissions(spark, str(folder)).collect())
    want = [(i + 2, f'T "{i}"', f"n{i}") for i in range(50)] + [(2, "Over\nlines", "x\n\ny"), (3, "Plain", "1,2")]
    assert rows == sorted(want)


def test_headers_that_disagree_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,notes_on_outline_before\nA,n\n")
    (tmp_path / "b.csv").write_text('notes_on_outline_before,title\n"n\nn",B\n')
    with pytest.raises(Exception, match="header|schema"):
        tables.read_submissions(spark, str(tmp_path)).collect()
