import datetime as dt

from crawlquarry.operators import drift as D
from pyspark.sql import functions as F

DAY = dt.datetime(2025, 1, 1)


def drifted(spark, files, rows):
    f = spark.createDataFrame([(i, s, DAY + dt.timedelta(days=n), h, "x") for i, s, n, h in files], "file_id bigint, series_id string, exported_at timestamp, headers array<string>, name string")
    r = spark.createDataFrame([(i, n, c, "x") for i, n, c in rows], "file_id bigint, row_no int, cells array<string>, name string")
    return D.Drift(f, r)


def kinds(d):
    return {(r.file_id, r.change_kind, r.column_name) for r in d.changes().collect()}


U = [f"https://a.test/{k}" for k in range(6)]


def test_changes(spark):
    files = [(1, "s", 1, ["﻿Address", "Status  Code", "Title", "Depth", "Blank"]), (2, "s", 2, ["URL", "HTTP", "title", "Words", "Blank"]), (3, "t", 1, ["Address"])]
    rows = [(1, n, [u, str(200 + n), f"T{n}", str(n), None]) for n, u in enumerate(U)] + [(2, n, [u + " ", f"HTTP/{200 + n}", f"t{n}", str(100 + n), ""]) for n, u in enumerate(U)] * 2
    d = drifted(spark, files, rows)
    assert kinds(d) == {(2, "renamed", "url"), (2, "renamed", "http"), (2, "type_changed", "http"), (2, "removed", "depth"), (2, "added", "words")}
    assert {(r.name, r.field) for r in d.lineage().where("series_id = 's'").collect()} >= {("url", "url"), ("address", "url"), ("http", "status_code"), ("status code", "status_code")}
    out = d.table().where("file_id = 2 and row_no = 3").first()
    assert (out.url, out.status_code, out.status_code_as, out.title, out.word_count) == (U[3], 203, "text", "t3", 103)


def test_kinds(spark):
    files = [(1, "s", 1, ["Address", "a", "b", "c"]), (2, "s", 2, ["Address", "a", "b", "c"])]
    rows = [(1, n, [u, "1", "+2", " "]) for n, u in enumerate(U)] + [(2, n, [u, "1" if n else "1.5", "2" if n else "x", "5"]) for n, u in enumerate(U)]
    assert kinds(drifted(spark, files, rows)) == {(2, "type_changed", "a"), (2, "type_changed", "b")}
    appeared = {r.column_name: sorted(r.appeared) for r in drifted(spark, files, rows).changes().collect()}
    assert appeared == {"a": ["decimal"], "b": ["text"]}


def test_blank_files_and_empty_tables(spark):
    assert kinds(drifted(spark, [], [])) == set()
    files = [(1, "s", 1, ["Address", "x", None]), (2, "s", 2, None), (3, None, 1, ["q", "q"])]
    rows = [(1, 1, ["https://a.test/"]), (1, 2, None), (9, 1, ["lost"]), (3, 1, ["1", "2", "3"])]
    assert kinds(drifted(spark, files, rows)) == {(2, "removed", "address"), (2, "removed", "x"), (2, "removed", "")}


def test_canonical(spark):
    cells = ["HTTP/301", " 301 ", "301.0", "1,234", "12+", "404 Not Found", "Yes", "Tent 12, deal", "", None, "0.50"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(D.canonical(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == ["301", "301", "301", "1234", "12", "404", "true", "tent 12, deal", None, None, "0.5"]


def test_conflicts_are_split_into_branches(spark):
    cells = ["12", "12.0", "12.7", "+5", "1,200", "12 words", "many", "", None, "99999999999999999999"]
    files = [(1, "s", 1, ["Address", "Word Count"])]
    d = drifted(spark, files, [(1, n, [f"https://a.test/{n}", c]) for n, c in enumerate(cells)])
    got = {r.row_no: r for r in d.table().collect()}
    assert [got[n].word_count for n in range(len(cells))] == [12, 12, None, 5, 1200, 12, None, None, None, None]
    assert [got[n].word_count_as for n in range(len(cells))] == ["integer", "decimal", "decimal", "integer", "text", "text", "text", None, None, "integer"]
    assert {n: r.unread for n, r in got.items() if r.unread} == {2: {"word_count": "12.7"}, 6: {"word_count": "many"}, 9: {"word_count": "99999999999999999999"}}
    assert (got[0].word_count_integer, got[2].word_count_decimal, got[5].word_count_text, got[5].word_count_integer) == (12, 12.7, "12 words", None)


def test_long_lines_of_renames_are_one_column(spark):
    n = 40
    files = [(k, "s", k, ["Address", f"Name {k}"]) for k in range(n)] + [(100 + k, "t", k, ["Address", ["Title 1", "Heading", "Title 1"][k]]) for k in range(3)]
    rows = [(k, i, [u, f"v{i}"]) for k in [*range(n), 100, 101, 102] for i, u in enumerate(U)]
    got = {(r.series_id, r.name): r.field for r in drifted(spark, files, rows).lineage().collect()}
    assert {f for (s, name), f in got.items() if s == "s" and name != "address"} == {"name 0"} and got["t", "heading"] == "title"
