import csv
import io
import random
import zipfile

from crawlquarry.sources import csv_files as C
from crawlquarry.streaming.landing import land


def test_split_records_like_a_csv_reader():
    rng = random.Random(3)
    rows = [["Address", "Title", "x"]] + [[f"https://a.test/{k}", "".join(rng.choice('a",\n\r é') for _ in range(rng.randrange(12))), ""] for k in range(300)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    lines = C.split_records(out.getvalue().encode())
    assert [next(csv.reader([x], strict=True)) if "\n" not in x and "\r" not in x else None for x in lines] == [r if "\n" not in r[1] and "\r" not in r[1] else None for r in rows]
    assert len(lines) == len(rows)


def test_ranges_give_the_records_of_the_whole_file(spark, tmp_path):
    rng = random.Random(5)
    rows = [["Address", "Title"]] + [[f"https://a.test/{k}", "".join(rng.choice('ab",\n;') for _ in range(rng.randrange(40)))] for k in range(400)]
    path = tmp_path / "big.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    want = list(enumerate(C.split_records(path.read_bytes()), 1))
    for size in (97, 1000, 5000, 1 << 20):
        got = sorted((r.line_no, r.raw_line) for r in C.records(spark, [str(path)], size).collect())
        assert got == want, size


def test_import(spark, tmp_path):
    (tmp_path / "one.csv").write_text('"All pages"\nAddress,Title 1,Meta Description 1,Word Count,Other\nhttps://a.test/,Home,,"1,200",z\n,x,,,\nhttps://a.test/b,B,,,\n')
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("deep/er/two.CSV", "﻿url;Meta Description;Status Code\nhttps://a.test/;About us;200\nhttps://a.test/c;C;9999\n")
        z.writestr("readme.md", "x")
    i = C.Ingest(spark, [str(tmp_path / n) for n in ("one.csv", "notes.txt", "broken.zip", "two.zip", "lost.csv")])
    pages = {r.url: r for r in i.pages().collect()}
    assert set(pages) == {"https://a.test/", "https://a.test/b"}
    home = pages["https://a.test/"]
    assert (home.title, home.meta_description, home.word_count, home.status_code) == ("Home", "About us", 1200, 200)
    assert {r.reason for r in i.faulty().collect()} == {"invalid_value"}
    assert sorted(r.file_name for r in i.warnings.collect()) == ["broken.zip", "lost.csv", "notes.txt"]
    assert [r.name for r in i.unknown_columns().collect()] == ["other"]
    assert i.summary().first().status == "PARTIAL"
    assert C.discover(str(tmp_path)) == [str(tmp_path / "one.csv")]
    assert C.discover(str(tmp_path / "missing")) == []


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Address\nhttps://a.test/\nnonsense\n")
    q = land(spark, str(tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.url for r in spark.read.parquet(str(tmp_path / "rows")).collect()] == ["https://a.test/"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_a_lost_quotation_mark_costs_one_line(spark, tmp_path):
    """An unclosed quote in line 3 of a thousand; later quotes, and quoted line breaks, are read as they stand."""
    rows = ["Address,Title,Words"] + [f'https://a.test/{k},"Title {k}",{k}' if k % 9 else f'https://a.test/{k},"Title\n{k}",{k}' for k in range(1000)]
    rows[3] = 'https://a.test/2,"Title 2,2'
    rows[500] = 'https://a.test/499,"Title ""499,499'
    rows[-1] = 'https://a.test/999,"open at the end,1'
    path = tmp_path / "x.csv"
    path.write_text("\n".join(rows) + "\n")
    assert C.split_records(path.read_bytes()) == rows
    for size in (64, 700, 1 << 20):
        assert [r.raw_line for r in C.records(spark, [str(path)], size).orderBy("line_no").collect()] == rows, size
    i = C.Ingest(spark, [str(path)])
    assert i.rows().count() == 997 and {(r.line_no, r.reason) for r in i.faulty().collect()} == {(4, "quoting"), (501, "quoting"), (1001, "quoting")}


def test_random_quotes_don_t_depend_on_ranges(spark, tmp_path):
    rng = random.Random(8)
    path = tmp_path / "r.csv"
    path.write_text("URL;T\n" + "".join(rng.choice('aa";;\n\n\r') for _ in range(3000)))
    want = list(enumerate(C.split_records(path.read_bytes()), 1))
    for size in (31, 200, 1111):
        assert sorted((r.line_no, r.raw_line) for r in C.records(spark, [str(path)], size).collect()) == want, size


def test_the_header_may_be_far_down_and_headers_keep_their_spelling(spark, tmp_path):
    (tmp_path / "far.csv").write_text("".join(f"note {k}, with, commas\n" for k in range(60_000)) + 'URL;Own Column\nhttps://a.test/;"x\ny"\n')
    assert C._layout(str(tmp_path / "far.csv"), (tmp_path / "far.csv").stat().st_size) == (";", 2)
    i = C.Ingest(spark, [str(tmp_path / "far.csv")], header_within=None)
    assert i.rows().first().extra == {"Own Column": "x\ny"}
    assert C.Ingest(spark, [str(tmp_path / "far.csv")]).rows().count() == 0  # not in the first five records
    (tmp_path / "none.csv").write_text("")
    assert C.records(spark, [str(tmp_path / "none.csv")]).count() == 0


def test_export_and_order(spark, tmp_path):
    df = spark.createDataFrame([(f, f"n{f}", k, "Address,Title" if k == 1 else f"https://a.test/{k % 3},{f}-{k}") for f in (1, 2, 3) for k in range(1, 8)], "file_id bigint, name string, line_no int, raw_line string")
    paths = C.export(df.repartition(5), str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["n1.csv", "n2.csv", "n3.csv"] and sum(C.sizes(paths).values()) == sum(len(r.raw_line) + 1 for r in df.collect())
    pages = {r.url: r.title for r in C.Ingest(spark, paths[::-1]).pages().collect()}
    assert pages == {"https://a.test/2": "3-2", "https://a.test/0": "3-3", "https://a.test/1": "3-4"}  # the first file given comes first
