"""The record tokenizer against a plain state machine, and its cases."""

import csv
import datetime as dt
import io

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlquarry.operators import bad_records as B

SCHEMA = "file_id bigint, project_id string, line_no int, raw_line string, loaded_at timestamp, reason string"
T0 = dt.datetime(2025, 1, 1)


def slow(line: str, sep: str):
    """Fields, or None where the quoting is broken, one character at a time."""
    fields, buf, state = [], [], "start"
    for c in line:
        if state == "start":
            if c == '"':
                state = "quoted"
            elif c == sep:
                fields.append("")
            else:
                buf.append(c)
                state = "plain"
        elif state == "plain":
            if c == '"':
                return None
            if c == sep:
                fields.append("".join(buf))
                buf, state = [], "start"
            else:
                buf.append(c)
        elif state == "quoted":
            if c == '"':
                state = "closed"
            else:
                buf.append(c)
        elif c == '"':
            buf.append('"')
            state = "quoted"
        elif c == sep:
            fields.append("".join(buf))
            buf, state = [], "start"
        else:
            return None
    return None if state == "quoted" else [*fields, "".join(buf)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='a",;é\n ', max_size=40), st.sampled_from([",", ";"])), min_size=1, max_size=12))
def test_tokenizer_equals_a_plain_machine(records):
    t = B.tokenize([x.encode() for x, _ in records], [s for _, s in records])
    for r, (line, sep) in enumerate(records):
        want = slow(line, sep)
        assert bool(t["broken"][r]) == (want is None)
        if want is None:
            assert t["offset"][r] >= 0
        else:
            assert [t["field"](r, k) for k in range(int(t["fields"][r]))] == want


def test_chunk_size_does_not_matter():
    rng = np.random.default_rng(1)
    classes = rng.choice([B.OTHER, B.QUOTE, B.SEP, B.END], 5000, p=[0.6, 0.2, 0.15, 0.05]).astype(np.uint8)
    want, s = [], B.START
    for c in classes:
        s = B.STEP[c][s]
        want.append(s)
    for chunk in (1, 2, 7, 64, 256, 9000):
        assert B.states(classes, chunk).tolist() == want


def test_round_trip_with_a_csv_writer():
    rows = [["a", 'he said "x"', "l1\nl2", "", "c,d"], ["", "", "", "", ""]]
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        t = B.tokenize([out.getvalue().encode()], [","])
        assert [t["field"](0, k) for k in range(5)] == row


def frame(spark, rows):
    return spark.createDataFrame([(f, "p", n, line, T0, "mine") for f, n, line in rows], SCHEMA)


def reasons(df):
    return {(r.file_id, r.line_no): r.reason for r in B.faulty(df).collect()}


def test_reasons(spark):
    rows = [
        (1, 1, '"Internal: all pages"'), (1, 2, "﻿Address;Status Code;Word Count"), (1, 3, "https://a.test/;200;1,234"), (1, 4, 'https://a.test/"x;200;1'), (1, 5, "https://a.test/;200"),
        (1, 6, "htp://a;200;1"), (1, 7, "https://a.test/;99;1"), (1, 8, "https://a.test/;0;"), (1, 9, " HTTPS://a.test/ ; 200 ; 12 "), (1, 10, "https://a.test/;200;12,34"), (1, 11, ""), (1, 12, None), (1, 13, "   "),
        (1, 5, "https://a.test/;200"), (1, 14, '"https://a.test/";"200";"3""'), (1, 15, "https:///x;200;1"),
        (2, 1, "no header here"), (2, 2, "still none"),
        (None, 1, "URL"), (None, 2, "https://b.test/"), (None, 3, "x"),
        (3, 1, "Title\tURL"), (3, 2, "t\thttps://c.test/" + "y" * 100_000), (3, 3, "t\t" + '"' + "z" * 100_000),
    ]
    got = reasons(frame(spark, rows))
    assert got == {(1, 4): "quoting", (1, 5): "column_count", (1, 6): "invalid_value", (1, 7): "invalid_value", (1, 10): "invalid_value", (1, 14): "quoting", (1, 15): "invalid_value", (None, 3): "invalid_value", (3, 3): "quoting"}


def test_typed_rows(spark):
    rows = [(1, 1, "Address,Status Code,Title,Title 1,In Sitemap,Colour,Response Time"), (1, 2, 'https://a.test/,"1,200",x,y,SÌ,red,2.4'), (1, 3, "https://a.test/b,404, , second,no,,"), (1, 3, "https://a.test/b,404, , second,no,,")]
    out = {r.line_no: r for r in B.typed(frame(spark, rows)).collect()}
    assert set(out) == {3}  # 1,200 isn't a status
    assert (out[3].status_code, out[3].title, out[3].in_sitemap, out[3].response_time_ms) == (404, None, False, None)
    assert out[3].extra == {"Title 1": " second"}


def test_empty(spark):
    df = frame(spark, [])
    assert B.faulty(df).count() == 0
    assert B.typed(df).count() == 0


def test_headers_override_and_repeats(spark):
    rows = [(1, 1, "Address,Title,Title,Titolo,Words"), (1, 2, "https://a.test/,left,right,forced,7")]
    plain = B.typed(frame(spark, rows)).first()
    assert (plain.title, plain.word_count, plain.extra) == ("right", 7, {"Titolo": "forced", "Title": "left"})
    forced = B.typed(frame(spark, rows), {" TITOLO ": "title", "words": "inlinks"}).first()
    assert (forced.title, forced.word_count, forced.inlinks) == ("forced", None, 7)
