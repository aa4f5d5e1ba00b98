import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlquarry.llm import mix as M
from crawlquarry.llm import tokenizers as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.DEFAULT_DIR), reason="no vocabularies")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.01, 0.99)), min_size=3, max_size=3), st.floats(0, 0.999))
def test_a_step_keeps_tokens_and_number(units, chance):
    units = [[n, float(t), p] for n, (t, p) in enumerate(units)]
    tokens, number = sum(u[1] * u[2] for u in units), sum(u[2] for u in units)
    M.step(units, chance)
    assert any(u[2] in (0.0, 1.0) for u in units) and all(0 <= u[2] <= 1 for u in units)
    assert abs(sum(u[1] * u[2] for u in units) - tokens) < 1e-5 and abs(sum(u[2] for u in units) - number) < 1e-6


def test_allocation():
    rows = [{"source": "a", "share": 0.5, "cap": 100, "largest": 1}, {"source": "b", "share": 0.3, "cap": 1000, "largest": 1}, {"source": "c", "share": 0.2, "cap": 0, "largest": 0}]
    got = M.allocate(rows, None)
    assert got == pytest.approx({"a": 100, "b": 60})
    assert M.allocate(rows, 500) == pytest.approx({"a": 100, "b": 400})
    assert M.allocate([], None) == {} and M.allocate(rows[2:], None) == {}


def frames(spark, docs, targets):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, source string, text string, copies string")
    return d, spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int, tokenizer string")


def test_shares_and_caps(spark):
    words = "one two three four five six seven"
    docs = [(n, ["big", " BIG ", "Big"][n % 3], " ".join([words] * (1 + n % 13))) for n in range(600)] + [(1000 + n, "small", words * (1 + n % 3)) for n in range(40)] + [(2000, "small", None), (2001, "small", ""), (None, "small", words), (2002, None, words), (1000, "small", words)]
    targets = [("m", "big", 0.7, 2, "byte_bpe_50k"), ("m", "small", 0.2, 3, "byte_bpe_50k"), ("m", "absent", 0.1, 5, "byte_bpe_50k"), ("n", "absent", 1.0, 1, "byte_bpe_50k"), ("o", "small", None, None, "byte_bpe_50k")]
    mix = M.Mix(*frames(spark, docs, targets))
    rows = mix.selection().collect()
    assert {r.mix_id for r in rows} == {"m"}
    assert len(rows) == len({(r.mix_id, r.doc_id) for r in rows})
    assert max(r.copies for r in rows if r.source == "big") <= 2 and max(r.copies for r in rows if r.source == "small") <= 3
    shares = {(r.mix_id, r.source): r for r in mix.shares().collect()}
    assert shares["m", "big"].actual_share == pytest.approx(0.7 / 0.9, abs=0.002)
    assert shares["m", "small"].actual_share == pytest.approx(0.2 / 0.9, abs=0.002)
    assert shares["m", "absent"].actual_share == 0 and shares["n", "absent"].tokens == 0
    assert sorted(map(tuple, M.Mix(*frames(spark, docs, targets)).selection().collect())) == sorted(map(tuple, rows))


def test_many_open_documents_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "LANDING", 200)
    units = spark.range(4000).selectExpr("cast(id % 2 as int) as stratum", "id as doc_id", "cast(1 + id * id % 97 as bigint) as tokens", "0.37D as p").repartition(16)
    want = {r.stratum: r for r in units.groupBy("stratum").agg({"tokens": "sum", "doc_id": "count"}).collect()}
    out = M.cube(units)
    got = {r.stratum: r for r in out.groupBy("stratum").agg({"tokens": "sum", "doc_id": "count"}).collect()}
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(v) for k, v in want.items()}  # nobody is lost
    chosen = {r.stratum: r for r in out.where("p = 1.0").groupBy("stratum").agg({"tokens": "sum", "doc_id": "count"}).collect()}
    for k in (0, 1):
        assert abs(chosen[k]["sum(tokens)"] - 0.37 * want[k]["sum(tokens)"]) < 3 and abs(chosen[k]["count(doc_id)"] - 740) < 12


def test_empty(spark):
    d, t = frames(spark, [], [("m", "a", 1.0, 1, "byte_bpe_50k")])
    assert M.Mix(d, t).selection().count() == 0
    assert M.Mix(d, t.limit(0)).shares().count() == 0


def test_thousands_of_strata_end(spark):
    """More strata than any bound on open documents of all strata together could hold: each lands by itself."""
    units = spark.range(2000 * 60).selectExpr("cast(id % 2000 as int) as stratum", "id as doc_id", "cast(5 + pmod(xxhash64(id), 400) as bigint) as tokens", "0.41D as p").repartition(8)
    rows = M.cube(units).collect()
    assert len(rows) == 2000 * 60 and {r.p for r in rows} == {0.0, 1.0}
    tokens, chosen = [0] * 2000, [0] * 2000
    for r in rows:
        tokens[r.stratum] += r.tokens
        chosen[r.stratum] += r.tokens * r.p
    off = [abs(c - 0.41 * t) for c, t in zip(chosen, tokens, strict=True)]
    assert max(off) < 60 and sum(off) / len(off) < 5


def test_partitions_dont_matter(spark, monkeypatch):
    monkeypatch.setattr(M, "LANDING", 300)
    units = spark.range(5000).selectExpr("cast(id % 3 as int) as stratum", "id as doc_id", "cast(1 + id * id % 97 as bigint) as tokens", "0.37D as p")
    first = sorted(map(tuple, M.cube(units.repartition(3)).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(tuple, M.cube(units.repartition(13, "tokens")).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
