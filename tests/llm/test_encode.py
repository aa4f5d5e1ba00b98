"""Chunked encoding equals direct encoding, for texts of every kind."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tiktoken")
from crawlquarry.llm import encode as E  # noqa: E402
from crawlquarry.llm import tokenizers as T  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(T.DEFAULT_DIR), reason="no vocabularies")


def through_chunks(text: str, name: str = "byte_bpe_50k") -> list[int]:
    """The operator's steps without a session, as if every chunk were shared; then as if every other one were."""
    import pyarrow as pa

    raw, at, parts, ends = text.encode(), 0, {}, E.cuts([text.encode()])[0]
    for k, end in enumerate(ends):
        b = pa.RecordBatch.from_pydict({"key": [b"x"], "chunk": [raw[at:end].decode()]})
        out = next(E._encode_once(name, T.DEFAULT_DIR)([b])).to_pylist()[0]
        parts[k] = (out["head"], out["mid"], out["tail"])
        at = end
    stitcher = E.Stitcher(name, T.DEFAULT_DIR)
    got = stitcher.ids(raw, ends, parts).tolist()
    assert stitcher.ids(raw, ends, {k: v for k, v in parts.items() if k % 2}).tolist() == got == stitcher.ids(raw, ends, {}).tolist()
    return got


ALPHABET = st.sampled_from(["a", "the ", " word", "  ", "\n", "\t", " ", " ", "　", "é", "日本", "'s", "12", " 3", "!", " (", "😀", "x" * 40, " " * 30, "\r\n", "​", "<|endoftext|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join))
def test_equals_direct_encoding(text):
    assert through_chunks(text) == T.encoder("byte_bpe_50k")([text])[0]


def test_long_texts():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "日本語", "x1", "…", "\n"]) for _ in range(30_000)), "a" * 50_000, " " * 50_000 + "b", "日" * 30_000, "no-break" * 9000]
    for name in E.BYTE_LEVEL:
        for t in texts:
            assert through_chunks(t, name) == T.encoder(name)([t])[0]


def test_equals_the_other_library():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(os.path.join(T.DEFAULT_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Hello  world", "<|endoftext|> is text", "a\n\n  b ", "日本 x", ""]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [through_chunks(x) for x in texts]


def test_chunks_depend_on_content_alone():
    rng = random.Random(9)
    body = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(4000))
    pieces = lambda t: {t.encode()[a:b] for ends in E.cuts([t.encode()]) for a, b in zip([0, *ends], ends, strict=False)}
    one, two = pieces(body), pieces("Another beginning. " + body)
    assert len(one & two) > 0.8 * len(one)
    alone, many = E.cuts([body.encode()])[0], E.cuts([b"other text " * 50, body.encode(), b""])
    assert many[1] == alone and many[2] == [0]


def test_frame(spark):
    long = "A sentence of some words. " * 400
    rows = [(1, long, "z"), (1, long, "z"), (2, None, "z"), (3, "", "z"), (None, "orphan", "z"), (5, long + "end", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in E.ids(df).collect())
    direct = T.encoder("byte_bpe_50k")
    assert got == sorted(((i or 0), direct([t or ""])[0]) for i, t, _ in rows)
    assert E.ids(df.limit(0)).count() == 0
    pieces = {r.doc_id: list(r.ids) for r in E.ids(df.where("doc_id in (2, 5)"), "piece_bpe_32k").collect()}
    assert pieces[2] == [] and pieces[5] == T.encoder("piece_bpe_32k")([long + "end"])[0]


def test_shared_chunks_in_tasks_or_joined(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "日本"]) for _ in range(900))
    rows = [(n, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(200))) + " " + passage[n * 7 :]) for n in range(40)] + [(7, passage), (7, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = sorted((i or 0, T.encoder("byte_bpe_50k")([t])[0]) for i, t in rows)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in E.ids(df).collect()) == want
    for name in ("MOST_SHARED", "SHARED_BYTES"):
        monkeypatch.setattr(E, name, 0)
        assert sorted((r.doc_id or 0, list(r.ids)) for r in E.ids(df).collect()) == want


def test_vocabularies_reach_executors_without_the_folder(spark):
    from crawlquarry.functions.arrow import map_arrow

    T.ship(spark, ["byte_bpe_50k"])

    def run(batches):
        for b in batches:
            import pyarrow as pa

            from crawlquarry.llm import tokenizers

            got = tokenizers.encoder("byte_bpe_50k", "/no/such/folder")(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], names=["ids"])

    df = spark.createDataFrame([("A text.",)], "text string")
    assert [list(r.ids) for r in map_arrow(df, run, "ids array<int>").collect()] == T.encoder("byte_bpe_50k")(["A text."])
