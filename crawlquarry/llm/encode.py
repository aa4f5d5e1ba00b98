"""Token ids of a whole corpus, each shared chunk of text encoded once.

Texts are cut by content: a rolling hash over the last bytes decides where, so equal passages in different documents give
equal chunks. Chunks are counted by their 128-bit hash, and only those that stand in more than one place are taken out,
encoded once, and put where they stand; all other text is encoded in place and never moves. What remains are the joins
around shared chunks. A token never reaches over a point where a space stands before a character that is no space (the
pattern of the byte-level vocabularies always splits there, whatever is around), so a chunk's ids are exact between its
first and its last such point. The stretch from the last point of one shared chunk to the first of the next, with all
that is between them, is encoded anew; with both ends of the stretch on such points, the result equals the ids of the
whole text.

The shared chunks are handed to tasks while they are few (their number and bytes are measured); beyond that they are joined
to the documents in which they stand. Both ways give the same ids.

Defined results
    Null and empty texts have an empty array. Strings of special tokens are ordinary text. Each input row gives a row,
    repeated ones too: a document is known by its doc_id and text, so that it doesn't matter in which order or how often
    its row is read. Texts of any length are encoded whole. Extra columns don't matter. Vocabularies without the pattern are encoded text by text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.arrow import map_arrow, spread
from crawlquarry.llm.tokenizers import BYTE_LEVEL, DEFAULT_DIR, encoder, ship
from crawlquarry.plans.sized import size_bytes, written

#: Bytes that the rolling hash sees, its mask (a cut every 2**MASK_BITS bytes on average), least and greatest chunk.
WINDOW, MASK_BITS, LEAST, MOST = 32, 9, 128, 8192
#: Shared chunks, and their bytes as counted by ``size_bytes``, that may be handed to every task.
MOST_SHARED, SHARED_BYTES = 100_000, 16 << 20
_GEAR = np.array([int.from_bytes(xxhash.xxh64_digest(bytes([b]), seed=7)[:4], "big") for b in range(256)], np.uint32)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at each byte (gear hash, by doubling windows)."""
    h = _GEAR[data]
    w = 1
    while w < WINDOW:
        shifted = np.zeros_like(h)
        shifted[w:] = h[:-w]
        h = h + (shifted << np.uint32(w))
        w *= 2
    return h


def safe_points(data: np.ndarray) -> np.ndarray:
    """Bytes at which an encoding always splits: a space before an ASCII character that is no white space, or before a
    letter beyond ASCII that is told from white space by its first byte."""
    nxt = data[1:]
    plain = ((nxt < 128) & ~_WHITE[nxt]) | (nxt == 0xC3) | ((nxt >= 0xC4) & (nxt <= 0xDF)) | ((nxt >= 0xE4) & (nxt <= 0xE9))
    return np.flatnonzero((data[:-1] == 32) & plain)


def cuts(raws: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text end (the last is its length). A cut is the safe point nearest behind a place that the
    hash chose, or, where there is none, the beginning of a character. A place stands at least LEAST bytes behind the
    beginning of its chunk, so that the hash sees this text alone although all texts are hashed at once."""
    buffer = b"".join(raws)
    if len(buffer) < 2:
        return [[len(r)] for r in raws]
    data = np.frombuffer(buffer, np.uint8)
    picks = (np.flatnonzero((rolling(data) >> np.uint32(32 - MASK_BITS)) == 0) + 1).tolist()
    safe = safe_points(data).tolist()
    out, lo = [], 0
    for raw in raws:
        hi, at, ends = lo + len(raw), lo, []
        while hi - at > LEAST:
            k = bisect_left(picks, at + LEAST)
            want = picks[k] if k < len(picks) and picks[k] < hi else hi
            s = bisect_left(safe, want)
            end = safe[s] if s < len(safe) and safe[s] < hi - 1 else hi
            if end - at > MOST:
                end = min(want, at + MOST)
                while end < hi and (buffer[end] & 0xC0) == 0x80:
                    end += 1
            if end >= hi:
                break
            ends.append(end - lo)
            at = end
        out.append([*ends, len(raw)])
        lo = hi
    return out


def _pieces(raws: list[bytes]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(text, place, key, bytes) of every chunk of texts."""
    for n, (raw, ends) in enumerate(zip(raws, cuts(raws), strict=True)):
        at = 0
        for k, end in enumerate(ends):
            if end > at:
                yield n, k, xxhash.xxh3_128_digest(raw[at:end]), raw[at:end]
            at = end


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): how often each chunk of a batch stands there."""
    for b in batches:
        n = Counter(key for _, _, key, _ in _pieces([t.encode() for t in b.column("text").to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["key", "n"])


def _texts(only: frozenset[bytes] | None):
    """(key, chunk): the distinct chunks of each batch, those in ``only`` or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {key: piece for _, _, key, piece in _pieces([t.encode() for t in b.column("text").to_pylist()]) if only is None or key in only}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array([x.decode() for x in got.values()], pa.string())], names=["key", "chunk"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, pos, key): where chunks stand."""
    for b in batches:
        docs, hashes = b.column("doc_id").to_pylist(), b.column("hash").to_pylist()
        rows = [(docs[n], hashes[n], k, key) for n, k, key, _ in _pieces([t.encode() for t in b.column("text").to_pylist()])]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "hash", "pos", "key"])


def _encode_once(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        for b in batches:
            heads, mids, tails = [], [], []
            for text in b.column("chunk").to_pylist():
                raw = text.encode()
                safe = safe_points(np.frombuffer(raw, np.uint8)) if len(raw) > 1 else []
                if len(safe) == 0:
                    heads.append(text)
                    mids.append(None)
                    tails.append(None)
                    continue
                first, last = int(safe[0]), int(safe[-1])
                heads.append(raw[:first].decode())
                mids.append(np.array(encode([raw[first:last].decode()])[0], np.int32).tobytes())
                tails.append(raw[last:].decode())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(heads, pa.string()), pa.array(mids, pa.binary()), pa.array(tails, pa.string())], names=["key", "head", "mid", "tail"])

    return run


Shared = tuple[str, bytes | None, str | None]  # text before the first point, ids from there to the last, text behind it


class Stitcher:
    """Puts the ids of shared chunks and of the text around them together."""

    def __init__(self, name: str, folder: str):
        self.encode, self.joins = encoder(name, folder), {}

    def repaired(self, text: str) -> bytes:
        if not text:
            return b""
        got = self.joins.get(text)
        if got is None:
            got = np.array(self.encode([text])[0], np.int32).tobytes()
            if len(text) < 64:
                if len(self.joins) > 200_000:
                    self.joins.clear()
                self.joins[text] = got
        return got

    def ids(self, raw: bytes, ends: list[int], shared: dict[int, Shared]) -> np.ndarray:
        """The ids of a text whose chunks end at ``ends``, some of which are shared."""
        out, open_, at = [], "", 0
        for k in sorted(shared):
            head, mid, tail = shared[k]
            if mid is None:  # no point in it: text like any other
                continue
            start = ends[k - 1] if k else 0
            out += [self.repaired(open_ + raw[at:start].decode() + head), mid]
            open_, at = tail, ends[k]
        out.append(self.repaired(open_ + raw[at:].decode()))
        return np.frombuffer(b"".join(out), np.int32)


def _stitched(name: str, folder: str, table: dict[bytes, Shared] | None):
    """(doc_id, ids) of (doc_id, text): with the shared chunks in ``table``, or in a column ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitcher = Stitcher(name, folder)
        for b in batches:
            raws = [t.encode() for t in b.column("text").to_pylist()]
            all_ends = cuts(raws)
            shared: list[dict[int, Shared]] = [{} for _ in raws]
            if table is None:
                for mine, parts in zip(shared, b.column("parts").to_pylist(), strict=True):
                    mine.update({p["pos"]: (p["head"], p["mid"], p["tail"]) for p in parts or ()})
            elif table:
                for n, k, key, _ in _pieces(raws):
                    if key in table:
                        shared[n][k] = table[key]
            out = [stitcher.ids(*x) for x in zip(raws, all_ends, shared, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return run


def _whole(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([list(x) for x in encode(texts)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> DataFrame:
    """(doc_id, ids) of every document. Hashes of chunks are counted in a shuffle; of texts, only chunks that stand in
    several places move."""
    ship(documents.sparkSession, [tokenizer], folder)
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    if tokenizer not in BYTE_LEVEL:
        return map_arrow(docs, _whole(tokenizer, folder), "doc_id long, ids array<int>")
    twice = written(map_arrow(docs.select("text"), _keys, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    schema = "key binary, head string, mid binary, tail string"
    few = twice.count() <= MOST_SHARED
    if few:
        texts = map_arrow(docs.select("text"), _texts(frozenset(bytes(r["key"]) for r in twice.collect())), "key binary, chunk string")
    else:
        texts = map_arrow(docs.select("text"), _texts(None), "key binary, chunk string").join(twice, "key", "left_semi")
    once = written(map_arrow(texts.groupBy("key").agg(F.min("chunk").alias("chunk")), _encode_once(tokenizer, folder), schema).where("mid is not null"))
    if few and size_bytes(once.select(F.hex("mid").alias("mid"), "head", "tail")) <= SHARED_BYTES:
        table = {bytes(r["key"]): (r["head"], bytes(r["mid"]), r["tail"]) for r in once.collect()}
        return map_arrow(docs, _stitched(tokenizer, folder, table), "doc_id long, ids array<int>")
    docs = docs.withColumn("hash", F.xxhash64("text"))
    at = map_arrow(docs, _places, "doc_id long, hash long, pos int, key binary").distinct().join(once, "key")
    parts = at.groupBy(F.col("doc_id").alias("p_doc"), F.col("hash").alias("p_hash")).agg(F.collect_list(F.struct("pos", "head", "mid", "tail")).alias("parts"))  # bounded by one text
    both = docs.join(parts, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("hash") == F.col("p_hash")), "left")
    return map_arrow(both.select("doc_id", "text", "parts"), _stitched(tokenizer, folder, None), "doc_id long, ids array<int>")


def _lengths(names: list[str], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(n, folder) for n in names]
        for b in batches:
            keys, texts = b.column("tokenizer").to_pylist(), b.column("text").to_pylist()
            counts = [0] * len(keys)
            for name, encode in zip(names, encoders, strict=True):
                at = [i for i, k in enumerate(keys) if k == name]
                for i, x in zip(at, encode([texts[i] for i in at]), strict=True):
                    counts[i] = len(x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "row_id", "source", "tokenizer")], pa.array(counts, pa.int64())], names=["doc_id", "row_id", "source", "tokenizer", "tokens"])

    return run


def lengths(texts: DataFrame, names: list[str], folder: str = DEFAULT_DIR) -> DataFrame:
    """(doc_id, row_id, source, tokenizer, tokens) of (doc_id, row_id, source, tokenizer, text)."""
    ship(texts.sparkSession, names, folder)
    return map_arrow(spread(texts), _lengths(names, folder), "doc_id long, row_id long, source string, tokenizer string, tokens long")
