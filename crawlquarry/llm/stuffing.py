"""Pages made of keywords, links or tags instead of sentences.

One pass reads the texts. It cuts them into blocks at line and sentence ends and keeps of each block what judging needs:
its length, its marks and its words as hashes; and of each window (a run of blocks of about 400 characters) the ratio to
which it compresses and how many sentences end in it. All that follows works on these features, in vectors.

Stage 1, the method: the ratio of a window is normalized by what windows of its length and language have in the whole
corpus (median and spread). A window that is more redundant than that and has next to no ends of sentences is stuffed.

Stage 2, for the windows that this doesn't decide: lists of different names or links compress no better than sentences,
and spam imitates punctuation, so their blocks must hold words that the corpus uses in running sentences but not in lists.
Words learn that from all documents: how often they stand in blocks that end like a sentence, and how often in blocks full
of separators or without an end. An extremely redundant window needs more of them. Where the learned words cover too
little of the sentences of a script and language, blocks are judged without them: by separators, and by repetition where
the window is redundant.

A document is a case if more than half of its characters are stuffed.

Defined results
    Null texts and texts under 150 characters (as they stand) are no cases. Logs (lines that begin with a time stamp) and
    code (scripts, styles, closed listings that look like code, lines of a program) count as sentences; an opening tag or
    fence that is never closed opens nothing. A block belongs to the script of most of its letters; in scripts written
    without spaces, pairs of neighbouring characters are the words. Texts are read whole, in time linear in their length;
    repeated rows are judged alike. Extra columns don't matter; a null language is a language of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.arrow import map_arrow, spread
from crawlquarry.plans.sized import written

LEAST = 150
#: A word must stand in this many blocks to be learned.
LEAST_BLOCKS = 8
#: Learned words that are handed to tasks as an array (48 MB of hashes). Beyond it they are looked up by a join: same result.
MOST_LOOKUP = 6_000_000
#: A word is a sentence word if it stands in lists at most this much as often as in sentences (rates per block).
LIST_RATE = 0.1
#: Stage 1: deviation of the ratio below which a window is redundant, and ends of sentences per word under which it is
#: confirmed.
REDUNDANT, FEW_ENDS = -1.0, 0.02
#: Stage 2: deviation of extreme redundancy, and the share of sentence words that a block needs if it is punctuated like a
#: sentence, if it isn't, and if it is extremely redundant.
EXTREME = -3.0
NEED_ENDED, NEED, NEED_REDUNDANT = 0.08, 0.16, 0.30
#: Words above which a block is judged in stretches, and words of a stretch.
LONG, STRETCH = 40, 16
#: Share of the words of the sentences of a script and language that the learned words must cover for its blocks to be
#: judged by them.
COVERED = 0.5
#: Windows that a language needs at a length to have usual ratios of its own; with fewer, those of all languages hold.
LEAST_WINDOWS = 30

HIDDEN = re.compile("[​-‏‪-‮⁠﻿­]")
BLOCK = re.compile(r"[^\n.!?…。！？؟;]*(?:[.!?…؟](?=\S)[^\n.!?…。！？؟;]*|;[^\n.!?…。！？؟;]*)*[.!?…。！？؟]*[」』）]*")
PIECE = re.compile(r"(?<!\s)\s+[|>·•/]\s+")
ITEM = re.compile(r"([,;:|·#=•>、，；：｜・،؛]+|\s/\s|(?i:https?://)\S+)")
#: Marks that end a sentence, and what may close behind them.
MARKS, CLOSERS = tuple(".!?…。！？؟"), "\"'»”’)]」』）"
WORD = re.compile(r"[^\s,;|.!?…:()\[\]{}\"<>/=#·•*>~+–—、。，！？；：｜・「」『』（）،؛؟-]+")
HAS_DIGIT = re.compile(r"\d")
SEPARATOR = re.compile(r"[,;:|#=·•/>~+、，；：｜・،؛]")
NUMBERED = re.compile(r"\b\d+[.)]\s")
GAP = re.compile(r"(?<=[぀-ヿ㐀-鿿฀-๿])\s+(?=[぀-ヿ㐀-鿿฀-๿])")
LINK = re.compile(r"(?i)(?:https?://|www\.)\S+|<a\s[^>]{0,2000}>|(?<![\w.-])[\w.-]{1,80}\.(?:example|test|com|org|net|de|it|fr|es)/\S*")
LOG = re.compile(r"^\s*\[?(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\d\d:\d\d:\d\d|\d{1,3}(?:\.\d{1,3}){3} - )")
KEYWORD = re.compile(r"(?:const|let|var|def|class|import|from|return|function|if|for|while|else|try|public|private|select|insert|update)\b")
ONLY_BRACKETS = re.compile(r"[{}\[\]]+[;,]?")
CALL_END = re.compile(r"\)\s*;$")
OPEN = re.compile(r"<(script|style|pre|code)\b|```", re.I)
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
#: Scripts told apart beside Latin, which is the first.
SCRIPTS = {"latin": None} | {k: re.compile(f"[{v}]") for k, v in {"greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ӿ", "hebrew": "֐-׿", "arabic": "؀-ۿ", "devanagari": "ऀ-ॿ", "hangul": "가-힯", "thai": "฀-๿", "han": "㐀-鿿", "kana": "぀-ヿ"}.items()}
NAMES = list(SCRIPTS)
BEYOND_LATIN = re.compile("[Ͱ-ԯ֐-\uffff]")
UNSPACED_RUN = re.compile(f"{UNSPACED.pattern}+|(?:(?!{UNSPACED.pattern}).)+")


def is_code(line: str) -> bool:
    """Whether a stripped line is one of a program. Looks at its beginning, its end and single marks only."""
    if ONLY_BRACKETS.fullmatch(line) or line.startswith(("//", "#include", "$ ")) or line.endswith(("{", "}")):
        return True
    if line.endswith(";") and CALL_END.search(line[-80:]):
        return True
    return line.endswith(("{", "}", ")", ";", ":")) and KEYWORD.match(line) is not None and any(c in line[:-1] for c in "({=")


def _listing(inner: str) -> bool:
    """Whether the inside of a closed listing looks like code: a third of its lines do, or hold its marks."""
    lines = [x for x in map(str.strip, inner.split("\n")) if x]
    return not lines or 3 * sum(is_code(x) or any(c in x for c in "{}()=;$<") for x in lines) >= len(lines)


def blocks(text: str) -> list[tuple[str, str]]:
    """(block, kind): kind is ``log``, ``code`` or ``text``."""
    text = HIDDEN.sub("", text)
    out: list[tuple[str, str]] = []
    at = 0
    if "```" in text or "<" in text:
        low = text.lower() if len(text.lower()) == len(text) else text
        never: set[str] = set()  # closings that don't come any more
        for m in OPEN.finditer(text):
            close = f"</{m[1].lower()}>" if m[1] else "```"
            if m.start() < at or close in never:
                continue
            end = low.find(close, m.end())
            if end < 0:
                never.add(close)
                continue
            inner = text[m.end() : end]
            if m[1] and m[1].lower() in ("script", "style") or _listing(inner[inner.find(">") + 1 :] if m[1] else inner):
                out += _lines(text[at : m.start()]) + [(text[m.start() : end + len(close)], "code")]
                at = end + len(close)
    return out + _lines(text[at:])


def _lines(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if LOG.match(line):
            out.append((line, "log"))
        elif is_code(line) and not LINK.search(line):
            out.append((line, "code"))
        else:
            parts = BLOCK.findall(line)
            if any(c in line for c in "|>·•/"):
                parts = [p for b in parts for p in PIECE.split(b)]
            out += [(q, "text") for p in parts if (q := p.strip())]
    return out


def unlinked(block: str) -> str:
    """Without links, in lower case."""
    low = block.lower()
    return LINK.sub(" ", low) if "/" in low or "www." in low or "<a" in low else low


def words_of(plain: str) -> list[str]:
    words = WORD.findall(plain)
    if HAS_DIGIT.search(plain):
        words = [w for w in words if not w.isdigit()]
    if not plain.isascii() and UNSPACED.search(plain):
        words = [x for w in words for run in UNSPACED_RUN.findall(w) if not run.isdigit() for x in (_pairs(run) if UNSPACED.match(run) else [run])]
    return [w.strip("'’") for w in words] if "'" in plain or "’" in plain else words


def _pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(max(1, len(run) - 1))]


def script(text: str) -> str:
    """Of most of the letters, one of ``SCRIPTS``; Han with a tenth of kana or more is ``kana``."""
    if text.isascii() or not BEYOND_LATIN.search(text):
        return "latin"
    n = {k: len(p.findall(text)) for k, p in SCRIPTS.items() if p}
    n["latin"] = sum(c.isalpha() for c in text) - sum(n.values())
    n["han"], n["kana"] = (0, n["han"] + n["kana"]) if 10 * n["kana"] >= n["han"] + n["kana"] else (n["han"] + n["kana"], 0)
    return max(NAMES, key=lambda k: n[k])


def full_of_separators(plain: str, words: list[str]) -> bool:
    """More than one separator, item number or gap between unspaced words to four words."""
    n = len(SEPARATOR.findall(plain))
    if HAS_DIGIT.search(plain):
        n += len(NUMBERED.findall(plain))
    if not plain.isascii() and UNSPACED.search(plain):
        n += len(GAP.findall(plain))
    return 4 * n > len(words)


def ratio(block: str) -> tuple[int, float]:
    """(length class, compression ratio) of a block."""
    raw = block.encode("utf-8", "replace")
    return len(raw).bit_length(), len(zlib.compress(raw, 6)) / max(1, len(raw))


def windows(items: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Runs of neighbouring text blocks of about 400 characters: short blocks say nothing about redundancy."""
    out, at, size = [], 0, 0
    for i, (b, kind) in enumerate(items):
        size += len(b)
        if size >= 400 or kind != "text" or i == len(items) - 1:
            out.append((at, i + 1))
            at, size = i + 1, 0
    return out


def language(lang: str | None) -> str:
    lang = (lang or "")[:2].lower()
    return lang if lang.isascii() and lang.isalpha() and len(lang) == 2 else ""


# Flags of a unit (a block, or an item of a block that is a list).
TEXT, ENDED, LISTED, FIRST, REPEATS, LIST_BLOCK = 1, 2, 4, 8, 16, 32
FIELDS = {"w_size": "array<tinyint>", "w_ratio": "array<smallint>", "w_units": "array<int>", "w_ends": "array<int>", "w_words": "array<int>", "chars": "array<int>", "flags": "array<tinyint>", "script": "array<tinyint>", "n_words": "array<int>", "words": "array<bigint>"}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
FEATURES = "doc_id long, lang string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())


class Reader:
    """Features of texts; words still as texts."""

    def read(self, text: str) -> dict[str, list[int]]:
        f: dict[str, list[int]] = {k: [] for k in FIELDS}
        items = blocks(text)
        for lo, hi in windows(items):
            run = items[lo:hi]
            size, r = ratio("\n".join(b for b, _ in run) if hi - lo > 1 else run[0][0])
            before, n_words, ends = len(f["chars"]), 0, 0
            for b, kind in run:
                if kind != "text":
                    self._unit(f, len(b), FIRST, 0, [])
                    continue
                at = NAMES.index(script(b))
                plain = unlinked(b)
                ws = words_of(plain)
                n_words += len(ws)
                ended = ENDED if b.rstrip(CLOSERS).endswith(MARKS) else 0
                ends += bool(ended)
                listed = full_of_separators(plain, ws)
                flags = TEXT | ended | (LISTED if listed or not ended else 0) | (LIST_BLOCK if listed else 0) | (REPEATS if 3 * len(set(ws)) < 2 * len(ws) else 0)
                if listed or "/" in b and len(LINK.findall(b)) > 2:
                    # a list: item by item, since a sentence may stand in its midst
                    first = FIRST
                    for x in ITEM.split(b):
                        if x:
                            self._unit(f, len(x), (flags & ~ENDED) | first, at, words_of(unlinked(x)))
                            first = 0
                elif len(ws) > LONG and len(tokens := b.split(" ")) > LONG:
                    # longer than sentences are: stretch by stretch, since a sentence may end a list that has no marks
                    first = FIRST
                    for lo_ in range(0, len(tokens), STRETCH):
                        x = " ".join(tokens[lo_ : lo_ + STRETCH])
                        last = lo_ + STRETCH >= len(tokens)
                        self._unit(f, len(x) + (not last), (flags if last else flags & ~ENDED) | first, at, words_of(unlinked(x)))
                        first = 0
                else:
                    self._unit(f, len(b), flags | FIRST, at, ws)
            f["w_size"].append(min(size, 127))
            f["w_ratio"].append(min(200, int(r * 100)))
            f["w_units"].append(len(f["chars"]) - before)
            f["w_ends"].append(ends)
            f["w_words"].append(n_words)
        return f

    def _unit(self, f: dict[str, list[int]], chars: int, flags: int, at: int, words: list[str]) -> None:
        f["chars"].append(chars)
        f["flags"].append(flags)
        f["script"].append(at)
        f["n_words"].append(len(words))
        f["words"] += words


def hashed(words: list[str]) -> pa.Array:
    """64-bit hashes of words, each distinct one hashed once."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    own = pa.array([xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in coded.dictionary.to_pylist()], pa.int64())
    return own.take(coded.indices)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lo in range(0, len(texts), 512):
            got = [reader.read(t) for t in texts[lo : lo + 512]]
            lists = []
            for k, kind in FIELDS.items():
                offsets = np.concatenate([[0], np.cumsum([len(x[k]) for x in got])]).astype(np.int32)
                flat = [v for x in got for v in x[k]]
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), hashed(flat) if k == "words" else pa.array(flat, _ARROW[kind[6:-1]])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, 512), pa.array([language(g) for g in langs[lo : lo + 512]], pa.string()), *lists], names=["doc_id", "lang", *FIELDS])


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def _units(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of a batch by unit: its document (place in the batch), window, and the place of its words."""
    doc_of_window = np.repeat(np.arange(b.num_rows), b.column("w_size").value_lengths().to_numpy(zero_copy_only=False))
    window = np.repeat(np.arange(len(doc_of_window)), _flat(b, "w_units"))
    n_words = _flat(b, "n_words").astype(np.int64)
    return {"doc_of_window": doc_of_window, "window": window, "doc": doc_of_window[window] if len(window) else window, "n_words": n_words, "flags": _flat(b, "flags"), "script": _flat(b, "script")}


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers in order, and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, script, word, n, m): blocks of three words or more in which a word stands that are sentences, and that are
    lists. The word 0 of script -1 has all such blocks."""
    for b in batches:
        u, langs = _units(b), b.column("lang").to_pylist()
        coded = b.column("words").flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        first = (u["flags"] & FIRST) != 0
        n_blocks, block = int(first.sum()), np.cumsum(first) - 1
        per_block = np.bincount(block, u["n_words"], minlength=n_blocks)
        fit = (per_block >= 3) & ((u["flags"][first] & TEXT) != 0)
        listed = ((u["flags"][first] & LISTED) != 0).astype(np.int64)
        names = sorted(set(langs))
        lang_at = np.array([names.index(g) for g in langs], np.int64)
        group = (lang_at[u["doc"][first]] * 16 + u["script"][first]) * 2 + listed  # of each block
        at = np.repeat(block, u["n_words"])
        use, size = fit[at], max(1, len(words))
        once, _ = _counted(at[use] * size + codes[use])  # (block, word)
        keys, count = _counted(group[once // size] * size + once % size)
        g, w = keys // size, words[keys % size] if len(words) else keys
        n, m = np.where(g % 2 == 0, count, 0), np.where(g % 2 == 1, count, 0)
        cols = [[names[i] for i in g // 32] + [""], np.append(g // 2 % 16, -1), np.append(w, 0), np.append(n, int((fit & (listed == 0)).sum())), np.append(m, int((fit & (listed == 1)).sum()))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["lang", "script", "word", "n", "m"])


class Model:
    """What is learned from the corpus: sentence words (sorted hashes), the (language, script) pairs whose sentences they
    cover, and usual ratio and spread of windows by (language, length)."""

    def __init__(self, words: np.ndarray | None, covered: set[tuple[str, int]], usual: dict[tuple[str, int], tuple[float, float]]):
        self.words, self.covered, self.usual = words, covered, usual

    def knows(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), bool)
        at = np.searchsorted(self.words, words)
        return self.words[np.minimum(at, len(self.words) - 1)] == words

    def judge(self, b: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of stuffed characters, share by stage 1 alone) of each document; ``known``: of each word, whether it is
        a sentence word."""
        u, langs = _units(b), b.column("lang").to_pylist()
        size, got = _flat(b, "w_size"), _flat(b, "w_ratio") / 100 + 0.005
        usual = [self.usual.get((langs[d], s)) or self.usual.get(("", s)) or (r, 1.0) for d, s, r in zip(u["doc_of_window"].tolist(), size.tolist(), got.tolist(), strict=True)]
        mid, spread = np.array(usual, float).reshape(-1, 2).T
        deviation = (got - mid) / np.maximum(spread, 0.02)
        stuffed = (deviation < REDUNDANT) & (_flat(b, "w_ends") <= FEW_ENDS * _flat(b, "w_words"))
        chars, flags, n, w = _flat(b, "chars").astype(np.int64), u["flags"], u["n_words"], u["window"]
        text, ended, extreme = (flags & TEXT) != 0, (flags & ENDED) != 0, deviation[w] < EXTREME
        hits = np.bincount(np.repeat(np.arange(len(n)), n), known, len(n))
        need = np.where(extreme, NEED_REDUNDANT, np.where(ended, NEED_ENDED, NEED))
        wordless = (n == 0) | (hits < need * n)
        cover = np.array([(langs[d], s) in self.covered for d, s in zip(u["doc"].tolist(), u["script"].tolist(), strict=True)], bool)
        bare = ((flags & LIST_BLOCK) != 0) | (deviation[w] < REDUNDANT) & (~ended | ((flags & REPEATS) != 0))
        one = text & stuffed[w]
        bad = one | text & np.where(cover, wordless, bare)
        total = np.maximum(1, np.bincount(u["doc"], chars, b.num_rows))
        return np.bincount(u["doc"], chars * bad, b.num_rows) / total, np.bincount(u["doc"], chars * one, b.num_rows) / total


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _flat(b, "words")
            if model.words is not None:
                known = model.knows(words)
            else:  # places of the known words within each document's
                known = np.zeros(len(words), bool)
                start = np.concatenate([[0], np.cumsum(b.column("words").value_lengths().to_numpy(zero_copy_only=False))])
                hit = b.column("hit")
                known[np.repeat(start[:-1], hit.value_lengths().to_numpy(zero_copy_only=False)) + hit.flatten().to_numpy(zero_copy_only=False)] = True
            both, one = model.judge(b, known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(both, pa.float64()), pa.array(one, pa.float64())], names=["doc_id", "spam_share", "redundant_share"])

    return run


def features(documents: DataFrame) -> DataFrame:
    """What judging needs of all documents of ``LEAST`` characters or more, written once: the only pass over texts."""
    texts = documents.where(F.length("text") >= LEAST).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return written(map_arrow(spread(texts), _features, FEATURES))


def learn(seen: DataFrame) -> tuple[Model, DataFrame]:
    """(model, sentence words), counted over all features. What reaches the driver is bounded: 677 languages times the
    sizes of windows and the scripts, and at most ``MOST_LOOKUP`` hashes; more words stay a table (``Model.words`` None)."""
    counts = written(map_arrow(seen.select("lang", *[k for k in FIELDS if k not in ("w_ratio", "chars")]), _learned, "lang string, script long, word long, n long, m long").groupBy("lang", "script", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    total = counts.where("script = -1").first()
    rate = LIST_RATE * (total["m"] or 1) / (total["n"] or 1) if total else 0.0
    held = counts.where("script >= 0")
    words = written(held.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where((F.col("n") >= LEAST_BLOCKS) & (F.col("m") <= rate * F.col("n"))).select("word"))
    cover = held.join(words.withColumn("known", F.lit(True)), "word", "left").groupBy("lang", "script").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known"), F.col("n"))).alias("k")).where((F.col("n") > 0) & (F.col("k") >= COVERED * F.col("n")))
    covered = {(r["lang"], r["script"]) for r in cover.collect()}
    ratios = seen.select("lang", F.inline(F.arrays_zip("w_size", "w_ratio"))).groupBy("lang", "w_size", "w_ratio").agg(F.count("*").alias("n"))
    ratios = written(ratios)
    by = ratios.where("lang <> ''").unionByName(ratios.groupBy("w_size", "w_ratio").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "w_size", "w_ratio", "n"))
    mid = by.groupBy("lang", "w_size").agg(F.percentile("w_ratio", 0.5, F.col("n")).alias("mid"), F.sum("n").alias("windows")).where((F.col("windows") >= LEAST_WINDOWS) | (F.col("lang") == ""))
    far = by.join(mid, ["lang", "w_size"]).groupBy("lang", "w_size", "mid").agg(F.percentile(F.abs(F.col("w_ratio") - F.col("mid")), 0.5, F.col("n")).alias("mad"))
    usual = {(r["lang"], r["w_size"]): (r["mid"] / 100 + 0.005, 1.4826 * r["mad"] / 100) for r in far.collect()}
    few = words.count() <= MOST_LOOKUP
    return Model(np.sort(words.toArrow().column("word").to_numpy()) if few else None, covered, usual), words


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_share, redundant_share) of all documents of ``LEAST`` characters or more: the share of characters in
    stuffed blocks, and in those that stage 1 decides. No shuffle but of counts while the learned words can be handed to
    tasks; beyond that one join of words."""
    seen = features(documents)
    model, words = learn(seen)
    if model.words is None:
        seen = seen.withColumn("row", F.monotonically_increasing_id())
        hit = seen.select("row", F.posexplode("words").alias("pos", "word")).join(words, "word").groupBy("row").agg(F.collect_list("pos").alias("hit"))  # bounded by one text
        seen = seen.join(hit, "row", "left").withColumn("hit", F.coalesce("hit", F.array().cast("array<int>"))).drop("row")
    return map_arrow(seen, _scores(model), "doc_id long, spam_share double, redundant_share double")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages made of keywords, links or tags."""
    return scores(documents).where("spam_share > 0.5").select("doc_id")
