"""Several values packed in one cell, one row per value with its position.

A multi-pattern automaton finds whole known values in a cell (directives, types, and whatever the corpus shows as a value
of its own, in quotes or alone in a cell); directives are extended by their argument, languages by their address, quoted
text is a candidate as it stands. Dynamic programming over the cell then picks the cover of least cost by candidates,
unknown words and delimiters, so that a delimiter inside a known value stays inside it.

The dictionary has no bound. While it fits into a task it is the automaton's; beyond that it stays a table, and the
stretches of a cell that begin and end at delimiters (none longer than the longest value) are joined to it by their hash.
Both ways give the same candidates.

Defined results
    Null, blank and delimiter-only cells have no values. Empty values don't count, repeated ones do; positions are those
    of the values that count. A quote mark that is never closed is dropped from its word. Text of any length is read
    whole; case is folded character by character, so that a letter whose lower case is longer changes nothing around it.
    Extra columns don't matter; rows are independent, so repeated rows repeat their values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.functions.arrow import map_arrow
from crawlquarry.plans.sized import size_bytes, written

FIELDS = ("meta_robots", "structured_data_types", "hreflang")
#: Crawler directives, and those that take an argument.
DIRECTIVES = ["all", "index", "noindex", "follow", "nofollow", "none", "noarchive", "nocache", "nosnippet", "noimageindex", "notranslate", "nositelinkssearchbox", "indexifembedded", "noodp", "noydir"]
WITH_ARGUMENT = {
    "max-snippet": r"-?[0-9]+",
    "max-image-preview": r"[a-z]+",
    "max-video-preview": r"-?[0-9]+",
    "unavailable_after": r"(?:[a-z]{3,9},?\s+)?[0-9]{1,4}[-\s/][a-z0-9]{2,9}[-\s/][0-9]{2,4}(?:[,t]?\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\s*(?:[a-z]{2,4}|[+-][0-9]{2}:?[0-9]{2}))?)?",
}
LANGUAGE = r"(?:x-default|[A-Za-z]{2,3}(?:-[A-Za-z]{4})?(?:-[A-Za-z]{2}|-[0-9]{3})?)"
LINK = re.compile(rf"""{LANGUAGE}\s*(?:=|:|\||\s)\s*https?://(?:[^\s;|"',]|,(?!\s*(?:$|[,;|"'\s]|{LANGUAGE}\s*[=:|\s]\s*https?:)))+""", re.I)
ARGUMENTS = {k: re.compile(rf"\s*:\s*(?:{v})", re.I) for k, v in WITH_ARGUMENT.items()}
QUOTED = {'"': re.compile(r'"((?:[^"]|"")*)"'), "'": re.compile(r"'((?:[^']|'')*)'")}
SPLIT = frozenset(",;|[]")
LOOSE = frozenset("/+&")  # delimiters only beside white space, another delimiter or an end
WORD = re.compile(r"[^\s,;|\[\]]+")
#: Every character at which a cell may be split, white space as ``str.isspace`` has it, for Java.
DELIMITERS = r"[,;|/+&\[\]\x1C-\x1F\x{85}" + X.SPACE[1:]
#: Costs of a quoted text, a known value and an unknown word.
C_QUOTED, C_KNOWN, C_UNKNOWN = 9, 10, 20
#: Values, and their bytes as counted by ``size_bytes``, up to which a dictionary becomes an automaton in each task.
MOST_LOOKUP, LOOKUP_BYTES = 50_000, 8 << 20
INSIDE = re.compile(r"[\s,;|\[\]]")


def fold(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    return low.replace("ς", "σ")


def digest(field: str, folded: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{field}\0{folded}".encode("utf-8", "surrogatepass"))


class Segmenter:
    """Splits the cells of one field by a dictionary of whole values."""

    def __init__(self, field: str, values: list[str]):
        self.field = field
        plain = {fold(v) for v in values if not INSIDE.search(v)}
        if field == "meta_robots":
            plain |= {*DIRECTIVES, *WITH_ARGUMENT}
        self._build(plain)
        # a value with delimiters inside counts only if it isn't made of known values
        whole = {fold(v) for v in values if INSIDE.search(v)}
        kept = {v for v in whole if any(k == C_UNKNOWN for _, k in self.cover(v))}
        if kept:
            self._build(plain | kept)
        self.split = lru_cache(1 << 16)(self._split)

    def _build(self, words: set[str]) -> None:
        import ahocorasick  # of executors and of this problem alone

        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(w, w)
        if words:
            self.automaton.make_automaton()
        self.empty = not words

    @staticmethod
    def _edge(cell: str, i: int) -> bool:
        """Whether a value may begin or end at the character (of either side) i."""
        return not 0 <= i < len(cell) or cell[i] in SPLIT or cell[i] in LOOSE or cell[i] in "\"'" or cell[i].isspace()

    def _delimiter(self, cell: str, i: int) -> bool:
        c = cell[i]
        if c in SPLIT or c.isspace():
            return True
        if c not in LOOSE:
            return False
        before, after = i == 0 or cell[i - 1].isspace() or cell[i - 1] in SPLIT or cell[i - 1] in "\"'", i + 1 == len(cell) or cell[i + 1].isspace() or cell[i + 1] in SPLIT or cell[i + 1] in "\"'"
        return before or after

    def stretches(self, cell: str, longest: int) -> Iterator[tuple[int, int]]:
        """(start, end) of what may be a value of at most ``longest`` characters: from edge to edge."""
        n = len(cell)
        edges = [i for i in range(n) if self._edge(cell, i)]
        ends, k = [*edges, n], 0
        for start in [0, *(i + 1 for i in edges)]:
            while k < len(ends) and ends[k] <= start:
                k += 1
            for end in ends[k:]:
                if end - start > longest:
                    break
                yield start, end

    def cover(self, cell: str, spans: list[tuple[int, int]] = ()) -> list[tuple[str, int]]:
        """The values of the least costly cover, with the cost by which each came in. ``spans``: known values beside
        those of the automaton."""
        n = len(cell)
        at: dict[int, list[tuple[int, int, str]]] = {}  # start -> (end, cost, text)
        for start, end in spans:
            at.setdefault(start, []).append((end, C_KNOWN, cell[start:end]))
        if not self.empty:
            for end, word in self.automaton.iter(fold(cell)):
                start, end = end - len(word) + 1, end + 1
                if not self._edge(cell, start - 1):
                    continue
                if word in ARGUMENTS and (m := ARGUMENTS[word].match(cell, end)):
                    end = m.end()
                if self._edge(cell, end):
                    at.setdefault(start, []).append((end, C_KNOWN, cell[start:end]))
        if self.field == "hreflang":
            for m in LINK.finditer(cell):
                if self._edge(cell, m.start() - 1):
                    at.setdefault(m.start(), []).append((m.end(), C_KNOWN, m[0]))
        for mark, pattern in QUOTED.items():
            i = cell.find(mark)
            while i >= 0:
                if (i == 0 or self._edge(cell, i - 1) and cell[i - 1] != mark) and (m := pattern.match(cell, i)) and self._edge(cell, m.end()):
                    at.setdefault(i, []).append((m.end(), C_QUOTED, m[1].replace(mark * 2, mark)))
                    i = m.end() - 1
                i = cell.find(mark, i + 1)
        best: list[tuple[int, int, str | None, int] | None] = [None] * (n + 1)  # cost, from, value, kind
        best[0] = (0, -1, None, 0)
        for i in range(n):
            if best[i] is None:
                continue
            cost = best[i][0]
            if self._delimiter(cell, i):
                if best[i + 1] is None or cost < best[i + 1][0]:
                    best[i + 1] = (cost, i, None, 0)
            elif m := WORD.match(cell, i):
                j = m.end()
                if best[j] is None or cost + C_UNKNOWN < best[j][0]:
                    best[j] = (cost + C_UNKNOWN, i, m[0].strip("\"'"), C_UNKNOWN)
            for j, c, text in at.get(i, ()):
                if best[j] is None or cost + c < best[j][0]:
                    best[j] = (cost + c, i, text, c)
        out, i = [], n
        while i > 0:
            _, j, value, kind = best[i]
            if value is not None and value.strip():
                out.append((value.strip(), kind))
            i = j
        return out[::-1]

    def _split(self, cell: str) -> list[str]:
        return [v for v, _ in self.cover(cell)]


def learned(urls: DataFrame, fields: tuple[str, ...] = FIELDS, support: int = 3) -> DataFrame:
    """(field_name, value): values that stand alone in a cell or in quotes in at least ``support`` cells."""
    cells = urls.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), X.trimmed(F.col(f)).alias("cell")) for f in fields if f != "hreflang"])).alias("c")).select("c.*").where("cell <> ''")
    alone = F.when(~F.col("cell").rlike(r"""[\s,;|\[\]"']"""), F.array("cell")).otherwise(F.array().cast("array<string>"))
    quoted = F.transform(F.regexp_extract_all("cell", F.lit(r'(?:^|[\s,;|\[/])"((?:[^"]|"")*)"'), 1), lambda v: X.trimmed(F.replace(v, F.lit('""'), F.lit('"'))))
    seen = cells.select("field_name", F.explode(F.concat(alone, quoted)).alias("value")).where("value <> ''")
    return seen.groupBy("field_name", "value").count().where(F.col("count") >= support).select("field_name", "value")


def fits(words: DataFrame) -> bool:
    """Whether a (written) dictionary may become an automaton in each task."""
    return words.count() <= MOST_LOOKUP and size_bytes(words) <= LOOKUP_BYTES


def collected(words: DataFrame, fields: tuple[str, ...] = FIELDS) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {f: [] for f in fields}
    for r in words.orderBy("field_name", "value").collect():
        out[r["field_name"]].append(r["value"])
    return out


def dictionary(urls: DataFrame, fields: tuple[str, ...] = FIELDS, support: int = 3) -> dict[str, list[str]]:
    """The learned values by field, where they fit into a task; refused where they don't."""
    words = written(learned(urls, fields, support))
    if not fits(words):
        raise ValueError("the dictionary is too large for one task: see values()")
    return collected(words, fields)


def _splitter(known: dict[str, list[str]], least: int):
    state: dict[str, Segmenter] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not state:
                state.update({f: Segmenter(f, v) for f, v in known.items()})
            items = [state[f].split(c) for f, c in zip(b.column("field_name").to_pylist(), b.column("cell").to_pylist(), strict=True)]
            keep = pa.array([i for i, x in enumerate(items) if len(x) >= least], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("ord").take(keep), b.column("field_name").take(keep), pa.array(items, pa.list_(pa.string())).take(keep)], names=["ord", "field_name", "items"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fields, values_ = b.column("field_name").to_pylist(), b.column("value").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([digest(f, fold(v)) for f, v in zip(fields, values_, strict=True)], pa.binary()), pa.array([len(v) for v in values_], pa.int32())], names=["key", "size"])


def _stretches(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, Segmenter] = {}
        kinds = {"row": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "key": pa.binary()}
        for b in batches:
            rows: list[tuple] = []
            for row, f, cell in zip(b.column("row").to_pylist(), b.column("field_name").to_pylist(), b.column("cell").to_pylist(), strict=True):
                low = fold(cell)
                rows += [(row, i, j, digest(f, low[i:j])) for i, j in state.setdefault(f, Segmenter(f, [])).stretches(cell, longest)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return run


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict[str, Segmenter] = {}
    for b in batches:
        got = [
            state.setdefault(f, Segmenter(f, [])).cover(c, [(x["start"], x["stop"]) for x in spans or ()])
            for f, c, spans in zip(b.column("field_name").to_pylist(), b.column("cell").to_pylist(), b.column("spans").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([[v for v, _ in x] for x in got], pa.list_(pa.string())), pa.array([any(k == C_UNKNOWN for _, k in x) for x in got], pa.bool_())], names=["row", "items", "unknown"])


def _joined(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, items, unknown) of cells (row, field_name, cell), the known values being a table of (key, size)."""
    longest = keys.agg(F.max("size")).first()[0] or 0
    spans = map_arrow(cells, _stretches(longest), "row long, start int, stop int, key binary")
    hits = spans.join(keys.select("key").distinct(), "key").groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # bounded by one cell
    return map_arrow(cells.join(hits, "row", "left"), _covers, "row long, items array<string>, unknown boolean")


def _by_join(cells: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(ord, field_name, items) by a dictionary that stays a table."""
    inside = F.col("value").rlike(r"[,;|\[\]\x1C-\x1F\x{85}" + X.SPACE[1:])
    plain = written(map_arrow(words.where(~inside), _digests, "key binary, size int"))
    whole = written(words.where(inside).withColumn("row", F.monotonically_increasing_id()))
    lone = _joined(whole.select("row", "field_name", F.col("value").alias("cell")), plain).where("unknown")  # not made of known values
    kept = map_arrow(whole.join(lone.select("row"), "row", "left_semi").select("field_name", "value"), _digests, "key binary, size int")
    cells = written(cells.withColumn("row", F.monotonically_increasing_id()))
    got = _joined(cells.select("row", "field_name", "cell"), written(plain.unionByName(kept)))
    return cells.select("row", "ord", "field_name").join(got.where(F.size("items") >= least).select("row", "items"), "row").drop("row")


def values(urls: DataFrame, fields: tuple[str, ...] = FIELDS, least: int = 1, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(ord, field_name, pos, item) of the cells that hold at least ``least`` values. Cells that can't hold ``least``
    values, having no delimiter, don't leave the JVM."""
    cells = urls.select(F.col("ord").cast("long").alias("ord"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), X.trimmed(F.col(f)).alias("cell")) for f in fields])).alias("c")).select("ord", "c.*")
    cells = cells.where(F.col("cell") != "").where(F.col("cell").rlike(DELIMITERS) if least > 1 else F.lit(True))
    words = written(learned(urls, fields)) if known is None else None
    if words is None or fits(words):
        out = map_arrow(cells, _splitter(collected(words, fields) if known is None else known, least), "ord long, field_name string, items array<string>")
    else:
        out = _by_join(cells, words, least)
    return out.select("ord", "field_name", F.posexplode("items").alias("pos", "item")).select("ord", "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "item")
