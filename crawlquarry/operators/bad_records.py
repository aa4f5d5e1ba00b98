"""Delimited records that fail to parse: loaded rows on one side, faulty records with their reason on the other.

A five-state automaton reads the records. Its transition functions form a small finite monoid, so a chunk of bytes is
summed up as ONE element of that monoid whatever state it is entered in: all chunks of a batch are read at once, their
elements are composed in a prefix scan, and only then does each chunk learn its entry state. A record of any length is
just several chunks; nothing is read twice and nothing depends on where chunks are cut.

Defined results
    null, empty and white-space-only records are skipped: neither loaded nor faulty; so are the header of a file and
    everything before it. A file without a header has no columns: its records are neither loaded nor faulty.
    A null ``file_id`` is a file of its own; a null ``line_no`` can't be placed after a header and is skipped.
    Records delivered twice are one case and one row (the latest delivery counts; a tie takes the greater text).
    Extra columns of the input don't matter, whatever their names. An empty table gives empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.functions.arrow import map_arrow
from crawlquarry.plans.sized import small, written
from crawlquarry.schema import COLUMNS, HEADERS

SEPARATORS = (",", ";", "\t", "|")

# States, byte classes and transitions of the automaton.
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
OTHER, QUOTE, SEP, END, PAD, REOPEN = range(6)
STEP = {
    OTHER: (PLAIN, PLAIN, QUOTED, BROKEN, BROKEN),
    QUOTE: (QUOTED, BROKEN, CLOSED, QUOTED, BROKEN),
    SEP: (START, START, QUOTED, START, BROKEN),
    END: (START, START, START, START, START),
    PAD: (START, PLAIN, QUOTED, CLOSED, BROKEN),
    REOPEN: (QUOTED, QUOTED, QUOTED, QUOTED, QUOTED),  # a line of a file read as the inside of a quoted field
}
CLASSES = len(STEP)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that byte strings can have, as: next function by (function, class); composition; value by state."""
    known, todo = {STEP[PAD]: 0}, [STEP[PAD]]
    while todo:
        f = todo.pop()
        for c in range(CLASSES):
            g = tuple(STEP[c][s] for s in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
    fs = list(known)
    after = np.array([[known[tuple(STEP[c][s] for s in f)] for c in range(CLASSES)] for f in fs], dtype=np.uint8)
    both = np.array([[known[tuple(g[s] for s in f)] for g in fs] for f in fs], dtype=np.uint8)
    return after, both, np.array(fs, dtype=np.uint8)


AFTER, COMPOSE, VALUE = _monoid()


def summed(classes: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the monoid: of every byte's prefix within its chunk (by offset and chunk), and of all bytes up to the
    end of each chunk."""
    n = len(classes)
    rows = max(1, -(-n // chunk))
    grid = np.full(rows * chunk, PAD, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)  # one row per offset within the chunks
    funcs = np.empty_like(grid)
    f = np.zeros(rows, np.intp)
    flat = AFTER.ravel()
    for at in range(chunk):  # every chunk advances by one byte
        f = flat.take(f * CLASSES + grid[at]).astype(np.intp)
        funcs[at] = f
    prefix, step = funcs[-1].copy(), 1
    while step < rows:  # inclusive scan of the chunks' functions
        joined = COMPOSE[prefix[:-step], prefix[step:]]
        prefix[step:] = joined
        step *= 2
    return funcs, prefix


def states(classes: np.ndarray, chunk: int = 256, start: int = START) -> np.ndarray:
    """State after each byte, from ``start``, for bytes given by their class."""
    funcs, prefix = summed(classes, chunk)
    entry = np.full(len(prefix), start, np.intp)
    entry[1:] = VALUE[prefix[:-1], start]
    return VALUE.ravel().take(funcs.astype(np.intp) * 5 + entry).T.reshape(-1)[: len(classes)]


def tokenize(lines: list[bytes], seps: list[str]) -> dict:
    """Fields of each record, by its own separator. Keys: ``broken`` (bool), ``offset`` (of the fault in bytes, -1 if
    none), ``fields`` (number), ``field(record, k)`` (text of a field, quotes resolved)."""
    size = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    text = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    sep = np.repeat(np.fromiter((ord(s) for s in seps), np.uint8, len(seps)), size + 1)
    classes = np.where(text == 34, QUOTE, np.where(text == sep, SEP, OTHER)).astype(np.uint8)
    classes[ends] = END
    state = states(classes)
    before = np.concatenate([[START], state[:-1]])
    last = before[ends]
    broken = (last == BROKEN) | (last == QUOTED)
    offset = np.full(len(lines), -1, np.int64)
    # where a record breaks: its first byte that leads to BROKEN, or the quote that is never closed
    for hits, kind in (((state == BROKEN) & (before != BROKEN), BROKEN), ((state == QUOTED) & (before == START), QUOTED)):
        at = np.flatnonzero(hits)
        record = np.searchsorted(ends, at)
        mine = last[record] == kind
        offset[record[mine]] = at[mine] - starts[record[mine]]  # of several opening quotes the last stays
    cuts = np.flatnonzero((classes == SEP) & (state == START))
    first = np.searchsorted(cuts, starts)
    count = np.searchsorted(cuts, ends) - first + 1

    def field(r: int, k: int) -> str:
        lo = int(starts[r]) if k == 0 else int(cuts[first[r] + k - 1]) + 1
        hi = int(ends[r]) if k == count[r] - 1 else int(cuts[first[r] + k])
        raw = lines[r][lo - int(starts[r]) : hi - int(starts[r])].decode()
        return raw[1:-1].replace('""', '"') if raw[:1] == '"' else raw

    return {"broken": broken, "offset": offset, "fields": count, "field": field}


_ADDRESS = re.compile(r"https?://[^\s/?#:]\S*", re.I)
_STATUS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+")


def invalid(address: str, status: str, words: str) -> bool:
    address, status, words = address.strip(), status.strip(), words.strip()
    if not _ADDRESS.fullmatch(address):
        return True
    if status and not (_STATUS.fullmatch(status) and (int(status) == 0 or 100 <= int(status) <= 599)):
        return True
    return bool(words) and not _WORDS.fullmatch(words)


def _headers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [x.lstrip("﻿").encode() for x in b.column("raw_line").to_pylist()]
        best: list[tuple[str, list[str], list[str]] | None] = [None] * len(lines)
        for sep in SEPARATORS:
            t = tokenize(lines, [sep] * len(lines))
            for r in range(len(lines)):
                if not t["broken"][r]:
                    raw = [t["field"](r, k).replace("﻿", "") for k in range(int(t["fields"][r]))]
                    names = [re.sub(r"\s+", " ", x.strip()).lower() for x in raw]
                    if any(HEADERS.get(x) == "url" for x in names) and (best[r] is None or len(names) > len(best[r][1])):
                        best[r] = (sep, names, raw)
        keep = [r for r, x in enumerate(best) if x]
        yield pa.RecordBatch.from_pydict(
            {"file_id": b.column("file_id").take(pa.array(keep, pa.int64())), "line_no": b.column("line_no").take(pa.array(keep, pa.int64())), "sep": [best[r][0] for r in keep], "names": [best[r][1] for r in keep], "raw_names": [best[r][2] for r in keep]},
            schema=pa.schema([("file_id", pa.int64()), ("line_no", pa.int64()), ("sep", pa.string()), ("names", pa.list_(pa.string())), ("raw_names", pa.list_(pa.string()))]),
        )


def headers(records: DataFrame, within: int | None = None) -> DataFrame:
    """(file_id, header_line, sep, names, raw_names): the first record of each file (of its first ``within`` lines, if given) that
    names an address column, and the separator by which it has the most fields. Only records that may be headers leave
    the JVM."""
    maybe = records.select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), "raw_line").where(
        F.col("raw_line").rlike(r'(?i)(?:^|[,;\t|"\x{FEFF}])\s*(?:address|url)\s*(?:$|[,;\t|"])') & (F.col("line_no").isNotNull() if within is None else F.col("line_no") <= within)
    )
    found = map_arrow(maybe, _headers_of, "file_id long, line_no long, sep string, names array<string>, raw_names array<string>")
    return found.groupBy("file_id").agg(F.min(F.struct("line_no", "sep", "names", "raw_names")).alias("h")).select("file_id", F.col("h.line_no").alias("header_line"), "h.sep", "h.names", "h.raw_names")


def _reader(with_fields: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file_id", pa.int64()), ("line_no", pa.int64()), ("reason", pa.string()), ("error_offset", pa.int64())]
        schema = pa.schema(kinds + [("fields", pa.list_(pa.string()))] * with_fields)
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("raw_line", "sep", "n", "i_url", "i_status", "i_words")}
            lines = [x.encode() for x in col["raw_line"]]
            t = tokenize(lines, col["sep"])
            reasons: list[str | None] = []
            offsets, rows = [], []
            field = t["field"]
            for r, (n, iu, ist, iw) in enumerate(zip(col["n"], col["i_url"], col["i_status"], col["i_words"], strict=True)):
                at = int(t["offset"][r])
                if t["broken"][r]:
                    why = "quoting"
                elif t["fields"][r] != n:
                    why = "column_count"
                else:
                    why = "invalid_value" if invalid(field(r, iu), field(r, ist) if ist >= 0 else "", field(r, iw) if iw >= 0 else "") else None
                reasons.append(why)
                offsets.append(at if why == "quoting" else None)
                if with_fields:
                    rows.append(None if why else [field(r, k) for k in range(n)])
            keep = pa.array([r for r in range(len(lines)) if with_fields or reasons[r]], pa.int64())
            out = [b.column("file_id"), b.column("line_no"), pa.array(reasons, pa.string()), pa.array(offsets, pa.int64())]
            if with_fields:
                out.append(pa.array(rows, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([x.take(keep) for x in out], schema=schema)

    return read


def _position(names: Column, key: str) -> Column:
    """Zero-based place of the first header of a canonical column, -1 if there is none."""
    wanted = F.array(*[F.lit(x) for x in COLUMNS[key][1]])
    return F.coalesce(F.array_position(F.transform(names, lambda x: F.array_contains(wanted, x)), True), F.lit(0)).cast("int") - 1


def _with_headers(records: DataFrame, within: int | None = None) -> tuple[DataFrame, DataFrame]:
    head = written(headers(records, within))
    facts = head.select(
        F.col("file_id").alias("h_file"), "header_line", "sep", F.size("names").alias("n"), _position(F.col("names"), "url").alias("i_url"),
        _position(F.col("names"), "status_code").alias("i_status"), _position(F.col("names"), "word_count").alias("i_words"),
    )
    rows = records.select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), "raw_line", "loaded_at").where(X.has(F.col("raw_line")))
    return rows.join(small(facts), F.col("file_id").eqNullSafe(F.col("h_file")) & (F.col("line_no") > F.col("header_line"))), head


def faulty(records: DataFrame, within: int | None = None) -> DataFrame:
    """(file_id, line_no, reason, error_offset) of the records that can't be loaded, one row per (file_id, line_no).
    Input: file_id, line_no, raw_line, loaded_at. Rows that are fine never leave the reader; one pass, and a shuffle
    of the faults alone. ``within``: records of a file in which its header is looked for, all if not given."""
    joined, _ = _with_headers(records, within)
    bad = map_arrow(joined.drop("loaded_at", "h_file", "header_line"), _reader(False), "file_id long, line_no long, reason string, error_offset long")
    return bad.groupBy("file_id", "line_no").agg(F.min(F.struct("reason", "error_offset")).alias("f")).select("file_id", "line_no", "f.reason", "f.error_offset")


def _cell_position(names: Column, key: str, override: dict[str, str]) -> Column:
    """Place of the cell that fills a canonical column: the last header that ``override`` gives to it; else that of its
    first own header, the last one if that header is repeated."""
    size = F.size(names)
    forced = F.array(*[F.lit(h) for h, k in override.items() if k == key]).cast("array<string>")
    own = F.array(*[F.lit(h) for h in COLUMNS[key][1] if override.get(h, key) == key]).cast("array<string>")
    last = lambda wanted: size - F.array_position(F.transform(F.reverse(names), lambda x: F.array_contains(wanted, x)), True)
    first_own = F.get(F.filter(names, lambda x: F.array_contains(own, x)), F.lit(0))
    at = F.when(F.exists(names, lambda x: F.array_contains(forced, x)), last(forced)) if any(k == key for k in override.values()) else F.lit(None)
    return F.coalesce(at, F.when(first_own.isNotNull(), size - F.array_position(F.reverse(names), first_own)), F.lit(-1)).cast("int")


def typed(records: DataFrame, override: dict[str, str] | None = None, within: int | None = None) -> DataFrame:
    """The loaded rows: file_id, line_no and the canonical columns in their types; cells under other headers in
    ``extra``, by the header as it is written (a repeated one with ``#`` and its place). Values are coerced as in :mod:`crawlquarry.functions.exprs`; the first header of a canonical column
    wins, a second, different one goes to ``extra``; of the same header repeated the last cell counts. ``override`` maps
    headers (in any spelling) to canonical columns before the known names do."""
    override = {" ".join(h.split()).lower(): k for h, k in (override or {}).items()}
    joined, head = _with_headers(records, within)
    once = joined.groupBy("file_id", "line_no").agg(F.max(F.struct("loaded_at", "raw_line", "sep", "n", "i_url", "i_status", "i_words")).alias("r")).select("file_id", "line_no", "r.*")
    good = map_arrow(once.drop("loaded_at"), _reader(True), "file_id long, line_no long, reason string, error_offset long, fields array<string>").where("reason is null")
    names = head.select(F.col("file_id").alias("h_file"), F.col("names"), F.col("raw_names"), F.struct(*[_cell_position(F.col("names"), k, override).alias(k) for k in COLUMNS]).alias("at"))
    rows = good.join(small(names), F.col("file_id").eqNullSafe(F.col("h_file")))
    used = F.array(*[F.col(f"at.{k}") for k in COLUMNS])
    cast = {"string": X.blank_to_null, "int": X.to_int, "bool": X.to_bool, "indexability": X.to_indexability}
    extra = F.map_from_entries(
        F.filter(
            F.array_distinct(F.transform(F.col("raw_names"), lambda x, i: F.struct(F.concat(x, F.when(F.array_position(F.col("raw_names"), x) != i + 1, F.concat(F.lit("#"), i.cast("string"))).otherwise("")).alias("key"), F.when(F.array_contains(used, i), F.lit("")).otherwise(F.get(F.col("fields"), i)).alias("value")))),
            lambda e: F.trim(e["value"]) != "",
        )
    )
    return rows.select("file_id", "line_no", *[cast[kind](F.when(F.col(f"at.{k}") >= 0, F.get(F.col("fields"), F.col(f"at.{k}")))).alias(k) for k, (kind, _) in COLUMNS.items()], extra.alias("extra"))


