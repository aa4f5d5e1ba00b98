"""Crawl exports from files: plain CSV of any size, archives of CSVs, directories.

Files are read in ranges by many tasks, members of archives by a task each. A range owns the lines that begin in it. Two
hypotheses are read over it at once by the tokenizer's monoid: each line as the beginning of a record, and each line as
the inside of a quoted field. A record is one line, or the lines up to the first at which its open quote is closed rightly
and that gives it as many fields as the header has. Where there is no such line the quote is never closed: its first line
is a record of its own, to be reported as faulty, and reading goes on with the next line, so that a lost quotation mark
costs one line and not the rest of the file. What a range needs to know of the others (where a quote left open at its end
is closed, where its first record begins, how many records come before) is composed per file from a few numbers a range,
on executors; a second pass emits the records. Nothing depends on where ranges are cut.

Defined results
    A path that is neither .csv nor .zip, an archive that can't be opened, and a file that isn't there give a warning and
    no records. A missing directory has no files. Bytes that aren't UTF-8 are replaced. A byte-order mark is kept in the
    first record (the header's reader drops it). Line numbers count records from 1, empty ones included. The separator is
    that of the first line naming an address column, however far down; in a file without such a line that of its first
    line, and records may then have any number of fields.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.functions.arrow import map_arrow, ship
from crawlquarry.operators import bad_records as B
from crawlquarry.operators import merge
from crawlquarry.plans.sized import written
from crawlquarry.schema import HEADERS

#: Plain files above this are read in ranges of this size.
RANGE_BYTES = 64 << 20
#: Members of an archive that can be told apart by their file_id: path number * 2**PART_BITS + member.
PART_BITS = 20
SCHEMA = "file_id long, file_name string, line_no long, raw_line string, warning string"
_KINDS = pa.schema([("file_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int64()), ("raw_line", pa.string()), ("warning", pa.string())])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), os.path.abspath(path))


def discover(folder: str) -> list[str]:
    """Regular files of a folder, not of its subfolders, whose name ends in .csv in any case; sorted."""
    system, path = _system(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=False))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".csv"))


def sizes(paths: list[str]) -> dict[str, int]:
    """Bytes of each file that is there, asked for by file system all at once."""
    out: dict[str, int] = {}
    by: dict[str, tuple[fs.FileSystem, list[tuple[str, str]]]] = {}
    for p in paths:
        system, inner = _system(p)
        by.setdefault(system.type_name, (system, []))[1].append((p, inner))
    for system, both in by.values():
        for (p, _), info in zip(both, system.get_file_info([inner for _, inner in both]), strict=True):
            if info.type == fs.FileType.File:
                out[p] = info.size
    return out


def _classes(data: np.ndarray, sep: str, newline: int = B.END) -> np.ndarray:
    """Classes of bytes, lines being read one by one: a line break leads to the beginning of a record (END) or back into a
    quoted field (REOPEN). A carriage return before it belongs to it."""
    out = np.where(data == 34, B.QUOTE, np.where(data == ord(sep), B.SEP, B.OTHER)).astype(np.uint8)
    ends = data == 10
    out[ends] = newline
    out[:-1][(data[:-1] == 13) & ends[1:]] = B.PAD
    return out


class Lines:
    """The lines of some bytes and how each reads as the beginning of a record (a) and inside a quoted field (b):
    0 complete, 1 broken, 2 the quote is open at its end; with the separators that count."""

    def __init__(self, data: np.ndarray, sep: str, width: int | None):
        self.width = width
        if len(data) == 0 or data[-1] != 10:
            data = np.append(data, np.uint8(10))
        self.ends = np.flatnonzero(data == 10)
        self.starts = np.append(0, self.ends[:-1] + 1)
        n = len(self.ends)

        def read(entry: int, newline: int) -> tuple[np.ndarray, np.ndarray]:
            classes = _classes(data, sep, newline)
            state = B.states(classes, start=entry)
            before = np.append(entry, state[:-1])[self.ends]
            before[self.ends == self.starts] = entry  # an empty line
            marks = np.append(0, np.cumsum((classes == B.SEP) & (state == B.START)))
            return np.where(before == B.QUOTED, 2, np.where(before == B.BROKEN, 1, 0)), marks[self.ends + 1] - marks[self.starts]

        self.a, self.seps_a = read(B.START, B.END)
        self.b, seps_b = read(B.QUOTED, B.REOPEN)
        self.upto = np.append(0, np.cumsum(seps_b))  # separators inside quoted reading, before each line
        closing = np.where(self.b != 2, np.arange(n), n)
        self.next = np.append(np.minimum.accumulate(closing[::-1])[::-1], n)  # the first line at or behind, at which a quote ends
        self.last = int(np.flatnonzero(self.b != 2)[-1]) if (self.b != 2).any() else -1

    def fits(self, fields: int) -> bool:
        return self.width is None or fields == self.width

    def inner(self) -> dict[int, int]:
        """Records of several lines that end here, first line -> last."""
        out = {}
        for at in np.flatnonzero(self.a == 2).tolist():
            m = int(self.next[at + 1])
            if m < len(self.ends) and self.b[m] == 0 and self.fits(int(self.seps_a[at] + self.upto[m + 1] - self.upto[at + 1]) + 1):
                out[at] = m
        return out

    def tail(self) -> list[tuple[int, int]]:
        """(line, fields so far) of the lines whose quote is still open at the end."""
        n = len(self.ends)
        return [(at, int(self.seps_a[at] + self.upto[n] - self.upto[at + 1])) for at in np.flatnonzero(self.a == 2).tolist() if at >= self.last]

    def begins(self, entry: int, inner: dict[int, int], stop: int) -> list[int]:
        """Lines below ``stop`` at which records begin, from the line ``entry`` on."""
        out, at = [], entry
        while at < stop:
            out.append(at)
            at = inner.get(at, at) + 1
        return out


def _guess(lines: list[str]) -> tuple[str, int] | None:
    """(separator, fields) of the first line that names an address column."""
    for line in lines:
        names = {s: [x.strip().strip('"').strip().lower() for x in line.lstrip("﻿").split(s)] for s in B.SEPARATORS}
        fit = [s for s in B.SEPARATORS if any(HEADERS.get(" ".join(x.split())) == "url" for x in names[s])]
        if fit:
            sep = max(fit, key=lambda s: len(names[s]))
            t = B.tokenize([line.lstrip("﻿").rstrip("\r").encode("utf-8", "replace")], [sep])
            return sep, -1 if t["broken"][0] else int(t["fields"][0])
    return None


def _first(line: str) -> tuple[str, int]:
    return max(B.SEPARATORS, key=lambda s: line.count(s)), -1


def _layout(path: str, size: int) -> tuple[str, int]:
    """(separator, fields of the header or -1) of a file; reads on until a line names an address column."""
    first, rest, at = None, b"", 0
    while at < size:
        block = _read(path, at, 1 << 20)
        at += len(block)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if at < size and block else b""
        texts = [x.decode("utf-8", "replace") for x in lines]
        first = texts[0] if first is None and texts else first
        if (found := _guess(texts)) or not block:
            return found or _first(first or "")
    return _guess([rest.decode("utf-8", "replace")]) or _first(first or rest.decode("utf-8", "replace"))


def split_records(raw: bytes, sep: str | None = None) -> list[str]:
    """The records of a whole file."""
    if not raw:
        return []
    texts = raw.decode("utf-8", "replace").split("\n")
    found = (sep, -1) if sep else _guess(texts) or _first(texts[0])
    lines = Lines(np.frombuffer(raw, np.uint8), found[0], found[1] if found[1] > 0 else None)
    inner = lines.inner()
    return [raw[lines.starts[at] : lines.ends[inner.get(at, at)]].removesuffix(b"\r").decode("utf-8", "replace") for at in lines.begins(0, inner, len(lines.ends))]


def _batches(file_id: int, name: str, first: int, lines: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(lines), 20_000):
        some = lines[at : at + 20_000]
        n = len(some)
        yield pa.RecordBatch.from_pydict({"file_id": [file_id] * n, "file_name": [name] * n, "line_no": list(range(first + at, first + at + n)), "raw_line": some, "warning": [None] * n}, schema=_KINDS)


def _warning(file_id: int, name: str, why: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file_id": [file_id], "file_name": [name], "line_no": [None], "raw_line": [None], "warning": [why[:200]]}, schema=_KINDS)


def _read(path: str, start: int, size: int) -> bytes:
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        return f.read_at(size, start)


def _line_end(path: str, at: int, size: int) -> int:
    """The byte behind the first line break at or behind ``at``."""
    while at < size:
        block = _read(path, at, 1 << 20)
        hit = block.find(b"\n")
        if hit >= 0:
            return at + hit + 1
        at += len(block) or size
    return size


def _owned(r: dict) -> tuple[int, bytes]:
    """(first byte, bytes) of the lines that begin in a range."""
    start = r["start"] if r["start"] == 0 else _line_end(r["path"], r["start"] - 1, r["size"])
    stop = min(r["start"] + r["bytes"], r["size"])
    if start >= stop:
        return start, b""
    stop = _line_end(r["path"], stop - 1, r["size"])
    return start, _read(r["path"], start, stop - start)


RANGE = "file_id long, path string, size long, start long, bytes long, sep string, width int"
SUMS = RANGE + ", lines long, closes long, closes_right boolean, closes_seps long, closes_at long, seps long, inside long, from_start long, from_close long, last_from_start boolean, last_from_close boolean, tail array<struct<line:long,fields:long>>"
PLACED = RANGE + ", entry long, first long, tail_line long, tail_stop long"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            r["sep"], r["width"] = _layout(r["path"], r["size"])
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("sep", pa.string()), ("width", pa.int32())]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {k: pa.int64() for k in ("file_id", "size", "start", "bytes", "lines", "closes", "closes_seps", "closes_at", "seps", "inside", "from_start", "from_close")} | {"path": pa.string(), "sep": pa.string(), "width": pa.int32(), "closes_right": pa.bool_(), "last_from_start": pa.bool_(), "last_from_close": pa.bool_()}
    kinds["tail"] = pa.list_(pa.struct([("line", pa.int64()), ("fields", pa.int64())]))
    names = [x.split()[0] for x in SUMS.split(", ")]
    for b in batches:
        out = []
        for r in b.to_pylist():
            start, raw = _owned(r)
            if not raw:
                out.append(r | {"lines": 0, "closes": -1, "closes_right": False, "closes_seps": 0, "closes_at": 0, "seps": 0, "inside": 0, "from_start": 0, "from_close": 0, "last_from_start": False, "last_from_close": False, "tail": []})
                continue
            x = Lines(np.frombuffer(raw, np.uint8), r["sep"], r["width"] if r["width"] > 0 else None)
            inner, n = x.inner(), len(x.ends)
            c = int(x.next[0]) if x.next[0] < n else -1
            begins = [x.begins(entry, inner, x.last + 1) for entry in (0, c + 1)]
            out.append(
                r | {"lines": n, "closes": c, "closes_right": bool(c >= 0 and x.b[c] == 0), "closes_seps": int(x.upto[c + 1]), "closes_at": start + int(x.ends[c]) if c >= 0 else 0, "seps": int(x.upto[n]), "inside": x.last + 1}
                | {f"from_{k}": len(v) for k, v in zip(("start", "close"), begins, strict=True)} | {f"last_from_{k}": x.last in v[-1:] for k, v in zip(("start", "close"), begins, strict=True)}
                | {"tail": [{"line": at, "fields": k} for at, k in x.tail()]}
            )
        yield pa.RecordBatch.from_pylist([{k: o[k] for k in names} for o in out], schema=pa.schema([(k, kinds[k]) for k in names]))


def _placed(sums):
    """The ranges of ONE file (16,000 a TB) with where their records begin and how a record open at their end closes."""
    import pandas as pd

    rows = sums.sort_values("start").to_dict("records")
    closing: list[tuple[bool, int, int, int] | None] = [None] * len(rows)  # (rightly, separators, byte, range) behind each range
    for k in range(len(rows) - 2, -1, -1):
        n, c = rows[k + 1], closing[k + 1]
        closing[k] = (n["closes_right"], n["closes_seps"], n["closes_at"], k + 1) if n["closes"] >= 0 else c and (c[0], c[1] + n["seps"], c[2], c[3])
    out, entry, first, skip = [], 0, 1, -1
    for k, r in enumerate(rows):
        if k < skip:  # the whole range is inside a record
            out.append({**r, "entry": -1, "first": first, "tail_line": -1, "tail_stop": -1})
            continue
        if k != skip:
            entry = 0
        begins = (r["from_start"] if entry == 0 else r["from_close"]) if r["lines"] else 0
        last = r["last_from_start"] if entry == 0 else r["last_from_close"]
        line, stop = -1, -1
        c = closing[k]
        for t in r["tail"]:
            if t["line"] >= entry and (t["line"] >= r["inside"] or last) and c and c[0] and (r["width"] <= 0 or t["fields"] + c[1] + 1 == r["width"]):
                line, stop, skip = t["line"], c[2], c[3]
                break
        out.append({**r, "entry": entry, "first": first, "tail_line": line, "tail_stop": stop})
        first += begins + (line + 1 if line >= 0 else r["lines"]) - max(r["inside"], entry)
        entry = rows[skip]["closes"] + 1 if line >= 0 else 0
    names = [x.split()[0] for x in PLACED.split(", ")]
    return pd.DataFrame(out)[names]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            if r["entry"] < 0:
                continue
            start, raw = _owned(r)
            if not raw:
                continue
            x = Lines(np.frombuffer(raw, np.uint8), r["sep"], r["width"] if r["width"] > 0 else None)
            inner, stop = x.inner(), r["tail_line"] if r["tail_line"] >= 0 else len(x.ends)
            got = [raw[x.starts[at] : x.ends[inner.get(at, at)]] for at in x.begins(r["entry"], inner, stop)]
            if r["tail_line"] >= 0:
                at = start + int(x.starts[r["tail_line"]])
                got.append(_read(r["path"], at, r["tail_stop"] - at))
            yield from _batches(r["file_id"], os.path.basename(r["path"]), r["first"], [g.removesuffix(b"\r").decode("utf-8", "replace") for g in got])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, path, member, warning): what an archive holds; only its directory is read."""
    kinds = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("member", pa.string()), ("warning", pa.string())])
    for b in batches:
        for i, path in zip(b.column("file_id").to_pylist(), b.column("path").to_pylist(), strict=True):
            out = {"file_id": [], "path": [], "member": [], "warning": []}
            try:
                system, inner = _system(path)
                with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                if len(names) >= 1 << PART_BITS:
                    raise ValueError(f"more than {1 << PART_BITS} files in an archive")
                rows = [(i + k, path, n, None) for k, n in enumerate(names)]
            except Exception as e:
                rows = [(i, path, None, f"{type(e).__name__}: {e}")]
            out = {f.name: [row[k] for row in rows] for k, f in enumerate(kinds)}
            yield pa.RecordBatch.from_pydict(out, schema=kinds)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of members of archives, one at a time."""
    for b in batches:
        for r in b.to_pylist():
            if r["warning"] is not None:
                yield _warning(r["file_id"], os.path.basename(r["path"]), r["warning"])
                continue
            try:
                system, inner = _system(r["path"])
                with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    raw = z.read(r["member"])
            except Exception as e:
                yield _warning(r["file_id"], r["member"], f"{type(e).__name__}: {e}")
                continue
            yield from _batches(r["file_id"], r["member"], 1, split_records(raw))


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of files (file_id, path, size), file_id being a multiple of 2**PART_BITS."""
    spark = files.sparkSession
    ship(spark)
    tasks = spark.sparkContext.defaultParallelism * 4
    low = F.lower("path")
    archives = map_arrow(files.where(low.endswith(".zip")).select("file_id", "path").repartition(tasks, "file_id"), _members, "file_id long, path string, member string, warning string")
    out = map_arrow(archives.repartition(tasks, "file_id"), _whole, SCHEMA)
    plain = map_arrow(files.where(low.endswith(".csv") & (F.col("size") > 0)).select("file_id", "path", "size").repartition(tasks, "file_id"), _ranges, "file_id long, path string, size long, sep string, width int")
    plain = written(plain)
    one = plain.where(F.col("size") <= range_bytes).select("file_id", "path", "size", F.lit(0).cast("long").alias("start"), F.col("size").alias("bytes"), "sep", "width", *[F.lit(v).cast("long").alias(k) for k, v in (("entry", 0), ("first", 1), ("tail_line", -1), ("tail_stop", -1))])
    out = out.unionByName(map_arrow(one.repartition(tasks, "file_id"), _emit, SCHEMA))
    many = plain.where(F.col("size") > range_bytes)
    if not many.isEmpty():
        ranges = many.select("file_id", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"), F.lit(range_bytes).cast("long").alias("bytes"), "sep", "width")
        pieces = max(tasks, int(many.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0]))
        sums = map_arrow(ranges.repartition(min(pieces, 100_000), "file_id", "start"), _sums, SUMS)
        placed = written(sums.groupBy("file_id").applyInPandas(_placed, PLACED))
        out = out.unionByName(map_arrow(placed.repartition(min(pieces, 100_000), "file_id", "start"), _emit, SCHEMA))
    return out


def records(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_id, file_name, line_no, raw_line, warning): the records of files, in the order of ``paths`` by file_id."""
    size = sizes(paths)
    known = [(i << PART_BITS, p, size[p]) for i, p in enumerate(paths) if p in size and p.lower().endswith((".csv", ".zip"))]
    other = [(i << PART_BITS, os.path.basename(p), None, None, "no such file" if p not in size else "neither .csv nor .zip") for i, p in enumerate(paths) if not (p in size and p.lower().endswith((".csv", ".zip")))]
    return spark.createDataFrame(other, SCHEMA).unionByName(read(spark.createDataFrame(known, "file_id long, path string, size long"), range_bytes))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(folder)
        at, out, made = None, None, []
        for b in batches:
            for file_id, name, line in zip(b.column("file_id").to_pylist(), b.column("name").to_pylist(), b.column("raw_line").to_pylist(), strict=True):
                if file_id != at:
                    if out:
                        out.close()
                    at, out = file_id, system.open_output_stream(f"{inner}/{name}.csv")
                    made.append(f"{inner}/{name}.csv")
                out.write(line.encode() + b"\n")
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"path": made}, schema=pa.schema([("path", pa.string())]))

    return run


def export(rows: DataFrame, folder: str) -> list[str]:
    """Write records (file_id, name, line_no, raw_line) as one CSV file per file_id; a task that runs again writes the same."""
    system, inner = _system(folder)
    system.create_dir(inner, recursive=True)
    placed = rows.select("file_id", "name", "line_no", "raw_line").repartition("file_id").sortWithinPartitions("file_id", "line_no")
    map_arrow(placed, _writer(folder), "path string").count()
    return discover(folder)


def unknown(headers: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """(name): headers, of an array ``names`` in the form in which they meet, that name no canonical column."""
    names = headers.select(F.explode("names").alias("name"))
    return names.where(~F.col("name").isin(*HEADERS, *[" ".join(h.split()).lower() for h in override or {}]) & X.has(F.col("name"))).distinct()


class Ingest:
    """Files of one import: typed rows merged by page, faulty records, warnings, counters and status."""

    def __init__(self, spark: SparkSession, paths: list[str], header_within: int | None = 5, override: dict[str, str] | None = None):
        lines = written(records(spark, paths))
        self.raw = lines.where("warning is null").withColumn("loaded_at", F.lit(None).cast("timestamp"))
        self.warnings = lines.where("warning is not null").select("file_name", "warning")
        self.header_within = header_within
        self.override = override or {}

    def rows(self) -> DataFrame:
        """Typed rows; ``ord`` is their place by file and line. The header of a file is looked for in its first
        ``header_within`` records."""
        return B.typed(self.raw, self.override, self.header_within).withColumn("ord", F.struct("file_id", "line_no"))

    def pages(self) -> DataFrame:
        """One row per page: the first value of each column that isn't blank."""
        return merge.first_wins(self.rows().drop("file_id", "line_no"), keys=("url",))

    def faulty(self) -> DataFrame:
        return B.faulty(self.raw, self.header_within)

    def unknown_columns(self) -> DataFrame:
        """(name): headers that name no canonical column."""
        return unknown(B.headers(self.raw, self.header_within), self.override)

    def summary(self) -> DataFrame:
        return merge.import_status(merge.counters(self.rows()), self.warnings.count())
