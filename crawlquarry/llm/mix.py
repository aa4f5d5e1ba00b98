"""Mixing sources to target shares of tokens, by balanced sampling.

A document may be used up to its source's ``max_repeats`` times, so a source can give at most that many times its tokens.
The size of a mix is the largest at which no source is exhausted before it reaches its share (or a given one, then sources
that can't follow give all they have and the rest is shared among the others by their targets). Every document of a source
gets the same expected number of copies; its whole part is certain, and the fractions are rounded by the cube method: in
a stream through each task, three fractional documents of a source at a time move along the direction in which neither
the tokens nor the number of documents of the source change, until one of them is decided. Two of them, and a reserve of
a few documents, stay open per stream; those are streamed again, in fewer streams each time, until a source has a single
stream. What that leaves open is its landing problem, and each source lands by itself: of all ways to round the last
documents, the nearest in tokens is taken, then the nearest in number. Which stream a document is in, its place there and
every random choice hang on ids and numbers of documents, never on partitions or tasks: a selection is the same on any
cluster.

Defined results
    Sources meet in lower case without outer spaces. Documents of no tokens (null, empty), with a null doc_id or a null
    source are never used; repeated doc_ids count once. Sources without tokens have a share of 0 and their targets are
    shared among the others by proportion. A null or negative target or max_repeats counts as 0. Mixes without any usable
    source have no rows in the selection. Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.arrow import map_arrow
from crawlquarry.llm.encode import lengths
from crawlquarry.llm.tokenizers import DEFAULT_DIR
from crawlquarry.plans.sized import written

#: Targets are a configuration: more rows than this are refused.
MOST_TARGETS = 10_000
#: Documents of a stream. A source of more documents has several streams and goes through a further round.
LANDING = 50_000
#: Documents that each stream keeps for the landing, and of how many the landing tries all ways.
RESERVE, EXACT = 32, 12


def allocate(rows: list[dict], total: float | None) -> dict[str, float]:
    """Expected tokens by source; rows have source, share, cap (tokens times repeats) and largest (document)."""
    usable = [r for r in rows if r["cap"] > 0 and r["share"] > 0]
    if not usable:
        return {}
    mass = sum(r["share"] for r in usable)

    def filled(size: float) -> dict[str, float]:
        out: dict[str, float] = {}
        open_, left = list(usable), size
        while open_:
            m = sum(r["share"] for r in open_)
            full = [r for r in open_ if r["cap"] <= left * r["share"] / m]
            if not full:
                return out | {r["source"]: left * r["share"] / m for r in open_}
            for r in full:
                out[r["source"]] = r["cap"]
                left -= r["cap"]
            open_ = [r for r in open_ if r not in full]
        return out

    def error(size: float) -> float:
        """What the caps take from the shares, and what whole documents leave open."""
        got = filled(size)
        all_ = sum(got.values())
        return max(abs(got[r["source"]] / all_ - r["share"] / mass) + r["largest"] / 2 / all_ for r in usable)

    if total is not None:
        return filled(min(total, sum(r["cap"] for r in usable)))
    sizes = sorted({r["cap"] * mass / r["share"] for r in usable})
    return filled(min(sizes, key=lambda s: (error(s), -s)))


def _chance(doc: int, stratum: int, level: int) -> float:
    """Uniform in [0, 1) from the document, so that a task that runs again decides alike."""
    x = (doc * 0x9E3779B97F4A7C15 + stratum * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * k) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def step(units: list[list], chance: float) -> None:
    """Move the inclusion probabilities of three units [doc, tokens, p] (two, if of equal tokens) in the null space of
    (tokens, 1) until one of them is 0 or 1."""
    t = [u[1] for u in units]
    v = [1.0, -1.0] if len(units) == 2 else [t[1] - t[2], t[2] - t[0], t[0] - t[1]]
    if not any(v):
        v = [1.0, -1.0, 0.0]
    up = min((1 - u[2]) / d if d > 0 else u[2] / -d for u, d in zip(units, v, strict=True) if d)
    down = min(u[2] / d if d > 0 else (1 - u[2]) / -d for u, d in zip(units, v, strict=True) if d)
    move = up if chance * (up + down) < down else -down
    for u, d in zip(units, v, strict=True):
        u[2] += move * d
        if abs(u[2]) < 1e-9:
            u[2] = 0.0
        elif abs(1 - u[2]) < 1e-9:
            u[2] = 1.0


def landed(units: list[list]) -> None:
    """Round the last open units. From the largest down, each is rounded together with what the ones before it left over;
    of the smallest EXACT, all ways are tried for the nearest tokens, then the nearest number."""
    units = sorted(units, key=lambda u: (-u[1], u[0]))
    rest = 0.0
    for u in units[: max(0, len(units) - EXACT)]:
        want = rest + u[1] * u[2]
        u[2] = 1.0 if 2 * want >= u[1] else 0.0
        rest = want - u[1] * u[2]
    units = units[-EXACT:]
    ways = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    tokens, p = np.array([u[1] for u in units], float), np.array([u[2] for u in units])
    off = np.abs(ways @ tokens - tokens @ p - rest)
    best = np.lexsort((np.abs(ways.sum(1) - p.sum()), off.round(6)))[0]
    for u, x in zip(units, ways[best], strict=True):
        u[2] = float(x)


SCHEMA = "stratum int, doc_id long, tokens long, p double"


def _flight(level: int):
    """Rows (stratum, stream, streams, doc_id, tokens, p), those of a stream together and in order -> the same documents
    with p moved: all but a few of each stream to 0 or 1, and all of a stratum of one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("stratum", pa.int32()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("p", pa.float64())])
        at: tuple | None = None
        units: list[list] = []
        reserve: list[list] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def closed() -> list[tuple]:
            left = reserve + units
            if left and at[2] == 1:
                landed(left)
            return [(at[0], *u) for u in left]

        for b in batches:
            done: list[tuple] = []
            for s, stream, streams, doc, tokens, p in zip(*(b.column(c).to_pylist() for c in ("stratum", "stream", "streams", "doc_id", "tokens", "p")), strict=True):
                if (s, stream, streams) != at:
                    done += closed() if at else []
                    at, units, reserve = (s, stream, streams), [], []
                if len(reserve) < RESERVE:
                    reserve.append([doc, tokens, p])
                    continue
                units.append([doc, tokens, p])
                while len(units) == 3 or len(units) == 2 and units[0][1] == units[1][1]:
                    step(units, _chance(units[-1][0], s, level))
                    done += [(s, *u) for u in units if u[2] in (0.0, 1.0)]
                    units[:] = [u for u in units if u[2] not in (0.0, 1.0)]
            yield batch(done)
        yield batch(closed() if at else [])

    return run


def cube(units: DataFrame, sizes: dict[int, int] | None = None) -> DataFrame:
    """(stratum, doc_id, tokens, p) with fractions p -> the same with p 0 or 1, keeping tokens and number of each
    stratum up to its landing. ``sizes``: documents of each stratum. A stream of LANDING documents leaves RESERVE + 2, so
    every round leaves a stratum that part of its documents, and the number of rounds is known before the first."""
    if LANDING <= 2 * (RESERVE + 2):
        raise ValueError("LANDING must be more than twice what a stream leaves open")
    if sizes is None:
        sizes = {r["stratum"]: r["count"] for r in units.groupBy("stratum").count().limit(MOST_TARGETS + 1).collect()}
    spark = units.sparkSession
    out, level, todo = None, 0, units
    while True:
        streams = {s: max(1, -(-n // LANDING)) for s, n in sizes.items()}
        frame = spark.createDataFrame(list(streams.items()), "stratum int, streams int")  # as many rows as there are targets
        order = F.xxhash64("doc_id", F.lit(level))
        placed = todo.join(F.broadcast(frame), "stratum").withColumn("place", order).withColumn("stream", F.pmod("place", "streams").cast("int"))
        placed = placed.repartition("stratum", "stream").sortWithinPartitions("stratum", "stream", "place", "doc_id")
        flown = map_arrow(placed.select("stratum", "stream", "streams", "doc_id", "tokens", "p"), _flight(level), SCHEMA)
        if all(n == 1 for n in streams.values()):
            return flown if out is None else out.unionByName(flown)
        flown = written(flown)
        decided = flown.where("p in (0.0, 1.0)")
        out = decided if out is None else out.unionByName(decided)
        todo, level = flown.where("p not in (0.0, 1.0)"), level + 1
        sizes = {s: n * (RESERVE + 2) for s, n in streams.items() if n > 1}


class Mix:
    """Selections of documents for every mix of a table of targets."""

    def __init__(self, documents: DataFrame, targets: DataFrame, folder: str = DEFAULT_DIR, total_tokens: float | None = None):
        rows = targets.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats", "tokenizer").limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        self.spark = documents.sparkSession
        self.targets = [r.asDict() | {"share": max(0.0, r["target_share"] or 0.0), "repeats": max(0, r["max_repeats"] or 0)} for r in rows if r["mix_id"] is not None and r["source"] is not None]
        wanted = sorted({(t["source"], t["tokenizer"]) for t in self.targets})
        by_source = {s: [k for x, k in wanted if x == s] for s, _ in wanted}
        source = F.lower(F.trim("source"))
        names = F.create_map(*[x for s, ks in by_source.items() for x in (F.lit(s), F.array(*map(F.lit, ks)))]) if by_source else F.lit(None).cast("map<string,array<string>>")
        docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_id"), source.alias("source"), "text")
        if by_source:
            docs = docs.where(F.col("source").isin(*by_source))
        docs = docs.select("doc_id", "row_id", "source", F.explode(F.get(F.array(names), F.lit(0))[F.col("source")]).alias("tokenizer"), "text")
        counted = lengths(docs, sorted({k for _, k in wanted}), folder)
        # a document that is repeated, or named with several sources, counts once for each of them
        self.tokens = written(counted.where("tokens > 0").groupBy("doc_id", "source", "tokenizer").agg(F.max("tokens").alias("tokens")))
        sums = {(r["source"], r["tokenizer"]): r for r in self.tokens.groupBy("source", "tokenizer").agg(F.sum("tokens").alias("sum"), F.max("tokens").alias("largest"), F.count("*").alias("n")).collect()}
        self.strata: list[dict] = []
        for mix in sorted({t["mix_id"] for t in self.targets}):
            mine = [t for t in self.targets if t["mix_id"] == mix]
            for t in mine:
                s = sums.get((t["source"], t["tokenizer"]))
                t |= {"n": s["n"] if s else 0, "sum": s["sum"] if s else 0, "largest": s["largest"] if s else 0, "cap": (s["sum"] if s else 0) * t["repeats"]}
            given = allocate(mine, total_tokens)
            for t in mine:
                copies = given.get(t["source"], 0.0) / t["sum"] if t["sum"] else 0.0
                copies = round(copies) if abs(copies - round(copies)) < 1e-12 else copies
                self.strata.append(t | {"stratum": len(self.strata), "copies": min(copies, t["repeats"])})

    def selection(self) -> DataFrame:
        """(mix_id, source, doc_id, copies, tokens): documents in a mix, tokens being those of one copy."""
        plan = [(s["stratum"], s["mix_id"], s["source"], s["tokenizer"], math.floor(s["copies"]), float(s["copies"] - math.floor(s["copies"]))) for s in self.strata if s["copies"] > 0]
        frame = self.spark.createDataFrame(plan, "stratum int, mix_id string, source string, tokenizer string, whole int, fraction double")
        rows = self.tokens.join(F.broadcast(frame), ["source", "tokenizer"])  # as many rows as there are targets
        sure = rows.where("whole > 0").select("stratum", "doc_id", "tokens", F.col("whole").alias("copies"))
        sizes = {s["stratum"]: s["n"] for s in self.strata if s["copies"] > math.floor(s["copies"])}
        drawn = cube(rows.where("fraction > 0").select("stratum", "doc_id", "tokens", F.col("fraction").alias("p")), sizes).where("p = 1.0").select("stratum", "doc_id", "tokens", F.lit(1).alias("copies"))
        both = sure.unionByName(drawn).groupBy("stratum", "doc_id").agg(F.sum("copies").cast("int").alias("copies"), F.max("tokens").alias("tokens"))
        return both.join(F.broadcast(frame.select("stratum", "mix_id", "source")), "stratum").select("mix_id", "source", "doc_id", "copies", "tokens")

    def shares(self) -> DataFrame:
        """(mix_id, source, target_share, actual_share, tokens, documents, copies, available_tokens, max_repeats)."""
        got = self.selection().groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
        plan = [(s["mix_id"], s["source"], float(s["share"]), s["repeats"], s["sum"]) for s in self.strata]
        frame = self.spark.createDataFrame(plan, "mix_id string, source string, target_share double, max_repeats int, available_tokens long")
        joined = F.broadcast(frame).join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "documents", "copies"])
        total = joined.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
        actual = F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0)
        return joined.join(total, "mix_id").select("mix_id", "source", "target_share", actual.alias("actual_share"), "tokens", "documents", "copies", "available_tokens", "max_repeats")
