"""Schemas that drift between the files of a series.

Every file gets a schema whose columns are tagged unions: per column the number of cells of each kind that occurs in it
(integer, decimal, text, blank). Such schemas are fused by adding counts, so they are built by partial aggregation over
all files in parallel. Consecutive schemas of a series are then compared: columns that appear or go, alternatives that
appear, and renames, which are found by the values that the gone and the new column hold for the same addresses. In the
common table a column whose cells conflict is split into typed branches beside its canonical value.

Defined results
    Headers meet without byte-order mark, trimmed, with single spaces and in lower case; of equal headers in a file the
    first counts. A null header is the header ''. Cells beyond the headers, and rows of unknown files, don't count;
    missing cells are blank. Repeated rows count once for renames. Files of the same time are in order of file_id.
    A column blank throughout has no kind. A file without rows can have no renames. Extra columns don't matter.
    A header that is gone and one that is new pair up if they hold equal values for more than half of the addresses of
    both files at which either isn't blank; each takes its best partner, ties in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.operators.components import components
from crawlquarry.plans.sized import small, written
from crawlquarry.schema import COLUMNS, SQL_TYPES

#: The columns of the common table.
CONSTANT = ("url", "status_code", "title", "inlinks", "outlinks", "word_count", "crawl_depth", "indexability", "in_sitemap", "meta_description", "h1")
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?[0-9]+\.[0-9]+$"
#: A number with at most a word before it (``HTTP/404``) or words or a mark behind it (``404 Not Found``, ``12+``).
DECORATED = r"^(?:[A-Za-z]+/)?([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)(?:[?+%]|\s+[A-Za-z][A-Za-z ]*)?$"


def canonical(cell: Column) -> Column:
    """The value of a cell however it is written: a plain number, or the text in one spelling; null where blank."""
    t = X.squeezed(cell)
    return F.when(t == "", F.lit(None).cast("string")).otherwise(canonical_of(t))


def canonical_of(t: Column) -> Column:
    """The same of a text that is squeezed already and isn't blank."""
    number = F.regexp_replace(F.regexp_extract(t, DECORATED, 1), ",", "").try_cast("decimal(38,9)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(plain, F.when(t.isin("yes", "si", "sì"), "true").when(t == "no", "false").otherwise(t))


def timeline(files: DataFrame) -> DataFrame:
    """(file_id, series_id, seq, names, prev_id, prev_names): files of each series in order of time."""
    w = Window.partitionBy("series_id").orderBy("exported_at", "file_id")
    names = F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.coalesce(X.squeezed(h), F.lit("")))
    rows = files.select("file_id", "series_id", "exported_at", names.alias("names")).dropDuplicates(["file_id"])
    return rows.select("file_id", "series_id", F.row_number().over(w).alias("seq"), "names", F.lag("file_id").over(w).alias("prev_id"), F.lag("names").over(w).alias("prev_names"))


def unions(rows: DataFrame) -> DataFrame:
    """(file_id, pos, n_integer, n_decimal, n_text, n_blank, n_address, kind): the tagged union of each column."""
    cell = F.coalesce(X.trimmed(F.col("cell")), F.lit(""))
    tagged = rows.select("file_id", F.posexplode("cells").alias("pos", "cell")).select("file_id", "pos", cell.alias("cell"))
    tagged = tagged.select("file_id", "pos", F.when(F.col("cell") == "", 0).when(F.col("cell").rlike(INTEGER), 1).when(F.col("cell").rlike(DECIMAL), 2).when(F.lower(F.left("cell", F.lit(8))).rlike("^https?://"), 4).otherwise(3).alias("tag"))
    n = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    counted = tagged.groupBy("file_id", "pos").agg(n(1).alias("n_integer"), n(2).alias("n_decimal"), n(3, 4).alias("n_text"), n(0).alias("n_blank"), n(4).alias("n_address"))
    return counted.withColumn("kind", F.when(F.col("n_text") > 0, "text").when(F.col("n_decimal") > 0, "decimal").when(F.col("n_integer") > 0, "integer"))


class Drift:
    """The schemas of all files, and what changed between consecutive files of a series."""

    def __init__(self, files: DataFrame, rows: DataFrame):
        self.rows = rows
        self.files = written(timeline(files))
        self.schemas = written(self._schemas())
        self.renames = written(self._renames())

    def _schemas(self) -> DataFrame:
        """(file_id, series_id, seq, prev_id, name, pos, is_address, n_..., kind): one row per column of a file."""
        cols = self.files.select("file_id", "series_id", "seq", "prev_id", F.posexplode("names").alias("pos", "name"))
        once = cols.groupBy("file_id", "series_id", "seq", "prev_id", "name").agg(F.min("pos").alias("pos"))
        all_ = once.join(unions(self.rows), ["file_id", "pos"], "left").na.fill(0, ["n_integer", "n_decimal", "n_text", "n_blank", "n_address"])
        named = F.col("name").isin(*COLUMNS["url"][1])
        # the address column: by its name, else the one with the most addresses in it
        w = Window.partitionBy("file_id").orderBy(F.desc(named), F.desc("n_address"), "pos")
        return all_.withColumn("is_address", (F.row_number().over(w) == 1) & (named | (F.col("n_address") > 0)))

    def _moved(self) -> DataFrame:
        """(file_id, gone, new): files with headers that are gone and headers that are new."""
        both = self.files.where("prev_id is not null").select("file_id", "prev_id", F.array_distinct(F.array_except("prev_names", "names")).alias("gone"), F.array_distinct(F.array_except("names", "prev_names")).alias("new"))
        return both.where((F.size("gone") > 0) & (F.size("new") > 0))

    def _renames(self) -> DataFrame:
        """(file_id, old_name, new_name, share): renamed headers of each file, file_id being the newer."""
        moved = self._moved()
        # the columns to look at, by the file that holds them: (file_id, pair, old, name, pos), and the address column
        wanted = moved.select(F.col("prev_id").alias("file_id"), F.col("file_id").alias("pair"), F.lit(True).alias("old"), F.explode("gone").alias("name")).unionByName(
            moved.select("file_id", F.col("file_id").alias("pair"), F.lit(False).alias("old"), F.explode("new").alias("name"))
        )
        at = self.schemas.select("file_id", "name", "pos", "is_address")
        key = at.where("is_address").select("file_id", F.col("pos").alias("key_pos"))
        named = written(wanted.join(at.drop("is_address"), ["file_id", "name"]).join(key, "file_id"))
        look = named.groupBy("file_id", "pair", "old", "key_pos").agg(F.collect_list("pos").alias("cols"))  # bounded by the headers of a file
        # only cells of moved columns leave the scan, and of them only hashes; place -1 says that the address is there at all
        cells = self.rows.join(small(look), "file_id").select("pair", "old", X.trimmed(F.get("cells", F.col("key_pos"))).alias("address"), "cells", "cols").where("address <> ''")
        raw = F.transform("cols", lambda c: F.struct(c.alias("pos"), F.get("cells", c).alias("cell")))
        cells = cells.select("pair", "old", F.xxhash64("address").alias("address"), F.inline(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit("x").alias("cell"))), raw)))
        # outside of the array function, where expressions compile; each step a column, so that it is worked out once
        cells = cells.where(X.has(F.col("cell"))).withColumn("t", X.squeezed(F.col("cell"))).withColumn("v", canonical_of(F.col("t")))
        long = cells.select("pair", "old", "address", "pos", F.xxhash64("v").alias("v")).repartition("pair", "address").distinct()
        # one shuffle by (pair, address) serves all that follows, down to the counts
        there = Window.partitionBy("pair", "address")
        common = long.select("*", F.max("old").over(there).alias("in_old"), F.min("old").over(there).alias("in_new")).where("in_old and not in_new and pos >= 0").drop("in_old", "in_new")
        filled = common.select("pair", "address", "old", "pos").distinct().groupBy("pair", "old", "pos").agg(F.count("*").alias("n"))
        sides = common.groupBy("pair", "address", "v").agg(F.collect_set(F.when(F.col("old"), F.col("pos"))).alias("o"), F.collect_set(F.when(~F.col("old"), F.col("pos"))).alias("n"))  # bounded by the headers of a file
        hits = sides.where((F.size("o") > 0) & (F.size("n") > 0)).select("pair", "address", F.explode("o").alias("o_pos"), "n").select("pair", "address", "o_pos", F.explode("n").alias("n_pos")).distinct()
        hits = hits.groupBy("pair", "o_pos", "n_pos").agg(F.count("*").alias("hits"))
        alone = filled.select("pair", F.when(F.col("old"), F.col("pos")).alias("o_pos"), F.when(~F.col("old"), F.col("pos")).alias("n_pos"), F.col("n").alias("hits"))
        both = written(hits.select("pair", "o_pos", "n_pos", "hits").unionByName(alone))
        name = lambda old, n: named.where("old" if old else "not old").select("pair", F.col("pos").alias(f"{n[0]}_pos"), F.col("name").alias(n))
        scored = (
            both.where("o_pos is not null and n_pos is not null")
            .join(both.where("n_pos is null").select("pair", "o_pos", F.col("hits").alias("n_old")), ["pair", "o_pos"])
            .join(both.where("o_pos is null").select("pair", "n_pos", F.col("hits").alias("n_new")), ["pair", "n_pos"])
            .withColumn("share", F.col("hits") / F.greatest("n_old", "n_new"))
            .where("share > 0.5")
            .join(name(True, "old_name"), ["pair", "o_pos"])
            .join(name(False, "new_name"), ["pair", "n_pos"])
        )
        by_old = Window.partitionBy("pair", "old_name").orderBy(F.desc("share"), "new_name")
        by_new = Window.partitionBy("pair", "new_name").orderBy(F.desc("share"), "old_name")
        best = scored.select("*", F.row_number().over(by_old).alias("a"), F.row_number().over(by_new).alias("b")).where("a = 1 and b = 1")
        return best.select(F.col("pair").alias("file_id"), "old_name", "new_name", "share")

    def changes(self) -> DataFrame:
        """(file_id, change_kind, column_name, old_name, old_kind, new_kind): one row per change. ``appeared`` lists the
        alternatives of a column's union that the older file didn't have."""
        s = self.schemas
        tags = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in ("integer", "decimal", "text")]))
        new = s.where("prev_id is not null").select("file_id", "prev_id", F.col("name").alias("column_name"), F.col("kind").alias("new_kind"), tags.alias("new_tags"))
        new = new.join(self.renames.select("file_id", F.col("new_name").alias("column_name"), F.col("old_name").alias("renamed_from")), ["file_id", "column_name"], "left").withColumn("match", F.coalesce("renamed_from", "column_name"))
        old = s.select(F.col("file_id").alias("prev_id"), F.col("name").alias("match"), F.col("kind").alias("old_kind"), tags.alias("old_tags"), F.lit(True).alias("was"))
        later = new.join(old, ["prev_id", "match"], "left")
        none = F.lit(None).cast("string")
        case = lambda kind, name, before, a, b, t: F.struct(F.lit(kind).alias("change_kind"), name.alias("column_name"), before.alias("old_name"), a.alias("old_kind"), b.alias("new_kind"), t.alias("appeared"))
        c, o, n, fresh = F.col("column_name"), F.col("old_kind"), F.col("new_kind"), F.array_except("new_tags", F.coalesce("old_tags", F.array().cast("array<string>")))
        found = F.array_compact(
            F.array(
                F.when(F.col("was").isNull(), case("added", c, none, o, n, fresh)),
                F.when(F.col("renamed_from").isNotNull(), case("renamed", c, F.col("match"), o, n, fresh)),
                F.when(F.col("was") & (o != n), case("type_changed", c, F.col("match"), o, n, fresh)),
            )
        )
        kept = later.select("file_id", F.inline(found))
        gone = self.files.where("prev_id is not null").select("file_id", "prev_id", F.explode(F.array_distinct(F.array_except("prev_names", "names"))).alias("column_name"))
        gone = gone.join(self.renames.select("file_id", F.col("old_name").alias("column_name")), ["file_id", "column_name"], "left_anti")
        gone = gone.join(s.select(F.col("file_id").alias("prev_id"), F.col("name").alias("column_name"), F.col("kind").alias("old_kind")), ["prev_id", "column_name"], "left")
        return kept.unionByName(gone.select("file_id", F.lit("removed").alias("change_kind"), "column_name", F.col("column_name").alias("old_name"), "old_kind", none.alias("new_kind"), F.array().cast("array<string>").alias("appeared")))

    def lineage(self) -> DataFrame:
        """(series_id, name, field): the constant column that a header of a series means. Headers that were renamed into
        each other are one column; it is the known column that any of them names, else it has its first header's name."""
        first = self.schemas.groupBy("series_id", "name").agg(F.min("seq").alias("since"))
        known = F.coalesce(*[F.when(F.col("name").isin(*names), F.lit(k)) for k, (_, names) in COLUMNS.items()])
        node = F.struct("series_id", known.isNull().alias("u"), F.col("since").alias("s"), F.coalesce(known, F.col("name")).alias("f"), "name")
        label = written(first.select("series_id", "name", node.alias("node")))
        link = self.renames.join(self.files.select("file_id", "series_id"), "file_id").select("series_id", "old_name", "new_name")
        for old in ("old_name", "new_name"):
            link = link.join(label.select("series_id", F.col("name").alias(old), F.col("node").alias("a" if old == "old_name" else "b")), ["series_id", old])
        least = components(link.select("a", "b"))
        return label.join(least, "node", "left").select("series_id", "name", F.coalesce("least.f", "node.f").alias("field"))

    def table(self, constant: tuple[str, ...] = CONSTANT) -> DataFrame:
        """All rows of all files in one table: file_id, series_id, row_no, the constant columns in constant types, for
        each of them the tag of the branch that the cell was read from (``<column>_as``), and ``extra`` for the rest.
        Columns of whole numbers have their branches beside them: ``<column>_integer``, ``_decimal`` and ``_text`` hold
        the cell as it was written, by its tag. A cell that has no exact canonical value of the column's type (12.7 isn't
        a whole number) is null there and has its text in ``unread``."""
        col = self.schemas.join(self.lineage(), ["series_id", "name"])
        w = Window.partitionBy("file_id", "field").orderBy("pos")
        col = col.withColumn("n", F.row_number().over(w))
        known = F.col("field").isin(*constant) & (F.col("n") == 1)
        plan = col.groupBy("file_id", "series_id").agg(
            *[F.min(F.when(known & (F.col("field") == k), F.col("pos"))).alias(f"at_{k}") for k in constant],
            F.collect_list(F.when(~known, F.struct("pos", F.when(F.col("n") > 1, F.concat_ws("#", "field", "n")).otherwise(F.col("field")).alias("name")))).alias("others"),
        )  # bounded by the headers of a file
        rows = self.rows.select("file_id", "row_no", "cells").join(small(written(plan)), "file_id")
        out: list[Column] = []
        unread: list[Column] = []
        for k in constant:
            raw = F.when(F.col(f"at_{k}").isNotNull(), X.blank_to_null(F.get("cells", F.col(f"at_{k}"))))
            tag = F.when(raw.rlike(INTEGER), "integer").when(raw.rlike(DECIMAL), "decimal").when(raw.isNotNull(), "text")
            kind = SQL_TYPES[COLUMNS[k][0]]
            value = raw if kind == "string" else canonical(raw).try_cast("bigint" if kind == "int" else kind)
            value = X.to_indexability(raw) if COLUMNS[k][0] == "indexability" else value
            out += [value.alias(k), tag.alias(f"{k}_as")]
            if kind == "int":
                out += [F.when(tag == "integer", raw.try_cast("bigint")).alias(f"{k}_integer"), F.when(tag == "decimal", raw.try_cast("double")).alias(f"{k}_decimal"), F.when(tag == "text", raw).alias(f"{k}_text")]
            unread.append(F.when(value.isNull() & raw.isNotNull(), F.struct(F.lit(k).alias("k"), raw.alias("v"))))
        rest = F.transform("others", lambda c: F.struct(c["name"].alias("k"), X.blank_to_null(F.get("cells", c["pos"])).alias("v")))
        return rows.select(
            "file_id", "series_id", "row_no", *out,
            F.map_from_entries(F.array_compact(F.array(*unread))).alias("unread"),
            F.map_from_entries(F.filter(rest, lambda e: e["v"].isNotNull())).alias("extra"),
        )


