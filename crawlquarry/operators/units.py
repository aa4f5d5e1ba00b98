"""Quantities recorded in different units, brought to common units.

Cells say their unit or they don't. Numbers without a unit share one unit per source (an audit and a measure), and that
unit is found by linking sources: the same page in two sources, the same row in a source that is known (the length of
its own title text), and, where pages aren't shared, the deciles of one site's values. Each link gives a robust scale
(median of logarithmic ratios) and offset (what remains between the medians after scaling), the scale is snapped to a
known conversion, and known units are propagated through the graph of sources, strongest links first, until nothing
changes. Links are a star and a chain per page, never all pairs; shortcuts along the chains, composed by doubling, keep
the number of rounds logarithmic in their length. Cells are parsed once.

Defined results
    A cell is a measurement if it is a number, a number with a known unit, several of these in a row, an ISO-8601
    duration or h:m:s; all else (null, blank, placeholders, unknown units, negative numbers) has no common value and is
    null. Numbers follow the audit's locale (German and Italian: comma for decimals; null and other: point); a number
    whose grouping doesn't hold is read with that mark as decimal point. An audit that isn't in the table of audits has
    no locale. Values are rounded half up to whole common units. A source without any usable link has the common unit.
    Rows are independent: repeated ones come out repeatedly. Extra columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.plans.sized import released, small, written

#: Spellings of units (lower case, without a final point), by measure.
SPELLINGS: dict[str, dict[str, list[str]]] = {
    "response_time_ms": {
        "ms": ["ms", "msec", "msecs", "millisecond", "milliseconds", "millisecondo", "millisecondi", "millisekunde", "millisekunden", "milliseconde", "millisecondes", "milisegundo", "milisegundos"],
        "s": ["s", "sec", "secs", "second", "seconds", "secondo", "secondi", "sekunde", "sekunden", "seconde", "secondes", "segundo", "segundos"],
        "us": ["us", "usec", "usecs", "µs", "μs", "microsecond", "microseconds", "microsecondo", "microsecondi", "mikrosekunde", "mikrosekunden", "microseconde", "microsecondes", "microsegundo", "microsegundos"],
        "min": ["m", "min", "mins", "minute", "minutes", "minuto", "minuti", "minuten", "minutos"],
    },
    "title_length": {
        "char": ["c", "ch", "char", "chars", "character", "characters", "zeichen", "carattere", "caratteri", "caractère", "caractères", "carácter", "caracteres"],
        "px": ["px", "pixel", "pixels", "pixeles", "píxeles"],
    },
}
COMMA_DECIMALS = ["de", "it", "fr", "es"]
NUMBER = r"[0-9][0-9.,]*"
PIECE = rf"({NUMBER})\s*([^0-9.,\s]+)\.?"
#: Links of fewer shared pages than this only decide where no stronger link does.
STRONG = 3
#: Rounds of propagation from link to link, after which shortcuts along chains are built.
PLAIN_ROUNDS = 4


def _units(scale: DataFrame) -> dict[str, dict[str, tuple[int, int, str]]]:
    """measure -> unit -> (numerator, denominator, common unit). The table of conversions is fixed and small; a table
    that isn't is refused rather than collected."""
    rows = scale.select("measure", "unit_name", "numerator", "denominator", "common_unit").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("unit_scale holds more than 1000 conversions")
    out: dict[str, dict[str, tuple[int, int, str]]] = {}
    for r in rows:
        out.setdefault(r["measure"], {})[r["unit_name"]] = (r["numerator"], r["denominator"], r["common_unit"])
    return out


def number(text: Column, comma: Column) -> Column:
    """A number by its notation; ``comma``: whether the comma marks decimals."""

    def read(mark: str, group: str) -> Column:
        g = "\\." if group == "." else ","
        grouped = text.rlike(rf"^[1-9][0-9]{{0,2}}({g}[0-9]{{3}})+(\{mark}[0-9]+)?$")
        plain = F.when(grouped, F.regexp_replace(text, g, "")).otherwise(F.regexp_replace(text, g, mark) if group == "." else text)
        return F.regexp_replace(plain, ",", ".").try_cast("decimal(28,9)")

    return F.when(comma, read(",", ".")).otherwise(read(".", ","))


def _factor(measure: str, unit: Column, units: dict, unit_names: bool = False) -> Column:
    """Common units per unit as decimal, or the name of the unit, by its spelling."""
    lower = F.lower(F.regexp_replace(unit, r"\.$", ""))
    out = F.lit(None)
    for name, (num, den, _) in units.items():
        value = F.lit(name) if unit_names else F.lit(f"{num / den:.12f}").cast("decimal(24,12)")
        names = SPELLINGS.get(measure, {}).get(name, [name])
        out = F.when(lower.isin(*names), value).otherwise(out)
    return out.cast("string" if unit_names else "decimal(24,12)")


def observations(urls: DataFrame, audits: DataFrame, scale: DataFrame) -> DataFrame:
    """(ord, audit_id, field_name, plain, value, written_in): one row per cell. ``plain`` is the number of a cell without
    unit; ``value`` the common value of a cell with one, ``written_in`` its unit (``mixed`` for several or for clock
    notation)."""
    units = _units(scale)
    info = audits.select(F.col("audit_id").alias("a_id"), "project_id", F.lower(F.substring("locale", 1, 2)).isin(*COMMA_DECIMALS).alias("comma")).groupBy("a_id").agg(F.min("project_id").alias("project_id"), F.first("comma", True).alias("comma"))
    page = F.lower(F.regexp_replace(X.trimmed(F.col("url")), r"(?i)^https?://(www\.)?|/+$", ""))
    title = F.length(X.trimmed(F.col("title"))).cast("double")
    # pages are only compared for equality, and no url is no page; all cells are trimmed once
    rows = urls.select("ord", "audit_id", F.when(page != "", F.xxhash64(page)).alias("page"), F.when(title > 0, title).alias("title_length_own"), *[X.trimmed(F.col(m)).alias(m) for m in units])
    rows = rows.join(small(written(info)), F.col("audit_id") == F.col("a_id"), "left").withColumn("comma", F.coalesce("comma", F.lit(False)))
    parts = []
    for measure, us in units.items():
        t = F.col(measure)
        plain = F.when(t.rlike(f"^{NUMBER}$"), number(t, F.col("comma")))
        pieces = t.rlike(rf"^(?:{PIECE}\s*)+$")
        nums, names = F.regexp_extract_all(t, F.lit(PIECE), 1), F.regexp_extract_all(t, F.lit(PIECE), 2)
        values = F.zip_with(nums, names, lambda n, u: (number(n, F.col("comma")).cast("decimal(24,9)") * _factor(measure, u, us)).cast("decimal(30,9)"))
        total = F.aggregate(values, F.lit(0).cast("decimal(38,9)"), lambda a, v: (a + v).cast("decimal(38,9)"))
        value, unit = F.when(pieces, total), F.when(pieces & (F.size(nums) == 1), _factor(measure, F.get(names, F.lit(0)), us, True)).when(pieces, "mixed")
        if "s" in us:
            sec = F.lit(f"{us['s'][0] / us['s'][1]:.12f}").cast("decimal(24,12)")
            part = lambda pattern, k: F.coalesce(F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)"))
            iso, clock = r"(?i)^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?$", r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]+)?)$"
            for p, at_least in ((iso, r"(?i)^PT.+"), (clock, ".")):
                hit = (F.lower(F.left(t, F.lit(2))) == "pt" if p == iso else t.contains(":")) & t.rlike(p) & t.rlike(at_least)
                seconds = (part(p, 1) * 3600 + part(p, 2) * 60 + part(p, 3)).cast("decimal(24,9)")
                value, unit = F.when(hit, (seconds * sec).cast("decimal(38,9)")).otherwise(value), F.when(hit, "mixed").otherwise(unit)
        # plain numbers, nearly all cells, aren't tried for anything else
        value, unit = F.when(plain.isNull() & (t != ""), value), F.when(plain.isNull() & (t != ""), unit)
        # the measure of the row's own text, a source in the common unit
        own = F.col("title_length_own") if measure == "title_length" else F.lit(None).cast("double")
        parts.append(
            F.struct(F.lit(measure).alias("field_name"), plain.cast("decimal(28,9)").alias("plain"), value.cast("decimal(38,9)").alias("value"), F.when(value.isNotNull(), unit).alias("written_in"), own.alias("own"))
        )
    return rows.select("ord", "audit_id", "project_id", "page", F.inline(F.array(*parts)))


class Units:
    """The unit of the plain numbers of each source (audit and measure), and the values in common units."""

    def __init__(self, urls: DataFrame, audits: DataFrame, scale: DataFrame):
        self.conversions = _units(scale)
        self.seen = written(observations(urls, audits, scale))
        self.links = written(self._links())
        self.sources = written(self._sources())

    def _links(self) -> DataFrame:
        """(field_name, a, b, kind, n, scale, offset): links of source ``a`` to source ``b``; b null is the common unit.
        ``scale`` is log10 of b's values over a's; ``offset`` what remains, relative to b's median."""
        some = self.seen.where("(plain > 0 or value > 0) and audit_id is not null").select("audit_id", "project_id", "page", "field_name", F.log10(F.col("plain").cast("double")).alias("p"), F.log10(F.col("value").cast("double")).alias("v"), F.log10("own").alias("o"))
        med = lambda c: F.percentile_approx(c, 0.5, 200)
        tenths = [k / 10 for k in range(1, 10)]
        # one row per page and source: a page that is repeated a million times is one observation of its source, and all
        # that follows reads this table instead of the cells
        page = some.groupBy("project_id", "page", "field_name", "audit_id").agg(F.avg("p").alias("p"), F.avg("v").alias("v"), F.avg(F.col("o") - F.col("p")).alias("o"))
        page = written(page)
        def link(pairs: DataFrame, keys: list[str], kind: str, x: Column, y: Column) -> DataFrame:
            """The robust scale of log values y over x, and what then remains between the medians, relative to y's."""
            got = pairs.groupBy(*keys).agg(F.count("*").alias("n"), med(y - x).alias("scale"), med(x).alias("_x"), med(y).alias("_y"))
            b = F.col("b") if "b" in keys else F.lit(None).cast("string").alias("b")
            return got.select("field_name", "a", b, F.lit(kind).alias("kind"), "n", "scale", (1 - F.pow(F.lit(10.0), F.col("scale") + F.col("_x") - F.col("_y"))).alias("offset"))

        source = F.col("audit_id").alias("a")
        own = link(page.where("o is not null").select("field_name", source, "p", "o"), ["field_name", "a"], "row", F.col("p"), F.col("o") + F.col("p"))
        star = page.groupBy("project_id", "page", "field_name").agg(F.avg("v").alias("anchor")).where("anchor is not null and page is not null").join(page.where("p is not null"), ["project_id", "page", "field_name"])
        star = link(star.select("field_name", source, "p", "anchor"), ["field_name", "a"], "page", F.col("p"), F.col("anchor"))
        w = Window.partitionBy("project_id", "page", "field_name").orderBy("audit_id")
        chain = page.where("p is not null and page is not null").select("field_name", source, F.col("p").alias("x"), F.lead("audit_id").over(w).alias("b"), F.lead("p").over(w).alias("y")).where("b is not null")
        chain = written(link(chain, ["field_name", "a", "b"], "page", F.col("x"), F.col("y")))
        back = chain.select("field_name", F.col("b").alias("a"), F.col("a").alias("b"), "kind", "n", (-F.col("scale")).alias("scale"), (1 - 1 / (1 - F.col("offset"))).alias("offset"))
        exact = own.unionByName(star).unionByName(chain).unionByName(back)
        # deciles of plain against known values: of the audit itself, of its project, of everything
        deciles = lambda df, keys: df.groupBy(*keys).agg(F.percentile_approx("p", tenths, 200).alias("px"), F.count("p").alias("np"), F.percentile_approx("v", tenths, 200).alias("vx"), F.count("v").alias("nv"))
        by_audit = written(deciles(page, ["field_name", "project_id", "audit_id"]))
        by_project, by_all = deciles(page, ["field_name", "project_id"]), deciles(page, ["field_name"])
        cohorts = []
        for kind, ref in (("site", by_audit), ("project", by_project), ("all", by_all)):
            keys = [c for c in ("field_name", "project_id", "audit_id") if c in ref.columns]
            ref = ref.where("nv > 0").select(*keys, "vx", F.col("nv").alias("n_ref"))
            cohorts.append(by_audit.where("np > 0").select("field_name", "project_id", "audit_id", "px", "np").join(ref, keys).select("field_name", F.col("audit_id").alias("a"), F.lit(kind).alias("kind"), F.least("np", "n_ref").alias("n"), "px", "vx"))
        cohort = cohorts[0].unionByName(cohorts[1]).unionByName(cohorts[2])
        gaps = F.array_sort(F.zip_with("vx", "px", lambda v, p: v - p))
        cohort = cohort.withColumn("scale", F.get(gaps, F.lit(4)))
        left = F.array_sort(F.zip_with("vx", "px", lambda v, p: F.pow(F.lit(10.0), v) - F.pow(F.lit(10.0), p + F.col("scale"))))
        cohort = cohort.select("field_name", "a", F.lit(None).cast("string").alias("b"), "kind", "n", "scale", (F.get(left, F.lit(4)) / F.pow(F.lit(10.0), F.get("vx", F.lit(4)))).alias("offset"))
        return exact.unionByName(cohort)

    def _snapped(self, measure: Column, log_factor: Column) -> Column:
        """Name of the known unit of which log10(common units per unit) is nearest."""
        best = F.lit(None).cast("string")
        for m, us in self.conversions.items():
            options = F.array(*[F.struct(F.abs(log_factor - math.log10(num / den)).alias("d"), F.lit(u).alias("u")) for u, (num, den, _) in us.items()])
            best = F.when(measure == m, F.array_min(options)["u"]).otherwise(best)
        return F.when(log_factor.isNotNull(), best)

    def _logs(self, measure: Column, unit: Column) -> Column:
        out = F.lit(None).cast("double")
        for m, us in self.conversions.items():
            for u, (num, den, _) in us.items():
                out = F.when((measure == m) & (unit == u), math.log10(num / den)).otherwise(out)
        return out

    def _sources(self) -> DataFrame:
        """(field_name, audit_id, unit, kind, n): the unit of each source's plain numbers and the link that gave it."""
        rank = F.when(F.col("n") < STRONG, 5).otherwise(0) + F.when(F.col("kind") == "row", 0).when(F.col("kind") == "page", 1).when(F.col("kind") == "site", 2).when(F.col("kind") == "project", 3).otherwise(4)
        links = self.links.withColumn("rank", rank)
        nodes = links.select("field_name", F.col("a").alias("audit_id")).distinct()
        # what a source is by its links to the common unit, best link first, the most shared pages among equals
        direct = links.where("b is null").withColumn("unit", self._snapped(F.col("field_name"), F.col("scale")))
        vote = direct.groupBy("field_name", "a", "rank", "kind", "unit").agg(F.sum("n").alias("n"))
        fixed = vote.groupBy("field_name", "a").agg(F.min(F.struct("rank", (-F.col("n")).alias("m"), "unit", "kind")).alias("best")).select("field_name", F.col("a").alias("audit_id"), "best.unit", "best.kind", (-F.col("best.m")).alias("n"), "best.rank")
        known = written(fixed)
        between = links.where("b is not null").select("field_name", "a", "b", self._ratio(F.col("field_name"), F.col("scale")).alias("scale"), "n", "rank")
        between, rounds = written(between), 0
        while True:
            rounds += 1
            if rounds == PLAIN_ROUNDS:  # long chains: cut them short
                between = self._shortened(between)
            # a neighbour's unit times the scale between the two; it replaces only weaker evidence: ranks fall, so this ends
            near = between.join(known.select("field_name", F.col("audit_id").alias("b"), F.col("unit").alias("b_unit"), F.col("rank").alias("b_rank")), ["field_name", "b"])
            near = near.withColumn("unit", self._snapped(F.col("field_name"), F.col("scale") + self._logs(F.col("field_name"), F.col("b_unit")))).withColumn("rank", F.greatest(F.col("rank"), F.col("b_rank")))
            votes = near.where("unit is not null").groupBy("field_name", "a", "rank", "unit").agg(F.sum("n").alias("n"))
            told = votes.groupBy("field_name", "a").agg(F.min(F.struct("rank", (-F.col("n")).alias("m"), "unit")).alias("t"))
            merged = nodes.join(known, ["field_name", "audit_id"], "left").join(told.withColumnRenamed("a", "audit_id"), ["field_name", "audit_id"], "left")
            take = F.col("t").isNotNull() & (F.col("unit").isNull() | (F.col("t.rank") < F.col("rank")))
            after = written(merged.select("field_name", "audit_id", F.when(take, F.col("t.unit")).otherwise(F.col("unit")).alias("unit"), F.when(take, "link").otherwise(F.col("kind")).alias("kind"), F.when(take, -F.col("t.m")).otherwise(F.col("n")).alias("n"), F.when(take, F.col("t.rank")).otherwise(F.col("rank")).alias("rank"), take.alias("changed")))
            released(known)
            known = after.drop("changed")
            if after.where("changed").isEmpty():
                return known.where("unit is not null").select("field_name", "audit_id", "unit", "kind", "n")

    def _ratio(self, measure: Column, log_scale: Column) -> Column:
        """The known ratio of two units nearest to a scale between sources, as a logarithm: such scales compose exactly."""
        best = F.lit(None).cast("double")
        for m, us in self.conversions.items():
            logs = [math.log10(num / den) for num, den, _ in us.values()]
            options = F.array(*[F.struct(F.abs(log_scale - r).alias("d"), F.lit(r).alias("r")) for r in sorted({x - y for x in logs for y in logs})])
            best = F.when(measure == m, F.array_min(options)["r"]).otherwise(best)
        return best

    def _shortened(self, between: DataFrame) -> DataFrame:
        """The links, and shortcuts: from each source the best link to a source before it and the best to one behind it, by
        id, are followed 2, 4, 8 ... steps. Both point one way, so they end after as many doublings as the longest has
        bits."""
        out = between
        if between.isEmpty():
            return out
        for ahead in (False, True):
            best = between.where(F.col("b") > F.col("a") if ahead else F.col("b") < F.col("a")).groupBy("field_name", "a").agg(F.min(F.struct("rank", (-F.col("n")).alias("m"), "b", "scale")).alias("l"))
            hop = best.select("field_name", "a", "l.b", "l.scale", (-F.col("l.m")).alias("n"), "l.rank")
            while True:
                onward = hop.select("field_name", F.col("a").alias("b"), F.col("b").alias("c"), F.col("scale").alias("s2"), F.col("n").alias("n2"), F.col("rank").alias("r2"))
                hop = written(hop.join(onward, ["field_name", "b"]).select("field_name", "a", F.col("c").alias("b"), (F.col("scale") + F.col("s2")).alias("scale"), F.least("n", "n2").alias("n"), F.greatest("rank", "r2").alias("rank")))
                if hop.isEmpty():
                    break
                out = out.unionByName(hop)
        return out

    def values(self) -> DataFrame:
        """(ord, audit_id, field_name, unit, common_value): every cell in common units; ``unit`` is the one it was
        recorded in, null (with a null value) where nothing was measured."""
        src = small(self.sources.select(F.col("field_name").alias("s_field"), F.col("audit_id").alias("s_audit"), F.col("unit").alias("s_unit")))
        rows = self.seen.select("ord", "audit_id", "field_name", "plain", "value", "written_in").join(src, (F.col("field_name") == F.col("s_field")) & (F.col("audit_id") == F.col("s_audit")), "left")
        common = F.lit(None).cast("string")
        factor = F.lit(None).cast("decimal(24,12)")
        for m, us in self.conversions.items():
            common = F.when(F.col("field_name") == m, F.lit(next(iter(us.values()))[2])).otherwise(common)
            for u, (num, den, _) in us.items():
                factor = F.when((F.col("field_name") == m) & (F.coalesce("s_unit", common) == u), F.lit(f"{num / den:.12f}").cast("decimal(24,12)")).otherwise(factor)
        unit = F.when(F.col("plain").isNotNull(), F.coalesce("s_unit", common)).otherwise(F.col("written_in"))
        value = F.coalesce((F.col("plain") * factor).cast("decimal(38,9)"), F.col("value"))
        return rows.select("ord", "audit_id", "field_name", unit.alias("unit"), F.floor(value + F.lit("0.5").cast("decimal(2,1)")).cast("long").alias("common_value"), (unit == common).alias("is_common"))

    def converted(self) -> DataFrame:
        """(ord, field_name, common_value) of the measurements recorded in another unit than the common one."""
        return self.values().where("common_value is not null and not is_common").select("ord", "field_name", "common_value")
