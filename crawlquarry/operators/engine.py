"""Rules over any number of audits at once: matches, issues, links and scores.

Issues are counted in one scan and two shuffles: each page becomes one entry with a bit per row rule and an entry per text
that group rules compare and per redirect; entries are combined by (audit, rule, text) before they move, then by audit.
Matches need the pages themselves: row rules are one scan and one explode without a shuffle, the entries of group and
redirect rules are written once and joined to their counts, and adaptive execution splits a text that a third of all
pages share. Every frame carries ``audit_id``: one audit and a million are one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.operators.rules import CATALOGUE, RECORD, Rule, flagged, metadata, usable
from crawlquarry.plans.sized import written

LINKS_PER_ISSUE = 2000
#: Weights of severities, and the formula's constants.
WEIGHTS = {"CRITICAL": 30.0, "HIGH": 18.0, "MEDIUM": 9.0, "LOW": 3.0, "INFO": 0.5}
PENALTY_CAP = 25


def records(urls: DataFrame) -> DataFrame:
    """Pages in the columns that rules read: missing columns are null, text in a number's place is coerced, null
    indexability is UNKNOWN."""
    have = dict(urls.dtypes)
    out = []
    for field in RECORD.split(", "):
        name, kind = field.split(" ", 1)
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kind == "int" and have[name] == "string":
            out.append(X.to_int(F.col(name)).alias(name))
        elif name == "ord" and have[name].startswith("struct"):
            out.append(F.col(name))  # any order will do
        elif name == "indexability":
            out.append(F.coalesce(name, F.lit("UNKNOWN")).alias(name))
        else:
            out.append(F.col(name).cast(kind).alias(name))
    return urls.select(*out)


def last_wins(urls: DataFrame, order: str = "ord") -> DataFrame:
    """One record per (audit, url): the last one whole, at the place of the first. Blank urls are dropped."""
    rest = [c for c in urls.columns if c not in ("audit_id", "url")]
    kept = urls.where(F.col("url").isNotNull() & (F.col("url") != "")).groupBy("audit_id", "url").agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("_first"))
    return kept.select("audit_id", "url", *[F.col("_first").alias(c) if c == order else F.col(f"r.{c}").alias(c) for c in rest])


def _hit(rule: Rule) -> Column:
    return F.when(rule.when(), F.struct(F.lit(rule.key).alias("rule_key"), rule.evidence().alias("evidence")))


def _keyed(rules: list[Rule], struct) -> Column:
    """An array of what group and redirect rules look up: ``struct(rule, key, member)`` of the texts of a group, of the
    target of a redirect, and (no member) of pages that redirect themselves."""
    out = []
    for n, r in enumerate(rules):
        if r.kind == "group":
            out.append(F.when(r.when(), struct(n, F.lower(X.trimmed(F.col(r.group))), True)))
        elif r.kind == "redirect":
            out += [F.when(r.when(), struct(n, F.col("redirect_url"), True)), F.when(F.col("status_code").between(300, 399), struct(n, F.col("url"), False))]
    return F.array_compact(F.array(*out))


def matches(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(audit_id, rule_key, url, evidence, group_ord, ord): every hit. ``(group_ord, ord)`` is the order of hits of a
    rule: that of the pages, for groups by their first member."""
    rules = usable(pages.sparkSession, rules or CATALOGUE)
    pages = flagged(pages)
    parts = []
    if rows := [r for r in rules if r.kind == "row"]:
        # the array in a projection of its own, which compiles; only hits are exploded
        hit = pages.select("audit_id", "url", "ord", F.array(*map(_hit, rows)).alias("hits")).select("audit_id", "url", "ord", F.inline(F.array_compact("hits")))
        parts.append(hit.select("audit_id", "rule_key", "url", "evidence", F.col("ord").alias("group_ord"), "ord"))
    if looked := [r for r in rules if r.kind != "row"]:
        struct = lambda n, key, member: F.struct(F.lit(n).alias("rule"), key.alias("key"), F.lit(member).alias("member"))
        entry = written(pages.select("audit_id", "url", "ord", F.inline(_keyed(looked, struct))))
        count = entry.groupBy("audit_id", "rule", "key").agg(F.count_if("member").alias("n"), F.min(F.when(F.col("member"), F.col("ord"))).alias("first"), F.max(~F.col("member")).alias("again"))
        both = entry.where("member").join(count, ["audit_id", "rule", "key"]).withColumn("redirect_url", F.col("key"))
        pick = lambda of: F.coalesce(*[F.when(F.col("rule") == n, of(r)) for n, r in enumerate(looked)])
        hit = both.where(pick(lambda r: F.col("n") > 1 if r.kind == "group" else F.col("again") | (F.col("key") == F.col("url"))))
        parts.append(hit.select("audit_id", pick(lambda r: F.lit(r.key)).alias("rule_key"), "url", pick(Rule.evidence).alias("evidence"), pick(lambda r: F.col("first" if r.kind == "group" else "ord")).alias("group_ord"), "ord"))
    return reduce(DataFrame.unionByName, parts)


def _described(counted: DataFrame, rules: list[Rule] | None) -> DataFrame:
    pct = F.when(F.col("total") > 0, X.rounded(F.col("affected") / F.col("total") * 100, tenths=True)).otherwise(0.0)
    return counted.join(F.broadcast(metadata(counted.sparkSession, rules)), "rule_key").withColumn("pct", pct)  # 25 rows


def issues(hits: DataFrame, pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per audit and rule with hits: metadata, affected, total, pct (of the audit's pages)."""
    counted = hits.groupBy("audit_id", "rule_key").agg(F.count("*").alias("affected"))
    return _described(counted.join(pages.groupBy("audit_id").agg(F.count("*").alias("total")), "audit_id"), rules)


def summarized(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The issues of pages as :func:`issues` has them, counted in one scan without listing the hits."""
    rules = usable(pages.sparkSession, rules or CATALOGUE)
    rows, looked = [r for r in rules if r.kind == "row"], [r for r in rules if r.kind != "row"]
    struct = lambda n, key, member: F.struct(F.lit(n).alias("rule"), key.alias("key"), F.lit(0).cast("long").alias("bits"), F.lit(member).alias("member"), (F.lit(member) & (key == F.col("url"))).alias("own"))
    bits = reduce(Column.bitwiseOR, [F.when(r.when(), F.lit(1 << n)).otherwise(F.lit(0)).cast("long") for n, r in enumerate(rows)], F.lit(0).cast("long"))
    page = F.array(F.struct(F.lit(-1).alias("rule"), F.lit(None).cast("string").alias("key"), F.col("_bits").alias("bits"), F.lit(True).alias("member"), F.lit(False).alias("own")))
    entry = flagged(pages).withColumn("_bits", bits).select("audit_id", F.inline(F.concat(page, _keyed(looked, struct))))
    hits = [F.count_if(F.col("bits").bitwiseAND(F.lit(1 << n)) != 0).alias(f"h{n}") for n in range(len(rows))]
    group = entry.groupBy("audit_id", "rule", "key").agg(F.count_if("member").alias("n"), F.count_if("own").alias("own"), F.max(~F.col("member")).alias("again"), *hits)
    found = [F.sum(f"h{n}").alias(f"h{n}") for n in range(len(rows))]
    for n, r in enumerate(looked):
        of_key = F.when(F.col("n") > 1, F.col("n")) if r.kind == "group" else F.when(F.col("again"), F.col("n")).otherwise(F.col("own"))
        found.append(F.sum(F.when(F.col("rule") == n, of_key)).alias(f"k{n}"))
    audit = group.groupBy("audit_id").agg(F.sum(F.when(F.col("rule") == -1, F.col("n"))).alias("total"), *found)
    each = [F.struct(F.lit(r.key).alias("rule_key"), F.col(c).alias("affected")) for c, r in [*((f"h{n}", r) for n, r in enumerate(rows)), *((f"k{n}", r) for n, r in enumerate(looked))]]
    return _described(audit.select("audit_id", "total", F.inline(F.filter(F.array(*each), lambda x: x["affected"] > 0))), rules)


def ordered(found: DataFrame) -> DataFrame:
    """Issues of each audit by severity, then hits, then catalogue; ``place`` counts from 1."""
    w = Window.partitionBy("audit_id").orderBy("sev_rank", F.desc("affected"), "rule_ord")
    return found.withColumn("place", F.row_number().over(w))


#: Spark limits groups before they move up to this many rows a group; beyond it the groups are cut first.
GROUP_LIMIT, CUTS = 1000, 128


def first_of(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their ``place`` from 1. Few are picked before rows move; for more, each
    group is cut into parts by a hash of its order and the first ``n`` of each part are picked, so that no task sorts a
    whole hot group: at most ``CUTS`` times ``n`` rows of a group meet."""
    if n > GROUP_LIMIT:
        part = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(CUTS)))
        rows = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_n") <= n).drop("_part", "_n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def links(hits: DataFrame, most: int = LINKS_PER_ISSUE) -> DataFrame:
    """The first ``most`` hits of each issue: the report's feature, counts stay those of all hits."""
    return first_of(hits, ["audit_id", "rule_key"], ["group_ord", "ord"], most)


def penalties(found: DataFrame) -> DataFrame:
    """Issues with ``tenths``: the penalty in whole tenths of a point, by which sums are exact in any order."""
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")]
    reach = F.least(F.lit(1.0), F.sqrt(F.col("affected") / F.greatest(F.col("total"), F.lit(1))) * 1.3)
    return found.withColumn("tenths", F.least(F.lit(PENALTY_CAP * 10), F.floor(weight * (0.35 + 0.65 * reach) * 10 + 0.5)).cast("long"))


def scores(found: DataFrame, audits: DataFrame) -> DataFrame:
    """(audit_id, score, total_penalty): 100 for an audit without issues."""
    lost = penalties(found).groupBy("audit_id").agg(F.sum("tenths").alias("tenths"))
    tenths = F.coalesce("tenths", F.lit(0))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(100 - tenths / 10 + 0.5))).cast("int")
    return audits.select("audit_id").distinct().join(lost, "audit_id", "left").select("audit_id", score.alias("score"), (tenths / 10).alias("total_penalty"))


def breakdown(found: DataFrame) -> DataFrame:
    """Penalties of each audit, the greatest first; ties in the order of issues."""
    w = Window.partitionBy("audit_id").orderBy(F.desc("tenths"), "sev_rank", F.desc("affected"), "rule_ord")
    return penalties(found).select("audit_id", "rule_key", "severity", "affected", "pct", (F.col("tenths") / 10).alias("penalty"), F.row_number().over(w).alias("place"))
