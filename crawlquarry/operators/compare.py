"""Two audits of a project side by side: pages, issues and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry.plans.sized import small


def latest_pairs(audits: DataFrame) -> DataFrame:
    """(project_id, current_id, base_id): the two latest audits of each project that has two."""
    w = Window.partitionBy("project_id").orderBy(F.desc("audit_date"), "audit_id")
    place = audits.select("project_id", "audit_id", F.row_number().over(w).alias("n")).where("n <= 2")
    both = place.groupBy("project_id").agg(F.max(F.when(F.col("n") == 1, F.col("audit_id"))).alias("current_id"), F.max(F.when(F.col("n") == 2, F.col("audit_id"))).alias("base_id"))
    return both.where("base_id is not null")


def sides(pairs: DataFrame) -> DataFrame:
    """(audit_id, project_id, current): one row per audit of a pair."""
    return pairs.select(F.explode(F.array(F.struct(F.col("current_id").alias("audit_id"), "project_id", F.lit(True).alias("current")), F.struct(F.col("base_id").alias("audit_id"), "project_id", F.lit(False).alias("current")))).alias("s")).select("s.*")


def _differs(c: str) -> Column:
    """Texts differ with null and '' alike; numbers with null as a value of its own."""
    return F.coalesce(f"b.{c}", F.lit("")) != F.coalesce(f"a.{c}", F.lit("")) if c != "status_code" else ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))


def page_diff(pages: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = ("status_code", "title", "canonical", "indexability")) -> DataFrame:
    """(project_id, url, kind, from_value, to_value): ``new``, ``removed`` and the changed column of each page. One full
    outer join serves all kinds; pages are unique per audit."""
    side = small(sides(pairs))
    mine = pages.select("audit_id", "url", *columns).join(side, "audit_id")
    a, b = mine.where("not current").alias("a"), mine.where("current").alias("b")
    both = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.url") == F.col("b.url")), "full_outer")
    none = F.lit(None).cast("string")
    case = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("from_value"), y.cast("string").alias("to_value"))
    here, there = F.col("b.url").isNotNull(), F.col("a.url").isNotNull()
    found = F.array(F.when(~there, case("new", none, none)), F.when(~here, case("removed", none, none)), *[F.when(here & there & _differs(c), case(c, F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in columns])
    return both.select(F.coalesce("a.project_id", "b.project_id").alias("project_id"), F.coalesce("a.url", "b.url").alias("url"), F.inline(F.filter(found, lambda x: x.isNotNull())))


def issue_diff(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """(project_id, rule_key, kind, from_count, to_count): issues ``new``, ``resolved`` or ``persistent``."""
    mine = issues.select("audit_id", "rule_key", "affected").join(small(sides(pairs)), "audit_id")
    both = mine.groupBy("project_id", "rule_key").agg(F.max(F.when(~F.col("current"), F.col("affected"))).alias("from_count"), F.max(F.when(F.col("current"), F.col("affected"))).alias("to_count"))
    return both.withColumn("kind", F.when(F.col("from_count").isNull(), "new").when(F.col("to_count").isNull(), "resolved").otherwise("persistent"))


def score_delta(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """(project_id, from_score, to_score, delta): null where either score is."""
    s = scores.select("audit_id", "score")
    out = pairs.join(s.select(F.col("audit_id").alias("base_id"), F.col("score").alias("from_score")), "base_id", "left").join(s.select(F.col("audit_id").alias("current_id"), F.col("score").alias("to_score")), "current_id", "left")
    return out.select("project_id", "from_score", "to_score", (F.col("to_score") - F.col("from_score")).alias("delta"))
