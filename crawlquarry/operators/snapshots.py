"""What changed between consecutive full snapshots.

The pages of all snapshots are range-partitioned by (schedule, url) and sorted by (schedule, url, snapshot): every range
is one sorted run in which the versions of a page stand beside each other. Two pointers, the version before and the
version at hand, stream over the run once: pages of consecutive snapshots are compared, a gap before or behind a version
is an added or a removed page. The ranges come from sampled keys, so a schedule with a third of all rows is cut like any
other; one shuffle and one sort serve deduplication and comparison, and no group is ever held. Texts are only compared, so
64-bit hashes of them move in their place.

That derives the changes of a whole history at once. :class:`Kept` is for deliveries as they come: it keeps the last
snapshot of every schedule cut and sorted by key, so that a new one alone is shuffled, and merges the two run by run. The
cuts are buckets of the key's hash there, since only those let a stored side stay where it is.

Defined results
    Rows with a null url or of an unknown or null audit are no pages of a snapshot. A url of only spaces is the url ''.
    Audits without schedule, or not READY, don't count; the first READY audit of a schedule has no cases. Of audits at
    the same time the smaller audit_id comes first. An audit without rows is an empty snapshot: all pages are removed.
    Of several rows of a page in one audit that with the highest ord counts (null is lowest; a tie takes one of them by
    its values, always the same). Null and empty texts are equal; a null status code equals only null. Extra columns don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquarry.plans.sized import small, written

#: Buckets of kept snapshots: each should fit a task.
BUCKETS = 64

KEY = ("schedule_id", "url")


def timeline(audits: DataFrame) -> DataFrame:
    """(audit_id, schedule_id, seq, next_audit_id): the READY audits of each schedule in order of time."""
    w = Window.partitionBy("schedule_id").orderBy("audit_date", "audit_id")
    ready = audits.where((F.col("status") == "READY") & F.col("schedule_id").isNotNull() & F.col("audit_id").isNotNull())
    return ready.select("audit_id", "schedule_id", "audit_date").distinct().select("audit_id", "schedule_id", F.row_number().over(w).alias("seq"), F.lead("audit_id").over(w).alias("next_audit_id"))


def _compared(pages: DataFrame, columns: list[str]) -> list[Column]:
    """Columns to compare: numbers as they are, texts by their hash, null ones as empty ones."""
    text = {c: t == "string" for c, t in pages.dtypes}
    return [F.xxhash64(F.coalesce(c, F.lit(""))).alias(c) if text[c] else F.col(c) for c in columns]


def sorted_runs(pages: DataFrame, line: DataFrame, columns: list[str]) -> DataFrame:
    """The pages of the snapshots of a timeline as range-partitioned runs, sorted by (schedule, url, snapshot)."""
    line = small(line.select("audit_id", "schedule_id", "seq", F.col("next_audit_id").isNull().alias("is_last")))
    mine = pages.where(F.col("url").isNotNull()).select("audit_id", F.expr("trim(url)").alias("url"), "ord", *_compared(pages, columns))
    return mine.join(line, "audit_id").drop("audit_id").repartitionByRange(*KEY).sortWithinPartitions(*KEY, "seq", F.desc("ord"), *[F.desc(c) for c in columns])


def _same(a: Column, b: Column, text: bool) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")) if text else a.eqNullSafe(b)


def changes(pages: DataFrame, audits: DataFrame, columns: tuple[str, ...] = ("status_code", "title", "canonical")) -> DataFrame:
    """(schedule_id, audit_id, url, change_kind, changed): typed changes, audit_id being the later snapshot's and
    ``changed`` naming the columns of a ``changed`` page."""
    cols = list(columns)
    line = written(timeline(audits))
    runs = sorted_runs(pages, line, cols)
    first = Window.partitionBy(*KEY, "seq").orderBy(F.desc("ord"), *[F.desc(c) for c in cols])
    page = runs.select("*", F.row_number().over(first).alias("_n")).where("_n = 1")
    run = Window.partitionBy(*KEY).orderBy("seq")
    version = page.select(
        *KEY, "seq", "is_last", *cols,
        F.lag("seq").over(run).alias("p_seq"), F.lead("seq").over(run).alias("n_seq"),
        *[F.lag(c).over(run).alias(f"p_{c}") for c in cols],
    )
    beside = F.col("p_seq") == F.col("seq") - 1
    differ = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"p_{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    case = lambda seq, kind, names: F.struct(seq.alias("seq"), F.lit(kind).alias("change_kind"), names.alias("changed"))
    found = F.array(
        F.when((F.col("seq") > 1) & ~F.coalesce(beside, F.lit(False)), case(F.col("seq"), "added", none)),
        F.when(beside & (F.size(differ) > 0), case(F.col("seq"), "changed", differ)),
        F.when(~F.col("is_last") & ~F.coalesce(F.col("n_seq") == F.col("seq") + 1, F.lit(False)), case(F.col("seq") + 1, "removed", none)),
    )
    cases = version.select("schedule_id", "url", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("schedule_id", "url", "c.*")
    names = small(line.select("schedule_id", "seq", "audit_id"))
    return cases.join(names, ["schedule_id", "seq"]).select("schedule_id", "audit_id", "url", "change_kind", "changed")


class Kept:
    """The last snapshot of every schedule, kept under a folder that all executors share. Each version is a table of its
    own, bucketed and sorted by (schedule, url); it also holds what its delivery changed, pages that it removed included."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = ("status_code", "title", "canonical"), buckets: int = BUCKETS):
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), list(columns), buckets
        self.table: str | None = None
        self.known: DataFrame | None = None

    def _first(self, pages: DataFrame, audits: DataFrame) -> DataFrame:
        """The counting row of each page of the audits (audit_id, schedule_id), one shuffle by key."""
        mine = pages.where(F.col("url").isNotNull()).select("audit_id", F.expr("trim(url)").alias("url"), "ord", *self.columns).join(small(audits), "audit_id").repartition(self.buckets, *KEY)
        w = Window.partitionBy(*KEY).orderBy(F.desc("ord"), *[F.desc(c) for c in self.columns])
        return mine.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*KEY, "audit_id", *self.columns)

    def advance(self, pages: DataFrame, audits: DataFrame) -> None:
        """Take in one new snapshot of each of some schedules: ``audits`` (audit_id, schedule_id, READY ones, at most one of
        a schedule), ``pages`` as for :func:`changes`."""
        audits = written(audits.select("audit_id", "schedule_id").where("audit_id is not null and schedule_id is not null"))
        if not audits.groupBy("schedule_id").count().where("count > 1").isEmpty():
            raise ValueError("more than one new snapshot of a schedule: take them in one after the other")
        new = self._first(pages, audits)
        text = {c: t == "string" for c, t in new.dtypes}
        old = self.spark.table(self.table).where("present").select(*KEY, "audit_id", *self.columns) if self.table else new.limit(0)
        before = self.known if self.known is not None else audits.limit(0)
        batch = audits.select("schedule_id", F.col("audit_id").alias("now")).join(before.select("schedule_id", F.lit(True).alias("again")), "schedule_id", "left")
        o, n = old.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("audit_id", *self.columns)]), new.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("audit_id", *self.columns)])
        both = o.join(n, list(KEY), "full_outer").join(small(written(batch)), "schedule_id", "left")
        here, there, fresh = F.col("n_audit_id").isNotNull(), F.col("o_audit_id").isNotNull(), F.col("now").isNotNull()
        differ = F.array_compact(F.array(*[F.when(~_same(F.col(f"n_{c}"), F.col(f"o_{c}"), text[c]), F.lit(c)) for c in self.columns]))
        kind = F.when(fresh & F.col("again"), F.when(~there, "added").when(~here, "removed").when(F.size(differ) > 0, "changed"))
        keep = lambda c: F.when(fresh & here, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
        after = both.select(*KEY, F.coalesce("now", "o_audit_id").alias("audit_id"), *map(keep, self.columns), (~fresh | here).alias("present"), kind.alias("change_kind"), F.when(kind == "changed", differ).otherwise(F.array().cast("array<string>")).alias("changed"))
        name = f"crawlquarry_{uuid.uuid4().hex}"
        after.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.known = written(before.select("schedule_id").unionByName(audits.select("schedule_id")).distinct())
        self.table = name

    def changes(self) -> DataFrame:
        """(schedule_id, audit_id, url, change_kind, changed) of the last delivery."""
        return self.spark.table(self.table).where("change_kind is not null").select("schedule_id", "audit_id", "url", "change_kind", "changed")
