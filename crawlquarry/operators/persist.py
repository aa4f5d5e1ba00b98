"""Stored audits: pages, issues, links and header of an audit, replaced as one unit.

A write makes a new unit in each table and then adds one line per audit to the manifest; readers take the unit that an
audit's last line names. So a write that fails leaves the old state, an audit whose new snapshot is empty becomes empty,
and audits that a write doesn't name keep what they have. One writer at a time.

Defined results
    Blank urls are dropped, of equal urls of an audit the last record counts. Records of audits that the write doesn't
    name are left out. An audit without pages has no issues and the score 100. Extra columns of pages don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.operators import engine
from crawlquarry.plans.sized import small, written

MANIFEST = "audit_id string, unit string, version bigint"


class Store:
    """Audits stored under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm, at = self.spark.sparkContext._jvm, f"{self.path}/manifest"
        p = jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        """(audit_id, unit): what each audit's last write made."""
        if not self._exists():
            return self.spark.createDataFrame([], "audit_id string, unit string")
        lines = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        return lines.groupBy("audit_id").agg(F.max_by("unit", "version").alias("unit"))

    def replace(self, rows: DataFrame, audits: DataFrame) -> None:
        """Replace the audits (audit_id) by the pages in ``rows``: urls, then issues, links and header from what was stored,
        then the manifest."""
        unit = uuid.uuid4().hex
        put = lambda df, table: df.write.parquet(f"{self.path}/{table}/unit={unit}")
        named = small(written(audits.select("audit_id").where("audit_id is not null").distinct()))
        put(engine.last_wins(engine.records(rows).join(named, "audit_id", "left_semi")), "urls")
        pages = self.spark.read.parquet(f"{self.path}/urls/unit={unit}")
        put(engine.ordered(engine.summarized(pages)), "issues")
        put(engine.links(engine.matches(pages)).select("audit_id", "rule_key", "url", "evidence", "place"), "links")
        issues = self.spark.read.parquet(f"{self.path}/issues/unit={unit}")
        parts = engine.breakdown(issues).groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("place", "rule_key", "penalty"))).alias("breakdown"))  # 25 at most
        total = pages.groupBy("audit_id").agg(F.count("*").alias("total_urls"))
        head = engine.scores(issues, named).join(parts, "audit_id", "left").join(total, "audit_id", "left")
        put(head.select("audit_id", F.lit("READY").alias("status"), "score", "total_penalty", F.coalesce("total_urls", F.lit(0)).alias("total_urls"), "breakdown"), "header")
        before = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] if self._exists() else 0
        named.select("audit_id", F.lit(unit).alias("unit"), F.lit((before or 0) + 1).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, table: str) -> DataFrame:
        """``urls``, ``issues``, ``links`` or ``header`` of all audits as they stand."""
        return self.spark.read.parquet(f"{self.path}/{table}").join(small(written(self.manifest())), ["audit_id", "unit"], "left_semi").drop("unit")
