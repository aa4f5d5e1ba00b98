"""Merging rows of one page, and replacing a stored snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X


def first_wins(rows: DataFrame, keys: tuple[str, ...] = ("audit_id", "url"), order: str = "ord") -> DataFrame:
    """One row per key (the url trimmed); each column has its first value in ``order`` that is neither null nor empty.
    0, false and UNKNOWN are values. A map column ``extra`` is united, the last value of a key winning. Rows without url
    are dropped. One shuffle, combined before it."""
    kinds = dict(rows.dtypes)
    rest = [c for c in rows.columns if c not in (*keys, order, "extra")]
    base = rows.withColumn("url", X.blank_to_null(F.col("url"))).where("url is not null")
    value = lambda c: F.when(F.col(c) != "", F.col(c)) if kinds[c] == "string" else F.col(c)
    out = base.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(value(c), F.when(value(c).isNotNull(), F.col(order))).alias(c) for c in rest])
    if "extra" in kinds:
        last = base.select(*keys, order, F.explode("extra")).groupBy(*keys, "key").agg(F.max_by("value", order).alias("value"))
        united = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("extra"))
        out = out.join(united, list(keys), "left")
    return out


def counters(parsed: DataFrame) -> DataFrame:
    """(rows_total, rows_skipped, rows_kept, rows_imported) of parsed rows: imported are distinct pages after merging."""
    url = X.blank_to_null(F.col("url"))
    return parsed.agg(F.count("*").alias("rows_total"), F.count_if(url.isNull()).alias("rows_skipped"), F.count(url).alias("rows_kept"), F.count_distinct(url).alias("rows_imported"))


def import_status(counted: DataFrame, warnings: int) -> DataFrame:
    """FAILED without pages, PARTIAL with warnings, else IMPORTED."""
    return counted.withColumn("status", F.when(F.col("rows_imported") == 0, "FAILED").when(F.lit(warnings > 0), "PARTIAL").otherwise("IMPORTED"))


def replace_snapshot(rows: DataFrame, path: str) -> None:
    """Replace the stored rows of the audits in ``rows``, leaving other audits alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("audit_id").parquet(path)


def insert_absent(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those fresh ones whose key isn't stored yet; nothing is updated."""
    return stored.unionByName(fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))
