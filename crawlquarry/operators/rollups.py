"""Counts, latest children, boards and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry.schema import PRIORITIES, SEVERITIES, TASK_STATUSES


def rank(c: Column, order: list[str]) -> Column:
    """Place of a value in an enum's order, unknown values last."""
    out = F.lit(len(order))
    for n, v in reversed(list(enumerate(order))):
        out = F.when(c == v, n).otherwise(out)
    return out


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): children of every parent, 0 where there are none. Counted before the join, so that several counts
    don't multiply each other."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.select(key).distinct().join(n, key, "left").na.fill(0, [name])


def latest_child(children: DataFrame, key: str, order: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest child of each parent, ties by the smaller id."""
    w = Window.partitionBy(key).orderBy(F.desc(order), tie)
    return children.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, *columns)


def latest_children(children: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` children of each parent in an order, with their ``place``; picked before rows move."""
    w = Window.partitionBy(key).orderBy(*order)
    return children.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def severity_histogram(found: DataFrame, audits: DataFrame) -> DataFrame:
    """(audit_id, severity, n): issues by severity, zeros included."""
    all_ = audits.select("audit_id").distinct().select("audit_id", F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"))
    n = found.groupBy("audit_id", "severity").agg(F.count("*").alias("n"))
    return all_.join(n, ["audit_id", "severity"], "left").na.fill(0, ["n"])


def high_priority(found: DataFrame) -> DataFrame:
    """(audit_id, n): issues of severity CRITICAL or HIGH."""
    return found.groupBy("audit_id").agg(F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("n"))


def scalars(**counts: DataFrame) -> DataFrame:
    """One row of several independent counts, each (by name) of a frame of one row and one column."""
    rows = [df.toDF("value").select(F.lit(name).alias("name"), "value") for name, df in counts.items()]
    return reduce(DataFrame.unionByName, rows).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in counts])


def board(tasks: DataFrame, status: str = "status", priority: str = "priority") -> list[Column]:
    """Order of a task board: by status, then priority, in the order of their enums."""
    return [rank(F.col(status), TASK_STATUSES), rank(F.col(priority), PRIORITIES)]


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order (a feature of lists, planned as a heap per partition)."""
    return df.orderBy(*order).limit(n)
