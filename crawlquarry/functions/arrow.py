"""Arrow functions on executors: the package travels with them, so a cluster needs no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_crawlquarry_shipped", False) or ".zip" in ROOT:
        return
    to = os.path.join(tempfile.mkdtemp(prefix="crawlquarry-ship-"), "crawlquarry.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(ROOT):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("crawlquarry", os.path.relpath(full, ROOT)))
    sc.addPyFile(to)
    sc._crawlquarry_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself if it is read in as many pieces as there are cores, as large tables are; a smaller one (one file of one
    row group is one piece, whatever is done with it) is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # moved already, and adaptive execution knows its size
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < min(cores, 64) else df
