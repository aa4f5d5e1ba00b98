"""Tables cut from their lineage, and broadcasts behind a check of their size.

Everything here is for *derived metadata* (headers of files, headers of audits, units of sources): tables that are far
smaller than the facts they describe but grow with them, so their size is measured before they are broadcast and there
is always a shuffle join for the case that they are larger.
"""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A derived table above this many bytes is shuffled, never broadcast.
BROADCAST_BYTES = 48 << 20

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session; only where that is unset, as in
    tests on one machine, a temporary folder of our own. On several machines that would be another folder on each, so
    there it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="crawlquarry-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut, it survives lost executors,
    and later reads of it prune columns. The files are deleted by
    :func:`released` or :func:`clean`, at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlquarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(clean)
    out = spark.read.schema(df.schema).parquet(path)
    out._crawlquarry_path = path
    _written[path] = spark
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder, deleted by :func:`clean`."""
    path = f"{shared_dir(spark)}/crawlquarry-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(df: DataFrame) -> None:
    """Delete a table that :func:`written` gave and that no result reads any more. Other frames are left alone."""
    if (path := getattr(df, "_crawlquarry_path", None)) in _written:
        _delete(_written.pop(path), path)


def clean() -> None:
    """Delete all that :func:`written` left: for long sessions, once the results of their queries are stored."""
    while _written:
        path, spark = _written.popitem()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue  # the session has ended, and only it knows the file system
        try:
            _delete(spark, path)
        except Exception as e:  # noqa: BLE001  at the end of the driver; what is left is named
            print(f"crawlquarry: {path} is left: {e}", file=sys.stderr)


def size_bytes(df: DataFrame) -> int:
    """Upper estimate of the bytes of ``df`` in memory, counted over all its rows."""
    parts = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")), F.lit(0)) + 24 for c, t in df.dtypes]
    return int(df.agg(F.sum(reduce(lambda a, b: a + b, parts)).cast("long").alias("n")).first()["n"] or 0)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written ``df``, marked for broadcast if it was measured to be within ``limit``; otherwise without a hint, so
    that the join is a shuffle whose skewed partitions adaptive execution splits."""
    return F.broadcast(df) if size_bytes(df) <= limit else df
