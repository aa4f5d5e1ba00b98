"""An extension: a landing folder whose new exports are parsed as they arrive and appended as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlquarry.operators import bad_records
from crawlquarry.plans.sized import released, small, written
from crawlquarry.sources import csv_files

#: Files of a micro-batch; they are numbered in one task, by path.
FILES_PER_BATCH = 10_000


def land(spark: SparkSession, folder: str, rows_path: str, faults_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Watch ``folder``; each micro-batch appends its typed rows to ``rows_path`` and its faulty records to
    ``faults_path``, both by batch number, so that a batch that is replayed after a failure overwrites itself. Rows are
    known by batch, file_id and line, and carry the path of their file."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{csv,CSV,zip,ZIP}").option("maxFilesPerTrigger", FILES_PER_BATCH).load(folder)
    files = files.select("path", "length")  # contents are read in ranges, not here

    def step(batch: DataFrame, number: int) -> None:
        place = F.row_number().over(Window.orderBy("path")) - 1
        named = written(batch.select("path", F.col("length").alias("size")).distinct().select(F.shiftleft(place.cast("long"), csv_files.PART_BITS).alias("file_id"), "path", "size"))
        raw = written(csv_files.read(named).where("warning is null").withColumn("loaded_at", F.lit(None).cast("timestamp")))
        of = small(named.select(F.col("file_id").alias("first_id"), "path"))
        whose = F.shiftleft(F.shiftright("file_id", csv_files.PART_BITS), csv_files.PART_BITS) == F.col("first_id")
        bad_records.typed(raw).join(of, whose).drop("first_id").write.mode("overwrite").parquet(f"{rows_path}/batch={number}")
        bad_records.faulty(raw).join(of, whose).drop("first_id").write.mode("overwrite").parquet(f"{faults_path}/batch={number}")
        released(raw)
        released(named)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
