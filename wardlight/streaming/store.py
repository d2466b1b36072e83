"""The event table as a streaming sink, and compaction of its small files.

Events stream into ``path/live``, partitioned by month.  Spark's file sink keeps a
log of the files of each committed batch there, and readers go by that log: a batch
that is run again after a failure replaces its files, so no row is read twice.

A stream leaves many small files.  Compaction rewrites the live files of closed
months, sorted, under ``path/compacted`` and then names them in a list
(``path/taken``).  A reader takes the compacted rows of complete compactions and the
live files that none of them has taken; a compaction that broke off before its list
was written is not seen, and its folder is left behind for housekeeping.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.operators.ordering import small_side
from wardlight.operators.timeslice import MONTH

TAKEN = "run string, file string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stream_events(events: DataFrame, path: str) -> None:
    """Append what is there now to the event store; run again, it goes on where it stopped."""
    rows = events.select(*s.CANONICAL_COLUMNS).withColumn(MONTH, F.date_format("TimeGenerated", "yyyyMM").cast("int"))
    query = (
        rows.writeStream.format("parquet")
        .partitionBy(MONTH)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start(f"{path}/live")
    )
    query.awaitTermination()


def stream_health(records: DataFrame, path: str) -> None:
    """Append health records as JSON lines, each batch once."""
    query = (
        records.writeStream.format("json").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/live")
    )
    query.awaitTermination()


def _taken(spark: SparkSession, path: str) -> DataFrame:
    if exists(spark, f"{path}/taken"):
        return spark.read.schema(TAKEN).parquet(f"{path}/taken")
    return spark.createDataFrame([], TAKEN)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """Live rows that no compaction has taken, with ``_file``."""
    live = spark.read.parquet(f"{path}/live").withColumn("_file", F.col("_metadata.file_path"))
    taken = small_side(_taken(spark, path).select(F.col("file").alias("_file")).distinct())
    return live.join(taken, "_file", "left_anti")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All events of the store, each once."""
    live = _live(spark, path).drop("_file")
    if not exists(spark, f"{path}/taken"):
        return live
    runs = [r["run"] for r in _taken(spark, path).select("run").distinct().collect()]  # one a compaction
    done = spark.read.schema(live.schema).option("basePath", f"{path}/compacted").parquet(*[f"{path}/compacted/run={r}" for r in runs])
    return live.unionByName(done.select(*live.columns))


def compact(spark: SparkSession, path: str, before_month: int, rows_per_file: int = 5_000_000) -> int:
    """Rewrite the live files of months before ``before_month``; the number of files taken."""
    chosen = _live(spark, path).where(F.col(MONTH) < before_month)
    files = chosen.select("_file").distinct()
    count = files.count()
    if not count:
        return 0
    run = uuid.uuid4().hex
    rows = chosen.drop("_file").repartitionByRange(MONTH, "TimeGenerated", "EventRecordID")
    rows = rows.sortWithinPartitions(MONTH, "TimeGenerated", "HostName", "EventID")
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy(MONTH).parquet(f"{path}/compacted/run={run}")
    # The files read above are those that are listed: new batches only add others.
    files.select(F.lit(run).alias("run"), F.col("_file").alias("file")).write.mode("append").parquet(f"{path}/taken")
    return count
