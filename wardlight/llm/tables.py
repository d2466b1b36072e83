"""Results written to the shared folder, so they are computed once and survive lost executors."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts lineage like a checkpoint; Spark also knows the table's size, so it
    can decide by itself whether a join may broadcast it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and shuffles of finished jobs from the executors.

    Its cleaner acts on what the driver's collectors find unused; by itself the
    driver, which holds little, would not collect between the steps of a pipeline.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: About a slice of text (``textbytes.SLICE``) and the next.
BATCH_BYTES = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of ``BATCH_BYTES``, unless the session has a bound of its own.

    Spark cuts batches at 10,000 rows, whatever their size; whole texts make that
    tens of MB, held outside the heap by the executor (with a copy on the way)
    and again by the worker, while all work is done in slices that are smaller.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


SIFT_BITS = 1 << 25


def sifted(df: DataFrame, column: str, keys: DataFrame, flag: str = "_maybe") -> DataFrame:
    """``df`` with ``flag``: false where ``column`` is certainly not among ``keys``.

    A bitmap of hashed keys, so that rows without a partner need not be
    shuffled to a join.  It has ``SIFT_BITS`` bits (4 MB) at most, whatever the
    number of keys, and may therefore be broadcast; the more keys there are, the
    more other rows pass too.
    """

    def place(name: str):
        return F.pmod(F.xxhash64(name), F.lit(SIFT_BITS))

    bits = F.bitmap_construct_agg(F.bitmap_bit_position(place(column))).alias("_bits")
    maps = written(keys.groupBy(F.bitmap_bucket_number(place(column)).alias("_bucket")).agg(bits), "sift")
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(place(column))).join(F.broadcast(maps), "_bucket", "left")
    at = F.bitmap_bit_position(place(column)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


def first_by_hash(df: DataFrame, place: str, rows: int, size: str | None = None, most: int = 0) -> DataFrame:
    """The rows of ``df`` whose ``place`` (a 64-bit hash) comes first, within bounds.

    At most ``rows`` rows, and at most ``most`` of the sum of ``size``, are kept:
    whole slices of the hash, of which there are 4096, in order.
    """
    slot = F.shiftrightunsigned(place, 52)
    total = F.sum(size) if size else F.lit(0)
    parts = df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), total.alias("size")).collect()
    n = weight = last = 0
    for part in sorted(parts, key=lambda r: r["slot"]):
        n, weight = n + part["n"], weight + part["size"]
        if n > rows or weight > most > 0:
            break
        last = part["slot"] + 1
    return df.where(slot < last)
