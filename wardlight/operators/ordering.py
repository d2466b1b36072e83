"""Running numbers and running sums that survive a hot key.

A plain ``row_number() over (partition by key order by t)`` sends every row of
a key to one task.  Here the rows are range-partitioned on (keys, order)
instead, so a key that holds a third of the table is spread over many tasks;
per-partition totals then give each partition its starting offset.

The range cut depends on sampling, so it is fixed once in a reliable
checkpoint before it is read twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.session import checkpointed


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    number: str | None = None,
    sums: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based running number and running sums per key, in ``order``.

    ``sums`` maps new column -> summed column.  ``order`` must be a total
    order within a key.  The offsets table has one row per (range partition,
    key), so its size follows the partition count and the keys, not the rows.
    """
    sums = sums or {}
    cut = checkpointed(
        (
            df.repartitionByRange(partitions, *keys, *order)
            if partitions
            else df.repartitionByRange(*keys, *order)
        ).withColumn("_part", F.spark_partition_id())
    )
    totals = cut.groupBy("_part", *keys).agg(
        F.count("*").alias("_n"),
        *[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()],
    )
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}")
            for name in sums
        ],
    )
    inside = W.partitionBy("_part", *keys).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns(
        {
            "_rn": F.row_number().over(inside),
            **{f"_run_{name}": F.sum(source).over(upto) for name, source in sums.items()},
        }
    )
    joined = local.join(offsets, ["_part", *keys], "left")
    added = {name: F.col(f"_run_{name}") + F.col(f"_off_{name}") for name in sums}
    if number:
        added[number] = F.col("_rn") + F.col("_off_n")
    return joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Add the previous row's ``value`` per key, in ``order``; null at the first.

    As :func:`with_running`: rows are range-partitioned, looked back inside a
    partition, and the first row of a key in a partition takes the key's last
    value from the partition before.
    """
    cut = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *keys).orderBy(*order)
    ends = cut.groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = ends.select(
        "_part", *keys, F.lag("_end").over(W.partitionBy(*keys).orderBy("_part")).alias("_carried")
    )
    local = cut.withColumns({"_rn": F.row_number().over(inside), "_before": F.lag(value).over(inside)})
    return local.join(carried, ["_part", *keys], "left").select(
        *df.columns, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_before")).alias(into)
    )


def small_side(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 64 << 20) -> DataFrame:
    """A join side, broadcast if its rows and bytes have been counted to be small.

    The side is written out first, so counting it and joining it read the same
    rows and its own input is scanned once.  Beyond ``max_rows`` rows or
    ``max_bytes`` bytes there is no hint and Spark shuffles both sides.
    """
    fixed = checkpointed(df)
    width = sum(_width(f) for f in fixed.schema.fields)
    rows, size = fixed.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(fixed) if rows <= max_rows and size <= max_bytes else fixed


def _width(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0)) + 16
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(16)
    return F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0)) + 16


def first_n(
    df: DataFrame,
    keys: list[str],
    order: list,
    n: int,
    spread_by: Column,
    spread: int = 64,
) -> DataFrame:
    """The first ``n`` rows per key, exact, without one task per hot key.

    Two rankings: inside a salted part of the key first, then over the at most
    ``n * spread`` survivors of a key.
    """
    from wardlight.functions.columns import salt

    part = df.withColumn("_salt", salt(spread_by, spread))
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    outer = W.partitionBy(*keys).orderBy(*order)
    return (
        part.withColumn("_rn", F.row_number().over(inner))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(outer))
        .filter(F.col("_rn") <= n)
        .drop("_rn", "_salt")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``.

    Spark ranks before the shuffle as well (a partial group limit), so a key
    with many copies sends one row per map task, not all of them.
    """
    rank = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(rank)).filter("_rn = 1").drop("_rn")


def percentiles(df: DataFrame, value: str, points: dict[str, float], bins: int = 4096) -> dict[str, float | None]:
    """Exact interpolated percentiles of a whole-number column, in fixed memory.

    The range of the values is cut into ``bins`` steps, counts tell which step
    holds a wanted rank, and that step is cut again until it is one value wide.
    Each pass is one aggregate of at most ``bins`` counts for each range still
    open (two ranks a point), whatever the values are: an outlier costs passes,
    about one for each factor ``bins`` of the range, not memory.  ``df`` is read
    once a pass, so it should be held; null values do not count, and without
    values every percentile is None.
    """
    rows = df.select(F.col(value).cast("decimal(20,0)").alias("v")).where("v is not null")
    total, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not total:
        return dict.fromkeys(points)
    ranks = {p: (total - 1) * share for p, share in points.items()}
    wanted = {int(r) for r in ranks.values()} | {min(int(r) + 1, total - 1) for r in ranks.values()}
    found: dict[int, int] = {}
    # Ranges by their ends: the ranks in them, and how many values lie before.
    ranges = {(int(low), int(high)): (sorted(wanted), 0)}
    while ranges:
        for low, high in [ends for ends in ranges if ends[0] == ends[1]]:
            found.update(dict.fromkeys(ranges.pop((low, high))[0], low))
        if not ranges:
            break
        ends = list(ranges)
        steps = [-(-(high - low + 1) // bins) for low, high in ends]
        at = [
            F.when(
                F.col("v").between(F.lit(Decimal(low)), F.lit(Decimal(high))),
                F.struct(F.lit(k).alias("k"), F.expr(f"cast((v - {low}BD) div {step}BD as int)").alias("bin")),
            )
            for k, ((low, high), step) in enumerate(zip(ends, steps))
        ]
        # Ranges do not overlap: a value lies in one at most.
        counted = rows.select(F.coalesce(*at).alias("at")).where("at is not null").groupBy("at.k", "at.bin").count().collect()
        narrower = {}
        for k, ((low, high), step) in enumerate(zip(ends, steps)):
            left, before = ranges[low, high]
            for row in sorted((r for r in counted if r["k"] == k), key=lambda r: r["bin"]):
                inside = [r for r in left if before <= r < before + row["count"]]
                if inside:
                    start = low + row["bin"] * step
                    narrower[start, min(start + step - 1, high)] = (inside, before)
                before += row["count"]
        ranges = narrower
    out = {}
    for name, rank in ranks.items():
        below, above = found[int(rank)], found[min(int(rank) + 1, total - 1)]
        part = rank - int(rank)
        out[name] = below + (above - below) * part if part and above != below else below
    return out
