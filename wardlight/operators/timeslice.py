"""Time ranges on event tables, so that month partitions outside them are not read.

An event table is partitioned by ``event_month`` (``yyyyMM``).  A condition on the
time alone does not tell Spark which partitions can hold it, so each range also
says it of the month.  Frames without that column get the time condition only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators.ordering import small_side

MONTH = "event_month"


def moment(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyyMM").cast("int")


def in_slice(df: DataFrame, start=None, end=None, at: str = "TimeGenerated", closed: bool = False) -> DataFrame:
    """Rows of ``[start, end)``, or ``[start, end]`` if ``closed``; None is no bound."""
    tests = []
    month = F.col(MONTH).cast("int") if MONTH in df.columns else None
    if start is not None:
        tests.append(F.col(at) >= moment(start))
        tests += [] if month is None else [month >= month_of(moment(start))]
    if end is not None:
        tests.append(F.col(at) <= moment(end) if closed else F.col(at) < moment(end))
        tests += [] if month is None else [month <= month_of(moment(end))]
    for test in tests:
        df = df.filter(test)
    return df


def back_from(df: DataFrame, as_of, back: str, at: str = "TimeGenerated") -> DataFrame:
    """Rows of the time ``back`` before ``as_of``, half-open."""
    return in_slice(df, moment(as_of) - F.expr(f"interval {back}"), as_of, at)


def in_slices(df: DataFrame, slices: DataFrame, start: str = "start", end: str = "end", at: str = "TimeGenerated") -> DataFrame:
    """Rows joined to each range of a table that holds them, half-open.

    Ranges are spread over their months and met by month, so Spark reads the
    partitions that some range reaches (dynamic pruning).  A range without a
    bound, or that ends before it starts, holds nothing.
    """
    held = F.col(start) < F.col(end)
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    if MONTH not in df.columns:
        return df.join(small_side(slices.filter(held)), inside)
    months = F.sequence(F.trunc(F.col(start).cast("date"), "month"), F.trunc(F.col(end).cast("date"), "month"), F.expr("interval 1 month"))
    spread = slices.filter(held).withColumn("_first", F.explode(months))
    spread = small_side(spread.withColumn("_month", month_of(F.col("_first").cast("timestamp"))).drop("_first"))
    # The condition again, on rows that are computed: it tells Spark that they are worth pruning by.
    return df.join(spread.filter(held), (F.col(MONTH).cast("int") == F.col("_month")) & inside).drop("_month")
