"""Physical retention of an event table: what has expired is removed from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.operators import ledger
from wardlight.operators.timeslice import MONTH
from wardlight.session import local_table, scratch_path
from wardlight.sources.sinks import read_events


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark can reach; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def month_actions(events: DataFrame, as_of, days: dict[str, int], default_days: int) -> DataFrame:
    """(event_month, action): ``drop`` months past every retention, ``check`` those past some."""
    spans = [default_days, *days.values()]
    cut = F.lit(as_of).cast("timestamp")
    months = events.select(MONTH).where(F.col(MONTH).isNotNull()).distinct()  # one row a month
    first = F.to_timestamp(F.col(MONTH).cast("string"), "yyyyMM")
    after = F.add_months(first.cast("date"), 1).cast("timestamp")
    action = (
        F.when(after <= cut - F.make_dt_interval(F.lit(max(spans))), "drop")
        .when(first < cut - F.make_dt_interval(F.lit(min(spans))), "check")
        .otherwise("keep")
    )
    return months.select(F.col(MONTH).cast("int").alias(MONTH), action.alias("action"))


def purge_events(spark: SparkSession, path: str, as_of, days: dict[str, int] | None = None, default_days: int = 30) -> DataFrame:
    """Remove what :func:`ledger.apply_retention` would leave out; (event_month, action, events_kept).

    Months past the retention of every source type are dropped whole, without
    being read.  Months past some of them are read once; those that hold expired
    events are written to a folder of their own first and then replace their
    partition (dynamic overwrite), or are dropped if nothing is left.  Other
    months, and events without a time, are not touched.  What has been removed is
    not found again, so a purge that broke off may simply be run again.
    """
    days = days or s.RETENTION_DAYS
    events = read_events(spark, path)
    actions = {r[MONTH]: r["action"] for r in month_actions(events, as_of, days, default_days).collect()}
    report = [(m, "dropped", 0) for m, a in actions.items() if a == "drop"]
    border = [m for m, a in actions.items() if a == "check"]
    if border:
        month = F.col(MONTH).cast("int")
        held = events.where(month.isin(border))
        staged = scratch_path(spark, "retained")
        kept = ledger.apply_retention(held, as_of, days, default_days)
        kept.write.partitionBy(MONTH).parquet(staged)
        left = spark.read.schema(events.schema).parquet(staged)
        before = {r["m"]: r["n"] for r in held.groupBy(month.alias("m")).agg(F.count("*").alias("n")).collect()}
        after = {r["m"]: r["n"] for r in left.groupBy(month.alias("m")).agg(F.count("*").alias("n")).collect()}
        changed = [m for m in border if 0 < after.get(m, 0) < before[m]]
        if changed:
            rows = left.where(month.isin(changed)).repartitionByRange(MONTH, "TimeGenerated", "EventRecordID")
            rows.sortWithinPartitions(MONTH, "TimeGenerated", "HostName", "EventID").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy(MONTH).parquet(path)
        for m in border:
            action = "rewritten" if m in changed else "kept" if after.get(m, 0) else "dropped"
            report.append((m, action, after.get(m, 0)))
    for m, action, _ in report:
        if action == "dropped":
            delete_folder(spark, f"{path}/{MONTH}={m}")
    return local_table(spark, sorted(report), f"{MONTH} int, action string, events_kept bigint")
