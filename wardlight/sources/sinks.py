"""Sinks: the event table, health records, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.session import local_table

CAP_NOTE = "Results capped: more rows matched than this file holds"


def write_events(events: DataFrame, path: str, mode: str = "append", files_per_month: int | None = None) -> None:
    """Canonical columns, partitioned by month, sorted for time/host/id scans.

    Rows are spread over (month, hour of day, hash of id) so that one month or
    one busy hour is written by many tasks; each file stays narrow in time.
    """
    rows = events.select(*s.CANONICAL_COLUMNS).withColumn(
        "event_month", F.date_format("TimeGenerated", "yyyyMM")
    )
    if files_per_month:
        rows = rows.repartition(
            files_per_month, "event_month", F.pmod(F.xxhash64("EventRecordID"), F.lit(files_per_month))
        )
    else:
        rows = rows.repartitionByRange("event_month", "TimeGenerated", "EventRecordID")
    rows.sortWithinPartitions("event_month", "TimeGenerated", "HostName", "EventID").write.mode(
        mode
    ).partitionBy("event_month").parquet(path)


def read_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_health(records: DataFrame, path: str, mode: str = "append") -> None:
    """Health records as JSON lines."""
    records.write.mode(mode).json(path)


def csv_cell(col: Column) -> Column:
    """Quoted cell; a leading ``= + - @`` is neutralised, quotes are doubled."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    safe = F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def _export_text(name: str, at: str) -> Column:
    column = F.col(name)
    if name in ("TimeGenerated", "IngestTimestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return column


def csv_rows(events: DataFrame) -> DataFrame:
    """(EventRecordID, row): the CSV text of every event."""
    cells = [csv_cell(_export_text(n, n)) for n in s.CANONICAL_COLUMNS]
    return events.select("EventRecordID", F.concat_ws(",", *cells).alias("row"))


def csv_header(truncated: bool = False, note: str = CAP_NOTE) -> list[str]:
    lines = [f"# NOTE: {note}"] if truncated else []
    return [*lines, ",".join(f'"{n}"' for n in s.CANONICAL_COLUMNS)]


def export_csv(events: DataFrame, path: str, truncated: bool = False, note: str = CAP_NOTE) -> None:
    """CSV part files with CRLF; header lines go to ``path/header``."""
    spark = events.sparkSession
    header = local_table(spark, [(x,) for x in csv_header(truncated, note)], "value string")
    header.coalesce(1).write.option("lineSep", "\r\n").text(f"{path}/header")
    csv_rows(events).select(F.col("row").alias("value")).write.option("lineSep", "\r\n").text(f"{path}/rows")


def json_rows(events: DataFrame) -> DataFrame:
    """(EventRecordID, row): every event as a JSON object."""
    items = [_export_text(n, n).alias(n) for n in s.CANONICAL_COLUMNS]
    return events.select("EventRecordID", F.to_json(F.struct(*items)).alias("row"))


def export_json(events: DataFrame, path: str, truncated: bool = False, note: str = CAP_NOTE) -> None:
    """Events as JSON lines and a one-row manifest with the truncation note."""
    spark = events.sparkSession
    manifest = local_table(
        spark, [(truncated, note if truncated else None)], "_truncated boolean, _truncation_note string"
    )
    manifest.coalesce(1).write.json(f"{path}/manifest")
    json_rows(events).select(F.col("row").alias("value")).write.text(f"{path}/events")
