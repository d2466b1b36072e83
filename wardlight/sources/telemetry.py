"""Security telemetry derived from the ``events`` table.

The test tables hold no security log.  This module maps each row of
``events`` to one canonical event with integer and string arithmetic only, so
the same mapping can be written in any SQL dialect (see ``plans/oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.schema import CANONICAL_COLUMNS, EVENT_SCHEMA

SYSMON = "Microsoft-Windows-Sysmon/Operational"
EVENT_IDS = {"click": 4624, "view": 4769, "error": 4768, "purchase": 4662, "signup": 10}
SOURCES = ["wef", "syslog", "netflow", "forensic"]
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file stream, be it one file or a folder of parts; the schema comes from its footer.

    Without ``files_per_trigger`` the whole table is one micro-batch: its parts are in no
    order of time, so in later batches a watermark would leave rows behind.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _pick(number: Column, options: list) -> Column:
    chosen = None
    for i, option in enumerate(options):
        test = number == i
        chosen = F.when(test, F.lit(option)) if chosen is None else chosen.when(test, F.lit(option))
    return chosen


def _suffixed(name: Column, dollar: Column) -> Column:
    return F.concat(name, F.when(dollar, F.lit("$")).otherwise(F.lit("")))


def as_security_events(events: DataFrame) -> DataFrame:
    """Canonical columns plus SourceType, TargetImage and SampleKey."""
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("SampleKey")
    eid, src = F.col("EventID"), F.col("SourceType")
    sysmon = eid == 10
    back = "\\"
    base = events.select(
        "event_id",
        "user_id",
        "value",
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("TimeGenerated"),
        F.get_json_object("props", "$.k").cast("int").alias("SampleKey"),
        F.element_at(
            F.create_map(*[F.lit(x) for pair in EVENT_IDS.items() for x in pair]),
            F.col("event_type"),
        )
        .cast("bigint")
        .alias("EventID"),
        _pick(e % 4, SOURCES).alias("SourceType"),
    )
    rows = base.withColumn("ProvenanceTag", F.concat(src, F.lit(":x:0"))).select(
        "TimeGenerated",
        F.concat(F.lit("host"), (u % 20).cast("string")).alias("HostName"),
        "EventID",
        F.concat("ProvenanceTag", F.lit(":"), e.cast("string")).alias("EventRecordID"),
        F.when(sysmon, SYSMON).otherwise("Security").alias("ChannelName"),
        _suffixed(F.concat(F.lit("user"), u.cast("string")), u % 7 == 0).alias("SubjectUserName"),
        _suffixed(F.concat(F.lit("user"), k.cast("string")), k % 5 == 0).alias("TargetUserName"),
        F.when(eid == 4624, _pick(k % 3, [2, 3, 10])).otherwise(0).cast("int").alias("LogonType"),
        _suffixed(F.concat(F.lit("svc"), k.cast("string")), k % 3 == 0).alias("ServiceName"),
        F.when(sysmon, _pick(k % 4, ["0x1010", "0x40", "0x1000", "0x143a"]))
        .otherwise("")
        .alias("GrantedAccess"),
        F.when(
            sysmon,
            F.when(k % 3 != 0, f"C:{back}Windows{back}System32{back}lsass.exe").otherwise(
                f"C:{back}x.exe"
            ),
        )
        .otherwise("")
        .alias("TargetImage"),
        F.when(
            sysmon,
            F.when(k % 10 == 0, f"C:{back}Windows{back}System32{back}svchost.exe").otherwise(
                F.concat(F.lit(f"C:{back}tools{back}p"), k.cast("string"), F.lit(".exe"))
            ),
        )
        .otherwise("")
        .alias("ProcessImagePath"),
        F.when((eid == 4662) & (k % 2 == 0), "DC=corp,DC=lab").otherwise("").alias("ObjectName"),
        F.when(k % 50 == 0, "127.0.0.1")
        .otherwise(F.concat_ws(".", F.lit("10"), (u % 4).cast("string"), F.lit("0"), k.cast("string")))
        .alias("SrcIpAddr"),
        F.concat(F.lit("10.9.0."), (e % 50).cast("string")).alias("DstIpAddr"),
        _pick(e % 5, [445, 3389, 443, 53, 80]).cast("int").alias("DstPort"),
        F.when(k % 2 == 0, F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}")))
        .otherwise("")
        .alias("UnmappedFields"),
        F.timestamp_millis(
            F.unix_millis("TimeGenerated") + F.floor(F.col("value") * 1000).cast("bigint")
        ).alias("IngestTimestamp"),
        "ProvenanceTag",
        "SourceType",
        "SampleKey",
    )
    present = set(rows.columns)
    blanks = {
        f.name: F.lit("" if f.dataType.simpleString() == "string" else 0).cast(f.dataType)
        for f in EVENT_SCHEMA.fields
        if f.name not in present
    }
    return rows.withColumns(blanks).select(
        *CANONICAL_COLUMNS, "SourceType", "TargetImage", "SampleKey"
    )


def security_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_security_events(table(spark, folder, "events"))


def raw_messages(events: DataFrame) -> DataFrame:
    """One raw message per event, in the shape its source would send.

    ``id, provenance_tag, payload (JSON text), received_at``.
    """
    sec = as_security_events(events)
    k = F.col("SampleKey")
    number = F.split_part("EventRecordID", F.lit(":"), F.lit(4))
    iso = F.date_format("TimeGenerated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    extra = F.when(k % 2 == 0, k)
    windows = F.struct(
        F.when(k % 2 == 0, F.col("EventID").cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("EventID").cast("string"), F.lit(" ")))
        .alias("EventID"),
        number.alias("EventRecordID"),
        F.col("HostName").alias("Computer"),
        F.col("ChannelName").alias("Channel"),
        iso.alias("TimeCreated"),
        "SubjectUserName",
        "TargetUserName",
        "LogonType",
        "ServiceName",
        F.col("ProcessImagePath").alias("Image"),
        "GrantedAccess",
        "ObjectName",
        F.col("SrcIpAddr").alias("IpAddress"),
        F.lit("70000").alias("IpPort"),
        F.col("DstIpAddr").alias("DestAddress"),
        F.col("DstPort").cast("string").alias("DestPort"),
        F.lit("TCP").alias("Protocol"),
        F.concat(F.lit("md5="), F.upper(F.md5(number.cast("binary")))).alias("Hashes"),
        extra.alias("k"),
    )
    syslog = F.struct(
        number.alias("record_id"),
        F.concat(F.lit("session for "), F.col("SubjectUserName")).alias("message"),
        F.col("HostName").alias("hostname"),
        F.lit("sshd").alias("appname"),
        iso.alias("timestamp"),
        F.col("SrcIpAddr").alias("src_ip"),
        F.col("DstIpAddr").alias("dst_ip"),
        F.lit("x").alias("src_port"),
        F.col("DstPort").alias("dst_port"),
        extra.alias("k"),
    )
    netflow = F.struct(
        number.alias("record_id"),
        F.col("HostName").alias("exporter"),
        iso.alias("start_time"),
        F.col("SrcIpAddr").alias("src_ip"),
        F.col("DstIpAddr").alias("dst_ip"),
        F.lit(-5).alias("src_port"),
        F.col("DstPort").alias("dst_port"),
        _pick(k % 4, [6, 17, 1, 47]).alias("protocol"),
        (k * 100).alias("bytes"),
        extra.alias("k"),
    )
    forensic = F.struct(
        number.alias("record_id"),
        F.col("HostName").alias("hostname"),
        F.lit("not a time").alias("timestamp"),
        F.col("EventID"),
        F.lit("collector").alias("tool"),
        F.concat(F.lit("run "), k.cast("string")).alias("cmdline"),
        F.col("ProcessImagePath").alias("image_path"),
        extra.alias("k"),
    )
    src = F.col("SourceType")
    return sec.select(
        F.col("EventRecordID").alias("id"),
        F.col("ProvenanceTag").alias("provenance_tag"),
        F.when(src == "wef", F.to_json(windows))
        .when(src == "syslog", F.to_json(syslog))
        .when(src == "netflow", F.to_json(netflow))
        .otherwise(F.to_json(forensic))
        .alias("payload"),
        F.col("IngestTimestamp").alias("received_at"),
    )
