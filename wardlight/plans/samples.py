"""Tables the registered queries start from, all derived from the given ones."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import ingest, rules
from wardlight.session import scratch_path
from wardlight.sources import telemetry as t

AS_OF = t.AS_OF
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
WHOLE = "30 days"


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, so a result does not depend on the session."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if f.dataType.simpleString() == "timestamp"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores.

    A table of one or two files is one or two tasks, however costly its
    parsing.  A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_json_arrays(df: DataFrame, path: str, suffix: str = ".json") -> None:
    """Rows as JSON arrays, one for each partition that has rows, in files with ``suffix``."""

    def framed(batches):
        last = None
        for batch in batches:
            lines = batch["value"].tolist()
            if lines:
                yield pd.DataFrame({"value": [("[" if last is None else ",") + lines[0], *("," + x for x in lines[1:])]})
                last = lines[-1]
        if last is not None:  # without rows no file: under a log's name "[]" would be a line
            yield pd.DataFrame({"value": ["]"]})

    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(framed, "value string")
    rows.write.text(path)
    rename_parts(df.sparkSession, path, suffix)


def write_with_header(df: DataFrame, header: str, path: str, suffix: str = ".csv") -> None:
    """Rows of text under a header line, one file for each partition, in files with ``suffix``."""

    def framed(batches):
        yield pd.DataFrame({"value": [header]})
        for batch in batches:
            yield pd.DataFrame({"value": batch["row"]})

    df.select("row").mapInPandas(framed, "value string").write.text(path)
    rename_parts(df.sparkSession, path, suffix)


def rename_parts(spark: SparkSession, path: str, suffix: str) -> None:
    """Give the part files of a written text table another suffix."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[: -len(".txt")] + suffix))


def sec(spark: SparkSession, folder: str) -> DataFrame:
    return t.security_events(spark, folder)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return t.raw_messages(spread(t.table(spark, folder, "events")))


RULE_FIELDS = {"TargetImage": "TargetImage"}


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return rules.detect_rules(sec(spark, folder), rules.AD_RULES)


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Detection ledger with a score and a delivery time from its window."""
    built = rules.build_hits(matches(spark, folder), rules.rules_table(spark, rules.AD_RULES))
    slot = F.pmod(F.floor(F.unix_seconds("batch_start") / 900), F.lit(100))
    return built.withColumns(
        {
            "anomaly_score": F.round(slot / 99.0, 4),
            "forwarded_at": F.when(slot % 3 != 0, F.col("created_at") + F.expr("interval 1 hour")),
        }
    )


STATUS_OF = {
    "click": "test",
    "view": "review",
    "error": "draft",
    "purchase": "production",
    "signup": "disabled",
}


def rule_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A change log of rule states: every event changes the rule of its user."""
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    return t.table(spark, folder, "events").select(
        F.concat(F.lit("rule"), F.col("user_id").cast("string")).alias("rule_id"),
        F.element_at(pairs, F.col("event_type")).alias("status"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


def incident_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events re-tagged as evidence uploaded to the incident of their host."""
    tag = F.concat_ws(
        ":",
        F.lit("manual-upload:incident"),
        F.col("HostName"),
        F.unix_seconds("IngestTimestamp").cast("string"),
    )
    return sec(spark, folder).withColumn("ProvenanceTag", tag)


def incident_list(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "nation").select(
        F.concat(F.lit("host"), F.col("n_nationkey").cast("string")).alias("incident_id"),
        F.col("n_name").alias("name"),
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Delivery outcome per hit, in hourly batches."""
    hour = F.date_trunc("hour", "created_at")
    return hits(spark, folder).select(
        F.date_format(hour, "yyyyMMddHH").alias("batch_id"),
        F.col("created_at").alias("sent_at"),
        "hit_id",
        F.col("forwarded_at").isNotNull().alias("delivered"),
    )


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the delivery batch (day) and stream they went out in."""
    return sec(spark, folder).select(
        F.date_format("TimeGenerated", "yyyyMMdd").alias("batch_id"),
        F.col("SourceType").alias("stream_tag"),
        "EventRecordID",
        "TimeGenerated",
        "DstPort",
    )


def forward_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows per batch and stream, delivered one day after the batch."""
    return (
        sent(spark, folder)
        .groupBy("batch_id", "stream_tag")
        .agg(F.count("*").alias("event_count"), F.max("TimeGenerated").alias("_last"))
        .select("batch_id", "stream_tag", "event_count", F.col("_last").alias("forwarded_at"))
    )


def health(spark: SparkSession, folder: str) -> DataFrame:
    """Flood records and batch outcomes in one health table."""
    from wardlight.operators import ledger

    flood = ingest.flood_heuristic(raw(spark, folder), 1, window=3600)
    batches = ledger.batch_health(outcomes(spark, folder))
    return ingest.union_sources(flood, batches)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ext, content): documents as .txt, event properties as .jsonl."""
    documents = spread(t.table(spark, folder, "documents")).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.lit("txt").alias("ext"),
        F.col("text").alias("content"),
    )
    properties = t.table(spark, folder, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string"), F.lit(".jsonl")).alias("file"),
        F.lit("jsonl").alias("ext"),
        F.concat(F.col("props"), F.lit("\nnot json\n\n"), F.col("props")).alias("content"),
    )
    return documents.unionByName(properties)


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ext, content): documents, some spoilt by a bad or a NUL byte."""
    body = F.encode("text", "UTF-8")
    return t.table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"),
        F.when(F.col("source") == "src3", "exe").otherwise("txt").alias("ext"),
        F.when(F.col("lang") == "de", F.concat(body, F.unhex(F.lit("FF"))))
        .when(F.col("lang") == "fr", F.concat(body, F.unhex(F.lit("00"))))
        .otherwise(body)
        .alias("content"),
    )


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content): an archive for each document, of a size that can be worked out.

    A third holds 2,000 equal bytes, a third the text stored as it is but cut
    short in its checksum, and a third the text stored as it is.
    """

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kind = batch["kind"]
            stored = [zlib.compress(bytes(x), 0) for x in batch["content"]]
            bomb = zlib.compress(b"a" * 2000)
            content = [bomb if k == 0 else x[:-2] if k == 1 else x for k, x in zip(kind, stored)]
            yield pd.DataFrame({"file": batch["file"], "content": content})

    files = t.table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"),
        F.encode("text", "UTF-8").alias("content"),
        (F.col("doc_id") % 3).alias("kind"),
    )
    return files.mapInPandas(squeeze, "file string, content binary")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed upload records by canonical name, with values that need care."""
    from wardlight.operators.normalize import parse_fields

    record = F.to_json(
        F.struct(
            "HostName",
            F.col("EventID").cast("string").alias("EventID"),
            F.lit("x").alias("SrcPort"),
            F.col("DstPort"),
            "CommandLine",
            F.upper("ServiceName").alias("ServiceName"),
            F.lit("forged:tag").alias("ProvenanceTag"),
            F.lit("1970-01-01").alias("IngestTimestamp"),
            F.lit("z").alias("_x_provenance"),
            F.when(F.col("SampleKey") % 2 == 0, F.col("SampleKey")).alias("extra"),
        )
    )
    received = F.col("IngestTimestamp")
    return (
        t.as_security_events(spread(t.table(spark, folder, "events")))
        .select(
            F.concat(F.col("HostName"), F.lit(".jsonl")).alias("file"),
            F.col("EventRecordID").alias("row_id"),
            parse_fields(record).alias("fields"),
            received.alias("IngestTimestamp"),
        )
        .withColumn("ProvenanceTag", ingest.upload_tag(F.col("file"), F.col("IngestTimestamp")))
    )


def long_records(docs: DataFrame) -> DataFrame:
    """(doc_id, record, size): each text 40 times in a field and, for every second document, 200 times in a note, as JSON.

    The text is escaped once and then repeated, which gives the same record as escaping what was repeated.
    """
    listed = docs.select("doc_id", F.to_json(F.array("text")).alias("listed"), F.octet_length("text").alias("size"))
    # Without [" and "].
    escaped = F.substring(F.col("listed").cast("binary"), F.lit(3), F.octet_length("listed") - 4).cast("string")
    record = F.concat(
        F.lit('{"CommandLine":"'),
        F.repeat("escaped", F.lit(40)),
        F.lit('","HostName":"h","note":"'),
        F.repeat("escaped", F.when(F.col("doc_id") % 2 == 0, 200).otherwise(0)),
        F.lit('"}'),
    )
    return listed.select("doc_id", escaped.alias("escaped"), "size").select("doc_id", record.alias("record"), "size")


def indicators(spark: SparkSession, folder: str) -> DataFrame:
    """Indicator table: every supplier names one indicator of each of the seven types."""
    key = F.col("s_suppkey").cast("string")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    return t.table(spark, folder, "supplier").select(
        F.inline(
            F.array(
                pair("IP", F.concat(F.lit("10.1.0."), key)),
                pair("Username", F.concat(F.lit("user"), key)),
                pair("Hostname", F.concat(F.lit("host"), (3 * F.col("s_suppkey")).cast("string"))),
                pair("Port", (440 + F.col("s_suppkey") % 8).cast("string")),
                pair("EventID", (4600 + F.col("s_suppkey") % 70).cast("string")),
                pair("ProcessName", F.concat(F.lit("C:\\tools\\p"), key, F.lit(".exe"))),
                pair("FileHash", F.md5(F.concat(F.lit("host"), key).cast("binary"))),
            )
        )
    )


def arrivals(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """The events in four parts by number, whatever their time: where a stream reads, and the parts."""
    path = scratch_path(spark, "arrivals")
    events = t.table(spark, folder, "events")
    parts = []
    for k in range(4):
        parts.append(f"{path}/part-{k}")
        events.filter(F.col("event_id") % 4 == k).write.parquet(parts[-1])
    return f"{path}/stream", parts


#: Bytes of a row group of an arrival, before compression: what one task holds at least.
ARRIVAL_BLOCK = 8 << 20


def arrive(spark: SparkSession, part: str, stream: str) -> None:
    """Append a part to what the stream reads, as one file; a part is one micro-batch.

    Its row groups are small, so that many tasks read the file.
    """
    rows = spark.read.parquet(part).coalesce(1)
    rows.write.mode("append").option("parquet.block.size", ARRIVAL_BLOCK).parquet(stream)


def arrival_stream(spark: SparkSession, stream: str) -> DataFrame:
    schema = spark.read.parquet(stream).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(stream)
