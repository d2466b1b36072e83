"""Every registered query: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.functions import columns as c
from wardlight.operators import anomaly, correlate, graph, ingest, kpi, ledger, normalize, rules, search
from wardlight.plans import samples as x
from wardlight.plans.samples import AS_OF, END, START, WHOLE
from wardlight.session import local_table, scratch_path
from wardlight.sources import evidence, files, retention, sinks
from wardlight.sources import telemetry as t
from wardlight.streaming import jobs, state, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: x.plain(fn(spark, folder))
    return fn


# Column lists used by several queries.
EVENT_KEYS = ["EventRecordID", "TimeGenerated", "HostName", "EventID"]
HOUR = 3_600_000


# -- ingest -----------------------------------------------------------------


@query
def scan_drop(spark, folder):
    path = scratch_path(spark, "drop")
    t.table(spark, folder, "documents").select("text").write.text(path)
    return files.scan_drop(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query
def normalize_long_messages(spark, folder):
    """Whole documents as messages without a record id of their own."""
    raw = t.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit("syslog:x:0").alias("provenance_tag"),
        F.to_json(F.struct(F.col("text").alias("message"))).alias("payload"),
        F.lit("2024-01-01").cast("timestamp").alias("received_at"),
    )
    return normalize.normalize_events(raw).groupBy("EventRecordID").agg(F.count("*").alias("n"))


@query
def parse_evidence_csv(spark, folder):
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    docs = t.table(spark, folder, "documents").select(
        F.format_string("doc-%d.csv", "doc_id").alias("file"),
        F.lit("csv").alias("ext"),
        F.concat(F.lit("message,k\r\n"), quoted, F.lit(","), F.col("doc_id").cast("string"), F.lit("\r\n")).alias("content"),
    )
    fields = F.from_json("record", "message string, k string")
    parsed = files.parse_evidence(docs).withColumn("r", fields)
    return parsed.select("file", "position", "r.message", F.col("r.k").cast("bigint").alias("k"))


@query
def parse_evidence(spark, folder):
    parsed = files.parse_evidence(x.text_files(spark, folder))
    fields = F.from_json("record", "message string, k int")
    return parsed.select("file", "position", fields.alias("r")).select("file", "position", "r.message", "r.k")


@query
def evidence_arrays(spark, folder):
    """Documents as JSON arrays, one a file, lexed by many tasks."""
    path = scratch_path(spark, "evidence")
    docs = t.table(spark, folder, "documents")
    x.write_json_arrays(docs.select(F.col("text").alias("message"), F.col("doc_id").alias("k"), F.struct("lang", "source").alias("of")), path)
    records, _ = evidence.read_evidence(spark, path)
    fields = F.from_json("record", "message string, k bigint, of struct<lang string, source string>")
    return records.select(fields.alias("r")).select("r.message", "r.k", "r.of.lang", "r.of.source")


@query
def evidence_csv(spark, folder):
    """Documents as CSV files with quoted line breaks, lexed by many tasks."""
    path = scratch_path(spark, "evidence")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    docs = t.table(spark, folder, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted, "lang").alias("row"))
    x.write_with_header(docs, "k,message,lang", path)
    records, _ = evidence.read_evidence(spark, path)
    fields = F.from_json("record", "message string, k string, lang string")
    return records.select(fields.alias("r")).select("r.message", F.col("r.k").cast("bigint").alias("k"), "r.lang")


@query
def evidence_logs(spark, folder):
    """Documents as log files, JSON lines and an array under a log's name; positions within the files."""
    path = scratch_path(spark, "evidence")
    docs = t.table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    docs.filter("doc_id % 3 = 0").select("text").write.text(f"{path}/plain")
    objects = docs.filter("doc_id % 3 = 1").select(F.col("text").alias("message"))
    objects.select(F.explode(F.array(F.to_json(F.struct("message")), F.lit("not an object"))).alias("value")).write.text(f"{path}/objects")
    x.write_json_arrays(docs.filter("doc_id % 3 = 2").select(F.col("text").alias("message")), f"{path}/arrays", ".log")
    records, verdicts = evidence.read_evidence(spark, path)
    kept = records.join(verdicts.filter("verdict = 'accepted'"), "file")
    numbers = kept.groupBy("file").agg((F.max("position") + 1 - F.countDistinct("position")).alias("gaps"))
    message = F.get_json_object("record", "$.message")
    return kept.join(numbers, "file").groupBy(message.alias("message")).agg(F.count("*").alias("n"), F.max("gaps").alias("gaps"))


@query
def tag_provenance(spark, folder):
    src = c.source_type(F.col("provenance_tag"))
    tagged = ingest.tag_provenance(x.raw(spark, folder), src, F.lit("http"))
    return tagged.select("id", "provenance_tag", "ingest_time")


@query
def union_sources(spark, folder):
    events = x.sec(spark, folder)
    parts = [
        events.filter(F.col("SourceType") == "wef").select(*EVENT_KEYS, "LogonType"),
        events.filter(F.col("SourceType") == "syslog").select(*EVENT_KEYS),
        events.filter(F.col("SourceType") == "netflow").select(*EVENT_KEYS, "DstPort"),
        events.filter(F.col("SourceType") == "forensic").select(*EVENT_KEYS),
    ]
    return ingest.union_sources(*parts)


@query
def route_events(spark, folder):
    marked = x.sec(spark, folder).select(
        "EventRecordID",
        F.when(F.col("SourceType") != "forensic", F.col("ProvenanceTag")).alias("provenance_tag"),
        F.when(F.col("DstPort") == 53, F.lit(True)).alias("flood_detected"),
    )
    return ingest.route_events(marked).select("EventRecordID", "route")


@query
def size_gate(spark, folder):
    pages = t.table(spark, folder, "documents").select("doc_id", F.col("text").alias("payload"))
    return ingest.size_gate(pages, limit=4096).select("doc_id", "event_bytes", "accepted")


@query
def rate_limit(spark, folder):
    kept = ingest.rate_limit(x.raw(spark, folder), limit=3, window="1 hour")
    return kept.select("id", "provenance_tag", "received_at")


@query
def flood_heuristic(spark, folder):
    return ingest.flood_heuristic(x.raw(spark, folder), 1, window=3600).drop("Detail")


@query
def flood_heuristic_sliding(spark, folder):
    return ingest.flood_heuristic(x.raw(spark, folder), 2, window=3600, slide=900).drop("Detail")


@query
def decompression_gate(spark, folder):
    judged = files.decompression_gate(x.archives(spark, folder), cap=2.0)
    return judged.select("file", F.col("expanded"), "verdict")


@query
def utf8_gate(spark, folder):
    return files.utf8_gate(x.binary_files(spark, folder)).select("file", "verdict")


@query
def upload_summary(spark, folder):
    """Uploads in which some records, or all of a file, cannot be mapped."""
    rows = x.uploads(spark, folder)
    number = F.split_part("row_id", F.lit(":"), F.lit(4)).cast("long")
    wrong = (number % 5 == 1) & (F.split_part("file", F.lit("."), F.lit(1)) != "host7") | F.col("file").isin("host3.jsonl", "host12.jsonl")
    mapped = normalize.map_upload(rows.filter(~wrong))
    return files.upload_summary(rows.select("file").distinct(), mapped, rows.filter(wrong).select("file"))


@query
def upload_cuts(spark, folder):
    """Uploads with values beyond the bounds of a field and of the unmapped rest."""
    docs = x.spread(t.table(spark, folder, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    written = x.long_records(docs)
    rows = written.select(
        "doc_id",
        normalize.parse_fields(F.col("record")).alias("fields"),
        F.lit("manual-upload:x:0").alias("ProvenanceTag"),
        F.lit(AS_OF).cast("timestamp").alias("IngestTimestamp"),
        "size",
    )
    mapped = normalize.map_upload(rows)
    return mapped.select(
        "doc_id",
        "was_cut",
        (F.octet_length("CommandLine") <= normalize.FIELD_BYTES).alias("field_fits"),
        (F.octet_length("UnmappedFields") <= normalize.UNMAPPED_BYTES).alias("rest_fits"),
        F.try_parse_json("UnmappedFields").isNotNull().alias("rest_reads"),
    )


@query
def overlap_pull(spark, folder):
    events = x.sec(spark, folder)
    middle = "2024-01-15 00:00:00"
    first = ingest.overlap_pull(events, "2024-01-01 00:05:00", middle)
    second = ingest.overlap_pull(events, middle, "2024-02-01 00:00:00")
    return normalize.dedup_events(first.unionByName(second)).select(*EVENT_KEYS)


@query
def pull_slices(spark, folder):
    return ingest.pull_slices(x.sec(spark, folder), rows_per_query=4, step="6 hours")


@query
def stream_drop(spark, folder):
    path = scratch_path(spark, "drop")
    t.table(spark, folder, "documents").select("text").write.text(path)
    found = jobs.run_available(files.stream_drop(spark, path), "drop")
    return found.groupBy("line").agg(F.count("*").alias("n"))


@query
def event_store(spark, folder):
    """Events streamed to the store in two runs, its first month compacted between them and after."""
    path = scratch_path(spark, "store")
    stream, folders = x.arrivals(spark, folder)
    for part in folders:
        x.arrive(spark, part, stream)
        store.stream_events(t.as_security_events(x.arrival_stream(spark, stream)), path)
        store.compact(spark, path, 202402)
    return store.read_store(spark, path).select(*EVENT_KEYS)


@query
def stream_late(spark, folder):
    """Of four arrivals in any order of time: what came behind the watermark, and what did not."""
    stream, folders = x.arrivals(spark, folder)
    for part in folders:
        x.arrive(spark, part, stream)
    events = t.as_security_events(x.arrival_stream(spark, stream))
    late, counts = jobs.late_rows(events, "TimeGenerated", "10 days")
    kept = jobs.run_available(jobs.stream_dedup(events, lateness="10 days").select("EventRecordID", "SourceType"), "kept")
    both = late.select("SourceType", F.lit(True).alias("late")).unionByName(kept.select("SourceType", F.lit(False).alias("late")))
    return both.groupBy("SourceType", "late").agg(F.count("*").alias("events"))


@query
def stream_fanout(spark, folder):
    events = t.as_security_events(_stream(spark, folder))
    steps = jobs.run_available(jobs.stream_fanout(events, "SubjectUserName", "DstIpAddr", "1 hour"), "fanout")
    return jobs.fanout_windows(steps, 2, "1 day")


@query
def write_events(spark, folder):
    path = scratch_path(spark, "events")
    sinks.write_events(x.sec(spark, folder), path)
    return (
        sinks.read_events(spark, path)
        .groupBy("event_month", "HostName")
        .agg(F.count("*").alias("events"), F.max("TimeGenerated").alias("last_event"))
        .select(F.col("event_month").cast("int").alias("event_month"), "HostName", "events", "last_event")
    )


@query
def write_health(spark, folder):
    path = scratch_path(spark, "health")
    records = x.health(spark, folder)
    sinks.write_health(records, path)
    return (
        spark.read.schema(records.schema)
        .json(path)
        .groupBy("EventType", "Severity")
        .agg(F.count("*").alias("records"), F.sum("EventCount").alias("event_count"))
    )


@query
def export_csv(spark, folder):
    return sinks.csv_rows(x.sec(spark, folder))


@query
def export_json(spark, folder):
    path = scratch_path(spark, "export")
    sinks.export_json(x.sec(spark, folder), path)
    return spark.read.schema(
        "EventRecordID string, HostName string, EventID long, SrcIpAddr string, UnmappedFields string"
    ).json(f"{path}/events")


# -- normalisation ----------------------------------------------------------

NORMAL_COLUMNS = [n for n in s.CANONICAL_COLUMNS if n != "UnmappedFields"]


@query
def normalize_events(spark, folder):
    out = normalize.normalize_events(x.raw(spark, folder))
    extra = F.get_json_object("UnmappedFields", "$.k").cast("int").alias("extra_k")
    return out.select(*NORMAL_COLUMNS, extra)


@query
def coerce_ints(spark, folder):
    k = F.col("SampleKey")
    texts = x.sec(spark, folder).select(
        "EventRecordID",
        F.when(k % 5 == 0, F.concat(F.lit(" "), F.col("EventID").cast("string"), F.lit(" ")))
        .when(k % 5 == 1, F.concat(F.lit("id"), k.cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("-"), k.cast("string")))
        .when(k % 5 == 3, F.lit("4294967296"))
        .otherwise(F.concat(k.cast("string"), F.lit(".7")))
        .alias("text"),
        ((k - 50) * 2000).cast("string").alias("wide"),
    )
    return texts.select(
        "EventRecordID",
        c.event_id(F.col("text")).alias("event_id"),
        c.port(F.col("wide")).alias("port"),
        c.logon_type(F.col("wide")).alias("logon_type"),
    )


@query
def parse_hashes(spark, folder):
    number = F.split_part("EventRecordID", F.lit(":"), F.lit(4))
    md5, sha = F.md5(number.cast("binary")), F.sha2(number, 256)
    k = F.col("SampleKey")
    rows = x.sec(spark, folder).select(
        "EventRecordID",
        F.when(k % 4 == 0, F.concat(F.lit("MD5="), F.upper(md5), F.lit(", SHA256="), F.upper(sha)))
        .when(k % 4 == 1, F.concat(F.lit("sha256="), sha, F.lit("00ff")))
        .when(k % 4 == 2, F.concat(F.lit("MD5=00,IMPHASH=1,MD5="), md5))
        .otherwise("")
        .alias("hashes"),
    )
    return rows.select(
        "EventRecordID",
        c.listed_hash(F.col("hashes"), "MD5", 32).alias("md5"),
        c.listed_hash(F.col("hashes"), "SHA256", 64).alias("sha256"),
    )


@query
def extract_unmapped(spark, folder):
    rest = normalize.unmapped_json(
        normalize.parse_fields(F.col("payload")),
        normalize.MAPPED_KEYS["wef"] + ["record_id"],
    )
    parsed = x.raw(spark, folder).select("id", rest.alias("rest"))
    return parsed.select(
        "id",
        (F.col("rest") == "").alias("nothing_left"),
        F.get_json_object("rest", "$.k").cast("int").alias("k"),
        F.get_json_object("rest", "$.bytes").cast("int").alias("bytes"),
        F.get_json_object("rest", "$.message").alias("message"),
    )


@query
def stable_record_id(spark, folder):
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), "value_text"))
    rows = t.table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("event_id").cast("string")).alias("source_id"),
        F.concat_ws(": ", "event_type", F.col("value").cast("string")).alias("value_text"),
        "event_type",
        "user_id",
    )
    return rows.select(
        "event_id", normalize.stable_record_id(F.lit("wef:x:0"), F.col("source_id"), payload).alias("record_id")
    )


@query
def dedup_events(spark, folder):
    events = x.sec(spark, folder)
    again = events.withColumn("IngestTimestamp", F.col("IngestTimestamp") + F.expr("interval 5 minutes"))
    return normalize.dedup_events(again.unionByName(events)).select(*EVENT_KEYS, "IngestTimestamp")


@query
def map_upload(spark, folder):
    mapped = normalize.map_upload(x.uploads(spark, folder))
    return mapped.select(
        "row_id",
        "HostName",
        "EventID",
        "SrcPort",
        "DstPort",
        "ServiceName",
        "TimeGenerated",
        "ProvenanceTag",
        "had_unmapped",
        F.get_json_object("UnmappedFields", "$.extra").cast("int").alias("extra"),
    )


@query
def classify_events(spark, folder):
    return normalize.classify_events(x.sec(spark, folder)).select("EventRecordID", "EventClass", "OutputTable")


@query
def project_asim(spark, folder):
    return normalize.project_asim(normalize.classify_events(x.sec(spark, folder)), "ASimAuthentication")


@query
def project_output(spark, folder):
    out = normalize.project_output(normalize.classify_events(x.sec(spark, folder)))
    return out.groupBy("OutputTable", "accepted").agg(F.count("*").alias("events"))


@query
def unwrap_nested(spark, folder):
    system = F.struct(
        F.struct(F.lit("Security-Auditing").alias("Name"), F.lit("{1}").alias("Guid")).alias("Provider"),
        "EventID",
        F.col("ChannelName").alias("Channel"),
        F.col("HostName").alias("Computer"),
        F.struct(F.date_format("TimeGenerated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("SystemTime")).alias(
            "TimeCreated"
        ),
    )
    data = F.struct(
        "TargetUserName",
        "ServiceName",
        F.concat(F.lit("::ffff:"), F.col("SrcIpAddr")).alias("IpAddress"),
        F.col("DstPort").cast("string").alias("IpPort"),
        F.col("ProcessImagePath").alias("SourceImage"),
    )
    raw = x.sec(spark, folder).select(
        F.col("EventRecordID").alias("id"),
        F.lit("wef:x:0").alias("provenance_tag"),
        F.to_json(
            F.struct(
                system.alias("System"),
                data.alias("EventData"),
                F.lit("forged").alias("_x_provenance"),
                F.col("EventRecordID").alias("EventRecordID"),
            )
        ).alias("payload"),
        F.col("IngestTimestamp").alias("received_at"),
    )
    return normalize.normalize_events(raw, nested=True).select(
        "EventRecordID",
        "TimeGenerated",
        "HostName",
        "EventID",
        "ChannelName",
        "ProviderName",
        "TargetUserName",
        "ServiceName",
        "ProcessImagePath",
        "SrcIpAddr",
        "SrcPort",
        "UnmappedFields",
    )


@query
def promote_fields(spark, folder):
    k = F.col("SampleKey")
    nested = F.to_json(
        F.struct(
            F.when(F.col("EventID") == 4769, F.when(k % 2 == 0, "0x17").otherwise("0x12")).alias(
                "TicketEncryptionType"
            ),
            F.when(F.col("EventID") == 4768, (k % 3).cast("string")).alias("PreAuthType"),
            F.when(F.col("EventID") == 10, F.col("TargetImage")).alias("TargetImage"),
        )
    )
    events = x.sec(spark, folder).withColumn("UnmappedFields", nested).drop("TargetImage")
    return normalize.promote_fields(events).select("EventRecordID", *normalize.PROMOTED)


@query
def decode_base64(spark, folder):
    line = F.concat(F.lit("run -enc "), F.base64(F.encode(F.concat(F.col("text"), F.lit(" -- end of line --")), "UTF-8")), F.lit(" next "), F.base64(F.encode(F.concat(F.lit("second run of "), F.col("doc_id").cast("string")), "UTF-8")))
    docs = t.table(spark, folder, "documents").select("doc_id", line.alias("CommandLine"))
    return normalize.decode_base64(docs).select("doc_id", F.sha2("DecodedText", 256).alias("decoded_sha"))


@query
def display_times(spark, folder):
    return x.sec(spark, folder).select(
        "EventRecordID",
        c.display_time(F.col("TimeGenerated"), "+02:00").alias("event_time"),
        c.display_time(F.when(F.col("DstPort") == 445, F.col("IngestTimestamp")), "-05:30").alias("ingest_time"),
    )


# -- search -----------------------------------------------------------------


@query
def list_events(spark, folder):
    rows = search.list_events(x.sec(spark, folder), START, END, event_id=4769)
    return search.newest_page(rows, 1000).select(*EVENT_KEYS)


@query
def list_events_count(spark, folder):
    rows = search.list_events(x.sec(spark, folder), START, END, event_id=4769)
    return rows.agg(F.count("*").alias("total"))


def _search(spark, folder, kind, value):
    return search.search(x.sec(spark, folder), kind, value, START, END).select(*EVENT_KEYS)


@query
def search_ip(spark, folder):
    return _search(spark, folder, "IP", "127.0.0.1")


@query
def search_user(spark, folder):
    return _search(spark, folder, "Username", "user8")


@query
def search_host(spark, folder):
    return _search(spark, folder, "Hostname", "host7")


@query
def search_port(spark, folder):
    return _search(spark, folder, "Port", "3389")


@query
def search_eventid(spark, folder):
    return _search(spark, folder, "EventID", "4662")


@query
def search_process(spark, folder):
    return _search(spark, folder, "ProcessName", "C:\\tools\\p1")


@query
def search_hash(spark, folder):
    hashed = x.sec(spark, folder).withColumn("FileMD5", F.md5(F.col("HostName").cast("binary")))
    # In upper case, as an analyst may paste it.
    digest = hashlib.md5(b"host7").hexdigest().upper()
    return search.search(hashed, "FileHash", digest, START, END).select(*EVENT_KEYS)


@query
def search_incident(spark, folder):
    rows = search.search(x.incident_events(spark, folder), "EventID", "4769", START, END, incident_id="host3")
    return rows.select(*EVENT_KEYS)


@query
def ioc_match(spark, folder):
    return search.ioc_match(_hashed(x.sec(spark, folder)), x.indicators(spark, folder), ["EventRecordID"])


def _hashed(events: DataFrame) -> DataFrame:
    return events.withColumn("FileMD5", F.md5(F.col("HostName").cast("binary")))


@query
def ioc_counts(spark, folder):
    return search.ioc_counts(_hashed(x.sec(spark, folder)), x.indicators(spark, folder))


@query
def category_events(spark, folder):
    return search.category_events(x.sec(spark, folder), ["EventRecordID"])


@query
def category_counts(spark, folder):
    return search.category_counts(x.sec(spark, folder))


@query
def category_page(spark, folder):
    return search.category_page(x.sec(spark, folder), "network-analysis", offset=500).select(*EVENT_KEYS)


@query
def list_detections(spark, folder):
    rows = search.list_detections(x.hits(spark, folder), severity="high", forwarded=True, start=START, end=END)
    return rows.select("hit_id", "rule_id", "hit_count", "severity", "created_at", "forwarded_at")


@query
def hunt_recent(spark, folder):
    return search.hunt_recent(x.sec(spark, folder), AS_OF, "30 days")


@query
def hunt_top_rules(spark, folder):
    return search.hunt_top_rules(x.hits(spark, folder), AS_OF, WHOLE)


@query
def hunt_by_source(spark, folder):
    return search.hunt_by_source(x.sec(spark, folder), AS_OF, WHOLE)


@query
def hunt_anomaly(spark, folder):
    return search.hunt_anomaly(x.hits(spark, folder))


@query
def hunt_kerberoast(spark, folder):
    return search.hunt_kerberoast(x.sec(spark, folder))


@query
def hunt_unforwarded(spark, folder):
    return search.hunt_unforwarded(x.hits(spark, folder))


@query
def adhoc_sql(spark, folder):
    return search.adhoc_sql(
        spark,
        {"security_events": x.sec(spark, folder)},
        "SELECT HostName, EventID, count(*) AS n FROM security_events "
        "WHERE DstPort = :port GROUP BY HostName, EventID",
        {"port": 445},
    )


@query
def list_incidents(spark, folder):
    opened = ledger.incidents(x.hits(spark, folder)).select(
        F.col("fingerprint").alias("incident_id"),
        F.col("title").alias("name"),
        "severity",
        "status",
        F.col("hit_count").alias("event_count"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
    listed = ledger.list_incidents(opened, status="open", name_like="AD-003", sort_by="severity")
    return listed.select("incident_id", "name", "severity", "event_count", "created_at")


@query
def entity_events(spark, folder):
    return search.entity_events(x.sec(spark, folder), "user15").select(*EVENT_KEYS)


@query
def cidr_match(spark, folder):
    return search.cidr_match(x.sec(spark, folder), ["10.1.0.0/26", "10.9.0.8/29"]).select(
        "EventRecordID", "SrcIpAddr", "DstIpAddr"
    )


@query
def cidr_table_match(spark, folder):
    nets = t.table(spark, folder, "nation").select(
        F.concat(
            F.lit("10."),
            (F.col("n_nationkey") % 4).cast("string"),
            F.lit(".0."),
            (F.floor(F.col("n_nationkey") / 4) * 8).cast("string"),
            F.lit("/"),
            (F.lit(29) - F.col("n_regionkey")).cast("string"),
        ).alias("cidr")
    )
    nets = nets.unionAll(local_table(spark, [("0.0.0.0/0",), ("2001:db8::/32",)], "cidr string"))
    return search.cidr_table_match(x.sec(spark, folder), nets)


# -- rules ------------------------------------------------------------------


@query
def detect_rules(spark, folder):
    found = x.matches(spark, folder)
    return found.groupBy("rule_id", F.window("TimeGenerated", "15 minutes").start.alias("window_start")).agg(
        F.count("*").alias("matches")
    )


def _rule(number: int):
    def run(spark, folder):
        return rules.rule_matches(x.sec(spark, folder), rules.AD_RULES[number - 1], EVENT_KEYS)

    run.__name__ = f"rule_ad_{number:03d}"
    return query(run)


for _number in range(1, 7):
    _rule(_number)


@query
def rules_precise(spark, folder):
    k = F.col("SampleKey")
    promoted = x.sec(spark, folder).withColumns(
        {
            "TicketEncryptionType": F.when(k % 2 == 0, "0x17").otherwise("0x12"),
            "PreAuthType": (k % 3).cast("string"),
        }
    )
    return rules.detect_rules(promoted, rules.PRECISE_RULES, keep=["EventRecordID"])


@query
def self_rules(spark, folder):
    audit = ledger.rule_audit(x.rule_changes(spark, folder)).select("TimeGenerated", "EventType", "Detail")
    at = F.lit(AS_OF).cast("timestamp")
    judged = files.decompression_gate(x.archives(spark, folder), cap=2.0)
    trips = files.decompression_health(judged, at).select("TimeGenerated", "EventType", "Detail")
    lost = ledger.ledger_delta_records(reconcile_counts(spark, folder), at).select("TimeGenerated", "EventType", "Detail")
    health = x.health(spark, folder).select("TimeGenerated", "EventType", "Detail")
    return rules.self_rules(ingest.union_sources(health, audit, trips, lost))


@query
def detection_hits(spark, folder):
    built = rules.build_hits(x.matches(spark, folder), rules.rules_table(spark, rules.AD_RULES))
    return built.select(
        "hit_id",
        "rule_id",
        "rule_version",
        "batch_start",
        "batch_end",
        F.array_join("event_record_ids", ",").alias("event_record_ids"),
        "hit_count",
        "level",
        "severity",
        "mitre_tag",
        "created_at",
    )


@query
def detection_hits_chunked(spark, folder):
    """The same windows with tiny chunks: counts and ids must stay whole."""
    chunks = rules.evidence_chunks(x.matches(spark, folder), "1 day", chunk_ids=5)
    return chunks.groupBy("rule_id", "batch_start", "chunks").agg(
        F.sum("n").alias("hit_count"), F.sum(F.size("ids")).alias("ids")
    )


@query
def threshold_tumbling(spark, folder):
    return correlate.threshold_tumbling(x.sec(spark, folder), "SubjectUserName", 2, "60 minutes")


@query
def threshold_sliding(spark, folder):
    return correlate.threshold_sliding(x.sec(spark, folder), "SubjectUserName", 2, 3600, 600)


@query
def threshold_exact(spark, folder):
    return correlate.threshold_exact(x.sec(spark, folder), "SubjectUserName", 2, HOUR)


@query
def sequence_next(spark, folder):
    first, second = F.col("EventID") == 4768, F.col("EventID") == 4769
    return correlate.sequence_next(x.sec(spark, folder), first, second, "SubjectUserName", 6 * HOUR)


@query
def sequence_diff_host(spark, folder):
    logon = F.col("EventID") == 4624
    return correlate.sequence_diff_host(x.sec(spark, folder), logon, "TargetUserName", HOUR)


@query
def fanout(spark, folder):
    return correlate.fanout(x.sec(spark, folder), "SubjectUserName", "DstIpAddr", 3, "1 day")


@query
def entity_state(spark, folder):
    first = F.col("EventID") == 4624
    return correlate.entity_state(x.sec(spark, folder), first, "second-logon", "TargetUserName", HOUR)


@query
def rule_fixture_check(spark, folder):
    """All events, each labelled with the rule of its event id."""
    e, logon = F.col("EventID"), F.col("LogonType")
    rule = (
        F.when(e == 4769, "windows-ad-001")
        .when(e == 4768, "windows-ad-002")
        .when(e == 4662, "windows-ad-003")
        .when(e == 10, "windows-ad-004")
        .when((e == 4624) & (logon == 3), "windows-ad-005")
        .when((e == 4624) & (logon == 10), "windows-ad-006")
    )
    k = F.col("SampleKey")
    person = k % 5 != 0
    expected = (
        F.when(e == 4769, k % 3 != 0)
        .when(e == 4768, person)
        .when(e == 4662, (k % 2 == 0) & ~F.col("SubjectUserName").endswith("$"))
        .when(e == 10, (k % 3 != 0) & (k % 4 != 2) & (k % 10 != 0))
        .when(logon == 3, person)
        .otherwise(person & (k % 50 != 0))
    )
    labelled = x.sec(spark, folder).withColumns({"rule_id": rule, "expected": expected})
    return rules.rule_fixture_check(labelled.filter(F.col("rule_id").isNotNull()))


@query
def rule_dry_run(spark, folder):
    return rules.rule_dry_run(x.sec(spark, folder), rules.AD_RULES[0], START, END)


@query
def rule_coverage(spark, folder):
    # A rule for an event that no source sends stays silent.
    planned = {**rules.AD_RULES[0], "id": "planned-001", "title": "Planned"}
    listed = rules.rules_table(spark, [*rules.AD_RULES, planned])
    return rules.rule_coverage(listed, x.matches(spark, folder))


@query
def telemetry_gaps(spark, folder):
    needs = {**rules.RULE_TELEMETRY, "planned-001": [("Security", 4625)], "planned-002": [("Security", 10)]}
    return rules.telemetry_gaps(x.sec(spark, folder), needs)


# -- correlation, ledgers -----------------------------------------------------


@query
def lateral_movement(spark, folder):
    return correlate.lateral_movement(x.sec(spark, folder), 12 * HOUR)


@query
def new_source(spark, folder):
    return correlate.new_source(x.sec(spark, folder), AS_OF, recent="3 days")


@query
def new_source_days(spark, folder):
    return correlate.new_source_days(x.sec(spark, folder), "SubjectUserName", baseline_days=7)


@query
def pending_batches(spark, folder):
    return ledger.pending_batches(x.hits(spark, folder))


@query
def delivery_marking(spark, folder):
    """What waits after the first two batches of five have been delivered and marked."""
    hits = x.hits(spark, folder)
    sent = ledger.pending_batches(hits, 5).filter("batch_no < 2").select("hit_id")
    return ledger.pending_batches(ledger.undelivered(hits, sent), 5)


@query
def new_evidence(spark, folder):
    """Matches of the second half of the month that a run a day longer has not seen."""
    events = x.sec(spark, folder)
    earlier = rules.detect_rules(events, rules.AD_RULES, START, "2024-01-17 00:00:00")
    matches = rules.detect_rules(events, rules.AD_RULES, "2024-01-16 00:00:00", END)
    return ledger.new_evidence(matches, earlier).select("rule_id", "EventRecordID", "TimeGenerated")


@query
def security_records(spark, folder):
    records = ledger.security_records(x.hits(spark, folder))
    return records.select(
        "TimeGenerated",
        "RuleId",
        "EventType",
        "Severity",
        "ATTACKTechnique",
        F.get_json_object("Detail", "$.hit_id").alias("hit_id"),
        F.get_json_object("Detail", "$.batch_start").alias("batch_start"),
        F.get_json_object("Detail", "$.hit_count").cast("bigint").alias("hit_count"),
        F.size(F.from_json("SourceEventIds", "array<string>")).cast("bigint").alias("source_ids"),
    )


@query
def incidents(spark, folder):
    return ledger.incidents(x.hits(spark, folder)).select(
        "fingerprint", "title", "severity", "rule_id", "hit_count", "mitre_tag", "created_at"
    )


@query
def incidents_known(spark, folder):
    """The second half of the month: incidents opened a day before are skipped."""
    hits = x.hits(spark, folder)
    opened = ledger.incidents(hits).filter(F.col("hit_count") > 1).select("fingerprint", "created_at")
    return ledger.incidents(hits, opened).select("fingerprint", "rule_id", "created_at")


@query
def incident_evidence(spark, folder):
    return ledger.incident_evidence(x.incident_list(spark, folder), x.incident_events(spark, folder))


@query
def enrich_event_desc(spark, folder):
    return ledger.enrich_event_desc(x.sec(spark, folder)).select("EventRecordID", "EventID", "EventDescription")


@query
def reconcile_counts(spark, folder):
    sent = x.sent(spark, folder).withColumn("batch_id", F.substring("batch_id", 1, 6))
    keys = ["batch_id", "stream_tag"]
    local = sent.groupBy(*keys).agg(F.count("*").alias("event_count"))
    received = sent.filter("DstPort <> 445").groupBy(*keys).agg(F.count("*").alias("event_count"))
    return ledger.reconcile_counts(local, received)


@query
def reconcile_stages(spark, folder):
    accepted = x.raw(spark, folder).withColumnRenamed("id", "EventRecordID")
    stored = x.sec(spark, folder).filter("DstPort <> 53")
    return ledger.reconcile_stages(accepted, stored)


@query
def latest_rule_state(spark, folder):
    return ledger.latest_rule_state(x.rule_changes(spark, folder))


@query
def active_rules(spark, folder):
    return ledger.active_rules(x.rule_changes(spark, folder))


@query
def forwardable_hits(spark, folder):
    """Hits of rules whose latest state, from any event of their users, is production."""
    live = F.col("event_type").isin("purchase", "view", "click")
    states = ledger.latest_rule_state(
        t.table(spark, folder, "events").select(
            F.concat(F.lit("windows-ad-00"), (F.col("user_id") % 6 + 1).cast("string")).alias("rule_id"),
            F.when(live, "production").otherwise("disabled").alias("status"),
            F.col("ts").cast("timestamp").alias("updated_at"),
        )
    )
    return ledger.forwardable(x.hits(spark, folder), states).select("hit_id", "rule_id")


@query
def rule_audit(spark, folder):
    return ledger.rule_audit(x.rule_changes(spark, folder)).select(
        "TimeGenerated", "RuleId", "old_status", "new_status", "Severity"
    )


@query
def audit_gaps(spark, folder):
    changes = x.rule_changes(spark, folder)
    audit = ledger.rule_audit(changes).filter("old_status <> 'production'")
    return ledger.audit_gaps(changes, audit)


@query
def forward_ledger(spark, folder):
    return ledger.forward_ledger(x.sent(spark, folder))


@query
def pack_batches(spark, folder):
    rows = x.sec(spark, folder).select(
        "SourceType", "TimeGenerated", "EventRecordID", (F.col("SampleKey") * 100 + 200).cast("bigint").alias("size")
    )
    packed = ledger.pack_batches(
        rows, "SourceType", "size", ["TimeGenerated", "EventRecordID"], max_rows=50, max_bytes=200_000
    )
    return packed.groupBy("SourceType", "batch_key").agg(
        F.count("*").alias("events"), F.sum("size").alias("bytes"), F.min("TimeGenerated").alias("first_event")
    )


@query
def pack_batches_greedy(spark, folder):
    rows = x.sec(spark, folder).select(
        "SourceType", "TimeGenerated", "EventRecordID", (F.col("SampleKey") * 100 + 200).cast("bigint").alias("size")
    )
    packed = ledger.pack_batches_greedy(
        rows, "SourceType", "size", ["TimeGenerated", "EventRecordID"], max_rows=50, max_bytes=200_000
    )
    # A batch may span segments; it is listed under its first.
    batches = packed.groupBy("SourceType", "batch_no").agg(
        F.min("segment").alias("segment"), F.count("*").alias("events"), F.sum("size").alias("bytes")
    )
    return batches.select("SourceType", "segment", "batch_no", "events", "bytes")


@query
def apply_retention(spark, folder):
    return ledger.apply_retention(x.sec(spark, folder), AS_OF).select(*EVENT_KEYS)


@query
def purge_report(spark, folder):
    events = x.sec(spark, folder)
    delivered = events.filter("SourceType <> 'netflow' or DstPort <> 53")
    return ledger.purge_report(events, delivered, "2024-02-20 00:00:00")


@query
def replay_range(spark, folder):
    events = x.sec(spark, folder)
    delivered = events.filter("DstPort <> 445")
    return ledger.replay_range(events, delivered, START, END).select(*EVENT_KEYS)


@query
def replay_ranges(spark, folder):
    """Two ranges of two batches, replayed from an event table partitioned by month."""
    path = scratch_path(spark, "events")
    events = x.sec(spark, folder)
    sinks.write_events(events, path)
    ranges = local_table(
        spark, [("a", "2024-01-03", "2024-01-05"), ("b", "2024-01-04", "2024-01-04"), ("c", "2024-01-04", "2024-01-09")], "batch_id string, s string, e string"
    ).select("batch_id", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    found = ledger.replay_ranges(sinks.read_events(spark, path), events.filter("DstPort <> 445"), ranges)
    return found.select("batch_id", *EVENT_KEYS)


@query
def purge_events(spark, folder):
    """What is left of an event table after its retention has been applied to the files, twice."""
    path = scratch_path(spark, "events")
    sinks.write_events(x.sec(spark, folder), path)
    for _ in range(2):
        retention.purge_events(spark, path, AS_OF)
    return sinks.read_events(spark, path).select(*EVENT_KEYS)


@query
def batch_health(spark, folder):
    return ledger.batch_health(x.outcomes(spark, folder))


# -- figures ------------------------------------------------------------------


@query
def events_by_source(spark, folder):
    return kpi.events_by_source(x.sec(spark, folder), AS_OF, WHOLE)


@query
def hit_kpis(spark, folder):
    return kpi.hit_kpis(x.hits(spark, folder), AS_OF)


@query
def score_histogram(spark, folder):
    return kpi.score_histogram(x.hits(spark, folder), AS_OF, WHOLE)


@query
def hourly_volume(spark, folder):
    return kpi.hourly_volume(x.sec(spark, folder), AS_OF, WHOLE)


@query
def volume_levels(spark, folder):
    return kpi.volume_levels(x.sec(spark, folder), AS_OF, WHOLE)


@query
def hit_timeline(spark, folder):
    return kpi.hit_timeline(x.hits(spark, folder))


@query
def hit_timeline_matrix(spark, folder):
    return kpi.hit_timeline_matrix(x.hits(spark, folder))


@query
def pipeline_latency(spark, folder):
    return kpi.pipeline_latency(x.sec(spark, folder), AS_OF, WHOLE)


@query
def source_stats(spark, folder):
    return kpi.source_stats(x.sec(spark, folder), AS_OF, 720)


@query
def top_rules(spark, folder):
    return kpi.top_rules(x.hits(spark, folder), AS_OF, WHOLE)


@query
def score_percentiles(spark, folder):
    return kpi.score_percentiles(x.hits(spark, folder), AS_OF, WHOLE)


@query
def severity_breakdown(spark, folder):
    return kpi.severity_breakdown(x.hits(spark, folder), AS_OF, WHOLE)


@query
def ledger_totals(spark, folder):
    return kpi.ledger_totals(x.forward_rows(spark, folder), AS_OF, WHOLE)


@query
def stats_bundle(spark, folder):
    bundle = kpi.stats_bundle(
        x.sec(spark, folder), x.hits(spark, folder), x.forward_rows(spark, folder), AS_OF
    )
    fields = F.from_json(
        "entry",
        "SourceType string, stream_tag string, rule_id string, severity string, event_count double, hits double, total double, "
        "max_score double, p95 double, p99 double, last_batch_at timestamp",
    )
    e = bundle.select("section", fields.alias("e")).select("section", "e.*")
    value = F.coalesce("event_count", "hits", "total", "p95", F.unix_seconds("last_batch_at").cast("double"))
    return e.select(
        "section",
        F.concat_ws("|", "SourceType", "stream_tag", "rule_id", "severity").alias("name"),
        value.alias("value"),
        F.coalesce("max_score", "p99").alias("more"),
    )


@query
def rule_rollup(spark, folder):
    return kpi.rule_rollup(x.hits(spark, folder))


@query
def rules_by_status(spark, folder):
    return kpi.rules_by_status(ledger.latest_rule_state(x.rule_changes(spark, folder)))


@query
def health_summary(spark, folder):
    return kpi.health_summary(x.health(spark, folder), AS_OF, WHOLE)


@query
def health_alert(spark, folder):
    failed = x.outcomes(spark, folder).withColumn("batch_id", F.col("hit_id"))
    return kpi.health_alert(ledger.batch_health(failed))


@query
def distinct_entities(spark, folder):
    return kpi.distinct_entities(x.sec(spark, folder), AS_OF, WHOLE)


@query
def pipeline_trend(spark, folder):
    return kpi.pipeline_trend(x.sec(spark, folder))


@query
def late_report(spark, folder):
    return kpi.late_report(x.sec(spark, folder))


# -- anomaly ------------------------------------------------------------------


@query
def entity_features(spark, folder):
    return anomaly.entity_features(x.sec(spark, folder))


@query
def zscore(spark, folder):
    return anomaly.zscore(anomaly.entity_features(x.sec(spark, folder)), ["events", "destinations"])


@query
def forest_scores(spark, folder):
    """Scores by two trees whose cuts are given."""
    forest = local_table(
        spark,
        [
            (0, 0, 0, 100.0, 1, 2, 0.0),
            (0, 1, -1, 0.0, -1, -1, 1.0),
            (0, 2, 1, 30.0, 3, 4, 0.0),
            (0, 3, -1, 0.0, -1, -1, 3.5),
            (0, 4, -1, 0.0, -1, -1, 2.0),
            (1, 0, 1, 50.0, 1, 2, 0.0),
            (1, 1, -1, 0.0, -1, -1, 6.25),
            (1, 2, -1, 0.0, -1, -1, 1.0),
        ],
        "tree int, node int, feature int, cut double, low int, high int, depth_end double",
    )
    events = t.table(spark, folder, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    return anomaly.score_forest(events, ["value", "k"], forest).select("event_id", "anomaly_score")


@query
def isolation_forest(spark, folder):
    scored = anomaly.isolation_forest(anomaly.entity_features(x.sec(spark, folder)))
    return scored.select("kind", "entity", "day", "anomaly_score")


def _simple_scores(spark, folder):
    """A score per entity that can be worked out by hand: its busiest day."""
    features = anomaly.entity_features(x.sec(spark, folder))
    return features.withColumn("anomaly_score", F.round(F.least(F.lit(1.0), F.col("events") / 20.0), 4)).select(
        "kind", "entity", "anomaly_score"
    )


@query
def score_hits(spark, folder):
    found = x.matches(spark, folder)
    built = rules.build_hits(found, rules.rules_table(spark, rules.AD_RULES))
    scored = anomaly.score_hits(built, found, _simple_scores(spark, folder))
    return scored.select("hit_id", "rule_id", "anomaly_score")


@query
def score_hits_batch(spark, folder):
    found = x.matches(spark, folder)
    built = rules.build_hits(found, rules.rules_table(spark, rules.AD_RULES))
    scored = anomaly.score_hits(built, found, _simple_scores(spark, folder), scope="batch")
    return scored.select("hit_id", "rule_id", "anomaly_score")


@query
def advisory_records(spark, folder):
    return anomaly.advisory_records(_simple_scores(spark, folder), AS_OF)


# -- graph --------------------------------------------------------------------


def _graph_rows(spark, folder):
    return graph.graph_slice(x.sec(spark, folder), START, END)


@query
def graph_slice(spark, folder):
    return graph.graph_slice(x.sec(spark, folder), START, END, limit=1000).select(*EVENT_KEYS)


@query
def graph_nodes(spark, folder):
    return graph.graph_nodes(_graph_rows(spark, folder))


@query
def graph_nodes_capped(spark, folder):
    return graph.graph_nodes(_graph_rows(spark, folder), cap=200).select("name", "category")


@query
def graph_edges(spark, folder):
    return graph.graph_edges(_graph_rows(spark, folder))


@query
def graph_khop(spark, folder):
    return graph.graph_khop(graph.graph_edges(_graph_rows(spark, folder)), "user8", hops=2)


# -- streams ------------------------------------------------------------------


def _stream(spark, folder):
    return t.stream_table(spark, folder, "events")


def _normalized_stream(spark, folder):
    return jobs.run_normalize(t.raw_messages(_stream(spark, folder)), "normalize")


@query
def stream_normalize(spark, folder):
    out, _ = _normalized_stream(spark, folder)
    extra = F.get_json_object("UnmappedFields", "$.k").cast("int").alias("extra_k")
    return out.select(*NORMAL_COLUMNS, extra)


@query
def ingest_rejects(spark, folder):
    """Health rows of a stream in which some messages are too large and some are cut short."""
    k = F.pmod(F.split_part("id", F.lit(":"), F.lit(4)).cast("long"), F.lit(10))
    broken = F.when(k == 3, F.repeat(F.lit("x"), 70_000)).when(k == 7, F.lit("{")).when(k == 9, F.lit(None))
    raw = t.raw_messages(_stream(spark, folder))
    raw = raw.withColumn("payload", F.when(k.isin(3, 7, 9), broken).otherwise(F.col("payload")))
    _, rejects = jobs.run_normalize(raw, "rejects")
    return rejects.groupBy("TimeGenerated", "EventType", "Severity", "SourceId").agg(F.sum("EventCount").alias("EventCount"))


@query
def stream_flood(spark, folder):
    flood = jobs.stream_flood(t.raw_messages(_stream(spark, folder)), 1)
    return jobs.run_available(flood, "flood").drop("Detail")


@query
def stream_threshold(spark, folder):
    events = t.as_security_events(_stream(spark, folder))
    return jobs.run_available(
        jobs.stream_threshold(events, "SubjectUserName", 2, "60 minutes", "10 minutes"), "threshold"
    )


@query
def stream_sessions(spark, folder):
    events = t.as_security_events(_stream(spark, folder))
    return jobs.run_available(jobs.stream_sessions(events, "HostName", "30 minutes"), "sessions")


@query
def stream_sequence(spark, folder):
    events = t.as_security_events(_stream(spark, folder))
    first, second = F.col("EventID") == 4768, F.col("EventID") == 4769
    with state.keyed_state(spark):
        return jobs.run_available(jobs.stream_sequence(events, first, second, "SubjectUserName", 6 * HOUR), "sequence")


@query
def entity_state(spark, folder):
    """Partial matches of two rules still open at the end of the stream, read back from its state."""
    stream = t.as_security_events(_stream(spark, folder))
    requested, granted, logon = (F.col("EventID") == n for n in (4768, 4769, 4624))
    rule_set = [
        state.SequenceRule("ticket-use", requested, granted, "SubjectUserName", 6 * HOUR),
        state.SequenceRule("logon-after-request", requested, logon, "HostName", 2 * HOUR),
    ]
    with state.keyed_state(spark):
        _, checkpoint = state.run_with_state(state.sequences(stream, rule_set), "entity-state")
        last = x.sec(spark, folder).filter(requested | granted | logon).agg(F.max("TimeGenerated")).first()[0]
        mark = F.lit(last).cast("timestamp") - F.expr(f"interval {state.LATENESS}")
        held = state.entity_state(spark, checkpoint, mark)
        return held.withColumn("first_id", F.get_json_object("payload", "$.first_id")).drop("payload")


@query
def stream_join(spark, folder):
    logons = t.as_security_events(_stream(spark, folder))
    flows = t.as_security_events(_stream(spark, folder))
    return jobs.run_available(jobs.stream_join(logons, flows, "60 minutes"), "join")


@query
def stream_dedup(spark, folder):
    events = t.as_security_events(_stream(spark, folder))
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run_available(jobs.stream_dedup(twice).select("EventRecordID", "HostName"), "dedup")


@query
def stream_detect(spark, folder):
    events = t.as_security_events(_stream(spark, folder))
    found = jobs.stream_detect(events, rules.AD_RULES, flush=True)
    return found.select("hit_id", "rule_id", "batch_start", "hit_count", "severity")


@query
def stream_rate_limit(spark, folder):
    with state.keyed_state(spark):
        kept = jobs.stream_rate_limit(t.raw_messages(_stream(spark, folder)), 3, "1 hour")
    return kept.select("id", "provenance_tag", "received_at")
