"""Coercion, hashing, ids, unmapped fields, uploads, base64, addresses."""

import datetime as dt
import hashlib
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from wardlight.functions import columns as c
from wardlight.operators import ingest, normalize

AT = dt.datetime(2025, 1, 15, 10, 25)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize(
    "raw,want",
    [("4624", 4624), (" 4624 ", 4624), ("abc", 0), ("-1", 0), ("4294967295", 4294967295), ("4294967296", 0), (None, 0), ("4624.7", 4624), ("9" * 25, 0), ("", 0)],
)
def test_event_id(spark, raw, want):
    assert one(spark, raw, c.event_id) == want


@pytest.mark.parametrize("raw,want", [("-5", 0), ("70000", 65535), ("x", 0), ("445", 445), ("9" * 30, 65535), ("-" + "9" * 30, 0)])
def test_port(spark, raw, want):
    assert one(spark, raw, c.port) == want


def test_logon_type(spark):
    assert [one(spark, x, c.logon_type) for x in ("10", "300", None)] == [10, 255, 0]


@pytest.mark.parametrize(
    "text,md5,sha",
    [
        ("MD5=ABCDEF,SHA256=00FF", "abcdef", "00ff"),
        ("sha256=" + "A" * 70, "", "a" * 64),
        ("MD5=11, md5=22 ,IMPHASH=33", "22", ""),
        ("", "", ""),
        (None, "", ""),
        ("XMD5=11", "", ""),
    ],
)
def test_listed_hash(spark, text, md5, sha):
    assert one(spark, text, lambda x: c.listed_hash(x, "MD5", 32)) == md5
    assert one(spark, text, lambda x: c.listed_hash(x, "SHA256", 64)) == sha


def test_record_id_digest_equals_sorted_json(spark):
    raw = {"b": 'x, y: "q" \\', "a": 1, "n": {"z": [1, 2, {"k": "v: w"}], "c": None}, "t": True, "e": "", "last": "view: 1"}
    want = hashlib.sha256(f"wef:x:{json.dumps(raw, sort_keys=True)}".encode()).hexdigest()
    frame = spark.createDataFrame([(json.dumps(raw),)], "p string")
    got = frame.select(normalize.stable_record_id(F.lit("wef:x"), F.lit(""), F.col("p"))).collect()[0][0]
    assert got == want
    assert frame.select(normalize.stable_record_id(F.lit("wef:x"), F.lit("7"), F.col("p"))).collect()[0][0] == "wef:x:7"


def raw_frame(spark, *rows):
    return spark.createDataFrame(
        [(str(i), tag, text, AT) for i, (tag, text) in enumerate(rows)],
        "id string, provenance_tag string, payload string, received_at timestamp",
    )


def test_dispatch_and_rejects(spark):
    frame = raw_frame(
        spark,
        ("wef:x", '{"EventID": 4624, "Computer": "h", "extra": {"a": [1]}}'),
        ("ipfix:x", '{"src_ip": "1.2.3.4", "proto": 17, "bytes": 9}'),
        ("unknown:x", '{"EventID": "4625"}'),
        ("wef:x", "not json"),
        ("wef:x", "[1, 2]"),
        ("forensic:x", '{"row": 1, "cmdline": "c", "timestamp": "2025-01-15T10:00:00Z"}'),
    )
    rows = {r.ProvenanceTag: r for r in normalize.normalize_events(frame).collect()}
    assert json.loads(rows["wef:x"].UnmappedFields) == {"extra": {"a": [1]}}
    assert (rows["ipfix:x"].NetworkProtocol, rows["ipfix:x"].ChannelName) == ("udp", "Netflow")
    assert json.loads(rows["ipfix:x"].UnmappedFields) == {"bytes": 9}
    assert rows["unknown:x"].EventID == 4625
    assert rows["forensic:x"].TimeGenerated == dt.datetime(2025, 1, 15, 10)
    assert all(v is not None for r in rows.values() for v in r)
    rejects = normalize.normalize_rejects(frame).collect()
    assert sorted(r.id for r in rejects) == ["3", "4"]


def test_unwrap_nested(spark):
    windows = {
        "System": {"Provider": {"Name": "P", "Guid": "{1}"}, "EventID": 4769, "Channel": "Security", "Computer": "dc01", "TimeCreated": {"SystemTime": "2025-01-15T10:23:45.123Z"}},
        "EventData": {"TargetUserName": "svc", "IpAddress": "::ffff:192.168.1.50", "IpPort": "52341", "TicketEncryptionType": "0x17"},
        "_x_provenance": "forged",
        "_x_ingest_ts": "forged",
    }
    listing = {"artifact": "Pslist", "hostname": "w1", "collection_time": "2025-01-15T10:00:00Z", "row": {"Pid": 1, "Exe": "C:\\m.exe", "CommandLine": "m"}}
    frame = raw_frame(spark, ("wef:x", json.dumps(windows)), ("forensic:x", json.dumps(listing)))
    win, row = normalize.normalize_events(frame, nested=True).orderBy("EventID", ascending=False).collect()
    assert (win.HostName, win.EventID, win.ProviderName, win.SrcIpAddr, win.SrcPort) == ("dc01", 4769, "P", "192.168.1.50", 52341)
    assert win.TimeGenerated == dt.datetime(2025, 1, 15, 10, 23, 45, 123000)
    assert json.loads(win.UnmappedFields) == {"TicketEncryptionType": "0x17"}
    assert (row.ProcessImagePath, row.CommandLine, row.HostName) == ("C:\\m.exe", "m", "w1")
    assert row.TimeGenerated == dt.datetime(2025, 1, 15, 10)


def test_upload_mapping(spark):
    record = {
        "EventID": "x", "SrcPort": "99", "HostName": "h", "CommandLine": "é" * 40000, "FileMD5": "ab",
        "ProvenanceTag": "forged", "IngestTimestamp": "forged", "_x_provenance": "forged",
        "UnmappedFields": "mine", "other": 1,
    }
    frame = spark.createDataFrame([(json.dumps(record), AT)], "p string, IngestTimestamp timestamp").select(
        normalize.parse_fields(F.col("p")).alias("fields"),
        "IngestTimestamp",
        ingest.upload_tag(F.lit("case.json"), F.col("IngestTimestamp")).alias("ProvenanceTag"),
    )
    row = normalize.map_upload(frame).collect()[0]
    epoch = int(AT.replace(tzinfo=dt.timezone.utc).timestamp())
    assert row.ProvenanceTag == f"manual-upload:{hashlib.sha256(b'case.json').hexdigest()[:8]}:{epoch}"
    assert (row.EventID, row.SrcPort, row.HostName, row.FileMD5) == (0, 99, "h", "ab")
    assert row.TimeGenerated == AT and row.IngestTimestamp == AT
    assert len(row.CommandLine.encode()) == 65536 and row.had_unmapped
    assert json.loads(row.UnmappedFields) == {"UnmappedFields": "mine", "other": 1}


def test_incident_tag(spark):
    at = F.timestamp_seconds(F.lit(100))
    frame = spark.range(1).select(ingest.upload_tag(F.lit("f"), at, F.lit("i-7")).alias("t"))
    assert frame.collect()[0].t == "manual-upload:incident:i-7:100"


def test_long_message_without_an_id(spark):
    raw = {"message": 'say "x": \\, y\n' * 5000, "hostname": "h"}
    want = hashlib.sha256(f"syslog:x:0:{json.dumps(raw, sort_keys=True)}".encode()).hexdigest()
    frame = spark.createDataFrame([("1", "syslog:x:0", json.dumps(raw))], "id string, provenance_tag string, payload string")
    got = normalize.normalize_events(frame.withColumn("received_at", F.current_timestamp())).collect()
    assert [r.EventRecordID for r in got] == [want] and got[0].HostName == "h"


def test_all_base64_runs_are_decoded(spark):
    import base64

    line = " and ".join(base64.b64encode(x).decode() for x in (b"first thing to run", b"second thing to run"))
    frame = spark.createDataFrame([(line,)], "CommandLine string")
    assert normalize.decode_base64(frame).collect()[0].DecodedText == "first thing to run\nsecond thing to run"


def test_decode_base64(spark):
    import base64

    narrow = "powershell " + base64.b64encode(b"Invoke-Something now").decode()
    wide = "powershell -enc " + base64.b64encode("whoami /all please".encode("utf-16-le")).decode()
    frame = spark.createDataFrame([(narrow,), (wide,), ("plain text",)], "CommandLine string")
    got = [r.DecodedText for r in normalize.decode_base64(frame).collect()]
    assert got == ["Invoke-Something now", "whoami /all please", ""]


@pytest.mark.parametrize("cidr", ["10.1.0.0/26", "10.0.0.0/8", "10.1.0.5/32", "0.0.0.0/0", "172.16.0.0/12", "2001:db8::/33", "::1/128"])
def test_cidr(spark, cidr):
    addresses = ["10.1.0.5", "10.1.0.63", "10.1.0.64", "10.1.0.5.9", "10.1.0.999", "172.31.255.1", "172.32.0.1", "2001:db8:1::7", "2001:db8:8000::7", "::1", "", "host", "::ffff:10.1.0.5", "8.8.8.8"]
    frame = spark.createDataFrame([(a,) for a in addresses], "a string")
    got = {r.a for r in frame.filter(c.in_cidr(F.col("a"), cidr)).collect()}
    net, want = ipaddress.ip_network(cidr), set()
    for a in addresses:
        try:
            address = ipaddress.ip_address(a)
        except ValueError:
            continue
        if address.version == net.version and address in net:
            want.add(a)
    assert got == want


def test_dedup_is_idempotent_and_keeps_the_first(spark, sec):
    again = sec.withColumn("IngestTimestamp", F.col("IngestTimestamp") + F.expr("interval 1 hour"))
    once = normalize.dedup_events(again.unionByName(sec))
    assert once.count() == sec.count() == normalize.dedup_events(once).count()
    assert once.exceptAll(sec).count() == 0


def test_ingest_at_the_time_of_the_event_is_shown(spark, tmp_path):
    """A dash stands for an absent time only; an event may be taken in within the millisecond."""
    from wardlight.plans.catalog import QUERIES

    row = "select 5L event_id, timestamp_ntz'2024-01-02 03:04:05' ts, 1L user_id, 'click' event_type, 0.0D value, '{\"k\": 3}' props"
    spark.sql(row).write.parquet(str(tmp_path / "events.parquet"))
    shown = QUERIES["display_times"](spark, str(tmp_path)).first()
    assert shown.event_time == "2024-01-02 03:04:05 UTC (05:04:05 +02:00)"
    assert shown.ingest_time == "2024-01-02 03:04:05 UTC (21:34:05 -05:30)"


def test_upper_maps_are_columns(spark):
    """A merge takes its upper map from a column, not by reading the record again for every key of the lower."""
    payload = '{"System": {"Provider": {"Name": "p"}, "EventID": 4}, "EventData": {"IpAddress": "::ffff:10.0.0.1", "EventID": 5}}'
    frame = spark.createDataFrame([(payload,)], "payload string").select(normalize.parse_fields(F.col("payload")).alias("fields"))
    flat = normalize.unwrap_nested(frame)
    assert flat.columns == ["fields"]
    assert json.loads(flat.select(F.to_json("fields").alias("j")).first().j) == {"Provider": "p", "EventID": 5, "IpAddress": "10.0.0.1"}
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "_system" in plan and "_data" in plan


def test_each_run_is_decoded_once(spark):
    frame = spark.range(1).select(F.base64(F.encode(F.lit("a text of some length to be wrapped over lines " * 4), "UTF-8")).alias("CommandLine"))
    found = normalize.decode_base64(frame.repartition(1))
    assert found.first().DecodedText == "a text of some length to be wrapped over lines " * 4
    assert found._jdf.queryExecution().analyzed().toString().lower().count("try_to_binary") == 1


def test_upload_rest_is_written_once(spark):
    """The rest is a column of its own; text that ends in many blanks is still an object."""
    text = json.dumps({"CommandLine": "x" * 70_000, "note": "y" * 300_000}) + " " * 200
    frame = spark.createDataFrame([(text,), (text + "x",)], "payload string").select(
        normalize.parse_fields(F.col("payload")).alias("fields"), F.lit("t").alias("ProvenanceTag"), F.current_timestamp().alias("IngestTimestamp")
    )
    mapped = normalize.map_upload(frame.where("fields is not null"))
    row = mapped.collect()[0]
    assert row.was_cut and row.CommandLine == "x" * 65536 and json.loads(row.UnmappedFields)["_bytes"] == 300_011
    assert mapped.count() == 1 and "_rest" in mapped._jdf.queryExecution().analyzed().toString()


def test_upload_texts_are_not_written_out(spark):
    """Typed text is taken as it is; other values and the rest are written once each, a rest beyond its bound once more."""
    record = {"CommandLine": "a\n\"é\u0000😀" * 9, "HostName": 12.50, "ServiceName": None, "TargetUserName": {"b": [1, "x"]}, "DstPort": 7, "EventID": "4624", "SubjectUserName": True, "more": "\t"}
    texts = [json.dumps(record), json.dumps({"CommandLine": "c"}), "{}"]
    frame = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, payload string").repartition(1).select(
        "n", normalize.parse_fields(F.col("payload")).alias("fields"), F.lit("t").alias("ProvenanceTag"), F.current_timestamp().alias("IngestTimestamp")
    )
    mapped = normalize.map_upload(frame)
    full, short, empty = mapped.orderBy("n").collect()
    assert (full.CommandLine, full.HostName, full.ServiceName) == (record["CommandLine"], "12.5", "")
    assert (json.loads(full.TargetUserName), full.DstPort, full.EventID, full.SubjectUserName) == ({"b": [1, "x"]}, 7, 4624, "true")
    assert json.loads(full.UnmappedFields) == {"more": "\t"}
    assert (short.CommandLine, short.UnmappedFields, short.had_unmapped) == ("c", "", False) and empty.CommandLine == empty.UnmappedFields == ""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        assert mapped._jdf.queryExecution().analyzed().toString().count("to_json(") == 3
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_long_texts_are_searched_by_bytes(spark):
    """Where an object ends and a second begins is found without counting characters, also beside wide ones."""
    good = ['{"a":1}', '{"a":"' + "é" * 100 + '"}', '{"a":{"b":"😀{"}}' + " " * 70 + "\n", '{"a":"}{"}']
    bad = ["", "é{}", '{"a":1} {"b":2}', '{"a":"' + "é" * 100 + '"},{}', '{"a":1}' + " " * 70 + "é", "[1]", None]
    frame = spark.createDataFrame([(x, x in good) for x in [*good, *bad]], "p string, good boolean").repartition(1)
    read = frame.select("p", "good", normalize.parse_fields(F.col("p")).isNotNull().alias("reads"))
    assert [r.p for r in read.collect() if r.reads != r.good] == []
    plan = read._jdf.queryExecution().analyzed().toString().lower()
    assert "locate(" not in plan and "right(" not in plan


@pytest.mark.parametrize("limit", range(1, 12))
def test_a_cut_reads_bytes(spark, limit):
    texts = ["", "abc", "é" * 8, "a😀b😀c😀", "日本語テキスト", "x" * 11]
    cut = spark.createDataFrame([(x,) for x in texts], "t string").repartition(1).select("t", c.truncate_bytes(F.col("t"), limit).alias("cut"))
    assert all(r.cut == r.t.encode()[:limit].decode(errors="ignore") for r in cut.collect())
    assert "encode(" not in cut._jdf.queryExecution().analyzed().toString().lower()


def test_long_records_are_what_repeated_texts_would_be(spark):
    from wardlight.plans import samples

    texts = ["", "a\nb", 'q"\\/\u0000 \x7f', "é😀", "[\"x\"]", "{}"]
    docs = spark.createDataFrame([(n, x) for k in (0, 1) for n, x in enumerate(texts, k)], "doc_id long, text string")
    note = F.repeat("text", F.when(F.col("doc_id") % 2 == 0, 200).otherwise(0))
    record = F.to_json(F.struct(F.repeat("text", F.lit(40)).alias("CommandLine"), F.lit("h").alias("HostName"), note.alias("note")))
    want = docs.select("doc_id", record.alias("record"), F.octet_length("text").alias("size"))
    made = samples.long_records(docs)
    assert sorted(made.collect()) == sorted(want.collect())
    assert made._jdf.queryExecution().analyzed().toString().count("to_json(") == 1


def test_values_of_any_length_are_read(spark):
    """A value beyond the parser's bound of 20,000,000 characters does not lose its record; what is no object stays refused."""
    value = F.repeat(F.lit("y"), F.lit(20_000_001))
    ends = [('{"CommandLine":"c","note":"', '"}', True), ('{"CommandLine":"', '"}', True), ('{"note":1,"note":"', '"}', False), ("{'note':'", "'}", False), ('{"note":"', '"} {}', False)]
    frame = spark.createDataFrame([(n, *x) for n, x in enumerate(ends)], "n int, a string, z string, good boolean").repartition(1)
    frame = frame.select("n", "good", F.concat("a", value, "z").alias("payload")).select(
        "n", "good", normalize.parse_fields(F.col("payload")).alias("fields"), F.lit("t").alias("ProvenanceTag"), F.current_timestamp().alias("IngestTimestamp")
    )
    kept = normalize.map_upload(frame).select("n", "good", "was_cut", "had_unmapped", F.octet_length("CommandLine").alias("size"))
    found = [tuple(r) for r in kept.orderBy("n").collect()]
    assert found[:2] == [(0, True, True, True, 1), (1, True, True, False, 65536)]
    assert [r[1:3] for r in found[2:]] == [(False, False)] * 3
