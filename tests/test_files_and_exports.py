"""File gates, evidence parsing, sinks and exports."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from wardlight.operators import search
from wardlight.sources import files, sinks
from wardlight.sources import telemetry as t


def parse(spark, ext, content, cap=10**6):
    frame = spark.createDataFrame([(f"f.{ext}", ext, content)], "file string, ext string, content string")
    rows = files.parse_evidence(frame, max_events=cap).orderBy("position").collect()
    return [json.loads(r.record) for r in rows]


def test_json_array_and_object(spark):
    assert parse(spark, "json", '[{"a": 1}, 2, {"b": "x"}]') == [{"a": 1}, {"b": "x"}]
    assert parse(spark, "json", '{"a": {"b": [1]}}') == [{"a": {"b": [1]}}]
    assert parse(spark, "json", "oops") == []


def test_jsonl_skips_bad_lines(spark):
    assert parse(spark, "jsonl", '{"a": 1}\nbad\n\n  {"b": 2}  \r\n[3]') == [{"a": 1}, {"b": 2}]


def test_csv(spark):
    text = 'HostName,CommandLine\r\nh1,"say ""hi"", now"\r\nh2,\r\n'
    assert parse(spark, "csv", text) == [
        {"HostName": "h1", "CommandLine": 'say "hi", now'},
        {"HostName": "h2", "CommandLine": ""},
    ]


def test_log_falls_back(spark):
    assert parse(spark, "log", '{"a": 1}\nplain') == [{"a": 1}]
    assert parse(spark, "txt", '[\n{"a": 1},\n{"a": 2},\n{"a": 3}]') == [{"a": 1}, {"a": 2}, {"a": 3}]
    assert parse(spark, "log", '{"a": 1} {"b": 2}\n{"c": [{"d": 1}, {"d": 2}]}') == [{"c": [{"d": 1}, {"d": 2}]}]
    assert parse(spark, "txt", "one\n\n two \n") == [{"message": "one"}, {"message": "two"}]
    assert parse(spark, "exe", "one") == []


def test_event_cap_keeps_file_order(spark):
    assert parse(spark, "txt", "a\nb\nc", cap=2) == [{"message": "a"}, {"message": "b"}]


def test_event_cap_tells_what_it_left_out(spark):
    frame = spark.createDataFrame([("f.txt", "txt", "a\nb\nc")], "file string, ext string, content string")
    assert {r.left_out for r in files.parse_evidence(frame, max_events=2).collect()} == {1}
    assert files.parse_evidence(frame).count() == 3


def test_oversize_file_has_a_verdict(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine")
    (tmp_path / "b.txt").write_text("x" * 200)
    got = {r.file.rsplit("/")[-1]: r.verdict for r in files.utf8_gate(files.read_files(spark, str(tmp_path), 100)).collect()}
    assert got == {"a.txt": "accepted", "b.txt": "FILE_TOO_LARGE"}


def test_long_quoted_cells(spark):
    cell = 'a,"b"\r\n' * 9000
    text = "message,k\r\n" + '"' + cell.replace('"', '""') + '",1\r\n'
    assert parse(spark, "csv", text) == [{"message": cell, "k": "1"}]


def test_line_files_of_any_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "sub" / "b.jsonl").write_text('{"k": 1}\nbad\n')
    (tmp_path / "c.exe").write_text("no")
    lines = files.scan_drop(spark, str(tmp_path))
    assert lines.count() == 4
    records = {r.record for r in files.parse_drop_lines(lines).collect()}
    assert records == {'{"message":"x"}', '{"message":"y"}', '{"k": 1}'}


def test_utf8_gate(spark):
    rows = [("a", "txt", "ok é".encode()), ("b", "txt", b"\xff\xfe"), ("c", "log", b"a\x00b"), ("d", "evtx", b"x"), ("e", "zip", b"x")]
    frame = spark.createDataFrame(rows, "file string, ext string, content binary")
    got = {r.file: r.verdict for r in files.utf8_gate(frame).collect()}
    assert got == {
        "a": "accepted",
        "b": "BINARY_CONTENT_REJECTED",
        "c": "BINARY_CONTENT_REJECTED",
        "d": "UNSUPPORTED_FILE_TYPE",
        "e": "UNSUPPORTED_FILE_TYPE",
    }


def test_decompression_gate(spark):
    bomb = gzip.compress(b"\0" * 5_000_000)
    rows = [("bomb", bomb), ("fine", zlib.compress(b"abc" * 5)), ("bad", b"not compressed"), ("cut", gzip.compress(b"hello" * 9)[:-9])]
    frame = spark.createDataFrame(rows, "file string, content binary")
    got = {r.file: r for r in files.decompression_gate(frame).collect()}
    assert got["bomb"].verdict == "DecompressionCapTrip"
    assert got["bomb"].expanded < 21 * len(bomb) + 65536
    assert got["fine"].verdict == "accepted" and got["fine"].expanded == 15
    assert got["bad"].verdict == "CorruptArchive" and got["cut"].verdict == "CorruptArchive"


def test_decompression_matches_zlib(spark, folder):
    docs = t.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("file"), F.encode("text", "UTF-8").alias("content"))
    plain = {r.file: bytes(r.content) for r in docs.collect()}
    packed = spark.createDataFrame([(k, zlib.compress(v)) for k, v in plain.items()], "file string, content binary")
    for r in files.decompression_gate(packed, cap=3.0).collect():
        ratio = len(plain[r.file]) / r.compressed
        assert r.verdict == ("DecompressionCapTrip" if len(plain[r.file]) > int(r.compressed * 3.0) else "accepted"), ratio


@pytest.mark.parametrize(
    "raw,want",
    [("=1+1", '"\'=1+1"'), ("+1", '"\'+1"'), ("-1", '"\'-1"'), ("@x", '"\'@x"'), ('say "a"', '"say ""a"""'), ("a,b", '"a,b"'), (None, '""'), ("", '""')],
)
def test_csv_cell(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.select(sinks.csv_cell(F.col("x"))).collect()[0][0] == want


def test_csv_export_files(spark, sec, tmp_path):
    out = str(tmp_path / "csv")
    sinks.export_csv(sec, out, truncated=True)
    header = next((tmp_path / "csv" / "header").glob("part-*")).read_bytes().decode()
    assert header.startswith("# NOTE: Results capped") and header.count("\r\n") == 2
    rows = b"".join(p.read_bytes() for p in (tmp_path / "csv" / "rows").glob("part-*"))
    assert rows.count(b"\r\n") == sec.count()


def test_json_export_manifest(spark, sec, tmp_path):
    out = str(tmp_path / "json")
    sinks.export_json(sec, out, truncated=True)
    manifest = spark.read.json(f"{out}/manifest").collect()[0]
    assert manifest._truncated and manifest._truncation_note.startswith("Results capped")
    assert spark.read.json(f"{out}/events").count() == sec.count()


def test_event_table_round_trip(spark, sec, tmp_path):
    out = str(tmp_path / "events")
    sinks.write_events(sec, out)
    back = sinks.read_events(spark, out)
    columns = [c for c in back.columns if c != "event_month"]
    assert back.select(columns).exceptAll(sec.select(columns)).count() == 0
    assert back.count() == sec.count()
    plan = back.filter((F.col("EventID") == 4769) & (F.col("event_month") == "202401"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(EventID), EqualTo(EventID,4769)]" in plan
    assert "PartitionFilters: [isnotnull(event_month" in plan


def test_search_validation():
    for kind, value in [("Nope", "x"), ("Port", "0"), ("Port", "65536"), ("EventID", "-1"), ("FileHash", "z" * 32), ("FileHash", "a" * 31)]:
        with pytest.raises(ValueError):
            search.search_condition(kind, value)
    with pytest.raises(ValueError):
        search.check_range("2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        search.check_range("2024-01-01", "2024-02-02")


def test_incident_id_is_checked(sec):
    with pytest.raises(ValueError):
        search.search(sec, "IP", "1.1.1.1", "2024-01-01", "2024-01-02", incident_id="a:b%")


def test_cap_reports_truncation(sec):
    rows, over = search.capped(sec, 10)
    assert rows.count() == 10 and over.collect()[0].truncated
    _, whole = search.capped(sec, 10**6)
    assert not whole.collect()[0].truncated


def test_keyset_page_equals_offset_page(sec):
    first = search.newest_page(sec, 50).collect()
    last = first[-1]
    follow = search.page_after(sec, last.TimeGenerated, last.EventRecordID, 50)
    want = search.newest_page(sec, 50, 50)
    assert [r.EventRecordID for r in follow.collect()] == [r.EventRecordID for r in want.collect()]


def test_adhoc_cap_cannot_be_lifted(spark, sec):
    rows = search.adhoc_sql(spark, {"ev": sec}, "SELECT * FROM (SELECT * FROM ev LIMIT 900) t", cap=5)
    assert rows.count() == 5
