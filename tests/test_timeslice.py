"""Time ranges prune month partitions; retention removes them."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import ingest, kpi, ledger, rules, search, timeslice
from wardlight.session import local_table
from wardlight.sources import retention, sinks
from wardlight.sources import telemetry as t


@pytest.fixture(scope="module")
def months(spark, folder, tmp_path_factory):
    """The month of events, and copies of it in the months around, as an event table."""
    path = str(tmp_path_factory.mktemp("events") / "t")
    sec = t.security_events(spark, folder)
    every = sec.withColumn("n", F.explode(F.array(*map(F.lit, (-2, -1, 0, 1)))))
    moved = F.expr("timestampadd(MONTH, n, TimeGenerated)")
    sinks.write_events(every.withColumn("TimeGenerated", moved), path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_prune_partitions(spark, months):
    events = sinks.read_events(spark, months)
    assert events.select("event_month").distinct().count() >= 4
    start, end = "2024-01-10", "2024-01-11"
    delivered = events.where("DstPort <> 445")
    found = {
        "rules": rules.detect_rules(events, rules.AD_RULES, start, end),
        "dry run": rules.detect_rules(events, rules.AD_RULES[:1], start, end),
        "pull": ingest.overlap_pull(events, start, end),
        "replay": ledger.replay_range(events, delivered, start, end),
        "search": search.search(events, "IP", "127.0.0.1", start, end),
        "list": search.list_events(events, start, end, event_id=4769),
        "volume": kpi.hourly_volume(events, end, source="HostName"),
        "retention": ledger.apply_retention(events, "2024-03-01"),
    }
    for name, df in found.items():
        filters = [line for line in plan(df).splitlines() if "PartitionFilters: [" in line]
        assert any("event_month" in line for line in filters), name
    for name, df in found.items():
        plain = df.sparkSession.read.parquet(months).drop("event_month")
        if name == "pull":
            assert df.drop("event_month").count() == ingest.overlap_pull(plain, start, end).count() > 0
        if name == "retention":
            assert df.count() == ledger.apply_retention(plain, "2024-03-01").count() > 0


def test_joined_ranges_prune_partitions(spark, months):
    events = sinks.read_events(spark, months)
    ranges = [("a", "2023-12-30", "2024-01-02"), ("b", "2024-01-05", "2024-01-05"), ("c", "2024-01-01", "2024-01-03"), ("d", None, "2024-01-03")]
    table = local_table(spark, ranges, "batch string, s string, e string").select("batch", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    got = timeslice.in_slices(events, table)
    assert "dynamicpruning" in plan(got).lower()
    want = events.drop("event_month").join(table, F.expr("TimeGenerated >= start and TimeGenerated < end"))
    key = ["batch", "EventRecordID", "TimeGenerated"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert timeslice.in_slices(events.drop("event_month"), table).count() == got.count() > 0


def test_purge_drops_months_and_rewrites_one(spark, months, tmp_path):
    path = str(tmp_path / "copy")
    spark.read.parquet(months).write.partitionBy("event_month").parquet(path)
    as_of, days = "2024-02-20", {"wef": 20, "syslog": 30, "netflow": 35, "sysmon": 45, "forensic": 60}
    want = ledger.apply_retention(sinks.read_events(spark, path), as_of, days)
    expected = sorted(map(tuple, want.select("EventRecordID", "TimeGenerated").collect()))
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "copy" / "event_month=202402").iterdir()}
    report = {r.event_month: (r.action, r.events_kept) for r in retention.purge_events(spark, path, as_of, days).collect()}
    assert report[202311] == ("dropped", 0) and report[202401][0] == "rewritten"
    left = sinks.read_events(spark, path)
    assert sorted(map(tuple, left.select("EventRecordID", "TimeGenerated").collect())) == expected
    assert not (tmp_path / "copy" / "event_month=202311").exists()
    again = {r.event_month: r.action for r in retention.purge_events(spark, path, as_of, days).collect()}
    assert "dropped" not in again.values() and "rewritten" not in again.values()
    assert sorted(map(tuple, sinks.read_events(spark, path).select("EventRecordID", "TimeGenerated").collect())) == expected
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "copy" / "event_month=202402").iterdir()} == untouched


def test_sifted_values_are_few(spark, folder):
    """Of the values of the events hardly more are spread over rows than match."""
    sec = t.security_events(spark, folder).withColumn("FileMD5", F.md5(F.col("HostName").cast("binary")))
    wanted = spark.createDataFrame([("IP", "127.0.0.1"), ("Username", "user8"), ("Port", "3389"), ("EventID", "4662"), ("Hostname", "host7")], "type string, value string")
    spread = search.searchable_values(sec, ["EventRecordID"], wanted).count()
    matches = search.ioc_match(sec, wanted, ["EventRecordID"])
    whole = search.searchable_values(sec, ["EventRecordID"]).join(wanted, ["type", "value"])
    assert sorted(map(tuple, matches.collect())) == sorted(map(tuple, whole.select(*matches.columns).collect()))
    assert matches.count() <= spread <= 2 * matches.count()
    assert search.ioc_match(sec, wanted.limit(0), ["EventRecordID"]).count() == 0


def test_no_row_carries_the_whole_filter(spark, folder):
    """A value meets one piece of the bitmap; a cross join would copy all of it into every event."""
    sec = t.security_events(spark, folder)
    wanted = spark.range(3000).select(F.lit("Username").alias("type"), F.concat(F.lit("user"), "id").alias("value"))
    met = search.searchable_values(sec, ["EventRecordID"], wanted)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    whole = search.searchable_values(sec, ["EventRecordID"]).join(wanted, ["type", "value"])
    got = search.ioc_match(sec, wanted, ["EventRecordID"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))
