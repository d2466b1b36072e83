"""Streams over several micro-batches give the batch answer."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import correlate, ingest, normalize, rules
from wardlight.plans.catalog import QUERIES
from wardlight.sources import telemetry as t
from wardlight.streaming import jobs, state, store

HOUR = 3_600_000


@pytest.fixture(scope="module")
def pieces(spark, folder, tmp_path_factory):
    """The events in time order, four files, one per micro-batch."""
    out = str(tmp_path_factory.mktemp("pieces"))
    events = t.table(spark, folder, "events")
    bounds = [r[0] for r in events.select(F.percentile("event_id", F.array(*map(F.lit, (0.25, 0.5, 0.75))))).collect()][0]
    marks = [-1, *bounds, 10**12]
    for low, high in zip(marks, marks[1:]):
        part = events.filter((F.col("event_id") > low) & (F.col("event_id") <= high))
        part.coalesce(1).write.mode("append").parquet(out)
    return out


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_normalize(spark, folder, pieces):
    got = jobs.run_available(jobs.stream_normalize(t.raw_messages(stream(spark, pieces))), "n")
    want = normalize.normalize_events(t.raw_messages(t.table(spark, folder, "events")))
    assert rows(got.drop("UnmappedFields")) == rows(want.drop("UnmappedFields"))


def test_normalize_accounts_for_every_message(spark, pieces):
    raw = t.raw_messages(stream(spark, pieces))
    n = F.split_part("id", F.lit(":"), F.lit(4)).cast("long") % 5
    text = F.when(n == 0, F.repeat(F.lit("x"), 65_537)).when(n == 1, F.lit("not json")).when(n == 2, F.lit(None))
    events, rejects = jobs.run_normalize(raw.withColumn("payload", F.when(n < 3, text).otherwise(F.col("payload"))), "n")
    lost = dict(map(tuple, rejects.groupBy("EventType").agg(F.sum("EventCount")).collect()))
    groups = dict(map(tuple, t.raw_messages(spark.read.parquet(pieces)).groupBy(n).count().collect()))
    assert lost == {"EventSizeCap": groups[0], "ParseError": groups[1] + groups[2]}
    assert events.count() == groups[3] + groups[4]


def test_rate_limit_across_batches(spark, folder, pieces):
    got = jobs.stream_rate_limit(t.raw_messages(stream(spark, pieces)), 5, "3 days")
    kept = got.groupBy(
        F.split_part("provenance_tag", F.lit(":"), F.lit(1)).alias("s"), F.window("received_at", "3 days").start.alias("w")
    ).count()
    raw = t.raw_messages(t.table(spark, folder, "events"))
    want = ingest.rate_limit(raw, 5, window="3 days")
    assert got.count() == want.count()
    assert kept.agg(F.max("count")).collect()[0][0] == 5


def test_sequence_across_batches(spark, folder, pieces):
    first, second = F.col("EventID") == 4768, F.col("EventID") == 4769
    span = 24 * HOUR
    got = jobs.run_available(
        jobs.stream_sequence(t.as_security_events(stream(spark, pieces)), first, second, "SubjectUserName", span), "s"
    )
    sec = t.security_events(spark, folder)
    want = correlate.sequence_next(sec, first, second, "SubjectUserName", span)
    last = sec.filter(first | second).agg(F.max(F.unix_millis("TimeGenerated"))).collect()[0][0] - 300_000
    done = (F.floor(F.unix_millis("first_at") / span) + 2) * span <= last
    assert rows(got) == rows(want.filter(done))


def test_dedup_across_batches(spark, folder, pieces):
    events = t.as_security_events(stream(spark, pieces))
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    got = jobs.run_available(jobs.stream_dedup(twice).select("EventRecordID"), "d")
    assert rows(got) == rows(t.security_events(spark, folder).select("EventRecordID"))


def test_detect_across_batches(spark, folder, pieces):
    sec = t.security_events(spark, folder)
    hits = rules.build_hits(rules.detect_rules(sec, rules.AD_RULES), rules.rules_table(spark, rules.AD_RULES))
    columns = ["hit_id", "rule_id", "batch_start", "hit_count"]
    want = rows(hits.select(*columns))
    flushed = jobs.stream_detect(t.as_security_events(stream(spark, pieces)), rules.AD_RULES, flush=True)
    assert rows(flushed.select(*columns)) == want
    last = sec.agg(F.max(F.unix_millis("TimeGenerated"))).first()[0]
    done = F.unix_millis("batch_end") <= (last - 300_000) // 900_000 * 900_000
    closed = jobs.stream_detect(t.as_security_events(stream(spark, pieces)), rules.AD_RULES)
    assert rows(closed.select(*columns)) == rows(hits.filter(done).select(*columns))


def test_rate_limit_state_expires(spark, pieces, tmp_path):
    """Four batches and one row long after them: only that row's window is still held."""
    path = str(tmp_path / "later")
    for k, part in enumerate(sorted(spark.read.parquet(pieces).select(F.col("_metadata.file_modification_time").alias("m")).distinct().collect())):
        rows_ = spark.read.parquet(pieces).where(F.col("_metadata.file_modification_time") == F.lit(part.m))
        rows_.coalesce(1).write.mode("append").parquet(path)
    last = spark.read.parquet(pieces).limit(1).withColumn("ts", F.lit("2031-01-01").cast("timestamp_ntz")).select(*spark.read.parquet(pieces).columns)
    last.coalesce(1).write.mode("append").parquet(path)
    raw = t.raw_messages(stream(spark, path))
    kept, checkpoint = state.run_with_state(state.rate_limited(raw, 5, "3 days", salts=4), "rate")
    assert kept.where("received_at < '2030-01-01'").count() == ingest.rate_limit(t.raw_messages(spark.read.parquet(pieces)), 5, window="3 days").count()
    for operator in (0, 1):
        held = state.read_state(spark, checkpoint, "used", operator).select("key.starts", "value.passed").collect()
        assert len(held) == 1 and held[0].starts > 1_900_000_000_000 and held[0].passed == 1


def test_rate_limit_passes_values_unchanged(spark, tmp_path):
    rows_ = [("a:1", f"id{k}", f"2024-01-01 00:00:{k % 60:02d}.123456", None if k % 2 else 2**60 + k, [k, None]) for k in range(40)]
    df = spark.createDataFrame(rows_, "provenance_tag string, id string, at string, n long, more array<long>").withColumn("received_at", F.col("at").cast("timestamp")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got, _ = state.run_with_state(state.rate_limited(stream(spark, str(tmp_path / "in")), 25), "rate")
    want = ingest.rate_limit(df, 25)
    assert got.dtypes == df.dtypes and rows(got) == rows(want) and got.count() == 25


def test_states_need_the_right_store(spark, pieces):
    before = spark.conf.get(state.PROVIDER)
    spark.conf.set(state.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="keyed state needs"):
            state.rate_limited(t.raw_messages(stream(spark, pieces)), 5)
        with state.keyed_state(spark):
            state.rate_limited(t.raw_messages(stream(spark, pieces)), 5)
        assert "HDFS" in spark.conf.get(state.PROVIDER)
    finally:
        spark.conf.set(state.PROVIDER, before)


def test_partial_matches_of_two_rules(spark, folder, pieces):
    """What the state holds at the end is what the batch rules leave open; a busy entity is one key."""
    first, second = F.col("EventID") == 4768, F.col("EventID") == 4769
    rule_set = [
        state.SequenceRule("by user", first, second, "SubjectUserName", 24 * HOUR),
        state.SequenceRule("any host", first, second, "ChannelName", 2 * HOUR),
    ]
    events = t.as_security_events(stream(spark, pieces))
    found, checkpoint = state.run_with_state(state.sequences(events, rule_set), "two")
    sec = t.security_events(spark, folder)
    mark = sec.where(first | second).agg(F.max(F.unix_millis("TimeGenerated"))).first()[0] - 300_000
    held = state.entity_state(spark, checkpoint, F.timestamp_millis(F.lit(mark)))
    for rule in rule_set:
        pairs = correlate.sequence_next(sec, first, second, rule.entity, rule.span_ms)
        done = (F.floor(F.unix_millis("first_at") / rule.span_ms) + 2) * rule.span_ms <= mark
        assert rows(found.where(F.col("rule_id") == rule.rule_id).drop("rule_id")) == rows(pairs.where(done))
        waiting = sec.where(first & (F.col(rule.entity) != "") & (F.unix_millis("TimeGenerated") + rule.span_ms >= mark))
        want = waiting.groupBy(F.col(rule.entity).alias("entity_key"), F.col("TimeGenerated").alias("window_start")).agg(
            F.count("*").alias("event_count"), F.min("EventRecordID").alias("id")
        )
        got = held.where(F.col("rule_id") == rule.rule_id).withColumn("id", F.get_json_object("payload", "$.first_id"))
        assert rows(got.select("entity_key", "window_start", "event_count", "id")) == rows(want)
        assert got.where(F.unix_millis("expiry") - F.unix_millis("window_start") != rule.span_ms).isEmpty()


@pytest.fixture(scope="module")
def mixed(spark, folder, tmp_path_factory):
    """The events in four files, each over the whole time."""
    out = str(tmp_path_factory.mktemp("mixed"))
    events = t.table(spark, folder, "events")
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(out)
    return out


def test_every_row_is_counted_or_late(spark, folder, mixed):
    sec = t.security_events(spark, folder)
    events = t.as_security_events(stream(spark, mixed))
    late, counts = jobs.late_rows(events, "TimeGenerated", "5 days", window="1 day")
    counted = jobs.run_available(jobs.stream_threshold(events, "HostName", 1, "1 day", lateness="5 days"), "t")
    mark = sec.agg(F.max(F.unix_millis("TimeGenerated"))).first()[0] - 5 * 24 * HOUR
    day = F.window("TimeGenerated", "1 day")
    still_open = sec.where(F.unix_millis(day.end) > mark)
    late_open = late.where(F.unix_millis(day.end) > mark)
    assert late_open.isEmpty() and late.count() > 0
    assert counted.agg(F.sum("events")).first()[0] + late.count() + still_open.count() == sec.count()
    total = counts.agg(F.sum("rows"), F.sum("late")).first()
    assert total[0] == sec.count() and total[1] == late.count() and counts.count() == 4


def test_every_match_is_in_a_hit_or_late(spark, folder, mixed):
    sec = t.security_events(spark, folder)
    events = t.as_security_events(stream(spark, mixed))
    hits, late = jobs.detect_with_late(events, rules.AD_RULES, delay="10 days", flush=True)
    matches = rules.detect_rules(sec, rules.AD_RULES)
    assert late.count() > 0 and hits.agg(F.sum("hit_count")).first()[0] + late.count() == matches.count()
    assert rows(late.select("rule_id", "EventRecordID").subtract(matches.select("rule_id", "EventRecordID"))) == []


def test_detect_without_matches(spark, tmp_path, folder):
    t.table(spark, folder, "events").limit(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    hits, late = jobs.detect_with_late(t.as_security_events(stream(spark, str(tmp_path / "none"))), rules.AD_RULES, flush=True)
    assert hits.count() == 0 and late.count() == 0 and "hit_id" in hits.columns


def test_sketches_are_close_to_exact_counts(spark, tmp_path):
    wide = spark.range(60_000).select(
        F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("user"),
        F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string")).alias("target"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("TimeGenerated"),
    )
    path = str(tmp_path / "wide")
    for k in range(3):
        wide.where((F.col("id") >= 20_000 * k) & (F.col("id") < 20_000 * (k + 1))).coalesce(1).write.mode("append").parquet(path)
    sketches = jobs.run_available(jobs.stream_fanout(stream(spark, path), "user", "target", "1 hour"), "f")
    assert sketches.where(F.octet_length("sketch") > 5000).isEmpty()
    got = {(r.entity, r.window_start): r.targets for r in jobs.fanout_windows(sketches, 100, "1 day").collect()}
    closed = sketches.select("step_start").distinct()
    inside = wide.withColumn("step_start", F.window("TimeGenerated", "1 hour").start).join(closed, "step_start")
    exact = correlate.fanout(inside, "user", "target", 100, "1 day").collect()
    assert len(exact) == len(got) > 6
    for r in exact:
        assert abs(got[r.entity, r.window_start] - r.targets) <= 0.06 * r.targets


def test_store_has_every_event_once(spark, folder, tmp_path):
    """Restarts between batches, compaction between restarts, a compaction that broke off."""
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    events = t.table(spark, folder, "events")
    want = rows(t.security_events(spark, folder).select("EventRecordID"))
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(source)
        store.stream_events(t.as_security_events(stream(spark, source)), path)
        store.stream_events(t.as_security_events(stream(spark, source)), path)  # nothing new
        if k == 1:
            assert store.compact(spark, path, 202402) > 0 and store.compact(spark, path, 202402) == 0
        if k == 2:
            store.read_store(spark, path).write.partitionBy("event_month").parquet(f"{path}/compacted/run=broken")
    assert rows(store.read_store(spark, path).select("EventRecordID")) == want
    before = store._live(spark, path).select("_file").distinct().count()
    assert store.compact(spark, path, 209901) == before
    assert store._live(spark, path).isEmpty() and rows(store.read_store(spark, path).select("EventRecordID")) == want


def test_health_stream_appends_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "health")
    for k in range(3):
        spark.createDataFrame([(f"e{k}", k)], "EventType string, EventCount long").coalesce(1).write.mode("append").parquet(source)
        store.stream_health(stream(spark, source), path)
    got = spark.read.schema("EventType string, EventCount long").json(f"{path}/live")
    assert rows(got) == [("e0", 0), ("e1", 1), ("e2", 2)]


def test_state_is_asked_once_a_key_not_once_a_moment():
    """A key's moments go to its state in one call and are read in one when time has passed, over however many spans."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows, self.calls, self.timers = [], 0, set()

        def getListState(self, name, schema):  # noqa: N802
            return self

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10_000

        def appendList(self, rows):  # noqa: N802
            self.rows, self.calls = self.rows + list(rows), self.calls + 1

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def clear(self):
            self.rows, self.calls = [], self.calls + 1

    held, partial = Held(), state._Partial()
    partial.init(held)
    moments = [(ms, 10, 1, f"f{ms}", f"s{ms}" if ms % 2 else None) for ms in range(0, 20_000, 7)]
    rows = pd.DataFrame(moments, columns=["ms", "span", "firsts", "first_id", "next_id"])
    list(partial.handleInputRows(("r", "e", 0), iter([rows]), None))
    assert held.timers == {20} and held.calls == 1
    (found,) = partial.handleExpiredTimer(("r", "e", 0), held, None)
    assert held.calls == 3
    done = [ms for ms, *_ in moments if (ms // 10 + 2) * 10 <= 10_000]
    assert list(found["first_id"]) == [f"f{ms}" for ms in reversed(done) if (ms + 7) % 2]
    assert sorted(m[0] for m in held.rows if m[2]) == [ms for ms, *_ in moments if ms not in set(done)]


def test_join_meets_by_address_and_step_of_time(spark, folder, pieces):
    """A logon is held against the flow minutes of its time, not all of its address; none is lost at a step's edge."""
    logons, flows = (t.as_security_events(stream(spark, pieces)) for _ in range(2))
    joined = jobs.stream_join(logons, flows, "6 hours")
    condition = joined._jdf.queryExecution().analyzed().toString()
    assert "logon_step" in condition and "flow_step" in condition
    got = jobs.run_available(joined, "join")
    sec = t.security_events(spark, folder)
    minute = (F.date_trunc("minute", "TimeGenerated") + F.expr("interval 1 minute - interval 1 microsecond")).alias("flow_minute")
    minutes = sec.where("DstPort = 445").groupBy(F.col("SrcIpAddr").alias("address"), minute).agg(F.count("*").alias("flows"))
    last = [sec.where(kind).agg(F.max("TimeGenerated")).first()[0] for kind in ("EventID = 4624", "DstPort = 445")]
    mark = F.lit(min(last)) - F.expr("interval 5 minutes")
    found = sec.where("EventID = 4624").join(minutes, F.col("SrcIpAddr") == F.col("address")).where(
        (F.abs(F.unix_micros("flow_minute") - F.unix_micros("TimeGenerated")) <= 6 * HOUR * 1000) & (F.col("flow_minute") < mark)
    )
    want = found.select(F.col("EventRecordID").alias("logon_id"), "address", F.col("TimeGenerated").alias("logon_at"), "flow_minute", "flows")
    assert rows(got) == rows(want) != []


def test_an_arrival_is_read_by_many_tasks(spark, folder, tmp_path, monkeypatch):
    """One file is one micro-batch, but its row groups are small."""
    import pyarrow.parquet as pq

    from wardlight.plans import samples

    monkeypatch.setattr(samples, "ARRIVAL_BLOCK", 4096)
    samples.arrive(spark, f"{folder}/events.parquet", str(tmp_path / "stream"))
    (file,) = (tmp_path / "stream").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1


@pytest.mark.parametrize("parts", [1, 120])
def test_a_table_in_parts_streams_whole(spark, folder, tmp_path, parts):
    """A table may be a folder of any number of parts, in no order of time; all of it is one micro-batch."""
    t.table(spark, folder, "events").repartition(parts, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("entity_state", "stream_dedup"):
        assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, folder)) != []


def test_partial_matches_of_nothing(spark, folder, tmp_path):
    t.table(spark, folder, "events").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["entity_state"](spark, str(tmp_path)).isEmpty()


def test_moments_are_folded(spark):
    """Rows of a rule, entity and millisecond become one; ids that are missing do not count."""
    import pyarrow as pa

    names = [f.split()[0] for f in state._MOMENT.split(", ")]
    given = [("r", "a", 10, 0, 5, 5000, 1, "f2", None), ("r", "a", 10, 0, 5, 5001, 1, "f1", None), ("r", "a", 10, 0, 6, 6000, 0, None, "s")]
    (found,) = state._moments(iter([pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in given])]))
    assert sorted(tuple(row[n] for n in names) for row in found.to_pylist()) == [
        ("r", "a", 10, 0, 5, 5001, 2, "f1", None), ("r", "a", 10, 0, 6, 6000, 0, None, "s")
    ]
