"""The skew-safe helpers against brute force, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import correlate, ingest, ledger
from wardlight.operators.ordering import first_n, percentiles, small_side, with_previous, with_running


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, many equal times."""
    rng = np.random.default_rng(1)
    n = 6000
    frame = pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str)),
            "t": rng.integers(0, 500, n),
            "id": [f"e{i:05d}" for i in range(n)],
            "size": rng.integers(1, 5000, n),
        }
    )
    return frame, spark.createDataFrame(frame)


def test_running_numbers_and_sums(skewed):
    frame, df = skewed
    got = with_running(df, ["key"], ["t", "id"], "n", {"total": "size"}, partitions=7).toPandas()
    want = frame.sort_values(["key", "t", "id"]).copy()
    want["n"] = want.groupby("key").cumcount() + 1
    want["total"] = want.groupby("key")["size"].cumsum()
    got = got[list(want.columns)].sort_values(["key", "t", "id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True), check_dtype=False)


def test_previous_value_over_a_hot_key(skewed):
    frame, df = skewed
    got = with_previous(df, ["key"], ["t", "id"], "size", "last").toPandas()
    want = frame.sort_values(["key", "t", "id"])
    want["last"] = want.groupby("key")["size"].shift()
    got = got.sort_values(["key", "t", "id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(want.columns)], want.reset_index(drop=True), check_dtype=False)


def test_first_n_is_exact(skewed):
    frame, df = skewed
    got = first_n(df, ["key"], ["t", "id"], 50, spread_by=F.col("id"), spread=8).toPandas()
    want = frame.sort_values(["t", "id"]).groupby("key").head(50)
    assert set(got["id"]) == set(want["id"])


@pytest.mark.parametrize("n", [1, 2, 10, 5000])
def test_percentiles(spark, n):
    values = np.random.default_rng(n).integers(0, 100_000, n)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for bins in (2, 16, 4096):
        got = percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, bins)
        assert got["p50"] == pytest.approx(np.quantile(values, 0.5))
        assert got["p95"] == pytest.approx(np.quantile(values, 0.95))


def test_percentiles_of_wild_values(spark):
    """The range of the values costs passes, not memory; nulls do not count."""
    values = [-(2**63), 2**63 - 1, 5, 5, 6, 7, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert percentiles(df, "v", {"a": 0.0, "b": 0.5, "c": 1.0}, 64) == {"a": -(2**63), "b": 5.5, "c": 2**63 - 1}
    assert percentiles(df.limit(0), "v", {"a": 0.5}) == {"a": None}


def test_small_sides_are_small_in_bytes(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    assert hinted(small_side(wide)) and not hinted(small_side(wide, max_bytes=500_000)) and not hinted(small_side(wide, max_rows=99))


def _greedy(sizes, max_rows, max_bytes):
    out, count, held, batch = [], 0, 0, 0
    for s in sizes:
        if count and (count >= max_rows or held + s > max_bytes):
            batch, count, held = batch + 1, 0, 0
        count, held = count + 1, held + s
        out.append(batch)
    return out


def test_greedy_packing(skewed):
    frame, df = skewed
    got = ledger.pack_batches_greedy(df, "key", "size", ["t", "id"], 20, 40_000, segment_rows=10**6).toPandas()
    for key, rows in got.groupby("key"):
        rows = rows.sort_values(["t", "id"])
        assert list(rows["batch_no"]) == _greedy(rows["size"], 20, 40_000), key
    parts = ledger.pack_batches_greedy(df, "key", "size", ["t", "id"], 20, 40_000, segment_rows=100).toPandas()
    assert len(parts) == len(frame)
    sums = parts.groupby(["key", "segment", "batch_no"])["size"].agg(["sum", "count"])
    assert sums["sum"].max() <= 40_000 and sums["count"].max() <= 20
    assert parts.groupby(["key", "segment"]).size().max() == 100


@pytest.mark.parametrize("segment_rows,max_rows,max_bytes", [(100, 20, 40_000), (7, 20, 40_000), (64, 1000, 3_000), (50, 1, 10**9)])
def test_greedy_packing_spans_segments(spark, skewed, segment_rows, max_rows, max_bytes):
    frame, _ = skewed
    frame = frame.assign(key=frame["key"].where(frame["key"] != frame["key"].iloc[-1], None))
    df = spark.createDataFrame(frame)
    got = ledger.pack_batches_greedy(df, "key", "size", ["t", "id"], max_rows, max_bytes, segment_rows=segment_rows).toPandas()
    assert len(got) == len(frame)
    for key, rows in got.groupby("key", dropna=False):
        rows = rows.sort_values(["t", "id"])
        assert list(rows["batch_no"]) == _greedy(rows["size"], max_rows, max_bytes), key
        assert list(rows["segment"]) == [k // segment_rows for k in range(len(rows))]


def test_packing_bounds(skewed):
    _, df = skewed
    packed = ledger.pack_batches(df, "key", "size", ["t", "id"], 20, 40_000, largest_event=5000).toPandas()
    sums = packed.groupby(["key", "batch_key"])["size"].agg(["sum", "count"])
    assert sums["sum"].max() <= 40_000 and sums["count"].max() <= 20


def test_rate_limit_never_exceeds(spark, skewed):
    frame, _ = skewed
    df = spark.createDataFrame(frame).select(
        "id", F.concat("key", F.lit(":x")).alias("provenance_tag"), F.timestamp_seconds("t").alias("received_at")
    )
    got = ingest.rate_limit(df, 40).toPandas()
    frame = frame.assign(minute=frame["t"] // 60)
    want = frame.sort_values(["t", "id"]).groupby(["key", "minute"]).head(40)
    assert set(got["id"]) == set(want["id"])


def _events(spark, rows):
    return spark.createDataFrame(rows, "who string, ms long, host string, kind string, id string").withColumn(
        "TimeGenerated", F.timestamp_millis("ms")
    ).withColumn("EventRecordID", F.col("id"))


@pytest.fixture(scope="module")
def timeline(spark):
    rng = np.random.default_rng(3)
    rows = [
        (
            "hot" if rng.random() < 0.4 else f"u{rng.integers(0, 5)}",
            int(rng.integers(0, 60_000)),
            f"h{rng.integers(0, 3)}",
            "ab"[rng.integers(0, 2)],
            f"e{i:04d}",
        )
        for i in range(700)
    ]
    return rows, _events(spark, rows)


@pytest.mark.parametrize("span", [50, 400])
def test_threshold_exact(timeline, span):
    rows, df = timeline
    got = {
        (r.entity, int(r.ms)): r.events
        for r in correlate.threshold_exact(df, "who", 2, span)
        .withColumn("ms", F.unix_millis("moment"))
        .collect()
    }
    want = {}
    for who, ms, *_ in rows:
        n = sum(1 for w, m, *_ in rows if w == who and ms - span <= m <= ms)
        if n >= 2:
            want[(who, ms)] = n
    assert got == want


@pytest.mark.parametrize("span", [50, 400])
def test_sequence_next(timeline, span):
    rows, df = timeline
    got = {
        (r.entity, r.a): (r.first_events, r.first_id, r.b, r.next_id)
        for r in correlate.sequence_next(df, F.col("kind") == "a", F.col("kind") == "b", "who", span)
        .withColumns({"a": F.unix_millis("first_at"), "b": F.unix_millis("next_at")})
        .collect()
    }
    want = {}
    for who, ms in {(r[0], r[1]) for r in rows if r[3] == "a"}:
        firsts = [r for r in rows if r[0] == who and r[1] == ms and r[3] == "a"]
        later = sorted((r[1], r[4]) for r in rows if r[0] == who and r[3] == "b" and ms < r[1] <= ms + span)
        if later:
            want[(who, ms)] = (len(firsts), min(r[4] for r in firsts), *later[0])
    assert got == want


def test_sequence_diff_host(timeline):
    rows, df = timeline
    span = 300
    got = {
        (r.entity, r.a, r.first_host): (r.b, r.next_host)
        for r in correlate.sequence_diff_host(df, F.lit(True), "who", span, host="host")
        .withColumns({"a": F.unix_millis("first_at"), "b": F.unix_millis("next_at")})
        .collect()
    }
    want = {}
    for who, ms, host, *_ in rows:
        later = sorted(
            (m, h) for w, m, h, *_ in rows if w == who and h != host and (m, h) > (ms, host) and m <= ms + span
        )
        if later:
            want[(who, ms, host)] = later[0]
    assert got == want


def test_lateral_movement(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        flow = bool(rng.random() < 0.5)
        kind = int(rng.choice([3, 10]))
        rows.append(
            (
                f"10.0.0.{rng.integers(0, 3)}",
                int(rng.integers(0, 100_000)),
                "netflow" if flow else "wef",
                0 if flow else 4624,
                0 if flow else kind,
                int(rng.choice([445, 3389, 80])) if flow else 0,
            )
        )
    df = spark.createDataFrame(
        rows, "SrcIpAddr string, ms long, SourceType string, EventID long, LogonType int, DstPort int"
    ).withColumn("TimeGenerated", F.timestamp_millis("ms"))
    span = 900
    got = {
        (r.address, r.logon_type, r.t): (r.logons, r.flows, r.b, r.a)
        for r in correlate.lateral_movement(df, span)
        .withColumns({"t": F.unix_millis("logon_at"), "b": F.unix_millis("flow_before"), "a": F.unix_millis("flow_after")})
        .collect()
    }
    want = {}
    for ip, ms, src, eid, kind, _ in rows:
        if src == "netflow" or eid != 4624:
            continue
        port = correlate.LATERAL_PORTS[kind]
        near = [m for i, m, s, _, _, p in rows if s == "netflow" and i == ip and p == port and abs(m - ms) <= span]
        if near:
            logons = sum(1 for i, m, s, _, k, _ in rows if s != "netflow" and (i, m, k) == (ip, ms, kind))
            before, after = [m for m in near if m <= ms], [m for m in near if m >= ms]
            want[(ip, kind, ms)] = (logons, len(near), max(before, default=None), min(after, default=None))
    assert got == want
