"""Forest, ledgers, graph and figures on small hand-made frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import anomaly, graph, kpi, ledger


def test_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(400, 2))
    points[0] = [9.0, -9.0]
    frame = pd.DataFrame({"entity": [f"e{i}" for i in range(400)], "a": points[:, 0], "b": points[:, 1]})
    df = spark.createDataFrame(frame)
    forest = anomaly.fit_forest(df, ["a", "b"], ["entity"], trees=50, sample=128)
    assert forest.groupBy("tree").count().count() == 50
    scored = anomaly.score_forest(df, ["a", "b"], forest, 128).toPandas().set_index("entity")["anomaly_score"]
    assert scored.idxmax() == "e0" and scored["e0"] > 0.7
    assert scored.between(0, 1).all() and scored.median() < 0.55
    again = anomaly.score_forest(df.repartition(5), ["a", "b"], anomaly.fit_forest(df.repartition(3), ["a", "b"], ["entity"], trees=50, sample=128), 128)
    same = again.toPandas().set_index("entity")["anomaly_score"]
    assert (same.sort_index() == scored.sort_index()).all()


def test_score_one_is_in_the_last_bucket(spark):
    scores = spark.createDataFrame([(0.0,), (0.7,), (0.9999,), (1.0,)], "s double")
    assert [r[0] for r in scores.select(kpi.score_bucket(F.col("s"))).collect()] == [0, 7, 9, 9]


def test_reconcile_reports_both_directions(spark):
    local = spark.createDataFrame([("b1", "s", 1000), ("b2", "s", 100), ("b3", "s", 10)], "batch_id string, stream_tag string, event_count long")
    received = spark.createDataFrame([("b1", "s", 949), ("b2", "s", 50), ("b4", "s", 60)], "batch_id string, stream_tag string, event_count long")
    got = {r.batch_id: (r.delta, r.lost, r.surplus) for r in ledger.reconcile_counts(local, received).collect()}
    assert got == {"b1": (51, True, False), "b2": (50, False, False), "b3": (10, False, False), "b4": (-60, False, True)}


def test_known_incident_is_skipped_for_a_day(spark):
    hits = spark.createDataFrame(
        [("h1", "r", "1.0", "High", ["a", "b"], "2:1:1", 2, "t", "2024-01-02 00:00:00"), ("h2", "r", "1.0", "Medium", ["c"], "1:7:7", 1, "t", "2024-01-02 00:00:00")],
        "hit_id string, rule_id string, rule_version string, severity string, event_record_ids array<string>, ids_digest string, hit_count long, mitre_tag string, at string",
    ).withColumn("created_at", F.to_timestamp("at"))
    opened = ledger.incidents(hits)
    assert opened.count() == 1
    seen = lambda at: opened.select("fingerprint", F.to_timestamp(F.lit(at)).alias("created_at"))
    assert ledger.incidents(hits, seen("2024-01-01 12:00:00")).count() == 0
    assert ledger.incidents(hits, seen("2023-12-30 12:00:00")).count() == 1


def test_graph_first_category_wins_and_no_self_loop(spark):
    rows = spark.createDataFrame(
        [("r1", 2000, "x", "x", "", "1.1.1.1", "1.1.1.1", "", 5), ("r2", 1000, "h", "x", "", "", "", "", 6)],
        "EventRecordID string, ms long, HostName string, SubjectUserName string, TargetUserName string, SrcIpAddr string, DstIpAddr string, ProcessImagePath string, EventID long",
    ).withColumn("TimeGenerated", F.timestamp_millis("ms"))
    nodes = {r.name: r.category for r in graph.graph_nodes(rows).collect()}
    assert nodes == {"x": 0, "h": 0, "1.1.1.1": 2}
    edges = {(r.src, r.dst): r.event_id for r in graph.graph_edges(rows).collect()}
    assert edges == {("x", "1.1.1.1"): 5, ("h", "x"): 6}
    hops = {r.name: r.hop for r in graph.graph_khop(graph.graph_edges(rows), "h", 3).collect()}
    assert hops == {"h": 0, "x": 1, "1.1.1.1": 2}


def test_rule_audit_and_gaps(spark):
    changes = spark.createDataFrame(
        [("r", "draft", 1), ("r", "production", 2), ("r", "production", 3), ("r", "disabled", 4)], "rule_id string, status string, t long"
    ).select("rule_id", "status", F.timestamp_seconds("t").alias("updated_at"))
    audit = ledger.rule_audit(changes)
    got = [(r.old_status, r.new_status, r.Severity) for r in audit.orderBy("TimeGenerated").collect()]
    assert got == [("draft", "production", "High"), ("production", "disabled", "High")]
    assert ledger.audit_gaps(changes, audit).count() == 0
    assert ledger.audit_gaps(changes, audit.filter("new_status = 'production'")).count() == 1
    assert ledger.active_rules(changes).count() == 0


@pytest.mark.parametrize("sort_by,want", [("severity", ["c", "a", "b"]), ("name", ["c", "b", "a"])])
def test_incident_sort(spark, sort_by, want):
    rows = spark.createDataFrame(
        [("a", "alpha", "High", "open"), ("b", "Beta", "Low", "open"), ("c", "gamma", "critical", "open")],
        "incident_id string, name string, severity string, status string",
    ).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "event_count": F.lit(1)})
    assert [r.incident_id for r in ledger.list_incidents(rows, sort_by=sort_by).collect()] == want
