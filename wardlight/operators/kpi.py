"""Dashboard figures: volumes, latency, hit and rule roll-ups, health.

Each figure is one aggregate over one scan.  ``as_of`` closes the window:
a figure over "the last 24 hours" covers ``[as_of - 24 h, as_of)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.operators.ordering import percentiles
from wardlight.operators.timeslice import back_from
from wardlight.session import checkpointed, local_table

SEVERITIES = ["High", "Medium", "Low", "Informational"]


def since(at: str, as_of, back: str) -> Column:
    end = F.lit(as_of).cast("timestamp")
    return (F.col(at) >= end - F.expr(f"interval {back}")) & (F.col(at) < end)


def events_by_source(
    events: DataFrame, as_of, back: str = "24 hours", source: str = "SourceType", top: int | None = None
) -> DataFrame:
    counted = (
        back_from(events, as_of, back)
        .groupBy(source)
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), source)
    )
    return counted.limit(top) if top else counted


def hit_kpis(hits: DataFrame, as_of, back: str = "24 hours") -> DataFrame:
    """Hits of the window and time of the latest hit of all, in one scan."""
    return hits.agg(
        F.count_if(since("created_at", as_of, back)).alias("hits"),
        F.max("created_at").alias("last_batch_at"),
    )


def score_bucket(score: Column) -> Column:
    """Tenths 0-9; the score 1.0 belongs to the last one."""
    return F.least(F.floor(F.round(score * 10, 6)), F.lit(9)).cast("int")


def score_histogram(hits: DataFrame, as_of, back: str = "24 hours") -> DataFrame:
    """Ten score buckets, empty ones included."""
    labels = hits.sparkSession.range(10).select(
        F.col("id").cast("int").alias("bucket"),
        F.concat_ws(
            "-",
            F.format_string("%.1f", F.col("id") / 10),
            F.format_string("%.1f", (F.col("id") + 1) / 10),
        ).alias("label"),
    )
    counted = (
        hits.filter(since("created_at", as_of, back) & (F.col("anomaly_score") >= 0))
        .groupBy(score_bucket(F.col("anomaly_score")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    return labels.join(counted, "bucket", "left").select(
        "bucket", "label", F.coalesce("n", F.lit(0)).alias("hits")
    )


def hourly_volume(events: DataFrame, as_of, back: str = "24 hours", source: str = "SourceType") -> DataFrame:
    return (
        back_from(events, as_of, back)
        .groupBy(F.date_trunc("hour", "TimeGenerated").alias("hour"), source)
        .agg(F.count("*").alias("event_count"))
    )


def volume_levels(events: DataFrame, as_of, back: str = "24 hours", source: str = "SourceType") -> DataFrame:
    """Hour x source, per hour, per source and total, from one pass."""
    return (
        hourly_volume(events, as_of, back, source)
        .cube("hour", source)
        .agg(F.sum("event_count").alias("event_count"))
    )


def hit_timeline(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "severity").agg(
        F.count("*").alias("hits")
    )


def hit_timeline_matrix(hits: DataFrame, severities: list[str] = SEVERITIES) -> DataFrame:
    """One row per hour from the first to the last hit, one column per severity."""
    counted = hits.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in severities]
    )
    counted = checkpointed(counted)  # a row an hour; the hits are read once
    hours = counted.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour")
    )
    return hours.join(counted, "hour", "left").na.fill(0, severities)


def latency_millis() -> Column:
    return F.unix_millis("IngestTimestamp") - F.unix_millis("TimeGenerated")


def pipeline_latency(events: DataFrame, as_of, back: str = "24 hours", approximate: bool = False) -> DataFrame:
    """Average and 95th percentile of ingest minus event time, in seconds."""
    late = F.col("IngestTimestamp") >= F.col("TimeGenerated")
    rows = back_from(events, as_of, back).filter(late).select(latency_millis().alias("ms"))
    seconds = lambda col: F.round(col / 1000.0, 6)
    if approximate:
        return rows.agg(
            seconds(F.avg("ms")).alias("avg_seconds"),
            seconds(F.percentile_approx("ms", 0.95, 10000)).alias("p95_seconds"),
        )
    held = checkpointed(rows)  # one number an event; the table itself is scanned once
    mean, found = held.agg(F.avg("ms")).first()[0], percentiles(held, "ms", {"p95": 0.95})
    one = local_table(events.sparkSession, [(mean, found["p95"])], "mean_ms double, p95 double")
    return one.select(seconds(F.col("mean_ms")).alias("avg_seconds"), seconds(F.col("p95")).alias("p95_seconds"))



def source_stats(
    events: DataFrame, as_of, hours: int = 24, source: str = "SourceType"
) -> DataFrame:
    return (
        back_from(events, as_of, f"{hours} hours")
        .groupBy(source)
        .agg(
            F.max("TimeGenerated").alias("last_seen"),
            F.round(F.count("*") / F.lit(float(hours)), 6).alias("events_per_hour"),
            F.round(F.count_if(F.col("UnmappedFields") != "") * 100.0 / F.count("*"), 6).alias("unmapped_pct"),
        )
    )


def top_rules(hits: DataFrame, as_of, back: str = "24 hours", top: int = 20) -> DataFrame:
    return (
        hits.filter(since("created_at", as_of, back))
        .groupBy("rule_id", "severity")
        .agg(F.count("*").alias("hits"), F.max("anomaly_score").alias("max_score"))
        .orderBy(F.desc("hits"), "rule_id", "severity")
        .limit(top)
    )


def score_percentiles(hits: DataFrame, as_of, back: str = "24 hours") -> DataFrame:
    """95th and 99th percentile of the non-zero scores.

    Scores have four decimals, so the counted form holds at most 10,000 rows.
    """
    counted = (
        hits.filter(since("created_at", as_of, back) & (F.col("anomaly_score") > 0))
        .groupBy("anomaly_score")
        .agg(F.count("*").alias("n"))
    )
    at = lambda p: F.round(F.percentile("anomaly_score", p, F.col("n")), 6)
    return counted.agg(at(0.95).alias("p95"), at(0.99).alias("p99"))


def severity_breakdown(hits: DataFrame, as_of, back: str = "24 hours") -> DataFrame:
    return hits.filter(since("created_at", as_of, back)).groupBy("severity").agg(F.count("*").alias("hits"))


def ledger_totals(ledger: DataFrame, as_of, back: str = "24 hours") -> DataFrame:
    return (
        ledger.filter(since("forwarded_at", as_of, back))
        .groupBy("stream_tag")
        .agg(F.sum("event_count").alias("total"))
    )


def stats_bundle(events: DataFrame, hits: DataFrame, ledger: DataFrame, as_of, top: int = 20) -> DataFrame:
    """(section, entry): every aggregate of the summary as JSON text rows.

    Holds counts only, never the content of an event.  Each table is scanned once:
    events are counted by source over both horizons together, hits by rule,
    severity and score (which has four decimals), and the sections are made of
    these counts.
    """
    day = since("TimeGenerated", as_of, "24 hours")
    sources = checkpointed(
        back_from(events, as_of, "7 days").groupBy("SourceType").agg(F.count_if(day).alias("day"), F.count("*").alias("week"))
    )
    recent = since("created_at", as_of, "24 hours")
    score = F.when(recent, F.col("anomaly_score"))
    counted = checkpointed(
        hits.groupBy("rule_id", "severity", score.alias("score")).agg(F.count_if(recent).alias("n"), F.max("created_at").alias("last"))
    )
    found = counted.filter("n > 0")

    def by_source(column: str) -> DataFrame:
        rows = sources.filter(F.col(column) > 0).select("SourceType", F.col(column).alias("event_count"))
        return rows.orderBy(F.desc("event_count"), "SourceType").limit(top)

    at = lambda p: F.round(F.percentile("score", p, F.col("n")), 6)
    rules = found.groupBy("rule_id", "severity").agg(F.sum("n").alias("hits"), F.max("score").alias("max_score"))
    parts = {
        "events_24h_by_source": by_source("day"),
        "events_7d_by_source": by_source("week"),
        "top_hits_24h": rules.orderBy(F.desc("hits"), "rule_id", "severity").limit(top),
        "score_percentiles_24h": found.filter("score > 0").agg(at(0.95).alias("p95"), at(0.99).alias("p99")),
        "severity_24h": found.groupBy("severity").agg(F.sum("n").alias("hits")),
        "forwarded_24h": ledger_totals(ledger, as_of),
        "batch_marker": counted.agg(F.max("last").alias("last_batch_at")),
    }
    out = None
    for name, frame in parts.items():
        rows = frame.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("entry"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rule_rollup(hits: DataFrame) -> DataFrame:
    latest = F.struct("created_at", "hit_id")
    return hits.groupBy("rule_id").agg(
        F.sum("hit_count").alias("total_hits"),
        F.max_by("mitre_tag", latest).alias("mitre_tag"),
        F.max("created_at").alias("last_fired"),
    )


def rules_by_status(latest_states: DataFrame) -> DataFrame:
    return latest_states.groupBy("status").agg(F.count("*").alias("rules"))


def health_summary(health: DataFrame, as_of, back: str = "1 hour") -> DataFrame:
    return (
        health.filter(since("TimeGenerated", as_of, back))
        .groupBy("EventType", "Severity")
        .agg(F.count("*").alias("records"))
    )


def health_alert(health: DataFrame, failures: int = 3, event_type: str = "BatchFail") -> DataFrame:
    """Hours with at least ``failures`` failed batches."""
    return (
        health.filter(F.col("EventType") == event_type)
        .groupBy(F.date_trunc("hour", "TimeGenerated").alias("hour"))
        .agg(F.count("*").alias("failures"))
        .filter(F.col("failures") >= failures)
    )


ENTITY_COLUMNS = ["HostName", "SubjectUserName", "SrcIpAddr", "DstIpAddr", "ProcessImagePath"]


def distinct_entities(events: DataFrame, as_of, back: str = "24 hours", limit: int | None = None) -> DataFrame:
    """Distinct entity tuples of a window; ``limit`` gives only the first ones."""
    tuples = (
        events.filter(
            since("TimeGenerated", as_of, back)
            & ((F.col("HostName") != "") | (F.col("SubjectUserName") != "") | (F.col("SrcIpAddr") != ""))
        )
        .select(*ENTITY_COLUMNS)
        .distinct()
    )
    return tuples.orderBy(*ENTITY_COLUMNS).limit(limit) if limit else tuples


def pipeline_trend(events: DataFrame, source: str = "SourceType", hours: int = 24) -> DataFrame:
    """Per hour and source: volume, share without an event id, latency, and
    the moving average and change of the volume.

    Windows run over hourly rows, so a source has one row per hour.
    """
    hourly = events.groupBy(F.date_trunc("hour", "TimeGenerated").alias("hour"), source).agg(
        F.count("*").alias("events"),
        F.round(F.count_if(F.col("EventID") == 0) / F.count("*"), 6).alias("unparsed_share"),
        F.round(F.avg(latency_millis()) / 1000.0, 6).alias("avg_latency"),
    )
    order = W.partitionBy(source).orderBy("hour")
    return hourly.withColumns(
        {
            "moving_events": F.round(F.avg("events").over(order.rowsBetween(-(hours - 1), 0)), 6),
            "change": F.col("events") - F.lag("events").over(order),
        }
    )


def late_report(events: DataFrame, delay_ms: int = 300_000, source: str = "SourceType") -> DataFrame:
    """Events that arrived later than the watermark delay, per source."""
    late = latency_millis() > delay_ms
    return events.groupBy(source).agg(
        F.count_if(late).alias("late"),
        F.count("*").alias("events"),
        F.max(latency_millis()).alias("max_latency_ms"),
    )
