"""Ingest gates: tag, merge, route, size, rate, flood, overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import columns as c
from wardlight.operators.ordering import first_n, small_side
from wardlight.operators.timeslice import in_slice, moment

MAX_EVENT_BYTES = 65536
EVENTS_PER_MINUTE = 10000


def tag_provenance(
    df: DataFrame,
    transport: Column,
    channel: Column,
    received_at: str = "received_at",
) -> DataFrame:
    """Tag ``transport:channel:epoch`` and ingest time, overwriting content."""
    return df.withColumns(
        {
            "provenance_tag": F.concat_ws(
                ":", transport, channel, F.unix_seconds(F.col(received_at)).cast("string")
            ),
            "ingest_time": F.col(received_at),
        }
    )


def upload_tag(file_name: Column, received_at: Column, incident_id: Column | None = None) -> Column:
    """``manual-upload:{digest or incident:id}:{epoch}`` for an uploaded file."""
    scope = F.substring(F.sha2(file_name, 256), 1, 8)
    if incident_id is not None:
        scope = F.when(c.text(incident_id) != "", F.concat(F.lit("incident:"), incident_id)).otherwise(scope)
    return F.concat_ws(":", F.lit("manual-upload"), scope, F.unix_seconds(received_at).cast("string"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All tagged sources as one frame; a column a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def route_events(df: DataFrame, tag: str = "provenance_tag", flood: str = "flood_detected") -> DataFrame:
    """Add ``route``: ``flood``, ``normal``, or ``unrouted`` for an untagged event."""
    flooded = F.coalesce(F.col(flood), F.lit(False))
    return df.withColumn(
        "route",
        F.when(flooded, "flood")
        .when(F.col(tag).isNotNull() & F.col(flood).isNull(), "normal")
        .otherwise("unrouted"),
    )


def size_gate(df: DataFrame, payload: str = "payload", limit: int = MAX_EVENT_BYTES) -> DataFrame:
    """Add the serialised size and whether the event may pass."""
    size = F.octet_length(payload)
    return df.withColumns({"event_bytes": size, "accepted": size <= limit})


def size_rejects(gated: DataFrame, tag: str = "provenance_tag", at: str = "received_at") -> DataFrame:
    """Health rows for what the size gate refused, per source and hour."""
    return (
        gated.filter(~F.col("accepted"))
        .groupBy(c.source_type(F.col(tag)).alias("SourceId"), F.date_trunc("hour", at).alias("TimeGenerated"))
        .agg(F.count("*").alias("EventCount"), F.max("event_bytes").alias("max_bytes"))
        .select(
            "TimeGenerated",
            F.lit("EventSizeCap").alias("EventType"),
            F.lit("Warning").alias("Severity"),
            "SourceId",
            "EventCount",
            F.concat(F.lit("largest event: "), F.col("max_bytes").cast("string"), F.lit(" bytes")).alias("Detail"),
        )
    )


def parse_rejects(rejects: DataFrame, tag: str = "provenance_tag", at: str = "received_at") -> DataFrame:
    """Health rows for messages that could not be read, per source and hour."""
    return (
        rejects.groupBy(c.source_type(F.col(tag)).alias("SourceId"), F.date_trunc("hour", at).alias("TimeGenerated"), "reason")
        .agg(F.count("*").alias("EventCount"), F.min("id").alias("first_id"))
        .select(
            "TimeGenerated",
            F.col("reason").alias("EventType"),
            F.lit("Warning").alias("Severity"),
            "SourceId",
            "EventCount",
            F.concat(F.lit("first message: "), F.coalesce("first_id", F.lit(""))).alias("Detail"),
        )
    )


def rate_limit(
    df: DataFrame,
    limit: int = EVENTS_PER_MINUTE,
    tag: str = "provenance_tag",
    at: str = "received_at",
    key: str = "id",
    window: str = "60 seconds",
) -> DataFrame:
    """The first ``limit`` events per source type and fixed window.

    Only windows that exceed the limit are ranked.  The counting pass reads
    two columns; everything in a quiet window passes without a shuffle of its
    payload, and a flooded window is ranked in salted parts.
    """
    keyed = df.withColumns(
        {"_source": c.source_type(F.col(tag)), "_window": F.window(F.col(at), window).start}
    )
    over = small_side(
        keyed.groupBy("_source", "_window")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > limit)
        .select("_source", "_window", F.lit(True).alias("_flooded"))
    )
    marked = keyed.join(over, ["_source", "_window"], "left")
    quiet = marked.filter(F.col("_flooded").isNull())
    capped = first_n(
        marked.filter("_flooded"),
        ["_source", "_window"],
        [F.col(at), F.col(key)],
        limit,
        spread_by=F.col(key),
    )
    return quiet.unionByName(capped).select(*df.columns)


def flood_heuristic(
    df: DataFrame,
    threshold: int,
    tag: str = "provenance_tag",
    at: str = "received_at",
    slide: int | None = None,
    window: int = 60,
) -> DataFrame:
    """One health row per source and minute above ``threshold``.

    ``Error`` above five times the threshold, else ``Warning``.  With
    ``slide`` (seconds, dividing the window) the window slides; the counts are
    folded to slide-wide steps before they are spread over the windows.
    """
    step = slide or window
    counts = df.groupBy(
        c.source_type(F.col(tag)).alias("SourceId"),
        F.window(F.col(at), f"{step} seconds").start.alias("_step"),
    ).agg(F.count("*").alias("_n"))
    if slide:
        offsets = F.sequence(F.lit(0), F.lit(window - step), F.lit(step))
        counts = (
            counts.withColumn("_back", F.explode(offsets))
            .withColumn("_step", F.timestamp_seconds(F.unix_seconds("_step") - F.col("_back")))
            .groupBy("SourceId", "_step")
            .agg(F.sum("_n").alias("_n"))
        )
    return flood_records(counts.filter(F.col("_n") > threshold), threshold)


def flood_records(counts: DataFrame, threshold: int) -> DataFrame:
    """Health layout for (SourceId, _step, _n) rows above the threshold."""
    return counts.select(
        F.col("_step").alias("TimeGenerated"),
        F.lit("FloodHeuristic").alias("EventType"),
        F.when(F.col("_n") > 5 * threshold, "Error").otherwise("Warning").alias("Severity"),
        "SourceId",
        F.col("_n").alias("EventCount"),
        F.concat(F.lit("Ingest rate above threshold for source "), F.col("SourceId")).alias("Detail"),
    )


def overlap_pull(
    df: DataFrame, last_end, end, overlap: str = "5 minutes", at: str = "TimeGenerated"
) -> DataFrame:
    """Rows of ``[last_end - overlap, end)``; the overlap is removed by dedup."""
    return in_slice(df, moment(last_end) - F.expr(f"interval {overlap}"), end, at)


def pull_slices(
    df: DataFrame, rows_per_query: int = 10000, at: str = "TimeGenerated", step: str = "1 hour"
) -> DataFrame:
    """How many sub-queries each time step needs to stay under the row limit."""
    return (
        df.groupBy(F.window(F.col(at), step).start.alias("slice_start"))
        .agg(F.count("*").alias("rows"))
        .withColumn("queries", F.ceil(F.col("rows") / rows_per_query))
    )

