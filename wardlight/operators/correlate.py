"""Correlation over time: thresholds, sequences, spread, two-source joins.

Entities can be hot: a scanner may own a third of the events.  So no job here
sends an entity to one task, and none emits pairs.  Events are first folded to
one row per (entity, millisecond, ...), then laid out in time buckets.  A
bucket also receives the rows of its neighbours that lie within the span
(``context`` rows), so every window is complete inside its own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.operators.ordering import first_per_key
from wardlight.session import checkpointed

# Width of a time bucket in spans.  Narrow buckets split a busy entity further;
# at most one row in this many is copied to a neighbour.
BUCKET_SPANS = 4


def _millis(at: str) -> Column:
    return F.unix_millis(F.col(at))


def in_buckets(df: DataFrame, ms: str, span_ms: int, before: bool, after: bool) -> DataFrame:
    """Copy rows into the buckets that need them; adds ``_bucket``, ``_own``.

    ``before``: a bucket needs rows up to one span before its start;
    ``after``: rows up to one span past its end.
    """
    width = span_ms * BUCKET_SPANS
    at = F.col(ms)
    own = F.floor(at / width)
    places = [own]
    if before:
        places.append(F.when((own + 1) * width - at <= span_ms, own + 1))
    if after:
        places.append(F.when(at - own * width <= span_ms, own - 1))
    return df.select(
        *df.columns, own.alias("_home"), F.explode(F.array_compact(F.array(*places))).alias("_bucket")
    ).withColumn("_own", F.col("_bucket") == F.col("_home")).drop("_home")


def threshold_tumbling(
    events: DataFrame, entity: str, count: int, window: str, at: str = "TimeGenerated"
) -> DataFrame:
    """Entities with at least ``count`` events in a fixed window."""
    frame = F.window(at, window)
    return (
        events.filter(F.col(entity) != "")
        .groupBy(F.col(entity).alias("entity"), frame.start.alias("window_start"))
        .agg(F.count("*").alias("events"))
        .filter(F.col("events") >= count)
    )


def threshold_sliding(
    events: DataFrame,
    entity: str,
    count: int,
    window_seconds: int,
    step_seconds: int,
    at: str = "TimeGenerated",
) -> DataFrame:
    """As above with a sliding window; counts are folded to steps first."""
    steps = (
        events.filter(F.col(entity) != "")
        .groupBy(F.col(entity).alias("entity"), F.window(at, f"{step_seconds} seconds").start.alias("step"))
        .agg(F.count("*").alias("n"))
    )
    back = F.explode(F.sequence(F.lit(0), F.lit(window_seconds - step_seconds), F.lit(step_seconds)))
    return (
        steps.withColumn("back", back)
        .groupBy("entity", F.timestamp_seconds(F.unix_seconds("step") - F.col("back")).alias("window_start"))
        .agg(F.sum("n").alias("events"))
        .filter(F.col("events") >= count)
    )


def threshold_exact(
    events: DataFrame, entity: str, count: int, span_ms: int, at: str = "TimeGenerated"
) -> DataFrame:
    """Moments at which an entity has ``count`` events in the span before it.

    One row per (entity, moment), with the number of events in
    ``[moment - span, moment]``.  The number is a running sum of arrivals
    minus departures, one step per row whatever the span holds.
    """
    folded = (
        events.filter(F.col(entity) != "")
        .groupBy(F.col(entity).alias("entity"), _millis(at).alias("ms"))
        .agg(F.count("*").alias("n"))
    )
    placed = in_buckets(folded, "ms", span_ms, before=True, after=False)
    steps = placed.select(
        "entity",
        "_bucket",
        F.explode(
            F.array(
                F.struct(F.col("ms").alias("ms"), F.col("n").alias("n"), F.col("_own").alias("_own")),
                F.struct(
                    (F.col("ms") + span_ms + 1).alias("ms"), (-F.col("n")).alias("n"), F.lit(False).alias("_own")
                ),
            )
        ).alias("step"),
    ).select("entity", "_bucket", "step.*")
    # Departures sort first within a millisecond: n is negative.
    running = (
        W.partitionBy("entity", "_bucket").orderBy("ms", "n").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        steps.withColumn("events", F.sum("n").over(running))
        .filter(F.col("_own") & (F.col("events") >= count))
        .select("entity", F.timestamp_millis("ms").alias("moment"), "events")
    )


def sequence_next(
    events: DataFrame,
    first: Column,
    second: Column,
    entity: str,
    span_ms: int,
    at: str = "TimeGenerated",
    key: str = "EventRecordID",
) -> DataFrame:
    """``first`` followed by ``second`` on the same entity within the span.

    One row per entity and moment of a first event: how many first events
    there are, the least record id, and the earliest later second event.
    """
    relevant = events.filter((first | second) & (F.col(entity) != ""))
    folded = relevant.groupBy(F.col(entity).alias("entity"), _millis(at).alias("ms")).agg(
        F.count_if(first).alias("first_events"),
        F.min(F.when(first, F.col(key))).alias("first_id"),
        F.min(F.when(second, F.col(key))).alias("next_id"),
    )
    placed = in_buckets(folded, "ms", span_ms, before=False, after=True)
    later = (
        W.partitionBy("entity", "_bucket").orderBy(F.col("ms").desc()).rowsBetween(W.unboundedPreceding, -1)
    )
    follow = F.when(F.col("next_id").isNotNull(), F.struct("ms", "next_id"))
    return (
        placed.withColumn("_next", F.last(follow, ignorenulls=True).over(later))
        .filter(
            F.col("_own") & (F.col("first_events") > 0) & (F.col("_next.ms") - F.col("ms") <= span_ms)
        )
        .select(
            "entity",
            F.timestamp_millis("ms").alias("first_at"),
            "first_events",
            "first_id",
            F.timestamp_millis("_next.ms").alias("next_at"),
            F.col("_next.next_id").alias("next_id"),
        )
    )


def sequence_diff_host(
    events: DataFrame,
    condition: Column,
    entity: str,
    span_ms: int,
    host: str = "HostName",
    at: str = "TimeGenerated",
) -> DataFrame:
    """An entity seen on one host and within the span on another.

    One row per (entity, moment, host) with the next moment and host.  Rows of
    an entity are ordered by (moment, host); the next other host is the start
    of the next run of equal hosts, so a change marker is enough.
    """
    folded = (
        events.filter(condition & (F.col(entity) != "") & (F.col(host) != ""))
        .groupBy(F.col(entity).alias("entity"), _millis(at).alias("ms"), F.col(host).alias("host"))
        .agg(F.count("*").alias("events"))
    )
    placed = in_buckets(folded, "ms", span_ms, before=False, after=True)
    forward = W.partitionBy("entity", "_bucket").orderBy("ms", "host")
    marked = placed.withColumn(
        "_change",
        F.when(F.lag("host").over(forward) != F.col("host"), F.struct("ms", "host")),
    )
    later = (
        W.partitionBy("entity", "_bucket")
        .orderBy(F.col("ms").desc(), F.col("host").desc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        marked.withColumn("_next", F.last("_change", ignorenulls=True).over(later))
        .filter(F.col("_own") & (F.col("_next.ms") - F.col("ms") <= span_ms))
        .select(
            "entity",
            F.timestamp_millis("ms").alias("first_at"),
            F.col("host").alias("first_host"),
            "events",
            F.timestamp_millis("_next.ms").alias("next_at"),
            F.col("_next.host").alias("next_host"),
        )
    )


def fanout(
    events: DataFrame,
    entity: str,
    target: str,
    threshold: int,
    window: str,
    at: str = "TimeGenerated",
    approximate: bool = False,
) -> DataFrame:
    """Distinct targets an entity reached in a window, at or above a threshold.

    The exact form folds to distinct (entity, window, target) before counting.
    """
    start = F.window(at, window).start.alias("window_start")
    rows = events.filter((F.col(entity) != "") & (F.col(target) != ""))
    if approximate:
        counted = rows.groupBy(F.col(entity).alias("entity"), start).agg(
            F.approx_count_distinct(target).alias("targets")
        )
    else:
        counted = (
            rows.select(F.col(entity).alias("entity"), start, target)
            .distinct()
            .groupBy("entity", "window_start")
            .agg(F.count("*").alias("targets"))
        )
    return counted.filter(F.col("targets") >= threshold)


# Logon type -> destination port of the matching flow.
LATERAL_PORTS = {3: 445, 10: 3389}


def lateral_movement(
    events: DataFrame,
    span_ms: int,
    flow: Column | None = None,
    ports: dict[int, int] = LATERAL_PORTS,
    at: str = "TimeGenerated",
) -> DataFrame:
    """Logons with a flow from the same address to the matching port in time.

    One row per (address, logon type, moment): number of logons, number of
    flows within ``span`` on either side, and the nearest flow before and
    after.  The flow count is a running sum of flows entering and leaving the
    span, so an address with many flows costs one step per row.
    """
    is_flow = F.col("SourceType") == "netflow" if flow is None else flow
    is_logon = (F.col("EventID") == 4624) & F.col("LogonType").isin(*ports) & ~is_flow
    port_of = F.create_map(*[F.lit(x) for pair in ports.items() for x in pair])
    relevant = events.filter(
        (F.col("SrcIpAddr") != "") & (is_logon | (is_flow & F.col("DstPort").isin(*ports.values())))
    )
    folded = relevant.groupBy(
        F.col("SrcIpAddr").alias("address"),
        F.when(is_logon, F.element_at(port_of, F.col("LogonType"))).otherwise(F.col("DstPort")).alias("port"),
        _millis(at).alias("ms"),
    ).agg(F.count_if(is_logon).alias("logons"), F.count_if(is_flow).alias("flows"))
    placed = in_buckets(folded, "ms", span_ms, before=True, after=True)
    keys = ["address", "port", "_bucket"]

    def step(ms: Column, change: Column, row: bool) -> Column:
        own = F.col("_own") & (F.col("logons") > 0) if row else F.lit(False)
        return F.struct(
            ms.alias("at"),
            change.alias("change"),
            own.alias("_is_row"),
            F.when(F.lit(row) & (F.col("flows") > 0), F.col("ms")).alias("flow_ms"),
            F.col("logons").alias("logons"),
        )

    zero = F.lit(0).cast("bigint")
    steps = placed.select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    step(F.col("ms"), zero, True),
                    F.when(F.col("flows") > 0, step(F.col("ms") - span_ms, F.col("flows"), False)),
                    F.when(F.col("flows") > 0, step(F.col("ms") + span_ms + 1, -F.col("flows"), False)),
                )
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    # Within a millisecond: flows enter and leave before the row itself is read.
    rank = F.when(F.col("change") != 0, 0).otherwise(1)
    forward = W.partitionBy(*keys).orderBy("at", rank).rowsBetween(W.unboundedPreceding, 0)
    backward = (
        W.partitionBy(*keys).orderBy(F.col("at").desc(), rank.desc()).rowsBetween(W.unboundedPreceding, 0)
    )
    type_of = F.create_map(*[F.lit(x) for logon, p in ports.items() for x in (p, logon)])
    before = F.when(F.col("at") - F.col("_before") <= span_ms, F.col("_before"))
    after = F.when(F.col("_after") - F.col("at") <= span_ms, F.col("_after"))
    return (
        steps.withColumns(
            {
                "flows": F.sum("change").over(forward),
                "_before": F.last("flow_ms", ignorenulls=True).over(forward),
                "_after": F.last("flow_ms", ignorenulls=True).over(backward),
            }
        )
        .filter(F.col("_is_row") & (F.col("flows") > 0))
        .select(
            "address",
            F.element_at(type_of, F.col("port")).alias("logon_type"),
            F.timestamp_millis("at").alias("logon_at"),
            "logons",
            "flows",
            F.timestamp_millis(before).alias("flow_before"),
            F.timestamp_millis(after).alias("flow_after"),
        )
    )


def new_source(
    events: DataFrame,
    as_of,
    entity: str = "SubjectUserName",
    address: str = "SrcIpAddr",
    recent: str = "1 hour",
    baseline: str = "30 days",
    at: str = "TimeGenerated",
) -> DataFrame:
    """Recent (entity, address) pairs that the baseline before does not hold.

    Recent and baseline are split out of one pass: per pair, the first recent
    event and whether the baseline saw it.
    """
    end = F.lit(as_of).cast("timestamp")
    cut = end - F.expr(f"interval {recent}")
    rows = events.filter(
        (F.col(at) >= end - F.expr(f"interval {baseline}"))
        & (F.col(at) < end)
        & (F.col(entity) != "")
        & (F.col(address) != "")
    )
    is_recent = F.col(at) >= cut
    return (
        rows.groupBy(F.col(entity).alias("entity"), F.col(address).alias("address"))
        .agg(
            F.count_if(is_recent).alias("events"),
            F.min(F.when(is_recent, F.col(at))).alias("first_seen"),
            F.count_if(~is_recent).alias("_known"),
        )
        .filter((F.col("events") > 0) & (F.col("_known") == 0))
        .select("entity", "address", "first_seen", "events")
    )


def new_source_days(
    events: DataFrame,
    entity: str,
    address: str = "SrcIpAddr",
    baseline_days: int = 30,
    at: str = "TimeGenerated",
) -> DataFrame:
    """Rolling form: (entity, day, new_addresses) over the whole history.

    An address is new on a day when the entity did not use it in the
    ``baseline_days`` before, though the entity was active in that time.
    """
    pairs = (
        events.filter((F.col(entity) != "") & (F.col(address) != ""))
        .select(F.col(entity).alias("entity"), F.col(address).alias("address"), F.to_date(at).alias("day"))
        .distinct()
    )
    return fresh_addresses(pairs, ["entity"], baseline_days)


def fresh_addresses(pairs: DataFrame, keys: list[str], baseline_days: int) -> DataFrame:
    """(keys, day, new_addresses) from distinct (keys, address, day) rows.

    The pairs are read twice, so they are written out once: the events behind
    them are scanned once.
    """
    held = checkpointed(pairs)
    seen = F.lag("day").over(W.partitionBy(*keys, "address").orderBy("day"))
    fresh = (
        held.withColumn("_seen", seen)
        .filter(F.col("_seen").isNull() | (F.date_diff("day", "_seen") > baseline_days))
        .groupBy(*keys, "day")
        .agg(F.count("*").alias("new_addresses"))
    )
    history = F.lag("day").over(W.partitionBy(*keys).orderBy("day"))
    known = (
        held.select(*keys, "day")
        .distinct()
        .withColumn("_prior", history)
        .filter(F.date_diff("day", "_prior") <= baseline_days)
        .select(*keys, "day")
    )
    return fresh.join(known, [*keys, "day"], "left_semi")


def entity_state(
    events: DataFrame, first: Column, rule_id: str, entity: str, span_ms: int, at: str = "TimeGenerated"
) -> DataFrame:
    """Partial matches as state rows (rule, entity, start, count, expiry)."""
    rows = events.filter(first & (F.col(entity) != "")).groupBy(
        F.col(entity).alias("entity_key"), F.window(at, f"{span_ms} milliseconds").start.alias("window_start")
    ).agg(F.count("*").alias("event_count"))
    return rows.select(
        F.lit(rule_id).alias("rule_id"),
        "entity_key",
        "window_start",
        "event_count",
        F.timestamp_millis(F.unix_millis("window_start") + span_ms).alias("expiry"),
    )


def latest_per_key(changes: DataFrame, keys: list[str], at: str = "updated_at", tie: list[str] | None = None) -> DataFrame:
    """The latest row per key of an append-only change log."""
    order = [F.col(at).desc(), *[F.col(t).desc() for t in tie or []]]
    return first_per_key(changes, keys, order)
