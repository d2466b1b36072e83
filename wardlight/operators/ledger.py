"""Forwarding, reconciliation, retention and rule-state ledgers."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight import schema as s
from wardlight.functions import columns as c
from wardlight.operators.correlate import latest_per_key
from wardlight.operators.normalize import lookup
from wardlight.operators.ordering import first_per_key, with_previous, with_running
from wardlight.operators.timeslice import in_slice, in_slices
from wardlight.session import checkpointed

FORWARD_BATCH = 200
PACK_ROWS = 500
PACK_BYTES = 1_000_000

# Hit severity (lower case) -> severity of the record.
RECORD_SEVERITY = {
    "critical": "Critical",
    "high": "High",
    "medium": "Medium",
    "low": "Low",
    "informational": "Low",
}
HIGH_STATUSES = ["production", "disabled"]


def _mapped(values: dict, key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


# -- delivery ---------------------------------------------------------------


def forwardable(hits: DataFrame, rule_states: DataFrame) -> DataFrame:
    """Hits of rules whose latest status is production."""
    live = rule_states.filter(F.col("status") == "production").select("rule_id")
    return hits.join(live, "rule_id", "left_semi")


def undelivered(hits: DataFrame, delivered: DataFrame) -> DataFrame:
    """Marking a hit delivered is appending its id to ``delivered``."""
    return hits.join(delivered.select("hit_id"), "hit_id", "left_anti")


def pending_batches(hits: DataFrame, size: int = FORWARD_BATCH) -> DataFrame:
    """All unforwarded hits, oldest first, with their batch number from 0."""
    waiting = hits.filter(F.col("forwarded_at").isNull()).select(
        "hit_id", "rule_id", "severity", "hit_count", "created_at"
    )
    numbered = with_running(waiting, [], ["created_at", "hit_id"], number="position")
    return numbered.withColumn("batch_no", F.floor((F.col("position") - 1) / size))


def security_records(hits: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Hit -> security record with a JSON detail.

    With ``evidence`` (the chunks of :func:`rules.evidence_chunks`) a hit gives
    one record for each chunk of its ids, told apart by ``part`` in the detail.
    Without it a hit whose ids are kept in chunks is an error, so no record goes
    out without its ids.
    """
    if evidence is not None:
        parts = evidence.select("rule_id", "batch_start", F.col("chunk").alias("part"), F.col("ids").alias("_ids"))
        hits = hits.join(parts, ["rule_id", "batch_start"]).withColumn("event_record_ids", F.col("_ids"))
    else:
        missing = F.raise_error(F.lit("ids of this hit are in its evidence chunks; pass them"))
        listed = F.when(F.col("event_record_ids").isNull(), missing.cast("array<string>")).otherwise(F.col("event_record_ids"))
        hits = hits.withColumns({"part": F.lit(0), "event_record_ids": listed})
    severity = F.lower(c.text(F.col("severity")))
    detail = F.to_json(
        F.struct(
            "hit_id",
            "hit_count",
            "part",
            c.time_text(F.col("batch_start")).alias("batch_start"),
            c.time_text(F.col("batch_end")).alias("batch_end"),
            "anomaly_score",
            "mitre_tag",
        )
    )
    return hits.select(
        F.col("created_at").alias("TimeGenerated"),
        F.col("rule_id").alias("RuleId"),
        F.col("rule_version").alias("RuleVersion"),
        F.lit("DetectionHit").alias("EventType"),
        F.lit("").alias("Entity"),
        F.to_json("event_record_ids").alias("SourceEventIds"),
        _mapped(RECORD_SEVERITY, severity, "Low").alias("Severity"),
        detail.alias("Detail"),
        F.col("mitre_tag").alias("ATTACKTechnique"),
    )


def incident_fingerprint() -> Column:
    """SHA-256 over rule and the digest of its record ids."""
    return F.sha2(F.concat_ws("|", "rule_id", "ids_digest"), 256)


def incidents(
    hits: DataFrame,
    known: DataFrame | None = None,
    look_back: str = "24 hours",
    owner: str = "pipeline",
) -> DataFrame:
    """One incident per fingerprint of the high hits.

    ``known`` (fingerprint, created_at) holds incidents already opened; one
    opened within ``look_back`` before the hit suppresses it.
    """
    high = hits.filter(F.lower("severity").isin("high", "critical")).withColumn(
        "fingerprint", incident_fingerprint()
    )
    fresh = first_per_key(high, ["fingerprint"], [F.col("created_at"), F.col("hit_id")])
    if known is not None:
        seen = known.groupBy("fingerprint").agg(F.max("created_at").alias("_opened"))
        fresh = (
            fresh.join(seen, "fingerprint", "left")
            .filter(
                F.col("_opened").isNull()
                | (F.col("_opened") < F.col("created_at") - F.expr(f"interval {look_back}"))
            )
            .drop("_opened")
        )
    return fresh.select(
        "fingerprint",
        F.concat(F.lit("Detection: "), F.col("rule_id")).alias("title"),
        "severity",
        "rule_id",
        "rule_version",
        "hit_id",
        "hit_count",
        "mitre_tag",
        "created_at",
        F.lit(owner).alias("owner"),
        F.lit("open").alias("status"),
    )


def new_evidence(matches: DataFrame, earlier: DataFrame) -> DataFrame:
    """Matches not seen under the same (rule, record id) in the look-back."""
    keys = ["rule_id", "EventRecordID"]
    return matches.join(earlier.select(*keys).distinct(), keys, "left_anti")


def incident_evidence(incident_list: DataFrame, events: DataFrame) -> DataFrame:
    """Event count, first and last event, hosts and users per incident.

    The incident id is part of the upload tag.  Events are folded per incident, host
    and user before anything is counted twice or joined, so a large incident is never
    shuffled row by row.
    """
    tag = F.col("ProvenanceTag")
    rolled = (
        events.filter(tag.startswith("manual-upload:incident:"))
        .withColumn("incident_id", F.split_part(tag, F.lit(":"), F.lit(3)))
        .groupBy("incident_id", "HostName", "SubjectUserName")
        .agg(F.count("*").alias("n"), F.min("TimeGenerated").alias("first"), F.max("TimeGenerated").alias("last"))
        .groupBy("incident_id")
        .agg(
            F.sum("n").alias("event_count"),
            F.min("first").alias("first_event"),
            F.max("last").alias("last_event"),
            F.count_distinct("HostName").alias("hosts"),
            F.count_distinct("SubjectUserName").alias("users"),
        )
    )
    return incident_list.join(rolled, "incident_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in ("event_count", "hosts", "users")}
    )


def list_incidents(
    incident_list: DataFrame,
    severity: str | None = None,
    status: str | None = None,
    name_like: str | None = None,
    sort_by: str = "created_at",
    descending: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Filtered and sorted incident listing; severity sorts by rank."""
    rows = incident_list
    if severity:
        rows = rows.filter(F.lower("severity") == severity.lower())
    if status:
        rows = rows.filter(F.col("status") == status)
    if name_like:
        rows = rows.filter(F.lower("name").contains(name_like.lower()))
    keys = {
        "severity": _mapped_rank(),
        "name": F.lower("name"),
        "event_count": F.col("event_count"),
        "created_at": F.col("created_at"),
        "updated_at": F.col("updated_at"),
    }
    key = keys.get(sort_by, keys["created_at"])
    ordered = rows.orderBy(key.desc() if descending else key.asc(), "incident_id")
    return ordered.limit(limit) if limit else ordered


def _mapped_rank() -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in s.SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower("severity")), F.lit(0))


def enrich_event_desc(events: DataFrame) -> DataFrame:
    """Add the description of the event id, null when there is none."""
    table = lookup(events.sparkSession, s.EVENT_DESCRIPTIONS, "EventID long, EventDescription string")
    return events.join(F.broadcast(table), "EventID", "left")


# -- reconciliation ---------------------------------------------------------


def reconcile_counts(
    local: DataFrame, received: DataFrame, share: float = 0.05, floor: int = 50
) -> DataFrame:
    """Local against received counts per batch and stream, both directions.

    Inputs hold (batch_id, stream_tag, event_count), any number of rows each.
    """
    keys = ["batch_id", "stream_tag"]
    left = local.groupBy(*keys).agg(F.sum("event_count").alias("local_count"))
    right = received.groupBy(*keys).agg(F.sum("event_count").alias("received_count"))
    both = left.join(right, keys, "full_outer").na.fill(0, ["local_count", "received_count"])
    delta = F.col("local_count") - F.col("received_count")
    limit = F.greatest(F.col("local_count") * share, F.lit(float(floor)))
    return both.withColumns({"delta": delta, "lost": delta > limit, "surplus": -delta > limit})


def ledger_delta_records(reconciled: DataFrame, at: Column) -> DataFrame:
    """A security record for every batch that lost events."""
    return reconciled.filter("lost").select(
        at.alias("TimeGenerated"),
        F.lit("SELF-005").alias("RuleId"),
        F.lit("LedgerDelta").alias("EventType"),
        F.lit("High").alias("Severity"),
        F.to_json(F.struct("batch_id", "stream_tag", "local_count", "received_count", "delta")).alias("Detail"),
    )


def reconcile_stages(
    accepted: DataFrame, stored: DataFrame, key: str = "EventRecordID", at: str = "received_at"
) -> DataFrame:
    """Accepted, stored and lost record ids per source and hour.

    Both sides are folded to one row per id first: copies of an id must not
    pile up in the join.
    """
    want = accepted.groupBy(key, c.source_type(F.col("provenance_tag")).alias("source")).agg(
        F.min(at).alias("_first")
    )
    have = stored.select(key).distinct().withColumn("_stored", F.lit(1))
    return (
        want.join(have, key, "left")
        .groupBy("source", F.date_trunc("hour", "_first").alias("hour"))
        .agg(
            F.count("*").alias("accepted"),
            F.count("_stored").alias("stored"),
            (F.count("*") - F.count("_stored")).alias("lost"),
        )
    )


# -- batches ----------------------------------------------------------------


def forward_ledger(
    sent: DataFrame, batch: str = "batch_id", stream: str = "stream_tag", key: str = "EventRecordID"
) -> DataFrame:
    """One row per batch and stream with counts, bounds and end ids."""
    first = F.struct("TimeGenerated", F.col(key))
    return sent.groupBy(batch, stream).agg(
        F.count("*").alias("event_count"),
        F.min("TimeGenerated").alias("batch_start"),
        F.max("TimeGenerated").alias("batch_end"),
        F.min(first)[key].alias("first_event_uid"),
        F.max(first)[key].alias("last_event_uid"),
    )


def pack_batches(
    events: DataFrame,
    stream: str,
    size: str,
    order: list[str],
    max_rows: int = PACK_ROWS,
    max_bytes: int = PACK_BYTES,
    largest_event: int = 65536,
) -> DataFrame:
    """First-in-first-out batches under both limits, from running totals.

    A batch ends when either the running row count or the running byte count
    of its stream enters a new slot.  A slot holds events that *start* in it,
    so the byte slot is narrowed by the largest event a gate lets through:
    then no batch exceeds ``max_bytes``.  Adds ``batch_key``.
    """
    if max_bytes <= largest_event:
        raise ValueError("max_bytes must exceed the largest event")
    slot = max_bytes - largest_event
    placed = with_running(events, [stream], order, number="_position", sums={"_through": size})
    started = F.col("_through") - F.col(size)
    return placed.withColumn(
        "batch_key",
        F.concat_ws(
            "-",
            F.floor((F.col("_position") - 1) / max_rows).cast("string"),
            F.floor(started / slot).cast("string"),
        ),
    ).drop("_position", "_through")


def pack_batches_greedy(
    events: DataFrame,
    stream: str,
    size: str,
    order: list[str],
    max_rows: int = PACK_ROWS,
    max_bytes: int = PACK_BYTES,
    segment_rows: int = 50_000,
) -> DataFrame:
    """Batches closed by whichever limit is reached first, over the whole stream.

    That rule is sequential, so each stream is cut into segments of
    ``segment_rows`` events.  For each event that may be the first of a segment
    to start a batch (one of the first ``max_rows``), the segment's summary
    tells where the first batch of a later segment then starts, and how many
    batches start in between.  Summaries are composed in pairs, pairs of pairs and
    so on, which takes as many rounds as the number of segments has binary digits;
    the way back gives every segment its entry, and each numbers its batches on
    its own.  Batches may span segments, and ``segment_rows`` decides nothing but
    ``segment``.  A task holds one segment (of ``max_rows`` events at least) and
    the ``max_rows`` events after it, or two summaries.
    Returns (stream, segment, batch_no, key order columns, size).
    """
    # A stream without a name is a stream too.
    name = F.coalesce(F.concat(F.lit("="), F.col(stream).cast("string")), F.lit("")).alias("_stream")
    numbered = with_running(events.select(stream, size, *order, name), ["_stream"], order, number="_position")
    rows = segment_rows * -(-max(max_rows, 1) // segment_rows)  # a batch reaches into the next segment at most
    at = F.col("_position") - 1
    segmented = numbered.withColumns({"segment": F.floor(at / segment_rows), "_part": F.floor(at / rows)})

    def next_starts(sizes: np.ndarray) -> np.ndarray:
        """For each event the place of the first event after a batch that starts with it."""
        if (sizes < 0).any():
            raise ValueError("sizes must not be negative")
        through = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(sizes))
        fits = np.searchsorted(through, through[:-1] + max_bytes, side="right") - 1
        return np.maximum(at + 1, np.minimum(at + max_rows, fits))

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_position")
        own, first = int(part["_owner"].iloc[0]), int(part["_position"].iloc[0])
        held = int((part["_part"] == own).sum())
        leave = next_starts(part["_size"].to_numpy(np.int64))[:held]
        batches = np.ones(held, np.int64)
        inside = np.flatnonzero(leave < held)
        while len(inside):  # twice as many batches ahead each time
            to = leave[inside]
            leave[inside], batches[inside] = leave[to], batches[inside] + batches[to]
            inside = inside[leave[inside] < held]
        leave, batches = leave[: max(max_rows, 1)], batches[: max(max_rows, 1)]
        runs = np.concatenate([[True], (np.diff(leave) != 0) | (np.diff(batches) != 0)])
        return pd.DataFrame(
            {
                "_stream": part["_stream"].iloc[:1].to_numpy(),
                "_part": [own],
                "_first": [first],
                "_held": [held],
                "_from": [np.flatnonzero(runs)],
                "_leave": [leave[runs] + first],
                "_batches": [batches[runs]],
            }
        )

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_position")
        follow = next_starts(part[size].to_numpy(np.int64))
        starts = np.zeros(len(part), np.int64)
        place = int(part["_entry"].iloc[0] - part["_position"].iloc[0])
        while place < len(part):
            starts[place] = 1
            place = int(follow[place])
        return part.assign(batch_no=int(part["_batch"].iloc[0]) - 1 + np.cumsum(starts))

    # The first events of a part are read with the part before, whose last batch may take them.
    reach = (at % rows < max_rows - 1) & (F.col("_part") > 0)
    owners = F.when(reach, F.array(F.col("_part") - 1, "_part")).otherwise(F.array("_part"))
    narrow = segmented.select("_stream", "_part", "_position", F.col(size).alias("_size"), F.explode(owners).alias("_owner"))
    summaries = checkpointed(narrow.groupBy("_stream", "_owner").applyInPandas(summarise, _SUMMARY))
    entered = segmented.join(_entries(summaries), ["_stream", "_part"])
    schema = T.StructType([*entered.schema.fields, T.StructField("batch_no", T.LongType())])
    packed = entered.groupBy("_stream", "_part").applyInPandas(pack, schema)
    return packed.drop("_stream", "_part", "_position", "_entry", "_batch")


_SUMMARY = "_stream string, _part long, _first long, _held long, _from array<long>, _leave array<long>, _batches array<long>"
_ENTRY = "_stream string, _part long, _entry long, _batch long"


def _through(part, entry: int, batch: int) -> tuple[int, int]:
    """Where a batch that starts at ``entry`` leaves a summarised part, and the number of the next one."""
    if entry >= part._first + part._held:
        return entry, batch
    run = int(np.searchsorted(part._from, entry - part._first, side="right")) - 1
    return int(part._leave[run]), batch + int(part._batches[run])


def _entries(summaries: DataFrame) -> DataFrame:
    """(_stream, _part, _entry, _batch): the first batch start of every part, by a prefix scan over summaries."""

    def compose(pair: pd.DataFrame) -> pd.DataFrame:
        """Two neighbours as one part; entries are those of the first."""
        rows = [SimpleNamespace(**r) for r in pair.sort_values("_part").to_dict("records")]
        first = rows[0]
        left = [_through(rows[-1], int(e), int(b)) if len(rows) > 1 else (int(e), int(b)) for e, b in zip(first._leave, first._batches)]
        return pd.DataFrame(
            {
                "_stream": [first._stream],
                "_part": [first._part // 2],
                "_first": [first._first],
                "_held": [sum(r._held for r in rows)],
                "_from": [first._from],
                "_leave": [[e for e, _ in left]],
                "_batches": [[b for _, b in left]],
            }
        )

    def enter(parts: pd.DataFrame) -> pd.DataFrame:
        """Entries of two neighbours from that of the part they make up."""
        rows = [SimpleNamespace(**r) for r in parts.sort_values("_part").to_dict("records")]
        entry, batch, out = int(rows[0]._entry), int(rows[0]._batch), []
        for row in rows:
            out.append((row._stream, row._part, entry, batch))
            entry, batch = _through(row, entry, batch)
        return pd.DataFrame(out, columns=["_stream", "_part", "_entry", "_batch"])

    last = summaries.agg(F.max("_part")).first()[0] or 0
    levels = [summaries.select(*(f.split()[0] for f in _SUMMARY.split(", ")))]
    half = F.expr("_part div 2")
    for _ in range(last.bit_length()):
        levels.append(checkpointed(levels[-1].groupBy("_stream", half.alias("_pair")).applyInPandas(compose, _SUMMARY)))
    entries = levels.pop().select("_stream", "_part", F.lit(1).cast("long").alias("_entry"), F.lit(0).cast("long").alias("_batch"))
    for level in reversed(levels):
        above = entries.withColumnsRenamed({"_part": "_pair", "_stream": "_above"})
        met = level.join(above, (F.col("_stream") == F.col("_above")) & (half == F.col("_pair"))).drop("_above")
        entries = checkpointed(met.groupBy("_stream", "_pair").applyInPandas(enter, _ENTRY))
    return checkpointed(entries)


def batch_health(outcomes: DataFrame) -> DataFrame:
    """Health row per batch over (batch_id, sent_at, hit_id, delivered)."""
    sent = outcomes.groupBy("batch_id").agg(
        F.max("sent_at").alias("TimeGenerated"),
        F.count_if("delivered").alias("_ok"),
        F.count("*").alias("_all"),
    )
    good = F.col("_ok") == F.col("_all")
    return sent.select(
        "TimeGenerated",
        F.when(good, "BatchSuccess").otherwise("BatchFail").alias("EventType"),
        F.when(good, "Informational").otherwise("Error").alias("Severity"),
        F.lit("forwarder").alias("SourceId"),
        F.col("_all").alias("EventCount"),
        F.concat(
            F.lit("forwarded "), F.col("_ok").cast("string"), F.lit(" of "), F.col("_all").cast("string")
        ).alias("Detail"),
        F.col("batch_id").alias("BatchId"),
    )


def replay_range(events: DataFrame, delivered: DataFrame, start, end, key: str = "EventRecordID") -> DataFrame:
    """Events of ``[start, end)`` that were not delivered."""
    return in_slice(events, start, end).join(delivered.select(key).distinct(), key, "left_anti")


def replay_ranges(events: DataFrame, delivered: DataFrame, ranges: DataFrame, key: str = "EventRecordID") -> DataFrame:
    """Events of several ranges (batch_id, start, end) that were not delivered, with the batch to send them in.

    An event of two ranges is given for each.  Only the months that some range
    reaches are read.
    """
    return in_slices(events, ranges).join(delivered.select(key).distinct(), key, "left_anti").drop("start", "end")


# -- retention --------------------------------------------------------------


def retention_type(events_tag: str = "ProvenanceTag", channel: str = "ChannelName") -> Column:
    """Source type of the retention table; Sysmon is told apart by channel."""
    prefix = c.source_type(F.col(events_tag))
    return (
        F.when((prefix == "wef") & F.col(channel).startswith("Microsoft-Windows-Sysmon"), "sysmon")
        .when(prefix == "ipfix", "netflow")
        .otherwise(prefix)
    )


def apply_retention(
    events: DataFrame, as_of, days: dict[str, int] | None = None, default_days: int = 30
) -> DataFrame:
    """Events still inside the retention of their source type.

    What is older than the longest retention is not read.
    """
    days = days or s.RETENTION_DAYS
    table = lookup(events.sparkSession, days, "_type string, _days int")
    longest = F.make_dt_interval(F.lit(max(default_days, *days.values())))
    kept_from = F.lit(as_of).cast("timestamp") - F.make_dt_interval(
        F.coalesce("_days", F.lit(default_days))
    )
    return (
        in_slice(events, F.lit(as_of).cast("timestamp") - longest)
        .withColumn("_type", retention_type())
        .join(F.broadcast(table), "_type", "left")
        .filter(F.col("TimeGenerated") >= kept_from)
        .select(*events.columns)
    )


def purge_report(
    events: DataFrame, delivered: DataFrame, as_of, days: dict[str, int] | None = None, default_days: int = 30
) -> DataFrame:
    """Month partitions whose last day is past retention, per source type.

    A partition with an undelivered event is reported as PurgeBeforeForward.
    """
    table = lookup(events.sparkSession, days or s.RETENTION_DAYS, "source_type string, _days int")
    ids = delivered.select("EventRecordID").distinct().withColumn("_sent", F.lit(1))
    month_end = F.last_day(F.to_date(F.col("partition"), "yyyyMM"))
    expired_before = F.date_sub(
        F.lit(as_of).cast("timestamp").cast("date"), F.coalesce("_days", F.lit(default_days))
    )
    # Only events of expired months meet the delivered ids.
    expired = (
        events.select(
            "EventRecordID",
            "TimeGenerated",
            retention_type().alias("source_type"),
            F.date_format("TimeGenerated", "yyyyMM").alias("partition"),
        )
        .join(F.broadcast(table), "source_type", "left")
        .filter(month_end < expired_before)
        .drop("_days")
    )
    parts = (
        expired.join(ids, "EventRecordID", "left")
        .groupBy("partition", "source_type")
        .agg(
            F.count("*").alias("EventCountEstimate"),
            F.count("_sent").alias("_sent"),
            F.min("TimeGenerated").alias("first_event"),
            F.max("TimeGenerated").alias("last_event"),
        )
    )
    confirmed = F.col("_sent") == F.col("EventCountEstimate")
    return parts.select(
        "partition",
        "source_type",
        F.to_date("partition", "yyyyMM").alias("DateRangeStart"),
        month_end.alias("DateRangeEnd"),
        "EventCountEstimate",
        "first_event",
        "last_event",
        confirmed.alias("ForwardingConfirmed"),
        F.when(confirmed, "PartitionPurge").otherwise("PurgeBeforeForward").alias("EventType"),
        F.when(confirmed, "Informational").otherwise("Warning").alias("Severity"),
    )


# -- rule states ------------------------------------------------------------


def latest_rule_state(changes: DataFrame) -> DataFrame:
    return latest_per_key(changes, ["rule_id"], "updated_at", ["status"])


def active_rules(changes: DataFrame, statuses: tuple = ("test", "review", "production")) -> DataFrame:
    """Rules that may run: latest status is neither draft nor disabled."""
    return latest_rule_state(changes).filter(F.col("status").isin(*statuses))


def rule_audit(changes: DataFrame) -> DataFrame:
    """An audit record for every change of status; repeats are not changes."""
    high = F.col("old_status").isin(HIGH_STATUSES) | F.col("status").isin(HIGH_STATUSES)
    return (
        with_previous(changes, ["rule_id"], ["updated_at", "status"], "status", "old_status")
        .filter(F.col("old_status").isNotNull() & (F.col("old_status") != F.col("status")))
        .select(
            F.col("updated_at").alias("TimeGenerated"),
            F.col("rule_id").alias("RuleId"),
            F.lit("RuleChangeAudit").alias("EventType"),
            "old_status",
            F.col("status").alias("new_status"),
            F.when(high, "High").otherwise("Informational").alias("Severity"),
            F.to_json(F.struct("old_status", F.col("status").alias("new_status"))).alias("Detail"),
        )
    )


def audit_gaps(changes: DataFrame, audit: DataFrame, demoted: tuple = ("draft", "disabled")) -> DataFrame:
    """Demotions with no audit record of that rule and status at or before them."""
    moves = rule_audit(changes).filter(F.col("new_status").isin(*demoted))
    covered = audit.groupBy("RuleId", "new_status").agg(F.min("TimeGenerated").alias("_audited"))
    return (
        moves.join(covered, ["RuleId", "new_status"], "left")
        .filter(F.col("_audited").isNull() | (F.col("_audited") > F.col("TimeGenerated")))
        .select("RuleId", "old_status", "new_status", "TimeGenerated")
    )
