"""Stream operators with keyed state of their own, and their state read as tables.

State is kept by event time: it expires when the watermark has passed its end, so
a replay gives what the first run gave.  Spark's own time-to-live counts
processing time and is not used.  The state store must be RocksDB; the caller
sets it (``keyed_state``), a session with another store is refused.

Before rows are dealt out by key they are folded or cut per partition, so a key
that holds a third of the rows sends no more to its task than the rule needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardlight.functions import columns as c
from wardlight.session import ROCKSDB_PROVIDER, scratch_path

LATENESS = "5 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The RocksDB state store for the streams started inside; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _check_store(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER) != ROCKSDB_PROVIDER:
        raise ValueError(f"keyed state needs {PROVIDER}={ROCKSDB_PROVIDER}; see keyed_state")


def run_with_state(stream: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Run over what is there now; the rows written, and the folder of the stream's checkpoint."""
    spark = stream.sparkSession
    _check_store(spark)
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), f"{out}-state"


def read_state(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """A state variable of a checkpoint, as it stands after its last batch."""
    return (
        spark.read.format("statestore")
        .option("operatorId", operator)
        .option("stateVarName", variable)
        .load(checkpoint)
    )


# -- rate limit -------------------------------------------------------------------


class _Allowance(StatefulProcessor):
    """How many rows of a key have passed; the first ``limit`` do, in order within a batch."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "passed bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held = self.used.get()
        left = self.limit - (held[0] if held is not None else 0)
        best, ends = None, None
        for batch in rows:
            if batch.empty:
                continue
            ends = int(batch["ends"].iloc[0])
            if left > 0:
                best = batch if best is None else pd.concat([best, batch])
                best = best.sort_values(["at", "key"], kind="stable").head(left)
        if ends is not None:
            self.handle.registerTimer(ends)
        if best is not None:
            self.used.update((self.limit - left + len(best),))
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.used.clear()
        yield from ()

    def close(self) -> None:
        pass


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def rate_limited(
    raw: DataFrame,
    limit: int,
    window: str = "60 seconds",
    tag: str = "provenance_tag",
    at: str = "received_at",
    key: str = "id",
    lateness: str = LATENESS,
    salts: int = 16,
) -> DataFrame:
    """The first ``limit`` events per source type and fixed window of a stream.

    Batches count in the order they come; within a batch the first by time and
    id pass.  A first state per (source, window, salt) lets through at most
    ``limit`` rows of each salt, so a flooded source sends a bounded number to
    the second state, per (source, window), which decides.  Both forget a window
    once the watermark has passed its end.  Rows without a time, and rows later
    than the watermark, do not pass.
    """
    _check_store(raw.sparkSession)
    frame = F.window(at, window)
    rows = (
        raw.where(F.col(at).isNotNull())
        .withWatermark(at, lateness)
        .select(
            c.source_type(F.col(tag)).alias("source"),
            F.unix_millis(frame.start).alias("starts"),
            F.unix_millis(frame.end).alias("ends"),
            c.salt(F.col(key), salts).alias("salt"),
            F.col(at).alias("at"),
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
            # One text, so that its values come back as they were: numbers beside nulls would not.
            F.to_json(F.struct(*raw.columns), _EXACT).alias("row"),
        )
    )
    schema = rows.schema
    for keys in (["source", "starts", "salt"], ["source", "starts"]):
        rows = rows.groupBy(*keys).transformWithStateInPandas(
            _Allowance(limit), schema, "Append", "EventTime", eventTimeColumnName="at"
        )
    return rows.select(F.from_json("row", raw.schema, _EXACT).alias("row")).select("row.*")


# -- sequences --------------------------------------------------------------------


@dataclass(frozen=True)
class SequenceRule:
    """``first``, then ``second`` on one ``entity`` within ``span_ms``."""

    rule_id: str
    first: Column
    second: Column
    entity: str
    span_ms: int


SEQUENCE_OUT = (
    "rule_id string, entity string, first_at timestamp, first_events bigint, first_id string, next_at timestamp, next_id string"
)
_MOMENT = (
    "rule_id string, entity string, span bigint, part bigint, ms bigint, TimeGenerated timestamp, firsts bigint, first_id string, next_id string"
)
#: Spans of a rule that make one part of an entity, so that a busy entity is many keys.
SPANS_A_PART = 64


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a rule, entity and millisecond as one, batch by batch."""
    keys = ["rule_id", "entity", "span", "part", "ms"]
    folds = {"TimeGenerated": "max", "firsts": "sum", "first_id": "min", "next_id": "min"}
    for rows in batches:
        found = pa.Table.from_batches([rows]).group_by(keys).aggregate(list(folds.items()))
        found = found.select([*keys, *(f"{n}_{how}" for n, how in folds.items())]).rename_columns([*keys, *folds])
        yield from found.combine_chunks().to_batches()


class _Partial(StatefulProcessor):
    """First events still open and the second events that may answer them, of one (rule, entity, part of time).

    Both are one list of moments, written once a batch and read once when time has
    passed, whatever the number of moments.  A timer sits where the earliest moment
    closes, on a grid one span wide; when it fires, every first event closed by the
    watermark is answered and forgotten, and with it each second event that no open
    or later first event can precede.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "ms bigint, span bigint, events bigint, first_id string, next_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        for batch in rows:
            names = ["ms", "span", "firsts", "first_id", "next_id"]
            texts = [[x if isinstance(x, str) else None for x in batch[n]] for n in names[3:]]
            moments = list(zip(*(batch[n].tolist() for n in names[:3]), *texts))
            if moments:
                self.open.appendList(moments)
                self.handle.registerTimer(min(_closes(m) for m in moments))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs()
        moments = sorted((tuple(m) for m in self.open.get()), key=lambda m: m[0])
        out, left, still, after = [], [], now, None
        # From the last on: ``after`` is the nearest later moment with a second event.
        for ms, same in ((ms, list(same)) for ms, same in groupby(reversed(moments), lambda m: m[0])):
            span, events = same[0][1], sum(m[2] for m in same)
            if events and (ms // span + 2) * span <= now:
                if after is not None and after[0] <= ms + span:
                    out.append((*key[:2], ms, events, min(m[3] for m in same if m[3] is not None), *after))
            elif events:
                still = min(still, ms)
            seconds = [m[4] for m in same if m[4] is not None]
            after = (ms, min(seconds)) if seconds else after
        for m in moments:
            waits, answers = m[2] and _closes(m) > now, m[4] is not None and m[0] > still
            if waits or answers:
                left.append((*m[:2], *(m[2:4] if waits else (0, None)), m[4]))
        if left:
            self.open.put(left)
            self.handle.registerTimer(max(now + 1, min(_closes(m) for m in left)))
        elif moments:
            self.open.clear()
        if out:
            found = pd.DataFrame(out, columns=["rule_id", "entity", "first_at", "first_events", "first_id", "next_at", "next_id"])
            for column in ("first_at", "next_at"):
                found[column] = pd.to_datetime(found[column], unit="ms")
            yield found

    def close(self) -> None:
        pass


def _closes(moment: tuple) -> int:
    """When the span of a moment is over, rounded up to the grid."""
    return (moment[0] // moment[1] + 2) * moment[1]


def sequences(events: DataFrame, rule_set: list[SequenceRule], lateness: str = LATENESS) -> DataFrame:
    """Every first event's nearest second event within its rule's span, one row per moment.

    All rules share one scan and one operator; the state key is (rule, entity, part
    of time), a part being ``SPANS_A_PART`` spans.  Second events in the first span
    of a part go to the part before as well, whose first events they may answer.
    The stream form of :func:`correlate.sequence_next`.  Events of one rule,
    entity and millisecond are folded before they are dealt out.  A pair is given
    once the watermark has passed the end of its span, rounded up to the grid.
    """
    _check_store(events.sparkSession)
    each = [
        F.when(
            (r.first | r.second) & (F.col(r.entity) != ""),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.col(r.entity).alias("entity"),
                F.lit(r.span_ms).cast("bigint").alias("span"),
                F.coalesce(r.first, F.lit(False)).cast("bigint").alias("firsts"),
                F.when(r.first, F.col("EventRecordID")).alias("first_id"),
                F.when(r.second, F.col("EventRecordID")).alias("next_id"),
            ),
        )
        for r in rule_set
    ]
    relevant = (
        events.where(F.col("TimeGenerated").isNotNull())
        .select("TimeGenerated", F.array_compact(F.array(*each)).alias("_found"))
        .where(F.size("_found") > 0)
        .select("TimeGenerated", F.unix_millis("TimeGenerated").alias("ms"), F.inline("_found"))
    )
    names = [f.split()[0] for f in _MOMENT.split(", ")]
    slot, first = F.floor(F.col("ms") / F.col("span")), F.col("copy") == 0
    spread = relevant.withColumn("slot", slot).withColumn(
        "copy", F.explode(F.when(F.col("next_id").isNotNull() & (F.col("slot") % SPANS_A_PART == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    spread = spread.withColumns(
        {
            "part": F.floor(F.col("slot") / SPANS_A_PART) - F.col("copy"),
            "firsts": F.when(first, F.col("firsts")).otherwise(F.lit(0).cast("bigint")),
            "first_id": F.when(first, F.col("first_id")),
        }
    )
    folded = spread.select(*names).mapInArrow(_moments, _MOMENT).withWatermark("TimeGenerated", lateness)
    return folded.groupBy("rule_id", "entity", "part").transformWithStateInPandas(_Partial(), SEQUENCE_OUT, "Append", "EventTime")


def entity_state(spark: SparkSession, checkpoint: str, as_of: Column | None = None) -> DataFrame:
    """Partial matches: first events still waiting, one row per rule, entity and moment.

    With ``as_of`` those whose span was over by then are left out, whether the
    operator has dropped them yet or not.
    """
    held = read_state(spark, checkpoint, "open").select("key.rule_id", F.col("key.entity").alias("entity_key"), "list_element.*")
    # A moment that came in several batches has a row of each.
    folded = held.where("events > 0").groupBy("rule_id", "entity_key", "ms", "span").agg(
        F.sum("events").alias("event_count"), F.min("first_id").alias("first_id")
    )
    rows = folded.select(
        "rule_id",
        "entity_key",
        F.timestamp_millis("ms").alias("window_start"),
        "event_count",
        F.to_json(F.struct("first_id")).alias("payload"),
        F.timestamp_millis(F.col("ms") + F.col("span")).alias("expiry"),
    )
    return rows if as_of is None else rows.where(F.col("expiry") >= as_of)
