"""Structured Streaming forms of the jobs.

Every function takes a streaming DataFrame and returns one, or takes a batch
inside ``foreachBatch``.  Lateness is always a parameter; late rows are counted
by :func:`wardlight.operators.kpi.late_report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import columns as c
from wardlight.operators import ingest, normalize, rules
from wardlight.session import scratch_path
from wardlight.streaming import state
from wardlight.streaming.state import LATENESS

DAY = 86_400_000


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back what it wrote.

    Output and checkpoint live in the shared folder, so the result survives
    the loss of an executor and never passes through the driver.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_normalize(raw: DataFrame, limit_bytes: int = ingest.MAX_EVENT_BYTES) -> DataFrame:
    """Size gate and normalisation; stateless, so it is the batch projection.

    What it refuses is the second output of :func:`run_normalize`.
    """
    gated = ingest.size_gate(raw, limit=limit_bytes).filter("accepted").drop("event_bytes", "accepted")
    return normalize.normalize_events(gated)


def reject_rows(raw: DataFrame, limit_bytes: int = ingest.MAX_EVENT_BYTES) -> DataFrame:
    """Health rows for every message that :func:`stream_normalize` refuses.

    A message too large is not read; a missing one counts as unreadable.
    """
    gated = ingest.size_gate(raw, limit=limit_bytes)
    unread = normalize.normalize_rejects(gated.filter(F.coalesce("accepted", F.lit(True))))
    return ingest.size_rejects(gated).unionByName(ingest.parse_rejects(unread))


def run_normalize(raw: DataFrame, label: str, limit_bytes: int = ingest.MAX_EVENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Normalised events, and health rows for the messages refused, of what is there now.

    Both are written per micro-batch under one checkpoint, so a source and
    hour that spans batches has a health row in each.
    """
    spark = raw.sparkSession
    out = scratch_path(spark, label)

    def write_batch(frame: DataFrame, batch_id: int) -> None:
        outputs = {"events": stream_normalize(frame, limit_bytes), "rejects": reject_rows(frame, limit_bytes)}
        for name, rows in outputs.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/{batch_id}")

    query = (
        raw.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
        write_batch(spark.createDataFrame([], raw.schema), 0)  # nothing arrived: empty tables
    reader = spark.read.option("recursiveFileLookup", "true")
    return (
        reader.schema(stream_normalize(raw, limit_bytes).schema).parquet(f"{out}/events"),
        reader.schema(reject_rows(raw, limit_bytes).schema).parquet(f"{out}/rejects"),
    )


def stream_dedup(events: DataFrame, key: str = "EventRecordID", lateness: str = LATENESS) -> DataFrame:
    """First arrival per record id within the watermark."""
    return events.withWatermark("TimeGenerated", lateness).dropDuplicatesWithinWatermark([key])


def stream_flood(
    raw: DataFrame, threshold: int, tag: str = "provenance_tag", at: str = "received_at", lateness: str = LATENESS
) -> DataFrame:
    """Flood records per source and minute, emitted when the minute closes."""
    counts = (
        raw.withWatermark(at, lateness)
        .groupBy(c.source_type(F.col(tag)).alias("SourceId"), F.window(at, "60 seconds"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > threshold)
        .select("SourceId", F.col("window.start").alias("_step"), "_n")
    )
    return ingest.flood_records(counts, threshold)


def stream_threshold(
    events: DataFrame,
    entity: str,
    count: int,
    window: str,
    step: str | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Entities with ``count`` events in a tumbling or sliding window."""
    frame = F.window("TimeGenerated", window, step) if step else F.window("TimeGenerated", window)
    return (
        events.filter(F.col(entity) != "")
        .withWatermark("TimeGenerated", lateness)
        .groupBy(F.col(entity).alias("entity"), frame)
        .agg(F.count("*").alias("events"))
        .filter(F.col("events") >= count)
        .select("entity", F.col("window.start").alias("window_start"), "events")
    )


def stream_sessions(events: DataFrame, entity: str, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Activity sessions per entity."""
    return (
        events.filter(F.col(entity) != "")
        .withWatermark("TimeGenerated", lateness)
        .groupBy(F.col(entity).alias("entity"), F.session_window("TimeGenerated", gap))
        .agg(F.count("*").alias("events"))
        .select(
            "entity",
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "events",
        )
    )


def stream_join(
    logons: DataFrame, flows: DataFrame, span: str = "5 minutes", port: int = 445, lateness: str = LATENESS
) -> DataFrame:
    """Logon and flow of one address within ``span``: two watermarks bound the
    state.  The flow side is folded to one row per address and minute, so an
    address with many flows joins on minutes, not on every flow.  Both sides also
    meet by steps of time as long as the span, flow minutes in theirs and the two
    beside it, so a row is held against some spans of its address, not all its state.
    """
    reach = F.expr(f"interval {span}")
    step = max(60_000, _millis(logons.sparkSession, span))

    def step_of(at: str) -> Column:
        return F.floor(F.unix_millis(at) / step)

    left = (
        logons.filter((F.col("EventID") == 4624) & (F.col("SrcIpAddr") != ""))
        .select(
            F.col("EventRecordID").alias("logon_id"),
            F.col("SrcIpAddr").alias("address"),
            F.col("TimeGenerated").alias("logon_at"),
        )
        .withWatermark("logon_at", lateness)
        .withColumn("logon_step", step_of("logon_at"))
    )
    right = (
        flows.filter((F.col("DstPort") == port) & (F.col("SrcIpAddr") != ""))
        .select(F.col("SrcIpAddr").alias("flow_address"), F.col("TimeGenerated").alias("flow_at"))
        .withWatermark("flow_at", lateness)
        .groupBy("flow_address", F.window("flow_at", "1 minute"))
        .agg(F.count("*").alias("flows"))
        .select("flow_address", F.window_time("window").alias("flow_minute"), "flows")
        .withColumn("flow_step", F.explode(F.array(*[step_of("flow_minute") + k for k in (-1, 0, 1)])))
    )
    return left.join(
        right,
        (F.col("address") == F.col("flow_address"))
        & (F.col("logon_step") == F.col("flow_step"))
        & (F.col("flow_minute") >= F.col("logon_at") - reach)
        & (F.col("flow_minute") <= F.col("logon_at") + reach),
    ).select("logon_id", "address", "logon_at", "flow_minute", "flows")


def stream_sequence(
    events: DataFrame, first: Column, second: Column, entity: str, span_ms: int, lateness: str = LATENESS
) -> DataFrame:
    """``first`` then ``second`` on one entity within the span: one rule of :func:`state.sequences`."""
    return state.sequences(events, [state.SequenceRule("", first, second, entity, span_ms)], lateness).drop("rule_id")


def stream_detect(
    events: DataFrame,
    rule_set: list[dict],
    window: str = "15 minutes",
    delay: str = "5 minutes",
    flush: bool = False,
) -> DataFrame:
    """Rule detection with one hit per rule and window, however batches fall.

    Each micro-batch appends its matches to an evidence table.  Hits are built
    for the windows that have closed since the last batch: those that end
    ``delay`` or more before the latest event seen.  Only the days of these windows
    are read again.  A retried batch writes the same folders again.  ``flush``
    closes the windows still open when the source is exhausted, as a replay of
    bounded input does.  See :func:`detect_with_late` for matches that come later.
    """
    return detect_with_late(events, rule_set, window, delay, flush)[0]


def detect_with_late(
    events: DataFrame, rule_set: list[dict], window: str = "15 minutes", delay: str = "5 minutes", flush: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Hits of :func:`stream_detect`, and the matches that came after their window had closed.

    Every match is in a hit, in the late table, or in a window still open.
    """
    spark = events.sparkSession
    out = scratch_path(spark, "hits")
    span, wait = (_millis(spark, x) for x in (window, delay))

    matches = rules.detect_rules(events, rule_set).withColumns({"late": F.lit(False), "batch_id": F.lit(0).cast("bigint"), "day": F.lit(0)})
    layout = T.StructType([*matches.schema.fields])
    last = {"batch": -1}

    def closed(seen: int | None) -> int:
        return 0 if seen is None else (seen - wait) // span * span

    def build(low: int, high: int | None, name: str) -> None:
        at = F.col("TimeGenerated")
        if high is not None and low >= high:
            return
        found = spark.read.schema(layout).option("basePath", f"{out}/matches").parquet(f"{out}/matches")
        found = found.filter((at >= F.timestamp_millis(F.lit(low))) & (F.col("day") >= low // DAY))
        if high is not None:
            found = found.filter((at < F.timestamp_millis(F.lit(high))) & (F.col("day") <= high // DAY))
        found = found.filter("not late").drop("batch_id", "day", "late")
        built = rules.build_hits(found, rules.rules_table(spark, rule_set), window)
        built.write.mode("overwrite").parquet(f"{out}/hits/batch_id={name}")

    def seen_before(batch_id: int) -> int | None:
        """Latest event of the earlier batches; the batch before has written it."""
        if batch_id == 0:
            return None
        return spark.read.schema("seen bigint").parquet(f"{out}/marks/batch_id={batch_id - 1}").first()[0]

    def one(frame: DataFrame, batch_id: int) -> None:
        latest = Observation(f"latest-{batch_id}")
        watched = frame.observe(latest, F.max(F.unix_millis("TimeGenerated")).alias("seen"))
        before = seen_before(batch_id)
        over = F.unix_millis("TimeGenerated") < F.lit(closed(before))
        day = F.floor(F.unix_millis("TimeGenerated") / DAY).cast("int")
        matched = rules.detect_rules(watched, rule_set).withColumns({"late": over, "day": day})
        matched.write.mode("overwrite").partitionBy("day").parquet(f"{out}/matches/batch_id={batch_id}")
        last["batch"] = batch_id
        known = [x for x in (before, latest.get["seen"]) if x is not None]
        now = max(known, default=None)
        mark = spark.range(1).select(F.lit(now).cast("bigint").alias("seen"))
        mark.write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")
        build(closed(before), closed(now), str(batch_id))

    query = (
        events.writeStream.foreachBatch(one)
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if flush and last["batch"] >= 0:
        build(closed(seen_before(last["batch"] + 1)), None, str(2**62))
    hits = rules.build_hits(spark.createDataFrame([], T.StructType(matches.schema.fields[:-3])), rules.rules_table(spark, rule_set), window)
    if not _written(spark, f"{out}/matches"):
        return hits, spark.createDataFrame([], T.StructType(matches.schema.fields[:-3]))
    found = spark.read.schema(layout).option("basePath", f"{out}/matches").parquet(f"{out}/matches")
    late = found.filter("late").drop("batch_id", "day", "late")
    if _written(spark, f"{out}/hits"):
        hits = spark.read.option("basePath", f"{out}/hits").parquet(f"{out}/hits").drop("batch_id")
    return hits, late


def _written(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def late_rows(stream: DataFrame, at: str, lateness: str = LATENESS, window: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that a watermark of ``lateness`` leaves behind, and counts for each micro-batch.

    A side output beside a stateful job on the same source, in the same batches:
    a row is late if its time, or the end of its ``window``, was not after the
    watermark that the batch before worked with, which the batches before that one
    had set.  That is Spark's own rule, so every row is in the job's result or
    state, or here.  Rows without a time are late.
    The counts (batch_id, rows, late) are observed while the rows are written.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "late")
    wait = _millis(spark, lateness)
    spent: list[tuple] = []

    def seen(batch_id: int) -> int | None:
        if batch_id < 0:
            return None
        return spark.read.schema("seen bigint").parquet(f"{out}/marks/batch_id={batch_id}").first()[0]

    def one(frame: DataFrame, batch_id: int) -> None:
        before, earlier = (seen(batch_id - back) for back in (1, 2))
        mark = None if earlier is None else F.timestamp_millis(F.lit(earlier - wait))
        end = F.window(F.col(at), window).end if window else F.col(at)
        missing = F.col(at).isNull()
        late = missing if mark is None else missing | F.coalesce(end <= mark, F.lit(False))
        watch = Observation(f"late-{batch_id}")
        marked = frame.withColumn("_late", late)
        watched = marked.observe(watch, F.count("*").alias("rows"), F.count_if("_late").alias("late"), F.max(F.unix_millis(at)).alias("seen"))
        watched.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        figures = watch.get
        known = [x for x in (before, figures["seen"]) if x is not None]
        spark.range(1).select(F.lit(max(known, default=None)).cast("bigint").alias("seen")).write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")
        spent.append((batch_id, figures["rows"], figures["late"]))

    query = (
        stream.writeStream.foreachBatch(one)
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counts = spark.createDataFrame(spent, "batch_id bigint, rows bigint, late bigint")
    if not spent:
        return spark.createDataFrame([], stream.schema), counts
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows"), counts


def stream_fanout(
    events: DataFrame, entity: str, target: str, step: str, at: str = "TimeGenerated", lateness: str = LATENESS, precision: int = 12
) -> DataFrame:
    """(entity, step_start, sketch): distinct targets of each entity and step, as mergeable sketches.

    A sketch has at most ``2**precision`` bytes or so, however many targets there
    are; it is emitted when its step closes.
    """
    return (
        events.filter((F.col(entity) != "") & (F.col(target) != ""))
        .withWatermark(at, lateness)
        .groupBy(F.col(entity).alias("entity"), F.window(at, step))
        .agg(F.hll_sketch_agg(target, precision).alias("sketch"))
        .select("entity", F.col("window.start").alias("step_start"), "sketch")
    )


def fanout_windows(sketches: DataFrame, threshold: int, window: str, slide: str | None = None) -> DataFrame:
    """Entities at or above ``threshold`` targets in windows longer than a step, from its sketches.

    Sketches of the steps of a window are merged; the count is an estimate, off by
    about 1.04 / sqrt(2**precision) (1.6 per cent at 12) in two of three cases.
    """
    frame = F.window("step_start", window, slide) if slide else F.window("step_start", window)
    merged = sketches.groupBy("entity", frame).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("targets"))
    return merged.filter(F.col("targets") >= threshold).select("entity", F.col("window.start").alias("window_start"), "targets")


def _millis(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {interval})").first()[0]


def stream_rate_limit(raw: DataFrame, limit: int, window: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    """Rate limit per source and window over what is there now; see :func:`state.rate_limited`."""
    return run_available(state.rate_limited(raw, limit, window, lateness=lateness), "rate")
