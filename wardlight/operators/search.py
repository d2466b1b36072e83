"""Analyst searches: listings, typed search, indicators, categories, hunts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.functions import columns as c
from wardlight.operators.membership import sifted
from wardlight.operators.timeslice import back_from, in_slice
from wardlight.session import checkpointed

PAGE_ROWS = 100
MAX_ROWS = 10_000
MAX_DAYS = 30

# Search type -> columns it looks in.
SEARCH_COLUMNS = {
    "IP": ["SrcIpAddr", "DstIpAddr"],
    "Hostname": ["HostName"],
    "Username": ["SubjectUserName", "TargetUserName"],
    "Port": ["SrcPort", "DstPort"],
    "EventID": ["EventID"],
    "ProcessName": ["ProcessImagePath", "ParentProcessImagePath"],
}
# Digest length -> column.
HASH_COLUMNS = {32: "FileMD5", 64: "FileSHA256"}


def _between(at: str, start, end, closed: bool = True) -> list[Column]:
    tests = []
    if start is not None:
        tests.append(F.col(at) >= F.lit(start).cast("timestamp"))
    if end is not None:
        limit = F.lit(end).cast("timestamp")
        tests.append(F.col(at) <= limit if closed else F.col(at) < limit)
    return tests


def list_events(
    events: DataFrame,
    start=None,
    end=None,
    host: str | None = None,
    event_id: int | None = None,
    user: str | None = None,
    address: str | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Events under all given filters; both time bounds are included."""
    tests = []
    for name, value in (
        ("HostName", host),
        ("EventID", event_id),
        ("SubjectUserName", user),
        ("SrcIpAddr", address),
        ("ProvenanceTag", tag),
    ):
        if value is not None:
            tests.append(F.col(name) == value)
    return in_slice(events, start, end, closed=True).filter(c.all_of(tests))


def newest_page(
    rows: DataFrame, limit: int = PAGE_ROWS, offset: int = 0, at: str = "TimeGenerated", key: str = "EventRecordID"
) -> DataFrame:
    """One page, newest first, ties broken by id; a distributed top-k."""
    ordered = rows.orderBy(F.col(at).desc(), F.col(key))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(
    rows: DataFrame, last_at, last_key, limit: int = PAGE_ROWS, at: str = "TimeGenerated", key: str = "EventRecordID"
) -> DataFrame:
    """The page that follows a known last row; cost does not grow with depth."""
    mark = F.lit(last_at).cast("timestamp")
    rest = rows.filter((F.col(at) < mark) | ((F.col(at) == mark) & (F.col(key) > last_key)))
    return newest_page(rest, limit, at=at, key=key)


def search_condition(kind: str, value: str) -> Column:
    """The predicate of a typed search; a wrong value raises ValueError."""
    if kind == "FileHash":
        digest = value.lower()
        if not re.fullmatch(r"[0-9a-f]+", digest):
            raise ValueError("a file hash is hexadecimal")
        if len(digest) not in HASH_COLUMNS:
            raise ValueError("a file hash has 32 or 64 digits")
        return F.col(HASH_COLUMNS[len(digest)]) == digest
    if kind not in SEARCH_COLUMNS:
        raise ValueError(f"unknown search type {kind!r}")
    names = SEARCH_COLUMNS[kind]
    if kind in ("Port", "EventID"):
        number = int(value)
        if kind == "Port" and not 1 <= number <= 65535:
            raise ValueError("a port is between 1 and 65535")
        if number < 0:
            raise ValueError("an event id is not negative")
        return c.any_of([F.col(n) == number for n in names])
    if kind == "ProcessName":
        return c.any_of([F.col(n).startswith(value) for n in names])
    return c.any_of([F.col(n) == value for n in names])


def check_range(start, end, max_days: int = MAX_DAYS) -> None:
    """A search range is forward and at most ``max_days`` long."""
    low, high = pd.Timestamp(start), pd.Timestamp(end)
    if low >= high:
        raise ValueError("start must be before end")
    if high - low > pd.Timedelta(days=max_days):
        raise ValueError(f"a search covers at most {max_days} days")


def search(
    events: DataFrame, kind: str, value: str, start, end, incident_id: str | None = None, max_days: int = MAX_DAYS
) -> DataFrame:
    """All events of the range that match; see :func:`capped` for the cap.

    Without ``start`` the search covers the 24 hours before ``end``.
    """
    if start is None:
        start = str(pd.Timestamp(end) - pd.Timedelta(hours=24))
    check_range(start, end, max_days)
    tests = [search_condition(kind, value)]
    if incident_id is not None:
        if not re.fullmatch(r"[A-Za-z0-9_\-]+", incident_id):
            raise ValueError("an incident id holds letters, digits, '_' and '-'")
        tests.append(F.col("ProvenanceTag").startswith(f"manual-upload:incident:{incident_id}:"))
    return in_slice(events, start, end, closed=True).filter(c.all_of(tests))


def capped(rows: DataFrame, cap: int = MAX_ROWS, key: str = "EventRecordID") -> tuple[DataFrame, DataFrame]:
    """The newest ``cap`` rows, and a one-row frame saying if more exist."""
    over = rows.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))
    return newest_page(rows, cap, key=key), over


def searchable_values(events: DataFrame, keep: list[str], indicators: DataFrame | None = None) -> DataFrame:
    """(type, value, column, keep...): every non-empty searchable value.

    With ``indicators`` (type, value) values that are certainly none of them are
    dropped where they are read, before any is shuffled.
    """
    spots = [(kind, n) for kind, names in SEARCH_COLUMNS.items() for n in names]
    spots += [("FileHash", n) for n in HASH_COLUMNS.values()]
    items = [
        F.when(
            ~F.col(n).cast("string").isin("", "0"),
            F.struct(
                F.lit(kind).alias("type"), F.col(n).cast("string").alias("value"), F.lit(n).alias("column")
            ),
        )
        for kind, n in spots
    ]
    values = events.select(F.explode(F.array_compact(F.array(*items))).alias("v"), *keep).select("v.*", *keep)
    return values if indicators is None else sifted(values, indicators, ["type", "value"])


def ioc_match(events: DataFrame, indicators: DataFrame, keep: list[str]) -> DataFrame:
    """Every (indicator, event, column) match of a table of (type, value).

    A bitmap of the indicators, of bounded size, sifts the values of each event
    first.  The join itself carries no hint: Spark broadcasts the indicators while
    they are small and splits skewed values when they are not.
    """
    wanted = checkpointed(indicators.select("type", "value").distinct())
    return searchable_values(events, keep, wanted).join(wanted, ["type", "value"])


def ioc_counts(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Sightings per indicator.  Values are sifted, then folded, before they meet the table."""
    wanted = checkpointed(indicators.select("type", "value").distinct())
    seen = searchable_values(events, ["TimeGenerated"], wanted).groupBy("type", "value").agg(
        F.count("*").alias("sightings"),
        F.min("TimeGenerated").alias("first_seen"),
        F.max("TimeGenerated").alias("last_seen"),
    )
    return seen.join(wanted, ["type", "value"])


def categories() -> dict[str, Column]:
    """The event categories of the dashboard, as predicates."""
    return {
        "active-directory": F.col("EventID").isin(
            4720, 4722, 4724, 4725, 4726, 4728, 4732, 4756, 4768, 4769, 4771, 4776
        )
        | (F.col("ChannelName") == "Security"),
        "network": (F.col("NetworkProtocol") != "") | (F.col("SrcIpAddr") != ""),
        "dns": F.col("EventID").isin(4, 3008) | F.col("ServiceName").contains("dns"),
        "network-analysis": F.col("DstPort").isin(80, 443, 8080, 8443) & (F.col("SrcIpAddr") != ""),
        "malware-analysis": (F.col("FileSHA256") != "")
        | (F.col("FileMD5") != "")
        | F.col("CommandLine").contains("powershell")
        | F.col("CommandLine").contains("cmd.exe"),
        "log-analysis": F.col("ProvenanceTag") != "",
    }


def category_counts(events: DataFrame) -> DataFrame:
    """(category, events): all categories in one scan."""
    tests = categories()
    one = events.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"`{n}`").alias("events")) for n in tests])
    return one.select(F.inline(pairs))


def category_events(events: DataFrame, keep: list[str]) -> DataFrame:
    """(category, keep...): one row per event and category it falls in."""
    named = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in categories().items()]))
    return events.select(F.explode(named).alias("category"), *keep)


def category_page(events: DataFrame, category: str, limit: int = 500, offset: int = 0) -> DataFrame:
    return newest_page(events.filter(categories()[category]), limit, offset)


def list_detections(
    hits: DataFrame,
    severity: str | None = None,
    rule_id: str | None = None,
    forwarded: bool | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Hits under all given filters; severity compares without case."""
    tests = _between("created_at", start, end)
    if severity is not None:
        tests.append(F.lower("severity") == severity.lower())
    if rule_id is not None:
        tests.append(F.col("rule_id") == rule_id)
    if forwarded is not None:
        at = F.col("forwarded_at")
        tests.append(at.isNotNull() if forwarded else at.isNull())
    return hits.filter(c.all_of(tests))


def _since(at: str, as_of, back: str) -> Column:
    end = F.lit(as_of).cast("timestamp")
    return (F.col(at) >= end - F.expr(f"interval {back}")) & (F.col(at) < end)


def hunt_recent(events: DataFrame, as_of, back: str = "1 hour", limit: int = 100) -> DataFrame:
    rows = back_from(events, as_of, back)
    return newest_page(rows, limit).select(
        "TimeGenerated", "HostName", "EventID", "SubjectUserName", "SrcIpAddr", "ProvenanceTag"
    )


def hunt_top_rules(hits: DataFrame, as_of, back: str = "24 hours", limit: int = 50) -> DataFrame:
    return (
        hits.filter(_since("created_at", as_of, back))
        .groupBy("rule_id", "severity")
        .agg(F.count("*").alias("hit_count"), F.max("anomaly_score").alias("max_anomaly"))
        .orderBy(F.desc("hit_count"), "rule_id", "severity")
        .limit(limit)
    )


def hunt_by_source(events: DataFrame, as_of, back: str = "24 hours", source: str = "ProvenanceTag") -> DataFrame:
    return (
        back_from(events, as_of, back)
        .groupBy(source)
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), source)
    )


def hunt_anomaly(hits: DataFrame, above: float = 0.7, limit: int = 50) -> DataFrame:
    return (
        hits.filter(F.col("anomaly_score") > above)
        .orderBy(F.desc("anomaly_score"), F.desc("created_at"), "hit_id")
        .limit(limit)
        .select("hit_id", "rule_id", "anomaly_score", "hit_count", "severity", "created_at")
    )


def hunt_kerberoast(events: DataFrame, limit: int = 100) -> DataFrame:
    rows = events.filter((F.col("EventID") == 4769) & ~F.col("ServiceName").endswith("$"))
    return newest_page(rows, limit).select(
        "TimeGenerated", "HostName", "SubjectUserName", "ServiceName", "TargetUserName"
    )


def hunt_unforwarded(hits: DataFrame, limit: int = 100) -> DataFrame:
    return (
        hits.filter(F.col("forwarded_at").isNull())
        .orderBy(F.desc("created_at"), "hit_id")
        .limit(limit)
        .select("hit_id", "rule_id", "severity", "hit_count", "created_at")
    )


def adhoc_sql(
    spark: SparkSession, tables: dict[str, DataFrame], statement: str, args: dict | None = None, cap: int | None = None
) -> DataFrame:
    """A read-only statement with named parameters over the given tables.

    All rows by default.  With a ``cap`` at most that many, and ``truncated``
    says on every row whether more exist.  The caller's views of the same names
    are put back.
    """
    held = {v.name: spark.table(v.name) for v in spark.catalog.listTables() if v.isTemporary and v.name in tables}
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    try:
        found = spark.sql(statement, args=args or {})  # resolved here, so the views may go
    finally:
        for name in tables:
            held[name].createOrReplaceTempView(name) if name in held else spark.catalog.dropTempView(name)
    if cap is None:
        return found
    more = found.limit(cap + 1).count() > cap
    return found.limit(cap).withColumn("truncated", F.lit(more))


def entity_events(events: DataFrame, value: str) -> DataFrame:
    """Events in which any text column equals the value, spaces trimmed."""
    return events.filter(c.any_of([c.strip(F.col(n)) == value for n in s.STRING_COLUMNS]))


def cidr_match(events: DataFrame, networks: list[str], columns: tuple = ("SrcIpAddr", "DstIpAddr")) -> DataFrame:
    """Events with an address in one of a few networks."""
    return events.filter(c.any_of([c.in_cidr(F.col(a), n) for a in columns for n in networks]))


def cidr_table_match(events: DataFrame, networks: DataFrame, column: str = "SrcIpAddr") -> DataFrame:
    """(cidr, events, addresses): a table of IPv4 and IPv6 networks against the events.

    Addresses are folded first, then meet the table by (version, prefix length,
    leading bits): an equi-join, whatever the number of networks.  An address
    is repeated only for the lengths that the table holds, at most 162.
    """

    def digits(address: Column) -> Column:
        return F.coalesce(F.lpad(F.lower(F.hex(c.ipv4_number(address))), 8, "0"), c.ipv6_hex(address))

    def leading(address: Column, bits: Column) -> Column:
        whole, rest = (bits / 4).cast("int"), bits % 4
        nibble = F.conv(F.substring(address, whole + 1, F.lit(1)), 16, 10).cast("int")
        part = F.floor(nibble / F.pow(F.lit(2.0), 4 - rest)).cast("string")
        return F.concat(F.substring(address, F.lit(1), whole), F.when(rest > 0, part).otherwise(F.lit("")))

    parts = F.split("cidr", "/")
    listed = networks.select("cidr", digits(parts[0]).alias("base"), parts[1].cast("int").alias("bits"))
    listed = listed.filter(F.col("base").isNotNull() & F.col("bits").between(0, 4 * F.length("base")))
    lengths: dict[int, list[int]] = {8: [], 32: []}
    for row in listed.select(F.length("base").alias("size"), "bits").distinct().collect():
        lengths[row["size"]].append(row["bits"])
    nets = listed.select("cidr", F.length("base").alias("size"), "bits", leading(F.col("base"), F.col("bits")).alias("net"))
    seen = (
        events.groupBy(column)
        .agg(F.count("*").alias("n"))
        .select(digits(F.col(column)).alias("address"), "n")
        .filter(F.col("address").isNotNull())
        .withColumn("size", F.length("address"))
    )
    tried = [F.array(*map(F.lit, sorted(lengths[size]))).cast("array<int>") for size in (8, 32)]
    candidates = seen.withColumn("bits", F.explode(F.when(F.col("size") == 8, tried[0]).otherwise(tried[1])))
    return (
        candidates.withColumn("net", leading(F.col("address"), F.col("bits")))
        .join(nets, ["size", "bits", "net"])
        .groupBy("cidr")
        .agg(F.sum("n").alias("events"), F.count("*").alias("addresses"))
    )
