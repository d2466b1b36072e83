"""Declarative detection rules, evaluated in one scan of the events.

A rule is plain data: named selections of ``field|modifier -> values``, the
selections that must hold (``all_of``, ``any_of``) and those that must not
(``none_of``).  Each rule becomes one boolean Column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.functions import columns as c
from wardlight.operators.normalize import PROMOTED, promote_fields
from wardlight.operators.ordering import first_n, small_side
from wardlight.operators.timeslice import in_slice
from wardlight.session import checkpointed, local_table

# Rule field -> canonical column.
RULE_FIELDS = {
    "EventID": "EventID",
    "EventRecordID": "EventRecordID",
    "Computer": "HostName",
    "SubjectUserName": "SubjectUserName",
    "SubjectUserSid": "SubjectUserSid",
    "SubjectDomainName": "SubjectDomainName",
    "TargetUserName": "TargetUserName",
    "TargetUserSid": "TargetUserSid",
    "TargetDomainName": "TargetDomainName",
    "ServiceName": "ServiceName",
    "Image": "ProcessImagePath",
    "CommandLine": "CommandLine",
    "ParentImage": "ParentProcessImagePath",
    "ParentCommandLine": "ParentCommandLine",
    "GrantedAccess": "GrantedAccess",
    "TargetObject": "RegistryKey",
    "ObjectName": "ObjectName",
    "LogonType": "LogonType",
    "IpAddress": "SrcIpAddr",
    "IpPort": "SrcPort",
    "DestAddress": "DstIpAddr",
    "DestPort": "DstPort",
    "Protocol": "NetworkProtocol",
    "TimeCreated": "TimeGenerated",
    "Channel": "ChannelName",
    "Provider": "ProviderName",
    "Hashes.MD5": "FileMD5",
    "Hashes.SHA256": "FileSHA256",
}
# Log source service -> channel filter.
SERVICE_CHANNELS = {
    "security": "Security",
    "system": "System",
    "sysmon": "Microsoft-Windows-Sysmon/Operational",
}

# Selections, levels, statuses and tags of the shipped rules.
AD_RULES = [
    {
        "id": "windows-ad-001",
        "title": "Kerberoasting",
        "status": "production",
        "level": "high",
        "tags": ["attack.credential-access", "attack.t1558.003"],
        "service": "security",
        "selections": {
            "request": {"EventID": 4769},
            "machine": {"ServiceName|endswith": "$"},
        },
        "all_of": ["request"],
        "none_of": ["machine"],
    },
    {
        "id": "windows-ad-002",
        "title": "AS-REP roasting",
        "status": "production",
        "level": "high",
        "tags": ["attack.credential-access", "attack.t1558.004"],
        "service": "security",
        "selections": {
            "request": {"EventID": 4768},
            "machine": {"TargetUserName|endswith": "$"},
        },
        "all_of": ["request"],
        "none_of": ["machine"],
    },
    {
        "id": "windows-ad-003",
        "title": "Directory replication by a user account",
        "status": "production",
        "level": "critical",
        "tags": ["attack.credential-access", "attack.t1003.006"],
        "service": "security",
        "selections": {
            "access": {"EventID": 4662, "ObjectName|contains": ["DC="]},
            "machine": {"SubjectUserName|endswith": "$"},
        },
        "all_of": ["access"],
        "none_of": ["machine"],
    },
    {
        "id": "windows-ad-004",
        "title": "Read access to the LSASS process",
        "status": "production",
        "level": "critical",
        "tags": ["attack.credential-access", "attack.t1003.001"],
        "service": "sysmon",
        "selections": {
            "access": {
                "EventID": 10,
                "TargetImage|endswith": "\\lsass.exe",
                "GrantedAccess|contains": ["0x1010", "0x1038", "0x143a", "0x40"],
            },
            "known": {
                "Image|contains": [
                    "\\Windows\\System32\\werfault.exe",
                    "\\Windows\\System32\\taskmgr.exe",
                    "\\Windows\\System32\\svchost.exe",
                ]
            },
        },
        "all_of": ["access"],
        "none_of": ["known"],
    },
    {
        "id": "windows-ad-005",
        "title": "Network logon, SMB candidate",
        "status": "test",
        "level": "medium",
        "tags": ["attack.lateral-movement", "attack.t1021.002"],
        "service": "security",
        "selections": {
            "logon": {"EventID": 4624, "LogonType": 3},
            "machine": {"TargetUserName|endswith": "$"},
        },
        "all_of": ["logon"],
        "none_of": ["machine"],
    },
    {
        "id": "windows-ad-006",
        "title": "Remote desktop logon",
        "status": "test",
        "level": "medium",
        "tags": ["attack.lateral-movement", "attack.t1021.001"],
        "service": "security",
        "selections": {
            "logon": {"EventID": 4624, "LogonType": 10},
            "machine": {"TargetUserName|endswith": "$"},
            "loopback": {"IpAddress|contains": ["127.0.0.1", "::1"]},
        },
        "all_of": ["logon"],
        "none_of": ["machine", "loopback"],
    },
]

# Narrower forms of the first two rules; they need the promoted JSON fields.
PRECISE_RULES = [
    {
        **AD_RULES[0],
        "id": "windows-ad-001-rc4",
        "selections": {
            **AD_RULES[0]["selections"],
            "weak": {"TicketEncryptionType": ["0x17", "0x18"]},
        },
        "all_of": ["request", "weak"],
    },
    {
        **AD_RULES[1],
        "id": "windows-ad-002-nopreauth",
        "selections": {**AD_RULES[1]["selections"], "open": {"PreAuthType": "0"}},
        "all_of": ["request", "open"],
    },
]

# Rules over the pipeline's own health and security records.
SELF_RULES = [
    {
        "id": "SELF-002",
        "title": "Ingest flood",
        "status": "production",
        "level": "high",
        "tags": [],
        "service": "health",
        "selections": {"event": {"EventType": "FloodHeuristic"}},
        "all_of": ["event"],
        "none_of": [],
    },
    {
        "id": "SELF-003",
        "title": "Rule disabled or demoted",
        "status": "production",
        "level": "high",
        "tags": ["attack.defense-evasion", "attack.t1562.001"],
        "service": "pipeline-security",
        "selections": {
            "event": {"EventType": "RuleChangeAudit"},
            "promotion": {"new_status": ["test", "review", "production"]},
        },
        "all_of": ["event"],
        "none_of": ["promotion"],
    },
    {
        "id": "SELF-004",
        "title": "Decompression cap exceeded",
        "status": "production",
        "level": "high",
        "tags": [],
        "service": "health",
        "selections": {"event": {"EventType": "DecompressionCapTrip"}},
        "all_of": ["event"],
        "none_of": [],
    },
    {
        "id": "SELF-005",
        "title": "Ledger reconciliation delta",
        "status": "production",
        "level": "high",
        "tags": [],
        "service": "pipeline-security",
        "selections": {"event": {"EventType": "LedgerDelta"}},
        "all_of": ["event"],
        "none_of": [],
    },
]

# Telemetry a rule needs before it can fire.
RULE_TELEMETRY = {
    "windows-ad-001": [("Security", 4769)],
    "windows-ad-002": [("Security", 4768)],
    "windows-ad-003": [("Security", 4662)],
    "windows-ad-004": [("Microsoft-Windows-Sysmon/Operational", 10)],
    "windows-ad-005": [("Security", 4624)],
    "windows-ad-006": [("Security", 4624)],
}

_LOOKAROUND = re.compile(r"\(\?<?[=!]")


def _test(column: Column, modifiers: list[str], value, cased: bool) -> Column:
    if "cidr" in modifiers:
        return c.in_cidr(column, value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return column == F.lit(value)
    if "re" in modifiers:
        if _LOOKAROUND.search(value):
            raise ValueError(f"look-around is not portable in a rule pattern: {value!r}")
        return column.rlike(value)
    left = column if cased else F.lower(column)
    right = value if cased else value.lower()
    if "contains" in modifiers:
        return left.contains(right)
    if "startswith" in modifiers:
        return left.startswith(right)
    if "endswith" in modifiers:
        return left.endswith(right)
    return left == F.lit(right)


def selection(spec: dict, fields: dict, cased: bool = False) -> Column:
    """AND over fields; OR over the values of a field (AND with ``|all``)."""
    tests = []
    for key, values in spec.items():
        name, *modifiers = key.split("|")
        column = fields.get(name, name)
        column = F.col(column) if isinstance(column, str) else column
        values = values if isinstance(values, list) else [values]
        join = c.all_of if "all" in modifiers else c.any_of
        if "token" in modifiers:
            tests.append(join([F.array_contains(column, v) for v in values]))
        elif not modifiers and len(values) > 1 and all(isinstance(v, int) for v in values):
            tests.append(column.isin(*values))
        else:
            tests.append(join([_test(column, modifiers, v, cased) for v in values]))
    return c.all_of(tests)


def rule_condition(
    rule: dict, fields: dict | None = None, channel: str | None = "ChannelName", cased: bool = False, total: bool = True
) -> Column:
    """One boolean Column per rule.

    ``total`` makes a null false.  A filter does that by itself, and the bare
    conjunction lets Spark push its parts down to the scan.
    """
    fields = {**RULE_FIELDS, **(fields or {})}
    named = {k: selection(v, fields, cased) for k, v in rule["selections"].items()}
    parts = [named[k] for k in rule.get("all_of", [])]
    if rule.get("any_of"):
        parts.append(c.any_of([named[k] for k in rule["any_of"]]))
    parts += [~F.coalesce(named[k], F.lit(False)) for k in rule.get("none_of", [])]
    wanted = SERVICE_CHANNELS.get(rule.get("service"))
    if channel and wanted:
        parts.append(F.col(channel) == wanted)
    return F.coalesce(c.all_of(parts), F.lit(False)) if total else c.all_of(parts)


def _event_ids(rules: list[dict]) -> list[int] | None:
    """Event ids the rules can match, or None when a rule does not pin one."""
    ids: set[int] = set()
    for rule in rules:
        pinned = None
        for name in rule.get("all_of", []):
            value = rule["selections"][name].get("EventID")
            if value is not None:
                pinned = value if isinstance(value, list) else [value]
        if pinned is None:
            return None
        ids.update(pinned)
    return sorted(ids)


def with_rule_fields(events: DataFrame) -> DataFrame:
    """Events plus the promoted JSON fields the rules use, where missing."""
    missing = [n for n in PROMOTED if n not in events.columns]
    return promote_fields(events, missing) if missing and "UnmappedFields" in events.columns else events


EVIDENCE = ["EventRecordID", "TimeGenerated", "SubjectUserName", "HostName", "SrcIpAddr"]


def detect_rules(
    events: DataFrame,
    rules: list[dict],
    start=None,
    end=None,
    keep: list[str] = EVIDENCE,
    fields: dict | None = None,
    cased: bool = False,
) -> DataFrame:
    """(rule_id, evidence columns): one row per rule and matching event.

    One scan for all rules.  The time bounds are half-open, and the pinned
    event ids become an IN filter that reaches the Parquet scan.
    """
    rows = with_rule_fields(in_slice(events, start, end))
    ids = _event_ids(rules)
    if ids is not None:
        rows = rows.filter(F.col("EventID").isin(*ids))
    matched = F.array_compact(
        F.array(*[F.when(rule_condition(r, fields, cased=cased), F.lit(r["id"])) for r in rules])
    )
    return rows.select(F.explode(matched).alias("rule_id"), *keep)


def rule_matches(events: DataFrame, rule: dict, columns: list[str]) -> DataFrame:
    """The events one rule matches."""
    rows, ids = with_rule_fields(events), _event_ids([rule])
    if ids is not None:
        rows = rows.filter(F.col("EventID").isin(*ids))
    return rows.filter(rule_condition(rule, total=False)).select(*columns)


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rule metadata as a DataFrame; as many rows as there are rules."""
    rows = [
        (
            r["id"],
            r["title"],
            r["status"],
            r["level"],
            s.LEVEL_SEVERITY.get(r["level"], "Medium"),
            next((t for t in r["tags"] if t.startswith("attack.t")), ""),
        )
        for r in rules
    ]
    return local_table(
        spark,
        rows,
        "rule_id string, title string, status string, level string, severity string, mitre_tag string",
    )


IDS_PER_CHUNK = 100_000


def evidence_chunks(
    matches: DataFrame, window: str = "15 minutes", chunk_ids: int = IDS_PER_CHUNK
) -> DataFrame:
    """(rule_id, batch_start, batch_end, chunk, chunks, ids, digest sums, n).

    A rule and window with up to ``chunk_ids`` matches is one chunk holding
    its sorted record ids.  A larger one is split by a hash of the id, so no
    task ever holds more than about one chunk of a flooding rule.  Copies of a
    record count in ``n`` but are listed once; they collapse before the shuffle.
    """
    at = F.window("TimeGenerated", window)
    keyed = matches.select(
        "rule_id", at.start.alias("batch_start"), at.end.alias("batch_end"), "EventRecordID"
    )
    keys = ["rule_id", "batch_start", "batch_end"]
    sizes = small_side(
        keyed.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(*keys, F.ceil(F.col("_n") / chunk_ids).cast("int").alias("chunks"))
        .filter("chunks > 1")
    )
    return (
        keyed.join(sizes, keys, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("EventRecordID"), F.col("chunks")).cast("int"))
        .groupBy(*keys, "chunk", "chunks")
        .agg(F.array_sort(F.collect_set("EventRecordID")).alias("ids"), F.count("*").alias("n"))
        .withColumns({name: _digest_sum(F.col("ids"), at) for name, at in DIGEST_PARTS.items()})
    )


#: Sums kept of the ids' digests, and where their fifteen hex digits begin.
DIGEST_PARTS = {"ids_sum_a": 1, "ids_sum_b": 16}


def _digest_sum(ids: Column, at: int) -> Column:
    """Sum of a part of each id's SHA-256: free of order, and of how ids are chunked."""
    part = lambda x: F.conv(F.substring(F.sha2(x, 256), at, 15), 16, 10).cast("decimal(20,0)")
    return F.aggregate(ids, F.lit(0).cast("decimal(38,0)"), lambda total, x: (total + part(x)).cast("decimal(38,0)"))


def build_hits(
    matches: DataFrame,
    rules: DataFrame,
    window: str = "15 minutes",
    rule_version: str = "1.0",
    chunk_ids: int = IDS_PER_CHUNK,
) -> DataFrame:
    """The detection ledger: one row per rule and window with a match.

    ``ids_digest`` is the number of distinct record ids and two sums of their
    digests; ``hit_id`` is SHA-256 over rule, ``ids_digest`` and window start in
    epoch milliseconds.  Neither depends on order, chunk size or time zone.
    ``event_record_ids`` lists the ids of a hit of one chunk; a larger hit lists
    them in :func:`evidence_chunks` only, and the column is null.
    ``created_at`` is the window end; ``forwarded_at`` starts null.
    """
    single = F.col("chunks") == 1
    grouped = (
        evidence_chunks(matches, window, chunk_ids)
        .groupBy("rule_id", "batch_start", "batch_end", "chunks")
        .agg(
            F.sum("n").alias("hit_count"),
            F.first(F.when(single, F.col("ids")), ignorenulls=True).alias("event_record_ids"),
            F.sum(F.size("ids")).alias("_distinct"),
            *[F.sum(name).cast("decimal(38,0)").alias(name) for name in DIGEST_PARTS],
        )
        .withColumn("ids_digest", F.concat_ws(":", *[F.col(n).cast("string") for n in ("_distinct", *DIGEST_PARTS)]))
    )
    start = F.unix_millis("batch_start").cast("string")
    return (
        grouped.join(rules, "rule_id")
        .select(
            F.sha2(F.concat_ws(":", "rule_id", "ids_digest", start), 256).alias("hit_id"),
            "rule_id",
            F.lit(rule_version).alias("rule_version"),
            "batch_start",
            "batch_end",
            "event_record_ids",
            "ids_digest",
            "hit_count",
            "level",
            "severity",
            "mitre_tag",
            F.lit(0.0).alias("anomaly_score"),
            F.col("batch_end").alias("created_at"),
            F.lit(None).cast("timestamp").alias("forwarded_at"),
        )
    )


def self_rules(records: DataFrame, rules: list[dict] = SELF_RULES) -> DataFrame:
    """(rule_id, severity, TimeGenerated, EventType): rules over own records.

    ``records`` needs EventType, TimeGenerated and Detail (JSON text or text).
    The new status is read from the JSON, so its spacing does not matter.
    """
    fields = {"EventType": "EventType", "new_status": c.text(F.get_json_object("Detail", "$.new_status"))}
    matched = F.array_compact(
        F.array(
            *[
                F.when(
                    rule_condition(r, fields, channel=None, cased=True),
                    F.struct(
                        F.lit(r["id"]).alias("rule_id"),
                        F.lit(s.LEVEL_SEVERITY[r["level"]]).alias("severity"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return records.select(F.explode(matched).alias("m"), "TimeGenerated", "EventType").select(
        "m.rule_id", "m.severity", "TimeGenerated", "EventType"
    )


def rule_fixture_check(labelled: DataFrame, rules: list[dict] = AD_RULES) -> DataFrame:
    """Confusion counts per rule over (rule_id, expected, event columns)."""
    by_rule = None
    for rule in rules:
        test = F.col("rule_id") == rule["id"]
        found = rule_condition(rule)
        by_rule = F.when(test, found) if by_rule is None else by_rule.when(test, found)
    scored = labelled.withColumn("found", F.coalesce(by_rule, F.lit(False)))
    want, got = F.col("expected"), F.col("found")
    return scored.groupBy("rule_id").agg(
        F.count_if(want & got).alias("true_positive"),
        F.count_if(~want & ~got).alias("true_negative"),
        F.count_if(~want & got).alias("false_positive"),
        F.count_if(want & ~got).alias("false_negative"),
    )


def rule_dry_run(events: DataFrame, rule: dict, start, end, sample: int = 20) -> DataFrame:
    """Matches of one rule per host in a time slice, with the newest ids.

    At most ``sample`` ids are shown per host; the count covers all matches.
    """
    found = detect_rules(events, [rule], start, end, ["HostName", "TimeGenerated", "EventRecordID"])
    found = checkpointed(found)  # the matches only; the events are scanned once
    order = [F.col("TimeGenerated").desc(), F.col("EventRecordID").desc()]
    shown = (
        first_n(found, ["HostName"], order, sample, spread_by=F.col("EventRecordID"))
        .groupBy("HostName")
        .agg(F.array_join(F.array_sort(F.collect_list("EventRecordID")), ",").alias("sample_ids"))
    )
    return found.groupBy("HostName").agg(F.count("*").alias("matches")).join(shown, "HostName")


def rule_coverage(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Every rule with its match count, and whether it covers a technique."""
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("matches"), F.max("TimeGenerated").alias("last_match"))
    return rules.join(counts, "rule_id", "left").select(
        "rule_id",
        "status",
        "mitre_tag",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        "last_match",
        ((F.col("status") == "production") & (F.col("mitre_tag") != "")).alias("technique_covered"),
        F.col("matches").isNull().alias("silent"),
    )


def telemetry_gaps(
    events: DataFrame, needs: dict[str, list[tuple[str, int]]] = RULE_TELEMETRY
) -> DataFrame:
    """(rule_id, ChannelName, EventID) needed by a rule and absent in the events."""
    spark = events.sparkSession
    rows = [(rule, channel, eid) for rule, pairs in needs.items() for channel, eid in pairs]
    wanted = local_table(spark, rows, "rule_id string, ChannelName string, EventID long")
    seen = (
        events.filter(F.col("EventID").isin(*sorted({r[2] for r in rows})))
        .groupBy("ChannelName", "EventID")
        .agg(F.count("*").alias("_n"))
    )
    return wanted.join(seen, ["ChannelName", "EventID"], "left_anti").select(
        "rule_id", "ChannelName", "EventID"
    )
