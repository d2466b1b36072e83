"""Rule predicates on labelled events, hit ids, chunked evidence."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wardlight.operators import ledger, normalize, rules
from wardlight.schema import EVENT_SCHEMA

SYSMON = "Microsoft-Windows-Sysmon/Operational"
LSASS = json.dumps({"TargetImage": "C:\\Windows\\System32\\lsass.exe"})

# One event that must match and one that must not, per shipped rule.
CASES = [
    ("windows-ad-001", True, {"EventID": 4769, "ServiceName": "MSSQLSvc"}),
    ("windows-ad-001", False, {"EventID": 4769, "ServiceName": "LABDC01$"}),
    ("windows-ad-002", True, {"EventID": 4768, "TargetUserName": "svc_nopreauth"}),
    ("windows-ad-002", False, {"EventID": 4768, "TargetUserName": "LABWKS02$"}),
    ("windows-ad-003", True, {"EventID": 4662, "ObjectName": "DC=corp,DC=lab", "SubjectUserName": "jdoe"}),
    ("windows-ad-003", False, {"EventID": 4662, "ObjectName": "DC=corp,DC=lab", "SubjectUserName": "LABDC02$"}),
    (
        "windows-ad-004",
        True,
        {"EventID": 10, "ChannelName": SYSMON, "ProcessImagePath": "C:\\Users\\jdoe\\mimikatz.exe", "GrantedAccess": "0x1010", "UnmappedFields": LSASS},
    ),
    (
        "windows-ad-004",
        False,
        {"EventID": 10, "ChannelName": SYSMON, "ProcessImagePath": "C:\\Windows\\System32\\WerFault.exe", "GrantedAccess": "0x1010", "UnmappedFields": LSASS},
    ),
    ("windows-ad-005", True, {"EventID": 4624, "LogonType": 3, "TargetUserName": "jdoe"}),
    ("windows-ad-005", False, {"EventID": 4624, "LogonType": 3, "TargetUserName": "LABWKS02$"}),
    ("windows-ad-006", True, {"EventID": 4624, "LogonType": 10, "TargetUserName": "jdoe", "SrcIpAddr": "10.10.10.99"}),
    ("windows-ad-006", False, {"EventID": 4624, "LogonType": 10, "TargetUserName": "jdoe", "SrcIpAddr": "127.0.0.1"}),
]


def events(spark, rows):
    blank = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in EVENT_SCHEMA.fields}
    blank.update(TimeGenerated=None, IngestTimestamp=None, ChannelName="Security")
    return spark.createDataFrame([{**blank, **r} for r in rows], EVENT_SCHEMA)


def test_fixture_check_has_no_failures(spark):
    labelled = None
    for rule_id, expected, row in CASES:
        one = events(spark, [row]).withColumns({"rule_id": F.lit(rule_id), "expected": F.lit(expected)})
        labelled = one if labelled is None else labelled.unionByName(one)
    checked = rules.rule_fixture_check(normalize.promote_fields(labelled)).collect()
    assert len(checked) == 6
    for row in checked:
        assert (row.true_positive, row.true_negative, row.false_positive, row.false_negative) == (1, 1, 0, 0)


def test_modifiers(spark):
    rule = lambda spec, **kw: {"id": "r", "selections": {"s": spec}, "all_of": ["s"], **kw}
    frame = events(spark, [{"CommandLine": "PowerShell -Enc AAA", "SrcIpAddr": "10.1.2.3", "DstPort": 445}])
    yes = [
        {"CommandLine|contains": "powershell"},
        {"CommandLine|contains|all": ["power", "enc"]},
        {"CommandLine|startswith": ["cmd", "power"]},
        {"CommandLine|re": r"-[Ee]nc\s+\w+"},
        {"IpAddress|cidr": "10.1.0.0/16"},
        {"DestPort": [445, 3389]},
    ]
    no = [
        {"CommandLine|contains|all": ["power", "bash"]},
        {"IpAddress|cidr": ["192.168.0.0/16", "10.2.0.0/15"]},
        {"DestPort": 80},
    ]
    for spec in yes:
        assert frame.filter(rules.rule_condition(rule(spec))).count() == 1, spec
    for spec in no:
        assert frame.filter(rules.rule_condition(rule(spec))).count() == 0, spec
    assert frame.filter(rules.rule_condition(rule({"CommandLine|contains": "powershell"}), cased=True)).count() == 0


def test_lookaround_is_refused():
    with pytest.raises(ValueError):
        rules.rule_condition({"id": "r", "selections": {"s": {"Image|re": "(?=x)y"}}, "all_of": ["s"]})


def test_missing_text_does_not_hide_a_match(spark):
    """An empty field must not turn ``not filter`` into null."""
    frame = events(spark, [{"EventID": 4769, "ServiceName": None}])
    assert frame.filter(rules.rule_condition(rules.AD_RULES[0])).count() == 1


def test_window_is_half_open(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:15:00"))
    frame = events(spark, [{"EventID": 4769, "ServiceName": "a"}]).withColumn("TimeGenerated", at)
    find = lambda a, b: rules.detect_rules(frame, rules.AD_RULES, a, b).count()
    assert find("2024-01-01 00:00:00", "2024-01-01 00:15:00") == 0
    assert find("2024-01-01 00:15:00", "2024-01-01 00:30:00") == 1


def _matches(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "EventRecordID string")
    return rows.select(
        F.lit("windows-ad-001").alias("rule_id"),
        F.to_timestamp(F.lit("2024-01-01 00:05:00")).alias("TimeGenerated"),
        "EventRecordID",
    )


def test_hit_id_ignores_row_order(spark):
    meta = rules.rules_table(spark, rules.AD_RULES)
    ids = ["c", "a", "b"]
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
    sums = [sum(int(d[a : a + 15], 16) for d in digests) for a in (0, 15)]
    want = hashlib.sha256(f"windows-ad-001:3:{sums[0]}:{sums[1]}:1704067200000".encode()).hexdigest()
    for order in (ids, ids[::-1]):
        hit = rules.build_hits(_matches(spark, order), meta).collect()[0]
        assert (hit.hit_id, hit.hit_count, hit.severity, hit.mitre_tag) == (want, 3, "High", "attack.t1558.003")


def test_a_flooding_rule_is_chunked_and_whole(spark):
    meta = rules.rules_table(spark, rules.AD_RULES)
    ids = [f"id{i:05d}" for i in range(2500)]
    found = _matches(spark, ids)
    chunks = rules.evidence_chunks(found, chunk_ids=100).collect()
    assert sorted(i for c in chunks for i in c.ids) == ids
    assert len(chunks) > 20 and max(len(c.ids) for c in chunks) < 200
    hit = rules.build_hits(found, meta, chunk_ids=100).collect()
    again = rules.build_hits(_matches(spark, ids[::-1]), meta, chunk_ids=100).collect()
    assert len(hit) == 1 and hit[0].hit_count == 2500 and hit[0].event_record_ids is None
    assert hit[0].hit_id == again[0].hit_id


def test_one_rule_pushes_its_filters_to_the_scan(spark, sec, tmp_path):
    path = str(tmp_path / "events")
    sec.write.parquet(path)
    rule = next(r for r in rules.AD_RULES if r["id"] == "windows-ad-001")
    plan = rules.rule_matches(spark.read.parquet(path), rule, ["EventRecordID"])._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and "EventID" in pushed[0] and "PushedFilters: []" not in pushed[0]


def test_chunk_size_changes_no_id_and_loses_none(spark, sec):
    meta, found = rules.rules_table(spark, rules.AD_RULES), rules.detect_rules(sec, rules.AD_RULES)
    whole, cut = (rules.build_hits(found, meta, "1 day", chunk_ids=n) for n in (100_000, 5))
    names = lambda hits: sorted(r.hit_id for r in hits.collect())
    opened = lambda hits: sorted((r.fingerprint, r.hit_id) for r in ledger.incidents(hits).collect())
    assert names(whole) == names(cut) and opened(whole) == opened(cut)
    records = ledger.security_records(cut, rules.evidence_chunks(found, "1 day", chunk_ids=5))
    listed = records.select("RuleId", F.explode(F.from_json("SourceEventIds", "array<string>")).alias("id"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, found.select("rule_id", "EventRecordID").distinct().collect()))
    assert records.where("SourceEventIds = '[]'").count() == 0
    with pytest.raises(Exception, match="evidence chunks"):
        ledger.security_records(cut).collect()


def test_hit_ids_do_not_depend_on_the_session_time_zone(spark):
    meta, before = rules.rules_table(spark, rules.AD_RULES), spark.conf.get("spark.sql.session.timeZone")
    found = _matches(spark, ["a", "b"]).withColumn("TimeGenerated", F.timestamp_seconds(F.lit(1_704_067_500)))
    ids = set()
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            ids.add(rules.build_hits(found, meta, "1 minute").collect()[0].hit_id)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(ids) == 1
