"""The SQL each registered query is checked against (DuckDB dialect).

``SEC`` is the telemetry mapping of ``sources/telemetry.py`` written as SQL;
``MATCHES`` and ``HITS`` build the rule matches and the detection ledger on it.
Queries without an entry have no SQL form; their tests check them instead.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_CLOSED = "(SELECT max({0}) - INTERVAL '5 minutes' FROM sec)"
SEC = r"""
WITH base AS (
  SELECT event_id AS e, user_id AS u, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         date_trunc('millisecond', ts) AS t,
         CAST(CASE event_type WHEN 'click' THEN 4624 WHEN 'view' THEN 4769 WHEN 'error' THEN 4768
              WHEN 'purchase' THEN 4662 WHEN 'signup' THEN 10 END AS BIGINT) AS eid,
         CASE event_id % 4 WHEN 0 THEN 'wef' WHEN 1 THEN 'syslog' WHEN 2 THEN 'netflow' ELSE 'forensic' END AS src
  FROM events
), sec AS (
  SELECT t AS TimeGenerated,
         'host' || (u % 20) AS HostName,
         eid AS EventID,
         src || ':x:0:' || e AS EventRecordID,
         CASE WHEN eid = 10 THEN 'Microsoft-Windows-Sysmon/Operational' ELSE 'Security' END AS ChannelName,
         'user' || u || CASE WHEN u % 7 = 0 THEN '$' ELSE '' END AS SubjectUserName,
         'user' || k || CASE WHEN k % 5 = 0 THEN '$' ELSE '' END AS TargetUserName,
         CASE WHEN eid = 4624 THEN CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 10 END ELSE 0 END AS LogonType,
         'svc' || k || CASE WHEN k % 3 = 0 THEN '$' ELSE '' END AS ServiceName,
         CASE WHEN eid = 10 THEN CASE k % 4 WHEN 0 THEN '0x1010' WHEN 1 THEN '0x40' WHEN 2 THEN '0x1000'
              ELSE '0x143a' END ELSE '' END AS GrantedAccess,
         CASE WHEN eid = 10 THEN CASE WHEN k % 3 <> 0 THEN 'C:\Windows\System32\lsass.exe' ELSE 'C:\x.exe' END
              ELSE '' END AS TargetImage,
         CASE WHEN eid = 10 THEN CASE WHEN k % 10 = 0 THEN 'C:\Windows\System32\svchost.exe'
              ELSE 'C:\tools\p' || k || '.exe' END ELSE '' END AS ProcessImagePath,
         CASE WHEN eid = 4662 AND k % 2 = 0 THEN 'DC=corp,DC=lab' ELSE '' END AS ObjectName,
         CASE WHEN k % 50 = 0 THEN '127.0.0.1' ELSE '10.' || (u % 4) || '.0.' || k END AS SrcIpAddr,
         '10.9.0.' || (e % 50) AS DstIpAddr,
         CASE e % 5 WHEN 0 THEN 445 WHEN 1 THEN 3389 WHEN 2 THEN 443 WHEN 3 THEN 53 ELSE 80 END AS DstPort,
         CASE WHEN k % 2 = 0 THEN '{"k": ' || k || '}' ELSE '' END AS UnmappedFields,
         t + to_milliseconds(CAST(floor(value * 1000) AS BIGINT)) AS IngestTimestamp,
         src || ':x:0' AS ProvenanceTag,
         src AS SourceType, k, e, u,
         epoch_ms(t) AS ms,
         CAST(floor(value * 1000) AS BIGINT) AS latency_ms
  FROM base
)"""

# One branch per rule, the rule text written as SQL.
MATCHES = (
    SEC
    + r""", matches AS (
  SELECT 'windows-ad-001' AS rule_id, * FROM sec WHERE EventID = 4769 AND ServiceName NOT LIKE '%$'
  UNION ALL
  SELECT 'windows-ad-002', * FROM sec WHERE EventID = 4768 AND TargetUserName NOT LIKE '%$'
  UNION ALL
  SELECT 'windows-ad-003', * FROM sec WHERE EventID = 4662 AND contains(ObjectName, 'DC=')
    AND SubjectUserName NOT LIKE '%$'
  UNION ALL
  SELECT 'windows-ad-004', * FROM sec WHERE EventID = 10 AND suffix(TargetImage, '\lsass.exe')
    AND (contains(GrantedAccess, '0x1010') OR contains(GrantedAccess, '0x1038')
         OR contains(GrantedAccess, '0x143a') OR contains(GrantedAccess, '0x40'))
    AND NOT contains(ProcessImagePath, '\Windows\System32\svchost.exe')
  UNION ALL
  SELECT 'windows-ad-005', * FROM sec WHERE EventID = 4624 AND LogonType = 3 AND TargetUserName NOT LIKE '%$'
  UNION ALL
  SELECT 'windows-ad-006', * FROM sec WHERE EventID = 4624 AND LogonType = 10 AND TargetUserName NOT LIKE '%$'
    AND NOT contains(SrcIpAddr, '127.0.0.1') AND NOT contains(SrcIpAddr, '::1')
), rule_meta AS (
  SELECT * FROM (VALUES
    ('windows-ad-001', 'production', 'high', 'High', 'attack.t1558.003'),
    ('windows-ad-002', 'production', 'high', 'High', 'attack.t1558.004'),
    ('windows-ad-003', 'production', 'critical', 'High', 'attack.t1003.006'),
    ('windows-ad-004', 'production', 'critical', 'High', 'attack.t1003.001'),
    ('windows-ad-005', 'test', 'medium', 'Medium', 'attack.t1021.002'),
    ('windows-ad-006', 'test', 'medium', 'Medium', 'attack.t1021.001')
  ) AS v(rule_id, status, level, severity, mitre_tag)
)"""
)

HITS = (
    MATCHES
    + r""", grouped AS (
  SELECT rule_id, time_bucket(INTERVAL '15 minutes', TimeGenerated) AS batch_start,
         string_agg(EventRecordID, ',' ORDER BY EventRecordID) AS event_record_ids,
         count(DISTINCT EventRecordID) || ':' || sum(('0x' || substr(sha256(EventRecordID), 1, 15))::BIGINT)
           || ':' || sum(('0x' || substr(sha256(EventRecordID), 16, 15))::BIGINT) AS ids_digest,
         count(*) AS hit_count
  FROM matches GROUP BY ALL
), hits AS (
  SELECT sha256(g.rule_id || ':' || ids_digest || ':' || epoch_ms(batch_start)) AS hit_id,
         g.rule_id, '1.0' AS rule_version, batch_start, batch_start + INTERVAL '15 minutes' AS batch_end,
         event_record_ids, sha256(g.rule_id || '|' || ids_digest) AS fingerprint, hit_count, level, severity, mitre_tag,
         batch_start + INTERVAL '15 minutes' AS created_at,
         round(((epoch_ms(batch_start) // 900000) % 100) / 99.0, 4) AS anomaly_score,
         CASE WHEN ((epoch_ms(batch_start) // 900000) % 100) % 3 <> 0
              THEN batch_start + INTERVAL '75 minutes' END AS forwarded_at
  FROM grouped g JOIN rule_meta USING (rule_id)
)"""
)

CHANGES = r"""
WITH changes AS (
  SELECT 'rule' || user_id AS rule_id,
         CASE event_type WHEN 'click' THEN 'test' WHEN 'view' THEN 'review' WHEN 'error' THEN 'draft'
              WHEN 'purchase' THEN 'production' ELSE 'disabled' END AS status,
         ts AS updated_at
  FROM events
), latest AS (
  SELECT * FROM changes
  QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY updated_at DESC, status DESC) = 1
), audit AS (
  SELECT updated_at AS TimeGenerated, rule_id AS RuleId, old_status, status AS new_status,
         CASE WHEN old_status IN ('production', 'disabled') OR status IN ('production', 'disabled')
              THEN 'High' ELSE 'Informational' END AS Severity
  FROM (SELECT *, lag(status) OVER (PARTITION BY rule_id ORDER BY updated_at, status) AS old_status FROM changes)
  WHERE old_status IS NOT NULL AND old_status <> status
)"""

HEALTH = (
    HITS
    + r""", flood AS (
  SELECT date_trunc('hour', IngestTimestamp) AS TimeGenerated, 'FloodHeuristic' AS EventType,
         CASE WHEN count(*) > 5 THEN 'Error' ELSE 'Warning' END AS Severity, SourceType AS SourceId,
         count(*) AS EventCount
  FROM sec GROUP BY 1, SourceType HAVING count(*) > 1
), batch AS (
  SELECT max(created_at) AS TimeGenerated,
         CASE WHEN count(forwarded_at) = count(*) THEN 'BatchSuccess' ELSE 'BatchFail' END AS EventType,
         CASE WHEN count(forwarded_at) = count(*) THEN 'Informational' ELSE 'Error' END AS Severity,
         'forwarder' AS SourceId, count(*) AS EventCount,
         'forwarded ' || count(forwarded_at) || ' of ' || count(*) AS Detail,
         strftime(created_at, '%Y%m%d%H') AS BatchId
  FROM hits GROUP BY strftime(created_at, '%Y%m%d%H')
), health AS (
  SELECT TimeGenerated, EventType, Severity, SourceId, EventCount FROM flood
  UNION ALL
  SELECT TimeGenerated, EventType, Severity, SourceId, EventCount FROM batch
)"""
)


def sql(name: str, prefix: str, body: str) -> None:
    ORACLES[name] = prefix + "\n" + body.strip("\n")


KEYS = "EventRecordID, TimeGenerated, HostName, EventID"

# -- ingest -----------------------------------------------------------------

_LINES = r"string_split_regex({0}, '\r\n|[\n\r]')"
sql(
    "scan_drop",
    "",
    f"SELECT line, count(*) AS n FROM (SELECT unnest({_LINES.format('text')}) AS line FROM documents) GROUP BY line",
)
sql(
    "stream_drop",
    "",
    f"SELECT line, count(*) AS n FROM (SELECT unnest({_LINES.format('text')}) AS line FROM documents) GROUP BY line",
)
sql(
    "parse_evidence",
    "",
    r"""
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS INTEGER) AS position, message,
       CAST(NULL AS INTEGER) AS k
FROM (
  SELECT 'doc-' || doc_id || '.txt' AS file, generate_subscripts(parts, 1) AS i,
         trim(unnest(parts), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS message
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents)
) WHERE message <> ''
UNION ALL
SELECT 'event-' || event_id || '.jsonl', p, NULL, CAST(json_extract_string(props, '$.k') AS INTEGER)
FROM events, (VALUES (0), (1)) AS v(p)
""",
)
sql(
    "tag_provenance",
    SEC,
    """
SELECT EventRecordID AS id, SourceType || ':http:' || (epoch_ms(IngestTimestamp) // 1000) AS provenance_tag,
       IngestTimestamp AS ingest_time
FROM sec
""",
)
sql(
    "union_sources",
    SEC,
    f"""
SELECT {KEYS}, CASE WHEN SourceType = 'wef' THEN LogonType END AS LogonType,
       CASE WHEN SourceType = 'netflow' THEN DstPort END AS DstPort
FROM sec
""",
)
sql(
    "route_events",
    SEC,
    """
SELECT EventRecordID, CASE WHEN DstPort = 53 THEN 'flood' WHEN SourceType <> 'forensic' THEN 'normal'
       ELSE 'unrouted' END AS route
FROM sec
""",
)
sql(
    "evidence_arrays",
    "",
    "SELECT text AS message, doc_id AS k, lang, source FROM documents",
)
sql(
    "evidence_csv",
    "",
    "SELECT coalesce(text, '') AS message, doc_id AS k, lang FROM documents",
)
sql(
    "evidence_logs",
    "",
    r"""
SELECT message, count(*) AS n, 0 AS gaps FROM (
  SELECT regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') AS raw, CASE WHEN doc_id % 3 = 0 THEN trim(raw) ELSE raw END AS message, doc_id % 3 AS kind FROM documents)
WHERE kind > 0 OR (message IS NOT NULL AND message <> '') GROUP BY message
""",
)
sql(
    "size_gate",
    "",
    "SELECT doc_id, strlen(text) AS event_bytes, strlen(text) <= 4096 AS accepted FROM documents",
)
_RATE = """
SELECT EventRecordID AS id, ProvenanceTag AS provenance_tag, IngestTimestamp AS received_at
FROM sec
QUALIFY row_number() OVER (PARTITION BY SourceType, date_trunc('hour', IngestTimestamp)
                           ORDER BY IngestTimestamp, EventRecordID) <= 3
"""
sql("rate_limit", SEC, _RATE)
sql("stream_rate_limit", SEC, _RATE)
sql(
    "flood_heuristic",
    SEC,
    """
SELECT date_trunc('hour', IngestTimestamp) AS TimeGenerated, 'FloodHeuristic' AS EventType,
       CASE WHEN count(*) > 5 THEN 'Error' ELSE 'Warning' END AS Severity, SourceType AS SourceId,
       count(*) AS EventCount
FROM sec GROUP BY 1, SourceType HAVING count(*) > 1
""",
)
sql(
    "flood_heuristic_sliding",
    SEC,
    """
SELECT time_bucket(INTERVAL '15 minutes', IngestTimestamp) - to_minutes(15 * b) AS TimeGenerated,
       'FloodHeuristic' AS EventType, CASE WHEN count(*) > 10 THEN 'Error' ELSE 'Warning' END AS Severity,
       SourceType AS SourceId, count(*) AS EventCount
FROM sec, (VALUES (0), (1), (2), (3)) AS v(b)
GROUP BY 1, SourceType HAVING count(*) > 2
""",
)
sql(
    "utf8_gate",
    "",
    """
SELECT 'doc-' || doc_id AS file,
       CASE WHEN source = 'src3' THEN 'UNSUPPORTED_FILE_TYPE'
            WHEN lang IN ('de', 'fr') THEN 'BINARY_CONTENT_REJECTED' ELSE 'accepted' END AS verdict
FROM documents
""",
)
sql(
    "upload_summary",
    SEC,
    """
SELECT HostName || '.jsonl' AS file, count(*) AS events_parsed, count(*) FILTER (NOT wrong) AS events_written,
       count(*) FILTER (NOT wrong AND k % 2 = 0) AS events_unmapped, count(*) FILTER (wrong) AS error_count,
       CASE WHEN bool_and(wrong) THEN 'failed' WHEN bool_or(wrong) THEN 'partial' ELSE 'success' END AS status
FROM (SELECT *, HostName IN ('host3', 'host12') OR e % 5 = 1 AND HostName <> 'host7' AS wrong FROM sec) GROUP BY HostName
""",
)
sql(
    "upload_cuts",
    "",
    """
SELECT doc_id, 40 * n > 65536 OR (doc_id % 2 = 0 AND 200 * (n + escapes) + 11 > 262144) AS was_cut, TRUE AS field_fits, TRUE AS rest_fits, TRUE AS rest_reads
FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, octet_length(encode(to_json(coalesce(text, ''))::VARCHAR)) - 2 - n AS escapes FROM documents)
""",
)
sql(
    "pull_slices",
    SEC,
    """
SELECT time_bucket(INTERVAL '6 hours', TimeGenerated) AS slice_start, count(*) AS rows, CAST(ceil(count(*) / 4.0) AS BIGINT) AS queries
FROM sec GROUP BY ALL
""",
)
sql("event_store", SEC, f"SELECT {KEYS} FROM sec")
sql(
    "stream_late",
    SEC,
    """
SELECT SourceType, late, count(*) AS events FROM (
  SELECT s.SourceType, coalesce(s.TimeGenerated <= (SELECT max(TimeGenerated) FROM sec b WHERE b.e % 4 < s.e % 4 - 1) - INTERVAL '10 days', FALSE) AS late FROM sec s)
GROUP BY ALL
""",
)
sql(
    "stream_fanout",
    SEC,
    f"""
SELECT SubjectUserName AS entity, date_trunc('day', TimeGenerated) AS window_start, count(DISTINCT DstIpAddr) AS targets FROM sec
WHERE date_trunc('hour', TimeGenerated) + INTERVAL '1 hour' <= {_CLOSED.format("TimeGenerated")}
GROUP BY ALL HAVING count(DISTINCT DstIpAddr) >= 2
""",
)
sql("overlap_pull", SEC, f"SELECT {KEYS} FROM sec")
sql(
    "write_events",
    SEC,
    """
SELECT CAST(strftime(TimeGenerated, '%Y%m') AS INTEGER) AS event_month, HostName, count(*) AS events,
       max(TimeGenerated) AS last_event
FROM sec GROUP BY ALL
""",
)
sql(
    "write_health",
    HEALTH,
    """
SELECT EventType, Severity, count(*) AS records, CAST(sum(EventCount) AS BIGINT) AS event_count
FROM health GROUP BY ALL
""",
)
_CELL = "'\"' || CASE WHEN left({0}, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || replace({0}, '\"', '\"\"') || '\"'"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_CSV = {
    "TimeGenerated": _ISO.format("TimeGenerated"),
    "HostName": "HostName",
    "EventID": "CAST(EventID AS VARCHAR)",
    "EventRecordID": "EventRecordID",
    "ChannelName": "ChannelName",
    "ProviderName": "''",
    "SubjectUserName": "SubjectUserName",
    "SubjectUserSid": "''",
    "SubjectDomainName": "''",
    "TargetUserName": "TargetUserName",
    "TargetUserSid": "''",
    "TargetDomainName": "''",
    "LogonType": "CAST(LogonType AS VARCHAR)",
    "ServiceName": "ServiceName",
    "ProcessImagePath": "ProcessImagePath",
    "CommandLine": "''",
    "ParentProcessImagePath": "''",
    "ParentCommandLine": "''",
    "GrantedAccess": "GrantedAccess",
    "ObjectName": "ObjectName",
    "FileMD5": "''",
    "FileSHA256": "''",
    "RegistryKey": "''",
    "SrcIpAddr": "SrcIpAddr",
    "SrcPort": "'0'",
    "DstIpAddr": "DstIpAddr",
    "DstPort": "CAST(DstPort AS VARCHAR)",
    "NetworkProtocol": "''",
    "ProvenanceTag": "ProvenanceTag",
    "IngestTimestamp": _ISO.format("IngestTimestamp"),
    "UnmappedFields": "UnmappedFields",
}
sql(
    "export_csv",
    SEC,
    "SELECT EventRecordID, "
    + " || ',' || ".join(_CELL.format(f"({v})") for v in _CSV.values())
    + ' AS "row" FROM sec',
)
sql("export_json", SEC, "SELECT EventRecordID, HostName, EventID, SrcIpAddr, UnmappedFields FROM sec")

# -- normalisation ----------------------------------------------------------

_NORMALIZED = r"""
SELECT CASE WHEN SourceType = 'forensic' THEN IngestTimestamp ELSE TimeGenerated END AS TimeGenerated,
       HostName,
       CASE WHEN SourceType IN ('syslog', 'netflow') THEN 0 ELSE EventID END AS EventID,
       EventRecordID,
       CASE SourceType WHEN 'wef' THEN ChannelName WHEN 'syslog' THEN 'Syslog' WHEN 'netflow' THEN 'Netflow'
            ELSE 'ForensicArtifact' END AS ChannelName,
       CASE SourceType WHEN 'wef' THEN '' WHEN 'syslog' THEN 'sshd' WHEN 'netflow' THEN 'softflowd'
            ELSE 'collector' END AS ProviderName,
       CASE WHEN SourceType = 'wef' THEN SubjectUserName ELSE '' END AS SubjectUserName,
       '' AS SubjectUserSid, '' AS SubjectDomainName,
       CASE WHEN SourceType = 'wef' THEN TargetUserName ELSE '' END AS TargetUserName,
       '' AS TargetUserSid, '' AS TargetDomainName,
       CASE WHEN SourceType = 'wef' THEN LogonType ELSE 0 END AS LogonType,
       CASE WHEN SourceType = 'wef' THEN ServiceName ELSE '' END AS ServiceName,
       CASE WHEN SourceType IN ('wef', 'forensic') THEN ProcessImagePath ELSE '' END AS ProcessImagePath,
       CASE SourceType WHEN 'syslog' THEN 'session for ' || SubjectUserName WHEN 'forensic' THEN 'run ' || k
            ELSE '' END AS CommandLine,
       '' AS ParentProcessImagePath, '' AS ParentCommandLine,
       CASE WHEN SourceType = 'wef' THEN GrantedAccess ELSE '' END AS GrantedAccess,
       CASE WHEN SourceType = 'wef' THEN ObjectName ELSE '' END AS ObjectName,
       CASE WHEN SourceType = 'wef' THEN md5(CAST(e AS VARCHAR)) ELSE '' END AS FileMD5,
       '' AS FileSHA256, '' AS RegistryKey,
       CASE WHEN SourceType <> 'forensic' THEN SrcIpAddr ELSE '' END AS SrcIpAddr,
       CASE WHEN SourceType = 'wef' THEN 65535 ELSE 0 END AS SrcPort,
       CASE WHEN SourceType <> 'forensic' THEN DstIpAddr ELSE '' END AS DstIpAddr,
       CASE WHEN SourceType <> 'forensic' THEN DstPort ELSE 0 END AS DstPort,
       CASE SourceType WHEN 'wef' THEN 'tcp'
            WHEN 'netflow' THEN CASE k % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' ELSE '47' END
            ELSE '' END AS NetworkProtocol,
       ProvenanceTag, IngestTimestamp, CASE WHEN k % 2 = 0 THEN k END AS extra_k
FROM sec
"""
sql("normalize_events", SEC, _NORMALIZED)
sql("stream_normalize", SEC, _NORMALIZED)
sql(
    "ingest_rejects",
    SEC,
    """
SELECT date_trunc('hour', IngestTimestamp) AS TimeGenerated,
       CASE WHEN e % 10 = 3 THEN 'EventSizeCap' ELSE 'ParseError' END AS EventType,
       'Warning' AS Severity, SourceType AS SourceId, count(*) AS EventCount
FROM sec WHERE e % 10 IN (3, 7, 9) GROUP BY ALL
""",
)
sql(
    "coerce_ints",
    SEC,
    """
SELECT EventRecordID,
       CAST(CASE k % 5 WHEN 0 THEN EventID WHEN 4 THEN k ELSE CASE WHEN k % 5 = 2 AND k = 0 THEN 0 ELSE 0 END END AS BIGINT) AS event_id,
       CAST(greatest(0, least(65535, (k - 50) * 2000)) AS INTEGER) AS port,
       CAST(greatest(0, least(255, (k - 50) * 2000)) AS INTEGER) AS logon_type
FROM sec
""",
)
sql(
    "parse_hashes",
    SEC,
    """
SELECT EventRecordID,
       CASE WHEN k % 4 IN (0, 2) THEN md5(CAST(e AS VARCHAR)) ELSE '' END AS md5,
       CASE WHEN k % 4 IN (0, 1) THEN sha256(CAST(e AS VARCHAR)) ELSE '' END AS sha256
FROM sec
""",
)
sql(
    "extract_unmapped",
    SEC,
    """
SELECT EventRecordID AS id, SourceType = 'wef' AND k % 2 = 1 AS nothing_left,
       CASE WHEN k % 2 = 0 THEN k END AS k,
       CASE WHEN SourceType = 'netflow' THEN k * 100 END AS bytes,
       CASE WHEN SourceType = 'syslog' THEN 'session for ' || SubjectUserName END AS message
FROM sec
""",
)
sql(
    "stable_record_id",
    "",
    """
SELECT event_id,
       CASE WHEN event_type <> 'view' THEN 'wef:x:0:' || event_id
            ELSE sha256('wef:x:0:{"type": "view", "user": ' || user_id || ', "value_text": "view: ' || value || '"}')
       END AS record_id
FROM events
""",
)
sql(
    "normalize_long_messages",
    "",
    """
SELECT sha256('syslog:x:0:{"message": ' || CAST(to_json(text) AS VARCHAR) || '}') AS EventRecordID, count(*) AS n
FROM documents GROUP BY 1
""",
)
sql(
    "parse_evidence_csv",
    "",
    "SELECT 'doc-' || doc_id || '.csv' AS file, CAST(0 AS INTEGER) AS position, text AS message, doc_id AS k FROM documents",
)
sql(
    "forest_scores",
    "",
    """
SELECT event_id, round(pow(2.0, -((CASE WHEN value < 100 THEN 1.0 WHEN k < 30 THEN 3.5 ELSE 2.0 END
       + CASE WHEN k < 50 THEN 6.25 ELSE 1.0 END) / 2) / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)), 4) AS anomaly_score
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""",
)
sql(
    "decompression_gate",
    "",
    """
SELECT 'doc-' || doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN 2000 ELSE octet_length(encode(text)) END AS expanded,
       CASE WHEN doc_id % 3 = 0 THEN 'DecompressionCapTrip' WHEN doc_id % 3 = 1 THEN 'CorruptArchive' ELSE 'accepted' END AS verdict
FROM documents
""",
)
sql("dedup_events", SEC, f"SELECT {KEYS}, IngestTimestamp FROM sec")
sql(
    "map_upload",
    SEC,
    """
SELECT EventRecordID AS row_id, HostName, EventID, CAST(0 AS INTEGER) AS SrcPort, DstPort,
       upper(ServiceName) AS ServiceName, IngestTimestamp AS TimeGenerated,
       'manual-upload:' || left(sha256(HostName || '.jsonl'), 8) || ':' || (epoch_ms(IngestTimestamp) // 1000) AS ProvenanceTag,
       k % 2 = 0 AS had_unmapped, CASE WHEN k % 2 = 0 THEN k END AS extra
FROM sec
""",
)
_CLASS = "CASE EventID WHEN 4662 THEN 201001 WHEN 10 THEN 1007 ELSE 3002 END"
_TABLE = (
    "CASE EventID WHEN 4662 THEN 'ASimRegistryEvent' WHEN 10 THEN 'ASimProcessEvent' ELSE 'ASimAuthentication' END"
)
sql(
    "classify_events",
    SEC,
    f"SELECT EventRecordID, CAST({_CLASS} AS INTEGER) AS EventClass, {_TABLE} AS OutputTable FROM sec",
)
sql(
    "project_asim",
    SEC,
    """
SELECT TimeGenerated, EventID, EventRecordID AS EventOriginalUid, HostName AS DvcHostname,
       SubjectUserName AS ActorUsername, '' AS ActorUserId, '' AS ActorUserDomain,
       TargetUserName AS TargetUsername, '' AS TargetUserId, '' AS TargetUserDomain,
       LogonType AS LogonMethod, SrcIpAddr, CAST(0 AS INTEGER) AS SrcPortNumber, '' AS EventProduct
FROM sec WHERE EventID IN (4624, 4768, 4769)
""",
)
sql(
    "project_output",
    SEC,
    f"SELECT {_TABLE} AS OutputTable, true AS accepted, count(*) AS events FROM sec GROUP BY 1",
)
sql(
    "unwrap_nested",
    SEC,
    """
SELECT 'wef:x:0:' || EventRecordID AS EventRecordID, TimeGenerated, HostName, EventID, ChannelName,
       'Security-Auditing' AS ProviderName, TargetUserName, ServiceName, ProcessImagePath, SrcIpAddr,
       DstPort AS SrcPort, '' AS UnmappedFields
FROM sec
""",
)
sql(
    "promote_fields",
    SEC,
    """
SELECT EventRecordID,
       CASE WHEN EventID = 4769 THEN CASE WHEN k % 2 = 0 THEN '0x17' ELSE '0x12' END ELSE '' END AS TicketEncryptionType,
       CASE WHEN EventID = 4768 THEN CAST(k % 3 AS VARCHAR) ELSE '' END AS PreAuthType, TargetImage
FROM sec
""",
)
sql(
    "decode_base64",
    "",
    "SELECT doc_id, sha256(text || ' -- end of line --' || chr(10) || 'second run of ' || doc_id) AS decoded_sha FROM documents",
)

_SHOWN = (
    "strftime({0}, '%Y-%m-%d %H:%M:%S') || ' UTC (' || strftime({0} {1}, '%H:%M:%S') || ' {2})'"
)
sql(
    "display_times",
    SEC,
    f"""
SELECT EventRecordID, {_SHOWN.format("TimeGenerated", "+ INTERVAL '2 hours'", "+02:00")} AS event_time,
       CASE WHEN DstPort = 445 THEN {_SHOWN.format("IngestTimestamp", "- INTERVAL '330 minutes'", "-05:30")}
            ELSE '—' END AS ingest_time
FROM sec
""",
)

# -- search -----------------------------------------------------------------

sql(
    "list_events",
    SEC,
    f"SELECT {KEYS} FROM sec WHERE EventID = 4769 ORDER BY TimeGenerated DESC, EventRecordID LIMIT 1000",
)
sql("list_events_count", SEC, "SELECT count(*) AS total FROM sec WHERE EventID = 4769")
for _name, _where in {
    "search_ip": "SrcIpAddr = '127.0.0.1' OR DstIpAddr = '127.0.0.1'",
    "search_user": "SubjectUserName = 'user8' OR TargetUserName = 'user8'",
    "search_host": "HostName = 'host7'",
    "search_port": "DstPort = 3389",
    "search_eventid": "EventID = 4662",
    "search_process": r"prefix(ProcessImagePath, 'C:\tools\p1')",
    "search_hash": "md5(HostName) = md5('host7')",
    "search_incident": "EventID = 4769 AND HostName = 'host3'",
    "entity_events": "SubjectUserName = 'user15' OR TargetUserName = 'user15'",
    "replay_range": "DstPort = 445",
}.items():
    sql(_name, SEC, f"SELECT {KEYS} FROM sec WHERE {_where}")

_IOC = (
    SEC
    + """, ioc AS (
  SELECT 'IP' AS type, '10.1.0.' || s_suppkey AS value FROM supplier
  UNION SELECT 'Username', 'user' || s_suppkey FROM supplier
  UNION SELECT 'Hostname', 'host' || (3 * s_suppkey) FROM supplier
  UNION SELECT 'Port', CAST(440 + s_suppkey % 8 AS VARCHAR) FROM supplier
  UNION SELECT 'EventID', CAST(4600 + s_suppkey % 70 AS VARCHAR) FROM supplier
  UNION SELECT 'ProcessName', 'C:\\tools\\p' || s_suppkey || '.exe' FROM supplier
  UNION SELECT 'FileHash', md5('host' || s_suppkey) FROM supplier
), seen AS (
  SELECT 'Hostname' AS type, HostName AS value, 'HostName' AS "column", EventRecordID, TimeGenerated FROM sec
  UNION ALL SELECT 'Port', CAST(DstPort AS VARCHAR), 'DstPort', EventRecordID, TimeGenerated FROM sec
  UNION ALL SELECT 'EventID', CAST(EventID AS VARCHAR), 'EventID', EventRecordID, TimeGenerated FROM sec
  UNION ALL SELECT 'ProcessName', ProcessImagePath, 'ProcessImagePath', EventRecordID, TimeGenerated FROM sec WHERE ProcessImagePath <> ''
  UNION ALL SELECT 'FileHash', md5(HostName), 'FileMD5', EventRecordID, TimeGenerated FROM sec
  UNION ALL
  SELECT 'IP', SrcIpAddr, 'SrcIpAddr', EventRecordID, TimeGenerated FROM sec
  UNION ALL SELECT 'IP', DstIpAddr, 'DstIpAddr', EventRecordID, TimeGenerated FROM sec
  UNION ALL SELECT 'Username', SubjectUserName, 'SubjectUserName', EventRecordID, TimeGenerated FROM sec
  UNION ALL SELECT 'Username', TargetUserName, 'TargetUserName', EventRecordID, TimeGenerated FROM sec
)"""
)
sql("ioc_match", _IOC, 'SELECT type, value, "column", EventRecordID FROM seen JOIN ioc USING (type, value)')
sql(
    "ioc_counts",
    _IOC,
    """
SELECT type, value, count(*) AS sightings, min(TimeGenerated) AS first_seen, max(TimeGenerated) AS last_seen
FROM seen JOIN ioc USING (type, value) GROUP BY type, value
""",
)
_CATEGORIES = {
    "active-directory": "EventID IN (4768, 4769) OR ChannelName = 'Security'",
    "network": "SrcIpAddr <> ''",
    "dns": "EventID IN (4, 3008) OR contains(ServiceName, 'dns')",
    "network-analysis": "DstPort IN (80, 443, 8080, 8443) AND SrcIpAddr <> ''",
    "malware-analysis": "false",
    "log-analysis": "ProvenanceTag <> ''",
}
sql(
    "category_events",
    SEC,
    " UNION ALL ".join(
        f"SELECT '{n}' AS category, EventRecordID FROM sec WHERE {w}" for n, w in _CATEGORIES.items()
    ),
)
sql(
    "category_counts",
    SEC,
    " UNION ALL ".join(
        f"SELECT '{n}' AS category, count(*) AS events FROM sec WHERE {w}" for n, w in _CATEGORIES.items()
    ),
)
sql(
    "category_page",
    SEC,
    f"""
SELECT {KEYS} FROM sec WHERE {_CATEGORIES["network-analysis"]}
ORDER BY TimeGenerated DESC, EventRecordID LIMIT 500 OFFSET 500
""",
)
sql(
    "list_detections",
    HITS,
    """
SELECT hit_id, rule_id, hit_count, severity, created_at, forwarded_at FROM hits
WHERE severity = 'High' AND forwarded_at IS NOT NULL
  AND created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
""",
)
_IN_MONTH = "{0} >= TIMESTAMP '2024-01-01' AND {0} < TIMESTAMP '2024-01-31'"
_EVENTS_MONTH = _IN_MONTH.format("TimeGenerated")
_HITS_MONTH = _IN_MONTH.format("created_at")
sql(
    "hunt_recent",
    SEC,
    f"""
SELECT TimeGenerated, HostName, EventID, SubjectUserName, SrcIpAddr, ProvenanceTag FROM sec
WHERE {_EVENTS_MONTH} ORDER BY TimeGenerated DESC, EventRecordID LIMIT 100
""",
)
sql(
    "hunt_top_rules",
    HITS,
    f"""
SELECT rule_id, severity, count(*) AS hit_count, max(anomaly_score) AS max_anomaly FROM hits
WHERE {_HITS_MONTH} GROUP BY ALL ORDER BY hit_count DESC, rule_id, severity LIMIT 50
""",
)
sql(
    "hunt_by_source",
    SEC,
    f"SELECT ProvenanceTag, count(*) AS event_count FROM sec WHERE {_EVENTS_MONTH} GROUP BY ProvenanceTag",
)
sql(
    "hunt_anomaly",
    HITS,
    """
SELECT hit_id, rule_id, anomaly_score, hit_count, severity, created_at FROM hits WHERE anomaly_score > 0.7
ORDER BY anomaly_score DESC, created_at DESC, hit_id LIMIT 50
""",
)
sql(
    "hunt_kerberoast",
    SEC,
    """
SELECT TimeGenerated, HostName, SubjectUserName, ServiceName, TargetUserName FROM sec
WHERE EventID = 4769 AND ServiceName NOT LIKE '%$' ORDER BY TimeGenerated DESC, EventRecordID LIMIT 100
""",
)
sql(
    "hunt_unforwarded",
    HITS,
    """
SELECT hit_id, rule_id, severity, hit_count, created_at FROM hits WHERE forwarded_at IS NULL
ORDER BY created_at DESC, hit_id LIMIT 100
""",
)
sql(
    "adhoc_sql",
    SEC,
    "SELECT HostName, EventID, count(*) AS n FROM sec WHERE DstPort = 445 GROUP BY HostName, EventID",
)
sql(
    "list_incidents",
    HITS,
    """
SELECT fingerprint AS incident_id, 'Detection: ' || rule_id AS name, severity, hit_count AS event_count, created_at
FROM hits WHERE rule_id = 'windows-ad-003'
""",
)
sql(
    "cidr_match",
    SEC,
    """
SELECT EventRecordID, SrcIpAddr, DstIpAddr FROM sec
WHERE (prefix(SrcIpAddr, '10.1.0.') AND CAST(split_part(SrcIpAddr, '.', 4) AS INTEGER) BETWEEN 0 AND 63)
   OR CAST(split_part(DstIpAddr, '.', 4) AS INTEGER) BETWEEN 8 AND 15
""",
)
_IPV4 = (
    "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536"
    " + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"
)
sql(
    "cidr_table_match",
    SEC
    + f""", nets AS (
  SELECT base || '/' || bits AS cidr, {_IPV4.format("base")} // (CAST(1 AS BIGINT) << (32 - bits)) AS net, bits
  FROM (SELECT '10.' || (n_nationkey % 4) || '.0.' || (n_nationkey // 4) * 8 AS base,
               CAST(29 - n_regionkey AS INTEGER) AS bits FROM nation
        UNION ALL SELECT '0.0.0.0', 0)
), addresses AS (
  SELECT {_IPV4.format("SrcIpAddr")} AS address, count(*) AS n FROM sec GROUP BY 1
)""",
    """
SELECT cidr, CAST(sum(n) AS BIGINT) AS events, count(*) AS addresses
FROM addresses JOIN nets ON address // (CAST(1 AS BIGINT) << (32 - bits)) = net GROUP BY cidr
""",
)

# -- rules ------------------------------------------------------------------

sql(
    "detect_rules",
    MATCHES,
    """
SELECT rule_id, time_bucket(INTERVAL '15 minutes', TimeGenerated) AS window_start, count(*) AS matches
FROM matches GROUP BY ALL
""",
)
for _number in range(1, 7):
    sql(
        f"rule_ad_{_number:03d}",
        MATCHES,
        f"SELECT {KEYS} FROM matches WHERE rule_id = 'windows-ad-{_number:03d}'",
    )
sql(
    "rules_precise",
    SEC,
    """
SELECT 'windows-ad-001-rc4' AS rule_id, EventRecordID FROM sec
WHERE EventID = 4769 AND ServiceName NOT LIKE '%$' AND k % 2 = 0
UNION ALL
SELECT 'windows-ad-002-nopreauth', EventRecordID FROM sec
WHERE EventID = 4768 AND TargetUserName NOT LIKE '%$' AND k % 3 = 0
""",
)
sql(
    "self_rules",
    HEALTH + CHANGES.replace("WITH changes", ", changes", 1),
    """
SELECT 'SELF-002' AS rule_id, 'High' AS severity, TimeGenerated, EventType FROM flood
UNION ALL
SELECT 'SELF-003', 'High', TimeGenerated, 'RuleChangeAudit' FROM audit WHERE new_status IN ('draft', 'disabled')
UNION ALL
SELECT 'SELF-004', 'High', TIMESTAMP '2024-01-31', 'DecompressionCapTrip' FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT 'SELF-005', 'High', TIMESTAMP '2024-01-31', 'LedgerDelta' FROM sec GROUP BY strftime(TimeGenerated, '%Y%m'), SourceType
HAVING count(*) FILTER (DstPort = 445) > greatest(count(*) * 0.05, 50.0)
""",
)
_HIT_COLUMNS = (
    "hit_id, rule_id, rule_version, batch_start, batch_end, event_record_ids, hit_count, level, severity,"
    " mitre_tag, created_at"
)
sql("detection_hits", HITS, f"SELECT {_HIT_COLUMNS} FROM hits")
sql("stream_detect", HITS, "SELECT hit_id, rule_id, batch_start, hit_count, severity FROM hits")
sql(
    "detection_hits_chunked",
    MATCHES,
    """
SELECT rule_id, date_trunc('day', TimeGenerated) AS batch_start, CAST(ceil(count(*) / 5.0) AS INTEGER) AS chunks,
       count(*) AS hit_count, count(*) AS ids
FROM matches GROUP BY ALL
""",
)
sql(
    "threshold_tumbling",
    SEC,
    """
SELECT SubjectUserName AS entity, date_trunc('hour', TimeGenerated) AS window_start, count(*) AS events
FROM sec GROUP BY ALL HAVING count(*) >= 2
""",
)
_SLIDING = """
SELECT SubjectUserName AS entity, time_bucket(INTERVAL '10 minutes', TimeGenerated) - to_minutes(10 * b) AS window_start,
       count(*) AS events
FROM sec, (VALUES (0), (1), (2), (3), (4), (5)) AS v(b) GROUP BY ALL HAVING count(*) >= 2
"""
sql("threshold_sliding", SEC, _SLIDING)
sql(
    "threshold_exact",
    SEC,
    """
SELECT DISTINCT entity, moment, events FROM (
  SELECT SubjectUserName AS entity, TimeGenerated AS moment,
         count(*) OVER (PARTITION BY SubjectUserName ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS events
  FROM sec)
WHERE events >= 2
""",
)
_SEQUENCE = (
    SEC
    + """, firsts AS (
  SELECT SubjectUserName AS entity, ms, min(TimeGenerated) AS first_at, count(*) AS first_events,
         min(EventRecordID) AS first_id
  FROM sec WHERE EventID = 4768 GROUP BY ALL
), seconds AS (
  SELECT SubjectUserName AS entity, ms, min(TimeGenerated) AS next_at, min(EventRecordID) AS next_id
  FROM sec WHERE EventID = 4769 GROUP BY ALL
), pairs AS (
  SELECT f.entity, f.ms, f.first_at, f.first_events, f.first_id, s.next_at, s.next_id
  FROM firsts f JOIN seconds s ON s.entity = f.entity AND s.ms > f.ms AND s.ms <= f.ms + 21600000
  QUALIFY row_number() OVER (PARTITION BY f.entity, f.ms ORDER BY s.ms) = 1
)"""
)
sql("sequence_next", _SEQUENCE, "SELECT entity, first_at, first_events, first_id, next_at, next_id FROM pairs")
sql(
    "sequence_diff_host",
    SEC
    + """, seen AS (
  SELECT TargetUserName AS entity, ms, HostName AS host, min(TimeGenerated) AS at, count(*) AS events
  FROM sec WHERE EventID = 4624 GROUP BY ALL
)""",
    """
SELECT a.entity, a.at AS first_at, a.host AS first_host, a.events, b.at AS next_at, b.host AS next_host
FROM seen a JOIN seen b ON b.entity = a.entity AND b.host <> a.host AND b.ms <= a.ms + 3600000
 AND (b.ms > a.ms OR (b.ms = a.ms AND b.host > a.host))
QUALIFY row_number() OVER (PARTITION BY a.entity, a.ms, a.host ORDER BY b.ms, b.host) = 1
""",
)
sql(
    "fanout",
    SEC,
    """
SELECT SubjectUserName AS entity, date_trunc('day', TimeGenerated) AS window_start, count(DISTINCT DstIpAddr) AS targets
FROM sec GROUP BY ALL HAVING count(DISTINCT DstIpAddr) >= 3
""",
)
sql(
    "entity_state",
    SEC,
    """
SELECT 'second-logon' AS rule_id, TargetUserName AS entity_key, date_trunc('hour', TimeGenerated) AS window_start,
       count(*) AS event_count, date_trunc('hour', TimeGenerated) + INTERVAL '1 hour' AS expiry
FROM sec WHERE EventID = 4624 GROUP BY ALL
""",
)
sql(
    "rule_fixture_check",
    MATCHES
    + """, labelled AS (
  SELECT EventRecordID, CASE WHEN EventID = 4769 THEN 'windows-ad-001' WHEN EventID = 4768 THEN 'windows-ad-002'
         WHEN EventID = 4662 THEN 'windows-ad-003' WHEN EventID = 10 THEN 'windows-ad-004'
         WHEN LogonType = 3 THEN 'windows-ad-005' WHEN LogonType = 10 THEN 'windows-ad-006' END AS rule_id
  FROM sec
)""",
    """
SELECT l.rule_id, count(m.EventRecordID) AS true_positive, count(*) - count(m.EventRecordID) AS true_negative,
       CAST(0 AS BIGINT) AS false_positive, CAST(0 AS BIGINT) AS false_negative
FROM labelled l LEFT JOIN matches m ON m.rule_id = l.rule_id AND m.EventRecordID = l.EventRecordID
WHERE l.rule_id IS NOT NULL GROUP BY l.rule_id
""",
)
sql(
    "rule_dry_run",
    MATCHES,
    """
SELECT HostName, count(*) AS matches, string_agg(EventRecordID, ',' ORDER BY EventRecordID) FILTER (rn <= 20) AS sample_ids
FROM (SELECT *, row_number() OVER (PARTITION BY HostName ORDER BY TimeGenerated DESC, EventRecordID DESC) AS rn
      FROM matches WHERE rule_id = 'windows-ad-001')
GROUP BY HostName
""",
)
sql(
    "rule_coverage",
    MATCHES,
    """
SELECT rule_id, status, mitre_tag, count(EventRecordID) AS matches, max(TimeGenerated) AS last_match,
       status = 'production' AND mitre_tag <> '' AS technique_covered, count(EventRecordID) = 0 AS silent
FROM (SELECT * FROM rule_meta UNION ALL SELECT * REPLACE ('planned-001' AS rule_id) FROM rule_meta WHERE rule_id = 'windows-ad-001')
LEFT JOIN matches USING (rule_id)
GROUP BY rule_id, status, mitre_tag
""",
)
sql(
    "telemetry_gaps",
    SEC,
    """
SELECT * FROM (VALUES ('planned-001', 'Security', CAST(4625 AS BIGINT)), ('planned-002', 'Security', CAST(10 AS BIGINT)))
  AS v(rule_id, ChannelName, EventID)
WHERE NOT EXISTS (SELECT 1 FROM sec s WHERE s.ChannelName = v.ChannelName AND s.EventID = v.EventID)
""",
)

# -- correlation, ledgers -----------------------------------------------------

sql(
    "lateral_movement",
    SEC
    + """, logons AS (
  SELECT SrcIpAddr AS address, LogonType AS logon_type, CASE LogonType WHEN 3 THEN 445 ELSE 3389 END AS port,
         ms, TimeGenerated AS logon_at, count(*) AS logons
  FROM sec WHERE EventID = 4624 AND LogonType IN (3, 10) AND SourceType <> 'netflow' GROUP BY ALL
), flows AS (
  SELECT SrcIpAddr AS address, DstPort AS port, ms, TimeGenerated AS at FROM sec
  WHERE SourceType = 'netflow' AND DstPort IN (445, 3389)
)""",
    """
SELECT l.address, logon_type, logon_at, logons, count(*) AS flows,
       max(f.at) FILTER (f.ms <= l.ms) AS flow_before, min(f.at) FILTER (f.ms >= l.ms) AS flow_after
FROM logons l JOIN flows f ON f.address = l.address AND f.port = l.port AND f.ms BETWEEN l.ms - 43200000 AND l.ms + 43200000
GROUP BY l.address, logon_type, logon_at, logons, l.ms
""",
)
sql(
    "new_source",
    SEC,
    f"""
SELECT SubjectUserName AS entity, SrcIpAddr AS address, min(TimeGenerated) AS first_seen, count(*) AS events
FROM sec s WHERE TimeGenerated >= TIMESTAMP '2024-01-28' AND TimeGenerated < TIMESTAMP '2024-01-31'
  AND NOT EXISTS (SELECT 1 FROM sec b WHERE b.SubjectUserName = s.SubjectUserName AND b.SrcIpAddr = s.SrcIpAddr
                  AND b.TimeGenerated < TIMESTAMP '2024-01-28' AND {_EVENTS_MONTH.replace("TimeGenerated", "b.TimeGenerated")})
GROUP BY ALL
""",
)
_NEW_DAYS = """
SELECT p.entity, p.day, count(*) AS new_addresses
FROM {0} p
WHERE NOT EXISTS (SELECT 1 FROM {0} q WHERE q.entity = p.entity AND q.address = p.address
                  AND q.day < p.day AND q.day >= p.day - {1})
  AND EXISTS (SELECT 1 FROM {0} q WHERE q.entity = p.entity AND q.day < p.day AND q.day >= p.day - {1})
GROUP BY p.entity, p.day
"""
sql(
    "new_source_days",
    SEC
    + """, pairs AS (
  SELECT DISTINCT SubjectUserName AS entity, SrcIpAddr AS address, CAST(TimeGenerated AS DATE) AS day FROM sec
)""",
    _NEW_DAYS.format("pairs", 7),
)
sql(
    "pending_batches",
    HITS,
    """
SELECT hit_id, rule_id, severity, hit_count, created_at, position, (position - 1) // 200 AS batch_no
FROM (SELECT *, row_number() OVER (ORDER BY created_at, hit_id) AS position FROM hits WHERE forwarded_at IS NULL)
""",
)
sql(
    "delivery_marking",
    HITS,
    """
SELECT hit_id, rule_id, severity, hit_count, created_at, row_number() OVER (ORDER BY created_at, hit_id) AS position,
  (row_number() OVER (ORDER BY created_at, hit_id) - 1) // 5 AS batch_no
FROM (SELECT * FROM hits WHERE forwarded_at IS NULL QUALIFY row_number() OVER (ORDER BY created_at, hit_id) > 10)
""",
)
sql(
    "new_evidence",
    MATCHES,
    "SELECT rule_id, EventRecordID, TimeGenerated FROM matches WHERE TimeGenerated >= TIMESTAMP '2024-01-17' AND TimeGenerated < TIMESTAMP '2024-01-31'",
)
sql(
    "security_records",
    HITS,
    """
SELECT created_at AS TimeGenerated, rule_id AS RuleId, 'DetectionHit' AS EventType, severity AS Severity,
       mitre_tag AS ATTACKTechnique, hit_id, strftime(batch_start, '%Y-%m-%d %H:%M:%S') || '.000' AS batch_start,
       hit_count, hit_count AS source_ids
FROM hits
""",
)
sql(
    "incidents",
    HITS,
    """
SELECT fingerprint, 'Detection: ' || rule_id AS title, severity, rule_id, hit_count, mitre_tag, created_at
FROM hits WHERE severity = 'High'
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at, hit_id) = 1
""",
)
sql(
    "incidents_known",
    HITS,
    "SELECT fingerprint, rule_id, created_at FROM hits WHERE severity = 'High' AND hit_count = 1",
)
sql(
    "incident_evidence",
    SEC,
    """
SELECT 'host' || n_nationkey AS incident_id, n_name AS name, count(EventRecordID) AS event_count,
       min(TimeGenerated) AS first_event, max(TimeGenerated) AS last_event, count(DISTINCT HostName) AS hosts,
       count(DISTINCT SubjectUserName) AS users
FROM nation LEFT JOIN sec ON HostName = 'host' || n_nationkey GROUP BY ALL
""",
)
sql(
    "enrich_event_desc",
    SEC,
    """
SELECT EventRecordID, EventID, CASE EventID WHEN 4624 THEN 'An account was successfully logged on'
       WHEN 4769 THEN 'A Kerberos service ticket was requested'
       WHEN 4768 THEN 'A Kerberos authentication ticket (TGT) was requested'
       WHEN 10 THEN 'ProcessAccess (Sysmon)' END AS EventDescription
FROM sec
""",
)
sql(
    "reconcile_counts",
    SEC,
    """
SELECT batch_id, stream_tag, local_count, received_count, local_count - received_count AS delta,
       local_count - received_count > greatest(local_count * 0.05, 50.0) AS lost,
       received_count - local_count > greatest(local_count * 0.05, 50.0) AS surplus
FROM (SELECT strftime(TimeGenerated, '%Y%m') AS batch_id, SourceType AS stream_tag, count(*) AS local_count,
             count(*) FILTER (DstPort <> 445) AS received_count FROM sec GROUP BY ALL)
""",
)
sql(
    "reconcile_stages",
    SEC,
    """
SELECT SourceType AS source, date_trunc('hour', IngestTimestamp) AS hour, count(*) AS accepted,
       count(*) FILTER (DstPort <> 53) AS stored, count(*) FILTER (DstPort = 53) AS lost
FROM sec GROUP BY ALL
""",
)
sql("latest_rule_state", CHANGES, "SELECT rule_id, status, updated_at FROM latest")
sql(
    "active_rules",
    CHANGES,
    "SELECT rule_id, status, updated_at FROM latest WHERE status IN ('test', 'review', 'production')",
)
sql("rule_audit", CHANGES, "SELECT TimeGenerated, RuleId, old_status, new_status, Severity FROM audit")
sql(
    "audit_gaps",
    CHANGES,
    """
SELECT RuleId, old_status, new_status, TimeGenerated FROM audit a WHERE new_status IN ('draft', 'disabled')
  AND NOT EXISTS (SELECT 1 FROM audit b WHERE b.RuleId = a.RuleId AND b.new_status = a.new_status
                  AND b.old_status <> 'production' AND b.TimeGenerated <= a.TimeGenerated)
""",
)
sql("rules_by_status", CHANGES, "SELECT status, count(*) AS rules FROM latest GROUP BY status")
sql(
    "forwardable_hits",
    HITS,
    """
SELECT hit_id, rule_id FROM hits JOIN (
  SELECT 'windows-ad-00' || (1 + user_id % 6) AS rule_id,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'production' ELSE 'disabled' END AS status
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts DESC, status DESC) = 1
) USING (rule_id) WHERE status = 'production'
""",
)
sql(
    "forward_ledger",
    SEC,
    """
SELECT strftime(TimeGenerated, '%Y%m%d') AS batch_id, SourceType AS stream_tag, count(*) AS event_count,
       min(TimeGenerated) AS batch_start, max(TimeGenerated) AS batch_end,
       arg_min(EventRecordID, (TimeGenerated, EventRecordID)) AS first_event_uid,
       arg_max(EventRecordID, (TimeGenerated, EventRecordID)) AS last_event_uid
FROM sec GROUP BY ALL
""",
)
sql(
    "pack_batches",
    SEC,
    """
SELECT SourceType, batch_key, count(*) AS events, CAST(sum(size) AS BIGINT) AS bytes, min(TimeGenerated) AS first_event
FROM (
  SELECT SourceType, TimeGenerated, size,
         ((row_number() OVER w - 1) // 50) || '-' || CAST((sum(size) OVER w - size) AS BIGINT) // (200000 - 65536) AS batch_key
  FROM (SELECT *, CAST(k * 100 + 200 AS BIGINT) AS size FROM sec)
  WINDOW w AS (PARTITION BY SourceType ORDER BY TimeGenerated, EventRecordID ROWS UNBOUNDED PRECEDING)
) GROUP BY SourceType, batch_key
""",
)
sql(
    "pack_batches_greedy",
    SEC.replace("WITH base", "WITH RECURSIVE base", 1)
    + """, numbered AS MATERIALIZED (
  SELECT SourceType, CAST(k * 100 + 200 AS BIGINT) AS size, row_number() OVER (PARTITION BY SourceType ORDER BY TimeGenerated, EventRecordID) AS n
  FROM sec
), walk AS (
  SELECT SourceType, n, size, CAST(0 AS BIGINT) AS batch_no, CAST(1 AS BIGINT) AS held, size AS bytes FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.SourceType, m.n, m.size, w.batch_no + CASE WHEN w.held >= 50 OR w.bytes + m.size > 200000 THEN 1 ELSE 0 END,
         CASE WHEN w.held >= 50 OR w.bytes + m.size > 200000 THEN 1 ELSE w.held + 1 END,
         CASE WHEN w.held >= 50 OR w.bytes + m.size > 200000 THEN m.size ELSE w.bytes + m.size END
  FROM walk w JOIN numbered m ON m.SourceType = w.SourceType AND m.n = w.n + 1
)""",
    """
SELECT SourceType, min((n - 1) // 50000) AS segment, batch_no, count(*) AS events, CAST(sum(size) AS BIGINT) AS bytes
FROM walk GROUP BY SourceType, batch_no
""",
)
_DAYS = (
    "CASE WHEN SourceType = 'wef' AND EventID = 10 THEN 14 WHEN SourceType = 'wef' THEN 14"
    " WHEN SourceType = 'forensic' THEN 30 ELSE 7 END"
)
sql(
    "apply_retention",
    SEC,
    f"SELECT {KEYS} FROM sec WHERE TimeGenerated >= TIMESTAMP '2024-01-31' - to_days({_DAYS})",
)
sql(
    "purge_events",
    SEC,
    f"SELECT {KEYS} FROM sec WHERE TimeGenerated >= TIMESTAMP '2024-01-31' - to_days({_DAYS})",
)
sql(
    "replay_ranges",
    SEC,
    f"""
SELECT batch_id, {KEYS} FROM sec, (VALUES ('a', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-05'), ('c', TIMESTAMP '2024-01-04', TIMESTAMP '2024-01-09')) r(batch_id, low, high)
WHERE TimeGenerated >= low AND TimeGenerated < high AND DstPort = 445
""",
)
sql(
    "purge_report",
    SEC
    + """, parts AS (
  SELECT strftime(TimeGenerated, '%Y%m') AS partition,
         CASE WHEN SourceType = 'wef' AND EventID = 10 THEN 'sysmon' ELSE SourceType END AS source_type,
         count(*) AS n, count(*) FILTER (SourceType <> 'netflow' OR DstPort <> 53) AS sent,
         min(TimeGenerated) AS first_event, max(TimeGenerated) AS last_event
  FROM sec GROUP BY ALL
)""",
    """
SELECT partition, source_type, CAST(strptime(partition, '%Y%m') AS DATE) AS DateRangeStart,
       last_day(CAST(strptime(partition, '%Y%m') AS DATE)) AS DateRangeEnd, n AS EventCountEstimate,
       first_event, last_event, sent = n AS ForwardingConfirmed,
       CASE WHEN sent = n THEN 'PartitionPurge' ELSE 'PurgeBeforeForward' END AS EventType,
       CASE WHEN sent = n THEN 'Informational' ELSE 'Warning' END AS Severity
FROM parts
WHERE last_day(CAST(strptime(partition, '%Y%m') AS DATE))
      < DATE '2024-02-20' - CASE source_type WHEN 'forensic' THEN 30 WHEN 'wef' THEN 14 WHEN 'sysmon' THEN 14 ELSE 7 END
""",
)
sql(
    "batch_health",
    HEALTH,
    "SELECT TimeGenerated, EventType, Severity, SourceId, EventCount, Detail, BatchId FROM batch",
)

# -- figures ------------------------------------------------------------------

sql(
    "events_by_source",
    SEC,
    f"SELECT SourceType, count(*) AS event_count FROM sec WHERE {_EVENTS_MONTH} GROUP BY SourceType",
)
sql(
    "hit_kpis",
    HITS,
    """
SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-30' AND created_at < TIMESTAMP '2024-01-31') AS hits,
       max(created_at) AS last_batch_at
FROM hits
""",
)
sql(
    "score_histogram",
    HITS,
    f"""
SELECT CAST(b AS INTEGER) AS bucket, printf('%.1f', b / 10.0) || '-' || printf('%.1f', (b + 1) / 10.0) AS label,
       count(hit_id) AS hits
FROM range(10) AS r(b) LEFT JOIN (SELECT * FROM hits WHERE {_HITS_MONTH})
  ON least(floor(round(anomaly_score * 10, 6)), 9) = b
GROUP BY b
""",
)
_HOURLY = f"""
SELECT date_trunc('hour', TimeGenerated) AS hour, SourceType, count(*) AS event_count FROM sec
WHERE {_EVENTS_MONTH} GROUP BY """
sql("hourly_volume", SEC, _HOURLY + "ALL")
sql("volume_levels", SEC, _HOURLY + "CUBE (date_trunc('hour', TimeGenerated), SourceType)")
sql(
    "hit_timeline",
    HITS,
    "SELECT date_trunc('hour', created_at) AS hour, severity, count(*) AS hits FROM hits GROUP BY ALL",
)
sql(
    "hit_timeline_matrix",
    HITS,
    """
SELECT h.hour, count(*) FILTER (severity = 'High') AS "High", count(*) FILTER (severity = 'Medium') AS "Medium",
       count(*) FILTER (severity = 'Low') AS "Low", count(*) FILTER (severity = 'Informational') AS "Informational"
FROM (SELECT unnest(generate_series(min(date_trunc('hour', created_at)), max(date_trunc('hour', created_at)),
                                    INTERVAL '1 hour')) AS hour FROM hits) h
LEFT JOIN hits ON date_trunc('hour', created_at) = h.hour GROUP BY h.hour
""",
)
sql(
    "pipeline_latency",
    SEC,
    f"""
SELECT round(avg(latency_ms) / 1000.0, 6) AS avg_seconds, round(quantile_cont(latency_ms, 0.95) / 1000.0, 6) AS p95_seconds
FROM sec WHERE {_EVENTS_MONTH}
""",
)
sql(
    "source_stats",
    SEC,
    f"""
SELECT SourceType, max(TimeGenerated) AS last_seen, round(count(*) / 720.0, 6) AS events_per_hour,
       round(count(*) FILTER (UnmappedFields <> '') * 100.0 / count(*), 6) AS unmapped_pct
FROM sec WHERE {_EVENTS_MONTH} GROUP BY SourceType
""",
)
sql(
    "top_rules",
    HITS,
    f"""
SELECT rule_id, severity, count(*) AS hits, max(anomaly_score) AS max_score FROM hits WHERE {_HITS_MONTH}
GROUP BY rule_id, severity ORDER BY count(*) DESC, rule_id, severity LIMIT 20
""",
)
sql(
    "score_percentiles",
    HITS,
    f"""
SELECT round(quantile_cont(anomaly_score, 0.95), 6) AS p95, round(quantile_cont(anomaly_score, 0.99), 6) AS p99
FROM hits WHERE {_HITS_MONTH} AND anomaly_score > 0
""",
)
sql(
    "severity_breakdown",
    HITS,
    f"SELECT severity, count(*) AS hits FROM hits WHERE {_HITS_MONTH} GROUP BY severity",
)
sql(
    "ledger_totals",
    SEC,
    """
SELECT stream_tag, CAST(sum(n) AS BIGINT) AS total FROM (
  SELECT SourceType AS stream_tag, count(*) AS n, max(TimeGenerated) AS forwarded_at FROM sec
  GROUP BY SourceType, date_trunc('day', TimeGenerated))
WHERE forwarded_at >= TIMESTAMP '2024-01-01' AND forwarded_at < TIMESTAMP '2024-01-31' GROUP BY stream_tag
""",
)
_DAY = "{0} >= TIMESTAMP '2024-01-30' AND {0} < TIMESTAMP '2024-01-31'"
sql(
    "stats_bundle",
    HITS,
    f"""
SELECT 'events_24h_by_source' AS section, SourceType AS name, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS more FROM sec
  WHERE {_DAY.format("TimeGenerated")} GROUP BY SourceType
UNION ALL SELECT 'events_7d_by_source', SourceType, count(*), NULL FROM sec
  WHERE TimeGenerated >= TIMESTAMP '2024-01-24' AND TimeGenerated < TIMESTAMP '2024-01-31' GROUP BY SourceType
UNION ALL SELECT 'top_hits_24h', rule_id || '|' || severity, count(*), max(anomaly_score) FROM hits
  WHERE {_DAY.format("created_at")} GROUP BY rule_id, severity
UNION ALL SELECT 'score_percentiles_24h', '', round(quantile_cont(anomaly_score, 0.95), 6), round(quantile_cont(anomaly_score, 0.99), 6) FROM hits
  WHERE {_DAY.format("created_at")} AND anomaly_score > 0
UNION ALL SELECT 'severity_24h', severity, count(*), NULL FROM hits WHERE {_DAY.format("created_at")} GROUP BY severity
UNION ALL SELECT 'forwarded_24h', stream_tag, sum(n), NULL FROM (
  SELECT SourceType AS stream_tag, count(*) AS n, max(TimeGenerated) AS last FROM sec GROUP BY strftime(TimeGenerated, '%Y%m%d'), SourceType)
  WHERE {_DAY.format("last")} GROUP BY stream_tag
UNION ALL SELECT 'batch_marker', '', epoch(max(created_at)), NULL FROM hits
""",
)
sql(
    "rule_rollup",
    HITS,
    """
SELECT rule_id, CAST(sum(hit_count) AS BIGINT) AS total_hits, max(mitre_tag) AS mitre_tag, max(created_at) AS last_fired
FROM hits GROUP BY rule_id
""",
)
sql(
    "health_summary",
    HEALTH,
    f"SELECT EventType, Severity, count(*) AS records FROM health WHERE {_EVENTS_MONTH} GROUP BY ALL",
)
sql(
    "health_alert",
    HITS,
    """
SELECT date_trunc('hour', created_at) AS hour, count(*) AS failures FROM hits WHERE forwarded_at IS NULL
GROUP BY 1 HAVING count(*) >= 3
""",
)
sql(
    "distinct_entities",
    SEC,
    f"""
SELECT DISTINCT HostName, SubjectUserName, SrcIpAddr, DstIpAddr, ProcessImagePath FROM sec WHERE {_EVENTS_MONTH}
""",
)
sql(
    "pipeline_trend",
    SEC,
    """
SELECT hour, SourceType, events, unparsed_share, avg_latency,
       round(avg(events) OVER (PARTITION BY SourceType ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS moving_events,
       events - lag(events) OVER (PARTITION BY SourceType ORDER BY hour) AS change
FROM (SELECT date_trunc('hour', TimeGenerated) AS hour, SourceType, count(*) AS events, CAST(0.0 AS DOUBLE) AS unparsed_share,
             round(avg(latency_ms) / 1000.0, 6) AS avg_latency FROM sec GROUP BY ALL)
""",
)
sql(
    "late_report",
    SEC,
    """
SELECT SourceType, count(*) FILTER (latency_ms > 300000) AS late, count(*) AS events, max(latency_ms) AS max_latency_ms
FROM sec GROUP BY SourceType
""",
)

# -- anomaly ------------------------------------------------------------------

FEATURES = (
    MATCHES
    + """, entities AS (
  SELECT 'user' AS kind, SubjectUserName AS entity, * FROM sec
  UNION ALL SELECT 'host', HostName, * FROM sec
  UNION ALL SELECT 'ip', SrcIpAddr, * FROM sec
), pairs AS (
  SELECT DISTINCT kind || ':' || entity AS entity, SrcIpAddr AS address, CAST(TimeGenerated AS DATE) AS day
  FROM entities WHERE kind <> 'ip'
), fresh AS ("""
    + _NEW_DAYS.format("pairs", 30)
    + """), features AS (
  SELECT c.*, coalesce(f.new_addresses, 0) AS new_addresses FROM (
    SELECT kind, entity, CAST(TimeGenerated AS DATE) AS day, count(*) AS events, count(DISTINCT DstIpAddr) AS destinations,
           round(count(*) FILTER (LogonType = 2) / CAST(count(*) AS DOUBLE), 6) AS interactive_share,
           round(count(*) FILTER (LogonType = 3) / CAST(count(*) AS DOUBLE), 6) AS network_share,
           round(count(*) FILTER (LogonType = 10) / CAST(count(*) AS DOUBLE), 6) AS remote_share,
           round(count(*) FILTER (hour(TimeGenerated) < 8 OR hour(TimeGenerated) >= 18) / CAST(count(*) AS DOUBLE), 6) AS off_hours_share
    FROM entities GROUP BY kind, entity, CAST(TimeGenerated AS DATE)) c
  LEFT JOIN fresh f ON f.entity = c.kind || ':' || c.entity AND f.day = c.day
), scores AS (
  SELECT kind, entity, max(round(least(1.0, events / 20.0), 4)) AS score FROM features GROUP BY kind, entity
)"""
)
sql("entity_features", FEATURES, "SELECT * FROM features")
_Z = (
    "round(CASE WHEN stddev_pop({0}) OVER w > 1e-9 THEN ({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w"
    " WHEN abs({0} - avg({0}) OVER w) <= 1e-9 THEN 0.0 END, 6) AS z_{0}"
)
sql(
    "zscore",
    FEATURES,
    f"""
SELECT kind, entity, day, {_Z.format("events")}, {_Z.format("destinations")} FROM features
WINDOW w AS (PARTITION BY kind, entity ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)
""",
)
_HIT_SCORES = (
    FEATURES
    + ", "
    + HITS[len(MATCHES) :].lstrip(", \n")
    + """, scored AS (
  SELECT time_bucket(INTERVAL '15 minutes', m.TimeGenerated) AS batch_start, m.rule_id,
         greatest(u.score, h.score, i.score) AS score
  FROM matches m JOIN scores u ON u.kind = 'user' AND u.entity = m.SubjectUserName
  JOIN scores h ON h.kind = 'host' AND h.entity = m.HostName
  JOIN scores i ON i.kind = 'ip' AND i.entity = m.SrcIpAddr
)"""
)
sql(
    "score_hits",
    _HIT_SCORES,
    """
SELECT hit_id, rule_id, max(score) AS anomaly_score FROM hits JOIN scored USING (rule_id, batch_start) GROUP BY ALL
""",
)
sql(
    "score_hits_batch",
    _HIT_SCORES,
    """
SELECT hit_id, hits.rule_id, max(score) AS anomaly_score FROM hits JOIN scored USING (batch_start) GROUP BY ALL
""",
)
sql(
    "advisory_records",
    FEATURES,
    """
SELECT TIMESTAMP '2024-01-31' AS TimeGenerated, 'AnomalyAdvisory' AS EventType, 'Low' AS Severity,
       kind || ':' || entity AS Entity, score AS anomaly_score
FROM scores WHERE score > 0.8
""",
)

# -- graph --------------------------------------------------------------------

GRAPH = (
    SEC
    + f""", sliced AS (SELECT * FROM sec WHERE {_EVENTS_MONTH}), mentions AS (
  SELECT HostName AS name, 0 AS category, 0 AS o, ms, EventRecordID FROM sliced
  UNION ALL SELECT SubjectUserName, 1, 1, ms, EventRecordID FROM sliced
  UNION ALL SELECT TargetUserName, 1, 2, ms, EventRecordID FROM sliced
  UNION ALL SELECT SrcIpAddr, 2, 3, ms, EventRecordID FROM sliced
  UNION ALL SELECT DstIpAddr, 2, 4, ms, EventRecordID FROM sliced
  UNION ALL SELECT ProcessImagePath, 3, 5, ms, EventRecordID FROM sliced
), nodes AS (
  SELECT name, arg_min(category, (-ms, o)) AS category, count(*) AS mentions,
         min((-ms, o)) AS seen
  FROM mentions WHERE name <> '' GROUP BY name
), links AS (
  SELECT HostName AS src, SubjectUserName AS dst, 0 AS o, ms, EventRecordID, EventID, TimeGenerated FROM sliced
  UNION ALL SELECT HostName, SrcIpAddr, 1, ms, EventRecordID, EventID, TimeGenerated FROM sliced
  UNION ALL SELECT SrcIpAddr, DstIpAddr, 2, ms, EventRecordID, EventID, TimeGenerated FROM sliced
  UNION ALL SELECT HostName, ProcessImagePath, 3, ms, EventRecordID, EventID, TimeGenerated FROM sliced
), edges AS (
  SELECT src, dst, arg_min(EventID, (-ms, EventID)) AS event_id, count(*) AS events,
         min(TimeGenerated) AS first_seen, max(TimeGenerated) AS last_seen
  FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
)"""
)
sql(
    "graph_slice",
    GRAPH,
    f"SELECT {KEYS} FROM sliced ORDER BY TimeGenerated DESC, EventRecordID LIMIT 1000",
)
sql(
    "graph_nodes",
    GRAPH,
    """
SELECT name, category, CASE category WHEN 0 THEN 'Host' WHEN 1 THEN 'User' WHEN 2 THEN 'IP Address' ELSE 'Process' END AS label,
       mentions
FROM nodes
""",
)
sql("graph_nodes_capped", GRAPH, "SELECT name, category FROM nodes ORDER BY seen, name LIMIT 200")
sql("graph_edges", GRAPH, "SELECT src, dst, event_id, events, first_seen, last_seen FROM edges")
sql(
    "graph_khop",
    GRAPH
    + """, paths AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT DISTINCT dst AS name FROM paths WHERE src = 'user8'),
two AS (SELECT DISTINCT dst AS name FROM paths JOIN one ON src = name)""",
    """
SELECT 'user8' AS name, 0 AS hop
UNION ALL SELECT name, 1 FROM one WHERE name <> 'user8'
UNION ALL SELECT name, 2 FROM two WHERE name <> 'user8' AND name NOT IN (SELECT name FROM one)
""",
)

# -- streams: the batch answer, for what the watermark has closed --------------

sql(
    "stream_flood",
    SEC,
    f"""
SELECT date_trunc('minute', IngestTimestamp) AS TimeGenerated, 'FloodHeuristic' AS EventType,
       CASE WHEN count(*) > 5 THEN 'Error' ELSE 'Warning' END AS Severity, SourceType AS SourceId, count(*) AS EventCount
FROM sec GROUP BY 1, SourceType
HAVING count(*) > 1 AND date_trunc('minute', IngestTimestamp) + INTERVAL '1 minute' <= {_CLOSED.format("IngestTimestamp")}
""",
)
sql(
    "stream_threshold",
    SEC,
    f"""
SELECT * FROM ({_SLIDING}) WHERE window_start + INTERVAL '1 hour' <= {_CLOSED.format("TimeGenerated")}
""",
)
sql(
    "stream_sessions",
    SEC,
    f"""
SELECT entity, min(seen_at) AS session_start, max(seen_at) + INTERVAL '30 minutes' AS session_end, count(*) AS events FROM (
  SELECT entity, seen_at, sum(fresh) OVER (PARTITION BY entity ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT HostName AS entity, TimeGenerated AS seen_at,
           CASE WHEN TimeGenerated >= lag(TimeGenerated) OVER (PARTITION BY HostName ORDER BY TimeGenerated) + INTERVAL '30 minutes'
                THEN 1 ELSE 0 END AS fresh
    FROM sec))
GROUP BY entity, session HAVING max(seen_at) + INTERVAL '30 minutes' <= {_CLOSED.format("TimeGenerated")}
""",
)
sql("stream_dedup", SEC, "SELECT EventRecordID, HostName FROM sec")
sql(
    "stream_sequence",
    _SEQUENCE,
    """
SELECT entity, first_at, first_events, first_id, next_at, next_id FROM pairs
WHERE (ms // 21600000 + 2) * 21600000 <= (SELECT max(ms) FROM sec WHERE EventID IN (4768, 4769)) - 300000
""",
)
sql(
    "entity_state",
    SEC,
    """
SELECT rule_id, entity AS entity_key, min(TimeGenerated) AS window_start, count(*) AS event_count, min(TimeGenerated) + to_milliseconds(span) AS expiry,
  min(EventRecordID) AS first_id
FROM (SELECT 'ticket-use' AS rule_id, SubjectUserName AS entity, 21600000 AS span, * FROM sec WHERE EventID = 4768
  UNION ALL SELECT 'logon-after-request', HostName, 7200000, * FROM sec WHERE EventID = 4768)
WHERE entity <> '' AND TimeGenerated + to_milliseconds(span) >= (SELECT max(TimeGenerated) FROM sec WHERE EventID IN (4768, 4769, 4624)) - INTERVAL '5 minutes'
GROUP BY rule_id, entity, span, ms
""",
)
_LOGONS = "EventID = 4624"
_FLOWS = "DstPort = 445"
sql(
    "stream_join",
    SEC
    + f""", closed AS (
  SELECT least(max(TimeGenerated) FILTER ({_LOGONS}), max(TimeGenerated) FILTER ({_FLOWS})) - INTERVAL '5 minutes' AS mark FROM sec
), minutes AS (
  SELECT SrcIpAddr AS address, date_trunc('minute', TimeGenerated) + INTERVAL '1 minute' - INTERVAL '1 microsecond' AS flow_minute,
         count(*) AS flows
  FROM sec WHERE {_FLOWS} GROUP BY ALL
)""",
    f"""
SELECT EventRecordID AS logon_id, address, TimeGenerated AS logon_at, flow_minute, flows
FROM sec JOIN minutes ON address = SrcIpAddr AND flow_minute BETWEEN TimeGenerated - INTERVAL '1 hour' AND TimeGenerated + INTERVAL '1 hour'
WHERE {_LOGONS} AND flow_minute < (SELECT mark FROM closed)
""",
)
