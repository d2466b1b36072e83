"""Canonical event table, ledgers, and the fixed lookup values around them."""

from __future__ import annotations

from pyspark.sql import types as T

# The 31 canonical columns, in table order.
CANONICAL_COLUMNS = [
    "TimeGenerated",
    "HostName",
    "EventID",
    "EventRecordID",
    "ChannelName",
    "ProviderName",
    "SubjectUserName",
    "SubjectUserSid",
    "SubjectDomainName",
    "TargetUserName",
    "TargetUserSid",
    "TargetDomainName",
    "LogonType",
    "ServiceName",
    "ProcessImagePath",
    "CommandLine",
    "ParentProcessImagePath",
    "ParentCommandLine",
    "GrantedAccess",
    "ObjectName",
    "FileMD5",
    "FileSHA256",
    "RegistryKey",
    "SrcIpAddr",
    "SrcPort",
    "DstIpAddr",
    "DstPort",
    "NetworkProtocol",
    "ProvenanceTag",
    "IngestTimestamp",
    "UnmappedFields",
]

_NOT_STRING = {
    "TimeGenerated": T.TimestampType(),
    "IngestTimestamp": T.TimestampType(),
    "EventID": T.LongType(),
    "LogonType": T.IntegerType(),
    "SrcPort": T.IntegerType(),
    "DstPort": T.IntegerType(),
}

EVENT_SCHEMA = T.StructType(
    [T.StructField(c, _NOT_STRING.get(c, T.StringType())) for c in CANONICAL_COLUMNS]
)

STRING_COLUMNS = [c for c in CANONICAL_COLUMNS if c not in _NOT_STRING]
INT_COLUMNS = ["EventID", "LogonType", "SrcPort", "DstPort"]
HASH_WIDTHS = {"FileMD5": 32, "FileSHA256": 64}

RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("provenance_tag", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

# Columns the collector assigns; content may never set them.
SERVER_COLUMNS = ["ProvenanceTag", "IngestTimestamp"]
# Envelope keys the collector adds around a payload, e.g. ``_x_provenance``.
SERVER_KEY_PATTERN = r"^_.*_(provenance|ingest_ts)$"

# Output table per event class.
CLASS_TABLES = {
    3002: "ASimAuthentication",
    4001: "ASimNetworkSession",
    4003: "ASimDns",
    1007: "ASimProcessEvent",
    1001: "ASimFileEvent",
    201001: "ASimRegistryEvent",
    3001: "ASimUserManagement",
    5003: "ASimScheduledTask",
}

# Default class per channel.
CHANNEL_CLASSES = {
    "Security": 3002,
    "Microsoft-Windows-Sysmon/Operational": 1007,
    "System": 4001,
}

# Class per event id, stronger than the channel default.
EVENT_ID_CLASSES = {
    4662: 201001,
    4624: 3002,
    4625: 3002,
    4768: 3002,
    4769: 3002,
    4720: 3001,
    4722: 3001,
    4728: 3001,
    4732: 3001,
    4756: 3001,
}

# Canonical column -> name in the output tables.  Columns that
# are absent here have no output name and are not forwarded.
OUTPUT_NAMES = {
    "TimeGenerated": "TimeGenerated",
    "EventID": "EventID",
    "EventRecordID": "EventOriginalUid",
    "HostName": "DvcHostname",
    "SubjectUserName": "ActorUsername",
    "SubjectUserSid": "ActorUserId",
    "SubjectDomainName": "ActorUserDomain",
    "TargetUserName": "TargetUsername",
    "TargetUserSid": "TargetUserId",
    "TargetDomainName": "TargetUserDomain",
    "ServiceName": "NetworkApplicationProtocol",
    "ProcessImagePath": "ActingProcessName",
    "CommandLine": "ActingProcessCommandLine",
    "ParentProcessImagePath": "ParentProcessName",
    "ParentCommandLine": "ParentProcessCommandLine",
    "RegistryKey": "RegistryKey",
    "ObjectName": "FilePath",
    "LogonType": "LogonMethod",
    "SrcIpAddr": "SrcIpAddr",
    "SrcPort": "SrcPortNumber",
    "DstIpAddr": "DstIpAddr",
    "DstPort": "DstPortNumber",
    "NetworkProtocol": "NetworkProtocol",
    "ProviderName": "EventProduct",
}

# Days an event is kept locally, per source type.
RETENTION_DAYS = {
    "syslog": 7,
    "wef": 14,
    "sysmon": 14,
    "netflow": 7,
    "forensic": 30,
    "pull": 3,
    "internal": 7,
}

RULE_STATUSES = ["draft", "test", "review", "production", "disabled"]
LEVELS = ["informational", "low", "medium", "high", "critical"]

# Rule level -> severity written on a hit.
LEVEL_SEVERITY = {
    "critical": "High",
    "high": "High",
    "medium": "Medium",
    "low": "Low",
    "informational": "Informational",
}

# Rank used to sort incidents by severity.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# What an event id means.
EVENT_DESCRIPTIONS = {
    1: "Process creation (Sysmon)",
    2: "A process changed a file creation time (Sysmon)",
    3: "Network connection (Sysmon)",
    4: "Sysmon service state changed",
    5: "Process terminated (Sysmon)",
    6: "Driver loaded (Sysmon)",
    7: "Image loaded (Sysmon)",
    8: "CreateRemoteThread (Sysmon)",
    9: "RawAccessRead (Sysmon)",
    10: "ProcessAccess (Sysmon)",
    11: "FileCreate (Sysmon)",
    12: "RegistryEvent — Object create and delete (Sysmon)",
    13: "RegistryEvent — Value Set (Sysmon)",
    14: "RegistryEvent — Key and Value Rename (Sysmon)",
    15: "FileCreateStreamHash (Sysmon)",
    17: "PipeEvent — Pipe Created (Sysmon)",
    18: "PipeEvent — Pipe Connected (Sysmon)",
    19: "WmiEvent — WmiEventFilter activity (Sysmon)",
    20: "WmiEvent — WmiEventConsumer activity (Sysmon)",
    21: "WmiEvent — WmiEventConsumerToFilter activity (Sysmon)",
    22: "DNS query (Sysmon)",
    23: "FileDelete — File Delete archived (Sysmon)",
    25: "ProcessTampering (Sysmon)",
    26: "FileDeleteDetected (Sysmon)",
    1100: "The event logging service has shut down",
    1102: "The audit log was cleared",
    1104: "The security log is now full",
    4624: "An account was successfully logged on",
    4625: "An account failed to log on",
    4634: "An account was logged off",
    4647: "User initiated logoff",
    4648: "A logon was attempted using explicit credentials",
    4656: "A handle to an object was requested",
    4657: "A registry value was modified",
    4660: "An object was deleted",
    4663: "An attempt was made to access an object",
    4670: "Permissions on an object were changed",
    4672: "Special privileges assigned to new logon",
    4673: "A privileged service was called",
    4674: "An operation was attempted on a privileged object",
    4688: "A new process has been created",
    4689: "A process has exited",
    4697: "A service was installed in the system",
    4698: "A scheduled task was created",
    4699: "A scheduled task was deleted",
    4700: "A scheduled task was enabled",
    4701: "A scheduled task was disabled",
    4702: "A scheduled task was updated",
    4713: "Kerberos policy was changed",
    4714: "Encrypted data recovery policy was changed",
    4715: "The audit policy on an object was changed",
    4716: "Trusted domain information was modified",
    4717: "System security access was granted to an account",
    4718: "System security access was removed from an account",
    4720: "A user account was created",
    4722: "A user account was enabled",
    4723: "An attempt was made to change an account password",
    4724: "An attempt was made to reset an account password",
    4725: "A user account was disabled",
    4726: "A user account was deleted",
    4727: "A security-enabled global group was created",
    4728: "A member was added to a security-enabled global group",
    4729: "A member was removed from a security-enabled global group",
    4730: "A security-enabled global group was deleted",
    4731: "A security-enabled local group was created",
    4732: "A member was added to a security-enabled local group",
    4733: "A member was removed from a security-enabled local group",
    4739: "Domain Policy was changed",
    4740: "A user account was locked out",
    4741: "A computer account was created",
    4742: "A computer account was changed",
    4743: "A computer account was deleted",
    4756: "A member was added to a security-enabled universal group",
    4757: "A member was removed from a security-enabled universal group",
    4764: "A group type was changed",
    4767: "A user account was unlocked",
    4768: "A Kerberos authentication ticket (TGT) was requested",
    4769: "A Kerberos service ticket was requested",
    4771: "Kerberos pre-authentication failed",
    4776: "The domain controller attempted to validate credentials for an account",
    4778: "A session was reconnected to a window station",
    4779: "A session was disconnected from a window station",
    5140: "A network share object was accessed",
    5142: "A network share object was added",
    5144: "A network share object was deleted",
    5145: "A network share object was checked to see whether client can be granted desired access",
    5156: "The Windows Filtering Platform has permitted a connection",
    5157: "The Windows Filtering Platform has blocked a connection",
    5158: "The Windows Filtering Platform has permitted a bind to a local port",
}
