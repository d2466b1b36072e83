"""Raw message -> canonical event: unwrap, map, coerce, id, dedup, classify.

One projection maps all source types.  A payload is parsed once to
``map<string,variant>``, so nested values survive into UnmappedFields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schema as s
from wardlight.functions import columns as c
from wardlight.operators.ordering import first_per_key
from wardlight.session import local_table

FIELD_BYTES = 65536
UNMAPPED_BYTES = 262144
# Fixed value: the characters of one JSON text value that Spark's variant parser reads at most.
VALUE_LENGTH = 20_000_000
# As strict as that parser, without its bound.
_STRICT = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Canonical text column -> payload keys, first one present wins.
WINDOWS = {
    "HostName": ["Computer", "hostname"],
    "ChannelName": ["Channel", "channel"],
    "ProviderName": ["Provider"],
    "SubjectUserName": ["SubjectUserName"],
    "SubjectUserSid": ["SubjectUserSid"],
    "SubjectDomainName": ["SubjectDomainName"],
    "TargetUserName": ["TargetUserName"],
    "TargetUserSid": ["TargetUserSid"],
    "TargetDomainName": ["TargetDomainName"],
    "ServiceName": ["ServiceName"],
    "ProcessImagePath": ["Image"],
    "CommandLine": ["CommandLine"],
    "ParentProcessImagePath": ["ParentImage"],
    "ParentCommandLine": ["ParentCommandLine"],
    "GrantedAccess": ["GrantedAccess"],
    "ObjectName": ["ObjectName"],
    "RegistryKey": ["TargetObject"],
    "SrcIpAddr": ["IpAddress"],
    "DstIpAddr": ["DestAddress"],
}
SYSLOG = {
    "HostName": ["hostname"],
    "ProviderName": ["appname"],
    # The message body is kept in CommandLine: the table has no message column.
    "CommandLine": ["message"],
    "SrcIpAddr": ["host", "src_ip"],
    "DstIpAddr": ["dst_ip"],
}
NETFLOW = {
    "HostName": ["exporter"],
    "SrcIpAddr": ["src_ip"],
    "DstIpAddr": ["dst_ip"],
}
FORENSIC = {
    "HostName": ["hostname", "Computer"],
    "ProviderName": ["tool", "Provider"],
    "CommandLine": ["CommandLine", "cmdline"],
    "ProcessImagePath": ["Image", "image_path"],
}
# The payload keys that each source uses for a column, first one wins.
TEXT_MAPS = {"wef": WINDOWS, "syslog": SYSLOG, "netflow": NETFLOW, "forensic": FORENSIC}

FIXED_CHANNELS = {"syslog": "Syslog", "netflow": "Netflow", "forensic": "ForensicArtifact"}
TIME_KEYS = {
    "wef": ["TimeCreated", "time_created"],
    "syslog": ["timestamp"],
    "netflow": ["timestamp", "start_time"],
    "forensic": ["timestamp", "TimeCreated"],
}
ID_KEYS = {"wef": ["EventID", "event_id"], "forensic": ["EventID"]}
PORT_KEYS = {
    "SrcPort": {"wef": ["IpPort"], "syslog": ["src_port"], "netflow": ["src_port"]},
    "DstPort": {"wef": ["DestPort"], "syslog": ["dst_port"], "netflow": ["dst_port"]},
}
# Payload keys that reach a column, so are not "unmapped".
MAPPED_KEYS = {
    "wef": [
        "EventID", "EventRecordID", "Computer", "SubjectUserName", "SubjectUserSid",
        "SubjectDomainName", "TargetUserName", "TargetUserSid", "TargetDomainName",
        "LogonType", "ServiceName", "Image", "CommandLine", "ParentImage",
        "ParentCommandLine", "GrantedAccess", "TargetObject", "ObjectName",
        "TimeCreated", "Channel", "Provider", "IpAddress", "IpPort",
        "DestAddress", "DestPort", "Protocol", "Hashes",
    ],
    "syslog": [
        "message", "hostname", "appname", "procid", "msgid", "timestamp", "facility",
        "severity", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
    ],
    # Flow counters stay in UnmappedFields; both spellings of a field count as mapped.
    "netflow": [
        "timestamp", "start_time", "src_ip", "dst_ip", "src_port", "dst_port",
        "proto", "protocol", "exporter",
    ],
    "forensic": [
        "timestamp", "TimeCreated", "hostname", "Computer", "EventID", "tool",
        "Provider", "CommandLine", "cmdline", "Image", "image_path",
    ],
}
# Protocol number -> name.
PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp"}


def parse_fields(payload: Column) -> Column:
    """JSON object text to ``map<string,variant>``; anything else is null.

    Spark's parser stops after the first value, so what follows it has to be
    checked: the text must end with the object, and a text that could hold two
    objects is parsed inside brackets, where a second one shows.  The parser
    refuses a value of more than ``VALUE_LENGTH`` characters; an object that may
    hold one is then read as a list of maps, where a repeated key must be refused.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))).try_cast("array<variant>")
    # The pattern is looked for only where there is a second brace at all; bytes are found faster than characters.
    raw = payload.cast("binary")
    second = F.contains(F.substring(raw, 2, 2**31 - 1), F.lit(b"{"))
    parsed = F.when(
        second & payload.rlike(r"\}\s*,?\s*\{"),
        F.when(F.size(boxed) == 1, F.try_element_at(boxed, F.lit(1))),
    ).otherwise(F.try_parse_json(payload))
    # Trimming looks at every character, so the last few come first.
    blanks = F.lit(" \t\n\x0b\f\r")
    tail = F.rtrim(F.substring(raw, -64, 64).cast("string"), blanks)
    ends = F.when(tail != "", tail.endswith("}")).otherwise(F.rtrim(payload, blanks).endswith("}"))
    listed = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<map<string,variant>>", _STRICT)
    distinct = lambda keys: F.size(F.array_distinct(keys)) == F.size(keys)
    # In a list of its own the read value is named, so that it is read once.
    only = F.transform(F.array(listed), lambda x: F.when((F.size(x) == 1) & distinct(F.map_keys(x[0])), x[0]))[0]
    long = F.when(F.octet_length(payload) > VALUE_LENGTH, only)
    return F.when(ends, F.coalesce(parsed.try_cast("map<string,variant>"), long))


def known_fields(payload: Column, names: list[str]) -> Column:
    """The named payload keys as one struct of text, read in a single pass."""
    return F.from_json(payload, ", ".join(f"`{n}` string" for n in names))


# Keys that differ from another known key by case only; a struct holds one.
_CASE_TWINS = {"channel", "protocol"}


def field(name: str) -> Column:
    """One known payload key as text; null when absent or JSON null."""
    if name in _CASE_TWINS:
        return F.try_element_at(F.col("fields"), F.lit(name)).try_cast("string")
    return F.col(f"known.`{name}`")


def _first_field(names: list[str]) -> Column:
    found = [field(n) for n in names]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def _by_source(source: Column, options: dict[str, Column], default: Column) -> Column:
    chosen = None
    for name, value in options.items():
        test = source == name
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return default if chosen is None else chosen.otherwise(default)


def unmapped_json(fields: Column, mapped: list[str]) -> Column:
    """Keys outside ``mapped`` as JSON text, empty when there are none."""
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*mapped))
    # By its size: compared as text it would be written out twice.
    return F.when(F.size(rest) == 0, "").otherwise(F.to_json(rest))


def _merge(base: Column, over: Column) -> Column:
    """Union of two maps; keys of ``over`` win."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(kept, over)


def _sub_map(name: str) -> Column:
    inner = F.try_element_at(F.col("fields"), F.lit(name)).try_cast("map<string,variant>")
    return F.coalesce(inner, F.from_json(F.lit("{}"), "map<string,variant>"))


def unwrap_nested(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Flatten ``System``/``EventData`` records and ``row`` envelopes.

    Provider name and creation time come out of their sub-objects,
    ``SourceImage`` stands in for a missing ``Image``, and ``::ffff:`` is
    removed from IPv4-mapped addresses.  Collector envelope keys are dropped.
    """
    has = lambda k: F.coalesce(F.map_contains_key(F.col("fields"), F.lit(k)), F.lit(False))

    def lifted(key: str, source: str) -> Column:
        """A one-entry map from a nested path, or an empty map."""
        value = F.try_element_at(F.col("fields"), F.lit("System"))
        text = F.try_variant_get(value, source, "string")
        empty = F.from_json(F.lit("{}"), "map<string,variant>")
        return F.when(text.isNotNull(), F.create_map(F.lit(key), text.cast("variant"))).otherwise(empty)

    work = df.withColumnRenamed(fields, "fields") if fields != "fields" else df
    cleaned = F.map_filter("fields", lambda k, _: ~k.rlike(s.SERVER_KEY_PATTERN))
    # Columns of their own: a merge looks into its upper map once for every key of the lower.
    parts = {
        "_system": _sub_map("System"),
        "_data": _sub_map("EventData"),
        "_row": _sub_map("row"),
        "_lifted": F.map_concat(lifted("Provider", "$.Provider.Name"), lifted("TimeCreated", "$.TimeCreated.SystemTime")),
    }
    kept = df.columns if fields == "fields" else work.columns
    work = work.withColumn("fields", cleaned).withColumns(parts)
    outer = F.map_filter("fields", lambda k, _: ~k.isin("System", "EventData"))
    windows = _merge(_merge(_merge(outer, F.col("_system")), F.col("_lifted")), F.col("_data"))
    envelope = _merge(F.map_filter("fields", lambda k, _: k != "row"), F.col("_row"))
    work = work.withColumn(
        "fields",
        F.when(has("System") | has("EventData"), windows)
        .when(has("row"), envelope)
        .otherwise(F.col("fields")),
    ).select(*kept)
    renames = {"SourceImage": "Image", "collection_time": "timestamp", "Exe": "image_path"}
    renamed = F.transform_keys(
        "fields",
        lambda k, _: _rename_key(k, renames),
    )
    work = work.withColumn("fields", renamed)
    stripped = F.transform_values(
        "fields",
        lambda k, v: F.when(
            k.isin("IpAddress", "DestAddress", "src_ip", "dst_ip")
            & F.coalesce(v.try_cast("string").startswith("::ffff:"), F.lit(False)),
            F.regexp_replace(v.try_cast("string"), "^::ffff:", "").cast("variant"),
        ).otherwise(v),
    )
    work = work.withColumn("fields", stripped)
    return work.withColumnRenamed("fields", fields) if fields != "fields" else work


def _rename_key(key: Column, renames: dict[str, str]) -> Column:
    """New key, unless the record already has a key of that name."""
    out = key
    for old, new in renames.items():
        free = ~F.map_contains_key(F.col("fields"), F.lit(new))
        out = F.when((key == old) & free, F.lit(new)).otherwise(out)
    return out


def stable_record_id(tag: Column, source_id: Column, payload: Column) -> Column:
    """``tag:source id``, or SHA-256 over tag and canonical JSON without one."""
    digest = F.sha2(F.concat(tag, F.lit(":"), c.canonical_json(payload)), 256)
    return F.when(c.text(source_id) != "", F.concat(tag, F.lit(":"), source_id)).otherwise(digest)


def _source_keys() -> list[str]:
    """Every payload key that any source map reads."""
    names = {"EventRecordID", "record_id", "Protocol", "proto", "protocol", "LogonType", "Hashes"}
    for keys in [*TIME_KEYS.values(), *ID_KEYS.values()]:
        names.update(keys)
    for by_column in TEXT_MAPS.values():
        for keys in by_column.values():
            names.update(keys)
    for by_source in PORT_KEYS.values():
        for keys in by_source.values():
            names.update(keys)
    return sorted(names - _CASE_TWINS)


def parsed_messages(raw: DataFrame) -> DataFrame:
    """Raw rows that hold a JSON object, with ``fields`` and ``source``.

    Exploding a 0- or 1-element array drops the unparsable rows.  A filter on
    the parsed column would be pushed below the projection and parse twice.
    """
    prefix = c.source_type(F.col("provenance_tag"))
    return raw.select(
        *raw.columns,
        F.when(prefix == "ipfix", "netflow")
        .when(prefix.isin("syslog", "netflow", "forensic"), prefix)
        .otherwise("wef")
        .alias("source"),
        F.explode(F.array_compact(F.array(parse_fields(F.col("payload"))))).alias("fields"),
    )


def normalize_rejects(raw: DataFrame) -> DataFrame:
    """Messages that hold no JSON object, with the reason."""
    return (
        raw.filter(parse_fields(F.col("payload")).isNull())
        .select("id", "provenance_tag", "received_at", F.lit("ParseError").alias("reason"))
    )


def normalize_events(raw: DataFrame, nested: bool = False) -> DataFrame:
    """Raw messages to the 31 canonical columns, one projection.

    The tag prefix picks the field map; an unknown prefix uses the Windows
    map.  A time that does not parse falls back to the ingest time.  A
    protocol that is not a number keeps its own text.
    """
    work = parsed_messages(raw)
    flat = F.col("payload")
    if nested:
        work = unwrap_nested(work)
        flat = F.to_json("fields")
    work = work.withColumn("known", known_fields(flat, _source_keys()))
    src = F.col("source")

    def text_column(name: str) -> Column:
        """The column in the sources that have it, empty in the others."""
        options = {k: c.text(_first_field(m[name])) for k, m in TEXT_MAPS.items() if name in m}
        return _by_source(src, options, F.lit(""))

    time_text = _by_source(
        src,
        {k: _first_field(v) for k, v in TIME_KEYS.items() if k != "wef"},
        _first_field(TIME_KEYS["wef"]),
    )
    flow_protocol = F.coalesce(field("proto"), field("protocol"), F.lit("0"))
    out = {name: text_column(name) for name in s.STRING_COLUMNS if name not in _COMPUTED}
    out["ChannelName"] = _by_source(
        src, {k: F.lit(v) for k, v in FIXED_CHANNELS.items()}, c.text(_first_field(WINDOWS["ChannelName"]))
    )
    # The flow exporter is not named in a flow record.
    out["ProviderName"] = F.when(src == "netflow", "softflowd").otherwise(text_column("ProviderName"))
    out["TimeGenerated"] = F.date_trunc(
        "millisecond", F.coalesce(F.try_to_timestamp(time_text), F.col("received_at"))
    )
    has_id = src.isin(*ID_KEYS)
    raw_id = _first_field(sorted({n for keys in ID_KEYS.values() for n in keys}))
    out["EventID"] = F.when(has_id, c.event_id(raw_id)).otherwise(F.lit(0).cast("bigint"))
    out["LogonType"] = F.when(src == "wef", c.logon_type(field("LogonType"))).otherwise(0).cast("int")
    for name, keys in PORT_KEYS.items():
        text = _by_source(src, {k: _first_field(v) for k, v in keys.items()}, F.lit("0"))
        out[name] = c.port(text)
    out["NetworkProtocol"] = (
        F.when(
            src == "netflow",
            F.coalesce(
                F.try_element_at(
                    F.create_map(*[F.lit(x) for p in PROTOCOLS.items() for x in p]), flow_protocol
                ),
                F.lower(flow_protocol),
            ),
        )
        .when(src == "wef", F.lower(c.text(field("Protocol"))))
        .otherwise("")
    )
    for name, width in s.HASH_WIDTHS.items():
        out[name] = F.when(
            src == "wef", c.listed_hash(field("Hashes"), name.removeprefix("File"), width)
        ).otherwise("")
    out["EventRecordID"] = stable_record_id(
        F.col("provenance_tag"),
        F.coalesce(F.nullif(field("EventRecordID"), F.lit("")), F.nullif(field("record_id"), F.lit(""))),
        F.col("payload"),
    )
    out["ProvenanceTag"] = F.col("provenance_tag")
    out["IngestTimestamp"] = F.date_trunc("millisecond", "received_at")
    out["UnmappedFields"] = _by_source(
        src,
        {k: unmapped_json(F.col("fields"), v) for k, v in MAPPED_KEYS.items() if k != "wef"},
        unmapped_json(F.col("fields"), MAPPED_KEYS["wef"]),
    )
    return work.select(*[out[name].alias(name) for name in s.CANONICAL_COLUMNS])


_COMPUTED = {
    "ChannelName",
    "ProviderName",
    "NetworkProtocol",
    "FileMD5",
    "FileSHA256",
    "EventRecordID",
    "ProvenanceTag",
    "UnmappedFields",
}


def dedup_events(events: DataFrame, key: str = "EventRecordID", tie: str = "TimeGenerated") -> DataFrame:
    """One row per record id: earliest ingest, then earliest event.

    Different copies with equal times are told apart by a hash of the row.
    """
    content = F.xxhash64(*[F.col(f"`{n}`") for n in events.columns])
    return first_per_key(events, [key], [F.col("IngestTimestamp"), F.col(tie), content])


def map_upload(parsed: DataFrame, fields: str = "fields") -> DataFrame:
    """Uploaded records by exact column name; adds ``had_unmapped``.

    ``parsed`` carries ``fields`` plus the server-assigned ProvenanceTag and
    IngestTimestamp.  Collector keys in the content are ignored, integers fall
    back to 0, text is cut at 64 KB, the rest goes to UnmappedFields.  A rest of
    more than 256 KB becomes a JSON object of its size and its beginning; the
    column ``was_cut`` tells of either.
    """
    work = parsed.withColumn("fields", F.col(fields)) if fields != "fields" else parsed
    own = F.map_filter(
        "fields", lambda k, _: ~k.isin(*s.SERVER_COLUMNS) & ~k.rlike(s.SERVER_KEY_PATTERN)
    )
    typed = [n for n in s.CANONICAL_COLUMNS if n not in (*s.SERVER_COLUMNS, "UnmappedFields")]
    # Text is taken as it is; only typed keys with other values are written out to be read, and the other keys as the rest.
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    texts = F.map_filter("fields", lambda k, v: k.isin(*typed) & is_text(v))
    others = F.map_filter("fields", lambda k, v: k.isin(*typed) & ~is_text(v))
    read = {"_texts": F.transform_values(texts, lambda _, v: v.try_cast("string")), "known": known_fields(F.to_json(others), typed)}
    work = work.withColumns({**read, "fields": own}).withColumn("_rest", unmapped_json(F.col("fields"), typed))
    held = [F.coalesce(F.try_element_at("_texts", F.lit(n)), field(n)).alias(n) for n in typed]
    work = work.withColumn("known", F.struct(*held)).drop("_texts")
    out, cut = {}, []
    for name in typed:
        if name == "TimeGenerated":
            out[name] = F.date_trunc(
                "millisecond", F.coalesce(F.try_to_timestamp(field(name)), F.col("IngestTimestamp"))
            )
        elif name == "EventID":
            out[name] = c.event_id(field(name))
        elif name == "LogonType":
            out[name] = c.logon_type(field(name))
        elif name in s.INT_COLUMNS:
            out[name] = c.port(field(name))
        elif name in s.HASH_WIDTHS:
            out[name] = F.substring(c.text(field(name)), 1, s.HASH_WIDTHS[name])
        else:
            out[name] = c.truncate_bytes(c.text(field(name)), FIELD_BYTES)
            cut.append(F.octet_length(c.text(field(name))) > FIELD_BYTES)
    rest = F.col("_rest")
    cut.append(F.octet_length(rest) > UNMAPPED_BYTES)
    # Written as JSON text a byte takes six at most.
    head = F.struct(F.octet_length(rest).alias("_bytes"), c.truncate_bytes(rest, UNMAPPED_BYTES // 6 - 16).alias("_beginning"))
    out["UnmappedFields"] = F.when(cut[-1], F.to_json(head)).otherwise(rest)
    out["ProvenanceTag"] = F.col("ProvenanceTag")
    out["IngestTimestamp"] = F.col("IngestTimestamp")
    keep = [x for x in work.columns if x not in ("fields", "known", "_rest", *s.SERVER_COLUMNS)]
    return work.select(
        *keep,
        *[out[n].alias(n) for n in s.CANONICAL_COLUMNS],
        (rest != "").alias("had_unmapped"),
        F.coalesce(c.any_of(cut), F.lit(False)).alias("was_cut"),
    )


def classify_events(events: DataFrame) -> DataFrame:
    """Add event class and output table; the id override beats the channel."""
    spark = events.sparkSession
    by_id = lookup(spark, s.EVENT_ID_CLASSES, "EventID long, _id_class int")
    by_channel = lookup(spark, s.CHANNEL_CLASSES, "ChannelName string, _channel_class int")
    tables = lookup(spark, s.CLASS_TABLES, "EventClass int, OutputTable string")
    return (
        events.join(F.broadcast(by_id), "EventID", "left")
        .join(F.broadcast(by_channel), "ChannelName", "left")
        .withColumn("EventClass", F.coalesce("_id_class", "_channel_class"))
        .join(F.broadcast(tables), "EventClass", "left")
        .drop("_id_class", "_channel_class")
    )


def lookup(spark: SparkSession, values: dict, ddl: str) -> DataFrame:
    """A fixed table of the library as a DataFrame; small by construction."""
    return local_table(spark, list(values.items()), ddl)


# Output fields that must not be empty, per output table.
MANDATORY = {
    "ASimAuthentication": ["TimeGenerated", "EventOriginalUid", "ActorUsername", "DvcHostname"],
    "ASimNetworkSession": ["TimeGenerated", "EventOriginalUid", "SrcIpAddr", "DvcHostname"],
    "ASimProcessEvent": ["TimeGenerated", "EventOriginalUid", "ActingProcessName", "DvcHostname"],
    "ASimRegistryEvent": ["TimeGenerated", "EventOriginalUid", "ActorUsername", "DvcHostname"],
}
MANDATORY_DEFAULT = ["TimeGenerated", "EventOriginalUid", "DvcHostname"]
# Columns each output table accepts.
ALLOWED = {
    "ASimAuthentication": [
        "TimeGenerated", "EventID", "EventOriginalUid", "DvcHostname", "ActorUsername",
        "ActorUserId", "ActorUserDomain", "TargetUsername", "TargetUserId",
        "TargetUserDomain", "LogonMethod", "SrcIpAddr", "SrcPortNumber", "EventProduct",
    ],
    "ASimNetworkSession": [
        "TimeGenerated", "EventOriginalUid", "DvcHostname", "SrcIpAddr", "SrcPortNumber",
        "DstIpAddr", "DstPortNumber", "NetworkProtocol", "NetworkApplicationProtocol",
        "EventProduct",
    ],
    "ASimProcessEvent": [
        "TimeGenerated", "EventID", "EventOriginalUid", "DvcHostname", "ActorUsername",
        "ActingProcessName", "ActingProcessCommandLine", "ParentProcessName",
        "ParentProcessCommandLine", "EventProduct",
    ],
    "ASimRegistryEvent": [
        "TimeGenerated", "EventID", "EventOriginalUid", "DvcHostname", "ActorUsername",
        "RegistryKey", "FilePath", "EventProduct",
    ],
}


def project_output(classified: DataFrame) -> DataFrame:
    """All classes at once: renamed columns, ``OutputTable`` and ``accepted``."""
    renamed = classified.select(
        *[F.col(old).alias(new) for old, new in s.OUTPUT_NAMES.items()], "OutputTable"
    )
    filled = lambda names: c.all_of(
        [F.coalesce(F.col(n).cast("string"), F.lit("")) != "" for n in names]
    )
    rule = None
    for name, columns in MANDATORY.items():
        test = F.col("OutputTable") == name
        rule = F.when(test, filled(columns)) if rule is None else rule.when(test, filled(columns))
    accepted = F.col("OutputTable").isNotNull() & rule.otherwise(filled(MANDATORY_DEFAULT))
    return renamed.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def project_asim(classified: DataFrame, table: str) -> DataFrame:
    """The accepted rows of one output table, only its allowed columns."""
    names = ALLOWED.get(table, list(s.OUTPUT_NAMES.values()))
    return project_output(classified).filter((F.col("OutputTable") == table) & F.col("accepted")).select(*names)


# JSON fields the rules use that have no column of their own.
PROMOTED = ["TicketEncryptionType", "PreAuthType", "TargetImage"]


def promote_fields(events: DataFrame, names: list[str] = PROMOTED) -> DataFrame:
    """Lift JSON keys of UnmappedFields to text columns, empty when absent."""
    wanted = F.from_json("UnmappedFields", ", ".join(f"`{n}` string" for n in names))
    return events.withColumn("_promoted", wanted).withColumns(
        {n: c.text(F.col(f"_promoted.`{n}`")) for n in names}
    ).drop("_promoted")


def decode_base64(df: DataFrame, column: str = "CommandLine", into: str = "DecodedText") -> DataFrame:
    """All base64 runs of 16 or more characters as text, one per line; else empty.

    A run may be wrapped over lines: a line break is skipped where 16 or more of
    its characters stand before it.  Text that was encoded as UTF-16LE (the usual
    form on a command line) is recognised by its zero bytes.  Runs that are not
    text are left out.
    """
    # The break comes first in the pattern: what stands before it is looked at only there.
    unwrapped = F.regexp_replace(column, r"\r?\n(?<=[A-Za-z0-9+/]{16}\r?\n)(?=[A-Za-z0-9+/])", "")
    runs = F.regexp_extract_all(unwrapped, F.lit(r"([A-Za-z0-9+/]{16,}={0,2})"), F.lit(1))

    def decoded(raw: Column) -> Column:
        wide = F.substring(F.hex(F.substring(raw, 1, 2)), 3, 2) == "00"
        narrow_text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        return F.when(wide, F.decode(raw, "UTF-16LE")).otherwise(narrow_text)

    # Two steps, so that each run is decoded once.
    raws = F.transform(runs, lambda run: F.try_to_binary(F.when(F.length(run) % 4 == 0, run), F.lit("base64")))
    return df.withColumn(into, c.text(F.array_join(F.array_compact(F.transform(raws, decoded)), "\n")))
