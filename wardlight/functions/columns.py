"""Small Column expressions: coercion, text, network, hashing, JSON.

All of them are built from Spark's own functions, so they stay inside
whole-stage code generation and inside predicate push-down where Spark can.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
UINT32_MAX = 4294967295


def text(col: Column) -> Column:
    """Absent text is the empty string, never null."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim spaces, tabs and line ends from both sides."""
    return F.btrim(col, F.lit(BLANKS))


def whole_number(col: Column) -> Column:
    """Text or number to bigint; a fraction is cut, anything else is null.

    The pattern comes first because a failing cast costs an exception per row.
    Numbers of 19 and more digits saturate.
    """
    as_text = col.cast("string")
    cut = F.split_part(as_text, F.lit("."), F.lit(1))
    huge = F.lit(10**18)
    return (
        F.when(as_text.rlike(r"^\s*[+-]?\d{1,18}\s*$"), as_text.try_cast("bigint"))
        .when(as_text.rlike(r"^\s*[+-]?\d{1,18}\.\d*\s*$"), cut.try_cast("bigint"))
        .when(as_text.rlike(r"^\s*\+?\d{19,}(\.\d*)?\s*$"), huge)
        .when(as_text.rlike(r"^\s*-\d{19,}(\.\d*)?\s*$"), -huge)
    )


def _within(col: Column, top: int) -> Column:
    """Clamped to [0, top]; null becomes 0."""
    zero = F.lit(0).cast("bigint")
    return F.greatest(zero, F.least(F.lit(top).cast("bigint"), F.coalesce(whole_number(col), zero)))


def event_id(col: Column) -> Column:
    """Event id in [0, 2^32); out of range or not a number becomes 0."""
    # Clamped one past the end, so that the remainder turns a large id into 0.
    return F.pmod(_within(col, UINT32_MAX + 1), F.lit(UINT32_MAX + 1))


def clamped(col: Column, top: int) -> Column:
    """Number clamped to [0, top]; not a number becomes 0."""
    return _within(col, top).cast("int")


def port(col: Column) -> Column:
    return clamped(col, 65535)


def logon_type(col: Column) -> Column:
    return clamped(col, 255)


def listed_hash(hashes: Column, name: str, width: int) -> Column:
    """One digest out of ``NAME=...,NAME=...``; lower case, the last one wins."""
    found = F.regexp_extract_all(
        F.concat(F.lit(","), text(hashes)), F.lit(rf"(?i),\s*{name}=([^,]*?)\s*(?=,|$)"), F.lit(1)
    )
    return F.coalesce(
        F.substring(F.lower(F.try_element_at(found, F.lit(-1))), 1, width), F.lit("")
    )


def canonical_json(json_text: Column) -> Column:
    """JSON with sorted keys and ``", "`` / ``": "`` separators.

    The variant form sorts keys at every level.  Every second part between
    quotes is a string, left as it is; escaped quotes and backslashes are hidden
    behind a NUL meanwhile, which JSON text never holds.  No pattern runs over
    the text, so its length does not matter.
    """
    compact = F.to_json(F.try_parse_json(json_text))
    hidden = F.replace(F.replace(compact, F.lit("\\\\"), F.lit("\0b")), F.lit('\\"'), F.lit("\0q"))
    spaced = F.transform(
        F.split(hidden, '"'),
        lambda x, i: F.when(i % 2 == 1, x).otherwise(F.replace(F.replace(x, F.lit(":"), F.lit(": ")), F.lit(","), F.lit(", "))),
    )
    joined = F.array_join(spaced, '"')
    return F.replace(F.replace(joined, F.lit("\0q"), F.lit('\\"')), F.lit("\0b"), F.lit("\\\\"))


def source_type(tag: Column) -> Column:
    """First segment of a provenance tag."""
    return F.split_part(tag, F.lit(":"), F.lit(1))


def truncate_bytes(col: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8; a character that does not fit whole is left out."""
    raw = F.substring(col.cast("binary"), 1, limit)  # of bytes: to count characters is to read all the text
    # One of four neighbouring lengths ends with a character.
    whole = [F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(col) > limit, F.coalesce(*whole, F.make_valid_utf8(F.substring(raw, 1, limit - 2).cast("string")))).otherwise(col)


def time_text(col: Column) -> Column:
    """Millisecond text form used inside ids."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS")


_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(col: Column) -> Column:
    """Dotted IPv4 to bigint; anything else is null."""
    number = F.aggregate(
        F.split(col, r"\."), F.lit(0).cast("bigint"), lambda total, part: total * 256 + part.try_cast("bigint")
    )
    return F.when(col.rlike(_IPV4), number)


def display_time(col: Column, zone: str) -> Column:
    """``yyyy-MM-dd HH:mm:ss UTC (HH:mm:ss zone)``; a dash when absent."""
    local = F.date_format(F.from_utc_timestamp(col, zone), "HH:mm:ss")
    shown = F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC ("), local, F.lit(f" {zone})"))
    return F.coalesce(shown, F.lit("—"))


def ipv6_hex(col: Column) -> Column:
    """IPv6 text to 32 hex digits; an address that is not IPv6 is null."""
    halves = F.split(F.lower(col), "::", 2)
    left = F.filter(F.split(halves[0], ":"), lambda g: g != "")
    right = F.filter(
        F.split(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), ":"), lambda g: g != ""
    )
    missing = F.lit(8) - F.size(left) - F.size(right)
    squeezed = F.size(halves) == 2
    groups = F.concat(
        left,
        F.when(squeezed & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(
            F.array().cast("array<string>")
        ),
        right,
    )
    padded = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    valid = (
        col.rlike(r"^[0-9A-Fa-f:]+$")
        & col.contains(":")
        & (F.size(groups) == 8)
        & F.forall(groups, lambda g: F.length(g) <= 4)
    )
    return F.when(valid, padded)


def in_cidr(col: Column, cidr: str) -> Column:
    """Membership of one address column in one network; false when no address.

    An IPv4 network is a text prefix of whole octets and a range for the octet
    it cuts.  The prefix test is cheap, reaches the Parquet scan, and spares
    most rows the check that the text is an address at all.
    """
    import ipaddress

    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 6:
        low, high = f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"
        return F.coalesce(ipv6_hex(col).between(F.lit(low), F.lit(high)), F.lit(False))
    whole, bits = divmod(net.prefixlen, 8)
    octets = str(net.network_address).split(".")
    tests = []
    if whole == 4:
        return F.coalesce(col == ".".join(octets), F.lit(False))
    if whole:
        tests.append(col.startswith(".".join(octets[:whole]) + "."))
    tests.append(col.rlike(_IPV4))
    if bits:
        cut = F.split_part(col, F.lit("."), F.lit(whole + 1)).try_cast("int")
        low = int(octets[whole])
        tests.append(cut.between(low, low + 2 ** (8 - bits) - 1))
    return F.coalesce(all_of(tests), F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return F.lit(False) if result is None else result


def all_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result & condition
    return F.lit(True) if result is None else result


def salt(col: Column, buckets: int) -> Column:
    """Deterministic bucket number, the same on every recomputation."""
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")
