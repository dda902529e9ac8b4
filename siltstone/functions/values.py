"""Checks and decodings of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 blocks that are not global, as start and prefix length (fixed values), and two hosts in them that are.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)
GLOBAL_V4 = ("192.0.0.9", "192.0.0.10")


def private_ranges() -> list[tuple[int, int]]:
    """First and last number of each private block."""
    out = []
    for address, bits in PRIVATE_V4:
        start = sum(int(p) << (24 - 8 * i) for i, p in enumerate(address.split(".")))
        out.append((start, start + (1 << (32 - bits)) - 1))
    return out


def is_global_v4(ip: Column) -> Column:
    """True for an IPv4 address outside the private blocks; false for anything else, null and IPv6 included."""
    parts = F.split(ip, r"\.")
    numbers = [F.get(parts, F.lit(k)).try_cast("long") for k in range(4)]
    shaped = ip.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    value = numbers[0] * 16777216 + numbers[1] * 65536 + numbers[2] * 256 + numbers[3]
    private = F.lit(False)
    for low, high in private_ranges():
        private = private | value.between(low, high)
    small = numbers[0].between(0, 255) & numbers[1].between(0, 255) & numbers[2].between(0, 255) & numbers[3].between(0, 255)
    return F.coalesce(shaped & small & (ip.isin(*GLOBAL_V4) | ~private), F.lit(False))


def ascii_json(text: Column) -> Column:
    """A JSON string of ASCII characters: others as \\uXXXX in lower case, pairs beyond the basic plane."""
    named = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))

    def told(unit: Column) -> Column:
        out = F.when(unit.between("0020", "007E"), F.decode(F.unhex(F.substring(unit, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))
        for code, short in named.items():
            out = F.when(unit == code, F.lit(short)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.array_join(F.transform(units, told), ""), F.lit('"'))


def utf8_text(payload: Column) -> Column:
    """Bytes as text; broken sequences become U+FFFD instead of ending the job."""
    return F.make_valid_utf8(payload.cast("string"))


def zoned_time(text: Column) -> Column:
    """True if a text is an ISO time with a zone; Spark alone would also take one without."""
    zone = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2}(:?[0-9]{2})?)$") & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]")
    return F.coalesce(zone & F.try_to_timestamp(text).isNotNull(), F.lit(False))
