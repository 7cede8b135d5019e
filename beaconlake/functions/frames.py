"""Expressions over decoded frames and their information elements.

``ies`` is the ordered ``array<struct<id:int, info:binary>>`` of a frame.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.schema import HIDDEN, SECURITY_CODES

# Element numbers, the vendor prefix of WPA, the privacy capability bit.
IE_RATES, IE_EXTENDED_RATES, IE_CHANNEL, IE_RSN, IE_VENDOR = 1, 50, 3, 48, 221
WPA_PREFIX = "0050F201"
PRIVACY_BIT = 0x0010

# What counts as blank in an SSID: Unicode white space and the four separator controls.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def byte_at(binary: Column, position: int) -> Column:
    """Value of the byte at a 1-based position, null beyond the end."""
    digits = F.nullif(F.hex(F.substring(binary, position, 1)), F.lit(""))
    return F.conv(digits, 16, 10).cast("int")


def is_beacon(frame: Column) -> Column:
    """Management frame (type 0) of subtype 8, whatever the protocol version."""
    return byte_at(frame, 1).bitwiseAND(0xFC) == 0x80


def ssid_of(ies: Column, blank: str = HIDDEN, missing: str = HIDDEN) -> Column:
    """Text of the first element whatever its number; malformed UTF-8 is replaced."""
    text = F.make_valid_utf8(F.try_element_at(ies, F.lit(1))["info"].cast("string"))
    return (
        F.when(text.isNull(), F.lit(missing))
        .when(F.regexp_like(text, F.lit(BLANK)), F.lit(blank))
        .otherwise(text)
    )


def channel_of(ies: Column) -> Column:
    """First byte of the first non-empty channel element, else 0."""
    elements = F.filter(ies, lambda x: (x["id"] == IE_CHANNEL) & (F.length(x["info"]) > 0))
    return F.coalesce(byte_at(F.try_element_at(elements, F.lit(1))["info"], 1), F.lit(0))


def rates_of(ies: Column) -> Column:
    """Sorted distinct rates in Mbit/s from both rate elements."""
    elements = F.filter(ies, lambda x: x["id"].isin(IE_RATES, IE_EXTENDED_RATES))
    digits = F.array_join(F.transform(elements, lambda x: F.hex(x["info"])), "")
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    rates = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int").bitwiseAND(0x7F) * F.lit(0.5))
    return F.array_sort(F.array_distinct(rates))


def rates_text(rates: Column) -> Column:
    return F.when(F.size(rates) == 0, F.lit("unknown")).otherwise(
        F.array_join(F.transform(rates, lambda r: r.cast("string")), ",")
    )


def security_of(ies: Column, capabilities: Column) -> Column:
    """RSN beats WPA beats the privacy bit beats open."""
    has_rsn = F.exists(ies, lambda x: x["id"] == IE_RSN)
    has_wpa = F.exists(
        ies,
        lambda x: (x["id"] == IE_VENDOR) & (F.hex(F.substring(x["info"], 1, 4)) == WPA_PREFIX),
    )
    return (
        F.when(has_rsn, F.lit("WPA2/WPA3"))
        .when(has_wpa, F.lit("WPA"))
        .when(capabilities.bitwiseAND(PRIVACY_BIT) != 0, F.lit("WEP"))
        .otherwise(F.lit("Open"))
    )


def security_code(security: Column) -> Column:
    """Ordinal of a security class; anything else is 0."""
    code = F.when(F.lit(False), F.lit(0))
    for name, value in SECURITY_CODES.items():
        code = code.when(security == name, F.lit(value))
    return code.otherwise(F.lit(0))


def signal_band(rssi: Column) -> Column:
    return (
        F.when(rssi == 0, F.lit("none"))
        .when(rssi > -50, F.lit("strong"))
        .when(rssi > -70, F.lit("medium"))
        .otherwise(F.lit("weak"))
    )
