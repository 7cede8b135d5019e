"""Scrubbing tables of text and reporting what changed."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.privacy import (
    SAFE_MACS, macs_in, normalise_mac, pseudonym, replace_literals, replace_macs, scrub_names,
)

# File endings and folders that hold no text to scrub.
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".pdf", ".pkl", ".joblib", ".pyc", ".pcap",
    ".pcapng", ".zip",
]
SKIP_DIRECTORIES = [".git", "venv", ".venv", "__pycache__", ".pytest_cache"]


def load_mapping(text: str | None) -> tuple[dict[str, str], dict[str, str]]:
    """``ssid_map`` and ``path_map`` from their JSON document; empty keys are dropped."""
    data = json.loads(text) if text else {}
    maps = []
    for name in ("ssid_map", "path_map"):
        value = data.get(name, {})
        if not isinstance(value, dict):
            raise ValueError(f"{name!r} must be a JSON object")
        maps.append({str(old): str(new) for old, new in value.items() if str(old)})
    return maps[0], maps[1]


def scrub_text(
    rows: DataFrame, columns: list[str], ssid_map: dict[str, str] | None = None,
    path_map: dict[str, str] | None = None,
) -> DataFrame:
    """Scrub the named text columns in place: names, paths, home paths, then addresses."""
    # Two projections, so that the address step does not evaluate the first one twice.
    named = rows.withColumns(
        {c: scrub_names(F.col(c), ssid_map or {}, path_map or {}) for c in columns}
    )
    return named.withColumns({c: replace_macs(F.col(c)) for c in columns})


def scrub_beacons(beacons: DataFrame, ssid_map: dict[str, str] | None = None) -> DataFrame:
    """Pseudonymous ``bssid`` and mapped ``ssid``."""
    return beacons.withColumn("bssid", pseudonym(F.col("bssid"))).withColumn(
        "ssid", replace_literals(F.col("ssid"), ssid_map or {})
    )


def scrubbable(files: DataFrame) -> DataFrame:
    """Rows of ``path, content`` that hold text: no skipped folder, no binary ending, valid UTF-8."""
    name = F.element_at(F.split("path", "/"), -1)
    # A leading dot starts a name, not an ending.
    ending = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    folders = F.split("path", "/")
    return files.filter(
        ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRECTORIES)))
        & ~ending.isin(BINARY_SUFFIXES)
        & F.is_valid_utf8(F.col("content").cast("string"))
    ).withColumn("content", F.col("content").cast("string"))


def changed_rows(
    rows: DataFrame, key: str, column: str, ssid_map: dict[str, str] | None = None,
    path_map: dict[str, str] | None = None,
) -> DataFrame:
    """``key, original, scrubbed`` of the rows that scrubbing changes."""
    pair = rows.select(key, F.col(column).alias("original"), F.col(column).alias("scrubbed"))
    scrubbed = scrub_text(pair, ["scrubbed"], ssid_map, path_map)
    # Filters do not move below the generator, so each text is scrubbed once.
    return scrubbed.select(
        key, F.inline(F.array(F.struct("original", "scrubbed")))
    ).filter(F.col("scrubbed") != F.col("original"))


def mac_audit(
    rows: DataFrame, column: str, ssid_map: dict[str, str] | None = None,
    path_map: dict[str, str] | None = None,
) -> DataFrame:
    """``mac, pseudonym`` of every address that scrubbing replaces. Keep it private."""
    text = scrub_names(F.col(column), ssid_map or {}, path_map or {})
    found = rows.select(F.explode(macs_in(text)).alias("found"))
    return (
        found.select(normalise_mac(F.col("found")).alias("mac"))
        .filter(~F.col("mac").isin(SAFE_MACS))
        .distinct()
        .withColumn("pseudonym", pseudonym(F.col("mac")))
    )
