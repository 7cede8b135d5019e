"""Network inventory: what was heard, where, how strongly, and when."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.frames import signal_band
from beaconlake.operators.profiles import completion_percent
from beaconlake.schema import CHANNELS, HIDDEN

NO_SIGNAL = -999


SIGHTED = ["ssid", "channel", "rssi", "security"]


def _sightings(beacons: DataFrame, *keys) -> DataFrame:
    """Rows of a key with equal advertised values merged into one with a count and a time span.

    Few distinct combinations exist per access point and the aggregates are plain numbers, so this
    is a hash aggregate that shrinks the data before the shuffle and before anything is sorted.
    """
    return beacons.groupBy(*keys, *SIGHTED).agg(
        F.count("*").alias("n"), F.min("capture_us").alias("first_us"),
        F.max("capture_us").alias("last_us"),
    )


def _inventory_columns() -> list:
    """Aggregates over sightings; equal capture times are resolved by the values themselves."""
    first, last = F.struct("first_us", "ssid"), F.struct("last_us", *SIGHTED)
    named = F.when(F.col("ssid") != HIDDEN, first)
    tuned = F.when(F.col("channel") != 0, last)
    return [
        # min_by / max_by skip rows whose ordering is null.
        F.coalesce(F.min_by("ssid", named), F.lit(HIDDEN)).alias("ssid"),
        F.coalesce(F.max_by("channel", tuned), F.lit(0)).alias("channel"),
        F.max_by("rssi", last).alias("rssi"),
        F.max_by("security", last).alias("security"),
        F.sum("n").alias("beacons"),
        F.min("first_us").alias("first_seen_us"),
        F.max("last_us").alias("last_seen_us"),
    ]


def network_inventory(beacons: DataFrame) -> DataFrame:
    """One row per access point: first revealed name, last non-zero channel, last signal."""
    return _sightings(beacons, "bssid").groupBy("bssid").agg(*_inventory_columns())


#: How partial rows of one access point merge; the structs carry the times that decide.
NETWORK_PARTIALS = {
    "named": "min(named)", "tuned": "max(tuned)", "latest": "max(latest)", "beacons": "sum(beacons)",
    "first_seen_us": "min(first_seen_us)", "last_seen_us": "max(last_seen_us)",
}


def network_partials(beacons: DataFrame) -> DataFrame:
    """Partial rows of the inventory, one for each distinct sighting; ``NETWORK_PARTIALS`` merges them."""
    last = F.struct("last_us", *SIGHTED)
    return _sightings(beacons, "bssid").select(
        "bssid", F.when(F.col("ssid") != HIDDEN, F.struct("first_us", "ssid")).alias("named"),
        F.when(F.col("channel") != 0, last).alias("tuned"), last.alias("latest"), F.col("n").alias("beacons"),
        F.col("first_us").alias("first_seen_us"), F.col("last_us").alias("last_seen_us"),
    )


def inventory_of(partials: DataFrame) -> DataFrame:
    """The inventory from merged partial rows, one per access point."""
    return partials.select(
        "bssid", F.coalesce("named.ssid", F.lit(HIDDEN)).alias("ssid"),
        F.coalesce("tuned.channel", F.lit(0)).alias("channel"), F.col("latest.rssi").alias("rssi"),
        F.col("latest.security").alias("security"), "beacons", "first_seen_us", "last_seen_us",
    )


def collection_totals(partials: DataFrame) -> DataFrame:
    """One row: beacons, distinct access points, and time, name and signal of the latest beacon."""
    return partials.agg(
        F.coalesce(F.sum("beacons"), F.lit(0)).alias("beacons"), F.count("bssid").alias("access_points"),
        F.max("latest").alias("latest"),
    ).select(
        "beacons", "access_points", F.col("latest.last_us").alias("latest_us"),
        F.col("latest.ssid").alias("latest_ssid"), F.col("latest.rssi").alias("latest_rssi"),
    )


def strongest_first(networks: DataFrame, top: int | None = None) -> DataFrame:
    """Networks by signal, strongest first; a missing signal (0) sorts as strongest."""
    ordered = networks.orderBy(F.desc(F.coalesce("rssi", F.lit(NO_SIGNAL))), "bssid")
    return ordered if top is None else ordered.limit(top)


def listing(networks: DataFrame) -> DataFrame:
    """Display form: name cut to 24 characters and a signal band."""
    return networks.withColumn("ssid", F.substring("ssid", 1, 24)).withColumn(
        "signal_band", signal_band(F.col("rssi"))
    )


def scan_session(
    beacons: DataFrame, start_us: int, seconds: int, channels: list[int] | None = None
) -> DataFrame:
    """Inventory of one bounded scan, optionally of some channels only."""
    heard = beacons.filter(
        (F.col("capture_us") >= start_us) & (F.col("capture_us") < start_us + seconds * 1_000_000)
    )
    if channels is not None:
        heard = heard.filter(F.col("channel").isin(channels))
    return network_inventory(heard)


def scan_windows(beacons: DataFrame, seconds: int = 30) -> DataFrame:
    """Inventory per tumbling scan window."""
    width = seconds * 1_000_000
    start = F.expr(f"capture_us - pmod(capture_us, {width})").alias("start_us")
    return (
        _sightings(beacons, start, "bssid")
        .groupBy("start_us", "bssid")
        .agg(*_inventory_columns())
        .select(F.timestamp_micros("start_us").alias("window_start"), "*")
        .drop("start_us")
    )


def stream_scan_windows(beacons: DataFrame, seconds: int = 30, late: str = "10 seconds") -> DataFrame:
    """The same on a stream: a window comes out once the watermark has passed it."""
    timed = beacons.withColumn("capture_ts", F.timestamp_micros("capture_us")).withWatermark(
        "capture_ts", late
    )
    return (
        timed.select(
            "capture_ts", "bssid", *SIGHTED, F.lit(1).alias("n"),
            F.col("capture_us").alias("first_us"), F.col("capture_us").alias("last_us"),
        )
        .groupBy(F.window("capture_ts", f"{seconds} seconds").alias("window"), "bssid")
        .agg(*_inventory_columns())
        .select(F.col("window.start").alias("window_start"), "*")
        .drop("window")
    )


def select_target(
    beacons: DataFrame, bssid: str | None = None, ssid: str | None = None,
    channel: int | None = None,
) -> DataFrame:
    """Rows of one access point and/or network name and/or channel."""
    if bssid:
        beacons = beacons.filter(F.col("bssid") == bssid.lower())
    if ssid:
        beacons = beacons.filter(F.col("ssid") == ssid)
    return on_channels(beacons, channel) if channel else beacons


def on_channels(beacons: DataFrame, locked: int | None = None) -> DataFrame:
    """Rows of the locked channel, or of all configured channels and those that name none."""
    if locked:
        return beacons.filter(F.col("channel") == locked)
    return beacons.filter(F.col("channel").isin([0, *CHANNELS]))


def collection_summary(beacons: DataFrame) -> DataFrame:
    """Per access point: first name, rows, last signal and profiling progress; busiest first."""
    return (
        _sightings(beacons, "bssid")
        .groupBy("bssid")
        .agg(
            F.min_by("ssid", F.struct("first_us", "ssid")).alias("ssid"),
            F.sum("n").alias("beacons"),
            F.max_by("rssi", F.struct("last_us", *SIGHTED)).alias("rssi"),
        )
        .withColumn("completion_percent", completion_percent(F.col("beacons")))
        .orderBy(F.desc("beacons"), "bssid")
    )


def load_summary(observations: DataFrame) -> DataFrame:
    """How many rows and access points a data set has."""
    per_ap = observations.groupBy("bssid").agg(F.count("*").alias("n"))
    return per_ap.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("bssid").alias("bssids")
    )
