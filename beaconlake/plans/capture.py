"""Beacon captures derived from the ``events`` table.

Twelve access points share nine network names. The first half of each access point's frames is a
benign baseline; later frames contain bursts (``label = 1``) of one of three attacks: changed
elements and security, repeated sequence numbers, or changed rates and clock.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.operators.ranking import bucketed_row_number
from beaconlake.session import materialise, path_exists

ACCESS_POINTS = 12
FULL_RATES = "1.0,2.0,5.5,6.0,9.0,11.0,12.0,18.0,24.0,36.0,48.0,54.0"
BASIC_RATES = "1.0,2.0,5.5,11.0"

_tables: dict[tuple[str, str, str], DataFrame] = {}


def beacons_from_events(events: DataFrame) -> DataFrame:
    """One beacon per event, in the layout of ``BEACON_SCHEMA`` plus ``is_baseline`` and ``label``."""
    keyed = events.select(
        F.col("event_id").alias("frame_id"), "ts",
        (F.col("user_id") % ACCESS_POINTS).cast("int").alias("ap"),
    )
    sizes = keyed.groupBy("ap").agg(F.count("*").alias("n"))  # twelve rows
    ranked = bucketed_row_number(keyed, ["ap"], F.date_trunc("hour", "ts"), ["ts", "frame_id"], "k")
    frames = (
        ranked.join(F.broadcast(sizes), "ap")
        .withColumn("is_baseline", F.col("k") * 2 <= F.col("n"))
        .withColumn("burst", ~F.col("is_baseline") & (F.col("k") % 60).between(30, 45))
        .withColumn("pause", F.floor(F.col("k") / 25.0))
    )
    k, ap, pause = F.col("k"), F.col("ap"), F.col("pause")

    def attack(kind: int):
        return F.col("burst") & (ap % 3 == kind)

    jitter = (F.col("frame_id") * 7919) % 401 - 200
    rewind = F.when(attack(1) & (k % 2 == 1), 1).otherwise(0)
    drift = F.when(attack(2) & (k % 2 == 0), 20_000).otherwise(0)
    return frames.select(
        "frame_id",
        F.lit("default").alias("sensor_id"),
        F.lit("default").alias("session_id"),
        (F.lit(1704067200000000) + k * 102_400 + jitter + pause * 2_500_000).cast("bigint").alias("capture_us"),
        F.concat(F.lit("LAB_AP_"), F.lpad((ap % 9).cast("string"), 2, "0")).alias("ssid"),
        F.concat(F.lit("02:10:00:00:00:"), F.lpad(ap.cast("string"), 2, "0")).alias("bssid"),
        (-45 - ap * 2 - F.col("frame_id") % 9).cast("int").alias("rssi"),
        (1 + ap % 11).cast("int").alias("channel"),
        ((k + pause * 25 + F.floor(k / 200.0) * 150 - rewind) % 4096).cast("int").alias("seq_num"),
        (k * 102_400 + pause * 2_500_000 + ap * k + drift).cast("bigint").alias("beacon_timestamp"),
        F.lit(100).alias("beacon_interval"),
        F.when(attack(0), 1041).otherwise(1073).alias("capabilities"),
        F.when(attack(2), BASIC_RATES).otherwise(FULL_RATES).alias("supported_rates"),
        F.when(attack(2), 4).otherwise(12).alias("rate_count"),
        F.when(attack(0), "WEP").otherwise("WPA2/WPA3").alias("security"),
        F.when(attack(0), 4).otherwise(18 + F.col("frame_id") % 2).cast("int").alias("ie_count"),
        "is_baseline",
        F.col("burst").cast("int").alias("label"),
    )


def beacons(spark: SparkSession, data_dir: str) -> DataFrame:
    """The derived ``beacons`` table, written once per session and data set, then read as files."""
    return _table(spark, data_dir, "beacons", beacons_from_events)


def _table(spark: SparkSession, data_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, data_dir, name)
    if key not in _tables or not path_exists(spark, _tables[key].inputFiles()[0]):
        source = spark.read.parquet(f"{data_dir.rstrip('/')}/events.parquet")
        _tables[key] = materialise(build(source), name)
    return _tables[key]


def _octets(value, width: int):
    """Little-endian hexadecimal text of an integer column."""
    big_endian = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    pairs = F.regexp_extract_all(big_endian, F.lit("(..)"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def _element(number: int, info):
    """Hexadecimal text of one information element."""
    return F.concat(F.lit(f"{number:02X}"), F.lpad(F.hex((F.length(info) / 2).cast("int")), 2, "0"), info)


def frames_from_beacons(rows: DataFrame) -> DataFrame:
    """802.11 beacon frames that carry the values of beacon rows.

    One frame in 50 is unusable: another subtype, a truncated header, or no elements.
    """
    mac = F.replace("bssid", F.lit(":"), F.lit(""))
    rates = F.transform(
        F.split("supported_rates", ","),
        lambda r: F.lpad(F.hex((r.cast("double") * 2).cast("int")), 2, "0"),
    )
    extended = F.size(rates) > 8
    rsn = F.col("security") == "WPA2/WPA3"
    base = 3 + extended.cast("int") + rsn.cast("int")
    filler = F.repeat(_element(221, F.lit("00904C0418")), (F.col("ie_count") - base).cast("int"))
    elements = F.concat(
        _element(0, F.hex("ssid")),
        _element(1, F.array_join(F.slice(rates, 1, 8), "")),
        _element(3, _octets(F.col("channel"), 1)),
        F.when(extended, _element(50, F.array_join(F.slice(rates, 9, 8), ""))).otherwise(""),
        F.when(rsn, _element(48, F.lit("0100"))).otherwise(""),
        filler,
    )
    case = F.col("frame_id") % 150
    header = F.concat(
        F.when(case == 0, "4000").otherwise("8000"), F.lit("0000"), F.lit("F" * 12), mac, mac,
        _octets(F.col("seq_num") * 16, 2),
    )
    fixed = F.concat(
        _octets(F.col("beacon_timestamp"), 8), _octets(F.col("beacon_interval"), 2),
        _octets(F.col("capabilities"), 2),
    )
    text = (
        F.when(case == 1, header)
        .when(case == 2, F.concat(header, fixed))
        .otherwise(F.concat(header, fixed, elements))
    )
    return rows.select(
        "frame_id", "sensor_id", "session_id", "capture_us", "rssi", F.unhex(text).alias("frame")
    )


def frames(spark: SparkSession, data_dir: str) -> DataFrame:
    """The derived ``frames`` table."""
    return _table(
        spark, data_dir, "frames", lambda events: frames_from_beacons(beacons(spark, data_dir))
    )
