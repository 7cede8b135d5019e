"""The older profiling job for one access point."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.operators.features import sequence_features
from beaconlake.operators.inventory import select_target
from beaconlake.operators.profiles import build_single_ap_profiles
from beaconlake.schema import MIN_PROFILE_ROWS, PROFILE_SECONDS
from beaconlake.session import materialise
from beaconlake.sources.tables import append_table, store_profile


@dataclass
class SingleApResult:
    profiles_path: str
    beacons: int


def profile_one_ap(
    beacons: DataFrame, bssid: str, ssid: str | None, start_us: int,
    seconds: int = PROFILE_SECONDS, profiles_path: str | None = None, rows_path: str | None = None,
) -> SingleApResult:
    """Select one access point, profile one bounded session, update the store, append the rows."""
    end_us = start_us + seconds * 1_000_000
    heard = select_target(beacons, bssid, ssid).filter(
        (F.col("capture_us") >= start_us) & (F.col("capture_us") < end_us)
    )
    rows = materialise(sequence_features(heard), "single-ap-rows")
    count = rows.count()
    if count < MIN_PROFILE_ROWS:
        raise ValueError(f"{count} beacons captured, {MIN_PROFILE_ROWS} needed")
    profile = build_single_ap_profiles(rows, source=rows_path or "")
    stored = store_profile(beacons.sparkSession, profile, profiles_path)
    if rows_path is not None:
        append_table(rows.withColumn("label", F.lit(0)), rows_path)
    return SingleApResult(stored, count)
