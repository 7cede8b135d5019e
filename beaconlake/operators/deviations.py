"""Each observation measured against the profile of the access point it claims to be."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = [
    "ie_count", "rate_count", "security", "channel", "clock_skew_mean", "clock_skew_std",
    "rssi_min", "rssi_max",
]


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left lookup by access point; profile columns come prefixed ``p_``.

    No broadcast hint: the number of access points is not bounded. A profile table read from
    files is broadcast by Catalyst when it is small and joined by sort-merge when it is not.
    """
    have = set(profiles.columns)
    picked = [
        (F.col(c) if c in have else F.lit(None).cast("string" if c == "security" else "double"))
        .alias(f"p_{c}")
        for c in STATISTICS
    ]
    return rows.join(
        profiles.select("bssid", F.lit(True).alias("p_known"), *picked), "bssid", "left"
    )


def _equal(name: str) -> Column:
    """1 for equal values and for access points without a profile; missing never matches."""
    same = F.coalesce(F.col(name) == F.col(f"p_{name}"), F.lit(False))
    return F.when(F.col("p_known"), same.cast("int")).otherwise(F.lit(1))


def profile_deviations(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the six profile-relative features; unknown access points get 0, 0 and 1, 1, 1, 1."""
    zero = F.lit(0.0)
    off = F.abs(F.col("clock_skew") - F.coalesce("p_clock_skew_mean", zero))
    std = F.coalesce("p_clock_skew_std", zero)
    low, high = F.coalesce("p_rssi_min", zero), F.coalesce("p_rssi_max", zero)
    off_centre = F.abs(F.col("rssi") - (high + low) / 2)
    known = F.col("p_known")
    return (
        with_profile(rows, profiles)
        .withColumn(
            "clock_skew_deviation",
            F.when(known, F.when(std > 0, off / F.nullif(std, zero)).otherwise(off)).otherwise(zero),
        )
        .withColumn(
            "rssi_deviation",
            F.when(known, off_centre / F.greatest(high - low, F.lit(10.0))).otherwise(zero),
        )
        .withColumn("ie_count_match", _equal("ie_count"))
        .withColumn("rate_count_match", _equal("rate_count"))
        .withColumn("security_match", _equal("security"))
        .withColumn("channel_match", _equal("channel"))
        .drop("p_known", *[f"p_{c}" for c in STATISTICS])
    )
