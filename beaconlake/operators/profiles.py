"""Behavioural profiles: one row per access point, built from value counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.operators.ranking import same_keys, selected, value_counts
from beaconlake.schema import MIN_PROFILE_ROWS, PROGRESS_SAMPLES, UNKNOWN
from beaconlake.session import materialise

# What a mode falls back to when every value is missing.
NUMBER_MODES = {
    "ie_count": 0, "rate_count": 0, "capabilities": 0, "channel": 0, "beacon_interval": 0,
}
TEXT_MODES = {"ssid": UNKNOWN, "security": "Unknown", "supported_rates": ""}
TRIM_ABOVE = 10
NORMAL_JUMP_BELOW = 100


def profile_counts(observations: DataFrame, skew: str = "clock_skew") -> DataFrame:
    """``bssid, field, num, txt, n``: how often an access point has each value of each field.

    Counts of separate sessions add up, so they are what incremental profiles are kept as. ``skew`` is SQL.
    """
    numbers = {name: name for name in [*NUMBER_MODES, "rssi", "seq_jump"]}
    numbers |= {"clock_skew": skew, "beacons": "1"}
    return value_counts(observations, ["bssid"], numbers, {c: c for c in TEXT_MODES})


def summaries_of(counts: DataFrame, keep: str) -> DataFrame:
    """One row per ``bssid, field``: rows, mean, std, min, max of kept values, and the mode.

    ``counts`` is a stored table of value counts. ``keep`` is SQL and may use ``field, num, q1, q3, rows``.
    Everything works on distinct values, so a hot access point is as cheap as its value domain.
    """
    # Only skews are trimmed, so only they need quartiles.
    quartiles = selected(counts.filter("field = 'clock_skew'"), ["bssid"], {"q1": 0.25, "q3": 0.75})
    marked = same_keys(counts, quartiles, ["bssid"]).selectExpr(
        "*", "CASE WHEN field = 'clock_skew' THEN q1 ELSE 0D END AS centre"
    ).selectExpr(
        "*", f"CASE WHEN {keep} THEN n END AS kept_n", f"CASE WHEN {keep} THEN num END AS kept_num",
        # Moments of skews are taken around a middle value, so that they lose no digits; the rest are whole numbers.
        "num - centre AS off",
    )
    return (
        marked.groupBy("bssid", "field")
        .agg(
            F.expr("coalesce(sum(kept_n), 0) AS kept"),
            F.expr("max(centre) AS middle"),
            F.expr("sum(kept_n * off) AS offs"),
            F.expr("sum(kept_n * off * off) AS squares"),
            F.expr("min(kept_num) AS low"),
            F.expr("max(kept_num) AS high"),
            # Most frequent value; the smallest one wins a tie.
            F.expr("min(struct(-n AS rank, num, txt)) AS mode"),
        )
        .selectExpr("*", "middle + offs / nullif(kept, 0) AS mean")
        .selectExpr(
            "*", "CASE WHEN kept > 1 THEN sqrt(greatest(squares - offs * offs / kept, 0D) / (kept - 1)) ELSE 0D END AS std"
        )
    )


def _pick(field: str, column: str) -> str:
    return f"max(CASE WHEN field = '{field}' THEN {column} END)"


def _statistic(field: str, column: str, name: str) -> Column:
    return F.expr(f"coalesce({_pick(field, column)}, 0D) AS {name}")


def _modes() -> list[Column]:
    numbers = [
        F.expr(f"CAST(coalesce({_pick(c, 'mode.num')}, {default}) AS INT) AS {c}")
        for c, default in NUMBER_MODES.items()
    ]
    texts = [
        F.expr(f"coalesce({_pick(c, 'mode.txt')}, '{default}') AS {c}")
        for c, default in TEXT_MODES.items()
    ]
    return numbers + texts


def _built() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def build_profiles(observations: DataFrame, min_rows: int = MIN_PROFILE_ROWS) -> DataFrame:
    """Profiles of every access point with at least ``min_rows`` observations."""
    return profiles_of(materialise(profile_counts(observations), "value-counts"), min_rows)


def profiles_of(counts: DataFrame, min_rows: int = MIN_PROFILE_ROWS) -> DataFrame:
    """Profiles from a stored table of value counts.

    Clock-skew statistics use all rows (also those without a valid measurement) after trimming at
    1.5 interquartile ranges; sequence-jump statistics use jumps below 100.
    """
    inside = "num BETWEEN q1 - 1.5D * (q3 - q1) AND q3 + 1.5D * (q3 - q1)"
    keep = (
        f"CASE field WHEN 'clock_skew' THEN rows <= {TRIM_ABOVE} OR {inside} "
        f"WHEN 'seq_jump' THEN num < {NORMAL_JUMP_BELOW} ELSE true END"
    )
    statistics = [
        _statistic("clock_skew", "mean", "clock_skew_mean"),
        _statistic("clock_skew", "std", "clock_skew_std"),
        _statistic("clock_skew", "low", "clock_skew_min"),
        _statistic("clock_skew", "high", "clock_skew_max"),
        _statistic("rssi", "mean", "rssi_mean"),
        _statistic("rssi", "std", "rssi_std"),
        _statistic("rssi", "low", "rssi_min"),
        _statistic("rssi", "high", "rssi_max"),
        _statistic("seq_jump", "mean", "seq_jump_mean"),
        _statistic("seq_jump", "std", "seq_jump_std"),
    ]
    return (
        summaries_of(counts, keep)
        .groupBy("bssid")
        .agg(*_modes(), *statistics, F.expr(_pick("beacons", "kept")).alias("total_beacons"))
        .filter(F.col("total_beacons") >= min_rows)
        .withColumn("profile_built", _built())
        .select(
            "ssid", "bssid", "ie_count", "rate_count", "security", "capabilities", "channel",
            "beacon_interval", "supported_rates", "clock_skew_mean", "clock_skew_std",
            "clock_skew_min", "clock_skew_max", "rssi_mean", "rssi_std", "rssi_min", "rssi_max",
            "seq_jump_mean", "seq_jump_std", "total_beacons", "profile_built",
        )
    )


def build_single_ap_profiles(
    observations: DataFrame, min_rows: int = MIN_PROFILE_ROWS, source: str = ""
) -> DataFrame:
    """The older profile: skew over valid measurements only, nothing trimmed."""
    skew = "CASE WHEN valid_skew = 1 THEN clock_skew END"
    statistics = [
        _statistic("rssi", "mean", "rssi_mean"),
        _statistic("rssi", "std", "rssi_std"),
        _statistic("rssi", "low", "rssi_min"),
        _statistic("rssi", "high", "rssi_max"),
        _statistic("seq_jump", "mean", "seq_jump_mean"),
        _statistic("seq_jump", "std", "seq_jump_std"),
        _statistic("seq_jump", "high", "seq_jump_max"),
        _statistic("clock_skew", "mean", "clock_skew_mean"),
        _statistic("clock_skew", "std", "clock_skew_std"),
        F.expr(f"coalesce({_pick('clock_skew', 'kept')}, 0) AS valid_skew_samples"),
    ]
    return (
        summaries_of(materialise(profile_counts(observations, skew), "value-counts"), "true")
        .groupBy("bssid")
        .agg(*_modes(), *statistics, F.expr(_pick("beacons", "kept")).alias("total_beacons"))
        .filter(F.col("total_beacons") >= min_rows)
        .withColumn("profile_time", _built())
        .withColumn("profile_type", F.lit("legacy_single_ap"))
        .withColumn("raw_data_file", F.lit(source))
    )


def skipped_access_points(
    observations: DataFrame, min_rows: int = MIN_PROFILE_ROWS
) -> DataFrame:
    """Access points with too few observations for a profile."""
    return (
        observations.groupBy("bssid")
        .agg(F.count("*").alias("beacons"))
        .filter(F.col("beacons") < min_rows)
    )


def profile_listing(profiles: DataFrame) -> DataFrame:
    """Profiles, best observed first, with the name cut to 24 characters."""
    return profiles.select(
        F.substring("ssid", 1, 24).alias("ssid"), "bssid", "ie_count", "rate_count",
        "clock_skew_mean", "total_beacons",
    ).orderBy(F.desc("total_beacons"), "bssid")


def completion_percent(beacons: Column, needed: int = PROGRESS_SAMPLES) -> Column:
    """Progress towards ``needed`` samples, whole percent, at most 100."""
    return F.least(F.lit(100), F.floor(beacons * 100 / needed)).cast("int")


def upsert_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` replacing those of the same access point."""
    kept = old.join(new.select("bssid"), "bssid", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
