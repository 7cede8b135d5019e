"""Batch pipelines from stored beacons to profiles, evidence and alerts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.operators.alerts import confirmed_alerts, suspicion_streaks
from beaconlake.operators.features import sequence_features
from beaconlake.operators.profiles import build_profiles
from beaconlake.operators.rules import evidence
from beaconlake.session import materialise


def baseline_profiles(baseline: DataFrame, **slicing) -> DataFrame:
    """Profiles of the baseline capture, stored as a table so that later joins know its size."""
    return materialise(build_profiles(sequence_features(baseline, **slicing)), "profiles")


def score_frames(
    beacons: DataFrame, profiles: DataFrame, since: str = "true", forest=None, **slicing
) -> DataFrame:
    """Evidence for every frame that satisfies ``since``; earlier frames only feed the features."""
    monitored = sequence_features(beacons, 2, profiles, **slicing).filter(since)
    if forest is not None:
        monitored = forest.score(monitored, where=F.col("valid_skew") == 1)
    return evidence(monitored)


def detect(
    beacons: DataFrame, profiles: DataFrame, since: str = "true", forest=None, **slicing
) -> DataFrame:
    """Frames in, alerts out."""
    return confirmed_alerts(
        suspicion_streaks(score_frames(beacons, profiles, since, forest, **slicing))
    )
