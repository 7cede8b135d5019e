"""Sequential features of each frame relative to earlier frames of its key."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import sequence as S
from beaconlake.functions.frames import security_code
from beaconlake.operators.deviations import with_profile
from beaconlake.operators.slicing import SLICED_KEY, dealt_by_slice, halo, with_slices
from beaconlake.schema import HISTORY, MIN_HISTORY, ORDER


def sequence_features(
    beacons: DataFrame, tiers: int = 3, profiles: DataFrame | None = None, **slicing
) -> DataFrame:
    """Add the sequential features and ``slice``, and on request the profile columns.

    One exchange on ``(sensor_id, bssid, slice)`` serves every window here and any later window
    on the same columns. Profiles are joined below that exchange: a later join by access point
    would bring the slices of a hot one together again.
    """
    sliced, counted = with_slices(beacons, **slicing)
    rows = sliced if profiles is None else with_profile(sliced, profiles)
    rows = rows.withColumn("_halo", F.lit(False))
    if counted:
        earlier = halo(sliced).withColumn("_halo", F.lit(True))
        # Dealt out by slice: what a join by access point leaves would satisfy the windows too.
        rows = dealt_by_slice(rows.unionByName(earlier, allowMissingColumns=True), counted)
    in_seq = Window.partitionBy(*SLICED_KEY, "seq_num").orderBy(*ORDER)
    in_time = Window.partitionBy(*SLICED_KEY).orderBy(*ORDER)
    recent = in_time.rowsBetween(1 - HISTORY, 0)

    def since(column: str, window):
        return F.col(column) - F.lag(column).over(window)

    gap, gap_ms = F.col("_gap_us"), F.col("_gap_us") / F.lit(1000.0)
    lagged = (
        rows.withColumn("_seq_gap_us", F.when(F.col("seq_num").isNotNull(), since("capture_us", in_seq)))
        .withColumns(
            {
                "_gap_us": since("capture_us", in_time),
                "_tsf_gap": since("beacon_timestamp", in_time),
                "_previous_seq": F.lag("seq_num").over(in_time),
            }
        )
        .withColumns(
            {"_gaps": F.count(gap_ms).over(recent), "_gap_var": F.var_pop(gap_ms).over(recent)}
        )
    )
    jump = S.seq_jump(F.col("seq_num"), F.col("_previous_seq"))
    made = {
        "seq_jump": jump,
        "seq_anomaly_score": S.seq_anomaly_score(jump, tiers),
        "is_seq_duplicate": S.is_duplicate(F.col("_seq_gap_us")),
        "seq_dup_delta": F.round(F.coalesce(F.col("_seq_gap_us") / 1e6, F.lit(0.0)), 6),
        "clock_skew": S.clock_skew(F.col("_tsf_gap"), gap),
        "valid_skew": S.valid_skew(gap),
        "inter_beacon_ms": F.coalesce(gap_ms, F.lit(0.0)),
        "timing_variance": F.when(
            F.col("_gaps") >= MIN_HISTORY, F.round("_gap_var", 6)
        ).otherwise(F.lit(0.0)),
        "security_encoded": security_code(F.col("security")),
    }
    return (
        lagged.filter(~F.col("_halo"))
        .withColumns(made)
        .drop("_halo", "_seq_gap_us", "_gap_us", "_tsf_gap", "_previous_seq", "_gaps", "_gap_var")
    )
