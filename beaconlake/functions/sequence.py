"""Expressions over a frame and the frames before it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.schema import DUPLICATE_GAP_US, SEQ_MODULUS, SKEW_GAP_US


def seq_jump(seq: Column, previous: Column) -> Column:
    """Forward distance in the 12-bit sequence space; 0 for a first frame."""
    return F.coalesce(F.pmod(seq - previous, F.lit(SEQ_MODULUS)), F.lit(0)).cast("int")


def seq_anomaly_score(jump: Column, tiers: int = 3) -> Column:
    """Large jumps score in proportion; with three tiers, middling jumps score 0.3."""
    score = F.when(jump > 100, F.least(F.lit(1.0), jump / F.lit(1000.0)))
    if tiers == 3:
        score = score.when(jump > 10, F.lit(0.3))
    return F.round(score.otherwise(F.lit(0.0)), 4)


def valid_skew(gap_us: Column) -> Column:
    return F.coalesce(gap_us.between(*SKEW_GAP_US), F.lit(False)).cast("int")


def clock_skew(tsf_gap: Column, gap_us: Column) -> Column:
    """Relative deviation of the transmitter's clock from the receiver's."""
    skew = (tsf_gap - gap_us).cast("double") / F.nullif(gap_us, F.lit(0)).cast("double")
    return F.when(gap_us.between(*SKEW_GAP_US), F.round(skew, 8)).otherwise(F.lit(0.0))


def is_duplicate(seq_gap_us: Column) -> Column:
    low, high = DUPLICATE_GAP_US
    return F.coalesce((seq_gap_us > low) & (seq_gap_us < high), F.lit(False)).cast("int")
