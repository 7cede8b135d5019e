"""Weighted evidence rules: is a frame suspicious, why, and how strongly."""

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.operators.deviations import STATISTICS, with_profile
from beaconlake.schema import (
    COUNT_TOLERANCE,
    EVIDENCE_WEIGHTS,
    MODEL_THRESHOLD,
    SKEW_FLOOR,
    SKEW_SIGMAS,
    STRONG_EVIDENCE,
    SUSPICION_THRESHOLD,
)

# The wording of each reason, in the order reasons are listed.
REASON_ORDER = ["duplicate_sequence", "ie_count", "security", "rate_count", "timing", "model"]
DUPLICATE_TEXT = (
    "Duplicate sequence activity: sequence %d was observed again for the same BSSID within the "
    "configured short timing window."
)
IE_TEXT = (
    "Beacon IE count deviation: observed %d Information Elements; baseline %d (Δ=%d)."
)
SECURITY_TEXT = "Advertised security change: observed %s; baseline %s."
RATE_TEXT = "Supported-rate deviation: observed %d unique rates; baseline %d."
TIMING_TEXT = (
    "Timing deviation: clock-skew estimate %s differs strongly from the profiled timing "
    "baseline (%sσ)."
)
MODEL_TEXT = (
    "Per-BSSID anomaly model: Isolation Forest decision score %s fell below the configured "
    "prototype threshold."
)


def _fixed(column: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value."""
    return F.call_function("format_number", column, F.lit("0." + "0" * digits))


def _away(name: str) -> Column:
    return F.abs(F.col(name) - F.col(f"p_{name}"))


def _skew_z() -> Column:
    mean = F.coalesce("p_clock_skew_mean", F.lit(0.0))
    return F.abs(F.col("clock_skew") - mean) / F.nullif("p_clock_skew_std", F.lit(0.0))


def _conditions() -> dict[str, Column]:
    valid = F.col("valid_skew").cast("int") == 1
    return {
        "duplicate_sequence": F.col("is_seq_duplicate") == 1,
        "ie_count": _away("ie_count") >= COUNT_TOLERANCE,
        "security": ~F.col("security").eqNullSafe(F.col("p_security")),
        "timing": valid
        & (F.col("p_clock_skew_std") > 0)
        & (_skew_z() > SKEW_SIGMAS)
        & (F.abs("clock_skew") > SKEW_FLOOR),
        "rate_count": _away("rate_count") >= COUNT_TOLERANCE,
        "model": valid & (F.col("model_score") < MODEL_THRESHOLD),
    }


def evidence(features: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Add ``ev_<rule>`` flags, ``threat_score`` (0 to 1) and ``suspicious``.

    Without ``profiles`` the rows bring their profile columns along. Scores are summed in integer hundredths. Access points without a profile never give evidence.
    A ``model_score`` column, when present, feeds the model rule.
    """
    rows = features
    if "model_score" not in rows.columns:
        rows = rows.withColumn("model_score", F.lit(None).cast("double"))
    joined = rows if profiles is None else with_profile(rows, profiles)
    flags = {
        rule: F.when(F.col("p_known") & condition, F.lit(1)).otherwise(F.lit(0))
        for rule, condition in _conditions().items()
    }
    flagged = joined.withColumns({f"ev_{rule}": flag for rule, flag in flags.items()})
    points = reduce(add, [F.col(f"ev_{r}") * w for r, w in EVIDENCE_WEIGHTS.items()])
    strong = reduce(or_, [F.col(f"ev_{r}") == 1 for r in STRONG_EVIDENCE])
    return flagged.withColumn(
        "suspicious", (strong | (points >= SUSPICION_THRESHOLD)).cast("int")
    ).withColumn("threat_score", F.least(F.lit(100), points) / F.lit(100.0))


def with_reasons(rows: DataFrame) -> DataFrame:
    """Add ``reasons``, the ordered texts of the rules that fired, and drop the profile columns."""
    text = {
        "duplicate_sequence": F.format_string(DUPLICATE_TEXT, "seq_num"),
        "ie_count": F.format_string(
            IE_TEXT, F.col("ie_count").cast("int"), F.col("p_ie_count").cast("int"),
            _away("ie_count").cast("int"),
        ),
        "security": F.format_string(SECURITY_TEXT, "security", "p_security"),
        "rate_count": F.format_string(
            RATE_TEXT, F.col("rate_count").cast("int"), F.col("p_rate_count").cast("int")
        ),
        "timing": F.format_string(
            TIMING_TEXT, _fixed(F.col("clock_skew"), 6), _fixed(_skew_z(), 1)
        ),
        "model": F.format_string(MODEL_TEXT, _fixed(F.col("model_score"), 3)),
    }
    fired = F.array(*[F.when(F.col(f"ev_{r}") == 1, text[r]) for r in REASON_ORDER])
    return rows.withColumn("reasons", F.filter(fired, lambda x: x.isNotNull())).drop(
        "p_known", *[f"p_{c}" for c in STATISTICS]
    )


def evidence_contribution(rows: DataFrame) -> DataFrame:
    """Per rule: its weight, how many frames it fired on and the points it gave in all."""
    facts = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.lit(weight).alias("weight"),
                F.col(f"ev_{rule}").alias("fired"),
            )
            for rule, weight in EVIDENCE_WEIGHTS.items()
        ]
    )
    return (
        rows.select(F.inline(facts))
        .groupBy("rule", "weight")
        .agg(
            F.sum("fired").alias("frames"),
            F.sum(F.col("fired") * F.col("weight")).alias("points"),
        )
    )
