"""Tables behind the charts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.operators.ranking import RANGES, bucketed_row_number, with_quantiles
from beaconlake.schema import EVIDENCE_WEIGHTS
from beaconlake.session import materialise

SKEW_SHOWN_BELOW = 0.005
TOP_NETWORKS = 5
SHOWN_PROFILES = 8
LABEL = "LAB_AP_%02d"
NO_LABEL = "LAB_AP_UNKNOWN"
QUARTILES = {"q0": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "q4": 1.0}


def network_labels(rows: DataFrame, order: str = "capture_us", bucket: str | None = None) -> DataFrame:
    """``ssid, ssid_label``: presentation names in order of first appearance, then of name.

    Names are numbered in ranges of first appearance that hold about equally many, wherever in time
    most of them appear, or in buckets that the caller names.
    """
    first = materialise(
        rows.filter(F.col("ssid").isNotNull()).groupBy("ssid").agg(F.min(order).alias("first")), "first-heard"
    )
    if bucket is None:
        shares = [i / RANGES for i in range(1, RANGES)]
        cuts = first.agg(F.percentile_approx("first", shares, 10 * RANGES)).first()[0] or [0]
        bucket = f"size(filter(array({', '.join(map(str, sorted(set(cuts))))}), e -> e < first))"
    ranked = bucketed_row_number(first, [], F.expr(bucket), ["first", "ssid"], "position")
    return ranked.select("ssid", F.format_string(LABEL, "position").alias("ssid_label"))


def label_networks(rows: DataFrame, labels: DataFrame, anonymise: bool = True) -> DataFrame:
    """Add ``display_ap``: the presentation name, or the real one when not anonymising."""
    if not anonymise:
        return rows.withColumn("display_ap", F.col("ssid"))
    return (
        rows.join(labels, "ssid", "left")
        .withColumn("display_ap", F.coalesce("ssid_label", F.lit(NO_LABEL)))
        .drop("ssid_label")
    )


def skew_counts(features: DataFrame) -> DataFrame:
    """``ssid, valid, num, n, first_us``: how often each numeric skew of a named network occurs."""
    skew = F.expr("try_cast(clock_skew AS DOUBLE)")
    valid = F.lit(0)
    if "valid_skew" in features.columns:
        valid = F.coalesce((F.expr("try_cast(valid_skew AS DOUBLE)") == 1).cast("int"), F.lit(0))
    return (
        features.select("ssid", "capture_us", skew.alias("num"), valid.alias("valid"))
        .filter(F.col("num").isNotNull() & ~F.isnan("num") & F.col("ssid").isNotNull())
        .groupBy("ssid", "valid", "num")
        .agg(F.count("*").alias("n"), F.min("capture_us").alias("first_us"))
    )


def skew_distribution(features: DataFrame, anonymise: bool = True) -> DataFrame:
    """Box-plot figures of clock skew for the five networks with most observations.

    Only small skews count, and only valid ones if there are any. Whiskers reach the outermost
    observation within 1.5 interquartile ranges of the box.
    """
    counts = materialise(skew_counts(features), "skew-counts")  # read several times below
    best = counts.agg(F.max("valid").alias("best"))
    shown = counts.join(
        F.broadcast(best), F.col("valid") == F.col("best")  # a single row
    ).filter(F.abs("num") < SKEW_SHOWN_BELOW)
    top = (
        shown.groupBy("ssid")
        .agg(F.sum("n").alias("observations"), F.min("first_us").alias("first_us"))
        .orderBy(F.desc("observations"), "ssid")
        .limit(TOP_NETWORKS)
    )
    position = F.row_number().over(Window.orderBy("first_us", "ssid"))
    labels = top.select("ssid", F.format_string(LABEL, position).alias("ssid_label"))
    values = (
        shown.join(F.broadcast(top.select("ssid")), "ssid", "left_semi")  # five rows
        .groupBy("ssid", "num")
        .agg(F.sum("n").alias("n"))
    )
    spread = F.col("q3") - F.col("q1")
    near = F.when(
        F.col("num").between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread), F.col("num")
    )
    boxes = (
        with_quantiles(values, ["ssid"], QUARTILES)
        .groupBy("ssid")
        .agg(
            F.sum("n").alias("observations"),
            *[F.first(q).alias(q) for q in QUARTILES],
            F.min(near).alias("whisker_low"),
            F.max(near).alias("whisker_high"),
        )
    )
    return label_networks(boxes, labels, anonymise)


def ie_baseline(profiles: DataFrame, anonymise: bool = True) -> DataFrame:
    """Typical element count of the first eight profiles, labelled by network name."""
    first = profiles.orderBy("bssid").limit(SHOWN_PROFILES).select("bssid", "ssid", "ie_count")
    labels = network_labels(first, "bssid", "0")
    return label_networks(first, labels, anonymise)


def evidence_weights(spark) -> DataFrame:
    """The weight of each live rule."""
    return spark.createDataFrame(list(EVIDENCE_WEIGHTS.items()), "rule string, weight int")
