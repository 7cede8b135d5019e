"""Named queries over the beacons derived from a data set, one or more per operator."""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions.frames import security_code
from beaconlake.operators import alerts as alerting
from beaconlake.operators import analysis, inventory, privacy, profiles, supervised
from beaconlake.operators.decode import (
    collector_observations, decode_frames, element_table, observations, quarantined_frames,
)
from beaconlake.operators.deviations import profile_deviations
from beaconlake.operators.features import sequence_features
from beaconlake.operators.iforest import Forest, fit_global, fit_per_ap, score_range
from beaconlake.operators.rules import evidence, evidence_contribution, with_reasons
from beaconlake.plans.capture import beacons, frames, frames_from_beacons
from beaconlake.plans.detection import baseline_profiles, detect, score_frames
from beaconlake.plans.single_ap import profile_one_ap
from beaconlake.schema import SUPERVISED_FEATURES
from beaconlake.session import materialise, new_path
from beaconlake.sources import layout, tables
from beaconlake.streaming import detection as live

MONITORED = "NOT is_baseline"
START_US = 1_704_067_200_000_000
# Small slices, so that the hot-key path of an operator runs on any data set.
SLICED = {"rows_per_slice": 64, "bucket_us": 5_000_000}

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(build: Query) -> Query:
    CATALOG[build.__name__] = build
    return build


def _rounded(rows: DataFrame, digits: int, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, digits) for n in names})


def _baseline(spark, data_dir) -> DataFrame:
    return beacons(spark, data_dir).filter("is_baseline")


def _profiles(spark, data_dir) -> DataFrame:
    return baseline_profiles(_baseline(spark, data_dir))


def _scored(spark, data_dir, **slicing) -> DataFrame:
    rows = beacons(spark, data_dir)
    return score_frames(rows, _profiles(spark, data_dir), MONITORED, **slicing)


# --- Sequential features


def _feature(*names: str) -> Query:
    return lambda spark, data_dir: sequence_features(beacons(spark, data_dir)).select("frame_id", *names)


CATALOG["seq_jump"] = _feature("seq_jump")
CATALOG["seq_anomaly"] = _feature("seq_anomaly_score")
CATALOG["clock_skew"] = _feature("clock_skew", "valid_skew")
CATALOG["inter_beacon"] = _feature("inter_beacon_ms")
CATALOG["seq_duplicate"] = _feature("is_seq_duplicate", "seq_dup_delta")


@query
def seq_anomaly_two_tier(spark, data_dir):
    rows = sequence_features(beacons(spark, data_dir), tiers=2)
    return rows.select("frame_id", "seq_anomaly_score")


@query
def timing_variance(spark, data_dir):
    rows = sequence_features(beacons(spark, data_dir))
    return _rounded(rows.select("frame_id", "timing_variance"), 3, "timing_variance")


@query
def sliced_features(spark, data_dir):
    rows = sequence_features(beacons(spark, data_dir), **SLICED).select(
        "frame_id", "seq_jump", "clock_skew", "inter_beacon_ms", "timing_variance",
        "is_seq_duplicate", "seq_dup_delta",
    )
    return _rounded(rows, 3, "timing_variance")


@query
def bucketed_features(spark, data_dir):
    """The same features over a bucketed table that was filled by two appends and compacted."""
    rows, table = beacons(spark, data_dir), f"beacons_{uuid.uuid4().hex}"
    path = new_path(spark, "bucketed")
    for half in (0, 1):
        layout.store_beacons(rows.filter(f"pmod(frame_id, 2) = {half}"), table, path, buckets=8)
    day = spark.table(table).agg(F.min(layout.DATE)).first()[0]
    layout.compact_date(spark, table, day)
    made = sequence_features(spark.table(table)).select(
        "frame_id", "seq_jump", "clock_skew", "inter_beacon_ms", "timing_variance", "is_seq_duplicate", "seq_dup_delta",
    )
    return _rounded(made, 3, "timing_variance")


# --- Frames


@query
def frame_observations(spark, data_dir):
    return collector_observations(frames(spark, data_dir)).drop("sensor_id", "session_id")


@query
def scanned_networks(spark, data_dir):
    decoded = decode_frames(frames(spark, data_dir), keep_bare=True)
    return inventory.network_inventory(observations(decoded))


@query
def live_networks(spark, data_dir):
    """The list of networks after frames have arrived in four batches."""
    folder, path = new_path(spark, "arriving"), new_path(spark, "live-networks")
    files = spark.sparkContext.defaultParallelism  # of a batch, so that writing and decoding use every core
    frames(spark, data_dir).repartition(4 * files, "frame_id").write.parquet(folder)
    arriving = live.read_frames(spark, folder, maxFilesPerTrigger=files)
    heard = observations(decode_frames(arriving, keep_bare=True))
    live.live_networks(heard, path, new_path(spark, "live-checkpoint")).awaitTermination()
    return live.network_list(spark, path)


@query
def collection_totals(spark, data_dir):
    """Counters of a collection that was stopped and started again."""
    table, checkpoint, totals = (new_path(spark, f"totals-{n}") for n in ("rows", "checkpoint", "networks"))
    middle = frames(spark, data_dir).agg(F.expr("(min(capture_us) + max(capture_us)) div 2")).first()[0]
    parts = new_path(spark, "totals-frames")
    for early in (True, False):
        part = frames(spark, data_dir).filter((F.col("capture_us") <= middle) == F.lit(early))
        live.arrive_in_order(part, parts)
        live.collect_baseline(live.read_frames(spark, parts), table, checkpoint, totals).awaitTermination()
    return live.session_totals(spark, totals)


@query
def security_ladder(spark, data_dir):
    """Frames with RSN, with WPA only, with the privacy bit only, and with neither; by frame number."""
    rung = F.col("frame_id") % 4
    planned = beacons(spark, data_dir).withColumns(
        {
            "security": F.when(rung == 0, "WPA2/WPA3").otherwise("none"),
            "capabilities": F.when(rung == 3, 1).otherwise(17),
        }
    )
    wpa = F.when(F.col("frame_id") % 4 == 1, F.unhex(F.lit("DD060050F2010100"))).otherwise(F.unhex(F.lit("")))
    sent = frames_from_beacons(planned).withColumn("frame", F.concat("frame", wpa))
    decoded = observations(decode_frames(sent))
    return decoded.select("frame_id", "security")


@query
def revealed_names(spark, data_dir):
    """Access points that hide their name in four of five frames."""
    hidden = F.when(F.col("frame_id") % 5 > 0, "<Hidden>").otherwise(F.col("ssid"))
    return inventory.network_inventory(beacons(spark, data_dir).withColumn("ssid", hidden))


@query
def ie_elements(spark, data_dir):
    elements = element_table(decode_frames(frames(spark, data_dir)))
    return elements.groupBy("bssid", "id").agg(
        F.count("*").alias("elements"), F.sum(F.length("info")).alias("octets"),
        F.max("position").alias("last_position"),
    )


@query
def frame_problems(spark, data_dir):
    rows = quarantined_frames(frames(spark, data_dir))
    return rows.groupBy("problem").agg(F.count("*").alias("frames"))


# --- Inventory


@query
def network_inventory(spark, data_dir):
    return inventory.network_inventory(beacons(spark, data_dir))


@query
def strongest_networks(spark, data_dir):
    networks = inventory.network_inventory(beacons(spark, data_dir))
    return inventory.listing(inventory.strongest_first(networks)).select(
        "bssid", "ssid", "channel", "rssi", "signal_band", "security", "beacons"
    )


@query
def five_strongest_networks(spark, data_dir):
    networks = inventory.network_inventory(beacons(spark, data_dir))
    return inventory.strongest_first(networks, 5).select("bssid", "ssid", "rssi")


@query
def collection_summary(spark, data_dir):
    return inventory.collection_summary(beacons(spark, data_dir))


@query
def scan_windows(spark, data_dir):
    rows = inventory.scan_windows(beacons(spark, data_dir))
    return rows.withColumn("window_start", F.unix_micros("window_start"))


@query
def scan_session(spark, data_dir):
    found = inventory.scan_session(beacons(spark, data_dir), START_US, 20, [1, 2, 3, 4, 5, 6])
    return found.select("bssid", "ssid", "channel", "rssi", "beacons")


@query
def target_rows(spark, data_dir):
    rows = inventory.select_target(
        beacons(spark, data_dir), bssid="02:10:00:00:00:10", ssid="LAB_AP_01",
        channel=11,
    )
    return rows.select("frame_id", "bssid", "ssid", "channel", "rssi")


@query
def load_summary(spark, data_dir):
    return inventory.load_summary(beacons(spark, data_dir))


# --- Import and storage


def _text_table(spark, data_dir) -> DataFrame:
    """Baseline rows written as CSV, with repeated header lines and unreadable cells, and re-read."""
    columns = [*tables.PROFILE_COLUMNS, "frame_id"]
    rows = sequence_features(_baseline(spark, data_dir)).select(
        *[
            F.when(F.col("frame_id") % 97 == 0, "bad").otherwise(F.col(c).cast("string")).alias(c)
            if c in ("rssi", "ie_count")
            else F.upper(c).alias(c)
            if c == "bssid"
            else F.col(c).cast("string").alias(c)
            for c in columns
        ]
    )
    headers = rows.filter("CAST(frame_id AS BIGINT) % 500 = 0").select(*[F.lit(c).alias(c) for c in columns])
    path = new_path(spark, "csv")
    rows.unionByName(headers).write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


def _import_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bssid").agg(
        F.count("*").alias("rows"), F.count("rssi").alias("rssi_values"),
        F.sum("rssi").alias("rssi_sum"), F.sum("ie_count").alias("ie_sum"),
    )


@query
def import_for_profiles(spark, data_dir):
    return _import_totals(tables.clean_for_profiles(_text_table(spark, data_dir)))


@query
def import_for_models(spark, data_dir):
    return _import_totals(tables.clean_for_models(_text_table(spark, data_dir)))


PROFILE_STATISTICS = [
    "clock_skew_mean", "clock_skew_std", "clock_skew_min", "clock_skew_max", "rssi_mean",
    "rssi_std", "rssi_min", "rssi_max", "seq_jump_mean", "seq_jump_std",
]


@query
def profiles_json(spark, data_dir):
    return _exported(spark, data_dir, 100_000)


@query
def profiles_json_split(spark, data_dir):
    """The same export with few profiles to a document, hence several documents."""
    return _exported(spark, data_dir, 3)


def _exported(spark, data_dir, per_document):
    path = new_path(spark, "profiles-json")
    tables.write_profiles_json(_profiles(spark, data_dir), path, per_document)
    rows = tables.read_profiles_json(spark, path).drop("profile_built")
    return _rounded(rows, 8, *PROFILE_STATISTICS)


@query
def profile_upsert(spark, data_dir):
    old = _profiles(spark, data_dir)
    changed = sequence_features(beacons(spark, data_dir)).filter(MONITORED)
    first = tables.store_profile(spark, old)
    path = tables.store_profile(spark, profiles.build_profiles(changed), first)
    return spark.read.parquet(path).select("bssid", "security", "ie_count", "total_beacons")


@query
def missing_columns(spark, data_dir):
    """What an import says of tables without some of the columns it needs."""
    rows, said = beacons(spark, data_dir), []
    for name, required, lacking in (
        ("profiles", tables.PROFILE_COLUMNS, rows.drop("rssi", "security")), ("models", tables.MODEL_COLUMNS, rows.drop("bssid")),
    ):
        try:
            tables.require_columns(lacking.withColumns({"seq_jump": F.lit(0), "clock_skew": F.lit(0.0)}), required)
        except ValueError as error:
            said.append(rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("import"), "rows", F.lit(str(error)).alias("said")))
    return said[0].union(said[1])


# --- Profiles


@query
def ap_profiles(spark, data_dir):
    rows = profiles.build_profiles(sequence_features(_baseline(spark, data_dir)))
    return _rounded(rows.drop("profile_built"), 8, *PROFILE_STATISTICS)


@query
def merged_profiles(spark, data_dir):
    """Profiles of the baseline, added to a store in three sessions, and an empty one."""
    rows = _base(spark, data_dir)
    store, profiled = new_path(spark, "profile-sessions"), None
    for number in range(4):
        session = rows.filter(f"pmod(frame_id div 7, 3) = {number}")
        profiled = tables.add_session(spark, session, store, number)
    return _rounded(profiled.drop("profile_built"), 8, *PROFILE_STATISTICS)


@query
def profile_listing(spark, data_dir):
    return _rounded(profiles.profile_listing(_profiles(spark, data_dir)), 8, "clock_skew_mean")


@query
def skipped_aps(spark, data_dir):
    """All beacons, with every 997th frame as the only one of an access point of its own."""
    alone = F.concat_ws("-", "bssid", F.col("frame_id").cast("string"))
    rows = beacons(spark, data_dir).withColumn(
        "bssid", F.when(F.col("frame_id") % 997 == 0, alone).otherwise(F.col("bssid"))
    )
    return profiles.skipped_access_points(rows)


@query
def single_ap_profiles(spark, data_dir):
    rows = profiles.build_single_ap_profiles(sequence_features(_baseline(spark, data_dir)))
    statistics = [c for c in rows.columns if c.endswith(("_mean", "_std", "_min", "_max"))]
    return _rounded(rows.drop("profile_time", "raw_data_file"), 8, *statistics)


@query
def single_ap_job(spark, data_dir):
    result = profile_one_ap(
        beacons(spark, data_dir), "02:10:00:00:00:05", None, START_US, rows_path=new_path(spark, "rows")
    )
    stored = spark.read.parquet(result.profiles_path)
    return _rounded(
        stored.select("bssid", "ssid", "channel", "total_beacons", "valid_skew_samples", "rssi_mean"),
        8, "rssi_mean",
    )


# --- Profile-relative features, evidence, alerts


@query
def deviations(spark, data_dir):
    rows = profile_deviations(sequence_features(beacons(spark, data_dir)), _profiles(spark, data_dir))
    return _rounded(
        rows.select(
            "frame_id", "clock_skew_deviation", "rssi_deviation", "ie_count_match",
            "rate_count_match", "security_match", "channel_match",
        ),
        6, "clock_skew_deviation", "rssi_deviation",
    )


@query
def frame_evidence(spark, data_dir):
    rows = with_reasons(_scored(spark, data_dir))
    return rows.select(
        "frame_id", "bssid", "ev_duplicate_sequence", "ev_ie_count", "ev_security",
        "ev_rate_count", "ev_timing", "suspicious", "threat_score",
        F.array_join("reasons", " ").alias("reasons"),
    )


@query
def evidence_points(spark, data_dir):
    return evidence_contribution(_scored(spark, data_dir))


@query
def unknown_access_points(spark, data_dir):
    """Profiles of half the access points only: evidence and deviations of the frames of the others."""
    known = _profiles(spark, data_dir).filter("CAST(right(bssid, 2) AS INT) % 2 = 0")
    rows = beacons(spark, data_dir)
    judged = score_frames(rows, known).filter("CAST(right(bssid, 2) AS INT) % 2 = 1")
    measured = profile_deviations(sequence_features(rows), known)
    return judged.select("frame_id", "ev_duplicate_sequence", "ev_ie_count", "ev_security", "suspicious", "threat_score").join(
        measured.select(
            "frame_id", "clock_skew_deviation", "rssi_deviation", "ie_count_match", "rate_count_match",
            "security_match", "channel_match",
        ),
        "frame_id",
    )


@query
def suspicious_streaks(spark, data_dir):
    rows = alerting.suspicion_streaks(_scored(spark, data_dir))
    return rows.select("frame_id", "bssid", "suspicious", "streak")


@query
def sliced_streaks(spark, data_dir):
    rows = alerting.suspicion_streaks(_scored(spark, data_dir, **SLICED))
    return rows.select("frame_id", "bssid", "suspicious", "streak")


def _alert_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "alert_number", "frame_id", "bssid", "ssid", "capture_us", "channel", "rssi",
        "threat_score_100", "streak", F.array_join("reasons", " ").alias("reasons"),
    )


def _alerts(spark, data_dir, **slicing) -> DataFrame:
    return detect(beacons(spark, data_dir), _profiles(spark, data_dir), MONITORED, **slicing)


@query
def alerts(spark, data_dir):
    return _alert_columns(_alerts(spark, data_dir))


@query
def sliced_alerts(spark, data_dir):
    return _alert_columns(_alerts(spark, data_dir, **SLICED))


@query
def alert_log(spark, data_dir):
    return alerting.alert_log(_alerts(spark, data_dir))


@query
def detection_totals(spark, data_dir):
    streaks = materialise(alerting.suspicion_streaks(_scored(spark, data_dir)), "scored-frames")
    raised = alerting.confirmed_alerts(streaks)
    facts = streaks.selectExpr("1 AS frames", "suspicious", "0 AS alerts").union(
        raised.selectExpr("0 AS frames", "0 AS suspicious", "1 AS alerts")
    )
    return facts.agg(
        F.sum("frames").alias("frames_evaluated"), F.sum("suspicious").alias("suspicious_frames"),
        F.sum("alerts").alias("alerts"),
    )


def _arriving(spark, rows: DataFrame) -> str:
    """A folder in which the rows of a table arrive in the order of capture."""
    folder = new_path(spark, "arriving")
    live.arrive_in_order(rows, folder)
    return folder


@query
def collected_table(spark, data_dir):
    """The streaming collector over the whole frames table: decode, features, append."""
    folder = _arriving(spark, frames(spark, data_dir))
    path, checkpoint = new_path(spark, "collected"), new_path(spark, "collector-checkpoint")
    live.collect_baseline(live.read_frames(spark, folder), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select(
        "frame_id", "bssid", "ssid", "supported_rates", "seq_jump", "seq_anomaly_score",
        "is_seq_duplicate", "clock_skew", "valid_skew", "inter_beacon_ms", "label",
    )


@query
def stream_alerts(spark, data_dir):
    """The streaming job over the whole beacons table, run until it has caught up."""
    folder = _arriving(spark, beacons(spark, data_dir))
    detected = live.stream_detection(
        live.read_beacons(spark, folder), _profiles(spark, data_dir)
    )
    path, checkpoint = new_path(spark, "stream-alerts"), new_path(spark, "stream-checkpoint")
    live.run_detection(detected, path, checkpoint).awaitTermination()
    return _alert_columns(spark.read.parquet(path))


def _session_for_models(spark: SparkSession) -> SparkSession:
    """A session of its own that keeps models in stream state; the caller's stays as it is."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.session.timeZone", "UTC")
    for name in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None and apart.conf.isModifiable(name):
            apart.conf.set(name, value)
    for name, value in live.SEEDED_STATE.items():
        apart.conf.set(name, value)
    return apart


@query
def stream_model_alerts(spark, data_dir):
    """Live scoring with the models broadcast and with them in the state, against the batch.

    Per way: frames evaluated, and frames and alerts that differ from the batch's, scores to the bit.
    """
    base, known = _base(spark, data_dir), _profiles(spark, data_dir)
    forest = fit_per_ap(base, known)
    path = new_path(spark, "stream-forest")
    forest.save(path)
    compared = ["model_score", "ev_model", "suspicious", "threat_score", "streak"]
    batch = alerting.suspicion_streaks(score_frames(beacons(spark, data_dir), known, forest=forest))
    want = materialise(batch.select("frame_id", *compared), "batch-frames")
    raised = materialise(alerting.confirmed_alerts(batch).select("frame_id"), "batch-alerts")
    known_path = known.inputFiles()[0].rsplit("/", 1)[0]
    folder = _arriving(spark, beacons(spark, data_dir))
    results = []
    for way, limit in (("broadcast", None), ("state", 0)):
        apart = _session_for_models(spark)
        stored = Forest.load(apart, path)
        options = {} if limit is None else {"broadcast_nodes": limit}
        detected = live.stream_detection(
            live.read_beacons(apart, folder), apart.read.schema(known.schema).parquet(known_path), stored, **options
        )
        rows = new_path(spark, "stream-frames")
        detected.select("frame_id", *compared, "is_late", "is_alert").writeStream.format("parquet").option(
            "path", rows
        ).option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(
            availableNow=True
        ).start().awaitTermination()
        got = spark.read.parquet(rows)
        same = F.lit(True)
        for c in compared:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        frames_seen = got.alias("a").join(want.alias("b"), "frame_id", "full").select(
            F.col("a.streak").isNotNull().cast("int").alias("frames"), (~same).cast("int").alias("frame"), F.lit(0).alias("alert")
        )
        live_alerts = got.filter("is_alert").select("frame_id", F.lit(1).alias("live"))
        alarms = live_alerts.join(raised.withColumn("stored", F.lit(1)), "frame_id", "full").select(
            F.lit(0), F.lit(0), (F.col("live").isNull() | F.col("stored").isNull()).cast("int")
        )
        results.append(
            frames_seen.union(alarms).agg(
                F.sum("frames").alias("frames_evaluated"), F.sum("frame").alias("differing_frames"),
                F.sum("alert").alias("differing_alerts"),
            ).select(F.lit(way).alias("way"), "*")
        )
    return results[0].union(results[1])


# --- Models. Trees are random by nature; the queries show what is determined about them.


def _base(spark, data_dir) -> DataFrame:
    return materialise(sequence_features(_baseline(spark, data_dir)), "baseline-features")


def _forest(spark, data_dir, base: DataFrame, **options) -> Forest:
    return fit_per_ap(base, materialise(profiles.build_profiles(base), "profiles"), **options)


@query
def forest_scores(spark, data_dir):
    """Per access point: rows, scored rows, and whether a twentieth of the training rows is below 0."""
    base = _base(spark, data_dir)
    forest = _forest(spark, data_dir, base)
    scored = forest.score(sequence_features(beacons(spark, data_dir)), F.col("valid_skew") == 1)
    below, upto = (F.count(F.when(c, 1)) for c in (F.col("model_score") < 0, F.col("model_score") <= 0))
    twentieth = F.count("*") / 20  # equal scores may all lie at the offset itself
    shares = forest.score(base).groupBy("bssid").agg(
        ((below <= twentieth + 1) & (upto >= F.floor(twentieth))).alias("share_holds")
    )
    return (
        scored.groupBy("bssid")
        .agg(F.count("*").alias("rows"), F.count("model_score").alias("scored"))
        .join(shares, "bssid")
    )


@query
def forest_cogroup_parity(spark, data_dir):
    """Fitting and scoring by broadcast and by cogroup: rows and how many of them differ."""
    base = _base(spark, data_dir)
    known = materialise(profiles.build_profiles(base), "profiles")
    a, b = fit_per_ap(base, known, trees=20), fit_per_ap(base, known, trees=20, broadcast_nodes=0)
    where = F.col("valid_skew") == 1
    left = a.score(base, where).select("frame_id", F.col("model_score").alias("x"))
    right = b.score(base, where, broadcast_nodes=0).select("frame_id", F.col("model_score").alias("y"))
    differ = F.count(F.when(~F.col("x").eqNullSafe(F.col("y")), 1))
    return left.join(right, "frame_id").agg(F.count("*").alias("rows"), differ.alias("differing"))


@query
def forest_scaling(spark, data_dir):
    params = _forest(spark, data_dir, _base(spark, data_dir)).params
    return params.select(
        F.col("model_key").alias("bssid"), "rows",
        *[F.round(F.col("means")[i], 6).alias(f"mean_{i}") for i in range(4)],
        *[F.round(F.col("scales")[i], 6).alias(f"scale_{i}") for i in range(4)],
    )


@query
def nonfinite_features(spark, data_dir):
    """Training rows with NaN and infinite values: left out of the models of access points, 0 in the global one."""
    base = _base(spark, data_dir)
    known = materialise(profiles.build_profiles(base), "profiles")
    odd = F.col("frame_id") % 10
    planted = base.withColumn(
        "clock_skew", F.when(odd == 0, float("nan")).when(odd == 1, float("inf")).otherwise(F.col("clock_skew"))
    )
    per_ap = fit_per_ap(planted, known, trees=1).params.select("model_key", "rows", F.col("means")[0].alias("mean"))
    whole = fit_global(planted, trees=1)
    at = whole.features.index("clock_skew")
    overall = whole.params.select("model_key", "rows", F.col("means")[at].alias("mean"))
    return _rounded(per_ap.union(overall), 9, "mean")


@query
def forest_nodes(spark, data_dir):
    """Per access point: trees, rows of their leaves, and whether nodes are odd and depth is bounded."""
    nodes = _forest(spark, data_dir, _base(spark, data_dir)).nodes()
    trees = nodes.groupBy("model_key", "tree_id").agg(
        F.count("*").alias("nodes"), F.max("depth").alias("depth"),
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("rows"),
    )
    return trees.groupBy(F.col("model_key").alias("bssid")).agg(
        F.count("*").alias("trees"), F.min("rows").alias("least_rows"), F.max("rows").alias("most_rows"),
        F.count(F.when((F.col("nodes") % 2 == 0) | (F.col("depth") > 8), 1)).alias("malformed"),
    )


@query
def forest_global(spark, data_dir):
    base = _base(spark, data_dir)
    known = materialise(profiles.build_profiles(base), "profiles")
    fitted = score_range(fit_global(profile_deviations(base, known)))
    return fitted.select(
        "model_key", "rows", ((F.col("score_min") < 0) & (F.col("score_max") > 0)).alias("spans_zero")
    )


@query
def stored_forest(spark, data_dir):
    """Scores of a forest that was saved and loaded again, per access point, and how many changed."""
    path = new_path(spark, "forest")
    base = _base(spark, data_dir)
    forest = _forest(spark, data_dir, base)
    forest.save(path)
    before = forest.score(base, into="before").select("frame_id", "bssid", "before")
    after = Forest.load(spark, path).score(base, into="after").select("frame_id", "after")
    changed = F.count(F.when(~F.col("before").eqNullSafe(F.col("after")), 1))
    return before.join(after, "frame_id").groupBy("bssid").agg(
        F.count("*").alias("rows"), changed.alias("changed")
    )


@query
def model_evidence(spark, data_dir):
    """The model rule on planted scores: below, exactly at and above the threshold, and missing."""
    planted = (
        F.when(F.col("frame_id") % 5 == 0, -0.3).when(F.col("frame_id") % 5 == 1, -0.12)
        .when(F.col("frame_id") % 5 == 2, 0.1)
    )
    rows = sequence_features(beacons(spark, data_dir), 2, _profiles(spark, data_dir))
    judged = evidence(rows.withColumn("model_score", planted))
    return judged.select("frame_id", "ev_model")


@query
def model_alerts(spark, data_dir):
    base, known = sequence_features(_baseline(spark, data_dir)), _profiles(spark, data_dir)
    forest = fit_per_ap(base, known)
    return _alert_columns(detect(beacons(spark, data_dir), known, MONITORED, forest))


def _labelled(spark, data_dir, columns: Sequence[str] = ("*",)) -> DataFrame:
    rows = sequence_features(beacons(spark, data_dir)).select(*columns)
    rows = materialise(rows, "features")  # read for both labels
    return supervised.labelled_union(
        rows.filter("label = 0").drop("label"), rows.filter("label = 1").drop("label")
    )


@query
def labelled_union(spark, data_dir):
    rows = _labelled(spark, data_dir)
    return rows.groupBy("bssid", "label").agg(F.count("*").alias("rows"))


@query
def label_distribution(spark, data_dir):
    return supervised.label_distribution(beacons(spark, data_dir))


@query
def rates_from_text(spark, data_dir):
    text = F.when(F.col("frame_id") % 11 == 0, " Unknown ").when(
        F.col("frame_id") % 13 == 0, None
    ).otherwise(F.col("supported_rates"))
    return beacons(spark, data_dir).select("frame_id", supervised.rates_in_text(text).alias("rate_count"))


def _with_gaps(rows: DataFrame) -> DataFrame:
    """Labelled rows in which some features are missing."""
    gap = F.col("frame_id") % 7 == 0
    return rows.withColumn("rssi", F.when(~gap, F.col("rssi"))).withColumn(
        "clock_skew", F.when(~gap, F.col("clock_skew"))
    )


@query
def feature_medians(spark, data_dir):
    rows, features = supervised.training_columns(_with_gaps(_labelled(spark, data_dir)))
    return _rounded(supervised.feature_medians(rows, features), 9, "median")


@query
def median_impute(spark, data_dir):
    rows, _ = supervised.impute_medians(_with_gaps(_labelled(spark, data_dir)))
    return _rounded(rows.select("frame_id", "rssi", "clock_skew", "security_encoded"), 9, "clock_skew")


@query
def stratified_counts(spark, data_dir):
    split = supervised.stratified_split(beacons(spark, data_dir))
    return split.groupBy("label").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("is_test"), 1)).alias("test_rows")
    )


def _guessed(spark, data_dir) -> DataFrame:
    """A fixed rule as prediction, so that metrics can be compared."""
    guess = (security_code(F.col("security")) < 3) | (F.col("rate_count") < 8)
    return beacons(spark, data_dir).withColumn("prediction", guess.cast("int"))


@query
def confusion_counts(spark, data_dir):
    return supervised.confusion_counts(_guessed(spark, data_dir))


@query
def classification_report(spark, data_dir):
    rows = supervised.classification_report(_guessed(spark, data_dir))
    return _rounded(rows, 9, "accuracy", "precision", "recall", "f1").withColumn(
        "support", F.col("support").cast("bigint")
    )


@query
def training_refused(spark, data_dir):
    """What training says of rows of one class, and of too few rows."""
    rows, said = beacons(spark, data_dir), []
    few = rows.filter("frame_id < 19")
    for name, part in (("one class", rows.filter("label = 0")), ("few rows", few)):
        try:
            supervised.check_trainable(part)
        except ValueError as error:
            said.append(part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("given"), "rows", F.lit(str(error)).alias("said")))
    return said[0].union(said[1])


def _trained(spark, data_dir):
    # Only what training reads is stored: names tell header rows, security is encoded anew.
    columns = dict.fromkeys(["sensor_id", "frame_id", "ssid", "label", "security", *SUPERVISED_FEATURES])
    return supervised.train_baseline(_labelled(spark, data_dir, [*columns]))


@query
def forest_classifier(spark, data_dir):
    """Sizes of both parts, and whether the confusion cells add up to the test part."""
    cells = sum(map(F.col, ["true_negatives", "false_positives", "false_negatives", "true_positives"]))
    return _trained(spark, data_dir)[2].select(
        "model_type", "n_estimators", "max_depth", "train_rows", "test_rows", cells.alias("cells"),
        F.size("limitations").alias("limitations"),
    )


@query
def feature_importance(spark, data_dir):
    model, features, _ = _trained(spark, data_dir)
    ranked = supervised.feature_importance(spark, model, features)
    return ranked.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"))


# --- Chart tables


@query
def skew_distribution(spark, data_dir):
    rows = analysis.skew_distribution(sequence_features(_baseline(spark, data_dir)))
    return _rounded(rows, 9, *analysis.QUARTILES, "whisker_low", "whisker_high")


@query
def ap_labels(spark, data_dir):
    return analysis.network_labels(beacons(spark, data_dir))


@query
def ie_baseline(spark, data_dir):
    return analysis.ie_baseline(_profiles(spark, data_dir))


# --- Privacy

SSID_MAP = {"LAB_AP_0": "NET_", "LAB_AP_01": "HOME", "AP": "ap"}
PATH_MAP = {"/home/user3/x": "/srv/x"}


def _notes(spark, data_dir) -> DataFrame:
    mac = F.upper(F.replace("bssid", F.lit(":"), F.lit("-")))
    text = F.concat(
        F.lit("AP "), F.col("ssid"), F.lit(" at "), mac, F.lit(" log /home/user"),
        (F.col("frame_id") % 7).cast("string"), F.lit("/x ff:ff:ff:ff:ff:ff"),
    )
    return beacons(spark, data_dir).select("frame_id", text.alias("text"))


@query
def scrub_text(spark, data_dir):
    return privacy.scrub_text(_notes(spark, data_dir), ["text"], SSID_MAP, PATH_MAP)


@query
def scrub_many_names(spark, data_dir):
    """A mapping of 20,000 names: the longest first, and a name made by one entry is an entry itself."""
    names = {f"NET_{i:05d}_GONE": f"gone {i}" for i in range(19_988)}
    names |= {f"LAB_AP_{i:02d}": f"NET_{i:03d}" for i in range(9)} | {"NET_003": "three", "AP": "ap", "NET_0": "net "}
    return privacy.scrub_text(_notes(spark, data_dir), ["text"], names)


@query
def scrub_documents(spark, data_dir):
    """Whole documents with an address and a home path appended, scrubbed."""
    digest = F.md5(F.col("doc_id").cast("string"))
    mac = F.concat_ws("-", *[F.substring(digest, 1 + 2 * i, 2) for i in range(6)])
    rows = spark.read.parquet(f"{data_dir.rstrip('/')}/documents.parquet").select(
        "doc_id", F.concat("text", F.lit(" seen by "), mac, F.lit(" in /home/ann/notes")).alias("text")
    )
    scrubbed = privacy.scrub_text(rows, ["text"])
    return scrubbed.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("characters"))


@query
def scrub_beacons(spark, data_dir):
    rows = privacy.scrub_beacons(beacons(spark, data_dir), SSID_MAP)
    return rows.groupBy("bssid", "ssid").agg(F.count("*").alias("rows"))


@query
def mac_audit(spark, data_dir):
    return privacy.mac_audit(_notes(spark, data_dir), "text", SSID_MAP, PATH_MAP)


@query
def changed_rows(spark, data_dir):
    rows = privacy.changed_rows(_notes(spark, data_dir), "frame_id", "text", {}, PATH_MAP)
    return rows.agg(F.count("*").alias("rows"), F.sum(F.length("scrubbed")).alias("characters"))


@query
def scrubbable_files(spark, data_dir):
    """Which page sources hold text, by path and content."""
    kind = F.element_at(
        F.array(*map(F.lit, ["a.html", ".git/config", "x/b.PNG", "venv/c.py", ".zip", "d"])),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    broken = F.when(F.col("page_id") % 10 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    files = spark.read.parquet(f"{data_dir.rstrip('/')}/pages.parquet").select(
        "page_id", F.concat(F.lit("site/"), kind).alias("path"),
        F.concat(F.encode("html", "UTF-8"), broken).alias("content"),
    )
    return privacy.scrubbable(files).select("page_id", "path")


