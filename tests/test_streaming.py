import numpy as np
import pandas as pd
import pytest
from places import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.operators.features import sequence_features
from beaconlake.operators.inventory import scan_windows, stream_scan_windows
from beaconlake.operators.iforest import Forest, fit_per_ap
from beaconlake.plans.capture import beacons, frames
from beaconlake.plans.detection import baseline_profiles, detect
from beaconlake.schema import BEACON_SCHEMA
from beaconlake.sources.tables import append_table
from beaconlake.streaming import detection as live


@pytest.fixture(scope="module")
def table(spark):
    return beacons(spark, DATA)


@pytest.fixture(scope="module")
def profiles(table):
    return baseline_profiles(table.filter("is_baseline"))


def feed(rows, path, parts):
    """Write rows as files in arrival order, so that each makes one micro-batch."""
    low, high = rows.agg(F.min("capture_us"), F.max("capture_us")).first()
    step = (high - low) // parts + 1
    for i in range(parts):
        part = rows.filter((F.col("capture_us") - low).between(i * step, (i + 1) * step - 1))
        append_table(part.select(*BEACON_SCHEMA.fieldNames()).coalesce(1), path)


ALERT = ["alert_number", "frame_id", "streak", "threat_score_100", "reasons"]


def test_stream_equals_batch(spark, table, profiles, path):
    forest = fit_per_ap(sequence_features(table.filter("is_baseline")), profiles)
    feed(table, path("in"), 3)
    totals = live.SessionTotals(report=lambda line: None)
    spark.streams.addListener(totals)
    source = live.read_beacons(spark, path("in"), maxFilesPerTrigger=1)
    query = live.run_detection(
        live.stream_detection(source, profiles, forest), path("alerts"), path("state"), path("log"),
        path("late"),
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = spark.read.parquet(path("alerts")).select(*ALERT)
    want = detect(table, profiles, forest=forest).select(*ALERT)
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    headlines = spark.read.text(path("log")).filter("value LIKE '[%ALERT #%'").count()
    assert headlines == want.count()
    assert spark.read.parquet(path("late")).count() == 0
    spark.streams.removeListener(totals)


def test_models_in_the_state_survive_a_restart(spark, table, profiles, path):
    """Two sensors hear the access points; models are seeded before the first batch and kept after it."""
    forest = fit_per_ap(sequence_features(table.filter("is_baseline")), profiles)
    forest.save(path("forest"))
    profiles.write.parquet(path("profiles"))
    other = table.withColumns({"sensor_id": F.lit("other"), "frame_id": F.col("frame_id") + 1_000_000})
    both = table.unionByName(other.filter("frame_id % 3 > 0"))
    want = detect(both, profiles, forest=forest).select(*ALERT)
    apart = spark.newSession()
    for name, value in live.SEEDED_STATE.items():
        apart.conf.set(name, value)
    middle = both.agg(F.expr("(min(capture_us) + max(capture_us)) div 2")).first()[0]
    for number, part in enumerate((both.filter(F.col("capture_us") <= middle), both.filter(F.col("capture_us") > middle))):
        feed(part, path("in"), 2)
        detected = live.stream_detection(
            live.read_beacons(apart, path("in"), maxFilesPerTrigger=1), apart.read.parquet(path("profiles")),
            Forest.load(apart, path("forest")), broadcast_nodes=0,
        )
        query = live.run_detection(detected, path("alerts"), path("state"))
        query.awaitTermination()
        assert len(query.recentProgress) >= 2, number
    got = spark.read.parquet(path("alerts")).select(*ALERT)
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


KNOWN = {
    "p_known": True, "p_ie_count": 18.0, "p_rate_count": 12.0, "p_security": "WPA2/WPA3", "p_clock_skew_mean": 0.0,
    "p_clock_skew_std": 1e-5,
}


JOINED_SCHEMA = T.StructType(
    [
        *BEACON_SCHEMA.fields, T.StructField("p_known", T.BooleanType()),
        *[T.StructField(c, T.StringType() if c == "p_security" else T.DoubleType()) for c in list(KNOWN)[1:]],
    ]
)


def held(rows, chunk):
    """The rows as a batch gives them, some at a time."""
    return live._held((rows.iloc[at : at + chunk] for at in range(0, len(rows), chunk)), JOINED_SCHEMA)


def test_a_long_batch_is_taken_in_steps(table, monkeypatch):
    rows = table.select(*BEACON_SCHEMA.fieldNames()).filter("bssid = '02:10:00:00:00:00'").toPandas().assign(**KNOWN)
    rows.loc[rows.index % 9 == 0, ["seq_num", "beacon_timestamp", "security", "p_known"]] = None

    def run(chunk):
        past = dict(live.EMPTY_PAST)
        return pd.concat(live._advance(held(rows.sample(frac=1, random_state=3), chunk), past, 2, True, None, ())), past

    whole, end = run(10_000)
    monkeypatch.setattr(live, "STEP_ROWS", 7)
    steps, last = run(11)
    assert len(whole) == len(rows) and end == last
    assert whole["is_alert"].sum() == steps["is_alert"].sum()
    for c in whole.columns:
        pd.testing.assert_series_equal(
            whole[c].reset_index(drop=True), steps[c].reset_index(drop=True), check_dtype=False
        )


def test_a_hot_key_fits_a_worker():
    """A million frames of one key in one batch, held in a small part of what they need as a frame."""
    n = 1_000_000
    one = {
        "frame_id": np.arange(n), "sensor_id": "s", "session_id": "default", "capture_us": np.arange(n) * 100_000, "ssid": "A",
        "bssid": "02:10:00:00:00:01", "rssi": -50, "channel": 6, "seq_num": np.arange(n) % 4096, "beacon_timestamp": np.arange(n) * 100_000,
        "beacon_interval": 100, "capabilities": 17, "supported_rates": "1.0,2.0", "rate_count": 12, "security": "Open", "ie_count": 18,
    }
    chunks = (pd.DataFrame({c: v[at : at + 10_000] if isinstance(v, np.ndarray) else v for c, v in one.items()} | KNOWN, index=range(10_000))
              for at in range(0, n, 10_000))
    table = live._held(chunks, JOINED_SCHEMA)
    assert table.nbytes < 150 * n
    past, rows, largest = dict(live.EMPTY_PAST), 0, 0
    for made in live._advance(table, past, 2, True, None, ()):
        rows, largest = rows + len(made), max(largest, len(made))
    assert rows == n and largest == live.STEP_ROWS and past["last_id"] == n - 1 and len(past["seqs"]) == 4096


def test_restart_continues_and_late_frames_leave_state_alone(spark, make_beacons, profiles, path):
    ap = "02:10:00:00:00:00"
    first = [{"frame_id": i, "bssid": ap, "ie_count": 4, "capture_us": 10_000_000 + i * 100_000} for i in range(3)]
    late = [{"frame_id": 50, "bssid": ap, "ie_count": 18, "capture_us": 9_000_000}]
    later = [{"frame_id": 60, "bssid": ap, "ie_count": 4, "capture_us": 10_300_000}]

    def go(rows):
        append_table(make_beacons(rows).coalesce(1), path("in"))
        source = live.read_beacons(spark, path("in"))
        query = live.run_detection(
            live.stream_detection(source, profiles), path("alerts"), path("state"), late_path=path("late")
        )
        query.awaitTermination()
        return spark.read.parquet(path("alerts")), spark.read.parquet(path("late"))

    alerts, gone = go(first)
    assert [r["frame_id"] for r in alerts.collect()] == [1] and gone.count() == 0
    alerts, gone = go(late)
    assert alerts.count() == 1 and [r["frame_id"] for r in gone.collect()] == [50]
    alerts, _ = go(later + [{"frame_id": 70, "bssid": ap, "ie_count": 4, "capture_us": 20_100_000}])
    got = {r["frame_id"]: (r["streak"], r["alert_number"]) for r in alerts.collect()}
    assert got == {1: (2, 1), 70: (5, 2)}


def test_collected_baseline_equals_batch_features(spark, path):
    raw = frames(spark, DATA)
    folder = raw.inputFiles()[0].rsplit("/", 1)[0]
    live.collect_baseline(live.read_frames(spark, folder), path("table"), path("state")).awaitTermination()
    from beaconlake.operators.decode import collector_observations

    names = ["frame_id", "seq_jump", "seq_anomaly_score", "is_seq_duplicate", "clock_skew", "valid_skew",
             "security_encoded", "inter_beacon_ms", "seq_dup_delta", "ssid", "supported_rates"]
    got = spark.read.parquet(path("table"))
    want = sequence_features(collector_observations(raw))
    assert got.count() == want.count() and got.filter("label <> 0").count() == 0
    assert got.select(*names).exceptAll(want.select(*names)).count() == 0
    pair = got.join(want.select("frame_id", F.col("timing_variance").alias("v")), "frame_id")
    assert pair.agg(F.max(F.abs(F.col("timing_variance") - F.col("v")))).first()[0] < 1e-3


def test_scan_windows_come_out_after_the_watermark(spark, table, path):
    feed(table, path("in"), 4)
    source = live.read_beacons(spark, path("in"), maxFilesPerTrigger=1)
    query = (
        stream_scan_windows(source, 2).writeStream.format("parquet").option("path", path("out"))
        .option("checkpointLocation", path("state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(path("out"))
    assert got.count() > 0
    assert got.exceptAll(scan_windows(table, 2).select(*got.columns)).count() == 0


def test_a_large_forest_is_not_broadcast(spark, table, profiles, path):
    """Above the limit the models are the stream's initial state, at or below it they are broadcast."""
    forest = fit_per_ap(sequence_features(table.filter("is_baseline")), profiles)
    feed(table, path("in"), 1)
    source = live.read_beacons(spark, path("in"))
    plans = [
        live.stream_detection(source, profiles, forest, limit)._jdf.queryExecution().analyzed().toString()
        for limit in (forest.node_count() - 1, forest.node_count())
    ]
    assert "TransformWithState" in plans[0] and "TransformWithState" not in plans[1]


def test_missing_values_are_like_in_batch(spark, table, profiles, path):
    """Nulls in every nullable input of the rules, over several micro-batches."""
    holes = {
        "seq_num": 11, "beacon_timestamp": 13, "security": 7, "ie_count": 17, "rate_count": 19, "rssi": 23, "ssid": 29,
    }
    rows = table
    for name, every in holes.items():
        rows = rows.withColumn(name, F.when(F.col("frame_id") % every != 0, F.col(name)))
    nameless = profiles.withColumn("security", F.when(F.col("bssid") > "02:10:00:00:00:05", F.col("security")))
    feed(rows, path("in"), 4)
    source = live.read_beacons(spark, path("in"), maxFilesPerTrigger=1)
    detected = live.stream_detection(source, nameless)
    query = detected.writeStream.format("parquet").option("path", path("out")).option(
        "checkpointLocation", path("state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    flags = ["ev_duplicate_sequence", "ev_ie_count", "ev_security", "ev_rate_count", "ev_timing"]
    pick = ["frame_id", "seq_jump", "seq_anomaly_score", "is_seq_duplicate", "clock_skew", "valid_skew", *flags, "suspicious"]
    got = spark.read.parquet(path("out")).select(*pick, "streak")
    from beaconlake.operators.alerts import suspicion_streaks
    from beaconlake.plans.detection import score_frames

    want = suspicion_streaks(score_frames(rows, nameless)).select(*pick, "streak")
    assert got.count() == want.count() == table.count()
    assert got.exceptAll(want).count() == 0


def test_alert_numbers_come_from_the_ledger(spark, table, profiles, path):
    feed(table, path("in"), 4)
    source = live.read_beacons(spark, path("in"), maxFilesPerTrigger=1)
    query = live.run_detection(live.stream_detection(source, profiles), path("alerts"), path("state"))
    query.awaitTermination()
    numbers = sorted(r[0] for r in spark.read.parquet(path("alerts")).select("alert_number").collect())
    assert numbers == list(range(1, len(numbers) + 1))
    assert spark.read.parquet(path("state") + "-ledger").agg(F.max("alerts")).first()[0] == len(numbers)


def test_a_stored_table_arrives_in_order(spark, table, profiles, path):
    """In several batches no frame is late, whatever files the table has."""
    stored = table.repartition(5, "frame_id")
    live.arrive_in_order(stored, path("in"), file_rows=stored.count() // 4)
    source = live.read_beacons(spark, path("in"), maxFilesPerTrigger=1)
    query = live.run_detection(live.stream_detection(source, profiles), path("alerts"), path("state"), late_path=path("late"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    assert spark.read.parquet(path("late")).count() == 0
    got, want = spark.read.parquet(path("alerts")).select(*ALERT), detect(table, profiles).select(*ALERT)
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_batch_of_one_key_fits_a_worker():
    """At some 500 bytes a held beacon and 18 a stored one, a whole batch of one key stays below 2 GB."""
    assert int(live.BATCH_LIMIT["maxBytesPerTrigger"]) / 18 * 500 < 2e9
    assert live.STEP_ROWS <= 1 << 14
