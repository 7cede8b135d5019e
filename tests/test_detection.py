"""Rules, streaks, cooldown and alerts."""

import random

import numpy as np
import pytest
from places import AP
from pyspark.sql import functions as F

from beaconlake.operators import alerts as A
from beaconlake.operators.rules import evidence, with_reasons

FEATURE = {
    "frame_id": 1, "sensor_id": "s", "capture_us": 0, "ssid": "ATTIC", "bssid": AP, "rssi": -63,
    "channel": 11, "seq_num": 2040, "seq_jump": 1, "clock_skew": 0.00002, "valid_skew": 0,
    "security": "WPA2/WPA3", "ie_count": 14, "rate_count": 8, "is_seq_duplicate": 0,
    "inter_beacon_ms": 102.4, "model_score": 0.07,
}
FEATURE_SCHEMA = (
    "frame_id long, sensor_id string, capture_us long, ssid string, bssid string, rssi int, "
    "channel int, seq_num int, seq_jump int, clock_skew double, valid_skew int, security string, "
    "ie_count int, rate_count int, is_seq_duplicate int, inter_beacon_ms double, model_score double"
)
TIMING = {"valid_skew": 1, "clock_skew": 0.002}

# overrides, suspicious, reasons, score
CASES = [
    ({}, 0, 0, 0.0),
    ({"bssid": "02:99:00:00:00:99"}, 0, 0, 0.0),
    ({"bssid": "02:99:00:00:00:99", "is_seq_duplicate": 1, "security": "Open"}, 0, 0, 0.0),
    ({"is_seq_duplicate": 1}, 1, 1, 0.9),
    ({"ie_count": 11}, 1, 1, 0.7),
    ({"ie_count": 17}, 1, 1, 0.7),
    ({"ie_count": 12}, 0, 0, 0.0),
    ({"security": "Open"}, 1, 1, 0.6),
    ({"rate_count": 5}, 0, 1, 0.3),
    ({"rate_count": 6}, 0, 0, 0.0),
    (TIMING, 0, 1, 0.35),
    ({"valid_skew": 0, "clock_skew": 0.002}, 0, 0, 0.0),
    ({"valid_skew": 1, "clock_skew": 0.0005}, 0, 0, 0.0),
    ({"valid_skew": 1, "model_score": -0.2}, 0, 1, 0.25),
    ({"valid_skew": 0, "model_score": -0.2}, 0, 0, 0.0),
    ({"valid_skew": 1, "model_score": -0.12}, 0, 0, 0.0),
    ({**TIMING, "rate_count": 4, "model_score": -0.2}, 1, 3, 0.9),
    ({**TIMING, "rate_count": 4}, 0, 2, 0.65),
    ({**TIMING, "is_seq_duplicate": 1, "ie_count": 4, "security": "WEP", "rate_count": 1}, 1, 5, 1.0),
]


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(
        [("ATTIC", AP, 14, 8, "WPA2/WPA3", 0.00002, 0.00004)],
        "ssid string, bssid string, ie_count int, rate_count int, security string, "
        "clock_skew_mean double, clock_skew_std double",
    )


def test_rule_table(spark, profiles):
    rows = [{**FEATURE, **case[0], "frame_id": i} for i, case in enumerate(CASES)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], FEATURE_SCHEMA)
    got = {r["frame_id"]: r for r in with_reasons(evidence(frame, profiles)).collect()}
    for i, (case, suspicious, reasons, score) in enumerate(CASES):
        found = got[i]
        assert (found["suspicious"], len(found["reasons"]), found["threat_score"]) == (
            suspicious, reasons, score,
        ), case


def test_missing_model_column_and_reason_texts(spark, profiles):
    row = {**FEATURE, **TIMING, "ie_count": 4, "security": "WEP", "is_seq_duplicate": 1, "rate_count": 4}
    frame = spark.createDataFrame([tuple(row.values())], FEATURE_SCHEMA).drop("model_score")
    reasons = with_reasons(evidence(frame, profiles)).first()["reasons"]
    assert [r.split(":")[0] for r in reasons] == [
        "Duplicate sequence activity", "Beacon IE count deviation", "Advertised security change",
        "Supported-rate deviation", "Timing deviation",
    ]
    assert "(Δ=10)" in reasons[1] and "0.002000" in reasons[4] and "(49.5σ)" in reasons[4]


def test_profile_without_spread_gives_no_timing_evidence(spark, profiles):
    frame = spark.createDataFrame([tuple({**FEATURE, **TIMING}.values())], FEATURE_SCHEMA)
    for std in (0.0, None):
        flat = profiles.withColumn("clock_skew_std", F.lit(std).cast("double"))
        assert with_reasons(evidence(frame, flat)).first()["reasons"] == []


def scored(spark, rows, sliced):
    """Rows of ``bssid, seconds, suspicious`` with slices of ten seconds or none."""
    data = [
        (i, "s", bssid, round(t * 1e6), flag, int(t // 10) if sliced else None)
        for i, (bssid, t, flag) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "frame_id long, sensor_id string, bssid string, capture_us long, suspicious int, slice long"
    )


def reference_alerts(rows):
    streak, last, streaks, alerts = {}, {}, {}, []
    for i, (bssid, t, flag) in sorted(enumerate(rows), key=lambda p: (p[1][1], p[0])):
        streak[bssid] = streak.get(bssid, 0) + 1 if flag else 0
        streaks[i] = streak[bssid]
        us = round(t * 1e6)
        if streak[bssid] >= 2 and (bssid not in last or us - last[bssid] >= 10_000_000):
            last[bssid] = us
            alerts.append(i)
    return streaks, sorted(alerts)


@pytest.mark.parametrize("sliced", [False, True])
@pytest.mark.parametrize("rate", [0.5, 0.9, 1.0])
def test_streak_and_cooldown_match_one_by_one(spark, sliced, rate):
    draw = random.Random(int(rate * 10))
    rows, clock = [], 0.0
    for _ in range(700):
        clock += draw.choice([0.1, 0.1, 1.0, 3.3, 10.0, 25.0])
        rows.append((draw.choice(["x", "x", "x", "y"]), clock, int(draw.random() < rate)))
    streaks, alerts = reference_alerts(rows)
    got = A.suspicion_streaks(scored(spark, rows, sliced))
    assert {r["frame_id"]: r["streak"] for r in got.collect()} == streaks
    kept = A.cool_down(got.filter("streak >= 2"))
    assert sorted(r["frame_id"] for r in kept.collect()) == alerts


def test_cooldown_restarts_only_at_emitted_alerts(spark):
    rows = [("x", t, 1) for t in (0, 1, 5, 10, 10.9, 11, 20.9, 21)]
    got = A.suspicion_streaks(scored(spark, rows, False))
    kept = A.cool_down(got.filter("streak >= 2"))
    assert sorted(r["capture_us"] / 1e6 for r in kept.collect()) == [1, 11, 21]


def test_step_functions_compose_in_any_order():
    draw = random.Random(8)
    for _ in range(200):
        clock, times = 0, []
        for _ in range(draw.randint(3, 60)):
            clock += draw.choice([1, 1, 2, 7, 9, 10, 11, 40])
            times.append(clock)
        times = np.array(times) * 1_000_000
        cuts = sorted({0, len(times), *(draw.randrange(1, len(times)) for _ in range(4))})
        parts = [A.slice_exits(times[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(parts) > 1:
            at = draw.randrange(len(parts) - 1)
            parts[at : at + 2] = [parts[at].then(parts[at + 1])]
        # Steps are few: no more than the candidates of a cooldown after the first one, and one more.
        assert len(parts[0].upto) <= np.searchsorted(times, times[0] + 10_000_000) + 1
        for last in range(int(times[0]) - 12_000_000, int(times[0]), 500_000):
            kept = A.emitted(times, last)
            want = times[kept[-1]] if len(kept) else last
            assert parts[0].after(np.array([last]))[0] == want


def test_cooldown_of_a_key_with_thousands_of_slices(spark):
    draw = random.Random(9)
    rows, clock = [], 0.0
    for _ in range(25_000):
        clock += draw.choice([0.5, 1.0, 2.0, 9.0])
        rows.append(("hot" if draw.random() < 0.9 else "other", clock, 1))
    streaks = scored(spark, rows, False).withColumn("slice", F.expr("CAST(capture_us div 7000000 AS BIGINT)"))
    streaks = streaks.withColumn("streak", F.lit(2))
    assert streaks.filter("bssid = 'hot'").select("slice").distinct().count() > 7_000
    got = sorted(r["frame_id"] for r in A.cool_down(streaks).collect())
    # Here every frame is a candidate, also the first of its key.
    want, last = [], {}
    for i, (bssid, t, _) in enumerate(rows):
        us = round(t * 1e6)
        if bssid not in last or us - last[bssid] >= 10_000_000:
            last[bssid] = us
            want.append(i)
    assert got == want and len(want) > 1_000


def test_emitted_positions():
    times = np.array([0, 4, 9, 10, 12, 30]) * 1_000_000
    assert A.emitted(times, None).tolist() == [0, 3, 5]
    assert A.emitted(times, -6_000_000).tolist() == [1, 5]
    assert A.emitted(times, 25_000_000).tolist() == []
