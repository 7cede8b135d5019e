import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.operators.features import sequence_features
from beaconlake.operators.slicing import hot_slices, with_slices


def feature_rows(beacons, **options):
    return sequence_features(beacons, **options).orderBy("sensor_id", "bssid", "capture_us", "frame_id").collect()


@pytest.mark.parametrize(
    "previous, current, jump",
    [(4095, 0, 1), (4000, 10, 106), (7, 7, 0), (5, 15, 10), (10, 9, 4095), (0, 4095, 4095)],
)
def test_sequence_wrap(make_beacons, previous, current, jump):
    rows = feature_rows(make_beacons([{"seq_num": previous}, {"seq_num": current}]))
    assert [r["seq_jump"] for r in rows] == [0, jump]


@pytest.mark.parametrize(
    "jump, three, two", [(10, 0, 0), (11, 0.3, 0), (100, 0.3, 0), (101, 0.101, 0.101), (1500, 1, 1)]
)
def test_anomaly_tiers(make_beacons, jump, three, two):
    rows = make_beacons([{"seq_num": 0}, {"seq_num": jump}])
    assert feature_rows(rows, tiers=3)[1]["seq_anomaly_score"] == three
    assert feature_rows(rows, tiers=2)[1]["seq_anomaly_score"] == two


@pytest.mark.parametrize("gap, valid", [(49_999, 0), (50_000, 1), (250_000, 1), (250_001, 0)])
def test_skew_gate(make_beacons, gap, valid):
    rows = make_beacons(
        [{"capture_us": 1000}, {"capture_us": 1000 + gap, "beacon_timestamp": gap + 5}]
    )
    second = feature_rows(rows)[1]
    assert second["valid_skew"] == valid
    assert second["clock_skew"] == (round(5 / gap, 8) if valid else 0.0)


@pytest.mark.parametrize("gap, duplicate", [(1_000, 0), (1_001, 1), (499_999, 1), (500_000, 0)])
def test_duplicate_gate(make_beacons, gap, duplicate):
    rows = make_beacons([{"capture_us": 0}, {"capture_us": 10, "seq_num": 7}, {"capture_us": gap}])
    last = feature_rows(rows)[2]
    assert last["is_seq_duplicate"] == duplicate
    assert last["seq_dup_delta"] == round(gap / 1e6, 6)


def test_timing_variance_needs_five_of_twenty(make_beacons):
    times = np.cumsum([100_000 + (i * 37) % 91 for i in range(30)]).tolist()
    rows = feature_rows(make_beacons([{"capture_us": int(t)} for t in times]))
    gaps = np.diff(times) / 1000.0
    assert rows[0]["inter_beacon_ms"] == 0.0
    for i, row in enumerate(rows):
        recent = gaps[max(0, i - 20) : i]
        want = round(float(np.var(recent)), 6) if len(recent) >= 5 else 0.0
        assert row["timing_variance"] == pytest.approx(want, abs=2e-6)


def test_frames_at_the_same_time(make_beacons):
    rows = feature_rows(make_beacons([{"capture_us": 5}, {"capture_us": 5, "seq_num": 101}]))
    assert (rows[1]["clock_skew"], rows[1]["valid_skew"], rows[1]["seq_jump"]) == (0.0, 0, 1)


def brute_force(rows):
    """The sequential features one frame at a time."""
    last, seen, gaps, out = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["capture_us"], r["frame_id"])):
        key = (r["sensor_id"], r["bssid"])
        jump = skew = gap_ms = 0
        if key in last:
            seq, us, tsf = last[key]
            jump = (r["seq_num"] - seq) % 4096
            gap = r["capture_us"] - us
            gap_ms = gap / 1000.0
            gaps.setdefault(key, []).append(gap_ms)
            if 50_000 <= gap <= 250_000:
                skew = round((r["beacon_timestamp"] - tsf - gap) / gap, 8)
        recent = gaps.get(key, [])[-20:]
        before = seen.get((*key, r["seq_num"]))
        delta = 0 if before is None else r["capture_us"] - before
        seen[(*key, r["seq_num"])] = r["capture_us"]
        last[key] = (r["seq_num"], r["capture_us"], r["beacon_timestamp"])
        variance = float(np.var(recent)) if len(recent) >= 5 else 0.0
        out[(r["sensor_id"], r["frame_id"])] = (
            jump, skew, gap_ms, variance, int(1_000 < delta < 500_000), delta / 1e6
        )
    return out


@pytest.mark.parametrize("rows_per_slice, bucket_us", [(1, 100_000), (5, 1_000_000), (40, 300_000)])
def test_hot_keys_in_slices_match_frame_by_frame(make_beacons, rows_per_slice, bucket_us):
    draw = random.Random(rows_per_slice)
    rows, clock = [], 0
    for i in range(600):
        # Long pauses leave slices with very few rows.
        clock += draw.choice([900, 20_000, 100_000, 100_000, 240_000, 5_000_000])
        rows.append(
            {
                "frame_id": i, "capture_us": clock, "seq_num": draw.randrange(12),
                "beacon_timestamp": clock + draw.randrange(50),
                "sensor_id": "a" if draw.random() < 0.8 else "b",
                "bssid": draw.choice(["02:00:00:00:00:0%d" % k for k in (1, 1, 1, 2, 3)]),
            }
        )
    beacons = make_beacons(rows)
    assert hot_slices(beacons, rows_per_slice, bucket_us).count() > 0
    got = sequence_features(beacons, rows_per_slice=rows_per_slice, bucket_us=bucket_us).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    for r in got:
        jump, skew, gap_ms, variance, duplicate, delta = want[(r["sensor_id"], r["frame_id"])]
        assert (r["seq_jump"], r["is_seq_duplicate"]) == (jump, duplicate)
        assert r["clock_skew"] == pytest.approx(skew, abs=1.1e-8)
        assert r["inter_beacon_ms"] == pytest.approx(gap_ms)
        assert r["seq_dup_delta"] == pytest.approx(delta, abs=1e-6)
        assert r["timing_variance"] == pytest.approx(variance, abs=1e-4)


def test_later_windows_need_no_further_exchange(make_beacons):
    from beaconlake.operators.alerts import suspicion_streaks

    rows = sequence_features(make_beacons([{}, {}])).withColumn("suspicious", F.lit(1))
    plan = suspicion_streaks(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sensor_id") == 1


def test_a_burst_is_cut_by_its_counts(make_beacons):
    """20,000 frames, nearly all of them within a second: no slice holds much more than its share."""
    rows = [{"frame_id": i, "capture_us": 50 * i, "seq_num": i % 4096} for i in range(18_000)]
    rows += [{"frame_id": 20_000 + i, "capture_us": 10**9 + 10**6 * i} for i in range(2_000)]
    sliced, any_hot = with_slices(make_beacons(rows), rows_per_slice=100, bucket_us=1_000)
    sizes = [r["count"] for r in sliced.groupBy("slice").count().collect()]
    assert any_hot and sum(sizes) == 20_000 and max(sizes) <= 120


def test_slices_survive_the_profile_join(spark, make_beacons):
    """With a sort-merge join the streak windows still stand on an exchange that has the slice."""
    from beaconlake.operators.alerts import suspicion_streaks
    from beaconlake.plans.detection import score_frames

    beacons = make_beacons([{"capture_us": 100_000 * i} for i in range(40)])
    profiles = spark.createDataFrame([("02:10:00:00:00:01", 20, "WPA2/WPA3")], "bssid string, ie_count int, security string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = suspicion_streaks(score_frames(beacons, profiles, rows_per_slice=10, bucket_us=500_000))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [" in line and "_clear_at" in line)
    exchange = next(line for line in lines[window:] if "Exchange hashpartitioning" in line)
    assert "slice" in exchange


def test_sliced_rows_stay_in_many_tasks(make_beacons, monkeypatch):
    """Adaptive execution does not join the tasks of slices, however well their rows compress."""
    from beaconlake.operators import slicing

    monkeypatch.setattr(slicing, "ROWS_PER_TASK", 10)
    rows = make_beacons([{"frame_id": i} for i in range(600)])
    made = sequence_features(rows, rows_per_slice=20, bucket_us=1_000)
    assert made.select("frame_id", "timing_variance").rdd.getNumPartitions() == 60
    assert made.count() == 600


def test_small_slices_look_back_over_several(make_beacons):
    """Slices of uneven sizes, most of fewer rows than a row looks back to."""
    rows = make_beacons([{"frame_id": i, "capture_us": i * 100_000 + i * i % 7_001, "seq_num": i * 7 % 90} for i in range(150)])
    names = ["frame_id", "seq_jump", "inter_beacon_ms", "is_seq_duplicate", "seq_dup_delta", "clock_skew"]
    whole = sequence_features(rows).select(*names, F.round("timing_variance", 3).alias("v"))
    for size in (1, 3, 17):
        cut = sequence_features(rows, rows_per_slice=size, bucket_us=250_000).select(*names, F.round("timing_variance", 3).alias("v"))
        assert cut.exceptAll(whole).count() == 0 and cut.count() == 150
