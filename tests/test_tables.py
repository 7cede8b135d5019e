"""Inventory, profiles, deviations, analysis and import."""

import math
import random
import statistics

import pytest
from places import AP
from pyspark.sql import functions as F

from beaconlake.operators import analysis, inventory, profiles, ranking
from beaconlake.operators.deviations import profile_deviations
from beaconlake.operators.ranking import bucketed_row_number, quantiles
from beaconlake.sources import tables


@pytest.mark.parametrize("narrow", [100_000, 0])
def test_selection_of_quantiles(spark, monkeypatch, narrow):
    """All values at once, and in rounds of ever finer cells; ties, signs, sizes and missing keys."""
    monkeypatch.setattr(ranking, "NARROW", narrow)
    draw = random.Random(6)
    groups = {
        "tiny": [draw.gauss(0, 1e-9) for _ in range(300)], "close": [0.25 + i * 2**-54 for i in range(200)],
        "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(300)], "one": [7.5],
        "ties": [float(draw.randint(-2, 2)) for _ in range(200)], None: [-0.0, 0.0, 3.0, -5.0], "two": [1.0, 2.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    probs = {"q0": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.9, "q4": 1.0}
    got = {r["k"]: r for r in ranking.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        ordered = sorted(values)
        for name, p in probs.items():
            place = (len(ordered) - 1) * p
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            assert got[k][name] == low + (high - low) * (place - math.floor(place)), (k, name)
    empty = spark.createDataFrame([], "k string, v double")
    assert ranking.quantiles(empty, ["k"], "v", probs).collect() == []


def test_hidden_name_is_revealed_later(make_beacons):
    rows = make_beacons(
        [{"ssid": "<Hidden>", "channel": 6}, {"ssid": "Named", "channel": 0}, {"ssid": "Other", "rssi": 0}]
    )
    row = inventory.network_inventory(rows).first()
    assert (row["ssid"], row["channel"], row["rssi"], row["beacons"]) == ("Named", 6, 0, 3)
    hidden = inventory.network_inventory(make_beacons([{"ssid": "<Hidden>", "channel": 0}])).first()
    assert (hidden["ssid"], hidden["channel"]) == ("<Hidden>", 0)


def test_strongest_first(make_beacons):
    rows = make_beacons([{"bssid": f"02:00:00:00:00:0{i}", "rssi": s} for i, s in enumerate([-80, -40, -60])])
    networks = inventory.strongest_first(inventory.network_inventory(rows))
    assert [r["rssi"] for r in networks.collect()] == [-40, -60, -80]
    assert [r["rssi"] for r in inventory.strongest_first(networks, 1).collect()] == [-40]


@pytest.mark.parametrize("rssi, band", [(0, "none"), (-49, "strong"), (-50, "medium"), (-70, "weak")])
def test_signal_band(make_beacons, rssi, band):
    heard = make_beacons([{"rssi": rssi, "ssid": "n" * 30}])
    rows = inventory.listing(inventory.network_inventory(heard))
    assert (rows.first()["signal_band"], len(rows.first()["ssid"])) == (band, 24)


def test_select_target_ignores_case(make_beacons):
    rows = make_beacons([{}, {"ssid": "Else"}, {"bssid": "02:00:00:00:00:07"}])
    assert inventory.select_target(rows, AP.upper(), "ATTIC").count() == 1
    assert inventory.select_target(rows).count() == 3


def test_channel_restriction(make_beacons):
    rows = make_beacons([{"channel": c} for c in (0, 1, 6, 6, 14, 36, 165)])
    assert inventory.on_channels(rows, 6).count() == 2
    assert inventory.on_channels(rows).count() == 5


def observed(make_beacons, rows):
    """Observations with given jumps, skews and signals."""
    made = make_beacons([{} for _ in rows])
    extra = made.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "frame_id long, seq_jump int, clock_skew double, rssi int, valid_skew int",
    )
    return made.drop("rssi").join(extra, "frame_id")


@pytest.mark.parametrize("n, built", [(9, 0), (10, 1), (11, 1)])
def test_profile_size_limit(make_beacons, n, built):
    rows = observed(make_beacons, [(1, 0.0, -50, 1)] * n)
    assert profiles.build_profiles(rows).count() == built
    assert profiles.skipped_access_points(rows).count() == 1 - built


def test_profile_statistics(make_beacons):
    skews = [0.0, 0.0, 1e-5, 2e-5, 3e-5, 1e-5, 2e-5, 0.0, 1e-5, 2e-5, 1e-5, 5.0]
    rows = observed(
        make_beacons, [(150 if i == 0 else i, s, -50 - i, i % 2) for i, s in enumerate(skews)]
    )
    row = profiles.build_profiles(rows).first()
    kept = skews[:-1]
    assert row["clock_skew_max"] == 3e-5
    assert row["clock_skew_mean"] == pytest.approx(statistics.mean(kept))
    assert row["clock_skew_std"] == pytest.approx(statistics.stdev(kept))
    assert row["seq_jump_mean"] == pytest.approx(6.0)
    assert row["seq_jump_std"] == pytest.approx(statistics.stdev(range(1, 12)))
    assert (row["rssi_min"], row["rssi_max"], row["total_beacons"]) == (-61, -50, 12)
    single = profiles.build_single_ap_profiles(rows).first()
    valid = skews[1::2]
    assert single["clock_skew_mean"] == pytest.approx(statistics.mean(valid))
    assert (single["valid_skew_samples"], single["seq_jump_max"]) == (6, 150)


def test_profile_without_trim_up_to_ten_rows(make_beacons):
    rows = observed(make_beacons, [(1, 9.0 if i == 0 else 0.0, -50, 1) for i in range(10)])
    assert profiles.build_profiles(rows).first()["clock_skew_max"] == 9.0


def test_profile_defaults_and_mode_ties(make_beacons):
    rows = observed(make_beacons, [(500, None, None, 0)] * 10)
    rows = (
        rows.withColumn("ssid", F.lit(None).cast("string"))
        .withColumn("security", F.lit(None).cast("string"))
        .withColumn("channel", F.lit(None).cast("int"))
        .withColumn("ie_count", F.when(F.col("frame_id") % 2 == 0, 9).otherwise(10))
        .withColumn("supported_rates", F.when(F.col("frame_id") % 2 == 0, "b").otherwise("a"))
    )
    row = profiles.build_profiles(rows).first()
    assert (row["ssid"], row["security"], row["channel"]) == ("<Unknown>", "Unknown", 0)
    assert (row["ie_count"], row["supported_rates"]) == (9, "a")
    assert (row["clock_skew_mean"], row["clock_skew_std"], row["rssi_mean"]) == (0, 0, 0)
    assert (row["seq_jump_mean"], row["seq_jump_std"], row["total_beacons"]) == (0, 0, 10)


@pytest.mark.parametrize("n, percent", [(0, 0), (1, 2), (25, 50), (49, 98), (50, 100), (999, 100)])
def test_completion_percent(spark, n, percent):
    got = spark.range(1).select(profiles.completion_percent(F.lit(n)).alias("p")).first()["p"]
    assert got == percent


def test_deviation_edges(spark, make_beacons):
    known = spark.createDataFrame(
        [
            (AP, 14, 8, "WPA2/WPA3", 6, 0.0, 0.0, -58.0, -56.0),
            ("02:00:00:00:00:02", None, 8, "Open", None, None, None, None, None),
        ],
        "bssid string, ie_count int, rate_count int, security string, channel int, "
        "clock_skew_mean double, clock_skew_std double, rssi_min double, rssi_max double",
    )
    rows = make_beacons(
        [{}, {"bssid": "02:00:00:00:00:02"}, {"bssid": "02:00:00:00:00:03"}]
    ).withColumn("clock_skew", F.lit(0.25))
    got = {r["bssid"][-1]: r for r in profile_deviations(rows, known).collect()}
    assert got["1"]["clock_skew_deviation"] == 0.25
    assert got["1"]["rssi_deviation"] == pytest.approx(3.0 / 10.0)
    assert [got["1"][c] for c in ("ie_count_match", "channel_match")] == [1, 1]
    assert (got["2"]["rssi_deviation"], got["2"]["ie_count_match"], got["2"]["security_match"]) == (5.4, 0, 0)
    assert (got["3"]["clock_skew_deviation"], got["3"]["security_match"]) == (0.0, 1)


def test_upsert_replaces_by_access_point(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "bssid string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "bssid string, n int")
    first = tables.store_profile(spark, old)
    got = spark.read.parquet(tables.store_profile(spark, new, first))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert spark.read.parquet(first).count() == 2


def test_labels_follow_first_appearance(make_beacons):
    rows = make_beacons([{"ssid": s} for s in ("z", "a", "z", "m")])
    labels = {r["ssid"]: r["ssid_label"] for r in analysis.network_labels(rows).collect()}
    assert labels == {"z": "LAB_AP_01", "a": "LAB_AP_02", "m": "LAB_AP_03"}
    some = analysis.network_labels(rows).filter("ssid = 'z'")
    shown = {r["ssid"]: r["display_ap"] for r in analysis.label_networks(rows, some).collect()}
    assert (shown["z"], shown["a"]) == ("LAB_AP_01", "LAB_AP_UNKNOWN")
    plain = analysis.label_networks(rows, labels=None, anonymise=False)
    assert {r["display_ap"] for r in plain.collect()} == {"z", "a", "m"}


def test_skew_distribution_falls_back_to_invalid_rows(make_beacons):
    rows = observed(make_beacons, [(1, s, -50, 0) for s in (0.001, 0.002, 0.003, 0.3, None)])
    row = analysis.skew_distribution(rows).first()
    assert (row["observations"], row["median"], row["q4"]) == (3, 0.002, 0.003)
    mixed = observed(make_beacons, [(1, s, -50, int(s > 0.001)) for s in (0.001, 0.002, 0.003)])
    assert analysis.skew_distribution(mixed).first()["observations"] == 2


def test_bucketed_row_number_equals_row_number(spark):
    rows = spark.range(500).selectExpr("id % 3 AS k", "(id * 7919) % 500 AS v")
    got = bucketed_row_number(rows, ["k"], F.expr("v div 20"), ["v"], "r").collect()
    want = {}
    for r in sorted(got, key=lambda r: r["v"]):
        want[r["k"]] = want.get(r["k"], 0) + 1
        assert r["r"] == want[r["k"]]


def test_quantiles_interpolate(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 1, 2, 10)] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: r["q"] for r in quantiles(rows, ["k"], "v", {"q": 0.75}).collect()}
    assert got == {"a": 4.0, "b": 5.0}


CSV = """ssid,bssid,rssi,channel,seq_jump,clock_skew,ie_count,rate_count,capabilities,beacon_interval,security,supported_rates
NA,02:AA:00:00:00:01,-50,6,1,0.5,20,12,1,100,Open,"1.0,2.0"
ssid,bssid,rssi,channel,seq_jump,clock_skew,ie_count,rate_count,capabilities,beacon_interval,security,supported_rates
,02:aa:00:00:00:01,oops,6,1,,20,12,1,100,Open,1.0
x,,-50,6,1,0.5,20,12,1,100,Open,1.0
"""


def test_csv_hygiene(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    raw = tables.read_csv(spark, str(tmp_path / "in.csv"))
    rows = tables.clean_for_profiles(raw).orderBy(F.col("ssid").desc_nulls_last()).collect()
    assert [(r["ssid"], r["bssid"], r["rssi"], r["clock_skew"]) for r in rows] == [
        ("NA", "02:aa:00:00:00:01", -50.0, 0.5), (None, "02:aa:00:00:00:01", None, None),
    ]
    assert rows[0]["supported_rates"] == "1.0,2.0"
    zeros = tables.clean_for_models(raw).filter("ssid IS NULL").first()
    assert (zeros["rssi"], zeros["clock_skew"]) == (0.0, 0.0)
    assert tables.missing_bssid(raw).count() == 1
    with pytest.raises(ValueError, match="rate_count, security"):
        tables.clean_for_profiles(raw.drop("rate_count", "security"))


def test_profiles_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"02:AA:BB:CC:DD:01": {"ssid": "LAB_AP_01", "ie_count": 20, "clock_skew_mean": -1.289e-05,'
        ' "notes": "kept out"},\n "02:aa:bb:cc:dd:02": {"ssid": "LAB_AP_02", "total_beacons": 1000}}'
    )
    known = tables.read_profiles_json(spark, str(tmp_path / "p.json"))
    got = {r["bssid"]: r for r in known.collect()}
    assert got["02:aa:bb:cc:dd:01"]["clock_skew_mean"] == -1.289e-05
    assert got["02:aa:bb:cc:dd:01"]["rssi_std"] is None
    assert got["02:aa:bb:cc:dd:02"]["total_beacons"] == 1000
    tables.write_profiles_json(known, str(tmp_path / "out"))
    again = tables.read_profiles_json(spark, str(tmp_path / "out"))
    assert again.exceptAll(known).count() == 0 and again.count() == 2
    assert tables.profile_entries_json(known).count() == 2


def test_many_profile_documents_come_back_whole(spark, tmp_path):
    rows = spark.range(1_000).selectExpr("concat('02:', lpad(id, 6, '0')) AS bssid", "CAST(id AS INT) AS ie_count")
    missing = [c for c in tables.PROFILE_SCHEMA.fieldNames() if c not in rows.columns]
    kinds = {f.name: f.dataType for f in tables.PROFILE_SCHEMA}
    known = rows.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in missing]).select(*tables.PROFILE_SCHEMA.fieldNames())
    tables.write_profiles_json(known, str(tmp_path / "out"), per_document=100)
    again = tables.read_profiles_json(spark, str(tmp_path / "out"))
    assert again.count() == 1_000 and again.select("bssid", "ie_count").exceptAll(rows.select("bssid", "ie_count")).count() == 0
