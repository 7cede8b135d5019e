"""Tables that grow by batches, and what is kept in them."""

import random

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import inventory
from beaconlake.operators.profiles import build_profiles
from beaconlake.session import numbered_folders, remove_folder
from beaconlake.sources.merged import MergedTable
from beaconlake.sources.tables import add_session
from beaconlake.streaming import detection as live


@pytest.fixture
def counts(spark, path):
    return MergedTable(spark, path("merged"), ["k"], {"n": "sum(n)", "low": "min(low)"})


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, n long, low long")


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_batches_merge_once(spark, counts):
    counts.add(rows(spark, [("a", 1, 5), ("a", 2, 4), (None, 7, 7)]), 0)
    counts.add(rows(spark, [("b", 1, 1)]), 1)
    counts.add(rows(spark, [("a", 10, 9)]), 2)
    want = sorted([("a", 13, 4), (None, 7, 7), ("b", 1, 1)], key=str)
    assert content(counts) == want
    counts.add(rows(spark, [("a", 10, 9)]), 2)  # run again after a failure
    assert content(counts) == want
    counts.compact()
    counts.add(rows(spark, [("a", 10, 9)]), 2)  # already in the base
    assert content(counts) == want
    counts.add(rows(spark, []), 3)
    counts.expire()
    assert numbered_folders(spark, f"{counts.path}/delta", "batch") == [3] and content(counts) == want


def test_deltas_are_folded(spark, counts):
    for batch in range(7):
        counts.add(rows(spark, [("a", 1, batch), (str(batch), 1, 1)]), batch, compact_every=3)
    assert len(counts._parts()[1]) < 3 and len(numbered_folders(spark, f"{counts.path}/base", "upto")) == 2
    assert content(counts) == sorted([("a", 7, 0), *[(str(i), 1, 1) for i in range(7)]])


def observed(spark, make_beacons, seed, aps, n):
    draw = random.Random(seed)
    made = make_beacons(
        [
            {"bssid": draw.choice(aps), "rssi": draw.randint(-80, -30), "ie_count": draw.choice([14, 14, 15]), "frame_id": seed * 1000 + i}
            for i in range(n)
        ]
    )
    return made.withColumns({"clock_skew": F.col("rssi") / 1e6, "seq_jump": F.lit(1), "valid_skew": F.lit(1)})


def test_sessions_add_up_to_the_profiles_of_all_rows(spark, make_beacons, path):
    parts = [(1, ["x", "y"], 60), (2, ["y", "z"], 25), (3, ["z", "few"], 12)]
    sessions = [observed(spark, make_beacons, *part) for part in parts]
    seen = None
    for number, session in enumerate(sessions):
        folder = path(f"session{number}")
        session.write.parquet(folder)
        got = add_session(spark, spark.read.parquet(folder), path("store"), number)
        seen = session if seen is None else seen.unionByName(session)
        want = {r["bssid"]: r for r in build_profiles(seen).drop("profile_built").collect()}
        have = {r["bssid"]: r for r in got.drop("profile_built").collect()}
        assert have.keys() == want.keys()
        for ap, profile in want.items():
            for name, value in profile.asDict().items():
                assert have[ap][name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), (ap, name)
        built = {r["bssid"]: r["profile_built"] for r in got.collect()}
        if number:
            # Profiles of access points that the session did not hear are the stored ones.
            assert all(built[ap] == before[ap] for ap in before if ap not in parts[number][1])
        before = built
        remove_folder(spark, folder)  # no later step may read an earlier session
    assert add_session(spark, sessions[2], path("store"), 2).count() == len(before)


def test_a_live_list_equals_the_inventory(spark, make_beacons, path):
    draw = random.Random(4)
    rows = [
        {
            "bssid": draw.choice("abcd"), "ssid": draw.choice(["<Hidden>", "N1", "N2"]), "channel": draw.choice([0, 1, 6]),
            "rssi": draw.randint(-90, 0), "security": draw.choice(["Open", "WPA2/WPA3"]), "capture_us": draw.randrange(50) * 1000,
        }
        for _ in range(300)
    ]
    table = make_beacons(rows)
    want = sorted(tuple(r) for r in inventory.network_inventory(table).collect())
    for part in range(5):
        table.filter(F.col("frame_id") % 5 == part).coalesce(1).write.mode("append").parquet(path("in"))
        source = live.read_beacons(spark, path("in"), maxFilesPerTrigger=1)
        live.live_networks(source, path("list"), path("checkpoint")).awaitTermination()
    assert sorted(tuple(r) for r in live.network_list(spark, path("list")).collect()) == want
    totals = live.session_totals(spark, path("list")).first()
    assert (totals["beacons"], totals["access_points"], totals["latest_us"]) == (300, 4, max(r["capture_us"] for r in rows))
