import pytest
from pyspark.sql import functions as F

from beaconlake.operators.decode import (
    collector_observations, decode_frames, element_table, observations, quarantined_frames,
)
from beaconlake.schema import FRAME_SCHEMA, UNKNOWN


def element(number, info=b""):
    return bytes([number, len(info)]) + info


def beacon(elements=b"", subtype=0x80, seq=100, tsf=1_000_000, interval=100, cap=1, ap="021000000001"):
    mac = bytes.fromhex(ap)
    header = bytes([subtype, 0, 0, 0]) + b"\xff" * 6 + mac + mac + (seq << 4).to_bytes(2, "little")
    fixed = tsf.to_bytes(8, "little") + interval.to_bytes(2, "little") + cap.to_bytes(2, "little")
    return header + fixed + elements


NAME = element(0, b"LAB_AP_01")
RATES = element(1, b"\x82\x84\x8b\x96")
CHANNEL = element(3, b"\x06")


@pytest.fixture
def frames(spark):
    def build(*raw, rssi=-40):
        rows = [(i, "s", "default", i, rssi, f) for i, f in enumerate(raw)]
        return spark.createDataFrame(rows, FRAME_SCHEMA)

    return build


def decoded(frame_table, **options):
    return observations(decode_frames(frame_table, **options)).orderBy("frame_id").collect()


def test_ordinary_beacon(frames):
    row = decoded(frames(beacon(NAME + RATES + CHANNEL, seq=4095, tsf=2**40 + 5, cap=0x0411)))[0]
    assert (row["ssid"], row["bssid"], row["channel"], row["rssi"]) == (
        "LAB_AP_01", "02:10:00:00:00:01", 6, -40,
    )
    assert (row["seq_num"], row["beacon_timestamp"], row["beacon_interval"]) == (4095, 2**40 + 5, 100)
    assert (row["capabilities"], row["ie_count"], row["rate_count"]) == (0x0411, 3, 4)
    assert row["supported_rates"] == "1.0,2.0,5.5,11.0"


@pytest.mark.parametrize(
    "elements, cap, security",
    [
        (b"", 1, "Open"),
        (b"", 0x11, "WEP"),
        (element(221, b"\x00\x50\xf2\x01\x01\x00"), 0x11, "WPA"),
        (element(221, b"\x00\x50\xf2\x02\x01\x00"), 1, "Open"),
        (element(48, b"\x01\x00"), 1, "WPA2/WPA3"),
        (element(221, b"\x00\x50\xf2\x01") + element(48, b"\x01\x00"), 0x11, "WPA2/WPA3"),
    ],
)
def test_security_ladder(frames, elements, cap, security):
    assert decoded(frames(beacon(NAME + elements, cap=cap)))[0]["security"] == security


def test_rates_of_both_elements_are_distinct_and_sorted(frames):
    row = decoded(frames(beacon(NAME + element(50, b"\x6c\x30\x82") + RATES)))[0]
    assert row["supported_rates"] == "1.0,2.0,5.5,11.0,24.0,54.0"
    assert decoded(frames(beacon(NAME)))[0]["supported_rates"] == "unknown"


def test_channel_skips_empty_elements(frames):
    assert decoded(frames(beacon(NAME + element(3) + element(3, b"\x0b\x01"))))[0]["channel"] == 11
    assert decoded(frames(beacon(NAME + element(3))))[0]["channel"] == 0


@pytest.mark.parametrize("raw", [b"", b"   ", "  ".encode(), b"\t\x1c\n"])
def test_blank_names_are_hidden(frames, raw):
    assert decoded(frames(beacon(element(0, raw))))[0]["ssid"] == "<Hidden>"


@pytest.mark.parametrize("raw", [b"caf\xc3\xa9", b"\xff\xfeab", b"a\xe2\x82", b"\x00\x00", b"\xf0\x9f\x98"])
def test_names_decode_like_replacing_utf8(frames, raw):
    assert decoded(frames(beacon(element(0, raw))))[0]["ssid"] == raw.decode("utf-8", "replace")


def test_first_element_is_the_name_whatever_its_number(frames):
    assert decoded(frames(beacon(element(7, b"US ") + NAME)))[0]["ssid"] == "US "


def test_truncated_element_keeps_what_is_there(spark, frames):
    table = frames(beacon(NAME + bytes([221, 200]) + b"\x00\x50\xf2\x01"), beacon(NAME + b"\x05"))
    rows = decoded(table)
    assert [(r["ie_count"], r["security"]) for r in rows] == [(2, "WPA"), (1, "Open")]
    last = element_table(decode_frames(table)).filter("frame_id = 0 AND position = 1").first()
    assert (last["id"], bytes(last["info"])) == (221, b"\x00\x50\xf2\x01")


def test_unusable_frames_go_to_quarantine(frames):
    table = frames(
        beacon(NAME), beacon(NAME, subtype=0x40), beacon(NAME)[:30], beacon(), None, b"", beacon(b"\x00")
    )
    problems = {r["frame_id"]: r["problem"] for r in quarantined_frames(table).collect()}
    assert problems == {
        1: "not a beacon", 2: "truncated header", 3: "no elements", 4: "empty", 5: "not a beacon",
        6: "no elements",
    }
    assert [r["frame_id"] for r in decoded(table)] == [0]


def test_scan_keeps_beacons_without_elements_as_open(frames):
    row = decoded(frames(beacon(cap=0x11)), keep_bare=True)[0]
    assert (row["ssid"], row["security"], row["channel"], row["ie_count"]) == ("<Hidden>", "Open", 0, 0)


def test_missing_signal_and_unreadable_name(frames):
    assert decoded(frames(beacon(NAME), rssi=None))[0]["rssi"] == 0
    rows = observations(decode_frames(frames(beacon()), keep_bare=True), UNKNOWN).collect()
    assert rows[0]["ssid"] == UNKNOWN
    assert collector_observations(frames(beacon(NAME))).count() == 1


def test_many_batches(spark, frames):
    table = frames(beacon(NAME + RATES + CHANNEL)).crossJoin(spark.range(30_000)).drop("id")
    total = observations(decode_frames(table)).agg(F.sum("ie_count"), F.min("channel")).first()
    assert tuple(total) == (90_000, 6)


def test_no_frames(frames):
    assert decoded(frames(beacon(NAME, subtype=0x40))) == []
