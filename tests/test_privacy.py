import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconlake.functions import privacy as P
from beaconlake.operators import privacy as O

# Expected results below were worked out by hand; pseudonyms are 02 and the first ten hex digits
# of the SHA-256 of the lower-case, colon-separated address.
A, B = "02:10:00:00:00:01", "02:10:00:00:00:0a"


def digits(address):
    return hashlib.sha256(address.encode()).hexdigest()[:10]


PSEUDO_A, PSEUDO_B = (":".join(re.findall("..", "02" + digits(m))) for m in (A, B))


def run(spark, texts, names=None, paths=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = O.scrub_text(rows, ["t"], names or {}, paths or {})
    return [r["t"] for r in out.orderBy("i").collect()]


PAIRS = [
    ("nothing here", "nothing here"),
    ("", ""),
    (A, PSEUDO_A),
    ("AP 02-10-00-00-00-0A, and 02:10:00:00:00:0a.", f"AP {PSEUDO_B}, and {PSEUDO_B}."),
    ("FF:FF:FF:FF:FF:FF stays, aa-bb-cc-dd-ee-ff too", "FF:FF:FF:FF:FF:FF stays, aa-bb-cc-dd-ee-ff too"),
    (f"x{A}", f"x{A}"),  # glued to a letter
    (f"{A}f", f"{A}f"),
    (f"{A}:99", f"{PSEUDO_A}:99"),  # of seven octets the first six are an address
    (f"é{A} _{A}", f"é{A} _{A}"),  # letters and underscores belong to words
    (f"²{A}", f"²{A}"),
    ("/home/ann/x /home/bob's/x /home/a b/x /home/z", "/home/user/x /home/bob's/x /home/a b/x /home/z"),
    (f"/home/me/{A}/", f"/home/user/{PSEUDO_A}/"),
    (f"line\n{A}\nline", f"line\n{PSEUDO_A}\nline"),
    ("00:00:00:00:00:00", "00:00:00:00:00:00"),
]
TEXTS = [before for before, _ in PAIRS]


def test_scrubbing(spark):
    assert run(spark, TEXTS) == [after for _, after in PAIRS]


def test_longest_names_and_paths_are_replaced_first(spark):
    names = {"Home": "LAB_AP_01", "Home2": "LAB_AP_02", "LAB": "Q"}
    paths = {"/home/me/": "/srv/", "/home/": "/h/"}
    texts = ["Home Home2 at /home/me/", "LAB", "/home/you/x"]
    # Shorter names are looked for in what longer ones were replaced by.
    assert run(spark, texts, names, paths) == ["Q_AP_01 Q_AP_02 at /srv/", "Q", "/h/you/x"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0aF:-/ hxé_\n", max_size=60), min_size=40, max_size=80))
def test_scrubbing_is_stable_and_hides_addresses(spark, texts):
    once = run(spark, [f"{t} {A.upper()} {t}" for t in texts])
    assert all(A not in t.lower() and PSEUDO_A in t for t in once)


def test_pseudonyms(spark):
    macs = [" 02-10-00-00-00-0A\t", "ff:ff:ff:ff:ff:ff", B]
    rows = spark.createDataFrame([(m,) for m in macs], "m string")
    got = [r[0] for r in rows.select(P.pseudonym(F.col("m"))).collect()]
    assert got == [PSEUDO_B, "ff:ff:ff:ff:ff:ff", PSEUDO_B]


def test_mapping_document():
    assert O.load_mapping(None) == ({}, {})
    text = '{"ssid_map": {"a": 1, "": "x"}, "path_map": {"/p/": "/q/"}}'
    assert O.load_mapping(text) == ({"a": "1"}, {"/p/": "/q/"})
    with pytest.raises(ValueError, match="path_map"):
        O.load_mapping('{"path_map": []}')


def test_file_selection(spark):
    files = [
        ("a/b.txt", b"x"), ("a/b.PNG", b"x"), (".git/c", b"x"), ("a/venv/c.py", b"x"), (".zip", b"x"),
        ("b.tar.zip", b"x"), ("c.txt", b"\xff"), ("noending", "é".encode()), ("a.pcap/x", b"x"),
    ]
    rows = spark.createDataFrame(files, "path string, content binary")
    assert {r["path"] for r in O.scrubbable(rows).collect()} == {"a/b.txt", ".zip", "noending", "a.pcap/x"}


def test_audit_and_change_report(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    audit = {r["mac"]: r["pseudonym"] for r in O.mac_audit(rows, "t").collect()}
    assert audit == {A: PSEUDO_A, B: PSEUDO_B}
    changed = {r["i"] for r in O.changed_rows(rows, "i", "t").collect()}
    assert changed == {i for i, (before, after) in enumerate(PAIRS) if before != after}


def test_beacons(make_beacons):
    row = O.scrub_beacons(make_beacons([{"ssid": "Mine", "bssid": A}]), {"Mine": "LAB"}).first()
    assert (row["ssid"], row["bssid"]) == ("LAB", PSEUDO_A)


def test_many_entries_equal_one_after_the_other(spark):
    draw = random.Random(12)
    mapping = {"".join(draw.choices("abc", k=draw.randint(1, 6))): "".join(draw.choices("abc", k=draw.randint(0, 4))) for _ in range(300)}
    texts = ["".join(draw.choices("abcd", k=draw.randint(0, 60))) for _ in range(200)]
    want = {}
    for text in texts:
        done = text
        for old, new in sorted(mapping.items(), key=lambda pair: len(pair[0]), reverse=True):
            done = done.replace(old, new)
        want[text] = done
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = rows.select("text", P.replace_literals(F.col("text"), mapping).alias("done")).collect()
    assert {r["text"]: r["done"] for r in got} == want | {None: None}
