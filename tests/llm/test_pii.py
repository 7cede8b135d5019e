from collections import Counter

from beaconlake.llm import pii
from beaconlake.llm.pii import candidate, entities_of, luhn, pseudonymise, spelled, surrogates

KEY = b"test"


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in entities_of(text)]


def test_types_are_found_in_order():
    text = (
        'Mr. John Smith, john.smith+x@mail.example.com, +1 (017) 555-7713, 10.0.255.1, 4539 1488 0343 6467,'
        ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 123-45-6789 DE89 3704 0044 0532 0130 00'
        " password: hunter2hunter2"
    )
    assert kinds(text) == [
        ("given_m", "John"), ("family", "Smith"), ("email", "john.smith+x@mail.example.com"), ("phone", "+1 (017) 555-7713"),
        ("ip", "10.0.255.1"), ("card", "4539 1488 0343 6467"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
        ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("assigned", "hunter2hunter2"),
    ]


def test_ordinary_text_has_none():
    for text in ("", "In 2024, 12 of 300 people paid 3.50 at 10:45.", "Version 1.2.3 of the token ring", "mr smith's 7 dogs"):
        assert entities_of(text) == []


def test_surrogates_keep_type_gender_script_and_format():
    assert all(0 < int(o) < 255 for o in candidate(KEY, "ip", "1.2.3.4", 0).split("."))
    assert luhn(candidate(KEY, "card", "4539148803436467", 0)) and luhn("4539148803436467")
    mail = candidate(KEY, "email", "jo.doe12@mail.example.com", 0)
    local, _, host = mail.partition("@")
    assert [c.isdigit() for c in local] == [c.isdigit() for c in "jo.doe12"] and host.endswith(".example.com")
    assert candidate(KEY, "given_f", "maria", 0).capitalize() in pii.GIVEN["f"]
    assert candidate(KEY, "given_m", "peter", 0).capitalize() in pii.GIVEN["m"]
    assert pii.script_of(candidate(KEY, "family", "иванов", 0)[0]) == "CYRILLIC"
    assert spelled("phone", "15551234567", "+1 (017) 555-7713") == "+1 (555) 123-4567"
    assert spelled("family", "bade", "SMITH") == "BADE" and spelled("family", "bade", "Smith") == "Bade"
    assert candidate(KEY, "ssn", "123456789", 0) != candidate(b"other", "ssn", "123456789", 0)


def test_surrogates_are_one_to_one_and_new(spark):
    # Names are drawn from a short list, so most of these collide at first.
    values = spark.createDataFrame(
        [("given_f", f"{n}x{i}") for n in "abcdef" for i in range(20)] + [("given_f", "anna"), ("ssn", "1"), ("ssn", "2")],
        "type string, value string",
    )
    rows = surrogates(values, KEY).collect()
    assert Counter((r.type, r.value) for r in rows) == Counter((r.type, r.value) for r in values.collect())
    assert max(Counter((r.type, r.surrogate) for r in rows).values()) == 1
    assert not {(r.type, r.surrogate) for r in rows} & {(r.type, r.value) for r in rows}


def test_coreference_across_documents(make_documents):
    rows = make_documents(
        [(1, "Mr John Smith wrote to ann@b.example.com."), (2, "MR SMITH? Mr Smith. ANN@B.example.com"), (3, "nothing")]
    )
    found = {r.doc_id: r for r in pseudonymise(rows, KEY).collect()}
    words = found[1].text.split()
    family = words[2]
    assert family != "Smith" and family in found[2].text and "Smith" not in found[2].text
    mail = words[-1].rstrip(".")
    assert mail.lower() in found[2].text.lower() and mail != "ann@b.example.com"
    assert found[3].text == "nothing" and found[3].pii_types == []


def test_odd_rows(odd_documents, no_documents):
    got = pseudonymise(odd_documents, KEY)
    assert got.columns == [*odd_documents.columns, "pii_types"]
    rows = got.collect()
    before = Counter((r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id != 14)
    assert Counter((r.doc_id, r.text) for r in rows if r.doc_id != 14) == before
    changed = next(r for r in rows if r.doc_id == 14)
    assert changed.pii_types == ["email", "phone"] and "a.b@c" not in changed.text and changed.lang == "'quoted\\"
    assert pseudonymise(no_documents, KEY).collect() == []


def test_whole_table(documents, texts):
    rows = pseudonymise(documents.select("doc_id", "text"), KEY).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    pairs = set()
    for r in rows:
        before, after = entities_of(texts[r.doc_id]), entities_of(r.text)
        assert [e[0] for e in before] == r.pii_types == [e[0] for e in after]
        pairs |= {(a[0], a[3], b[3]) for a, b in zip(before, after, strict=True)}
        if not before:
            assert r.text == texts[r.doc_id]
    assert len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})
    assert not {(p[0], p[2]) for p in pairs} & {p[:2] for p in pairs}


def test_later_mentions_and_longer_names_by_hand():
    text = "Dr. Anna Weber spoke. Weber said that Anna left WEBER's house; weber and Annapolis stay."
    assert kinds(text) == [
        ("given_u", "Anna"), ("family", "Weber"), ("family", "Weber"), ("given_u", "Anna"), ("family", "WEBER"),
    ]
    assert kinds("Mr John Paul Smith met Frau Dr. Vogel's dog") == [
        ("given_m", "John"), ("given_m", "Paul"), ("family", "Smith"), ("family", "Vogel"),
    ]
    assert kinds("Herr von Weber, Mr J. Smith, Señora María de la Cruz") == [
        ("family", "Weber"), ("family", "Smith"), ("given_f", "María"), ("family", "Cruz"),
    ]
    assert kinds("Mr Weber wrote to Weber@mail.example.com") == [("family", "Weber"), ("email", "Weber@mail.example.com")]


def test_later_mentions_have_the_same_surrogate(make_documents):
    rows = make_documents([(1, "Dr. Anna Weber spoke. Weber said (as WEBER) that Anna left."), (2, "Mr John Paul Smith. Paul?")])
    found = {r.doc_id: r.text for r in pseudonymise(rows, KEY).collect()}
    anna, weber = found[1].split()[1:3]
    assert anna not in ("Anna", "Weber") and weber not in ("Anna", "Weber")
    assert found[1] == f"Dr. {anna} {weber} spoke. {weber} said (as {weber.upper()}) that {anna} left."
    john, paul, smith = found[2].rstrip("?").split()[1:4]
    assert not {john, paul, smith.rstrip(".")} & {"John", "Paul", "Smith"}
    assert found[2] == f"Mr {john} {paul} {smith} {paul}?"


def test_national_phones_and_ipv6_by_hand(make_documents):
    values = ["030 1234567", "(030) 123-4567", "0171/1234567", "020 7946 0958", "01 23 45 67 89", "01711234567"]
    for value in values:
        assert kinds(f"call {value}, please") == [("phone", value)]
    for value in ("2001:db8::8a2e:370:7334", "fe80::1", "2001:0DB8:0:0:0:0:0:1", "::ffff:10.0.255.1"):
        assert kinds(f"from {value}.") == [("ipv6", value)]
    for text in ("on 01.02.2024 or 01-02-2024 or 01/02/2024", "std::vector a::b 10:45:30 0.1234567", "0:1:2:3:4:5:6::7:8:9"):
        assert kinds(text) == []
    assert kinds("0123 4567 8901 2345 6789")[0][0] in ("card", "phone")
    rows = make_documents([(1, "tel 030 1234567 from 2001:DB8::1 and 2001:db8:0::1")])
    words = pseudonymise(rows, KEY).collect()[0].text.split()
    assert "1234567" not in words and [len(w) for w in words[1:3]] == [3, 7]
    assert words[4] != "2001:DB8::1" and words[4].lower() == words[6].lower()
