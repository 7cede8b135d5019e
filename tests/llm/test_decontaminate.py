import hashlib
import re

from compare import connect, differences
from samples import DATA

from beaconlake.llm.decontaminate import contamination, drop_contaminated, words_of
from beaconlake.llm.queries import ORACLES, op6_decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_force(documents, items, width=10):
    out = []
    for doc_id, text in documents:
        words, hit, found = plain_words(text), set(), set()
        for item_id, item in items:
            of_item = plain_words(item)
            if item_id is None or not of_item:
                continue
            size = min(width, len(of_item))
            windows = {tuple(of_item[i : i + size]) for i in range(len(of_item) - size + 1)}
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found.add(str(item_id))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), ids, bool(hit)))
    return sorted(out, key=str)


def test_words():
    for text in ("A-b_c's 1é日  x\ty", "", None, "ÀB"):
        assert [w.decode() for w in words_of(text)] == plain_words(text)


def test_cases_against_brute_force(spark, make_documents):
    texts = [
        ITEM, f"before {ITEM.upper()}, after", "one two three four five six seven eight nine", f"{ITEM} {ITEM}",
        "one two-three four five six seven eight nine ten", "short item here", "short, ITEM", None, "", "a a a a a a a a a a a a",
        "x one two three four five six seven eight nine ten one two", ITEM.replace(" ", "\n"), ITEM,
    ]
    documents = [(i, t) for i, t in enumerate(texts)] + [(3, ITEM), (None, ITEM)]
    items = [
        (1, ITEM), (2, "Short item"), (3, "single"), (10, "a " * 10), (11, ITEM + " thirteen"), (12, ""), (13, None),
        (None, ITEM), (9, "one two three four five six seven eight nine ten"), (9, "four five six seven eight nine ten eleven twelve one"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted((tuple(r) for r in contamination(make_documents(documents), table).collect()), key=str)
    assert rows == brute_force(documents, items)
    kept = drop_contaminated(make_documents(documents), table)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if not r[5])


def test_blocks_of_the_index_give_the_same(spark, make_documents, monkeypatch):
    import beaconlake.llm.decontaminate as module

    documents = make_documents([(1, f"x {ITEM} y"), (2, "nothing of it"), (3, "three four five six seven")])
    items = spark.createDataFrame([(1, ITEM), (2, "three four five")], "item_id long, text string")
    whole = sorted(contamination(documents, items).collect())
    monkeypatch.setattr(module, "BLOCK", 2)
    assert sorted(contamination(documents, items).collect()) == whole


def test_whole_table_against_sql(spark):
    got = op6_decontaminate(spark, DATA).toPandas()
    assert differences(got, connect(DATA).execute(ORACLES["op6_decontaminate"]).df()) == []


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "der schnelle braune"), (2, "日本語")], "item_id long, text string")
    rows = contamination(odd_documents, items).collect()
    assert len(rows) == odd_documents.count()
    assert {r.doc_id: r.n_hit for r in rows if r.contaminated} == {11: 3, 9: 1}
    assert {r.items_sha256 for r in rows if r.doc_id == 1} == {EMPTY}
    assert contamination(no_documents, items).collect() == []
    nothing = contamination(odd_documents, items.filter("false")).collect()
    assert len(nothing) == len(rows) and not any(r.contaminated for r in nothing)
    assert drop_contaminated(odd_documents, items).columns == odd_documents.columns
