import hashlib
import random
from collections import Counter
from statistics import mean

import numpy as np
import pytest
from samples import DATA

from beaconlake.llm.fingerprint import (
    SPREAD, TERM, block, block_edges, document_fingerprints, fingerprint, likeness, within_radius,
)
from beaconlake.llm.queries import op13_fingerprints

MASK = (1 << 64) - 1


def plain(text):
    """The fingerprint as one number of 128 bits, term by term and bit by bit."""
    if not text:
        return 0
    text = text.lower()
    codes = [*map(ord, text), *[0] * (TERM - len(text))]
    votes, total = [0] * 128, 0
    for term, n in Counter(tuple(codes[i : i + TERM]) for i in range(len(codes) - TERM + 1)).items():
        number = 0
        for code in term:
            number = (number * int(SPREAD[0]) + code + 1) & MASK
        bits = 0
        for half, start in enumerate(SPREAD[1:]):
            h = (number + int(start)) & MASK
            for factor in SPREAD:
                h = ((h ^ (h >> 32)) * int(factor)) & MASK
            bits |= (h ^ (h >> 32)) << (64 * half)
        weight = n.bit_length()
        total += weight
        for b in range(128):
            votes[b] += weight * (bits >> b & 1)
    return sum(1 << b for b in range(128) if votes[b] * 2 > total)


def joined(halves):
    return (halves[0] & MASK) << 64 | halves[1] & MASK


def expected(rows, radius=4):
    """All columns for ``(doc_id, text)`` rows in their order."""
    texts = [t or "" for _, t in rows]
    prints = [plain(t) for t in texts]
    out = []
    for at, (doc_id, _) in enumerate(rows):
        after = (at + 1) % len(rows)
        half = len(texts[at]) // 2
        other = texts[at][: len(texts[at]) - half] + texts[after][:half]
        changed = plain(other)
        near = [j for j in range(len(rows)) if (prints[j] ^ prints[at]).bit_count() <= radius]
        ids = [rows[j][0] for j in near if rows[j][0] is not None]
        out.append(
            (
                doc_id, len(texts[at]), hashlib.sha256(other.encode()).hexdigest(), f"{prints[at]:032x}", f"{changed:032x}",
                1 - (prints[at] ^ changed).bit_count() / 128, 1 - (prints[at] ^ prints[after]).bit_count() / 128,
                len(near) - 1, min(ids, default=None),
            )
        )
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("text", ["", "a", "abcde", "Abcdef", "one two three " * 40, "日本語 のテキスト", "x" * 5000])
def test_fingerprint_is_the_plain_one(text):
    assert joined(fingerprint(text)) == plain(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(3000))
    whole = fingerprint(text)
    monkeypatch.setattr("beaconlake.llm.fingerprint.COUNTED", 700)
    assert fingerprint(text) == whole


def test_blocks_are_the_bits():
    number = random.Random(1).getrandbits(128)
    high, low = (np.array([h], dtype=np.uint64) for h in (number >> 64, number & MASK))
    for radius in (1, 3, 4, 6):
        edges = block_edges(radius)
        assert sum(w for _, w in edges) == 128 and len(edges) == radius + 2
        for start, width in edges:
            assert int(block(high, low, start, width)[0]) == number >> start & ((1 << width) - 1)


@pytest.mark.parametrize(("radius", "chunk"), [(4, 4096), (3, 7), (6, 20)])
def test_all_within_the_radius_are_found(spark, radius, chunk):
    rng = random.Random(radius)
    prints = {}
    for _ in range(12):
        middle = rng.getrandbits(128)
        for _ in range(25):
            flips = rng.sample(range(128), rng.randint(0, 5))
            prints.setdefault(middle ^ sum(1 << b for b in flips), len(prints))
    signed = [x if x < 1 << 63 else x - (1 << 64) for p in prints for x in (p >> 64, p & MASK)]
    rows = [(signed[2 * i], signed[2 * i + 1], 1 + i % 3, None if i % 10 == 0 else (1 << 60) + i) for i in range(len(prints))]
    nodes = spark.createDataFrame(rows, "high long, low long, docs long, first long")
    got = {(r.high, r.low): (r.links, r.first) for r in within_radius(nodes, radius, chunk).collect()}
    want, numbers = {}, list(prints)
    for i, p in enumerate(numbers):
        near = [j for j, q in enumerate(numbers) if i != j and (p ^ q).bit_count() <= radius]
        if near:
            want[rows[i][:2]] = sum(rows[j][2] for j in near), min((rows[j][3] for j in near if rows[j][3]), default=None)
    assert got == want and len(want) > 100


def test_edits_and_neighbours(make_documents):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, number = [], 0
    for _ in range(40):
        text = " ".join(rng.choices(words, k=rng.randint(5, 300)))
        for copy in range(rng.choice([1, 1, 2, 5])):
            rows.append((number, text if copy < 3 else text[:-1] + "z"))
            number += rng.randint(1, 3)
    assert found(document_fingerprints(make_documents(rows), chunk=8)) == expected(rows)


def test_odd_rows(odd_documents, no_documents, make_documents, spark):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    repeated = odd_documents.unionByName(odd_documents.filter("doc_id = 7"))
    got = document_fingerprints(repeated.filter("doc_id IS NOT NULL OR text IS NOT NULL"))
    ordered = sorted([r for r in rows if r[0] is not None] + [(7, "one")], key=lambda r: r[0])
    assert found(got) == expected([*ordered, *[r for r in rows if r[0] is None and r[1] is not None]])
    assert document_fingerprints(no_documents).collect() == []
    assert found(document_fingerprints(make_documents([(5, "alone here")]))) == expected([(5, "alone here")])
    big = [((1 << 60) + i, f"a text of number {i}") for i in range(3)]
    assert found(document_fingerprints(make_documents(big))) == expected(big)
    named = spark.createDataFrame([("b", "two texts"), ("a", "three texts")], "doc_id string, text string")
    assert found(document_fingerprints(named)) == expected([("a", "three texts"), ("b", "two texts")])


def test_whole_table(spark, texts):
    got = found(op13_fingerprints(spark, DATA))
    assert got == expected(sorted(texts.items()))
    long = [r for r in got if r[1] >= 300]
    assert mean(r[5] for r in long) > mean(r[6] for r in long) + 0.1
    assert likeness((0, 0), (0, -1)) == 0.5
