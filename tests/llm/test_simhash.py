import random
import re

import numpy as np
import xxhash

from beaconlake.llm.components import components
from beaconlake.llm.simhash import POSITION_SETS, fingerprint, keep_one, links, near_duplicates, walk


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_any_three_positions_miss_a_set():
    assert len(POSITION_SETS) == 14
    for a in range(8):
        for b in range(8):
            for c in range(8):
                assert any(not {a, b, c} & set(s) for s in POSITION_SETS)


def near(rng, n, flips):
    centre, out = rng.getrandbits(64), []
    for _ in range(n):
        mask = 0
        for _ in range(rng.randrange(flips + 1)):
            mask |= 1 << rng.randrange(64)
        out.append(centre ^ mask)
    return out


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    prints = sorted({p for n, f in ((60, 3), (40, 5), (30, 2), (5, 1)) for p in near(rng, n, f)} | {rng.getrandbits(64) for _ in range(100)} | {0})
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for chunk in (4096, 7):  # lists are whole, or cut into chunks
        edges = links(nodes, chunk)
        roots = {r.node: r.root for r in components(edges).collect()}
        got = [roots.get(p, p) for p in signed]
        want = plain_classes(prints)
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_walk_gives_one_edge_for_each_one_reached():
    prints = np.array(sorted(set(near(random.Random(3), 500, 2))), dtype=np.uint64)
    sources, targets = walk(prints)
    assert len(targets) <= len(prints) - 1 and len(set(targets)) == len(targets) == len(sources)


def test_whole_table(documents, texts):
    rows = near_duplicates(documents).collect()
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = plain_classes(prints)
    first = {}
    for i, c in zip(ids, want, strict=True):
        first.setdefault(c, i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (format(p, "016x"), first[c]) for i, p, c in zip(ids, prints, want, strict=True)
    }


def test_odd_rows(odd_documents, no_documents):
    rows = near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    empty = {("0" * 16, 1)}
    assert of[1] == of[2] == of[3] == of[10] == empty and ("0" * 16, 1) in of[None]
    assert of[4] == of[5] == of[6]  # case does not count
    assert any(c is None for _, c in of[None])  # nothing but missing ids in its component
    assert near_duplicates(no_documents).collect() == []


def test_one_of_each_group_stays(odd_documents, no_documents):
    kept = keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 7, 8, 9, 11, 12, 13, 14]
    assert keep_one(no_documents).collect() == []


def test_fingerprint_counts_repeats_over_long_texts():
    text = b"a b c d " * 20_000 + b"e f g"
    assert fingerprint(text) == plain_fingerprint(text.decode())
