import random
from collections import defaultdict

import pytest
from samples import DATA

import corpus_pipeline
from beaconlake.llm.nearcopies import candidate_groups, keep_one_of_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(texts):
    """Smallest id of each group that pairs of similarity 0.8 and more connect, by comparing all."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(ids):
        for a in ids[:j]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted({find(i) for i in ids})


@pytest.fixture(scope="module")
def planted():
    """Originals with copies that lie at similarities around and above 0.8, and chains of copies."""
    rng, texts, number = random.Random(5), {}, 0
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        texts[number], number = " ".join(words), number + 1
        for share in (0.0, 0.004, 0.01, 0.02, 0.03, 0.05):
            copy = list(words)
            for at in rng.sample(range(len(copy)), round(share * len(copy))):
                copy[at] = f"x{rng.randrange(5000)}"
            texts[number], number = " ".join(copy), number + 1
            if share == 0.02:
                words = copy  # later copies are copies of this one
    return texts


def test_planted_near_copies(make_documents, planted):
    want = first_of_groups(planted)
    assert 25 <= len(want) < len(planted)
    for chunk in (1 << 20, 300):  # groups are whole, or cut into chunks
        kept = keep_one_of_near_copies(make_documents(list(planted.items())), chunk)
        assert sorted(r.doc_id for r in kept.collect()) == want


def test_stage_leaves_no_similar_pair(spark, make_documents, planted):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, make_documents(list(planted.items())), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == first_of_groups(planted)


def test_stage_on_the_whole_table(spark, documents, texts):
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, documents, DATA)
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == first_of_groups(texts)


def test_odd_rows(odd_documents, no_documents):
    kept = keep_one_of_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    want = defaultdict(list)
    for r in odd_documents.collect():
        want[frozenset(shingles(r.text))].append(r.doc_id)
    firsts = [min((i for i in ids if i is not None), default=None) for ids in want.values()]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i in firsts)
    assert keep_one_of_near_copies(no_documents).collect() == []


def test_near_fingerprints_are_candidates(spark):
    """Texts without a shared band are candidates if their fingerprints are equal or up to three bits apart."""
    far = 0x0F0F0F0F0F0F0F0F
    prints = {1: 0, 2: 0, 3: 0b111, 4: far, 5: far ^ (1 << 40), 6: 0x00FF00FF00FF00FF}
    nodes = spark.createDataFrame([(n, fp, [n * 100]) for n, fp in prints.items()], "node long, fp long, keys array<long>")
    groups = defaultdict(set)
    for r in candidate_groups(nodes).collect():
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]]
