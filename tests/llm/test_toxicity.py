import zlib

import numpy as np
from samples import DATA

from beaconlake.llm.toxicity import Features, choose_voters, features_of, logistic_regression, toxicity


def test_features_and_their_lookup_agree():
    names = ["lexicon", "shouting", "bangs", "=fox", "^qui", "^brown", "=zzz"]
    text = "The QUICK brown fox!! idiot"
    features = Features(names)
    assert [names[i] for i in features.of(text)] == [n for n in names if n in features_of(text)]
    assert features.of(None) == features.of("") == [] and features_of(None) == set()


def test_voters_cover_toxic_texts():
    active = [[3], [3, 4], [4], [5], [6], [6], [6]]
    toxic = np.array([1, 1, 1, 1, 0, 0, 0])
    voters = choose_voters(active * 40, np.tile(toxic, 40), 7)
    assert {3, 4, 5} <= set(voters) and 6 not in voters


def test_regression_follows_soft_targets():
    weights = logistic_regression([[0], [0], [1], [1]] * 20, np.array([0.9, 0.9, 0.1, 0.1] * 20), 2)
    scores = 1 / (1 + np.exp(-(weights[:2] + weights[2])))
    assert np.allclose(scores, [0.9, 0.1], atol=0.02)


def planted(make_documents, spark):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        filler = " ".join(f"w{(i * 7 + k * 13) % 97}" for k in range(20))
        kind = ("idiot", "zorblax", "quimbels", "zorbley")[i // 6 % 4]
        rows.append((i, f"{filler} {kind if toxic else 'fine'} {filler}"))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    return make_documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(spark, make_documents):
    documents, labels, rows = planted(make_documents, spark)
    found = toxicity(documents, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in found if r.held_out]
    assert np.mean(right) > 0.98


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    found = toxicity(odd_documents, labels).collect()
    assert len(found) == odd_documents.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3, 10)}) == 1
    assert toxicity(no_documents, labels).collect() == []
    assert len(toxicity(odd_documents, labels.filter("false")).collect()) == odd_documents.count()


def test_whole_table(spark, documents):
    found = toxicity(documents, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in documents.select("doc_id").collect())
