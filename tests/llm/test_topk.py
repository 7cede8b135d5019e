import math

import numpy as np
from compare import connect, differences
from samples import DATA

import beaconlake.llm.topk as module
from beaconlake.llm.queries import ORACLES, op8_topk
from beaconlake.llm.topk import LEVELS, exact_topk, segment_features

VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute_force(rows, queries, k, scale=1024):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    out = []
    for q, v in sorted({(q, tuple(v)) for q, v in queries if q is not None and ints(v) is not None}):
        scored = [
            (-sum(a * b for a, b in zip(ints(v), ints(w), strict=True)), i)
            for i, w in rows
            if i is not None and i != q and ints(w) is not None and len(w) == len(v)
        ]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], start=1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], VECTORS)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = rng.integers(-500, 500, (40, 64)).astype(float)
    exact = rows @ rows.T
    for level in LEVELS:
        features = segment_features(rows, level)
        assert (features @ features.T >= exact - 1e-6).all()


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(300)]
    rows += [(500 + i, rows[7][1]) for i in range(15)] + [(600, [1.0, 2.0]), (700, [3.0, 1.0]), (9, rows[9][1]), (9, rows[9][1])]
    queries = [r for r in rows if r[0] % 100 == 0] + [rows[7], rows[7]]
    want = brute_force(rows, queries, 10)
    assert [tuple(r) for r in sorted(exact_topk(table(spark, rows), table(spark, queries)).collect())] == want
    monkeypatch.setattr(module, "BLOCK_NUMBERS", 20)  # several passes
    assert [tuple(r) for r in sorted(exact_topk(table(spark, rows), table(spark, queries)).collect())] == want


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [9.0, 9.0]),
        (5, [-0.0001, 0.0]), (6, [0.0, 0.0]), (7, [0.0, 0.0]), (100, []), (200, [1e6, -1e6]),
    ]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    assert [tuple(r) for r in sorted(exact_topk(table(spark, rows), table(spark, queries)).collect())] == brute_force(rows, queries, 10)
    assert exact_topk(table(spark, []), table(spark, [])).collect() == []
    assert exact_topk(table(spark, rows), table(spark, [])).collect() == []


def test_whole_table_against_sql(spark):
    got = op8_topk(spark, DATA).toPandas()
    assert differences(got, connect(DATA).execute(ORACLES["op8_topk"]).df()) == []


def test_queries_from_outside_the_table(spark):
    # The queries are much closer to each other than to any vector.
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(1500)]
    queries = [(10_000 + i, [float(x) for x in np.float32(20 + 0.1 * rng.normal(size=8))]) for i in range(30)]
    for k in (3, 10):
        got = [tuple(r) for r in sorted(exact_topk(table(spark, rows), table(spark, queries), k).collect())]
        assert len(got) == 30 * k and got == brute_force(rows, queries, k)
