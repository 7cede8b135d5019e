import math

import numpy as np
import pytest
from compare import connect, differences
from samples import DATA

import beaconlake.llm.hardneg as module
from beaconlake.llm.hardneg import exact_scores, hard_negatives, level_slices, summaries
from beaconlake.llm.queries import ORACLES, op12_hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int, score long, rank int, ints string, band int"
ANCHOR = "vec_id % 10 = 0"


def brute_force(rows, k=5, scale=256):
    def ints(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    usable = [(i, ints(v), label) for i, v, label in rows if i is not None and label is not None and ints(v)]
    anchors = sorted({(i, tuple(v), label) for i, v, label in usable if i % 10 == 0})
    out = []
    for i, v, label in anchors:
        def scored(same, i=i, v=v, label=label):
            return sorted(
                (-sum(a * b for a, b in zip(v, w, strict=True)), j)
                for j, w, other in usable
                if j != i and len(w) == len(v) and (other == label) == same
            )

        others = scored(False)
        for p, j in scored(True)[:k]:
            band = [(s, n) for s, n in others if 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(band, start=1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 1, "x", 1) for i, v, label in rows], VECTORS)


def mined(spark, rows):
    return sorted(tuple(r) for r in hard_negatives(table(spark, rows), ANCHOR).collect())


def test_bounds_hold_and_tighten():
    rows = np.random.default_rng(1).integers(-500, 500, (40, 64)).astype(float) + np.linspace(-300, 300, 64)
    features, exact, widths = summaries(rows), rows @ rows.T, []
    for means, devs in level_slices(64):
        middle, spread = features[:, means] @ features[:, means].T, features[:, devs] @ features[:, devs].T
        assert (middle + spread >= exact - 1e-6).all() and (middle - spread <= exact + 1e-6).all()
        widths.append(spread.sum())
    assert widths[1] < widths[0]


def test_scores_of_any_size():
    big = np.array([[1 << 40, 1 << 40], [1 << 62, 1 << 62], [-(1 << 62), 1]])
    other = np.array([[3, 1], [1 << 62, 5], [1 << 62, 1]])
    assert exact_scores(big, other).tolist() == [4 << 40, (1 << 63) - 1, -(1 << 63)]


@pytest.mark.parametrize("dimension", [1, 6, 20])
def test_against_brute_force(spark, monkeypatch, dimension):
    rng = np.random.default_rng(dimension)
    centres = rng.normal(size=(3, dimension))
    rows = [
        (i, [float(x) for x in centres[i % 3] + 0.4 * rng.normal(size=dimension)], int(rng.integers(0, 3)))
        for i in range(260)
    ]
    rows += [rows[7], rows[7], (300, rows[20][1], rows[20][2]), (20, rows[20][1], rows[20][2]), (20, rows[3][1], rows[20][2]), (301, rows[4][1], 2)]
    want = brute_force(rows)
    assert len(want) > 50 and mined(spark, rows) == want
    monkeypatch.setattr(module, "BLOCK_NUMBERS", 400)  # several blocks of anchors
    monkeypatch.setattr(module, "PAIRS", 50)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 2),
        (None, [9.0, 9.0], 1), (5, [1.0, 0.5], None), (6, [0.9, 0.5], 1), (7, [0.9, 0.4], 2), (8, [0.9, 0.4], 2),
        (9, [1.0, 0.4], 3), (10, [], 1), (20, [-1.0, 0.0], 4), (21, [1.0, 0.0], 4), (30, [0.0, 0.0], 5),
        (31, [3.0, 0.0], 5), (40, [1.0], 1), (41, [1.0], 1), (42, [0.9], 2),
    ]
    want = brute_force(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []  # no anchors
    assert mined(spark, [(10, [1.0], 1), (2, [1.0], 2)]) == []  # no positives


def test_whole_table_against_sql(spark):
    got = op12_hard_negatives(spark, DATA).toPandas()
    assert len(got) and differences(got, connect(DATA).execute(ORACLES["op12_hard_negatives"]).df()) == []
