import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v int, cell string, g int"


def brute(rows, every=100, positives=5, negatives=5, low=80, high=100):
    kept = {}
    for i, vector, label in rows:
        if i is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [math.floor(256 * x) for x in vector])
        kept[i] = min(kept.get(i, own), own)
    width = len(kept[min(kept)][1]) if kept else 0
    kept = {i: r for i, r in kept.items() if len(r[1]) == width}
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, (l, v) in kept.items() if i != a)
        for p, i, l in [s for s in scored if s[2] == label][:positives]:
            hard = [s for s in scored if s[2] != label and low * -p <= high * -s[0] <= high * -p][:negatives]
            out += [(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mined(df, **options).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "CHUNK", 60)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 12)


@pytest.mark.parametrize("kind", ["gauss", "copies", "clusters"])
def test_equals_brute_force(spark, small, kind):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(400):
        x = centres[i % 6] + rng.normal(size=8) * (0.05 if kind == "clusters" else 1.0)
        if kind == "copies" and i % 3 == 0:
            x = centres[0]
        rows.append((i, x.astype("float32").tolist(), int(rng.integers(3))))
    want = brute(rows, every=10)
    assert want and run(spark, rows, every=10) == want


def test_ranges_keep_far_cells_away(spark, small):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.05).astype("float32").tolist(), i % 2, 1, 2, "x", 3) for i in range(600)]
    own = hard_negatives.usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding", 256)
    cells = hard_negatives.cells_of(own)
    candidates = hard_negatives.placed(own, cells, True)
    anchors = hard_negatives.gathered(hard_negatives.placed(own.where("id % 10 = 0").withColumnRenamed("id", "anchor"), cells, False), "label")
    bounds = hard_negatives.positive_ranges(anchors, candidates, cells, 6)
    sent = candidates.join(bounds, (candidates["cell"] == bounds["cell"]) & (F.col("label") == F.col("of")) & F.col("e").between(F.col("lo"), F.col("hi"))).count()
    assert sent < 0.7 * candidates.join(anchors.select("g", "label").distinct(), "label").count()


def test_odd_rows(spark, small):
    one, two = [1.0, 0.5], [0.5, 1.0]
    rows = [
        (0, one, 1), (0, one, 1), (0, two, 2), (1, one, 1), (2, one, 2), (3, two, 2), (None, one, 1), (4, None, 1), (5, one, None), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1),
        (8, [float("-inf"), 1.0], 2), (9, [], 1), (100, [0.0, 0.0], 1), (101, [0.0, 0.0], 2), (102, [1.0], 1), (200, [-1.0, 0.0], 3), (201, one, 3), (-100, one, 2), (12, two, 1),
    ]
    got = run(spark, rows)
    assert got == brute(rows) and got
    assert run(spark, []) == [] and run(spark, [(1, one, 1)]) == [] and run(spark, [(100, one, 1)]) == []
    assert run(spark, [(100 * i, one, i % 2) for i in range(30)]) == brute([(100 * i, one, i % 2) for i in range(30)])


def test_many_labels_with_few_rows(spark, small):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).astype("float32").tolist(), i % 90) for i in range(200)]
    assert run(spark, rows, every=5) == brute(rows, every=5)
