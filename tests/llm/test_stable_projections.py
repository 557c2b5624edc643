"""Neighbours against brute force."""

import numpy as np
import pytest

from placewright.llm import stable_projections as S

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, v int"


def brute(vectors, k, every):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in vectors.items() if i != q)[:k]
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_recall_ties_and_odd_rows(spark, shard_rows):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 32)).astype(np.float32)
    x[100:400] = x[100]  # one vector that a third of the rows have
    rows = [(i, v.tolist(), 0, "r", 1) for i, v in enumerate(x)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 32), (1300, [None] * 32), (1400, [float("nan")] * 32), (1500, [float("inf")] + [1.0] * 31), (1600, [1.0, 2.0])]
    docs = spark.createDataFrame([*rows, rows[200], *((i, v, 0, "r", 1) for i, v in odd)], SCHEMA)
    got: dict = {}
    for r in S.nearest(docs, k=10, every=20, shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute({i: v.astype(float) for i, v in enumerate(x)}, 10, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        ordered = [found[i] for i in range(1, 11)]
        assert ordered == sorted(ordered)
        hits += len({i for _, i in ordered} & {i for _, i in want[q]})
        if 100 <= q < 400:
            assert [i for _, i in ordered] == [i for _, i in want[q]]
    assert hits >= 0.97 * 10 * len(want)


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (1, [1.0, 1.0], 0, "", 0), (2, [3.0, 1.0], 0, "", 0)], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in S.nearest(docs).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, pytest.approx(5**0.5))]
    assert S.nearest(docs.limit(0)).count() == 0
    assert S.nearest(docs.where("vec_id > 0")).count() == 0


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 100_000)
    for q in (5.0, 10.0, 17.0):
        assert abs(S.chi_square_cdf(np.array([q]), 8)[0] - (x < q).mean()) < 0.01
