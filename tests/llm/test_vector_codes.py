import hashlib
import math
import random
from collections import defaultdict

from placewright.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(r[0], r[2], [math.floor(scale * x) for x in r[1]]) for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]))
    if not kept:
        return []
    d = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == d]
    w = d // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                held[p, best(v, p)[1]].append(cut(v, p))
        for (p, e), each in held.items():
            books[p][e] = [sum(c) // len(each) for c in zip(*each, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for i, label, v in kept:
        found = [best(v, p) for p in range(parts)]
        error = sum(x for x, _ in found)
        by[label] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    return sorted(((i, code, error, by[label], sha) for i, code, error, label in out), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.report(df, **options).collect()), key=str)


def test_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype("float32").tolist(), int(rng.integers(3))) for i in range(300, 0, -1)]
    got = run(spark, rows, parts=4, entries=8)
    assert got == brute(rows, parts=4, entries=8) and len(got) == 300
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    one, two = [0.5, -0.25, 1.0, 0.0], [0.1, 0.2, 0.3, 0.4]
    rows = [(3, one, 1), (3, one, 1), (3, two, 1), (5, None, 1), (6, [1.0, None, 0.0, 0.0], 1), (7, [float("nan"), 0.0, 0.0, 0.0], 1), (8, [float("inf"), 0.0, 0.0, 0.0], 1), (9, [], 1), (None, two, None), (10, one, None), (11, [1.0, 2.0], 1), (-4, [0.0] * 4, 2)]
    got = run(spark, rows, parts=2, entries=3)
    assert got == brute(rows, parts=2, entries=3) and len(got) == 6
    assert run(spark, [], parts=2) == []
    assert run(spark, [(1, None, 1)], parts=2) == []


def test_ties_go_to_the_lower_entry(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5]) for _ in range(4)], i % 2) for i in range(80)]
    assert run(spark, rows, parts=2, entries=64) == brute(rows, parts=2, entries=64)


def test_codes_decode_to_entries(spark):
    rows = [(i, [i / 4, -i / 4, 0.0, 1.0], 0) for i in range(6)]
    codes, books = vector_codes.compressed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), parts=2, entries=6)
    got = {r["id"]: r["v"] for r in vector_codes.decoded(codes, books).collect()}
    assert got == {i: [64 * i, -64 * i, 0, 256] for i in range(6)}
    assert vector_codes.books_table(spark, books).count() == 12
    assert {r["error"] for r in codes.collect()} == {0}
