"""Segments against brute force, and held-out accuracy."""

import math
import random
import zlib

import numpy as np

from placewright.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, evidence double, toxic string"


def maximal_segments(w):
    """By definition: the best segment, then the same left and right of it."""
    if not len(w) or max(w) <= 0:
        return []
    best = (0.0, 0, 0)
    for i in range(len(w)):
        total = 0.0
        for j in range(i, len(w)):
            total += w[j]
            if total > best[0] + 1e-12:
                best = (total, i, j + 1)
    _, a, b = best
    left = maximal_segments(w[:a])
    right = [(x + b, y + b, s) for x, y, s in maximal_segments(w[b:])]
    return [*left, (a, b, best[0]), *right]


def test_scan_finds_every_maximal_segment():
    rng = random.Random(3)
    model = T.Model({f"t{v}": v / 4 for v in range(-8, 13)}, 0.3, 1.0, 1e-9, 1.0, 0.0)
    for _ in range(300):
        n = rng.randint(0, 25)
        tokens = [f"t{v}" for v in rng.sample(range(-8, 13), min(n, 20))]
        w = [model.weights[t] - 0.3 for t in tokens]
        got = [(a, b) for a, b, _ in model.passages(tokens)]
        want = [(a, b) for a, b, _ in maximal_segments(w)]
        assert got == want


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    bad = ["grobian", "lumpkin", "vilestem" + "a", "vilestem" + "b"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad[:2]) if rng.random() < 0.5 else "vilestem" + rng.choice("abcdefgh") for _ in range(5)]
        docs.append((i, " ".join(words), "en", 1.0, "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = corpus()
    odd = [(5000, None, "en", 0.0, ""), (5001, "", "en", 0.0, ""), (5002, "...", "en", 0.0, ""), (5003, docs[0][1], "xx", 0.0, ""), (5004, "fine words " * 20000, "en", 0.0, "")]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    told = spark.createDataFrame([*labels, (5000, 1, 0), (777777, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(df, told)
    got = {r["doc_id"]: r for r in T.scores(df, model).collect()}
    assert len(got) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d]["predicted"], y) for d, _, y in labels if got[d]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] == got[5002]["score"] < 0.5 and got[5003]["score"] == got[0]["score"]
    kept = {r["doc_id"] for r in T.reject_toxic(df, model).collect()}
    assert kept == {d for d, r in got.items() if not r["predicted"]}
    spans = {r["doc_id"]: r for r in T.evidence(df, model, spans=True).collect()}
    assert spans[0]["passages"] and abs(sum(p["evidence"] for p in spans[0]["passages"]) - spans[0]["evidence"]) < 1e-9


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(2, 300)
    df = spark.createDataFrame(docs, SCHEMA)
    flipped = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, q, y in labels]
    a, b = (T.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a == b


def test_no_labels_and_empty_table(spark):
    docs, labels = corpus(3, 30)
    df = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.fit(df, none) is None and {r["score"] for r in T.scores(df, None).collect()} == {0.0}
    assert T.reject_toxic(df, None).count() == 30
    assert T.scores(df.limit(0), T.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0


def test_scan_counts_every_occurrence():
    rng = random.Random(4)
    model = T.Model({f"t{v}": v / 4 + rng.random() / 100 for v in (-8, -5, -3, -2, -1, 1, 2, 5, 7)}, 0.3, 1.0, 1e-9, 1.0, 0.0)  # no sums are 0
    for _ in range(300):
        tokens = rng.choices(list(model.weights), k=rng.randint(0, 40))
        want = maximal_segments([model.weights[t] - 0.3 for t in tokens])
        got = model.passages(tokens)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([e for *_, e in got], [-np.log(-np.expm1(-1e-9 * len(tokens) * np.exp(-s))) for *_, s in want])


def test_passage_of_words_that_stood_scattered_before():
    model = T.Model({"grobian": 3.0, "lumpkin": 3.0}, 0.3, 1.0, 0.1, 1.0, 0.0)
    dense = ["grobian", "lumpkin"] * 4
    tokens = ["grobian", *["plain"] * 500, "lumpkin", *["plain"] * 500, *dense, *["plain"] * 500, *dense]
    assert [(a, b) for a, b, _ in model.passages(tokens)] == [(1002, 1010), (1510, 1518)]


def test_tokens_are_the_same_in_fit_and_scan(spark):
    """Letters and digits of any script, and marks, which part tokens in both."""
    text = "".join(chr(c) for c in [*range(0x20, 0x2FF), *range(0x300, 0x36F), *range(0x370, 0x52F), *range(0x5D0, 0x64F), *range(0x900, 0x97F), *range(0xE01, 0xE5B), *range(0x3041, 0x30FF), *range(0x4E00, 0x4E50), 0xB2, 0xBD, 0x2160, 0xFF21, 0xFF11])
    text = " ".join("x" + c + "y" for c in text)
    java = [t for t in spark.createDataFrame([(text,)], "t string").selectExpr(f"split(lower(t), r'{T.SEPARATORS}')").first()[0] if t]
    assert java == T.TOKEN.findall(text.lower())


def test_scale_follows_the_background(spark):
    """With K from random texts about as many of them have a segment of chance 1/m as should."""
    rng = random.Random(6)
    weights = {f"w{i}": rng.uniform(-1, 1.2) for i in range(200)}
    shares = np.full(200, 1 / 200)
    drift = 0.6
    rate = T.solve_rate(np.array([*weights.values()]) - drift, shares)
    texts = [(" ".join(rng.choice(list(weights)) for _ in range(400)),) for _ in range(1500)]
    raw = T.Model(weights, drift, rate, 1.0, 1.0, 0.0)
    scale = T.background_scale(spark.createDataFrame(texts[:1000], "text string"), raw)
    told = T.Model(weights, drift, rate, scale, 1.0, 0.0)
    chances = [math.exp(-max((e for *_, e in told.read(t)), default=0.0)) for (t,) in texts[1000:]]
    assert 0.02 < np.mean([c <= 0.1 for c in chances]) < 0.25


def test_every_passage_of_a_repeated_one(spark):
    model = T.Model({"bad": 3.0, "worse": 3.0}, 0.5, 1.0, 0.1, 1.0, 0.0)
    tokens = ["bad", "worse", "bad"] + ["calm"] * 60 + ["bad", "worse", "bad"]
    assert [(a, b) for a, b, _ in model.passages(tokens)] == [(0, 3), (63, 66)]


def test_rejection_sends_no_rows_through_arrow(spark):
    """Texts go to Python a few at a time and rows stay where they are: Arrow batches of whole rows, there and back, took 3 GB of an executor."""
    model = T.Model({"bad": 5.0}, 0.3, 1.0, 0.1, 4.0, -1.0)
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "bad bad bad bad", "c"), (4, "a good day", "d")], "doc_id long, text string, source string")
    kept = T.reject_toxic(df, model)
    assert kept.schema == df.schema and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [(1, None, "a"), (2, "", "b"), (4, "a good day", "d")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InArrow" not in plan
