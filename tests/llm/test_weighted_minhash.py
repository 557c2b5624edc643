"""Near duplicates against all pairs."""

import itertools
import random

import numpy as np

from placewright.llm import weighted_minhash as W
from placewright.llm.staging import block_counts, block_join

SCHEMA = "text string, doc_id long, a long, key string"


def brute(rows, cells=1 << 19, rarest=500, threshold=0.8):
    cut = W.Shingler(5)
    sets = {d: cut((t or "").encode()) for t, d, *_ in rows}
    seen = np.zeros(cells, dtype=np.int64)
    for shingles, *_ in sets.values():
        for own in W.cells_of(shingles, cells):
            seen[np.unique(own)] += 1
    table = W.idf(seen, sum(1 for s, *_ in sets.values() if len(s)), rarest)
    weighed = {d: (s, W.weighed(s, times, table)) for d, (s, times, _) in sets.items()}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(weighed[a][0]) and len(weighed[b][0]) and W.weighted_jaccard(weighed[a], weighed[b]) >= threshold:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return {d: root(d) for d in sets}


def test_classes_equal_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 150))), i, 1, "x") for i in range(120)]
    for i in range(120, 240):  # near and far copies, copies of copies
        words = rows[rng.randrange(len(rows))][0].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6, 30])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((" ".join(words), i, 1, "x"))
    rows += [(None, 900, 1, "x"), ("", 901, 1, "x"), ("", 902, 1, "x"), (" \n", 903, 1, "x"), ("one two", 904, 1, "x"), ("One  two", 905, 1, "x"), ("word " * 20000, 906, 1, "x"), ("word " * 19000, 907, 1, "x")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in W.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert got[905] == 904 and got[902] == 902 and got[907] == 906


def test_chain_is_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90)], "a long, b long")
    got = {r["id"]: r["least"] for r in W.classes(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90}


def test_empty_and_kept_rows(spark):
    assert W.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(text, 5, 1, "p"), (text, 3, 1, "q"), ("other words are here today", 9, 1, "r")], SCHEMA)
    assert sorted(r["doc_id"] for r in W.one_of_each(docs).collect()) == [3, 9]


def test_draws_agree_as_often_as_sets(spark):
    rng = np.random.default_rng(0)
    draw, agree, real = W.Sampler(36), [], []
    for _ in range(200):
        s = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
        w, v = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
        agree.append((draw(s, w) == draw(s, v)).mean())
        real.append(W.weighted_jaccard((s, w), (s, v)))
    assert abs(np.mean(agree) - np.mean(real)) < 0.02


def test_crowd_around_one_source(spark):
    """Many copies too far from their source and from each other, with a few true pairs among them."""
    rng = random.Random(11)
    source = [f"s{i}" for i in range(200)]
    rows = [(" ".join(source), 0, 1, "x")]
    for i in range(1, 160):
        words = list(source)
        for at in rng.sample(range(200), rng.choice([2, 6, 8, 12, 30])):
            words[at] = f"n{i}_{at}"
        rows.append((" ".join(words), i, 1, "x"))
        if i % 9 == 0:  # one that resembles this copy alone
            words[rng.randrange(200)] = f"m{i}"
            rows.append((" ".join(words), 1000 + i, 1, "x"))
    got = {r["doc_id"]: r["class_id"] for r in W.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_room_is_what_another_text_has_too(spark):
    rows = [("a b c d e f", 1), ("a b c d e g", 2), ("h i j k l", 3), (None, 4)]
    table = spark.sparkContext.broadcast(np.full(16, 2.0, dtype=np.float32))
    got = {r["b"]: sum(r["rooms"]) for r in W.shared_room(spark.createDataFrame(rows, "text string, doc_id long"), table, 5).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 0.0}


def test_texts_are_bounded_in_buckets_of_any_size(spark):
    """The texts whose shingles are looked at grow with the rows, not from some size of bucket on, and the bound holds in all."""
    alike, seen = W.Alike(0.8, ["code0"], 0), []

    def shared(ids):
        seen.append(ids.count())
        return ids.selectExpr("doc_id AS b", "array(if(doc_id < 2, 1.0D, 0.5D)) AS rooms")

    for n in (20, 200):
        members = spark.createDataFrame([(i, n, 1.0, 0, [1]) for i in range(n)], "b long, central long, mass double, code0 long, keys array<long>")
        sizes = spark.createDataFrame([(1, n)], "key long, n long")
        pairs = W.apart_pairs(members, spark.createDataFrame([], "id long, least long"), sizes, n, alike, shared)
        assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    assert seen == [20, 200]


def test_weights_follow_shares_of_documents(spark):
    """Frequencies from the sketch against counts of the shingles themselves, and the same shares at any size."""
    rng = random.Random(3)
    rows = [(" ".join(["common words that all have"] * (i % 2) + [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(40)]), i) for i in range(400)]
    seen, n = W.document_frequencies(spark.createDataFrame(rows, "text string, doc_id long"), 5, 1 << 19)
    cut, table = W.Shingler(5), W.idf(seen, 400, 500)
    shingles, times, _ = cut(b"common words that all have")
    assert n == 400 and abs(W.weighed(shingles, times, table)[0] - (1 + np.log(2))) < 0.01
    assert np.allclose(W.idf(np.array([0, 1, 50, 400]), 400, 100)[1:], W.idf(np.array([0, 1000, 50_000, 400_000]), 400_000, 100)[1:])


def test_samples_that_may_differ():
    assert W.differences_allowed(36, 0.8) in range(16, 20)
    rng = np.random.default_rng(2)
    differ = (rng.random((200_000, 36)) < 0.2 * 15 / 16).sum(axis=1)
    assert (differ > W.differences_allowed(36, 0.8)).mean() < 1e-4


def test_codes_count_differences(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(50):
        a, b = rng.integers(0, 2**64, 36, dtype=np.uint64), rng.integers(0, 2**64, 36, dtype=np.uint64)
        same = rng.random(36) < 0.5
        b = np.where(same, a, b)
        rows.append((*map(int, W.packed_codes(a)), *map(int, W.packed_codes(b))))
        want.append(int(((a >> np.uint64(60)) != (b >> np.uint64(60))).sum()))
    df = spark.createDataFrame(rows, "a0 long, a1 long, a2 long, b0 long, b1 long, b2 long")
    got = [r[0] for r in df.select(W.differences([df.a0, df.a1, df.a2], [df.b0, df.b1, df.b2])).collect()]
    assert got == want


def test_hot_keys_are_dealt_to_blocks(spark):
    left = spark.createDataFrame([(i % 7 if i > 4000 else 1, i) for i in range(5000)], "k int, i long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k int, v string")
    blocks = block_counts(left.groupBy("k").count().withColumnRenamed("count", "n"), "k", 5000, per=100, keys=10)
    assert {r["k"]: r["_blocks"] for r in blocks.collect()} == {1: -(-left.where("k = 1").count() // 100)}
    got = block_join(left, right, "k", "i", blocks, "left")
    assert got.count() == 5000 and got.where("v IS NULL").count() == left.where("k = 6").count()


def test_missing_and_repeated_ids(spark):
    text = " ".join(map(str, range(50)))
    rows = [(text, None, 1, "p"), (text, 3, 1, "q"), ("quite other words than those above", None, 1, "r"), ("one more text of a few words", 7, 1, "s"), ("and the same id with other words", 7, 1, "t")]
    got = sorted(((r["doc_id"] or -1, r["class_id"] or -1) for r in W.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(-1, -1), (-1, 3), (3, 3), (7, 7), (7, 7)]
