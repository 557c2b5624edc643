"""Substring operators against brute force."""

import hashlib
import random

import pytest

from placewright.llm import bwt_repeats, fm_repeats, repeats

SCHEMA = "text string, doc_id long, key string, ranges int"


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "bé", "ccc", "dd", "e%", "漢字", "x\x00y"] + [f"w{i}" for i in range(40)]
    passage = [rng.choice(words) for _ in range(80)]
    made = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            a = rng.randint(0, 20)
            text[len(text) // 2 : len(text) // 2] = passage[a : a + rng.choice([49, 50, 51, 60])]
        made.append(rng.choice([" ", " ", "\n", "\t "]).join(text))
    made += [made[0], made[0], made[3] + " tail", "", "  \n ", None, "zz " * 300, "zz " * 300 + "end", "ab" * 400, "q" * 199, "q" * 199, "r" * 200, "r" * 201, "Hello world. " * 100]
    made += [" ".join(passage) * 30]
    return [(t, i * 7 % 101, "k", 1) for i, t in enumerate(made)]


def by_words(rows, window):
    first: dict[tuple, int] = {}
    units = {d: (t or "").encode().split() for t, d, *_ in rows}
    for d, u in units.items():
        for i in range(len(u) - window + 1):
            w = tuple(u[i : i + window])
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, u in units.items():
        gone = set()
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(u), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(u) if i not in gone)).hexdigest())
    return out


def by_bytes(rows, length):
    times: dict[bytes, int] = {}
    for t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            times[b[i : i + length]] = times.get(b[i : i + length], 0) + 1
    out = {}
    for t, d, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fm_repeats.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_words(rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_repeats.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_bytes(rows, 200)


def test_empty_table_and_missing_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fm_repeats.digests(empty).count() == 0 and bwt_repeats.digests(empty).count() == 0
    lone = spark.createDataFrame([("x " * 300, None, "k", 1), ("x " * 300, None, "k", 1)], SCHEMA)
    assert [r["n_removed"] for r in bwt_repeats.digests(lone).collect()] == [0, 0]


def test_texts_and_spans(spark):
    rows = [(" ".join(map(str, range(60))), 1, "", 0), ("new " + " ".join(map(str, range(60))) + " end", 2, "", 0)]
    got = {r["doc_id"]: r for r in fm_repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["kept"] == "new end" and [tuple(s) for s in got[2]["spans"]] == [(1, 61)] and got[1]["n_removed"] == 0


def test_anchors_in_many_surroundings_are_split(spark, monkeypatch):
    """A phrase as long as an anchor in many texts, some of which share a whole window around it."""
    monkeypatch.setattr(repeats, "HOT", 5)
    rng = random.Random(4)
    phrase = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        before, after = ([f"x{i % 20 if i % 4 == 0 else i}_{j}" for j in range(40)] for _ in "ab")
        rows.append((" ".join([*before, *phrase, *after, *[rng.choice("abc") for _ in range(5)]]), i, "k", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fm_repeats.digests(docs).collect()}
    assert got == by_words(rows, 50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_repeats.digests(docs).collect()}
    assert got == by_bytes(rows, 200)


@pytest.mark.parametrize("long", [46, 60, 120])
def test_long_phrases_leave_no_large_anchor(spark, monkeypatch, long):
    """A phrase beyond nine tenths of a window in many surroundings, some of them shared: no anchor of what is dealt holds more than a shard."""
    monkeypatch.setattr(repeats, "HOT", 5)
    monkeypatch.setattr(repeats, "SHARD", 6000)
    rng = random.Random(long)
    phrase = [f"p{i}" for i in range(long)]
    rows = []
    for i in range(150):
        before, after = ([f"x{i % 50 if i % 5 == 0 else i}_{j}" for j in range(30)] for _ in "ab")
        rows.append((" ".join([*before, *phrase, *after, *[rng.choice("abc") for _ in range(5)]]), i, "k", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    for by_word, window, within_one in ((True, 50, False), (False, 200, True)):
        found = repeats.repeated_places(repeats.bodies(docs), window, 8 if by_word else 24, by_word, within_one)
        distinct = repeats.distinct_segments(found)
        before = repeats.wide_anchors(distinct, window, by_word).count()
        dealt = repeats.narrowed(repeats.bodies(docs), distinct, window, by_word)[0]
        assert before > 0 and repeats.wide_anchors(dealt, window, by_word).count() == 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fm_repeats.digests(docs).collect()}
    assert got == by_words(rows, 50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_repeats.digests(docs).collect()}
    assert got == by_bytes(rows, 200)


def test_rows_that_share_an_id(spark):
    """Several texts with one id: each is judged by its own text."""
    a, b = " ".join(f"w{i}" for i in range(90)), " ".join(f"v{i}" for i in range(70))
    rows = [(a, 1, "k", 1), (b, 1, "k", 1), (b + " end", 2, "k", 1), (b + " end", 2, "k", 1), ("short", 2, "k", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in fm_repeats.digests(docs).collect())
    assert got == [(1, 70, 0), (1, 90, 0), (2, 1, 0), (2, 71, 70), (2, 71, 70)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in bwt_repeats.digests(docs).collect())
    assert got == sorted([(1, len(a), 0), (1, len(b), len(b)), (2, len(b) + 4, len(b) + 4), (2, len(b) + 4, len(b) + 4), (2, 5, 0)])
    kept = {(r["doc_id"], r["text"]) for r in bwt_repeats.drop_repeats(docs).collect()}
    assert kept == {(1, a), (1, ""), (2, ""), (2, "short")}
