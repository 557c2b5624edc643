"""Encoding against the library, packing against its own rules."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from placewright.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "text string, doc_id long, ids string, length int"
LETTERS = [*"aAzqx'sreld  \n\t.,%0123é\xa0漢字\x1c😀", "<|endoftext|>", "<|endof", "'s", "'ll", "'re", "   ", "\r\n", "ab12", "…", " "]


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choices(LETTERS, k=rng.randint(0, 40))) for _ in range(1500)]
    return [*made, "", "Hello world, it's 2024.", "x" * 5000, "ab " * 4000, "\n" * 300, "日本語" * 500, "same", "same"]


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for t in texts():
        ids = own.encode(t.encode())
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert sum(map(len, own.fragments(b"one two, three"))) > 2


def test_slices_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    library, own = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    for t in texts()[:300] + ["some words in a row that are more than three " * 5]:
        assert own.encode(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids


def test_invalid_utf8_ids_decode_as_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    ids = [i for i in range(0, 256)] + [50256]
    assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark):
    rows = [(None, 1, "x", 0), ("", 2, "x", 0), ("Hello  wörld", 3, "x", 0), ("Hello  wörld", 3, "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, PATH).collect())
    ids = Tokenizer.from_file(PATH).encode("Hello  wörld", add_special_tokens=False).ids
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == (1, 0, empty, empty) and got[1] == (2, 0, empty, empty)
    assert got[2] == got[3] == (3, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256("Hello  wörld".encode()).hexdigest())
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()} == {1: "", 2: "", 3: "Hello  wörld"}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def check(rows, capacity):
    """Pieces of one sequence fill it from 0 without gaps."""
    held: dict = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_documents_are_cut_and_placed(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["one", "zwölf", "漢字", "%%"]) for _ in range(rng.choice([0, 3, 50, 200, 900, 2500]))), i, "x", 1) for i in range(80)] + [(None, 200, "x", 1), ("twin", 201, "x", 1), ("twin", 201, "x", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    library = Tokenizer.from_file(PATH)
    want: dict = {}
    for text, doc_id, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)])):
            want.setdefault((doc_id, piece), []).append((a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    found: dict = {}
    for r in got:
        found.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert found == want
    used, total = check(got, 1024), sum(r["length"] for r in got)
    assert used <= math.ceil(total / 1024) * 1.06 + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([30, 400, 30_000]))
    lengths = rng.integers(1, 1025, n) if seed % 2 else np.clip(rng.lognormal(5.5, 1, n).astype(int), 1, 1024)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    made = packing.plan(counts, 1024)
    seen: dict = {}
    fill = np.zeros(made.sequences, dtype=np.int64)
    for length, rank, count, first, offset in sorted(made.rows, key=lambda r: r[4]):
        assert (fill[first : first + count] == offset).all()
        fill[first : first + count] += length
        seen.setdefault(length, []).append((rank, count))
    assert fill.max() <= 1024 and (fill > 0).all()
    for length, own in seen.items():
        at = 0
        for rank, count in sorted(own):
            assert rank == at
            at += count
        assert at == counts[length]
    assert made.sequences <= math.ceil(lengths.sum() / 1024) * 1.06 + 1


def test_hot_length_is_ranked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 10)
    pieces = spark.createDataFrame([(i, 0, 0, 300 if i % 3 else 700, 1, i) for i in range(300)], packing.PIECE)
    assert check(packing.packed(pieces, 1024).collect(), 1024) <= 134
    held = packing.sequences(packing.packed(pieces, 1024)).collect()
    assert sum(len(r["holds"]) for r in held) == 300


def test_repeated_and_missing_ids_and_one_huge_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 10)
    rows = [("same words", 1)] * 60 + [("other", None)] * 30 + [("long text " * 60_000, 2)]
    got = packing.pack_documents(spark.createDataFrame(rows, "text string, doc_id long"), PATH).collect()
    check(got, 1024)
    assert sum(r["doc_id"] == 1 for r in got) == 60 and sum(r["doc_id"] is None for r in got) == 30
    assert [r["piece"] for r in sorted((r for r in got if r["doc_id"] == 2), key=lambda r: r["start"])] == list(range(sum(r["doc_id"] == 2 for r in got)))
    told = bpe.round_trip(spark.createDataFrame([("x y", None), (None, 4), ("x y", None)], "text string, doc_id long"), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in told) == [(0, 2), (0, 2), (4, 0)]
