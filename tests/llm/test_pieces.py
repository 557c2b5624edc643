import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from placewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "   a", "a ", "a  b   c ", "▁a", "▁", " ▁ x", "\x00x", "<s>hi</s>", "<unk> <0x41>", "a\tb\nc\r\n d", "　x", "ﬁn", "\U0001d54f\U0001f937\U0001f3fd‍♀️", "a" * 5000,
    " " * 300, "中文" * 900, "naïve é", "ไทย ก", "x � y", "1 234 567", "\n\n \n", " a",
]


def digest(ids, text):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def want(own, text):
    ids = own.encode(text or "")
    return digest(ids, own.decode(ids))


@pytest.mark.parametrize("block", [pieces.BLOCK, 40])
def test_equals_the_library(spark, monkeypatch, block):
    own = SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    texts = [None, *ODD, *("".join(rng.choice("ab ▁\n1é中.") for _ in range(rng.randrange(200))) for _ in range(60))]
    monkeypatch.setattr(pieces, "BLOCK", block)
    made = pieces.Model(PATH)
    got = [ids for table, rows in made.blocks(iter([(t or "").encode() for t in texts])) for ids in ([i for r in row.tolist() for i in table[r][0]] for row in rows)]
    assert got == [own.encode(t or "") for t in texts]


def test_round_trip_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = SentencePieceProcessor(model_file=PATH)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.round_trip(docs, PATH).collect()}
    assert got == {r["doc_id"]: want(own, r["text"]) for r in docs.collect()}


def test_rows_as_they_come(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, "c", 6), (2, None, 7), (3, "", 8), *((10 + i, t, 0) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    own = SentencePieceProcessor(model_file=PATH)
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in pieces.round_trip(docs, PATH).collect())
    assert got == sorted((str(i), *want(own, t)) for i, t, _ in rows)
    encoded = pieces.encode_documents(docs, PATH)
    assert sorted((str(r[0]), r[1]) for r in encoded.collect()) == sorted((str(i), own.encode(t or "")) for i, t, _ in rows)
    assert sorted((str(r[0]), r[1]) for r in pieces.decode_documents(encoded, PATH).collect()) == sorted((str(i), own.decode(own.encode(t or ""))) for i, t, _ in rows)
    assert pieces.round_trip(docs.limit(0), PATH).collect() == []
    assert pieces.encode_documents(docs.limit(0), PATH).collect() == []


def test_a_word_is_segmented_once(monkeypatch):
    made = pieces.Model(PATH)
    asked = []
    ids = made._ids
    monkeypatch.setattr(made, "_ids", lambda words: asked.extend(words) or ids(words))
    list(made.blocks(iter([b"a b a", b"b a c", b"a"])))
    list(made.blocks(iter([b"c b d"])))
    assert len(asked) == len(set(asked)) == 4
