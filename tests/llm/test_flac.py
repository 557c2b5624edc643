"""Exact round trips, and damaged streams."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from placewright.llm import flac

SCHEMA = "text string, doc_id long, media string, n_bytes long"


def payloads():
    rng = random.Random(1)
    made = [bytes(rng.randrange(256) if i % 2 else rng.choice(b"etaoin ") for _ in range(n)) for i, n in enumerate([1, 63, 64, 65, 1000, 1023, 1024, 1025, 5000, 20000] * 2)]
    wave = (100 + 80 * np.sin(np.arange(5000) / 9)).astype(np.uint8).tobytes()
    like_headers = (b"\xff\xf8\x70\x02\x01\x03\xff" * 700)
    return [flac.padded(p) for p in [*made, b"", wave, like_headers, bytes(4096), bytes(range(256)) * 9]]


def test_round_trip():
    own = payloads()
    media = flac.encode_all(own)
    assert flac.Frames(media).payloads() == own
    wave = own.index(flac.padded((100 + 80 * np.sin(np.arange(5000) / 9)).astype(np.uint8).tobytes()))
    assert len(media[wave]) < 0.6 * len(own[wave])  # predicted, not only stored
    kinds = {flac.Frames([m]).data[42 + flac.Frames.header(m, 42)[2]] >> 1 for m in media}
    assert 1 in kinds and kinds & {0x23} and kinds & {8, 9, 10}  # verbatim, linear and fixed predictors


def test_look_alike_header_inside_a_frame():
    first = flac.encode_all([bytes([128] * 1024 + [7] * 1024)])[0]
    second = first[42 + len(flac.encode_all([bytes([128] * 1024)])[0]) - 42 :]
    head = second[: flac.Frames.header(second, 0)[2]]
    payload = flac.padded(bytes(b ^ 0x80 for b in (bytes(random.Random(2).randrange(256) for _ in range(300)) + head) * 6))
    assert flac.Frames(flac.encode_all([payload])).payloads() == [payload]


@pytest.mark.parametrize("at", [50, 200, -1, 30])
def test_damage_is_noticed(at):
    media = bytearray(flac.encode_all([flac.padded(b"some text " * 400)])[0])
    media[at] ^= 4
    with pytest.raises(ValueError):
        flac.Frames([bytes(media)]).payloads()


def long_payload():
    rng = random.Random(3)
    return flac.padded(bytes(rng.choice(b"etaoin shrdlu") for _ in range(150_000)) + bytes(rng.randrange(256) for _ in range(50_000)))


def test_seek_points():
    payload = long_payload()
    media = flac.encode_all([payload, b"x" * 64])
    assert [flac.samples_at(media[0], at, n) for at, n in ((0, 10), (32767, 2), (32768, 1), (100_001, 70_000), (len(payload) - 3, 99))] == [payload[0:10], payload[32767:32769], payload[32768:32769], payload[100_001:170_001], payload[-3:]]
    assert flac.samples_at(media[1], 60, 4) == b"xxxx"
    cut = flac.pieces(media[0], 1)
    assert [sample for sample, _ in cut] == list(range(0, len(payload), flac.SEEK * flac.BLOCK))
    broken = bytearray(media[0])
    broken[46 + 18 + 15] ^= 1  # the second point's offset
    with pytest.raises(ValueError):
        flac.pieces(bytes(broken), 1)


def test_long_streams_are_read_in_pieces(monkeypatch):
    payload = long_payload()
    media = flac.encode_all([payload])
    whole, parts = flac.Digest(), flac.Digest()
    whole.add(flac.Frames(media).samples)
    monkeypatch.setattr(flac, "GROUP", 40_000)
    assert flac.encode_all([payload]) == media  # the same stream, however many frames are worked on at once
    steps = list(flac.decoded(media))
    assert len(steps) > 2
    for _, own in steps:
        parts.add(own)
    assert parts.row(media[0]) == whole.row(media[0])


def test_query_columns(spark):
    texts = ["", None, "Hello wörld", "x" * 64, "漢字 " * 3000, "same", "same"]
    docs = spark.createDataFrame([(t, i, "m", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in flac.read_back(flac.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(raw), len(p))
        assert got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(p[-64:])
    assert got[5].asDict() | {"doc_id": 0} == got[6].asDict() | {"doc_id": 0}
    blocks = flac.pcm_blocks(flac.store(docs)).where("doc_id = 4").orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [1024 * i for i in range(len(blocks))]
    assert b"".join(bytes(x ^ 0x80 for x in b["pcm"]) for b in blocks)[: len(texts[4].encode())] == texts[4].encode()
    assert flac.read_back(flac.store(docs.limit(0))).count() == 0
