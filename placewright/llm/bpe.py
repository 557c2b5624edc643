"""Byte-pair encoding by forced boundaries, and decoding.

A merge joins two neighbouring pieces into one vocabulary token, so two neighbouring bytes that stand side by
side in no token can never end up in one: between them there is a certain cut. The encoder marks all such cuts
of a text at once, encodes each fragment on its own (each distinct fragment once per task) and concatenates.

The vocabulary's pre-tokenizer looks at its surroundings in three places, and there no cut is made even though
the byte pair alone would allow it: after white space (a run of blanks splits by what follows it), before an
apostrophe (contractions), and inside a UTF-8 character. Added tokens count as vocabulary tokens, so none is cut.

Defined results: a null text counts as empty; an empty text has no ids (``n_tokens`` 0, digests of the empty
string); equal texts give equal rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct fragments remembered by a task, and the longest that is. Only memory depends on them, never a result.
REMEMBERED, LONGEST = 400_000, 64
#: Fragments handled at once, which bounds the memory for very long texts.
SLICE = 100_000
#: Bytes of text handled at once.
CHUNK = 2_000_000


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary file, with the table of byte pairs between which every text may be cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        self.sizes = np.zeros(len(self.bytes_of), dtype=np.int64)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        joined = np.zeros((256, 256), dtype=bool)
        for token, i in vocabulary.items():
            raw = token.encode() if token in added else bytes(letters[c] for c in token)
            self.bytes_of[i] = raw
            self.sizes[i] = len(raw)
            b = np.frombuffer(raw, dtype=np.uint8)
            joined[b[:-1], b[1:]] = True
        self.cut = ~joined & self._free_of_context()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _free_of_context() -> np.ndarray:
        """Byte pairs around which the pre-tokenizer splits alike, whatever stands further away."""
        free = np.ones((256, 256), dtype=bool)
        blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
        free[sorted({c.encode()[-1] for c in blanks}), :] = False
        free[:, ord("'")] = False
        free[:, 0x80:0xC0] = False  # inside a character
        return free

    def fragments(self, data: bytes) -> Iterator[list[bytes]]:
        """``data`` cut at every forced boundary, in lists of at most SLICE fragments."""
        b = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1
        for i in range(0, len(at) + 1, SLICE):
            starts = [0] if i == 0 else [int(at[i - 1])]
            own = at[i : i + SLICE].tolist()
            # The last fragment of a slice ends where the next slice starts.
            starts += own if i + SLICE > len(at) else own[:-1]
            ends = own if i + SLICE <= len(at) else [*own, len(data)]
            yield [data[x:y] for x, y in zip(starts, ends, strict=True)]

    def encode(self, data: bytes) -> np.ndarray:
        """The ids of a UTF-8 text, as unsigned 32-bit integers."""
        if not data:
            return np.zeros(0, dtype="<u4")
        return np.frombuffer(b"".join(self._encoded(data)), dtype="<u4")

    def _encoded(self, data: bytes) -> Iterator[bytes]:
        for parts in self.fragments(data):
            found = list(map(self.known.get, parts))
            if None in found:
                at = [i for i, ids in enumerate(found) if ids is None]
                made = self._learn({parts[i] for i in at})
                for i in at:
                    found[i] = made[parts[i]]
            yield b"".join(found)

    def _learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """The ids of fragments that are not known; all but the long ones are remembered."""
        if len(self.known) > REMEMBERED:  # the last two generations stay, so frequent fragments do
            self.older, self.known = self.known, {}
        made = {p: self.older[p] for p in missing if p in self.older}
        new = [p for p in missing if p not in made]
        made.update(zip(new, self._ids(new), strict=True))
        self.known.update((p, ids) for p, ids in made.items() if len(p) <= LONGEST)
        return made

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each fragment. Between two that may stand side by side with a forced cut the library needs no call of its own:
        they are encoded as one text, and the lengths of its tokens say which belong to which."""
        if not parts:
            return []
        last, first = (np.frombuffer(bytes(p[i] for p in parts), dtype=np.uint8) for i in (-1, 0))
        breaks = [0, *(np.flatnonzero(~self.cut[last[:-1], first[1:]]) + 1).tolist(), len(parts)]
        texts = [b"".join(parts[x:y]) for x, y in zip(breaks, breaks[1:], strict=False)]
        made = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]
        out = []
        for (x, y), ids, text in zip(zip(breaks, breaks[1:], strict=False), made, texts, strict=True):
            ends = np.cumsum(self.sizes[ids])
            stops = np.cumsum([len(p) for p in parts[x:y]])
            at = np.searchsorted(ends, stops)
            if not len(ids) or ends[-1] != len(text) or (ends[at] != stops).any():
                raise ValueError("a token runs over a forced boundary")
            raw, at = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
            out += [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, as the library has it."""
        table = self.bytes_of
        raw = b"".join(b"".join(map(table.__getitem__, ids[i : i + SLICE].tolist())) for i in range(0, len(ids), SLICE))
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty, a small part of the batch at a time."""
    raw = column.cast(pa.large_binary())
    for i in range(0, len(raw), 256):
        for x in raw.slice(i, 256).to_pylist():
            yield x or b""


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode(t).astype(np.int32) for t in utf8(batch.column("text"))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and its ids decoded again, with only
    the digests kept (ids of a corpus are larger than its texts, so they don't leave the task)."""

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in utf8(batch.column("text")):
                ids = own.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
