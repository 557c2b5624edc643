"""SentencePiece encoding by tables of distinct marked words, and decoding.

The library writes each blank as the marker U+2581 and puts one before the text. If no piece of the model has a marker after
another character, a merge never crosses from a word into the marker behind it: a text is a row of marked words (a run of
markers and what follows it), and each of them is segmented by itself. Per block of whole texts the marked words become a
table of distinct ones (Arrow's dictionary encoding) and their positions; each distinct word is segmented once, a task
remembers the words of earlier blocks, and ids go back to the texts by position.

Defined results: a null text counts as empty; an empty text has no ids (``n_tokens`` 0, digests of the empty string); equal
texts give equal rows, repeated rows stay; a null doc_id stays null; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.bpe import utf8

MARK = "▁".encode()
#: Words remembered by a task, and the longest that is, in bytes. Only memory depends on them, never a result.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8_000_000


class Model:
    """One model file, proven to let no piece cross a marker."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        mark = MARK.decode()
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = [p for p in pieces if mark in p.lstrip(mark)]
        if crossing or self.library.encode("  a") != self._ids([b"\xe2\x96\x81" * 3 + b"a"])[0]:
            raise ValueError(f"words of this model are not segmented by themselves: {crossing[:3]}")
        self.known: dict[bytes, tuple[list[int], bytes, bytes]] = {}

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each marked word. The library puts the first marker there itself, but not before nothing."""
        found = self.library.encode([w[len(MARK) :].decode() for w in words], num_threads=1)
        alone = [self.library.piece_to_id(MARK.decode())]
        return [ids or alone for ids in found]

    def segmented(self, words: list[bytes]) -> list[tuple[list[int], bytes, bytes]]:
        """For each of these distinct words its ids, the same in decimal with a comma behind each, and what they decode to."""
        found = list(map(self.known.get, words))
        new = [i for i, made in enumerate(found) if made is None]
        if new:
            if len(self.known) > REMEMBERED:
                self.known = {}
            each = self._ids([words[i] for i in new])
            # Decoding takes the first marker away, as it does at the start of a text.
            texts = self.library.decode(each, num_threads=1)
            for i, ids, text in zip(new, each, texts, strict=True):
                found[i] = (ids, b"%s," % ",".join(map(str, ids)).encode(), b" " + text.encode())
                if len(words[i]) <= LONGEST:
                    self.known[words[i]] = found[i]
        return found

    def blocks(self, texts: Iterator[bytes]) -> Iterator[tuple[list[tuple[list[int], bytes, bytes]], list[np.ndarray]]]:
        """Per block its table of distinct words, segmented, and for each text the rows of its words in that table."""
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > BLOCK:
                yield self._block(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield self._block(held)

    def _block(self, texts: list[bytes]) -> tuple[list[tuple[list[int], bytes, bytes]], list[np.ndarray]]:
        marked = [MARK + t.replace(b" ", MARK) if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, marked)])
        joined = b"".join(marked)
        b = np.frombuffer(joined, dtype=np.uint8)
        if not len(b):
            return [], [np.zeros(0, np.int64) for _ in texts]
        at = np.flatnonzero((b[:-2] == MARK[0]) & (b[1:-1] == MARK[1]) & (b[2:] == MARK[2]))
        first = np.ones(len(at), dtype=bool)
        first[1:] = np.diff(at) != len(MARK)  # a run of markers is one
        first |= np.isin(at, ends)
        starts = at[first]
        offsets = np.append(starts, len(b)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        rows = words.indices.to_numpy(zero_copy_only=False)
        cuts = np.searchsorted(starts, ends)
        return self.segmented(words.dictionary.to_pylist()), [rows[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model per Python worker and file."""
    return Model(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        own = model(path)
        for batch in batches:
            out = []
            for table, texts in own.blocks(utf8(batch.column("text"))):
                out += [[i for row in rows.tolist() for i in table[row][0]] for rows in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids are none."""

    def run(batches):
        own = model(path).library
        for batch in batches:
            texts = own.decode([ids or [] for ids in batch.column("ids").to_pylist()], num_threads=1) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and its ids decoded again. Ids and their decoded texts are
    joined back by position, and only the digests leave the task."""

    def run(batches):
        own = model(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for table, texts in own.blocks(utf8(batch.column("text"))):
                lengths = np.array([len(ids) for ids, _, _ in table], dtype=np.int64)
                decimal, decoded = [d for _, d, _ in table], [t for _, _, t in table]
                for rows in texts:
                    each = rows.tolist()
                    counts.append(int(lengths[rows].sum()) if each else 0)
                    of_ids.append(hashlib.sha256(b"".join(map(decimal.__getitem__, each))[:-1]).hexdigest())
                    of_text.append(hashlib.sha256(b"".join(map(decoded.__getitem__, each))[1:]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
