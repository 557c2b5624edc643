"""Exact repeats on bytes: common prefixes from a Burrows-Wheeler transform, by increasing value up to a bound.

The suffixes of a shard's segments (see ``repeats``) stand in one sorted order. Starting with the interval of the empty
string, every interval is extended backward by each byte that precedes it; the strings of length l met in round l
are exactly the l-byte strings of the shard. Where such a string's interval ends at a place that has no value yet, the
neighbours there share l - 1 bytes, and only such intervals are extended again. After round ``length`` every place without
a value is one whose neighbours share ``length`` bytes or more: those suffixes start repeats. Nothing longer is computed.

Defined results: a text is its UTF-8 bytes, null as empty; matches never cross documents; shorter texts lose nothing;
all places of a repeat are removed, in equal texts all bytes. Rows that share a doc_id are texts of their own, and equal
rows stand twice. Rows without one lose nothing. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.bpe import utf8
from placewright.llm.staging import unused
from placewright.llm.repeats import Segment, bodies, merged, repeated_ranges, runs
from placewright.llm.succinct import FMIndex

#: Bytes of an anchor.
ANCHOR = 72


def short_prefixes(index: FMIndex, n: int, bound: int) -> np.ndarray:
    """For each rank, whether its suffix shares fewer than ``bound`` symbols with the one before."""
    told = np.zeros(n + 1, dtype=bool)
    told[0] = told[n] = True
    low, high, one = np.zeros(1, dtype=np.int64), np.full(1, n), np.zeros(0, dtype=np.int64)
    step = index.step()
    for _ in range(bound):
        _, symbol, first, end = index.tree.children(low, high)
        real = symbol > 0  # a string never runs over the end of a segment
        base = index.start[symbol[real]]
        # An interval of one rank has one extension.
        one = step[one[index.last[one] > 0]]
        low, high = np.concatenate([base + first[real], one]), np.concatenate([base + end[real], one + 1])
        # An interval that starts after separators has the suffixes that end earlier just before it.
        fresh = ~told[high] | ~told[low]
        told[high] = told[low] = True
        low, high = low[fresh], high[fresh]
        single = high - low == 1
        one, low, high = low[single], low[~single], high[~single]
        if not len(low) and not len(one):
            break
    return told[:n]


def search(shard: list[Segment], length: int) -> Iterator[tuple[Segment, int, int, int]]:
    lengths = np.array([len(s.text) for s in shard])
    raw = np.frombuffer(b"\0".join(s.text for s in shard) + b"\0", dtype=np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(256, dtype=np.int64)
    inside = np.ones(len(raw), dtype=bool)
    inside[ends] = False
    used = np.unique(raw[inside])
    symbols[used] = np.arange(1, len(used) + 1)
    text = np.where(inside, symbols[raw], 0)
    index = FMIndex(text, length)
    short = short_prefixes(index, len(text), length)
    alone = short & np.append(short[1:], True)
    room = np.repeat(ends, lengths + 1) - np.arange(len(text))
    # An interval of ``length`` bytes repeats if it holds several suffixes, or one of a segment that stands several times.
    times = np.repeat([s.times for s in shard], lengths + 1)
    start = np.zeros(len(text), dtype=bool)
    start[index.order] = ~alone | (times[index.order] > 1)
    start &= room >= length
    for segment, first, size in zip(shard, (ends - lengths).tolist(), lengths.tolist(), strict=True):
        for a, b in runs(start[first : first + size]):
            yield segment, a, b + length - 1, -1


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row; a byte goes if a string of ``length`` bytes
    over it starts anywhere else too."""
    return _cut(docs, length, digest=False)


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    return _cut(docs, length, digest=True)


def cut_text(text: bytes, ranges: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal ranges to remove, and what stays."""
    gone = merged([(r["first"], r["end"]) for r in ranges or []])
    edges = [0, *(x for span in gone for x in span), len(text)]
    return gone, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_ranges(docs: DataFrame, length: int, name: str = "_ranges") -> DataFrame:
    """``docs`` with ``name``: ranges of bytes to remove (null: none)."""
    of, text_hash = unused(docs, "_of"), unused(docs, "_body")
    own = bodies(docs)
    found = repeated_ranges(own, length, ANCHOR, False, True, lambda shard: search(shard, length))
    found = found.select(F.col("doc_id").alias(of), F.col("body").alias(text_hash), F.col("ranges").alias(name))
    body = F.hash(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, (docs["doc_id"].cast("long") == F.col(of)) & (body == F.col(text_hash)), "left").drop(of, text_hash)


def drop_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeats taken out of ``text``; characters that a range covers in part stay, so texts stay
    texts. ``n_chars``, if there, is the new length. Null texts stay null."""
    names, counted, ranges = docs.columns, "n_chars" in docs.columns, unused(docs, "_ranges")
    joined = with_ranges(docs.withColumn("text", F.col("text").cast("string")), length, ranges)

    def whole(text: bytes, first: int, end: int) -> tuple[int, int]:
        while first < end and text[first] & 0xC0 == 0x80:
            first += 1
        while end < len(text) and first < end and text[end] & 0xC0 == 0x80:
            end -= 1
        return first, end

    def run(batches):
        for batch in batches:
            texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist() if counted else []
            for i, own in enumerate(batch.column(ranges).to_pylist()):
                if own and texts[i] is not None:
                    raw = texts[i].encode()
                    gone = [whole(raw, a, b) for a, b in merged([(r["first"], r["end"]) for r in own])]
                    texts[i] = cut_text(raw, [{"first": a, "end": b} for a, b in gone])[1].decode("utf-8")
                    if counted:
                        sizes[i] = len(texts[i])
            columns = {name: batch.column(name) for name in names} | {"text": pa.array(texts, pa.string())}
            if counted:
                columns["n_chars"] = pa.array(sizes, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return joined.mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def _cut(docs: DataFrame, length: int, digest: bool) -> DataFrame:
    joined = with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length)

    def run(batches):
        for batch in batches:
            rows = []
            for text, own in zip(utf8(batch.column("text")), batch.column("_ranges").to_pylist(), strict=True):
                gone, kept = cut_text(text, own)
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")
