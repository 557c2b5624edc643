"""Substring dedup on words: matching statistics against a compressed FM-index.

Each shard's segments (see ``repeats``) are one text of word numbers, held as a Burrows-Wheeler transform in a wavelet
tree. Every segment is streamed through it from right to left by backward search, all segments of the shard side by
side; the match is held at ``window`` words by widening its interval to all suffixes with that prefix (the parent of
the interval), so that each step gives the matching statistic of one position: how many words from here on stand in the
index, and which is the least document that has them. Statistics of ``window`` words are reported.

Defined results: words are what stands between ASCII white space, unchanged. Null and empty texts have no words;
texts of fewer than ``window`` words lose none; of equal texts the one with the least doc_id keeps its words. doc_id is
the key: rows that share one are one document, each judged by its own text; rows without one lose nothing. Other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placewright.llm.bpe import utf8
from placewright.llm.repeats import Segment, bodies, merged, repeated_ranges
from placewright.llm.succinct import FMIndex

#: Words of an anchor: long enough to be rare, short enough that a window holds many.
ANCHOR = 20


def prefix_classes(text: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """For each rank, whether its suffix differs from the one before within ``window`` symbols."""
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    padded = np.concatenate([text, np.zeros(window, dtype=text.dtype)])
    undecided = np.arange(1, len(order))
    for j in range(window):  # few neighbours stay undecided for long
        new[undecided[differ := padded[order[undecided] + j] != padded[order[undecided - 1] + j]]] = True
        undecided = undecided[~differ]
    return new


def search(shard: list[Segment], window: int) -> Iterator[tuple[Segment, int, int, int]]:
    numbers: dict[bytes, int] = {}
    lanes = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in s.text.split(b" ")]) for s in shard]
    lengths = np.array([len(x) for x in lanes])
    text = np.concatenate([x for lane in lanes for x in (lane, [0])])
    owner = np.repeat(np.arange(len(lanes)), lengths + 1)
    index = FMIndex(text, window)
    new = prefix_classes(text, index.order, window)
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(text))
    of_rank = np.cumsum(new) - 1
    least = np.minimum.reduceat(np.array([s.least for s in shard])[owner[index.order]], opens)
    # Lanes end together; the longest come first, so those that have a word at a step are a prefix.
    longest = np.argsort(-lengths, kind="stable")
    ends = (np.cumsum(lengths + 1) - 1)[longest]
    sizes = lengths[longest]
    low, high = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), len(text))
    match = np.zeros(len(lanes), dtype=np.int64)
    statistics = np.zeros(len(text), dtype=np.int64)
    source = np.zeros(len(text), dtype=np.int64)
    for step in range(1, int(sizes[0]) + 1):
        m = int(np.searchsorted(-sizes, -step, side="right"))
        at = ends[:m] - step
        low, high = index.backward(text[at], low[:m], high[:m])
        match = match[:m] + 1
        full = match > window
        low, high = np.where(full, opens[of_rank[low]], low), np.where(full, closes[of_rank[low]], high)
        match = np.minimum(match, window)
        statistics[at] = match
        source[at] = least[of_rank[low]]
    for segment, start, size in zip(shard, (np.cumsum(lengths + 1) - lengths - 1).tolist(), lengths.tolist(), strict=True):
        yield from ranges(segment, statistics[start : start + size], source[start : start + size], window)


def ranges(segment: Segment, statistics: np.ndarray, source: np.ndarray, window: int) -> Iterator[tuple[Segment, int, int, int]]:
    """Runs of windows with one and the same least document; a segment that only its own document has says nothing."""
    hits = np.flatnonzero(statistics >= window)
    if not len(hits) or (segment.times == 1 and (source[hits] >= segment.least).all()):
        return
    split = np.flatnonzero((np.diff(hits) > 1) | (np.diff(source[hits]) != 0)) + 1
    for run in np.split(hits, split):
        yield segment, int(run[0]), int(run[-1]) + window, int(source[run[0]])


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` for every row: ``kept`` are the words that stay, joined by one space;
    ``spans`` the removed ranges of words. A word goes if a window of ``window`` words over it starts in a document
    with a smaller doc_id too."""
    return _with_ranges(docs, window, "kept string, spans array<struct<first:int,end:int>>", digest=False)


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    return _with_ranges(docs, window, "kept_sha256 string", digest=True)


def _with_ranges(docs: DataFrame, window: int, more: str, digest: bool) -> DataFrame:
    own = bodies(docs)
    joined = own.join(repeated_ranges(own, window, ANCHOR, True, False, lambda shard: search(shard, window)), ["doc_id", "body"], "left").select("doc_id", "text", "ranges")

    def run(batches):
        for batch in batches:
            counts, gone, kept, spans = [], [], [], []
            for text, own in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                units = text.split()
                cut = merged([(r["first"], r["end"]) for r in own or []])
                counts.append(len(units))
                gone.append(sum(b - a for a, b in cut))
                for a, b in reversed(cut):
                    del units[a:b]
                left = b" ".join(units)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8"))
                spans.append([{"first": a, "end": b} for a, b in cut])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"]
            if not digest:
                columns, names = [*columns, pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {more}")
