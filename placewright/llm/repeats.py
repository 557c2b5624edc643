"""Where texts may repeat: what both substring operators share.

A repeat of W units (words or bytes) contains at least one *anchor*: among the k-unit strings of each window of W
units the one with the least hash is its anchor, so equal windows have equal anchors wherever they stand. An anchor
that occurs once in the corpus belongs to no repeat. So the plan is

1. scan: cut every text into *segments*, each of all neighbouring windows with one anchor, as rows (anchor, hash of
   the segment, doc_id, start); count the anchors and keep the rows of those that may repeat;
2. of equal segments one is looked at, with how often it stands: the first place's document gives its text;
3. deal the segments to shards by anchor. A shard is indexed and searched as a whole (this is where the operators
   differ) and says which ranges of each segment repeat;
4. join what it says with all places of the segment, and the ranges with the texts.

Equal windows meet in one shard, so shards need nothing from each other. All counting is by aggregations that
combine before they shuffle, a segment that a third of all documents share reaches its shard once, and its places are joined
in blocks. Shards close at a fixed size. An anchor with very many places (a phrase of a licence in all sorts of
surroundings) would make a large shard: such anchors, at most ``HOT_KEYS`` of them, are split. Their windows get a second anchor,
the least of their strings of nine tenths of a window, which differs where the surroundings do. Where an anchor's distinct segments still hold
more than a shard (a phrase of nine tenths of a window and more), they are cut to their windows, each dealt by its own hash: equal windows
are one entry, and one that stands alone isn't sent. So no anchor holds more than a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.bpe import utf8
from placewright.llm.staging import block_counts, block_join, staged

#: Bytes of segments in one shard.
SHARD = 1_000_000
#: Places from which on an anchor is split, if it also holds one in HOT_KEYS of all places (so no more are).
HOT, HOT_KEYS = 20_000, 10_000
SECOND = np.uint64(0x8EBC6AF09C88C6E3)

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64, remembered for the next text."""
    if len(POWERS.get(int(base), ())) < n:
        factors = np.full(max(2 * n, 10_000), base, dtype=np.uint64)
        factors[0] = 1
        POWERS[int(base)] = np.cumprod(factors, dtype=np.uint64)
    return POWERS[int(base)][:n]


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit codes, from prefix sums modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(BASE, len(codes)), dtype=np.uint64)])
        self.back = powers(INVERSE, len(codes) + 1)

    def stretch(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.back[first])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text: what stands between ASCII white space."""
    gap = np.concatenate([[True], SPACES[np.frombuffer(data, dtype=np.uint8)], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def codes(data: bytes, by_word: bool) -> np.ndarray:
    """One code for each unit of a text."""
    own = BYTE_CODES[np.frombuffer(data, dtype=np.uint8)]
    if not by_word:
        return own
    first, end = words(data)
    return Rolling(own).stretch(first, end)


def least_of(values: np.ndarray, want: int) -> np.ndarray:
    """The minimum over each ``want`` neighbours, by doubling."""
    wide = 1
    while wide < want:
        step = min(wide, want - wide)
        values = np.minimum(values[:-step], values[step:])
        wide += step
    return values


class Segments:
    """The segments of one text: first window and end of each (in units), its anchor and a hash of its units. Windows whose anchor
    is one of ``hot`` (sorted) have a second one in its place."""

    def __init__(self, units: np.ndarray, window: int, k: int, hot: np.ndarray):
        n = len(units) - window + 1
        if n < 1:
            self.first = self.end = np.zeros(0, np.int64)
            self.anchor = self.key = np.zeros(0, np.uint64)
            self.grams = self.anchor
            return
        rolling = Rolling(units)
        self.grams = rolling.grams(k)
        anchor = least_of(self.grams, window - k + 1)
        if len(hot):
            split = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
            if split.any():
                wide = window * 9 // 10
                longer = mix(rolling.grams(wide) ^ SECOND)
                anchor = np.where(split, least_of(longer, window - wide + 1), anchor)
                self.grams = np.concatenate([self.grams, longer])
        self.first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.end = np.append(self.first[1:], n) + window - 1
        self.anchor = anchor[self.first]
        self.key = rolling.stretch(self.first, self.end)

    def again(self) -> np.ndarray:
        """Whether the anchor stands more than once in this text."""
        seen = np.zeros(1 << 16, dtype=bool)
        low = np.uint64(0xFFFF)
        seen[self.anchor & low] = True
        values, times = np.unique(self.grams[seen[self.grams & low]], return_counts=True)
        return times[np.searchsorted(values, self.anchor)] > 1


def bodies(docs: DataFrame) -> DataFrame:
    """``doc_id, text, body``: rows with one doc_id are told apart by a hash of their texts."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.hash(F.coalesce(text, F.lit(""))).alias("body"))


def places(docs: DataFrame, window: int, k: int, by_word: bool, within_one: bool, hot) -> DataFrame:
    """``anchor, key, doc_id, body, start, size, again``: every segment of every text, in units."""
    names = ["anchor", "key", "doc_id", "body", "start", "size", "again"]

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            for doc_id, body, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), utf8(batch.column("text")), strict=True):
                own = Segments(codes(text, by_word), window, k, hot.value)
                m = len(own.first)
                if m and doc_id is not None:
                    again = own.again() if within_one else np.zeros(m, dtype=bool)
                    held.append([own.anchor.view(np.int64), own.key.view(np.int64), np.full(m, doc_id, dtype=np.int64), np.full(m, body, dtype=np.int32), own.first.astype(np.int32), (own.end - own.first).astype(np.int32), again])
                    size += m
                    if size > 50_000:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "anchor long, key long, doc_id long, body int, start int, size int, again boolean")


def repeated_places(docs: DataFrame, window: int, k: int, by_word: bool, within_one: bool):
    """The rows of ``places`` whose anchor stands in another document too (``within_one``: or again anywhere)."""
    share = docs.sparkSession.sparkContext.broadcast
    many = F.min("doc_id") < F.max("doc_id")

    def counted(hot):
        rows = places(docs, window, k, by_word, within_one, hot)
        counts = rows.groupBy("anchor").agg((many | F.max("again") | (F.count("*") > 1) if within_one else many).alias("many"), F.count("*").alias("n"))
        return rows.drop("again"), staged(counts.where("many").select("anchor", "n"), "anchors")

    hot = share(np.zeros(0, np.uint64))
    rows, counts = counted(hot)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = [r["anchor"] for r in counts.where(F.col("n") >= max(HOT, -(-total // HOT_KEYS))).select("anchor").collect()]  # HOT_KEYS at most
    if crowded:
        hot = share(np.sort(np.array(crowded, dtype=np.int64).view(np.uint64)))
        rows, counts = counted(hot)
    blocks = block_counts(counts, "anchor", total)
    return block_join(rows, counts.select("anchor"), "anchor", "doc_id", blocks)


def distinct_segments(found: DataFrame) -> DataFrame:
    """``anchor, key, at, times, size``: each distinct segment with its first place, how often it stands, and its units."""
    return found.groupBy("anchor", "key").agg(F.min(F.struct("doc_id", "body", "start")).alias("at"), F.count("*").alias("times"), F.min("size").alias("size"))


def wide_anchors(distinct: DataFrame, window: int, by_word: bool) -> DataFrame:
    """Anchors whose distinct segments hold more than a shard (a word is taken as six bytes). Those of a segment of more than four windows, which
    only texts that repeat within themselves have, are left whole."""
    return distinct.groupBy("anchor").agg(F.sum("size").alias("held"), F.max("size").alias("longest")).where((F.col("held") * (6 if by_word else 1) > SHARD) & (F.col("longest") <= 4 * window)).select("anchor")


def windows_of(docs: DataFrame, segments: DataFrame, window: int, by_word: bool) -> DataFrame:
    """``anchor, key, times, doc_id, body, start, shift, cell``: every window of the segments, ``shift`` units from the start, with its hash."""
    wanted = segments.groupBy("at.doc_id", "at.body").agg(F.collect_list(F.struct("anchor", "key", "times", "at.start", "size")).alias("wanted"))
    names = ["anchor", "key", "times", "doc_id", "body", "start", "shift", "cell"]

    def run(batches):
        for batch in batches:
            for i, text in enumerate(utf8(batch.column("text"))):
                rolling, want = Rolling(codes(text, by_word)), batch.column("wanted").slice(i, 1).flatten()
                start, size = (want.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
                n = size - window + 1
                owner = np.repeat(np.arange(len(n)), n)
                shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                first = start[owner] + shift
                cell = rolling.stretch(first, first + window).view(np.int64)
                same = [want.field(c).take(pa.array(owner)) for c in ("anchor", "key", "times")]
                here = [pa.array(np.full(len(owner), batch.column(c)[i].as_py()), t) for c, t in (("doc_id", pa.int64()), ("body", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, *here, pa.array(first.astype(np.int32)), pa.array(shift.astype(np.int32)), pa.array(cell)], names)

    rows = docs.join(wanted, ["doc_id", "body"]).select("doc_id", "body", "text", "wanted")
    return rows.mapInArrow(run, "anchor long, key long, times long, doc_id long, body int, start int, shift int, cell long")


def narrowed(docs: DataFrame, distinct: DataFrame, window: int, by_word: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """What is dealt to shards, in the form of ``distinct``, and, where anchors are wide, their windows and those of them that stand more
    than once (``cell, at, times, n``): these are dealt with ``cell`` as anchor and key."""
    wide = staged(wide_anchors(distinct, window, by_word), "wide")
    if wide.isEmpty():
        return distinct, None, None
    windows = staged(windows_of(docs, distinct.join(wide, "anchor", "left_semi"), window, by_word), "windows")
    cells = windows.groupBy("cell").agg(F.min(F.struct("doc_id", "body", "start")).alias("at"), F.sum("times").alias("times"), F.count("*").alias("n")).where("times > 1")
    cells = staged(cells, "cells")
    cut = cells.select(F.col("cell").alias("anchor"), F.col("cell").alias("key"), "at", "times", F.lit(window).alias("size"))
    return distinct.join(wide, "anchor", "left_anti").unionByName(cut), windows, cells


def widened(said: DataFrame, windows: DataFrame, cells: DataFrame, window: int) -> DataFrame:
    """What shards say of windows, as ranges of the segments they were cut from; windows that overlap are one range."""
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = block_counts(cells.select("cell", "n"), "cell", total)
    own = said.where("anchor = key").select(F.col("anchor").alias("cell"), "least").distinct()
    met = block_join(windows.select("cell", "anchor", "key", "shift"), own, "cell", "key", blocks)

    def joined(seen, x):
        last = F.try_element_at(seen, F.lit(-1))
        grown = F.concat(F.slice(seen, F.lit(1), F.size(seen) - 1), F.array(F.struct(last["first"].alias("first"), (x + window).alias("end"))))
        return F.when((F.size(seen) > 0) & (x <= last["end"]), grown).otherwise(F.array_append(seen, F.struct(x.alias("first"), (x + window).alias("end"))))

    shifts = F.sort_array(F.collect_list("shift"))  # of one segment: three windows' worth at most
    ranges = F.aggregate(shifts, F.array().cast("array<struct<first:int,end:int>>"), joined)
    out = met.groupBy("anchor", "key", "least").agg(ranges.alias("ranges")).select("anchor", "key", F.explode("ranges").alias("range"), "least")
    return out.select("anchor", "key", F.col("range.first").cast("long").alias("first"), F.col("range.end").cast("long").alias("end"), "least")


def segment_texts(docs: DataFrame, distinct: DataFrame, by_word: bool) -> DataFrame:
    """``anchor, key, times, least, segment``: the segments with their texts. Words are joined by one space."""
    wanted = distinct.groupBy("at.doc_id", "at.body").agg(F.collect_list(F.struct("anchor", "key", "at.start", "times", "size")).alias("wanted"))  # of one text: no more than it has

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("wanted")
            for i, text in enumerate(utf8(batch.column("text"))):
                want = lists.slice(i, 1).flatten()
                first, size = (want.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size"))
                end = first + size
                if by_word:
                    opens, closes = words(text)
                    first, end = opens[first], closes[end - 1]
                cut = [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                pieces = [b" ".join(x.split()) for x in cut] if by_word else cut
                yield pa.RecordBatch.from_arrays([want.field("anchor"), want.field("key"), want.field("times"), pa.array([ids[i]] * len(cut), pa.int64()), pa.array(pieces, pa.binary())], ["anchor", "key", "times", "least", "segment"])

    # Rows that repeat an id and its text give their segments more than once; they stand more than once, too.
    rows = docs.join(wanted, ["doc_id", "body"]).select("doc_id", "text", "wanted")
    return rows.mapInArrow(run, "anchor long, key long, times long, least long, segment binary")


@dataclass
class Segment:
    anchor: int
    key: int
    times: int
    least: int
    text: bytes


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Segment]]:
    """Segments in shards that hold whole anchors; rows come sorted by anchor."""
    held: list[Segment] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "times", "least", "segment")), strict=True):
            if held and row[0] != held[-1].anchor and size > SHARD:
                yield held
                held, size = [], 0
            held.append(Segment(*row))
            size += len(held[-1].text)
    if held:
        yield held


#: Of each segment of a shard: ranges of units that repeat, each with the least doc_id that has it.
Search = Callable[[list[Segment]], Iterator[tuple[Segment, int, int, int]]]


def repeated_ranges(docs: DataFrame, window: int, k: int, by_word: bool, within_one: bool, search: Search) -> DataFrame:
    """``doc_id, body, ranges``: ranges of units to remove, for each of ``docs`` (see ``bodies``) that has any. With ``within_one``
    all places of a repeat are removed, else those in documents with more than the least doc_id."""
    found = staged(repeated_places(docs, window, k, by_word, within_one), "places")

    def run(batches):
        for shard in shards(batches):
            rows = [(s.anchor, s.key, first, end, least) for s, first, end, least in search(shard)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["anchor", "key", "first", "end", "least"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = staged(distinct_segments(found), "segments")
    asked, windows, cells = narrowed(docs, distinct, window, by_word)
    dealt = segment_texts(docs, asked, by_word).repartition(n, "anchor").sortWithinPartitions("anchor", "key")
    said = dealt.mapInArrow(run, "anchor long, key long, first long, end long, least long")
    if windows is not None:
        said = staged(said, "said")
        said = said.where("anchor <> key").unionByName(widened(said, windows, cells, window))
    blocks = block_counts(distinct.select("key", F.col("times").alias("n")), "key", distinct.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    back = block_join(found, said, ["key", "anchor"], "doc_id", blocks)
    if not within_one:
        back = back.where("least < doc_id")
    return back.select("doc_id", "body", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end")).alias("range")).groupBy("doc_id", "body").agg(F.collect_set("range").alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
