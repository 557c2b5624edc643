"""Best-fit packing of token documents into sequences, planned on the histogram of lengths.

The plan follows the linear grouping scheme. Large lengths (over ``capacity / small_part``) are sorted and dealt
into groups of equal cardinality, and each group's lengths are rounded up to its largest. For these few sizes the
best configurations (which sizes share a sequence, and how often) come from the linear programme over
configurations, solved by column generation with a knapsack as pricing problem. The configurations' uses are laid down;
the actual documents take the places of their rounded sizes, which frees room, and all the rest, down to the small
documents, goes by best fit (longest first, to the place it fills best). Laying down all uses can fix the waste of rounding
up, so the plan is made with all, three quarters and half of them (``SHARES``), and the one with fewest sequences holds.

Lengths are integers up to ``capacity``, so all this works on counts per length: the driver handles at most
``capacity`` numbers and a plan of a few thousand rows, however many documents there are. Documents find their
place by their rank among those of their length. Ranks are counted in cells of bounded size, so a length that a
third of all documents have is ranked by many tasks.

Defined results: a null text counts as empty and makes one piece that holds only the end mark; of several rows
with one doc_id each makes its own pieces; other columns of the input play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.bpe import codec, utf8
from placewright.llm.staging import staged

#: Rows ranked together by one task.
CELL = 2_000
#: Of each configuration's uses, the shares that are tried to be laid down before best fit.
SHARES = (1.0, 0.75, 0.5)

#: ``turn`` numbers a task's pieces; it tells rows with one id apart when they are dealt to cells.
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids; only the first piece of a cut document may be shorter."""

    def run(batches):
        own, last, turn = codec(vocabulary), np.array([end_id], dtype="<u4"), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                ids = np.concatenate([own.encode(text), last])
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (x, y) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id, piece, x, y - x, zlib.crc32(ids[x:y].tobytes()), turn + len(rows)))
            turn += len(rows)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def linear_groups(counts: dict[int, int], above: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths over ``above``, longest first, in groups of equal cardinality: (rounded size, [(length, count)])."""
    lengths = sorted((x for x in counts if x > above and counts[x]), reverse=True)
    each = -(-sum(counts[x] for x in lengths) // groups) if lengths else 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for x in lengths:
        left = counts[x]
        while left:
            if not room:
                out.append((x, []))
                room = each
            take = min(left, room)
            out[-1][1].append((x, take))
            left, room = left - take, room - take
    # Groups with one and the same rounded size are one size.
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, runs in out:
        merged[size] += runs
    return sorted(merged.items(), reverse=True)


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over the filled length."""
    use = np.flatnonzero(values > 1e-12)
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own_sizes, own_values = sizes[use], values[use]
    order = np.argsort(own_sizes)
    use, own_sizes, own_values = use[order], own_sizes[order], own_values[order]
    for c in range(int(own_sizes[0]) if len(use) else capacity + 1, capacity + 1):
        n = np.searchsorted(own_sizes, c, side="right")
        worth = best[c - own_sizes[:n]] + own_values[:n]
        k = int(worth.argmax())
        best[c], chosen[c] = (worth[k], k) if worth[k] > best[c - 1] else (best[c - 1], -1)
    made, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            made[use[chosen[c]]] += 1
            c -= int(own_sizes[chosen[c]])
    return float(best[capacity]), made


def configurations(sizes: list[int], need: list[int], capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear programme's optimum (to ``gap``) uses each."""
    s, n = np.array(sizes), np.array(need, dtype=float)
    if not len(s):
        return []
    per = capacity // s
    columns = [np.eye(len(s), dtype=np.int64)[g] * int(per[g]) for g in range(len(s))]
    costs = np.ones(len(s))
    inverse, x = np.diag(1.0 / per), n / per
    for _ in range(40 * len(s)):
        dual = costs @ inverse
        if dual.min() < -1e-9:  # more of a size than needed is allowed
            entering, cost = -np.eye(len(s), dtype=np.int64)[int(dual.argmin())], 0.0
        else:
            value, entering = best_configuration(s, dual, capacity)
            cost = 1.0
            if value <= 1 + gap:
                break
        step = inverse @ entering
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        inverse[leave] /= step[leave]
        others = np.arange(len(s)) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
        t = ratio[leave]
        x = x - t * step
        x[leave] = t
        columns[leave], costs[leave] = entering, cost
    return [(c, float(m)) for c, m, cost in zip(columns, x, costs, strict=True) if cost and m > 0]


class Plan:
    """Sequences as ranges of numbers that are filled alike, and rows that say which ranks of a length go where."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.sequences = dict(counts), capacity, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: [(first sequence, count)]

    def put(self, length: int, first: int, count: int, room: int) -> None:
        self.rows.append((length, self.rank[length], count, first, self.capacity - room))
        self.rank[length] += count
        self.left[length] -= count

    def substitute(self, groups: list[tuple[int, list[tuple[int, int]]]], chosen: list[tuple[np.ndarray, int]]) -> None:
        """Actual documents take the places of rounded sizes, but for a configuration's smallest: what stands there
        is chosen by best fit, from the room that the others really leave, so rounding up costs next to nothing."""
        queues = [[*reversed(runs)] for _, runs in groups]
        for config, times in chosen:
            ranges = [(self.sequences, times, self.capacity)]
            self.sequences += times
            for g in np.repeat(np.arange(len(config)), config)[: max(1, config.sum() - 1)]:
                filled = []
                for first, count, room in ranges:
                    while count and queues[g]:
                        length, there = queues[g].pop()
                        take = min(count, there)
                        self.put(length, first, take, room)
                        filled.append((first, take, room - length))
                        if there > take:
                            queues[g].append((length, there - take))
                        first, count = first + take, count - take
                    if count:  # the size is used up: these places stay free
                        filled.append((first, count, room))
                ranges = filled
            for first, count, room in ranges:
                self.open[room].append((first, count))

    def best_fit(self) -> None:
        """What is left, longest first, each where the least room stays."""
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            for room in range(length, self.capacity + 1):
                while self.left[length] and self.open.get(room):
                    first, count = self.open[room].pop()
                    take = min(count, self.left[length])
                    self.put(length, first, take, room)
                    self.open[room - length].append((first, take))
                    if count > take:
                        self.open[room].append((first + take, count - take))
            per = self.capacity // length
            while n := self.left[length]:
                count, each = (n // per, per) if n >= per else (1, n)
                room = self.capacity
                for _ in range(each):
                    self.put(length, self.sequences, count, room)
                    room -= length
                self.open[room].append((self.sequences, count))
                self.sequences += count


def plan(counts: dict[int, int], capacity: int, groups: int = 96, small_part: int = 8) -> Plan:
    grouped = linear_groups(counts, capacity // small_part, groups)
    chosen = configurations([size for size, _ in grouped], [sum(n for _, n in runs) for _, runs in grouped], capacity)
    made = []
    for share in SHARES:
        own = Plan(counts, capacity)
        own.substitute(grouped, [(c, int(m * share)) for c, m in chosen if m * share >= 1])
        own.best_fit()
        made.append(own)
    return min(made, key=lambda p: p.sequences)


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rank`` of each piece among those of its length, counted in cells of about CELL rows."""
    spark = pieces.sparkSession
    cells = spark.createDataFrame([(x, max(1, -(-n // CELL))) for x, n in counts.items()], "length long, cells long")  # one row a length
    dealt = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "turn"), "cells"))
    sizes = dealt.groupBy("length", "cell").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("cell")) - F.col("count")).drop("count")
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    return dealt.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))


def packed(pieces: DataFrame, capacity: int, groups: int = 96, small_part: int = 8) -> DataFrame:
    """``pieces`` (see PIECE) with ``sequence_id`` and ``offset``. ``pieces`` is read twice, so it should be a written table."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most one row for each length up to capacity
    if not counts:
        return pieces.drop("turn").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    made = plan(counts, capacity, groups, small_part)
    rows = pieces.sparkSession.createDataFrame([(length, rank, rank + n, first, offset) for length, rank, n, first, offset in made.rows], "for_length long, from_rank long, to_rank long, first long, offset long")
    own = ranked(pieces, counts)
    fits = (F.col("length") == F.col("for_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = own.join(F.broadcast(rows), fits)  # a few thousand rows: lengths are at most ``capacity``
    return placed.select(*[c for c in pieces.columns if c != "turn"], (F.col("first") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, groups: int = 96) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    return packed(staged(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity, groups)


def sequences(placed: DataFrame) -> DataFrame:
    """One row for each sequence: what it holds, in order, and how full it is. At most ``capacity`` pieces each."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length")))
    return placed.groupBy("sequence_id").agg(held.alias("holds"), F.sum("length").alias("filled"))
