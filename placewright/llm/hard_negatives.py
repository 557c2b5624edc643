"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Scores are inner products of whole numbers. With one more component, sqrt(M^2 - |x|^2) for a row and 0 for an anchor (M the largest norm),
the row of the highest score is the nearest one: |q - x|^2 = M^2 + |q|^2 - 2 q.x. Rows and anchors are assigned to their nearest of at
most PIVOTS pivots, and rows keep their distance e to it. Anchors are gathered, cell by cell, into groups of some GROUP. For a group and a
cell the triangle inequality gives the range of e outside which no row of the cell can serve an anchor of the group, and only rows inside
it are replicated to the group, dealt to chunks of some CHUNK rows; a chunk and its group's anchors meet in one task, which computes
the exact scores and keeps the best of each anchor; these few rows are merged over the chunks.

This is done twice. First for positives: an anchor's own bound is the k-th least of (its distance to a pivot + e) over the least e of each
cell of its label. Then for negatives, whose scores must lie in a band below those of the positives: that is a shell around the
anchor with a known inner and outer radius.

Equal vectors of one label are interchangeable but for their ids: of each such class only the ids that can be among the first ones are
candidates, and anchors that are equal are answered once. So a vector that a third of all rows hold makes no hot group.

Defined results: rows whose id, label or vector is null, or whose vector is empty or holds a null or non-finite component, take no part;
nor do vectors of another width than that of the least id. Of rows with one id the one with the least (label, components) counts, once. An
anchor without positives, or a positive without negatives, has no rows. Equal scores go by id. Columns beside the three named play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.staging import block_counts, block_join, staged
from placewright.llm.vectors import matrix, quantised

#: Pivots at most (the root of the number of rows, if less), anchors of a group and rows of a chunk, about.
PIVOTS, GROUP, CHUNK = 1024, 256, 16_384


class Cells:
    """Pivots in the space with one more component; small enough for every task."""

    def __init__(self, pivots: np.ndarray, largest: int):
        self.m2 = largest
        order, left = [], list(range(len(pivots)))
        points = np.column_stack([pivots, np.sqrt(np.maximum(0.0, largest - (pivots * pivots).sum(axis=1).astype(float)))])
        while left:  # neighbours get neighbouring numbers
            at = 0 if not order else int(((points[left] - points[order[-1]]) ** 2).sum(axis=1).argmin())
            order.append(left.pop(at))
        self.points = points[order]
        #: What rounding can make of a distance, many times over.
        self.slack = 2e-6 * math.sqrt(largest) + 1e-9

    def distances(self, v: np.ndarray, rows: bool) -> np.ndarray:
        """Of rows or anchors (without the component of rows) to each pivot."""
        v = v.astype(float)
        n2 = (v * v).sum(axis=1)
        more = np.sqrt(np.maximum(0.0, self.m2 - n2)) if rows else np.zeros(len(v))
        own = np.column_stack([v, more])
        d2 = (own * own).sum(axis=1)[:, None] - 2 * own @ self.points.T + (self.points**2).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(0.0, d2))

    def radius(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows have this score."""
        v = v.astype(float)
        return np.sqrt(np.maximum(0.0, self.m2 + (v * v).sum(axis=1) - 2 * score))


def scores(q: np.ndarray, x: np.ndarray, largest: int) -> np.ndarray:
    """Exact inner products, in doubles as long as these hold every sum."""
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if largest < 1 << 52 else q @ x.T


def best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, equal ones by id."""
    at = np.arange(len(s))
    if len(s) > k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    return at[np.lexsort((ids[at], -s[at]))][:k]


def norm2() -> Column:
    return F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)


def usable_rows(rows: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """``id, label, v``, one row for each id, all of one width."""
    kept = quantised(rows, key, label, vector, scale).where("id IS NOT NULL AND label IS NOT NULL")
    own = staged(kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_r")).select("id", "_r.*"), "vectors")
    width = own.agg(F.min_by(F.size("v"), "id")).first()[0]
    return own.where(F.size("v") == F.lit(width))


def cells_of(own: DataFrame) -> Cells | None:
    """Pivots: a bounded set of rows, chosen by the hash of their ids. The driver sees these and the largest norm."""
    n, largest = own.agg(F.count("*"), F.max(norm2())).first()
    if not n:
        return None
    chosen = own.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, math.isqrt(n - 1) + 1)).collect()
    return Cells(np.unique(np.array([r["v"] for r in chosen], dtype=np.int64), axis=0), largest)


def placed(own: DataFrame, cells: Cells, rows: bool) -> DataFrame:
    """``own`` with ``cell`` and the distance ``e`` to its pivot."""
    held = own.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column("v")
            d = held.value.distances(matrix(column, len(column[0])), rows)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at])], names=[*batch.schema.names, "cell", "e"])

    return own.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in own.dtypes) + ", cell int, e double")


def gathered(anchors: DataFrame, part: str) -> DataFrame:
    """``anchors`` with ``g``: neighbouring cells of a part together, a cell with many anchors in several groups."""
    sizes = anchors.groupBy(part, "cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(part).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.select(part, "cell", F.ceil(F.col("_n") / GROUP).alias("_m"), F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / GROUP).alias("_run"))
    deal = F.pmod(F.xxhash64("anchor"), F.col("_m"))
    return anchors.join(runs, [part, "cell"]).withColumn("g", F.concat_ws("/", F.col(part), "_run", deal)).drop("_m", "_run")


def ranges(g: str, label: int | None, names: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray, n: np.ndarray) -> pa.Table:
    """A row for each cell that can serve a group, and the chunks that its rows need."""
    ok = np.flatnonzero((lo <= most) & (hi >= least))
    chunks = max(1, -(-int(n[ok].sum()) // CHUNK))
    return pa.table({"g": pa.array([g] * len(ok), pa.string()), "of": pa.array([label] * len(ok), pa.int64()), "cell": pa.array(names[ok], pa.int32()), "lo": pa.array(lo[ok], pa.float64()), "hi": pa.array(hi[ok], pa.float64()), "chunks": pa.array([chunks] * len(ok), pa.int32())})


RANGES = "g string, of long, cell int, lo double, hi double, chunks int"


def positive_ranges(anchors: DataFrame, candidates: DataFrame, cells: Cells, k: int) -> DataFrame:
    """For each group (of one label) the range of e of each cell in which one of its anchors' k nearest rows of the label can be."""
    least = Window.partitionBy("label", "cell").orderBy("e", "id")
    near = candidates.select("label", "cell", "e", "id").withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k)
    near = near.groupBy("label", "cell").agg(F.sort_array(F.collect_list("e")).alias("es"))  # k at most
    size = candidates.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("e").alias("most"))
    told = anchors.select(F.col("g").alias("of_g"), "label").distinct().join(near.join(size, ["label", "cell"]), "label").drop("label")
    held = anchors.sparkSession.sparkContext.broadcast(cells)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (len(a) and len(b)):
            return ranges("", None, *[np.zeros(0)] * 6)
        column = a.column("v").combine_chunks()
        d = held.value.distances(matrix(column, len(column[0])), False)
        names, es = b.column("cell").to_numpy(), b.column("es").to_pylist()
        d = d[:, names]
        padded = np.array([e + [np.inf] * (k - len(e)) for e in es])
        reach = np.full(len(d), np.inf)
        for i in range(0, len(d), 32) if padded.size >= k else ():
            reach[i : i + 32] = np.partition((d[i : i + 32, :, None] + padded[None]).reshape(len(d[i : i + 32]), -1), k - 1, axis=1)[:, k - 1]
        reach += held.value.slack
        return ranges(a.column("g")[0].as_py(), a.column("label")[0].as_py(), names, (d - reach[:, None]).min(axis=0), (d + reach[:, None]).max(axis=0), padded[:, 0], b.column("most").to_numpy(), b.column("n").to_numpy())

    return anchors.select("g", "label", "v").groupBy("g").cogroup(told.groupBy("of_g")).applyInArrow(run, RANGES)


def negative_ranges(anchors: DataFrame, candidates: DataFrame, cells: Cells, low: int, high: int) -> DataFrame:
    """For each group the range of e of each cell that meets one of its anchors' shells."""
    sizes = sorted(map(tuple, candidates.groupBy("cell").agg(F.count("*"), F.min("e"), F.max("e")).collect()))  # a row for each pivot
    names, n, least, most = (np.array(c) for c in zip(*sizes, strict=True))
    held = anchors.sparkSession.sparkContext.broadcast(cells)

    def run(a: pa.Table) -> pa.Table:
        column = a.column("v").combine_chunks()
        v = matrix(column, len(column[0]))
        d = held.value.distances(v, False)[:, names]
        wanted = a.column("wanted").to_pylist()
        outer = held.value.radius(v, np.array([low / high * min(w) for w in wanted])) + held.value.slack
        inner = held.value.radius(v, np.array([float(max(w)) for w in wanted])) - held.value.slack
        lo = np.maximum(d - outer[:, None], inner[:, None] - d)
        return ranges(a.column("g")[0].as_py(), None, names, lo.min(axis=0), (d + outer[:, None]).max(axis=0), least, most, n)

    return anchors.select("g", "v", "wanted").groupBy("g").applyInArrow(run, RANGES)


def met(candidates: DataFrame, anchors: DataFrame, bounds: DataFrame, run, schema: str, by_label: bool) -> DataFrame:
    """The chunks of rows that ``bounds`` replicate to each group, with the group's anchors, through ``run``. A cell with many rows is
    joined with its ranges in blocks."""
    counts = candidates.groupBy("cell").agg(F.count("*").alias("n"))
    total = candidates.count()
    own, keys = (candidates.withColumn("of", F.col("label")), ["cell", "of"]) if by_label else (candidates, ["cell"])
    near = block_join(own, bounds if by_label else bounds.drop("of"), keys, "id", block_counts(counts, "cell", total, per=max(2000, 4 * total // PIVOTS))).where("e BETWEEN lo AND hi")
    sent = near.select(F.col("g").alias("to_g"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("to_c"), "id", F.col("label").alias("label"), F.col("v").alias("v"))
    chunks = bounds.select("g", "chunks").distinct()
    asked = anchors.join(chunks, "g").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return asked.groupBy("g", "c").cogroup(sent.groupBy("to_g", "to_c")).applyInArrow(run, schema)


def merged(found: DataFrame, parts: list[str], k: int, name: str) -> DataFrame:
    """The k best of each part as a sorted array ``name`` of (score, id)."""
    first = Window.partitionBy(*parts).orderBy(F.desc("score"), "id")
    kept = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_r", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))
    return kept.groupBy(*parts).agg(rows.alias(name))


def nearest_of_label(anchors: DataFrame, candidates: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``anchor, best``: the k rows of an anchor's label (itself among them) with the highest scores."""
    own = staged(gathered(anchors, "label"), "groups")
    bounds = staged(positive_ranges(own, candidates, cells, k), "ranges")
    largest = cells.m2

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(a) and len(b):
            left, right = a.column("v").combine_chunks(), b.column("v").combine_chunks()
            ids = b.column("id").to_numpy()
            s = scores(matrix(left, len(left[0])), matrix(right, len(right[0])), largest)
            for anchor, row in zip(a.column("anchor").to_pylist(), s, strict=True):
                at = best(row, ids, k)
                for held, more in zip(out, ([anchor] * len(at), ids[at].tolist(), row[at].tolist()), strict=True):
                    held += more
        return pa.table(dict(zip(("anchor", "id", "score"), (pa.array(x, pa.int64()) for x in out), strict=True)))

    return merged(met(candidates, own.select("g", "anchor", "v"), bounds, run, "anchor long, id long, score long", True), ["anchor"], k, "best")


def in_bands(anchors: DataFrame, candidates: DataFrame, cells: Cells, k: int, low: int, high: int) -> DataFrame:
    """``anchor, score, hard``: for each wanted score of an anchor the k best rows of other labels whose scores lie in its band."""
    own = staged(gathered(anchors.withColumn("_all", F.lit(0)), "_all"), "groups")
    bounds = staged(negative_ranges(own, candidates, cells, low, high), "ranges")
    largest = cells.m2

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if len(a) and len(b):
            left, right = a.column("v").combine_chunks(), b.column("v").combine_chunks()
            ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
            s = scores(matrix(left, len(left[0])), matrix(right, len(right[0])), largest)
            for anchor, label, wanted, row in zip(*(a.column(c).to_pylist() for c in ("anchor", "label", "wanted")), s, strict=True):
                other = np.flatnonzero((labels != label) & (row <= max(wanted)) & (high * row >= low * min(wanted)))
                each, named = row[other], ids[other]
                for w in wanted:
                    band = np.flatnonzero((each <= w) & (high * each >= low * w))
                    at = band[best(each[band], named[band], k)]
                    for held, more in zip(out, ([anchor] * len(at), [w] * len(at), named[at].tolist(), each[at].tolist()), strict=True):
                        held += more
        return pa.table(dict(zip(("anchor", "wanted", "id", "score"), (pa.array(x, pa.int64()) for x in out), strict=True)))

    return merged(met(candidates, own.select("g", "anchor", "label", "v", "wanted"), bounds, run, "anchor long, wanted long, id long, score long", False), ["anchor", "wanted"], k, "hard")


def mined(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (ids divisible by ``every``) and each of its
    ``positives`` best rows of the same label the ``negatives`` best rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score."""
    own = usable_rows(rows, key, label, vector, scale)
    cells = cells_of(own)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if cells is None:
        return rows.sparkSession.createDataFrame([], schema)
    # Of equal vectors of one label only the first ids can be among the best, after the anchor's own.
    keep = max(positives + 1, negatives)
    alike = Window.partitionBy("label", "v").orderBy("id")
    candidates = staged(placed(own.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= keep).drop("_r"), cells, True), "candidates")
    members = own.where(F.col("id") % every == 0).withColumn("h", F.xxhash64("label", "v"))
    classes = staged(placed(members.groupBy("h", "label", "v").agg(F.min("id").alias("anchor"), F.count("*").alias("n")), cells, False), "classes")
    first = staged(nearest_of_label(classes.select("anchor", "label", "v", "cell"), candidates, cells, positives + 1), "positives")
    # A band below a negative score is empty.
    wanted = first.select("anchor", F.array_distinct(F.filter(F.transform("best", lambda x: x["score"]), lambda x: x >= 0)).alias("wanted")).where("size(wanted) > 0")
    hard = in_bands(classes.select("anchor", "label", "v", "cell").join(wanted, "anchor"), candidates, cells, negatives, low, high)
    told = hard.groupBy("anchor").agg(F.collect_list(F.struct("wanted", "hard")).alias("bands"))  # a band for each positive at most
    answers = staged(classes.select("h", "label", "v", "anchor").join(first, "anchor").join(told, "anchor").drop("anchor"), "answers")
    total = classes.agg(F.sum("n")).first()[0] or 0
    each = block_join(members, answers, ["h", "label", "v"], "id", block_counts(classes.groupBy("h").agg(F.sum("n").alias("n")), "h", total))
    pairs = each.select(F.col("id").alias("anchor_id"), "bands", F.explode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, positives)).alias("_p"))
    banded = pairs.select("anchor_id", F.col("_p.id").alias("positive_id"), F.col("_p.score").alias("positive_score"), F.get(F.filter("bands", lambda b: b["wanted"] == F.col("_p.score")), 0)["hard"].alias("_hard"))
    return banded.select("anchor_id", "positive_id", "positive_score", F.posexplode("_hard").alias("_at", "_n")).select(
        "anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_n.id").alias("negative_id"), "positive_score", F.col("_n.score").alias("negative_score"))
