"""Vector compression by product codes over whole numbers.

Every vector is cut into equal parts, and each part position has a codebook. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and moves each entry to the floor of its parts' mean. The codebooks are small
(parts x entries x width) and go to the tasks as a broadcast; a task finds all distances of an Arrow batch by
|x|^2 - 2 x.c + |c|^2, exactly, in 64-bit integer matrix products, and adds up its own sums per entry. What is shuffled each round is
these sums: at most parts x entries rows a task, however the parts are spread over the entries.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part. The width is that of the
first kept vector by (id, label, components); rows of another width take no part either, and a width that ``parts`` doesn't divide is an error. The
codebooks start with the ``entries`` smallest ids (null ids last); rows that share an id go by label and components; fewer rows make fewer
entries. Entries that no part is assigned to stay; of equal entries only the first is used. Repeated rows are rows; null labels are one
label. Components beyond vectors.LARGEST after scaling are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.staging import staged
from placewright.llm.vectors import matrix, quantised

#: Vectors whose distances are held at once.
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest entry of one codebook and their squared distance; all are 64-bit integers."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    at = d.argmin(axis=1)  # the first of equal ones
    return at, d[np.arange(len(x)), at]


def assigned(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances (rows x parts) of whole vectors."""
    parts, _, width = books.shape
    at, d = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
    for p in range(parts):
        at[:, p], d[:, p] = nearest(v[:, p * width : (p + 1) * width], books[p])
    return at, d


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width from the smallest ids: the only vectors that the driver sees."""
    order = [F.col("id").asc_nulls_last(), F.col("label").asc_nulls_first(), "v"]
    width = vectors.orderBy(*order).select(F.size("v")).limit(1).collect()
    if not width:
        return np.zeros((parts, 0, 0), np.int64)
    if width[0][0] % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {width[0][0]} components")
    first = [r["v"] for r in vectors.where(F.size("v") == width[0][0]).orderBy(*order).limit(entries).collect()]
    return np.array(first, dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def entry_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, n, sums``: how many parts each entry has, and their componentwise sums."""
    parts, entries, width = books.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                v = matrix(batch.column("v").slice(i, ROWS), parts * width)
                at, _ = assigned(v, held.value)
                for p in range(parts):
                    n[p] += np.bincount(at[:, p], minlength=entries)
                    np.add.at(sums[p], at[:, p], v[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e], pa.int64()), "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

    own = vectors.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return own.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def trained_books(vectors: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds. The driver receives a row for each used entry."""
    for _ in range(rounds if books.size else 0):
        books = books.copy()
        for r in entry_sums(vectors, books).collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error``: an entry for each part (array of int), and the squared distances summed over parts."""
    parts, _, width = books.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            codes, errors = [], []
            for i in range(0, len(batch), ROWS):
                at, d = assigned(matrix(batch.column("v").slice(i, ROWS), parts * width), held.value)
                codes += at.tolist()
                errors += d.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.list_(pa.int32())), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return vectors.mapInArrow(run, "id long, label long, code array<int>, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, v`` of codes: the entries side by side, as whole numbers."""
    held = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            rows = [held.value[np.arange(len(c)), c].ravel().tolist() for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int64()))], ["id", "v"])

    return codes.select("id", "code").mapInArrow(run, "id long, v array<long>")


def books_table(spark: SparkSession, books: np.ndarray) -> DataFrame:
    """``part, entry, components``: the codebooks as rows, to be stored beside the codes."""
    rows = [(p, e, c) for p, book in enumerate(books.tolist()) for e, c in enumerate(book)]
    return spark.createDataFrame(rows, "part int, entry int, components array<long>")


def compressed(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Codes (``id, label, code, error``) of all usable rows, and the codebooks."""
    vectors = staged(quantised(rows, key, label, vector, scale), "vectors")
    start = first_books(vectors, parts, entries)
    own = vectors.where(F.size("v") == start.shape[0] * start.shape[2])
    books = trained_books(own, start, rounds)
    return encoded(own, books), books


def report(rows: DataFrame, **options) -> DataFrame:
    """``vec_id, code`` (two hex digits a part)``, error, label_error, codebooks_sha256`` of every usable row."""
    codes, books = compressed(rows, **options)
    if books.shape[1] > 256:
        raise ValueError("two hex digits hold 256 entries")
    hexed = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    own = staged(codes.select(F.col("id").alias("vec_id"), "label", hexed.alias("code"), "error"), "codes")
    # A row for each label, written so that its size is known before the join.
    sums = staged(own.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label_errors")
    return own.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
