"""Toxicity by maximum-scoring segments of token log-odds.

Model. A token's weight is the log-odds of toxic against clean documents with a Dirichlet prior: the pooled shares
of all labelled training rows, scaled to ``prior`` pseudo-documents, and half a document on top. In these counts a token
counts once a document, so a word that one spam page repeats weighs no more than any other. Tokens whose own weight is less
than ``least_z`` standard deviations from 0 fall back on the weight of their first four letters (word stems with
unseen endings), and else on 0. Every token also pays ``drift``, so that a clean text scores downhill.

Scan. Every occurrence of a token scores, wherever else the same token stands. Within a text, the linear-time algorithm
for all maximal scoring segments finds every passage that stands out (Ruzzo and Tompa); runs of tokens that only go downhill are one step. Score statistics of segments are extreme
values: in background text a score reaches S with expectation ``K m exp(-lambda S)``, where lambda solves
``sum p(w) exp(lambda w) = 1`` over the background's token frequencies, and K is the maximum-likelihood value for the best
segments of the clean training texts, ``n / sum m exp(-lambda S)``. A passage's evidence is minus the logarithm
of the chance that ``m`` background tokens hold one so high; a document's evidence is the sum over its significant
passages, and a logistic curve of its logarithm fitted on the training fold turns it into a score from 0 to 1.

Bounds. Labelled rows for the fit are all there are, up to ``most_rows`` (chosen by hash, a documented bound on
fitting a classifier); counting is a Spark aggregation, and the driver sees the tokens that weigh and aggregates
only. A token needs several training documents to differ from 0 by ``least_z``, so the bound on rows bounds them too. Labels of documents whose crc32 is divisible by 5 are held out. The scan covers every whole text.

Defined results: null and empty texts have no passage and get the score of no evidence; labels, language, source and
id are no input of a score; with no labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.bpe import utf8
from placewright.llm.staging import whole_text

#: Separators of tokens: everything but letters and digits of any script. Used lower-cased.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Marks a stem among the weights; no token has this sign.
STEM = "*"
#: The same tokens for the scan.
TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    drift: float
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float

    def weigh(self, tokens: list[str]) -> np.ndarray:
        known = self.weights
        return np.array([known.get(t) or (known.get(t[:4] + STEM, 0.0) if len(t) > 4 else 0.0) for t in tokens])

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments that are significant: (first token, end, evidence)."""
        w = self.weigh(tokens) - self.drift
        rises = np.flatnonzero(w > 0)
        if not len(rises):
            return []
        sums = np.concatenate([[0.0], np.cumsum(w)])
        # Neighbouring rises are one step up; whatever lies between two such steps is one step down.
        starts = rises[np.concatenate([[True], np.diff(rises) > 1])]
        ends = rises[np.concatenate([np.diff(rises) > 1, [True]])] + 1
        found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, last one with less before
        for first, end in zip(starts.tolist(), ends.tolist(), strict=True):
            before, after = sums[first], sums[end]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][0] >= before:
                    j = found[j][4]
                if j < 0 or found[j][1] >= after:
                    found.append((before, after, first, end, j))
                    break
                before, first = found[j][0], found[j][2]
                del found[j:]
        out = []
        for before, after, first, end, _ in found:
            expected = self.scale * len(tokens) * math.exp(-self.rate * (after - before))
            # P(at least one) = 1 - exp(-expected)
            if expected < 1:
                out.append((first, end, -math.log(-math.expm1(-max(expected, 1e-300)))))
        return out

    def best(self, tokens: list[str]) -> float:
        """The score of the best segment; 0 if none rises."""
        sums = np.concatenate([[0.0], np.cumsum(self.weigh(tokens) - self.drift)])
        return float((sums - np.minimum.accumulate(sums)).max())

    def read(self, text: str) -> list[tuple[int, int, float]]:
        """The significant passages of a whole text."""
        tokens = TOKEN.findall(text.lower())
        return self.passages(tokens) if tokens else []

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * math.log1p(evidence) + self.offset))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def solve_rate(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p exp(rate w) = 1; the mean of w has to be below 0 and some w above."""
    low, high = 1e-6, 1.0
    while shares @ np.exp(np.minimum(high * weights, 700)) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if shares @ np.exp(np.minimum(mid * weights, 700)) >= 1 else (mid, high)
    return high


def fit(docs: DataFrame, labels: DataFrame, prior: float = 2000.0, least_z: float = 2.5, most_rows: int = 200_000) -> Model | None:
    """A model from labelled rows outside the held-out fold; None if one kind is missing."""
    # One label a document: toxic if any of its rows says so. Ids without a text have nothing to learn from.
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(whole_text(docs)).alias("text"))
    told = texts.join(F.broadcast(rows), "doc_id")  # at most ``most_rows`` rows of two numbers
    own = F.split("text", SEPARATORS)
    stems = F.transform(F.filter(own, lambda t: F.length(t) > 4), lambda t: F.concat(F.substring(t, 1, 4), F.lit(STEM)))
    token = told.select("toxic", F.explode(F.array_distinct(F.concat(own, stems))).alias("token")).where("token <> ''")
    counts = token.groupBy("token").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum(1 - F.col("toxic").cast("long")).alias("good"))
    total = counts.agg(F.sum("bad"), F.sum("good")).first()
    bad_all, good_all = total[0] or 0, total[1] or 0
    if not bad_all or not good_all:
        return None
    share = (F.col("bad") + F.col("good")) / F.lit(float(bad_all + good_all)) * prior + 0.5
    bad, good = F.col("bad") + share, F.col("good") + share
    odds = F.log(bad / (bad_all + prior - bad)) - F.log(good / (good_all + prior - good))
    weighed = counts.withColumns({"weight": odds, "z": odds / F.sqrt(1 / bad + 1 / good)})
    kept = weighed.where(F.abs("z") >= least_z).select("token", "weight", "good").collect()  # bounded by the training rows
    weights = {r["token"]: float(r["weight"]) for r in kept}
    of_good = np.array([r["good"] for r in kept] + [good_all - sum(r["good"] for r in kept)], dtype=float)
    values = np.array([*weights.values(), 0.0])
    p = of_good / of_good.sum()
    drift = max(0.25, float(p @ values) + 0.25)
    rate = solve_rate(values - drift, p)
    raw = Model(weights, drift, rate, 1.0, 1.0, 0.0)
    raw = Model(weights, drift, rate, background_scale(told.where("toxic = 0"), raw), 1.0, 0.0)
    # The evidence of the training rows, as counts in bins: the logistic curve is fitted on at most a few hundred numbers.
    seen = evidence(told.select("doc_id", "text", "toxic"), raw, keep=("toxic",))
    bins = seen.groupBy(F.least(F.round(F.log1p("evidence") * 40), F.lit(400.0)).alias("bin"), "toxic").count().collect()
    x, y, n = (np.array([r[k] for r in bins], dtype=float) for k in ("bin", "toxic", "count"))
    slope, offset = logistic(x / 40, y, n)
    return Model(weights, drift, rate, raw.scale, slope, offset)


def background_scale(clean: DataFrame, model: Model) -> float:
    """K from the best segments of clean texts: a sum over them, made by Spark."""
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            n, total = 0, 0.0
            for text in utf8(batch.column("text")):
                tokens = TOKEN.findall(text.decode("utf-8").lower())
                if tokens:
                    n, total = n + 1, total + len(tokens) * math.exp(-own.rate * own.best(tokens))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    n, total = clean.select("text").mapInArrow(run, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    return min(1.0, max(1e-6, n / total)) if n and total else 0.1


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Weighted logistic regression of one variable by Newton's method, with a small penalty on the slope."""
    a = np.stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ a, -50, 50)))
        gradient = a @ (n * (p - y)) + np.array([ridge * w[0], 1e-6 * w[1]])
        hessian = (a * (n * p * (1 - p))) @ a.T + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def evidence(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """``doc_id, evidence`` of every text (and ``keep``); with ``spans``, also its passages by first token, end and evidence."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    out = ", ".join(["doc_id long", *(f"{k} {kinds[k].simpleString()}" for k in keep), "evidence double", *(["passages array<struct<first:int,end:int,evidence:double>>"] if spans else [])])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as the training rows bear

    def run(batches):
        own = shared.value
        for batch in batches:
            sums, found = [], []
            for text in utf8(batch.column("text")):
                got = own.read(text.decode("utf-8"))
                sums.append(math.fsum(e for *_, e in got))
                found.append([{"first": a, "end": b, "evidence": e} for a, b, e in got])
            columns = [batch.column("doc_id"), *(batch.column(k) for k in keep), pa.array(sums, pa.float64())]
            names = ["doc_id", *keep, "evidence"]
            if spans:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
                columns, names = [*columns, pa.array(found, kind)], [*names, "passages"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(run, out)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    if model is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    else:
        curve = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.log1p("evidence") * model.slope + model.offset))
        rows = evidence(docs, model).select("doc_id", (1 / (1 + F.exp(-curve))).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; the decision is made in the pass that reads the text."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def is_clean(text: str) -> bool:
        own = shared.value
        return own.score(math.fsum(e for *_, e in own.read(text))) < 0.5

    # Rows stay in the JVM: Python gets texts a hundred at a time and gives back decisions, as whole Arrow batches of texts, there and back, are too large.
    return docs.where(F.udf(is_clean, "boolean", useArrow=False)(whole_text(docs)))
