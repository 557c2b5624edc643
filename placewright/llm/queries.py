"""The corpus operators as registered queries; where SQL can say the same, ORACLES has it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import bpe, bwt_repeats, flac, fm_repeats, hard_negatives, line_dedup, main_text, packing, pieces, stable_projections, toxicity, vector_codes, weighted_minhash
from placewright.llm.staging import table


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_projections.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.store(table(spark, sf_dir, "documents")))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


def op8_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_repeats.digests(table(spark, sf_dir, "documents"), window=50)


def op9_bwt_interval_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_repeats.digests(table(spark, sf_dir, "documents"), length=200)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_pieces_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), scale=256, every=100, positives=5, negatives=5, low=80, high=100)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"), scale=256, parts=16, entries=64, rounds=2)


WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

HARD_NEGATIVES = f"""
WITH w AS ({WHOLE}), k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: x::DOUBLE) AS v FROM w WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""


def codes_sql(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """The rounds one after the other; a part's position is p, its entry e."""
    width = f"(len(v) // {parts})"
    steps = [
        f"k AS ({WHOLE})",
        f"x AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * {width} + 1, (p + 1) * {width}) AS x FROM k, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < {entries})",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min({distance} * {entries} + e)::BIGINT AS best FROM x JOIN c{r} USING (p) GROUP BY ALL)")
        if r < rounds:
            moved = f"(SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, best % {entries} AS e, i, floor(sum(x[i + 1])::DECIMAL(38, 0)::DOUBLE / count(*))::BIGINT AS m FROM a{r} JOIN x USING (vec_id, p), LATERAL (SELECT unnest(range(len(x))) AS i) GROUP BY ALL) GROUP BY ALL)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN {moved} m USING (p, e))")
    return f"""WITH {", ".join(steps)}, s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM c{rounds}),
d AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM d JOIN k USING (vec_id), s"""


QUERIES = {f.__name__: f for f in (op1_stable_projections, op2_best_fit_packing, op3_flac, op4_bpe_round_trip, op5_line_dedup, op6_main_text, op7_weighted_minhash, op8_fm_index_repeats, op9_bwt_interval_repeats, op10_toxicity, op11_pieces_round_trip, op12_hard_negatives, op13_vector_codes)}
ORACLES: dict[str, str] = {"op12_hard_negatives": HARD_NEGATIVES, "op13_vector_codes": codes_sql(2)}
