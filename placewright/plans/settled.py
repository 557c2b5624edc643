"""Queries on decisions carried through a whole population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators import settled
from placewright.plans.places import EDGE_VALUES, EDGES, LAT, LON, points
from placewright.plans.registry import query, table


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("landmark"), F.min("l_suppkey").alias("listing"), F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("qty"), F.min("l_discount").alias("off"), F.min("l_extendedprice").alias("price"))
    k = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    candidates = lines.select(k.alias("candidate"), "landmark", "listing", (F.col("flag") == "R").alias("near_only"), (F.col("qty") % 5 == 0).alias("held"), (F.col("off") > 0.02).alias("located"), (F.col("price") / 20).alias("distance"))
    c = F.col("candidate")
    decided = candidates.where("candidate % 7 = 0").select(c, F.when(c % 2 == 0, "accept-same-site").otherwise("hold").alias("decision"), c.alias("seq"))
    later = candidates.where("candidate % 21 = 0").select(F.when(c % 5 == 0, -c).otherwise(c).alias("candidate"), F.when(c % 4 == 0, "hold").otherwise("accept-card").alias("decision"), (c + 1).alias("seq"))
    return candidates, decided.unionByName(later)


PAIRS = """
WITH c AS (SELECT l_orderkey * 100 + l_linenumber AS candidate, min(l_partkey) AS landmark, min(l_suppkey) AS listing, min(l_returnflag) = 'R' AS near_only, min(l_quantity) % 5 = 0 AS held, min(l_discount) > 0.02 AS located, min(l_extendedprice) / 20 AS distance FROM lineitem GROUP BY l_orderkey, l_linenumber),
d AS (SELECT candidate, CASE WHEN candidate % 2 = 0 THEN 'accept-same-site' ELSE 'hold' END AS decision, candidate AS seq FROM c WHERE candidate % 7 = 0 UNION ALL SELECT CASE WHEN candidate % 5 = 0 THEN -candidate ELSE candidate END, CASE WHEN candidate % 4 = 0 THEN 'hold' ELSE 'accept-card' END, candidate + 1 FROM c WHERE candidate % 21 = 0),
l AS (SELECT candidate, arg_max(decision, seq) AS decision, max(seq) AS seq FROM d GROUP BY 1)
"""


@query(PAIRS + """, s AS (SELECT landmark, arg_max(listing, (seq, candidate)) AS selected FROM c JOIN l USING (candidate) WHERE starts_with(decision, 'accept-') GROUP BY 1)
SELECT candidate, selected, CASE WHEN starts_with(decision, 'accept-') THEN 'linked' WHEN seq IS NOT NULL THEN 'held-after-review' WHEN selected <> listing THEN 'alternative-not-proven' WHEN near_only THEN 'proximity-only' WHEN held THEN 'held-current-use-or-member-scope'
WHEN NOT located THEN 'needs-location-and-identity-review' WHEN distance > 1250 THEN 'needs-location-or-branch-review' ELSE 'needs-address-or-scope-evidence' END AS status FROM c LEFT JOIN l USING (candidate) LEFT JOIN s USING (landmark)""")
def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight statuses over all candidates, decided or not."""
    return settled.review_statuses(*_pairs(spark, sf_dir), far=1250.0)[0].select("candidate", "selected", "status")


@query(PAIRS + "SELECT 'decision-without-candidate' AS rule, candidate::varchar AS key, decision AS detail FROM l WHERE candidate NOT IN (SELECT candidate FROM c)")
def review_status_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled.review_statuses(*_pairs(spark, sf_dir))[1]


def _approvals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]:
    k, c, s = F.col("o_orderkey"), F.col("c_custkey"), F.col("s_suppkey")
    orders = table(spark, sf_dir, "orders")
    row = F.concat(F.lit("C"), k - F.when(k % 50 == 1, 1).otherwise(0))
    candidate = F.when(k % 77 == 0, -k - 1).otherwise(F.col("o_custkey"))
    approvals = orders.where("o_orderkey % 5 < 2").select(row.alias("row"), candidate.alias("candidate"), F.when(k % 6 == 0, F.concat(F.lit("L"), k % 89)).alias("corrected_listing"), F.when(k % 6 == 0, F.concat(F.lit("https://fgj/"), k)).alias("corrected_source"))
    contextual = orders.where("o_orderkey % 11 = 3").select(F.concat(F.lit("D"), k).alias("row"), candidate.alias("candidate"), F.col("o_orderpriority").alias("reason"), F.when(k % 4 == 0, F.array(F.lit("https://fgj/x"))).otherwise(F.array(F.lit("https://fgj/x"), F.concat(F.lit("https://e/"), k))).alias("sources"))
    address = F.concat(F.when(c % 9 == 0, "https://other/").otherwise("https://fgj/"), c)
    candidates = table(spark, sf_dir, "customer").select(c.alias("candidate"), F.floor(c / 2).alias("landmark"), F.concat(F.lit("L"), c % 97).alias("listing"), F.array(address).alias("sources"))
    located = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("L"), s).alias("listing"))
    return approvals, candidates, located, contextual, "fgj"


APPROVED = """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 77 = 0 THEN -o_orderkey - 1 ELSE o_custkey END AS candidate, o_orderpriority AS reason FROM orders),
a AS (SELECT 'C' || (k - CASE WHEN k % 50 = 1 THEN 1 ELSE 0 END) AS "row", k, candidate, count(*) OVER (PARTITION BY k - CASE WHEN k % 50 = 1 THEN 1 ELSE 0 END) AS n FROM o WHERE k % 5 < 2),
c AS (SELECT c_custkey AS candidate, c_custkey // 2 AS landmark, 'L' || (c_custkey % 97) AS listing, CASE WHEN c_custkey % 9 <> 0 THEN 'https://fgj/' || c_custkey END AS source FROM customer),
g AS (SELECT "row", n, candidate, landmark, CASE WHEN k % 6 = 0 THEN 'L' || (k % 89) ELSE listing END AS listing, CASE WHEN k % 6 = 0 THEN 'https://fgj/' || k ELSE source END AS source FROM a LEFT JOIN c USING (candidate)),
s AS (SELECT *, listing IN (SELECT 'L' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AS located FROM g WHERE n = 1 AND landmark IS NOT NULL),
x AS (SELECT 'D' || k AS "row", candidate, landmark, listing, source, reason, CASE WHEN k % 4 <> 0 THEN 'https://e/' || k END AS evidence FROM o LEFT JOIN c USING (candidate) WHERE k % 11 = 3),
n AS (SELECT 'unlocated' AS kind, "row", candidate, landmark, listing, source, NULL::varchar AS note, NULL::varchar AS evidence FROM s WHERE NOT located UNION ALL SELECT 'contextual', "row", candidate, landmark, listing, source, reason, evidence FROM x WHERE landmark IS NOT NULL)
"""


@query(APPROVED + """SELECT landmark, 'same-site-' || lower(min("row")) AS id, arg_min(listing, "row") AS listing, CASE WHEN count(*) > 1 THEN 'same-listed-complex' ELSE 'same-historical-site' END AS relation, string_agg(listing, '|' ORDER BY "row") AS listings, string_agg("row", '|' ORDER BY "row") AS rows FROM s WHERE located GROUP BY 1""")
def approved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals that have a point, by landmark."""
    links = settled.approved_sites(*_approvals(spark, sf_dir))[0]
    return links.select("landmark", "id", "listing", "relation", F.concat_ws("|", "listing", "more_listings").alias("listings"), F.array_join("rows", "|").alias("rows"))


@query(APPROVED + "SELECT * FROM n WHERE source IS NOT NULL AND (kind = 'unlocated' OR evidence IS NOT NULL)")
def approved_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals without a point, and decisions that only explain a neighbourhood."""
    return settled.approved_sites(*_approvals(spark, sf_dir))[1]


@query(APPROVED + """SELECT DISTINCT 'row-twice' AS rule, "row" AS key, n::varchar AS detail FROM g WHERE n > 1 UNION ALL SELECT 'approval-without-candidate', "row", candidate::varchar FROM g WHERE landmark IS NULL
UNION ALL SELECT 'context-without-candidate', "row", candidate::varchar FROM x WHERE landmark IS NULL UNION ALL SELECT 'note-without-source', "row", kind FROM n WHERE source IS NULL OR (kind = 'contextual' AND evidence IS NULL)""")
def approved_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled.approved_sites(*_approvals(spark, sf_dir))[2]


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p, s, c = F.col("p_partkey"), F.col("s_suppkey"), F.col("c_custkey")
    parts = table(spark, sf_dir, "part")
    features = parts.select(F.concat(F.lit("p"), p).alias("id"), F.when(p % 3 == 0, "point").otherwise("line").alias("kind"), F.concat_ws(" ", "p_brand", "p_type", p % 40).alias("name"), F.col("p_type").alias("modern"), F.lit(None).cast("long").alias("line"), (p % 50 == 0).alias("verified"))
    verified = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("M"), F.when(s % 9 == 1, s - 1).otherwise(s)).alias("modern"))
    lines = table(spark, sf_dir, "customer").select(c.alias("line"), F.array(F.concat(F.lit("M"), c % 700), F.concat(F.lit("M"), c % 70)).alias("names"))
    return features, verified, lines, parts.where("p_size > 40").select(F.concat_ws(" ", "p_brand", "p_type", p % 40).alias("name"))


REPLACED = """
WITH v AS (SELECT s_name AS name, 'M' || CASE WHEN s_suppkey % 9 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS modern, count(*) OVER (PARTITION BY CASE WHEN s_suppkey % 9 = 1 THEN s_suppkey - 1 ELSE s_suppkey END) AS n FROM supplier),
b AS (SELECT c_custkey AS line, 'M' || (c_custkey % 700) AS modern FROM customer UNION SELECT c_custkey, 'M' || (c_custkey % 70) FROM customer), p AS (SELECT *, p_brand || ' ' || p_type || ' ' || (p_partkey % 40) AS name FROM part)
"""


@query(REPLACED + """SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'point' ELSE 'line' END AS kind, name, p_type AS modern, NULL::bigint AS line, false AS verified FROM p WHERE p_partkey % 50 <> 0 AND (p_partkey % 3 = 0 OR name NOT IN (SELECT name FROM p WHERE p_size > 40))
UNION ALL SELECT 'verified-' || modern || '-' || line, 'line', name, modern, line, true FROM v JOIN b USING (modern) WHERE n = 1""")
def replaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified lines in the place of old ones."""
    return settled.replaced_lines(*_lines(spark, sf_dir))[0]


@query(REPLACED + "SELECT 'no-line-of-this-name' AS rule, modern AS key, name AS detail FROM v WHERE modern NOT IN (SELECT modern FROM b) UNION ALL SELECT DISTINCT 'verified-twice', modern, n::varchar FROM v WHERE n > 1")
def replaced_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled.replaced_lines(*_lines(spark, sf_dir))[1]


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {EDGE_VALUES}), p AS (SELECT vec_id, {LON} AS px, {LAT} AS py FROM embeddings),
i AS (SELECT vec_id, vec_id % 41 = 0 OR count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM p, e GROUP BY vec_id),
c AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'old-city' WHEN 1 THEN 'settlement' ELSE 'outskirts' END AS old FROM i), n AS (SELECT *, CASE WHEN inside THEN 'old-city' WHEN old = 'old-city' THEN 'administered' ELSE old END AS class FROM c) SELECT vec_id AS id, class, class <> old AS changed FROM n""")
def boundary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that a boundary with a hole and a curated list settle."""
    v = F.col("vec_id")
    own = points(spark, sf_dir).select(v.alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.when(v % 3 == 0, "old-city").when(v % 3 == 1, "settlement").otherwise("outskirts").alias("class"))
    edges = spark.createDataFrame([(0, *e) for e in EDGES], "polygon int, x1 double, y1 double, x2 double, y2 double")
    return settled.reclassified(own, edges, own.where("id % 41 = 0").select("id"), "old-city", "administered", 0.01).select("id", "class", "changed")
