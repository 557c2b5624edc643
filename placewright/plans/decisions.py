"""Queries on reviews and their assembly, merged sources and planned changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators import reviewed
from placewright.plans.registry import query, table


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


CARDS_SQL = """
WITH a AS (SELECT c_custkey AS c, c_custkey // 6 AS g, c_custkey % 6 AS j FROM customer),
b AS (SELECT c, g, j, 'H' || g || CASE WHEN j < 2 THEN '' ELSE '-' || j END AS listing, 'M' || g || '-' || CASE WHEN j = 3 THEN 2 ELSE j END AS landmark, j = 0 AND g % 5 <> 0 AS cp, CASE WHEN j IN (2, 3) THEN 'M' || g || '-2' END AS hg, j = 2 AS hp, CASE WHEN j = 3 AND g % 7 = 0 THEN 'nearby-residential-context' ELSE 'same-listed-building' END AS relation FROM a WHERE j < 5)"""


def review_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as candidates, six to a block: two landmarks of one listing, two listings of one landmark, a plain link and a rejected one."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("candidate")).withColumns({"g": F.floor(F.col("candidate") / 6), "j": F.col("candidate") % 6})
    c, g, j = F.col("candidate"), F.col("g"), F.col("j")
    listing = text_of("H", g, F.when(j < 2, "").otherwise(text_of("-", j)))
    landmark = text_of("M", g, "-", F.when(j == 3, 2).otherwise(j))
    pair = lambda m, a: F.struct(m.cast("long").alias("member"), a.alias("address"))
    candidates = own.select("candidate", landmark.alias("landmark"), listing.alias("listing"), F.array(c).alias("members"), (~((j == 4) & (g % 4 == 0))).alias("has_point"), F.array(pair(c, text_of("No. ", c)), pair(g, F.lit("Rue"))).alias("addresses"))
    source = lambda u, t: F.struct(u.alias("url"), t.alias("title"))
    none = F.lit(None).cast("string")
    first = own.select(
        "candidate", F.lit(1).alias("seq"), F.lit("accept-same").alias("decision"), F.lit("r").alias("reason"), none.alias("replaces_decision"), none.alias("replaces_reason"), listing.alias("listing"), F.array(F.when((g % 11 == 0) & (j == 4), c + 1).otherwise(c)).alias("members"),
        F.when((j == 3) & (g % 7 == 0), reviewed.NEARBY).otherwise("same-listed-building").alias("relation"), F.when(j < 2, listing).alias("card_group"), ((j == 0) & (g % 5 != 0)).alias("card_primary"), F.when(j.isin(2, 3), text_of("M", g, "-2")).alias("heritage_group"), (j == 2).alias("heritage_primary"),
        F.array(text_of("a", g), text_of("b", j)).alias("aliases"), F.array(source(text_of("https://x.org/", g), text_of("t", j)), source(text_of("https://x.org/", g, "/", j), F.lit("t")), source(F.lit("http://www.virtualshanghai.net/a"), F.lit("v"))).alias("sources"))
    second = first.where(F.col("candidate") % 6 == 5).withColumns({"seq": F.lit(2), "decision": F.lit("reject"), "replaces_decision": F.when(F.floor(F.col("candidate") / 6) % 3 != 0, "accept-same").otherwise("other"), "replaces_reason": F.lit("r")})
    return candidates, first.unionByName(second)


@query(f"""{CARDS_SQL},
l AS (SELECT listing, arg_min(c, (NOT cp, c)) AS id, min(c) AS seq, arg_min(landmark, (NOT cp, c)) AS landmark, list(landmark ORDER BY NOT cp, c)[2:] AS more_landmarks, any_value(hg) AS hg, any_value(hp) AS hp, arg_min(relation, (NOT cp, c)) AS relation, bool_or(relation LIKE 'nearby%') AS nearby, list(c ORDER BY NOT cp, c) AS cs, any_value(g) AS g FROM b GROUP BY listing),
h AS (SELECT arg_min(id, (NOT hp, id)) AS id, arg_min(listing, (NOT hp, id)) AS listing, arg_min(landmark, (NOT hp, id)) AS landmark, arg_min(more_landmarks, (NOT hp, id)) AS more_landmarks, list(listing ORDER BY NOT hp, id)[2:] AS more_listings, arg_min(relation, (NOT hp, id)) AS relation, bool_or(nearby) AS nearby, flatten(list(cs ORDER BY NOT hp, id)) AS cs, any_value(g) AS g, true AS wide, bool_or(nearby) AS near FROM l WHERE hg IS NOT NULL GROUP BY hg
 UNION ALL SELECT id, listing, landmark, more_landmarks, [], relation, nearby, cs, g, false, false FROM l WHERE hg IS NULL)
SELECT id, listing, landmark, array_to_string(more_landmarks, ',') AS more_landmarks, array_to_string(more_listings, ',') AS more_listings, relation, nearby, CASE WHEN wide THEN len(cs) + 1 ELSE 2 * len(cs) END AS n_addresses,
 array_to_string(list_concat(['a' || g], list_transform(cs, lambda c: 'b' || (c % 6) || CASE WHEN near AND c % 6 = 3 THEN ',No. ' || c || ',Rue' ELSE '' END)), ',') AS aliases, array_to_string(list_concat(['t' || (cs[-1] % 6)], list_transform(cs, lambda c: 't')), ',') AS titles FROM h""")
def reviewed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted links folded twice: the landmarks of a listing, then the listings of a landmark."""
    cards, _ = reviewed.reviewed_links(*review_tables(spark, sf_dir))
    return cards.select("id", "listing", "landmark", F.array_join("more_landmarks", ",").alias("more_landmarks"), F.array_join("more_listings", ",").alias("more_listings"), "relation", "nearby", F.size("addresses").alias("n_addresses"), F.array_join("aliases", ",").alias("aliases"), F.array_join(F.transform("sources", lambda s: s["title"]), ",").alias("titles"))


@query(f"""{CARDS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY listing) AS n, count(*) OVER (PARTITION BY landmark) AS m, count(*) FILTER (relation LIKE 'nearby%') OVER (PARTITION BY hg) AS near FROM b),
r AS (SELECT c, CASE WHEN j = 4 AND g % 11 = 0 THEN 'membership-differs' END AS rule FROM n UNION ALL SELECT c, CASE WHEN j = 4 AND g % 4 = 0 THEN 'unresolved-point-or-scope' END FROM n UNION ALL SELECT c, CASE WHEN j < 2 AND (n < 2 OR g % 5 = 0) THEN 'incomplete-shared-card' END FROM n UNION ALL SELECT c, CASE WHEN hg IS NOT NULL AND (m < 2 OR near = 1) THEN 'incomplete-multi-listing-card' END FROM n
 UNION ALL SELECT c, CASE WHEN (j < 2 AND n = 2 AND g % 5 = 0) OR (hg IS NOT NULL AND m = 2 AND near = 1) THEN 'competing-identity' END FROM n UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 AND (c_custkey // 6) % 3 = 0 THEN 'supersedes-unnamed' END FROM customer)
SELECT rule, c::VARCHAR AS "key" FROM r WHERE rule IS NOT NULL""")
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids links, found on all of them before any is folded."""
    return reviewed.reviewed_links(*review_tables(spark, sf_dir))[1].select("rule", "key")


@query("""
WITH i AS (SELECT o_orderkey AS k, o_custkey % 4 AS p FROM orders WHERE o_orderkey % 10 <> 0), r AS (SELECT k, CASE WHEN k % 97 = 0 THEN (p + 1) % 4 ELSE p END AS p FROM i WHERE k % 53 <> 0 UNION ALL SELECT k, p FROM i WHERE k % 89 = 0 AND k % 53 <> 0 AND k % 97 <> 0),
ip AS (SELECT k, p, count(*) AS n FROM i GROUP BY ALL), rp AS (SELECT k, p, count(*) AS n FROM r GROUP BY ALL)
SELECT 'duplicate-decision' AS rule, k::VARCHAR AS "key" FROM rp WHERE n > 1 UNION ALL SELECT 'undecided', k::VARCHAR FROM ip ANTI JOIN rp USING (k, p) UNION ALL SELECT 'unassigned-decision', k::VARCHAR FROM rp ANTI JOIN ip USING (k, p)
UNION ALL SELECT 'overlapping-parts', k::VARCHAR FROM (SELECT DISTINCT k FROM rp) WHERE k % 10 = 7 AND k % 3 = 0 UNION ALL SELECT 'input-drifted', k::VARCHAR FROM i WHERE k % 71 = 0""")
def assembled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of a review: undecided, misplaced and repeated decisions, rows that drifted, and keys that an earlier review had."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    inputs = o.where(k % 10 != 0).withColumns({"part": F.col("o_custkey") % 4, "o_totalprice": F.when(k % 71 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    taken = inputs.where(k % 53 != 0).select("o_orderkey", F.when(k % 97 == 0, (F.col("part") + 1) % 4).otherwise(F.col("part")).alias("part"))
    reviews = taken.unionByName(taken.where((k % 89 == 0) & (k % 97 != 0)))
    return reviewed.assembled(o, inputs, reviews, o.where((k % 10 == 7) & (k % 3 == 0)).select("o_orderkey"), "o_orderkey")[1].select("rule", "key")


def merge_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_name", "c_mktsegment", "c_acctbal")
    k = F.col("id")
    live = c.where(k % 11 != 0).select("id", F.when(k % 5 != 0, F.lower("c_name")).alias("name"), F.upper("c_mktsegment").alias("address"))
    file = c.where(k % 3 != 0).select("id", F.col("c_name").alias("name"), F.lit("file").alias("address"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("x"))
    file = file.unionByName(file.where(k % 61 == 1))
    pages = c.where(k % 3 == 0).where(k % 7 != 0).select("id", F.concat(F.lit("page "), "c_name").alias("name"), F.lit("page").alias("address"), F.col("c_acctbal").alias("x"))
    fixes = c.where(k % 8 == 0).select("id", F.lit(1.5).alias("x"))
    fields = {"name": [("pages", "takes"), ("live", "takes"), ("file", "fills")], "address": [("live", "takes")], "x": [("file", "fills"), ("pages", "fills"), ("fixes", "fills")]}
    return reviewed.merged_sources([("live", live), ("file", file), ("pages", pages), ("fixes", fixes)], "id", fields, "live", ["file", "pages"], ["x"])


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'page ' || c_name WHEN c_custkey % 5 <> 0 THEN lower(c_name) END AS name, upper(c_mktsegment) AS address, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 <> 0 THEN c_acctbal WHEN c_custkey % 8 = 0 THEN 1.5 END AS x,
 'name=' || CASE WHEN c_custkey % 3 = 0 THEN 'pages' ELSE 'live' END || ',address=live' || CASE WHEN c_custkey % 3 = 0 THEN ',x=pages' WHEN c_custkey % 4 <> 0 THEN ',x=file' WHEN c_custkey % 8 = 0 THEN ',x=fixes' ELSE '' END AS origin FROM customer WHERE c_custkey % 11 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 7 <> 0)""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live list, a file, pages for what the file lacks, and fixes for missing places, with the origin of every field."""
    made, _ = merge_tables(spark, sf_dir)
    return made.withColumn("origin", F.array_join(F.transform(F.map_entries("origin"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("""
SELECT 'duplicate-in-file' AS rule, c_custkey::VARCHAR AS "key" FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 61 = 1 UNION ALL SELECT 'pending', c_custkey::VARCHAR FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 21 = 0
UNION ALL SELECT 'absent-from-master', c_custkey::VARCHAR FROM customer WHERE c_custkey % 11 = 0 AND (c_custkey % 3 <> 0 OR c_custkey % 7 <> 0) UNION ALL SELECT 'missing-x', c_custkey::VARCHAR FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 8 = 4""")
def merge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_tables(spark, sf_dir)[1].select("rule", "key")


@query("""
SELECT 'key-removed-or-added' AS rule, o_orderkey::VARCHAR AS "key", 'removed' AS detail FROM orders WHERE o_orderkey % 101 = 0 UNION ALL SELECT 'protected-field-changed', o_orderkey::VARCHAR, 'o_custkey' FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 101 <> 0
UNION ALL SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'unplanned-change' ELSE 'untargeted-record-changed' END, o_orderkey::VARCHAR, 'o_custkey' FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 101 <> 0
UNION ALL SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'unplanned-change' ELSE 'untargeted-record-changed' END, o_orderkey::VARCHAR, 'o_orderpriority' FROM orders WHERE o_orderkey % 41 = 0 AND o_orderkey % 101 <> 0
UNION ALL SELECT 'plan-not-applied', o_orderkey::VARCHAR, 'o_orderstatus' FROM orders WHERE o_orderkey % 6 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 101 = 0)""")
def planned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table against the plan that should lead from one to the other."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    after = o.where(k % 101 != 0).withColumns({"o_custkey": F.when(k % 37 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_orderpriority": F.when(k % 41 == 0, "0-NOW").otherwise(F.col("o_orderpriority")), "o_orderstatus": F.when((k % 6 == 0) & (k % 5 != 0), "held").otherwise(F.col("o_orderstatus"))})
    plans = o.where(k % 6 == 0).select("o_orderkey", F.lit("o_orderstatus").alias("field"), F.lit("held").alias("value"))
    return reviewed.planned_changes(o, after, plans, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_custkey"])


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS g FROM part) SELECT 'kept-apart' AS rule, a.k || '+' || b.k AS "key", a.g::VARCHAR AS detail FROM s a JOIN s b ON b.k = a.k + 1 AND a.g = b.g""")
def kept_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts should not share a size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("g"))
    return reviewed.kept_apart(p.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")), p, "k", "g")


@query("""WITH f AS (SELECT c_custkey AS m, c_nationkey AS g, CASE WHEN c_custkey % 3 <> 0 THEN 'use' END AS use, CASE WHEN c_custkey % 4 <> 0 THEN 'held' END AS status FROM customer WHERE c_custkey % 10 <> 9)
SELECT 'hold-not-cleared' AS rule, m::VARCHAR AS "key", 'use' AS detail FROM f WHERE g < 5 AND use IS NOT NULL UNION ALL SELECT 'hold-status', m::VARCHAR, status FROM f WHERE g < 5 AND status IS NULL UNION ALL SELECT 'hold-incomplete', m::VARCHAR, g::VARCHAR FROM f WHERE g < 5 AND m % 7 = 0
UNION ALL SELECT 'hold-without-feature', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer WHERE c_nationkey < 5 AND c_custkey % 10 = 9 AND c_custkey % 7 <> 0""")
def holds_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds of five groups: what they should have cleared, covered and marked."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("m"), F.col("c_nationkey").alias("g"))
    features = c.where("m % 10 <> 9").select("m", "g", F.when(F.col("m") % 3 != 0, "use").alias("use"), F.when(F.col("m") % 4 != 0, "held").alias("status"))
    holds = c.where("g < 5 AND m % 7 <> 0").groupBy("g").agg(F.collect_list("m").alias("members"))
    return reviewed.holds_kept(features, holds, "g", "m", ["use"], "status")
