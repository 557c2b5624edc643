"""Queries on joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewright.functions import address
from placewright.operators import relational as R
from placewright.operators.overlay import first_hold
from placewright.plans.registry import query, table


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_group(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT o_orderkey, o_custkey || '-' || lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR, 2, '0') AS id FROM orders")
def occurrence_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.occurrence(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"])
    return own.select("o_orderkey", F.concat_ws("-", "o_custkey", F.lpad(F.col("occurrence").cast("string"), 2, "0")).alias("id"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("is_signup", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return R.forward_fill(own, "is_signup", ["user_id"], ["ts", "event_id"], "signup").select("event_id", "signup")


@query("""
WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n, min(event_id) AS first_id FROM i WHERE event_type IS NOT NULL GROUP BY ALL""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.islands(table(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"])
    return own.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
WITH f AS (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY lower(p_name)) AS freq FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY freq, lower(p_name), p_partkey) AS rank FROM f)
SELECT p_partkey, rank, (floor((rank - 1) / 50) + 1)::INT AS chunk FROM r""")
def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ranked by how common their name is, then name and id, in chunks of fifty."""
    own = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name")).withColumn("freq", F.count("*").over(Window.partitionBy("name")))
    return R.chunked(own, ["freq", "name", "p_partkey"], 50).select("p_partkey", F.col("rank").cast("long").alias("rank"), "chunk")


@query("""SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) - 1 AS left_rivals, count(*) OVER (PARTITION BY l_suppkey) - 1 AS right_rivals FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def competition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.competition(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey")


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS r FROM c) SELECT l_partkey, l_suppkey, n FROM r WHERE r = 1""")
def label_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return R.first_per_group(counts, ["l_partkey"], [-F.col("n"), "l_suppkey"])


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey, min(o_orderpriority) AS priority FROM orders GROUP BY o_custkey")
def best_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("o_orderkey"), F.min("o_orderpriority").alias("priority"))


@query("""SELECT c_custkey, coalesce(min(year(o_orderdate)), 1949)::INT AS first_year, max(year(o_orderdate))::INT AS last_year FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def period_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("last_year"))
    own = table(spark, sf_dir, "customer").join(years, F.col("c_custkey") == F.col("o_custkey"), "left")
    return own.select("c_custkey", F.coalesce("a", F.lit(1949)).alias("first_year"), "last_year")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, count(*) AS n FROM embeddings GROUP BY label")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("y"), F.count("*").alias("n"))


@query("""
WITH g AS (SELECT c_nationkey || '|' || c_mktsegment AS k, count(*) AS n, count(DISTINCT c_acctbal > 0) AS v FROM customer GROUP BY 1)
SELECT sum(n)::BIGINT AS eligible, count(*) AS keys, count(*) FILTER (n > 1) AS shared, max(n) AS largest, count(*) FILTER (n > 1 AND v > 1) AS mixed FROM g""")
def collision_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collisions(table(spark, sf_dir, "customer"), F.concat_ws("|", "c_nationkey", "c_mktsegment"), F.col("c_acctbal") > 0)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS populated, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim({c}::VARCHAR) = '') AS blanks, count(*) FILTER (regexp_matches({c}::VARCHAR, '^-?0+(\\.0*)?$')) AS zeros, count(DISTINCT {c}) AS "distinct" FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("""SELECT count(*) FILTER (y % 5 = 0) AS unknown, count(*) FILTER (y % 5 <> 0 AND y <= 1995) AS early, count(*) FILTER (y % 5 <> 0 AND y > 1995) AS late, min(y) FILTER (y % 5 <> 0)::INT AS first_year, max(y) FILTER (y % 5 <> 0)::INT AS last_year FROM (SELECT year(o_orderdate) AS y FROM orders)""")
def year_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year column in which every fifth year stands for unknown."""
    y = F.nullif(F.when(F.col("y") % 5 == 0, 0).otherwise(F.col("y")), F.lit(0))
    own = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).select(y.alias("y"))
    return own.agg(F.count_if(F.col("y").isNull()).alias("unknown"), F.count_if(F.col("y") <= 1995).alias("early"), F.count_if(F.col("y") > 1995).alias("late"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return made.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1""")
def array_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query("""SELECT l_orderkey, l_returnflag AS flag, arg_min(l_linenumber, l_linenumber) AS first_line, arg_max(l_linenumber, l_linenumber) AS last_line FROM lineitem GROUP BY ALL""")
def map_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to merge maps: the first value of a key holds, or the last."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min_by("l_linenumber", "l_linenumber").alias("a"), F.max_by("l_linenumber", "l_linenumber").alias("b"))
    maps = own.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("a", "b")))).alias("m"))
    return maps.select("l_orderkey", F.explode("m").alias("flag", "v")).select("l_orderkey", "flag", F.col("v.a").alias("first_line"), F.col("v.b").alias("last_line"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, _ = R.require(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf_dir, "customer"), ["c_custkey"])
    return hit.select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def anti_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 40 = 0)""")
def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rows that only removed facts used (only every fortieth supplier stays)."""
    s, n = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(spark, sf_dir, "nation")
    return n.join(s.where("s_suppkey % 40 <> 0"), "n_nationkey", "left_semi").join(s.where("s_suppkey % 40 = 0"), "n_nationkey", "left_anti").select("n_nationkey")


@query("""
WITH a AS (SELECT n_nationkey, unnest([n_name, lower(n_name), 'alias ' || n_name]) AS alias FROM nation), q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'alias ' || n_name ELSE lower(n_name) END AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT s_suppkey, n_nationkey FROM q JOIN a USING (alias)""")
def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on any of several aliases."""
    n = table(spark, sf_dir, "nation")
    a = n.select("n_nationkey", F.explode(F.array("n_name", F.lower("n_name"), F.concat(F.lit("alias "), "n_name"))).alias("alias"))
    q = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("alias "), "n_name")).otherwise(F.lower("n_name")).alias("alias"))
    return q.join(a, "alias").select("s_suppkey", "n_nationkey").distinct()


@query("""
WITH probes AS (SELECT o_orderkey, unnest([o_custkey * 3, o_custkey * 2, o_custkey]) AS k, unnest([0, 1, 2]) AS pos FROM orders),
hits AS (SELECT o_orderkey, k, c_mktsegment, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS r FROM probes JOIN customer ON k = c_custkey)
SELECT o_orderkey, k AS c_custkey, c_mktsegment FROM hits WHERE r = 1""")
def key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several keys that exists."""
    c = F.col("o_custkey")
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.array(c * 3, c * 2, c).alias("keys"))
    return R.key_fallback(left, "keys", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_custkey"])


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS part_id, l_partkey AS item FROM lineitem WHERE l_linenumber <= 2), w AS (SELECT DISTINCT l_orderkey AS whole_id, l_partkey AS item FROM lineitem),
s AS (SELECT part_id, count(*) AS n FROM p GROUP BY 1), c AS (SELECT part_id, whole_id, count(*) AS n FROM p JOIN w USING (item) GROUP BY ALL)
SELECT part_id, whole_id FROM c JOIN s USING (part_id) WHERE c.n = s.n""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first two parts are all in another order too."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"))
    return R.contained_sets(li.where("l_linenumber <= 2").withColumnRenamed("l_orderkey", "part_id"), li.withColumnRenamed("l_orderkey", "whole_id"), "part_id", "whole_id", "item")


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS s FROM lineitem WHERE NOT (l_linenumber = 1 AND l_orderkey % 3 = 0) GROUP BY 1)
SELECT a.l_orderkey FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.s = b.s""")
def guarded_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays apply only where a group still has exactly the members it was reviewed with."""
    li = table(spark, sf_dir, "lineitem")
    return R.same_sets(li, li.where("NOT (l_linenumber = 1 AND l_orderkey % 3 = 0)"), "l_orderkey", "l_partkey")


@query("""SELECT l_orderkey, end_b FROM (SELECT l_orderkey, l_partkey * 50 + l_quantity::BIGINT AS end_b, count(*) OVER (PARTITION BY l_partkey * 50 + l_quantity::BIGINT) AS n FROM lineitem) WHERE n = 1""")
def competing_links_inert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.only_once(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 50 + F.col("l_quantity").cast("long")).alias("end_b")), "end_b")


HOLDS = [(1, 7, None), (2, None, [30, 60, 90]), (3, 11, [44])]


@query("""
WITH h(hold, grp, members) AS (VALUES (1, 7, NULL::BIGINT[]), (2, NULL, [30, 60, 90]), (3, 11, [44])),
g AS (SELECT o_custkey AS grp, list(o_orderkey) AS ids FROM orders GROUP BY 1)
SELECT g.grp, min(hold) AS hold FROM g, h WHERE h.grp = g.grp OR list_has_any(coalesce(h.members, []), g.ids) OR (h.grp = g.grp + 1 AND (len(g.ids) = 0 OR h.members IS NULL)) GROUP BY 1""")
def hold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hold of each group: by its key, by a shared member, or by an older key where the hold names no members. The
    three ways are three equi-joins, not one join on a disjunction."""
    holds = spark.createDataFrame(HOLDS, "hold int, grp long, members array<long>")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("member"), F.array(F.col("o_custkey") + 1).alias("legacy"))
    return first_hold(orders, holds)


@query("""SELECT a.l_orderkey AS a, b.l_orderkey AS b, a.l_linenumber AS line FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber AND a.l_orderkey < b.l_orderkey AND a.l_orderkey % 2 = b.l_orderkey % 2
WHERE greatest(a.l_partkey, b.l_partkey) + CASE WHEN greatest(a.l_partkey, b.l_partkey) % 2 = a.l_orderkey % 2 THEN 0 ELSE 1 END <= least(a.l_partkey + a.l_quantity::BIGINT, b.l_partkey + b.l_quantity::BIGINT)""")
def interval_overlap_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door ranges on one street (supplier and line) that share a number of the side both are on."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("l_partkey").alias("low"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("high"), (F.col("l_orderkey") % 2).cast("int").alias("side"))
    met = R.overlapping(own, ["l_suppkey", "l_linenumber", "side"], "l_orderkey", "low", "high", 64)
    first = F.greatest("low", "other_low") + F.when(F.greatest("low", "other_low") % 2 == F.col("side"), 0).otherwise(1)
    return met.where(first <= F.least("high", "other_high")).select(F.col("l_orderkey").alias("a"), F.col("other").alias("b"), F.col("l_linenumber").alias("line"))


@query("""
WITH a AS (SELECT c_custkey, (c_custkey * 7919) % 100003 AS code FROM customer), b AS (SELECT c_custkey AS other, ((c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) * 7919) % 100003 AS code FROM customer),
a1 AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY code) = 1), b1 AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY code) = 1)
SELECT c_custkey, other FROM a1 JOIN b1 USING (code)""")
def bijective_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two code systems joined where each code stands once on each side; every fifth row of the second one takes its neighbour's code."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("long")
    a = R.only_once(c.select("c_custkey", (k * 7919 % 100003).alias("code")), "code")
    b = R.only_once(c.select(F.col("c_custkey").alias("other"), ((k + F.when(k % 5 == 0, 1).otherwise(0)) * 7919 % 100003).alias("code")), "code")
    return a.join(b, "code").select("c_custkey", "other")


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS s, CASE WHEN n_nationkey IN (20, 21) THEN 41 - n_nationkey ELSE n_nationkey // 2 END AS t FROM nation WHERE n_nationkey > 0),
w AS (SELECT s, t AS pos, 1 AS hops FROM e UNION ALL SELECT w.s, e.t, hops + 1 FROM w JOIN e ON w.pos = e.s WHERE hops < 30)
SELECT e.s AS source, d.pos AS final, d.hops FROM e LEFT JOIN (SELECT * FROM w WHERE pos NOT IN (SELECT s FROM e)) d ON e.s = d.s""")
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").where(n > 0).select(n.alias("s"), F.when(n.isin(20, 21), 41 - n).otherwise(F.floor(n / 2).cast("int")).alias("t"))
    return R.redirects(edges, "s", "t")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return R.upsert(old, old.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("""SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, '*' AS field, CASE WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'added' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL
UNION ALL SELECT a.o_orderkey, 'o_orderstatus', 'changed' FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
UNION ALL SELECT a.o_orderkey, 'o_orderpriority', 'changed' FROM a JOIN b USING (o_orderkey) WHERE a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    after = o.where(k % 13 != 0).withColumns({"o_orderstatus": F.when(k % 7 == 0, "Z").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 9 != 0, F.col("o_orderpriority"))})
    return R.field_diff(o.where(k % 11 != 0), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""SELECT 'left' AS side, o_custkey FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 50 <> 0)""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return R.set_differences(o.select("o_custkey"), o.where("o_orderkey % 50 <> 0").select("o_custkey"))


@query("""
WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_custkey FROM orders), b AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, o_custkey FROM orders)
SELECT o_custkey, bool_and(a.o_orderkey = b.o_orderkey) AS same FROM a JOIN b USING (o_custkey, i) GROUP BY 1""")
def sequence_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two orders of a group's rows are the same sequence."""
    o = table(spark, sf_dir, "orders")
    a = R.occurrence(o, ["o_custkey"], ["o_orderkey"], "i").select("o_custkey", "i", F.col("o_orderkey").alias("x"))
    b = R.occurrence(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], "i").select("o_custkey", "i", F.col("o_orderkey").alias("y"))
    return a.join(b, ["o_custkey", "i"]).groupBy("o_custkey").agg(F.bool_and(F.col("x") == F.col("y")).alias("same"))
