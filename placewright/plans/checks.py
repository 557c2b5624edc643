"""Constraint queries: rows are violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators import validate as V
from placewright.operators.relational import chunked
from placewright.plans.registry import query, table


@query("""SELECT 'required' AS rule, event_id::VARCHAR AS key, 'value' AS detail FROM events WHERE value IS NULL OR event_type = 'error' UNION ALL SELECT 'required', event_id::VARCHAR, 'props' FROM events WHERE props IS NULL OR trim(props) = '' OR event_id % 7 = 0""")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors have no value here, and every seventh row blank properties."""
    own = table(spark, sf_dir, "events").withColumns({"value": F.when(F.col("event_type") != "error", F.col("value")), "props": F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("props"))})
    return V.required(own, "event_id", ["value", "props"])


@query("SELECT 'unique' AS rule, l_orderkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT 'references' AS rule, doc_id::VARCHAR AS key, doc_id::VARCHAR AS detail FROM documents ANTI JOIN labels USING (doc_id)")
def validate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.references(table(spark, sf_dir, "documents"), "doc_id", "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT 'price-range' AS rule, o_orderkey::VARCHAR AS key, o_orderstatus AS detail FROM orders WHERE NOT coalesce(o_totalprice < 300000 AND o_orderstatus <> 'P', false)")
def validate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.holds(table(spark, sf_dir, "orders"), "price-range", "o_orderkey", (F.col("o_totalprice") < 300000) & (F.col("o_orderstatus") != "P"), F.col("o_orderstatus"))


@query("""SELECT 'text' AS rule, doc_id::VARCHAR AS key, NULL::VARCHAR AS detail FROM documents WHERE regexp_matches(replace(text, '@', '?'), '[�?]')""")
def validate_damaged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.holds(table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "@", "?")), "text", "doc_id", ~F.col("text").rlike("[�?]"))


@query("""SELECT 'url' AS rule, page_id::VARCHAR AS key, url AS detail FROM pages WHERE NOT regexp_matches(url, '^https?://[a-z0-9.-]+/[a-z]{2}/[0-9]+$')""")
def validate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.holds(table(spark, sf_dir, "pages"), "url", "page_id", F.col("url").rlike("^https?://[a-z0-9.-]+/[a-z]{2}/[0-9]+$"), F.col("url"))


@query("""SELECT 'sorted' AS rule, o_orderkey::VARCHAR AS key, b || ' > ' || d AS detail FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, lag(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b > d""")
def validate_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return V.sorted_by(own, "o_orderkey", "o_orderkey", "d", ["o_custkey"])


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber < 7 GROUP BY 1)
SELECT 'conserved' AS rule, k::VARCHAR AS key, a.n || ' -> ' || coalesce(b.n, 0) AS detail FROM a LEFT JOIN b USING (k) WHERE a.n <> coalesce(b.n, 0)""")
def validate_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return V.conserved(li, li.where("l_linenumber < 7"), "l_orderkey")


@query("""SELECT 'accounted' AS rule, o_custkey::VARCHAR AS key, (f + o) || ' <> ' || n AS detail FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS n FROM orders GROUP BY 1) WHERE f + o <> n""")
def validate_accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count("*").alias("n"))
    return V.accounted(own, "o_custkey", ["f", "o"], "n")


@query("""SELECT 'combinations' AS rule, l_orderkey::VARCHAR AS key, l_returnflag || '|' || l_linestatus AS detail FROM lineitem WHERE (l_returnflag, l_linestatus) NOT IN (('N', 'O'), ('A', 'F'), ('R', 'F'))""")
def validate_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.combinations(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], [("N", "O"), ("A", "F"), ("R", "F")])


@query("""SELECT 'coverage' AS rule, NULL::VARCHAR AS key, n::VARCHAR AS detail FROM (SELECT count(*) AS n FROM labels) WHERE n < 1000000000 UNION ALL SELECT 'frozen', '25', n::VARCHAR FROM (SELECT count(*) AS n FROM region) WHERE n <> 25""")
def validate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.all_of(V.at_least(table(spark, sf_dir, "labels"), "coverage", F.count("*"), 10**9), V.cardinality(table(spark, sf_dir, "region"), "frozen", 25))


@query("""SELECT 'digests' AS rule, r_regionkey::VARCHAR AS key, sha256(r_name) AS detail FROM region WHERE r_regionkey % 2 = 1""")
def validate_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return V.digests(r, "r_regionkey", "r_name", r.select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 1, "changed").otherwise(F.sha2("r_name", 256)).alias("sha256")))


@query("""SELECT 'present' AS rule, 'NATION_XX|1' AS key, 'missing' AS detail""")
def validate_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return V.present(n, n.unionByName(spark.createDataFrame([("NATION_XX", 1)], "n_name string, n_regionkey int")))


@query("""WITH r AS (SELECT p_partkey, (floor((row_number() OVER (ORDER BY p_partkey) - 1) / 50) + 1)::INT AS chunk FROM part), k AS (SELECT * FROM r WHERE p_partkey % 97 <> 0), n AS (SELECT chunk, count(*) AS n FROM k GROUP BY 1)
SELECT 'chunks' AS rule, chunk::VARCHAR AS key, n::VARCHAR AS detail FROM n WHERE (chunk < (SELECT max(chunk) FROM n) AND n <> 50) OR n > 50""")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunked(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 50)
    return V.chunks(own.where("p_partkey % 97 <> 0"), "chunk", 50)
