"""Queries on lookups by alias, reviewed decisions, partitions, and joins with tables of lines and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import text
from placewright.operators import review, spatial
from placewright.plans.names import words_sql
from placewright.plans.places import EDGES, part
from placewright.plans.registry import query, table


@query(f"""
WITH i AS (SELECT {words_sql('n')} AS alias, p_partkey, min(field) AS field FROM (SELECT p_partkey, p_name AS n, 0 AS field FROM part UNION ALL SELECT p_partkey, p_brand || ' / ' || p_type, 1 FROM part UNION ALL SELECT p_partkey, p_brand, 1 FROM part UNION ALL SELECT p_partkey, p_type, 1 FROM part) GROUP BY ALL),
b AS (SELECT alias, min(field) AS field FROM i GROUP BY 1), e AS (SELECT alias, count(*) AS n, min(p_partkey) AS first_key FROM i JOIN b USING (alias, field) GROUP BY 1),
q AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Red  Widget' WHEN 1 THEN 'brand#' || (s_suppkey % 30) WHEN 2 THEN 'economy' ELSE 'old name' END AS asked FROM supplier)
SELECT s_suppkey, asked, coalesce(n, CASE WHEN asked = 'old name' THEN 1 END, 0) AS n, coalesce(first_key, CASE WHEN asked = 'old name' THEN -1 END) AS first_key, CASE WHEN n IS NOT NULL THEN 'exact' WHEN asked = 'old name' THEN 'manual' ELSE 'none' END AS how FROM q LEFT JOIN e ON {words_sql('asked')} = e.alias""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up over several columns with composite labels, the best column first, then a manual table."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.concat_ws(" / ", "p_brand", "p_type").alias("label"))
    index = review.name_index(parts, "p_partkey", ["p_name", "label"])
    k = F.col("s_suppkey")
    asked = F.when(k % 4 == 0, "Red  Widget").when(k % 4 == 1, F.concat(F.lit("brand#"), (k % 30).cast("string"))).when(k % 4 == 2, "economy").otherwise("old name")
    probes = table(spark, sf_dir, "supplier").select("s_suppkey", asked.alias("asked"))
    distinct = probes.select("asked").distinct()  # a name is looked up once, however many ask for it
    manual = spark.createDataFrame([("Old Name", -1), ("economy", -2), ("Economy", -3)], "alias string, p_partkey long")  # what has an exact name needs none
    found = review.by_alias(distinct, "asked", index, "p_partkey", manual).groupBy("asked").agg(F.count("p_partkey").alias("n"), F.min("p_partkey").alias("first_key"), F.first("how").alias("how"))
    return review.looked_up_once(probes, "asked", lambda _: found).select("s_suppkey", "asked", "n", "first_key", "how")


TERMS = {"ring": "anello", "small": "piccolo", "small ring": "anellino", "red": "rosso", "widget": "coso"}


@query("""WITH a AS (SELECT p_partkey, replace(p_name, 'small ring', 'anellino') AS n FROM part), b AS (SELECT p_partkey, CASE WHEN contains(n, 'red widget') THEN n ELSE replace(n, 'widget', 'coso') END AS n FROM a)
SELECT p_partkey, replace(replace(replace(n, 'small', 'piccolo'), 'ring', 'anello'), 'red', 'rosso') AS name FROM b""")
def dictionary_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest terms first; one of them is passed over inside a longer name."""
    return table(spark, sf_dir, "part").select("p_partkey", review.translated(F.col("p_name"), TERMS, {"widget": "red widget"}).alias("name"))


@query("""
WITH f AS (SELECT o_orderkey, unnest([o_custkey, o_custkey * 3, o_custkey + 1]) AS c_custkey, unnest([0, 1, 2]) AS pos FROM orders)
SELECT o.o_orderkey, coalesce(s.names, '') AS names FROM orders o LEFT JOIN (SELECT o_orderkey, string_agg(c_name, '|' ORDER BY pos) AS names FROM f JOIN customer USING (c_custkey) GROUP BY 1) s USING (o_orderkey)""")
def denormalised_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dimension for an array of ids, in order, without those that miss."""
    c = F.col("o_custkey")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.array(c, c * 3, c + 1).alias("ids"))
    made = review.denormalised(facts, "o_orderkey", "ids", table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "rows")
    return made.select("o_orderkey", F.array_join(F.transform("rows", lambda r: r["c_name"]), "|").alias("names"))


@query("SELECT l_orderkey, bool_or(l_suppkey % 3 = 0) AS some, bool_and(l_suppkey % 3 = 0) AS every FROM lineitem GROUP BY 1")
def approved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return review.approval(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", ok)


@query("""
WITH l AS (SELECT DISTINCT c_mktsegment AS id, lower(left(c_mktsegment, 6)) AS name FROM customer UNION SELECT DISTINCT p_name, p_name FROM part), r AS (SELECT c_custkey AS other, lower(c_mktsegment) || ' co' AS name FROM customer UNION ALL SELECT -1 - p_partkey, p_name || ' ' || lower(p_type) FROM part)
SELECT id, other FROM l JOIN r ON length(l.name) >= 4 AND contains(r.name, l.name) AND length(l.name) >= 0.48 * length(r.name)""")
def substring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand in longer ones, by grams."""
    parts, customers = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    left = customers.select(F.col("c_mktsegment").alias("id"), F.lower(F.substring("c_mktsegment", 1, 6)).alias("name")).unionByName(parts.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"))).distinct()
    firms = customers.select(F.col("c_custkey").cast("long").alias("other"), F.concat(F.lower("c_mktsegment"), F.lit(" co")).alias("name"))
    right = firms.unionByName(parts.select((-1 - F.col("p_partkey").cast("long")).alias("other"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")))
    return review.substring_pairs(left, right)


@query("""
WITH d AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, before AS unnamed FROM d WHERE before IS NOT NULL AND before <> 'F'""")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later decisions that don't name the one before them (here all claim to replace an F)."""
    o = table(spark, sf_dir, "orders").withColumn("replaces", F.lit("F"))
    return review.superseded(o, "o_custkey", "o_orderkey", "o_orderstatus", "replaces")[1]


@query("SELECT CASE WHEN (o_orderstatus = 'F')::INT + (o_totalprice > 200000)::INT + (o_orderpriority LIKE '1%')::INT > 1 THEN 'ambiguous' WHEN o_orderstatus = 'F' THEN 'eligible' WHEN o_totalprice > 200000 THEN 'deferred' WHEN o_orderpriority LIKE '1%' THEN 'excluded' ELSE 'unassigned' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def partition_accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in one bucket of several, or told as unassigned or ambiguous."""
    buckets = [("eligible", F.col("o_orderstatus") == "F"), ("deferred", F.col("o_totalprice") > 200000), ("excluded", F.col("o_orderpriority").startswith("1"))]
    return review.partitioned(table(spark, sf_dir, "orders"), buckets).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, array_to_string(list_filter([trim(p_name), CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE trim(p_brand) END, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE trim(p_type) END], lambda x: x IS NOT NULL), '|') AS types FROM part")
def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"t1": F.col("p_name"), "t2": F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")).otherwise("  "), "t3": F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))})
    return p.select("p_partkey", F.array_join(review.filled(["t1", "t2", "t3"]), "|").alias("types"))


@query("SELECT c_custkey, c_name, NULL::VARCHAR AS c_phone FROM customer")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.exported(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_phone"])


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) <= 1996 AND (o_orderkey % 3 = 0 OR year(o_orderdate) + o_orderkey % 3 >= 1996)")
def alive_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that hold a year; every third is open."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(review.alive_in(y, F.when(k % 3 != 0, y + k % 3), 1996)).select("o_orderkey")


@query("SELECT o_orderkey, 'C' || CASE WHEN r >= 1000 THEN r::VARCHAR ELSE lpad(r::VARCHAR, 3, '0') END AS label FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) AS r FROM orders)")
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by rank within a group, in the order of an enumeration."""
    order = [review.by_enum(F.col("o_orderstatus"), ["O", "F"]), "o_orderkey"]
    return review.labelled(table(spark, sf_dir, "orders"), order, ["o_custkey"], "C", 3).select("o_orderkey", "label")


@query("SELECT vec_id, i AS segment, round(embedding[i + 1]::DOUBLE, 6) AS a, round(embedding[i % 4 + 1 + 1]::DOUBLE, 6) AS b FROM (SELECT vec_id, embedding, unnest([0, 1, 2]) AS i FROM embeddings)")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of a line of four points."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.transform("embedding", lambda x: F.round(x.cast("double"), 6)), 1, 4).alias("line"))
    return review.adjacent(own, "vec_id", "line")


@query("""
WITH e AS (SELECT *, event_type = 'error' AS is_note, event_type = 'click' AS marked FROM events)
SELECT event_id, CASE WHEN marked THEN (first_value(CASE WHEN is_note THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END AS note FROM e QUALIFY NOT is_note""")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked rows with the note below them."""
    e = table(spark, sf_dir, "events").withColumns({"is_note": F.col("event_type") == "error", "marked": F.col("event_type") == "click"})
    return review.noted(e, ["user_id"], "event_id", "is_note", "marked", "event_id").select("event_id", F.col("attached").alias("note"))


@query()
def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one name within a block (brand and size), each under the most specific one that it resembles. Greedy, so tested in Python."""
    p = table(spark, sf_dir, "part").withColumns({"block": F.concat_ws("|", "p_brand", "p_size"), "score": text.specificity(F.col("p_name"), F.lit(None).cast("string"), F.col("p_size"), F.lit(1900))})
    return review.variant_groups(p, "block", "p_partkey", "p_name", "score")


@query("SELECT c_nationkey, count(*) AS rows, count(*) FILTER (c_acctbal > 0) AS found, count(*) FILTER (c_mktsegment = 'BUILDING') AS built FROM customer GROUP BY 1")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chunk_progress(table(spark, sf_dir, "customer"), "c_nationkey", {"found": F.col("c_acctbal") > 0, "built": F.col("c_mktsegment") == "BUILDING"})


#: Two polygons as rows of edges, moved by a tenth of a degree each.
AREAS = [(i, x1 + i / 10, y1 + i / 20, x2 + i / 10, y2 + i / 20) for i in range(3) for x1, y1, x2, y2 in EDGES]
AREA_SQL = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for i, a, b, c, d in AREAS)
HERE = "p AS (SELECT vec_id AS id, 121.47 + embedding[1]::DOUBLE / 5 AS x, 31.23 + embedding[2]::DOUBLE / 5 AS y FROM embeddings)"


def _areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (121.47 + part(0) / 5).alias("x"), (31.23 + part(1) / 5).alias("y"))
    return own, spark.createDataFrame(AREAS, "polygon int, x1 double, y1 double, x2 double, y2 double")


@query(f"""WITH e(polygon, x1, y1, x2, y2) AS (VALUES {AREA_SQL}), {HERE}
SELECT id, polygon FROM p, e GROUP BY ALL HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1""")
def polygon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a table of polygons with holes, by bands of latitude."""
    return spatial.in_polygons(*_areas(spark, sf_dir), band=0.01)


@query(f"""WITH e(polygon, x1, y1, x2, y2) AS (VALUES {AREA_SQL}), {HERE},
s AS (SELECT *, (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) AS side FROM p, e)
SELECT id, polygon, sum(CASE WHEN y1 <= y AND y2 > y AND side > 0 THEN 1 WHEN y1 > y AND y2 <= y AND side < 0 THEN -1 ELSE 0 END)::BIGINT AS turns FROM s GROUP BY ALL HAVING turns <> 0""")
def winding_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.winding(*_areas(spark, sf_dir), band=0.01)


ROADS = [(i, i % 4, 100 + i % 7, -0.3 + 0.05 * i, -0.2, 0.2 - 0.03 * i, 0.3) for i in range(12)]
ROAD_SQL = ", ".join(f'({i}, {k}, {g}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)' for i, k, g, a, b, c, d in ROADS)


@query(f"""WITH s(segment, key, grp, x1, y1, x2, y2) AS (VALUES {ROAD_SQL}),
v AS (SELECT label AS line, label % 4 AS key, vec_id AS pos, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
t AS (SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM v JOIN s USING (key)),
d AS (SELECT *, pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2) AS d2 FROM t),
b AS (SELECT line, pos, arg_min(grp, (d2, segment)) AS grp FROM d WHERE d2 <= 0.01 GROUP BY ALL), a AS (SELECT line, pos, grp FROM v LEFT JOIN b USING (line, pos)),
m AS (SELECT *, CASE WHEN lag(grp) OVER w IS NOT DISTINCT FROM grp AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY line ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS part FROM m)
SELECT line, part, grp AS segment_group, count(*) AS n FROM i WHERE grp IS NOT NULL GROUP BY ALL UNION ALL SELECT line, NULL, NULL, count(*) FROM v ANTI JOIN b USING (line) GROUP BY line""")
def road_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old lines cut into runs that follow one modern road of the same name."""
    vertices = table(spark, sf_dir, "embeddings").select(F.col("label").alias("line"), (F.col("label") % 4).alias("key"), F.col("vec_id").alias("pos"), part(0).alias("x"), part(1).alias("y"))
    modern = spark.createDataFrame(ROADS, "segment int, key int, group int, x1 double, y1 double, x2 double, y2 double")
    return spatial.aligned_lines(vertices, modern, "key", 0.1, 0.1)
