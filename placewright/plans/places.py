"""Queries on coordinates, spatial joins, linkage and reviewed overlays.

The stand-in tables have no places: the first two components of an embedding give a point around (121.47, 31.23).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.operators import linkage, overlay, spatial
from placewright.operators.relational import dealt_join, in_blocks, spread
from placewright.plans.registry import query, table

LON, LAT = "(121.47 + embedding[1]::DOUBLE / 5)", "(31.23 + embedding[2]::DOUBLE / 5)"
LON2, LAT2 = "(121.47 + embedding[3]::DOUBLE / 5)", "(31.23 + embedding[4]::DOUBLE / 5)"


def part(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (121.47 + part(0) / 5).alias("lon"), (31.23 + part(1) / 5).alias("lat"), (121.47 + part(2) / 5).alias("lon2"), (31.23 + part(3) / 5).alias("lat2"))


def _distance(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return points(spark, sf_dir).select("vec_id", F.round(geo.distance(method, F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))

    run.__name__ = f"geo_{method}"
    return run


def haversine_sql(radius: float) -> str:
    a = f"pow(sin(radians({LAT2} - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians({LAT2})) * pow(sin(radians({LON2} - {LON}) / 2), 2)"
    return f"SELECT vec_id, round(2 * {radius} * asin(least(1.0, sqrt({a}))), 3) AS metres FROM embeddings"


query(haversine_sql(geo.MEAN_RADIUS))(_distance("haversine"))
query(haversine_sql(geo.ROUND_RADIUS))(_distance("haversine_round"))
query(f"SELECT vec_id, round({geo.ROUND_RADIUS} * sqrt(pow(radians({LON2} - {LON}) * cos(radians(({LAT} + {LAT2}) / 2)), 2) + pow(radians({LAT2} - {LAT}), 2)), 3) AS metres FROM embeddings")(_distance("equirectangular"))
query(f"SELECT vec_id, round(sqrt(pow(({LON2} - {LON}) * 111320 * cos(radians(31.23)), 2) + pow(({LAT2} - {LAT}) * 111320, 2)), 3) AS metres FROM embeddings")(_distance("planar"))


def krueger_sql() -> tuple[str, str]:
    """Zone 51N of the forward series, in SQL."""
    k = 2 * ((geo.WGS84_F / (2 - geo.WGS84_F)) ** 0.5) / (1 + geo.WGS84_F / (2 - geo.WGS84_F))
    x = "eta + " + " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    y = "xi + " + " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    start = f"""WITH p AS (SELECT vec_id, radians({LAT}) AS phi, radians({LON} - 123) AS east FROM embeddings),
 q AS (SELECT *, sinh(atanh(sin(phi)) - {k!r} * atanh({k!r} * sin(phi))) AS t FROM p), r AS (SELECT vec_id, atan2(t, cos(east)) AS xi, atanh(sin(east) / sqrt(1 + t * t)) AS eta FROM q)"""
    scale = geo.UTM_SCALE * geo.RADIUS
    return start, f"SELECT vec_id, round(500000 + {scale!r} * ({x}), 3) AS x, round({scale!r} * ({y}), 3) AS y FROM r"


@query("\n".join(krueger_sql()))
def geo_utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.wgs84_to_utm(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def inverse_sql() -> str:
    scale = geo.UTM_SCALE * geo.RADIUS
    xi = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(geo.BETA, 1))
    eta = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(geo.BETA, 1))
    lat = "chi" + "".join(f" + {d!r} * sin({2 * j} * chi)" for j, d in enumerate(geo.DELTA, 1))
    return f"""WITH p AS (SELECT vec_id, (3450000 + embedding[2]::DOUBLE * 20000) / {scale!r} AS xi, (350000 + embedding[1]::DOUBLE * 20000 - 500000) / {scale!r} AS eta FROM embeddings),
 q AS (SELECT vec_id, {xi} AS a, {eta} AS b FROM p), r AS (SELECT *, asin(sin(a) / cosh(b)) AS chi FROM q)
 SELECT vec_id, round(123 + degrees(atan2(sinh(b), cos(a))), 6) AS lon, round(degrees({lat}), 6) AS lat FROM r"""


@query(inverse_sql())
def geo_utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.utm_to_wgs84(350000 + part(0) * 20000, 3450000 + part(1) * 20000)
    return table(spark, sf_dir, "embeddings").select("vec_id", lon.alias("lon"), lat.alias("lat"))


GCJ = """WITH p AS (SELECT vec_id, {lon} AS lon, {lat} AS lat, {lon} - 105 AS x, {lat} - 35 AS y FROM embeddings),
 d AS (SELECT *, -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3 AS dlat,
  300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS dlon,
  1 - {ee} * pow(sin(radians(lat)), 2) AS flat FROM p)
 SELECT vec_id, round(lon + dlon * 180 / ({a} / sqrt(flat) * cos(radians(lat)) * pi()), 6) AS lon, round(lat + dlat * 180 / ({a} * (1 - {ee}) / (flat * sqrt(flat)) * pi()), 6) AS lat FROM d""".format(lon=LON, lat=LAT, ee=geo.GCJ_EE, a=geo.GCJ_A)


@query(GCJ)
def geo_gcj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.wgs84_to_gcj02(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("vec_id", lon.alias("lon"), lat.alias("lat"))


@query(f"""WITH p AS (SELECT vec_id, {LON} - 0.0065 AS x, {LAT} - 0.006 AS y, pi() * 3000 / 180 AS w FROM embeddings), r AS (SELECT vec_id, sqrt(x * x + y * y) - 0.00002 * sin(y * w) AS r, atan2(y, x) - 0.000003 * cos(x * w) AS t FROM p)
SELECT vec_id, round(r * cos(t), 6) AS lon, round(r * sin(t), 6) AS lat FROM r""")
def geo_bd09(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.bd09_to_gcj02(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("vec_id", lon.alias("lon"), lat.alias("lat"))


@query()
def geo_gcj02_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("vec_id", lon.alias("lon"), lat.alias("lat"))


@query(f"SELECT vec_id, floor(({LON} + 180) / 360 * 16384)::INT AS x, floor((1 - asinh(tan(radians({LAT}))) / pi()) / 2 * 16384)::INT AS y FROM embeddings")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.tile(F.col("lon"), F.col("lat"), 14)
    return points(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"))


RINGS = [[(121.42, 31.20), (121.52, 31.19), (121.53, 31.27), (121.43, 31.26)], [(121.46, 31.22), (121.49, 31.22), (121.49, 31.24), (121.46, 31.24)]]
EDGES = [(*a, *b) for ring in RINGS for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
EDGE_VALUES = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in EDGES)


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {EDGE_VALUES}), p AS (SELECT vec_id, {LON} AS px, {LAT} AS py FROM embeddings)
SELECT vec_id, count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM p, e GROUP BY vec_id""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even-odd rule; the second ring is a hole."""
    return points(spark, sf_dir).select("vec_id", geo.in_rings(F.col("lon"), F.col("lat"), RINGS).alias("inside"))


LINES = [(i, i % 5, -0.3 + 0.03 * i, -0.2, 0.2 - 0.02 * i, 0.3) for i in range(20)]


@query(f"""WITH s(segment, label, x1, y1, x2, y2) AS (VALUES {", ".join(f"({i}, {g}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for i, g, a, b, c, d in LINES)}), p AS (SELECT vec_id, label % 5 AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
t AS (SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM p JOIN s USING (label)), d AS (SELECT vec_id, segment, pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2) AS d2 FROM t)
SELECT vec_id AS id, arg_min(segment, (d2, segment)) AS segment, round(min(d2), 9) AS d2 FROM d WHERE d2 <= 0.01 GROUP BY 1""")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(LINES, "segment int, label int, x1 double, y1 double, x2 double, y2 double")
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 5).alias("label"), part(0).alias("x"), part(1).alias("y"))
    return spatial.nearest_segment(own, F.broadcast(lines), "label", 0.1).select("id", "segment", F.round("d2", 9).alias("d2"))  # twenty lines


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id AND abs(a.x - b.x) <= 0.02 AND abs(a.y - b.y) <= 0.02),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM m WHERE distance <= 0.02) SELECT id, other, rank::INT AS rank, round(distance, 9) AS distance FROM r WHERE rank <= 12""")
def radius_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), part(0).alias("x"), part(1).alias("y"))
    return spatial.nearest_others(own, 0.02, 0.02, 12).select("id", "other", "rank", F.round("distance", 9).alias("distance"))


@query(f"""
WITH c AS (SELECT label AS k, vec_id AS pos, CASE WHEN vec_id % 7 = 0 THEN 'page' ELSE 'claim' END AS origin, CASE vec_id % 5 WHEN 0 THEN 'preferred' WHEN 1 THEN 'deprecated' ELSE 'normal' END AS rank, 121.47 + embedding[1]::DOUBLE AS lon, 31.23 + embedding[2]::DOUBLE / 100000 AS lat FROM embeddings),
o AS (SELECT *, coalesce(lon BETWEEN 121.4 AND 121.6 AND lat BETWEEN 30 AND 32 AND rank <> 'deprecated', false) AS ok FROM c), p AS (SELECT *, bool_or(ok AND origin = 'claim' AND rank = 'preferred') OVER (PARTITION BY k) AS pref FROM o),
e AS (SELECT * FROM p WHERE ok AND (origin = 'page' OR NOT pref OR rank = 'preferred')), f AS (SELECT k, arg_min(lon, (origin <> 'page', pos)) AS flon, arg_min(lat, (origin <> 'page', pos)) AS flat FROM e GROUP BY k),
d AS (SELECT k, flon, flat, max(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(lat - flat) / 2), 2) + cos(radians(flat)) * cos(radians(lat)) * pow(sin(radians(lon - flon) / 2), 2))))) AS far FROM e JOIN f USING (k) GROUP BY ALL)
SELECT k AS label, CASE WHEN far IS NULL THEN 'rejected' WHEN far > 8000 THEN 'coordinate-conflict' ELSE 'reference-point' END AS status, CASE WHEN far <= 8000 THEN flon END AS lon, CASE WHEN far <= 8000 THEN flat END AS lat FROM (SELECT DISTINCT k FROM c) LEFT JOIN d USING (k)""")
def location_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    own = table(spark, sf_dir, "embeddings").select(
        "label", v.alias("pos"), F.when(v % 7 == 0, "page").otherwise("claim").alias("origin"), F.when(v % 5 == 0, "preferred").when(v % 5 == 1, "deprecated").otherwise("normal").alias("rank"), (121.47 + part(0)).alias("lon"), (31.23 + part(1) / 100000).alias("lat"))
    return overlay.elected_locations(own, "label", (121.4, 121.6, 30.0, 32.0), 8000.0)


@query("""
WITH o AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS u FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 11 = 0 THEN 'held' END, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END, o.u, c_name) AS use,
 CASE WHEN c_custkey % 11 = 0 THEN 'hold' WHEN c_custkey % 7 = 0 THEN 'research' WHEN o.u IS NOT NULL THEN 'library' ELSE 'cache' END AS source FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def current_use_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds beat research, research beats the library, and a cache comes last."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("use"))
    own = [("hold", c.where("c_custkey % 11 = 0").select("c_custkey", F.lit("held").alias("use"))), ("research", c.where("c_custkey % 7 = 0").select("c_custkey", F.col("c_mktsegment").alias("use"))), ("library", o), ("cache", c.select("c_custkey", F.col("c_name").alias("use")))]
    return overlay.by_priority(own, "c_custkey", "use")


@query("SELECT l_orderkey, l_linenumber, l_partkey * 50 + l_quantity::BIGINT AS claim FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey * 50 + l_quantity::BIGINT) = 1")
def unclaimed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.unclaimed_twice(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 50 + F.col("l_quantity").cast("long")).alias("claim")), "claim")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 AND o_orderstatus = 'O' THEN 'held' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def guarded_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections apply where the row still is what they were made for."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    plan = o.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("O").alias("before"), F.lit("held").alias("after"))
    return overlay.guarded_update(o, plan, "o_orderkey", "o_orderstatus")[0]


@query("""
SELECT p_partkey, s_suppkey, CASE WHEN p_size = s_suppkey % 50 THEN 'strong' WHEN p_retailprice > 1500 THEN 'conflicting' WHEN p_size > 25 THEN 'likely' ELSE 'weak' END AS class
FROM part JOIN supplier ON p_partkey % 10 = s_suppkey % 10 AND p_size % 5 = s_suppkey % 5""")
def candidate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs from an equi-join on block keys, classified by the first rule that holds. There are as many as the square of the tables, so both sides
    meet as arrays that become pairs where they are read: a part's suppliers come in runs of one class, and those of the next part in the same
    order, so written pairs take little room."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 10).alias("a"), (F.col("p_size") % 5).alias("b"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).alias("a"), (F.col("s_suppkey") % 5).alias("b"))
    gathered = lambda df, at, to, *values: df.groupBy("a", "b", at).agg(F.sort_array(F.collect_list(F.struct(*values))).alias(to))  # noqa: E731  a block's
    parts = gathered(in_blocks(spread(p, "p_partkey"), ["a", "b"], "p_partkey", 250, "_i"), "_i", "_parts_held", "p_partkey", "p_size", "p_retailprice")
    suppliers = gathered(in_blocks(s, ["a", "b"], "s_suppkey", 128, "_j"), "_j", "_suppliers", (F.col("s_suppkey") % 50).alias("size"), "s_suppkey")
    met = dealt_join(parts, suppliers, ["a", "b"], "_i", per=4, wide=True)
    pairs = met.select("_suppliers", F.inline("_parts_held")).select("p_partkey", "p_size", "p_retailprice", F.inline("_suppliers"))
    rules = [(F.col("p_size") == F.col("size"), "strong"), (F.col("p_retailprice") > 1500, "conflicting"), (F.col("p_size") > 25, "likely")]
    return overlay.classified(pairs, rules, "weak", "class").select("p_partkey", "s_suppkey", "class")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as building records: a few names and addresses on a plane of four kilometres."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat_ws(" ", F.col("p_type"), F.lit("Hall")).alias("name"), F.lit("").alias("name_zh"), F.when(k % 3 == 0, F.concat(F.lit("No. "), (k % 40).cast("string"), F.lit(" Rte. Nord"))).when(k % 3 == 1, F.lit("Rue du Sud")).otherwise(F.lit("")).alias("address"),
        ((k * 7919) % 4000).cast("double").alias("x"), ((k * 104729) % 4000).cast("double").alias("y"), (F.lit(1850) + F.col("p_size")).alias("start_year"), (k % 4).cast("int").alias("n_types"))


@query("""
WITH r AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 4000)::DOUBLE AS x, ((p_partkey * 104729) % 4000)::DOUBLE AS y, CASE p_partkey % 3 WHEN 0 THEN 'ROUTE NORD|' || (p_partkey % 40) WHEN 1 THEN 'RUE DU SUD' END AS a, replace(upper(p_type), ' ', '') || 'HALL' AS c FROM part),
p AS (SELECT l.id AS a, r.id AS b, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) AS d, l.a = r.a AS same, contains(l.a, '|') AS numbered, l.c = r.c OR (least(length(l.c), length(r.c)) >= 6 AND abs(length(l.c) - length(r.c)) <= 2 AND levenshtein(l.c, r.c) <= greatest(1, floor(least(length(l.c), length(r.c)) / 10.0))) AS near FROM r l JOIN r ON l.id < r.id AND abs(l.x - r.x) <= 250 AND abs(l.y - r.y) <= 250),
k AS (SELECT *, CASE WHEN same AND numbered AND d <= 250 THEN 'same-numbered-address-within-radius' WHEN same AND NOT numbered AND d <= 30 THEN 'same-unnumbered-address-within-radius' WHEN d <= 8 AND near THEN 'nearby-semantic-variant' END AS code FROM p)
SELECT lpad(a::VARCHAR, 12, '0') AS "left", lpad(b::VARCHAR, 12, '0') AS "right", code, round(d, 3) AS distance FROM k WHERE code IS NOT NULL""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.candidate_pairs(records(spark, sf_dir)).withColumn("distance", F.round("distance", 3))


@query()
def site_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-link sites; the merging is sequential within a component, which SQL can't say."""
    return linkage.site_table(linkage.sites(records(spark, sf_dir))).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})
