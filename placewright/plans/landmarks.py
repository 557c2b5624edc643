"""Queries on two inventories of places: candidates, links and cards.

The stand-in tables have no places: parts are landmarks and customers are listings, on a grid of some 400 metres by their numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators import candidates, folding, measure
from placewright.plans.registry import query, table

ROADS = ("南京东路", "延安路", "福州路", "江西路")


def whole(c: str, by: int) -> Column:
    return F.floor(F.col(c) / by)


def road(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ROADS)), (c % 4 + 1).cast("int"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    none = F.array().cast("array<string>")
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_name").withColumn("n", F.when(k % 5 == 0, k % 70).otherwise(k))
    return own.select(
        k.alias("landmark"), "n", "p_name", (121.0 + F.col("n") % 60 * 0.004 + whole("k", 70) % 4 * 0.0006).alias("lon"), (30.9 + whole("n", 60) * 0.004).alias("lat"), F.when(k % 17 == 0, "polygon-vertex-mean").otherwise("source-point").alias("method"),
        F.when(k % 19 == 0, F.array(F.lit("site-redeveloped"))).otherwise(none).alias("relations"), F.when(k % 23 == 0, F.array(F.lit("historical-name-and-location"))).otherwise(none).alias("matches"),
        F.when(k % 29 == 0, F.array(k, k + 1_000_000_000)).otherwise(F.array(k)).alias("members"), (k % 31 == 0).alias("held"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    low = c % 50 * 4 + 1
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c"))
    return own.select(
        c.alias("listing"), F.when(c % 37 != 0, 121.0 + c % 60 * 0.004 + 0.0001 + c % 3 * 0.002).alias("lon"), (30.9 + whole("c", 60) * 0.004).alias("lat"), F.concat(F.lit("瑞"), c.cast("string"), F.when(c % 13 == 0, "医院").otherwise("大楼")).alias("title"),
        F.concat(road(c), low.cast("string"), F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("-"), (low + 4).cast("string"))), F.lit("号")).alias("address"), F.when(c % 41 == 0, 2).otherwise(1).alias("components"), (c % 43 == 0).alias("demolished"))


LANDMARK_SQL = """
r AS (SELECT ['南京东路', '延安路', '福州路', '江西路'] AS roads),
l AS (SELECT *, 121.0 + n % 60 * 0.004 + (k // 70) % 4 * 0.0006 AS lon, 30.9 + (n // 60) * 0.004 AS lat FROM (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 70 ELSE p_partkey END AS n FROM part)),
h AS (SELECT *, CASE WHEN c % 37 <> 0 THEN 121.0 + c % 60 * 0.004 + 0.0001 + c % 3 * 0.002 END AS olon, 30.9 + (c // 60) * 0.004 AS olat, '瑞' || c || '大楼' AS norm, roads[c % 4 + 1] AS road, c % 50 * 4 + 1 AS low, c % 50 * 4 + 1 + CASE WHEN c % 9 = 0 THEN 0 ELSE 4 END AS high FROM (SELECT c_custkey AS c FROM customer), r)"""

CANDIDATES = f"""
WITH {LANDMARK_SQL},
ln AS (SELECT k, n, 'v' AS v, '瑞' || n || '大楼' AS norm, p_name, CASE WHEN k % 7 = 0 THEN 'current' ELSE 'old' END AS role FROM l UNION ALL SELECT k, n, 'full', '瑞' || n || '大楼' || replace(p_name, ' ', ''), p_name, CASE WHEN k % 7 = 0 THEN 'current' ELSE 'old' END FROM l UNION ALL SELECT k, n, 'east', '老瑞' || n || '大楼东', p_name, 'old' FROM l WHERE k % 6 = 0),
x AS (SELECT l.k, h.c, CASE WHEN olon IS NOT NULL THEN round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(olat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(olat)) * pow(sin(radians(olon - lon) / 2), 2)))))::BIGINT END AS d, l.n, h.norm, h.road, h.low, h.high,
 l.k % 4 = 0 AND h.roads[(l.k // 4) % 4 + 1] = h.road AND (l.k // 16) % 200 + 1 BETWEEN h.low AND h.high AS at_door, l.k % 10 = 3 AND l.k % 4 = h.c % 4 AND l.k % 50 * 4 + 1 BETWEEN h.low AND h.high AS at_old, l.k % 8 = 1 AND l.k = h.c * 3 AS same_page FROM l, h),
y AS (SELECT x.k, x.c, any_value(d) AS d, any_value(at_door)::INT + (any_value(at_old) AND coalesce(any_value(d) <= 180, false))::INT AS n_addresses, any_value(same_page)::INT AS n_sources,
 count(*) FILTER (ln.norm = x.norm OR (d <= 1000 AND length(ln.norm) >= 4 AND length(x.norm) >= 4 AND ln.norm <> x.norm AND (contains(ln.norm, x.norm) OR contains(x.norm, ln.norm)) AND least(length(ln.norm), length(x.norm)) / greatest(length(ln.norm), length(x.norm)) >= 0.48)) AS n_names,
 bool_or(ln.norm = x.norm) AS exact, bool_or(ln.norm = x.norm AND role = 'old') AND x.c % 11 <> 0 AS historical,
 bool_or(role = 'old' AND (ln.norm = x.norm OR (d <= 1000 AND length(ln.norm) >= 4 AND length(x.norm) >= 4 AND (contains(ln.norm, x.norm) OR contains(x.norm, ln.norm)) AND least(length(ln.norm), length(x.norm)) / greatest(length(ln.norm), length(x.norm)) >= 0.48))) AS old_named FROM x JOIN ln USING (k) GROUP BY x.k, x.c),
z AS (SELECT *, list_filter([CASE WHEN c % 37 = 0 THEN 'heritage-has-no-coordinate' END, CASE WHEN k % 17 = 0 THEN 'landmark-polygon-reference-only' END, CASE WHEN k % 19 = 0 THEN 'same-site-rebuilt-not-same-building' END, CASE WHEN k % 29 = 0 THEN 'multi-source-landmark-site' END, CASE WHEN c % 13 = 0 OR c % 41 = 0 THEN 'campus-complex-or-component-scope' END,
 CASE WHEN k % 31 = 0 THEN 'persistent-current-use-hold' END, CASE WHEN n_names > 0 AND NOT old_named THEN 'existing-current-name-only-not-identity-proof' END, CASE WHEN k % 23 = 0 THEN 'legacy-automatic-current-use-does-not-prove-identity' END, CASE WHEN k % 47 = 0 AND c = k THEN 'reviewed-pair-conflict' END, CASE WHEN d > 250 THEN 'coordinate-separation-over-250m' END,
 CASE WHEN c % 43 = 0 THEN 'official-demolished-flag' END, CASE WHEN n_names + n_addresses + n_sources = 0 THEN 'distance-only-do-not-merge' END], lambda v: v IS NOT NULL) AS hz FROM y WHERE n_names + n_addresses + n_sources > 0 OR d <= 35),
s AS (SELECT *, CASE WHEN exact AND d > 250 THEN 'name-match-location-conflict' WHEN historical AND d <= 180 AND NOT (k % 17 = 0 OR k % 19 = 0 OR k % 29 = 0 OR c % 13 = 0 OR c % 41 = 0 OR k % 31 = 0 OR (k % 47 = 0 AND c = k) OR c % 43 = 0) THEN 'strong-one-to-one' WHEN n_names + n_addresses + n_sources > 0 THEN 'complex-site-review' ELSE 'insufficient-evidence' END AS cl FROM z),
w AS (SELECT *, cl = 'strong-one-to-one' AND (count(*) FILTER (cl = 'strong-one-to-one') OVER (PARTITION BY k) > 1 OR count(*) FILTER (cl = 'strong-one-to-one') OVER (PARTITION BY c) > 1) AS several, count(*) FILTER (exact AND d <= 180) OVER (PARTITION BY k) > 1 OR count(*) FILTER (exact AND d <= 180) OVER (PARTITION BY c) > 1 AS rival FROM s)
SELECT k AS landmark, c AS listing, CASE WHEN cl = 'strong-one-to-one' AND (several OR rival) THEN 'complex-site-review' ELSE cl END AS class, d AS distance, array_to_string(list_concat(hz, CASE WHEN several THEN ['multiple-strong-pairs'] WHEN cl = 'strong-one-to-one' AND rival THEN ['nearby-competing-exact-name-pair'] ELSE [] END), '|') AS hazards, n_names, n_addresses, n_sources FROM w"""


@query(CANDIDATES)
def landmark_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks and listings that names, addresses, sources or nearness bring together, with what speaks against each pair."""
    own, other = landmarks(spark, sf_dir), listings(spark, sf_dir)
    k, c = F.col("landmark"), F.col("listing")
    name = F.concat(F.lit("瑞"), F.col("n").cast("string"), F.lit("大楼／"), F.col("p_name"))
    names = own.select("landmark", name.alias("name"), F.when(k % 7 == 0, "current-name").otherwise("historical-name-or-alias").alias("role"))
    names = names.unionByName(own.where(k % 6 == 0).select("landmark", F.concat(F.lit("老瑞"), F.col("n").cast("string"), F.lit("大楼东")).alias("name"), F.lit("historical-record").alias("role")))
    listed = other.select("listing", F.concat(F.lit("瑞"), c.cast("string"), F.lit("大楼")).alias("name"), F.when(c % 11 == 0, "official-listed-name").otherwise("official-original-name").alias("role"))
    current = own.where(k % 4 == 0).select("landmark", F.concat(F.lit("上海市"), road(whole("landmark", 4)), (whole("landmark", 16) % 200 + 1).cast("string"), F.lit("号")).alias("address"))
    number = (k % 50 * 4 + 1).cast("string")
    old = own.where(k % 10 == 3).select("landmark", F.concat(number, F.lit(" Rue Vieille")).alias("address"), number.alias("number"), F.array(road(k)).alias("roads"))
    urls = own.where(k % 8 == 1).select("landmark", F.concat(F.lit("https://www.example.org/site/"), k.cast("string"), F.lit("/")).alias("url"))
    pages = other.select("listing", F.concat(F.lit("http://example.org/site/"), (c * 3).cast("string")).alias("url"))
    conflicts = own.where(k % 47 == 0).select(k.alias("member"), k.alias("listing"))
    found = candidates.candidates(own.drop("n", "p_name"), other, names, listed, current, old, other.select("listing", "address"), urls, pages, conflicts)
    return found.select("landmark", "listing", "class", "distance", F.array_join("hazards", "|").alias("hazards"), F.col("n_names").cast("long").alias("n_names"), "n_addresses", "n_sources")


FOLD = """
WITH RECURSIVE f AS (SELECT p_partkey // 10 AS g, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY 1),
k AS (SELECT g, s, g * 10 + c AS canonical, list_transform([c] || m, lambda x: g * 10 + x) AS ids, list_transform(w, lambda x: g * 10 + x) AS want FROM f, (VALUES (0, 0, [1, 2], [0, 1, 2], [0, 1, 2], [0, 1, 2], [0, 1, 2]), (1, 0, [3], [0, 3], [0, 1, 2, 3], [0, 3], [0, 1, 2, 3]), (2, 4, [3], [3, 4], [3, 4], [3, 4], [3, 4]), (3, 1, [5], [1, 5], [1, 5], [1, 5], [1, 5]),
 (4, 5, [6, 4], [4, 5, 6], [4, 5, 6], [3, 4, 5, 6], [3, 4, 5, 6]), (5, 0, [9, 1], [0, 1, 9], [0, 1, 9], [0, 1, 9], [0, 1, 9]), (6, 7, [8], [7, 8], [7, 8], [7, 8], [7, 8]), (7, 8, [7], [7, 8], [7, 8], [7, 8], [7, 8])) t(s, c, m, w00, w10, w01, w11), LATERAL (SELECT CASE WHEN g % 3 = 0 THEN CASE WHEN g % 2 = 0 THEN w00 ELSE w01 END ELSE CASE WHEN g % 2 = 0 THEN w10 ELSE w11 END END AS w)),
st AS (SELECT g, 0 AS s, list_transform(ids, lambda i: struct_pack(id := i, b := [i])) AS st FROM f UNION ALL
 SELECT g, s + 1, CASE WHEN ok THEN list_transform(list_filter(st, lambda x: x.id = canonical OR NOT list_contains(ids, x.id)), lambda x: CASE WHEN x.id = canonical THEN struct_pack(id := x.id, b := have) ELSE x END) ELSE st END
 FROM (SELECT *, list_contains(list_transform(present, lambda x: x.id), canonical) AND (len(present) = len(ids) OR len(present) = 1) AND have = list_sort(want) AS ok FROM (SELECT st.g, st.s, st, canonical, ids, want, list_filter(st, lambda x: list_contains(ids, x.id)) AS present, list_sort(flatten(list_transform(list_filter(st, lambda x: list_contains(ids, x.id)), lambda x: x.b))) AS have FROM st JOIN k ON k.g = st.g AND k.s = st.s)))
SELECT x.id AS id, array_to_string(list_sort(x.b), ',') AS buildings FROM (SELECT unnest(st) AS x FROM st WHERE s = 8)"""


@query(FOLD)
def folded_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as features and eight links for every ten of them; later links see what earlier ones have left."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("name"))
    texts = lambda v: F.array(*[x.cast("string") for x in v]).cast("array<string>")
    empty = {"parks": "array<bigint>", "name_zh": "string", "chinese": "string", "aliases": "array<string>", "legacy": "array<string>", "sources": "array<string>", "urls": "map<string,string>", "current": "map<string,string>", "records": "array<string>"}
    k = F.col("k")
    features = p.select(k.cast("string").alias("id"), F.lit("landmark").alias("kind"), F.array("k").alias("buildings"), "name", k.cast("string").alias("grp"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    g = F.floor(k / 10)
    split, even = g % 3 == 0, g % 2 == 0
    shapes = [(0, [1, 2], None), (0, [3], F.when(split, F.array(F.lit(0), F.lit(3))).otherwise(F.array(*map(F.lit, range(4))))), (4, [3], None), (1, [5], None), (5, [6, 4], F.when(even, F.array(*map(F.lit, (4, 5, 6)))).otherwise(F.array(*map(F.lit, (3, 4, 5, 6))))), (0, [9, 1], None), (7, [8], None), (8, [7], None)]
    links = None
    for seq, (canonical, members, want) in enumerate(shapes):
        wanted = want if want is not None else F.array(*map(F.lit, [canonical, *members]))
        own = p.where(k % 10 == 0).select(
            F.concat_ws("-", k, F.lit(seq)).alias("link"), F.lit(seq).alias("seq"), (k + canonical).cast("string").alias("canonical"), texts([k + m for m in members]).alias("members"), F.transform(wanted, lambda x: k + x).alias("buildings"), F.lit(None).cast("array<bigint>").alias("parks"),
            *[F.lit(None).cast("string").alias(c) for c in ("current_from", "name", "name_zh")], F.lit(None).cast("array<string>").alias("aliases"))
        links = own if links is None else links.unionByName(own)
    after, _ = folding.fold_links(features, links)
    return after.select(F.col("id").cast("long").alias("id"), F.array_join(F.transform(F.sort_array("buildings"), lambda x: x.cast("string")), ",").alias("buildings"))


LAYERS = (("heritage", 60.0), ("metro", 80.0), ("park", 10.0), ("road", 40.0), ("landmark", 120.0))
SHAPE_SQL = """
c AS (SELECT *, 121.47 + ((s * 37) % 100 - 50) * 0.0005 AS x, 31.23 + ((s * 53) % 100 - 50) * 0.0005 AS y, 0.001 + (s % 5) * 0.002 AS r FROM (SELECT s_suppkey AS s FROM supplier)),
e AS (SELECT s, s % 3 = 0 AS area, CASE s % 3 WHEN 0 THEN 'park' WHEN 1 THEN 'road' ELSE CASE s % 9 WHEN 2 THEN 'heritage' WHEN 5 THEN 'metro' ELSE 'landmark' END END AS layer, unnest(CASE s % 3
 WHEN 0 THEN [[x - r, y - r, x + r, y - r / 2], [x + r, y - r / 2, x + r / 2, y + r], [x + r / 2, y + r, x - r, y - r]] WHEN 1 THEN [[x - 3 * r, y - 2 * r, x, y], [x, y, x + r, y + 3 * r]] ELSE [[x, y, x, y]] END) AS v FROM c),
p AS (SELECT vec_id AS id, 121.47 + embedding[1]::DOUBLE / 10 AS lon, 31.23 + embedding[2]::DOUBLE / 10 AS lat FROM embeddings),
q AS (SELECT p.id, s, area, layer, lon, lat, 111195 * cos(radians(lat)) AS k, v FROM p, e),
a AS (SELECT *, (v[1] - lon) * k AS ax, (v[2] - lat) * 111195 AS ay, (v[3] - v[1]) * k AS dx, (v[4] - v[2]) * 111195 AS dy FROM q),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM a),
m AS (SELECT id, s, area, layer, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS d, area AND count(*) FILTER ((v[2] > lat) <> (v[4] > lat) AND lon < (v[3] - v[1]) * (lat - v[2]) / nullif(v[4] - v[2], 0) + v[1]) % 2 = 1 AS held FROM t GROUP BY id, s, area, layer)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as areas, lines and points of a few hundred metres."""
    s = F.col("s")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    exact = lambda v: F.lit(Decimal(v))  # noqa: E731  the SQL's literals are decimals, and vertices that two shapes share must be equal to the last bit
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s")).withColumns({"x": exact("121.47") + ((s * 37) % 100 - 50) * exact("0.0005"), "y": exact("31.23") + ((s * 53) % 100 - 50) * exact("0.0005"), "r": exact("0.001") + (s % 5) * exact("0.002")})
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    half = r.cast("double") / 2
    ring = F.array(at(x - r, y - r), at(x + r, y.cast("double") - half), at(x.cast("double") + half, y + r), at(x - r, y - r))
    line = F.array(at(x - 3 * r, y - 2 * r), at(x, y), at(x + r, y + 3 * r))
    node = F.when(s % 9 == 2, "heritage").when(s % 9 == 5, "metro").otherwise("landmark")
    return own.select(s.alias("geometry"), (s % 3 == 0).alias("area"), F.when(s % 3 == 0, "park").when(s % 3 == 1, "road").otherwise(node).alias("layer"), F.when(s % 3 == 0, ring).when(s % 3 == 1, line).otherwise(F.array(at(x, y))).alias("path"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (121.47 + F.col("embedding")[0].cast("double") / 10).alias("lon"), (31.23 + F.col("embedding")[1].cast("double") / 10).alias("lat"))


@query(f"WITH {SHAPE_SQL} SELECT id, s AS geometry, CASE WHEN NOT area THEN 'not-checked' WHEN held THEN 'inside' ELSE 'outside' END AS containment, CASE WHEN held THEN 0.0 ELSE round(d, 2) END AS distance, round(d, 2) AS boundary FROM m WHERE held OR round(d, 2) <= 160")
def measured_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, lines and points around each place, with containment and distances."""
    return measure.measured(clicks(spark, sf_dir), shapes(spark, sf_dir), reach=160.0)


@query(f"WITH {SHAPE_SQL} SELECT id, arg_min(s, (d, s)) AS geometry, round(min(d), 3) AS distance FROM m GROUP BY id")
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest geometry of each place, however far it is."""
    edges = measure.edges_of(shapes(spark, sf_dir))
    return measure.nearest_edges(clicks(spark, sf_dir), edges, 100.0).select("id", "geometry", F.round("distance", 3).alias("distance"))


@query(f"""WITH {SHAPE_SQL}, l(layer, pri, radius) AS (VALUES {", ".join(f"('{n}', {i}, {r})" for i, (n, r) in enumerate(LAYERS) if n != "metro")}), h AS (SELECT id, layer, s, pri, CASE WHEN held THEN 0.0 ELSE d END AS d FROM m JOIN l USING (layer) WHERE held OR d <= radius)
SELECT id, arg_min(layer, (pri, d, s)) AS layer, arg_min(s, (pri, d, s)) AS geometry, round(arg_min(d, (pri, d, s)), 3) AS distance FROM h GROUP BY id""")
def layered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a click selects where one layer is hidden."""
    shown = [x for x in LAYERS if x[0] != "metro"]
    return measure.layered(clicks(spark, sf_dir), shapes(spark, sf_dir), shown).select("id", "layer", "geometry", F.round("distance", 3).alias("distance"))


@query("""WITH c AS (SELECT *, 121.47 + ((s * 37) % 100 - 50) * 0.0005 AS x, 31.23 + ((s * 53) % 100 - 50) * 0.0005 AS y, 0.001 + (s % 5) * 0.002 AS r FROM (SELECT s_suppkey AS s FROM supplier)),
v AS (SELECT s, unnest(CASE s % 3 WHEN 0 THEN [[x - r, y - r], [x + r, y - r / 2], [x + r / 2, y + r], [x - r, y - r]] WHEN 1 THEN [[x - 3 * r, y - 2 * r], [x, y], [x + r, y + 3 * r]] ELSE [[x, y]] END) AS v FROM c)
SELECT s AS geometry, round(avg(v[1]), 7) AS mean_x, round(avg(v[2]), 7) AS mean_y, round((min(v[1]) + max(v[1])) / 2, 7) AS centre_x, round((min(v[2]) + max(v[2])) / 2, 7) AS centre_y FROM v GROUP BY s""")
def representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = measure.representative(shapes(spark, sf_dir))
    return own.select("geometry", *[F.round(c, 7).alias(c) for c in own.columns[1:]])


@query("""WITH p AS (SELECT round(embedding[1]::DOUBLE * 40, 4) AS x, CASE WHEN vec_id % 9 <> 0 THEN round(embedding[2]::DOUBLE * 40, 4) END AS y, round(embedding[1]::DOUBLE * 40, 4) + CASE WHEN vec_id % 5 = 0 THEN 3 ELSE 0 END AS sx, CASE WHEN vec_id % 7 <> 0 THEN round(embedding[2]::DOUBLE * 40, 4) END AS sy FROM embeddings),
o AS (SELECT *, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS gap FROM p), e AS (SELECT count(*) AS n, coalesce(sum(c), 0) AS r, max(c) AS m FROM (SELECT count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY round(x, 4), round(y, 4) HAVING count(*) > 1)), f AS (SELECT count(*) AS n, coalesce(sum(c), 0) AS r, max(c) AS m FROM (SELECT count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY round(x), round(y) HAVING count(*) > 1))
SELECT count(*) FILTER (y IS NOT NULL) AS both_present, count(*) FILTER (y IS NULL) AS missing_either, min(x) FILTER (y IS NOT NULL) AS min_x, max(x) FILTER (y IS NOT NULL) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) FILTER (sy IS NOT NULL) AS points, count(*) FILTER (sy IS NULL) AS missing_points, count(gap) AS compared,
 count(*) FILTER (gap > 0.001) AS mismatches, round(max(gap), 6) AS largest_gap, any_value(e.n) AS exact_places, any_value(e.r)::BIGINT AS exact_rows, any_value(e.m) AS exact_most, any_value(f.n) AS metre_places, any_value(f.r)::BIGINT AS metre_rows, any_value(f.m) AS metre_most FROM o, e, f""")
def coordinate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("vec_id"), lambda i: F.round(F.col("embedding")[i].cast("double") * 40, 4)
    own = table(spark, sf_dir, "embeddings").select(e(0).alias("x"), F.when(v % 9 != 0, e(1)).alias("y"), (e(0) + F.when(v % 5 == 0, 3).otherwise(0)).alias("sx"), F.when(v % 7 != 0, e(1)).alias("sy"))
    return measure.coordinate_profile(own, "x", "y", "sx", "sy").withColumn("largest_gap", F.round("largest_gap", 6))
