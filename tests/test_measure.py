import math
import random

import pytest
from pyspark.sql import functions as F

from placewright.operators import measure

SHAPE = "geometry string, area boolean, path array<struct<x:double,y:double>>"


def brute(point, parts, area):
    """One point against the parts of one geometry."""
    lon, lat = point
    k = 111195 * math.cos(math.radians(lat))
    best, odd = math.inf, False
    for path in parts:
        ring = [*path, path[0]] if area and path[0] != path[-1] else path
        for (ax, ay), (bx, by) in zip(ring, ring[1:] if len(ring) > 1 else ring, strict=False):
            a, b = ((ax - lon) * k, (ay - lat) * 111195), ((bx - lon) * k, (by - lat) * 111195)
            d = (b[0] - a[0], b[1] - a[1])
            long2 = d[0] ** 2 + d[1] ** 2
            t = max(0, min(1, -(a[0] * d[0] + a[1] * d[1]) / long2)) if long2 else 0
            best = min(best, math.hypot(a[0] + t * d[0], a[1] + t * d[1]))
            if area and (ay > lat) != (by > lat) and lon < (bx - ax) * (lat - ay) / (by - ay) + ax:
                odd = not odd
    return odd, best


@pytest.fixture(scope="module")
def places():
    rng = random.Random(3)
    points = [(i, 121 + rng.random() * 0.1, 31 + rng.random() * 0.1) for i in range(120)]
    shapes = {}
    for g in range(25):
        x, y, r = 121 + rng.random() * 0.1, 31 + rng.random() * 0.1, rng.choice([0.0005, 0.004, 0.03])
        turn = sorted(rng.random() * 2 * math.pi for _ in range(7))
        ring = [(x + r * math.cos(t), y + r * math.sin(t)) for t in turn]
        hole = [(x + r / 4 * math.cos(t), y + r / 4 * math.sin(t)) for t in turn]
        shapes[f"g{g:02}"] = (True, [[*ring, ring[0]], hole]) if g % 3 == 0 else (False, [ring]) if g % 3 == 1 else (False, [ring[:1]])
    return points, shapes


def frames(spark, places):
    points, shapes = places
    return spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame([(g, area, part) for g, (area, parts) in shapes.items() for part in parts], SHAPE)


def test_measured_equals_brute_force(spark, places):
    got = {(r["id"], r["geometry"]): (r["containment"], r["distance"], r["boundary"]) for r in measure.measured(*frames(spark, places), reach=300.0).collect()}
    want = {}
    for i, lon, lat in places[0]:
        for g, (area, parts) in places[1].items():
            odd, d = brute((lon, lat), parts, area)
            if odd or round(d, 2) <= 300:
                want[i, g] = ("inside" if odd else "outside" if area else "not-checked", 0.0 if odd else round(d, 2), round(d, 2))
    assert set(got) == set(want) and {v[0] for v in want.values()} == {"inside", "outside", "not-checked"}
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 0.011 and abs(got[k][2] - v[2]) < 0.011 for k, v in want.items())


def test_nearest_without_a_reach(spark, places):
    points, shapes = frames(spark, places)
    few = measure.edges_of(shapes.where("geometry < 'g05'"))
    got = {r["id"]: (r["geometry"], r["distance"]) for r in measure.nearest_edges(points, few, 50.0).collect()}
    for i, lon, lat in places[0]:
        d, g = min((brute((lon, lat), parts, area)[1], g) for g, (area, parts) in places[1].items() if g < "g05")
        assert got[i][0] == g and abs(got[i][1] - d) < 1e-6


def test_long_edges_touch_few_cells(spark):
    edge = spark.createDataFrame([("g", False, 121.0, 31.0, 121.5, 31.5), ("v", False, 121.0, 31.0, 121.0, 31.1), ("p", False, 121.0, 31.0, 121.0, 31.0)], "geometry string, area boolean, x1 double, y1 double, x2 double, y2 double")
    n = {r["geometry"]: r["count"] for r in measure.rastered(edge, 100.0, 95000.0).groupBy("geometry").count().collect()}
    assert 900 < n["g"] < 1200 and n["v"] <= 230 and n["p"] <= 4


def test_odd_rows(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, 9.0, 9.0)], "id int, lon double, lat double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    shapes = spark.createDataFrame([("a", True, square), ("b", None, square), ("c", True, None), ("d", True, []), ("e", True, [(0.0, float("nan")), (1.0, 1.0)]), (None, True, square), ("f", False, [(0.5, 0.5)])], SHAPE)
    got = {(r["id"], r["geometry"]): r["containment"] for r in measure.measured(points, shapes).collect()}
    assert got == {(1, "a"): "inside", (1, "f"): "not-checked"}
    assert measure.measured(points, shapes.limit(0)).count() == 0 and measure.measured(points.limit(0), shapes).count() == 0
    assert measure.nearest_edges(points, measure.edges_of(shapes.limit(0)), 10.0).count() == 0


def test_areas_points_and_profiles(spark):
    ring, line = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (4.0, 2.0)]
    rows = [("a", ring, {"building": "yes"}), ("b", ring, {"area": "no", "building": "yes"}), ("c", ring, {"area": "yes"}), ("d", ring, {"name": "x"}), ("e", line, {"building": "yes"}), ("f", ring, None)]
    df = spark.createDataFrame(rows, "geometry string, path array<struct<x:double,y:double>>, tags map<string,string>")
    assert [r[0] for r in df.orderBy("geometry").select(measure.is_area(F.col("path"), F.col("tags"))).collect()] == [True, False, True, False, False, False]
    got = {r["geometry"]: tuple(r)[1:] for r in measure.representative(df).collect()}
    assert got["a"] == (1.0, 0.25, 1.0, 0.5) and got["e"] == (2.0, 1.0, 2.0, 1.0)
    table = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0), (1.00001, 2.0, 4.0, 6.0), (1.4, 2.0, None, 1.0), (None, 2.0, 1.0, 1.0)], "x double, y double, sx double, sy double")
    r = measure.coordinate_profile(table, "x", "y", "sx", "sy").first()
    assert (r["both_present"], r["missing_either"], r["compared"], r["mismatches"], round(r["largest_gap"], 3), r["exact_places"], r["exact_rows"], r["metre_rows"], r["metre_most"]) == (3, 1, 2, 1, 5.0, 1, 2, 3, 3)


def test_layers_in_order(spark):
    rows = [("park", "p", True, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), ("road", "r", False, [(0.5, 0.2), (0.9, 0.2)]), ("mark", "b", False, [(0.5, 0.1)]), ("mark", "a", False, [(0.5, 0.1)]), ("none", "x", False, [(0.5, 0.1)]), ("road", None, False, [(0.5, 0.1)])]
    shapes = spark.createDataFrame(rows, "layer string, geometry string, area boolean, path array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.6, 0.2), (3, 5.0, 5.0), (4, None, 1.0), (5, 0.9, 0.5)], "id int, lon double, lat double")
    run = lambda layers: {r["id"]: (r["layer"], r["geometry"]) for r in measure.layered(points, shapes, layers).collect()}
    assert run([("mark", 50), ("road", 50), ("park", 0)]) == {1: ("mark", "a"), 2: ("road", "r"), 5: ("park", "p")}
    assert run([("park", 0), ("mark", 50)]) == {1: ("park", "p"), 2: ("park", "p"), 5: ("park", "p")}
    assert run([("road", 50)]) == {2: ("road", "r")}


def test_equal_shapes_are_measured_once(spark, places):
    points, shapes = places
    copies = [(f"{g}-{i}", area, part) for i in range(40) for g, (area, parts) in shapes.items() for part in parts]
    own, many = spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(copies, SHAPE)
    least, members = measure.alike(many)
    assert least.select("geometry").distinct().count() == len(shapes) and members.count() == 40 * len(shapes)
    once = measure.measured(own, frames(spark, places)[1], reach=300.0).collect()
    got = sorted(tuple(r) for r in measure.measured(own, many, reach=300.0).collect())
    assert got == sorted((r["id"], f"{r['geometry']}-{i}", *tuple(r)[2:]) for r in once for i in range(40))


def test_ties_at_a_shared_vertex_go_as_in_sql(spark):
    """A line and a point that share a vertex are equally far from most points: which is less in its last bit must be what SQL says."""
    rng = random.Random(11)
    points = [(i, 121.47 + rng.uniform(-0.02, 0.02), 31.23 + rng.uniform(-0.02, 0.02)) for i in range(3000)]
    shapes = [("a", False, [(121.46, 31.22), (121.4703, 31.2301), (121.475, 31.25)]), ("b", False, [(121.4703, 31.2301)]), ("c", True, [(121.4703, 31.2301), (121.4803, 31.2351), (121.4753, 31.2401)])]
    want = {}
    for i, lon, lat in points:
        k, best = 111195 * math.cos(math.radians(lat)), []
        for g, area, path in shapes:
            ring = [*path, path[0]] if area else path
            for (px, py), (qx, qy) in zip(ring, ring[1:] if len(ring) > 1 else ring, strict=False):
                ax, ay, dx, dy = (px - lon) * k, (py - lat) * 111195, (qx - px) * k, (qy - py) * 111195
                long2 = dx * dx + dy * dy
                t = max(0.0, min(1.0, -(ax * dx + ay * dy) / long2)) if long2 else 0.0
                x, y = ax + t * dx, ay + t * dy
                best.append((math.sqrt(x * x + y * y), g))
        want[i] = min(best)[::-1]
    got = measure.nearest_edges(spark.createDataFrame(points, "id int, lon double, lat double"), measure.edges_of(spark.createDataFrame(shapes, SHAPE)), 100.0)
    assert {r["id"]: (r["geometry"], r["distance"]) for r in got.collect()} == want


def test_nearest_others_compare_a_place_once(spark):
    """Copies of a point are one place until the nearest are known; results are those of all pairs."""
    import math
    import random

    from placewright.operators import spatial

    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 0.005, 0.01, 0.5]), rng.choice([0.0, -0.0, 0.012])) for i in range(120)] + [(200, None, 0.0), (201, 0.3, 0.3)]
    got = sorted((r["id"], r["other"], r["rank"], r["distance"]) for r in spatial.nearest_others(spark.createDataFrame(rows, "id int, x double, y double"), 0.02, 0.02, 3).collect())
    want = []
    for i, x, y in rows:
        near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in rows if j != i and None not in (x, a) and math.sqrt((x - a) ** 2 + (y - b) ** 2) <= 0.02) if x is not None else []
        want += [(i, j, n + 1, d) for n, (d, j) in enumerate(near[:3])]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, sorted(want), strict=True))
