"""Points measured against geometries of any shape: containment, distance, and the nearest one however far.

Geometries are rows ``geometry, area, path`` (``path``: array of x, y in degrees; several rows with one id are its parts or rings). A path of one vertex
is a point, one with a null or non-finite coordinate takes no part, and the rings of an area are closed where they are not. Edges are dealt to square
cells along their line, so a long diagonal touches as many cells as it is long. Distances are metres on a plane that is true at the
point's latitude; cells use the narrowest scale of all points, on which nothing is further away than it is.

Which areas can hold a point is asked on grids that double in width: every area lies on the one that fits its extent, in at most four cells.
The nearest edge without a fixed reach is found in rounds over cells that widen fourfold; a point leaves with the first round whose cells are as
wide as its distance.

Geometries of one shape (equal kind and equal parts) are measured once, by the least of them. Where one geometry is chosen, that one is the choice;
where all are told, the result is repeated for each at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from placewright.functions import geo
from placewright.operators.checkpoints import written
from placewright.operators.relational import dealt_join, spread

# Metres of a degree, and tags that make a closed way an area.
DEGREE = 111195.0
AREA_TAGS = ("building", "landuse", "amenity", "leisure")


def is_area(path: Column, tags: Column) -> Column:
    """Whether a way is an area: closed, not denied, and claimed or tagged as something that covers ground."""
    closed = (F.size(path) >= 4) & (F.get(path, 0) == F.element_at(path, -1))
    told = tags["area"]
    some = F.exists(F.array(*[tags[t] for t in AREA_TAGS]), lambda v: F.coalesce(v != "", F.lit(False)))
    return F.coalesce(closed & ~told.eqNullSafe("no") & (told.eqNullSafe("yes") | some), F.lit(False))


def representative(geometries: DataFrame) -> DataFrame:
    """``geometry, mean_x, mean_y, centre_x, centre_y``: the mean of all vertices (closing ones too) and the middle of the bounds."""
    v = geometries.select("geometry", F.explode("path").alias("v")).where(F.col("v.x").isNotNull() & F.col("v.y").isNotNull())
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    return v.groupBy("geometry").agg(F.avg("v.x").alias("mean_x"), F.avg("v.y").alias("mean_y"), mid("v.x").alias("centre_x"), mid("v.y").alias("centre_y"))


def coordinate_profile(df: DataFrame, x: str, y: str, shape_x: str, shape_y: str) -> DataFrame:
    """One row on the coordinates of a table in metres: presence and bounds of its columns, the points of its shapes, how far the two
    differ, and how many rows share a place to four decimals or to the metre."""
    own, shape = F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(shape_x).isNotNull() & F.col(shape_y).isNotNull()
    gap = F.sqrt(F.pow(F.col(x) - F.col(shape_x), 2) + F.pow(F.col(y) - F.col(shape_y), 2))
    both = lambda c: F.when(own, F.col(c))
    head = df.agg(
        F.count_if(own).alias("both_present"), F.count_if(~own).alias("missing_either"), F.min(both(x)).alias("min_x"), F.max(both(x)).alias("max_x"), F.min(both(y)).alias("min_y"), F.max(both(y)).alias("max_y"),
        F.count_if(shape).alias("points"), F.count_if(~shape).alias("missing_points"), F.count_if(own & shape).alias("compared"), F.count_if(gap > 0.001).alias("mismatches"), F.max(gap).alias("largest_gap"))
    for name, digits in (("exact", 4), ("metre", 0)):
        shared = df.where(own).groupBy(F.round(x, digits), F.round(y, digits)).agg(F.count("*").alias("n")).where("n > 1")
        head = head.crossJoin(shared.agg(F.count("*").alias(f"{name}_places"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.max("n").alias(f"{name}_most")))  # a row each
    return head


def edges_of(geometries: DataFrame) -> DataFrame:
    """``geometry, area, x1, y1, x2, y2``."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    good = geometries.where(F.col("geometry").isNotNull() & (F.size("path") > 0) & ~F.exists("path", lambda v: v.isNull() | bad(v["x"]) | bad(v["y"])))
    area = F.coalesce("area", F.lit(False))
    ring = F.when(area & (F.get("path", 0) != F.element_at("path", -1)), F.concat("path", F.slice("path", 1, 1))).otherwise(F.col("path"))
    n = F.size("_r")
    pairs = F.when(n == 1, F.transform("_r", lambda v: F.struct(v.alias("a"), v.alias("b")))).otherwise(F.zip_with(F.slice("_r", F.lit(1), n - 1), F.slice("_r", F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    each = good.withColumn("_r", ring).select("geometry", area.alias("area"), F.explode(pairs).alias("_e"))
    return each.select("geometry", "area", *[F.col(f"_e.{v}.{c}").alias(f"{c}{i}") for i, v in ((1, "a"), (2, "b")) for c in ("x", "y")])


def alike(geometries: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The geometries (geometry, area, path, and keys) that are the least of their shape, and ``geometry, member`` for all that have it."""
    whole = geometries.where(F.col("geometry").isNotNull()).groupBy("geometry", *keys).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("area", F.lit(False)).alias("area"), "path"))).alias("_shape"))
    shapes = whole.groupBy("_shape", *keys).agg(F.min("geometry").alias("_least"))
    members = whole.join(shapes, ["_shape", *keys]).select(F.col("_least").alias("geometry"), F.col("geometry").alias("member"))
    return shapes.select(F.col("_least").alias("geometry"), *keys, F.inline("_shape")), members


def narrowest(points: DataFrame) -> float:
    """Metres of a degree of longitude where they are fewest."""
    most = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    return DEGREE * max(math.cos(math.radians(most)), 1e-6)


def _at(c: Column, scale: float, width: float | Column) -> Column:
    return F.floor(c * scale / width)


def rastered(edges: DataFrame, width: float, narrow: float, tall: float = DEGREE) -> DataFrame:
    """``edges`` with ``_cx, _cy``: a row for each cell that an edge touches; ``narrow`` and ``tall`` are the scales of x and y."""
    x1, y1, x2, y2 = F.col("x1") * narrow, F.col("y1") * tall, F.col("x2") * narrow, F.col("y2") * tall
    low, high, slack = F.least(x1, x2), F.greatest(x1, x2), 1e-6 * width
    y = lambda x: y1 + (y2 - y1) * (x - x1) / F.nullif(x2 - x1, F.lit(0.0))

    def column(i: Column) -> Column:
        a, b = y(F.greatest(low, i * width)), y(F.least(high, (i + 1) * width))
        bottom, top = F.coalesce(F.least(a, b), F.least(y1, y2)), F.coalesce(F.greatest(a, b), F.greatest(y1, y2))
        return F.transform(F.sequence(F.floor((bottom - slack) / width), F.floor((top + slack) / width)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    cells = F.flatten(F.transform(F.sequence(F.floor((low - slack) / width), F.floor((high + slack) / width)), column))
    dealt = edges.withColumn("_c", F.explode(cells))
    return dealt.withColumns({"_cx": F.col("_c")["i"], "_cy": F.col("_c")["j"]}).drop("_c")


def around(points: DataFrame, width: float, narrow: float) -> DataFrame:
    """``points`` in the nine cells around each."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return points.withColumn("_o", F.explode(steps)).withColumns({"_cx": _at(F.col("lon"), narrow, width) + F.col("_o.i"), "_cy": _at(F.col("lat"), DEGREE, width) + F.col("_o.j")}).drop("_o")


@F.pandas_udf(DoubleType())
def exact_scale(lat: pd.Series) -> pd.Series:
    """Metres of a degree of longitude by the C library's cosine: the JVM's differs from it in the last bit for one latitude in some 700."""
    return pd.Series([DEGREE * math.cos(math.radians(v)) for v in lat], dtype="float64")


def edge_distance(scale: Column | None = None) -> Column:
    """Metres from the point (lon, lat) to the edge (x1, y1, x2, y2). Edges that meet in a vertex are equally far from much of the plane, up to the last
    bit; so that the same one of them is chosen everywhere, the order of operations is the one of the queries' SQL. ``scale``: metres of
    a degree of longitude at the point."""
    k = DEGREE * F.cos(F.radians("lat")) if scale is None else scale
    ax, ay = (F.col("x1") - F.col("lon")) * k, (F.col("y1") - F.col("lat")) * DEGREE
    dx, dy = (F.col("x2") - F.col("x1")) * k, (F.col("y2") - F.col("y1")) * DEGREE
    long2 = dx * dx + dy * dy
    t = F.when(long2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(long2, F.lit(0.0)))))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def nearest_edges(points: DataFrame, edges: DataFrame, width: float, keys: Sequence[str] = (), grow: int = 4) -> DataFrame:
    """``id`` and ``keys`` of every point (id, lon, lat, and keys) with ``geometry`` and ``distance`` of its nearest edge (of equal keys), however far; equal
    distances go by geometry. Points without any edge to compare have no row."""
    keys = list(keys)
    narrow = narrowest(points)
    left = written(spread(points.select("id", "lon", "lat", *keys).where("lon IS NOT NULL AND lat IS NOT NULL"), "id").withColumn("_k", exact_scale("lat")), "points")
    ends = ["x1", "y1", "x2", "y2"]
    edges = written(edges.select("geometry", *[k for k in keys if k != "geometry"], *ends).distinct() if "geometry" in keys else edges.groupBy(*keys, *ends).agg(F.min("geometry").alias("geometry")), "edges")
    spans = edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    own = left.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    found = None
    if spans[0] is not None and own[0] is not None:
        extent = max((max(spans[1], own[1]) - min(spans[0], own[0])) * narrow, (max(spans[3], own[3]) - min(spans[2], own[2])) * DEGREE)
        while True:
            last = width > extent
            met = around(left, width, narrow).join(rastered(edges, width, narrow), [*keys, "_cx", "_cy"]).withColumn("_d", edge_distance(F.col("_k")))
            best = met.groupBy("id", *keys).agg(F.min(F.struct(F.col("_d").alias("d"), (F.col(keys[0]) if "geometry" in keys else F.col("geometry")).alias("g"))).alias("_b"))
            best = best.select("id", *keys, *([] if "geometry" in keys else [F.col("_b.g").alias("geometry")]), F.col("_b.d").alias("distance"))
            done = written(best if last else best.where(F.col("distance") <= width), "nearest")
            found = done if found is None else found.unionByName(done)
            if last:
                break
            left = written(left.join(done.select("id", *keys), ["id", *keys], "left_anti"), "points")
            if not left.limit(1).count():
                break
            width *= grow
    if found is None:
        kept = edges.join(points.select("id", *keys), keys, "inner") if keys else edges.crossJoin(points.select("id").limit(0))
        found = kept.select("id", *keys, *([] if "geometry" in keys else ["geometry"]), F.lit(0.0).alias("distance")).limit(0)
    return found


def inside(points: DataFrame, edges: DataFrame, base: float, narrow: float) -> DataFrame:
    """``id, geometry`` of the areas that hold each point, by the even-odd rule over all of an area's rings."""
    own = edges.where("area")
    boxes = own.groupBy("geometry").agg(F.min(F.least("x1", "x2")).alias("left"), F.max(F.greatest("x1", "x2")).alias("right"), F.min(F.least("y1", "y2")).alias("bottom"), F.max(F.greatest("y1", "y2")).alias("top"))
    size = F.greatest((F.col("right") - F.col("left")) * narrow, (F.col("top") - F.col("bottom")) * DEGREE, F.lit(base))
    boxes = written(boxes.withColumn("level", F.ceil(F.log2(size / base)).cast("int")).withColumn("w", base * F.pow(F.lit(2.0), F.col("level"))), "boxes")
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # some twenty at most
    w = base * F.pow(F.lit(2.0), F.col("level"))
    asked = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"_cx": _at(F.col("lon"), narrow, w), "_cy": _at(F.col("lat"), DEGREE, w)})
    span = lambda a, b, scale: F.sequence(_at(F.col(a), scale, F.col("w")), _at(F.col(b), scale, F.col("w")))
    dealt = boxes.withColumn("_cx", F.explode(span("left", "right", narrow))).withColumn("_cy", F.explode(span("bottom", "top", DEGREE)))
    held = asked.join(dealt, ["level", "_cx", "_cy"]).where("lon BETWEEN left AND right AND lat BETWEEN bottom AND top")
    band = lambda c: _at(c, DEGREE, F.col("w") / 64)
    probes = held.select("id", "lon", "lat", "geometry", band(F.col("lat")).alias("_b"))
    sides = own.where("y1 <> y2").join(boxes.select("geometry", "w"), "geometry").withColumn("_b", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    met = dealt_join(probes, sides.drop("w", "area"), ["geometry", "_b"], "id").where(geo.crosses(*[F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")]))
    return met.groupBy("id", "geometry").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "geometry")


def measured(points: DataFrame, geometries: DataFrame, reach: float = 160.0) -> DataFrame:
    """``id, geometry, containment, distance, boundary`` of every geometry that holds a point (id, lon, lat) or is at most ``reach`` metres away.
    ``containment`` is ``not-checked`` for what is no area; ``distance`` is 0 inside; ``boundary`` is the distance to the nearest edge. Both are rounded to
    centimetres. Points without coordinates have no rows; ids are taken to be unique."""
    own = written(spread(points.select("id", "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL"), "id"), "points")
    narrow = narrowest(own)
    shapes, members = alike(geometries)
    edges = written(edges_of(shapes), "edges")
    near = around(own, reach, narrow).join(rastered(edges, reach, narrow), ["_cx", "_cy"]).withColumn("_d", edge_distance()).where(F.col("_d") <= reach + 0.005)
    near = near.groupBy("id", "geometry").agg(F.min("_d").alias("boundary"), F.bool_or("area").alias("area"))
    near = written(near.where(F.round("boundary", 2) <= reach), "near")
    held = written(inside(own, edges, reach, narrow), "inside")
    deep = held.join(near.select("id", "geometry"), ["id", "geometry"], "left_anti").join(own, "id")
    far = nearest_edges(deep, edges, reach * 4, ["geometry"]).select("id", "geometry", F.col("distance").alias("boundary"), F.lit(True).alias("area"))
    both = written(near.unionByName(far).join(held.withColumn("_in", F.lit(True)), ["id", "geometry"], "left"), "measured")
    held_by = F.coalesce("_in", F.lit(False))
    return dealt_join(spread(both, "id"), written(members, "members"), ["geometry"], "id").select("id", F.col("member").alias("geometry"), F.when(~F.col("area"), "not-checked").when(held_by, "inside").otherwise("outside").alias("containment"), F.when(held_by, 0.0).otherwise(F.round("boundary", 2)).alias("distance"), F.round("boundary", 2).alias("boundary"))


def layered(points: DataFrame, geometries: DataFrame, layers: Sequence[tuple[str, float]]) -> DataFrame:
    """``id, layer, geometry, distance`` of what a click on each point (id, lon, lat) selects: of the first of ``layers`` (name, radius in metres)
    that has a geometry (columns layer, geometry, area, path) within its radius or around the point, the nearest one; equal distances go by
    geometry. Layers that are not listed are hidden; points that hit nothing have no row. All layers are asked in one join, on cells as wide as the largest radius."""
    reach = {n: float(r) for n, r in layers}
    order = F.array_position(F.array(*[F.lit(n) for n in reach]), F.col("layer")).cast("int")
    own = written(spread(points.select("id", "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL"), "id"), "points")
    shown, _ = alike(geometries.where(F.col("layer").isin(*reach)), ["layer"])
    edges, width, narrow = written(edges_of(shown.withColumn("geometry", F.struct(order.alias("at"), "layer", "geometry"))), "edges"), max(*reach.values(), 1.0), narrowest(own)
    radius = F.element_at(F.array(*[F.lit(r) for r in reach.values()]), F.col("geometry.at"))
    near = around(own, width, narrow).join(rastered(edges, width, narrow), ["_cx", "_cy"]).withColumn("_d", edge_distance()).where(F.col("_d") <= radius)
    hits = near.select("id", "geometry", "_d").unionByName(inside(own, edges, width, narrow).withColumn("_d", F.lit(0.0)))
    best = hits.groupBy("id").agg(F.min(F.struct(F.col("geometry.at").alias("at"), F.col("_d").alias("d"), F.col("geometry.layer").alias("layer"), F.col("geometry.geometry").alias("geometry"))).alias("_b"))
    return best.select("id", "_b.layer", "_b.geometry", F.col("_b.d").alias("distance"))
