"""Statuses, approved sites, replaced lines and boundary classes on small cases: nulls, ties, repeated rows, empty tables."""

from placewright.operators import settled, spatial


def test_review_statuses(spark):
    c = "candidate long, landmark long, listing string, near_only boolean, held boolean, located boolean, distance double"
    df = spark.createDataFrame(
        [
            (1, 1, "a", False, False, True, 1.0), (2, 1, "b", True, True, True, 1.0), (3, 2, "a", True, True, False, None), (4, 2, "b", None, True, False, None), (5, 2, "c", None, None, None, 9e9), (6, 2, "d", None, None, True, 250.5),
            (7, 2, "e", None, None, True, 250.0), (8, 2, None, None, None, True, None), (9, None, "a", None, None, True, 1.0), (10, 3, "a", None, None, True, 1.0), (11, 3, "b", None, None, True, 1.0), (12, 3, None, None, None, True, 1.0), (13, 1, "a", None, None, None, None),
        ],
        c,
    )
    decisions = spark.createDataFrame([(1, "hold", 1), (1, "accept-x", 2), (10, "accept-x", 5), (11, "accept-x", 6), (99, "hold", 1), (7, None, 1)], "candidate long, decision string, seq long")
    made, wrong = settled.review_statuses(df, decisions)
    assert {r["candidate"]: (r["status"], r["selected"]) for r in made.collect()} == {
        1: ("linked", "a"), 2: ("alternative-not-proven", "a"), 3: ("proximity-only", None), 4: ("held-current-use-or-member-scope", None), 5: ("needs-location-and-identity-review", None), 6: ("needs-location-or-branch-review", None),
        7: ("held-after-review", None), 8: ("needs-address-or-scope-evidence", None), 9: ("needs-address-or-scope-evidence", None), 10: ("linked", "b"), 11: ("linked", "b"), 12: ("needs-address-or-scope-evidence", "b"), 13: ("needs-location-and-identity-review", "a"),
    }
    assert [(r["rule"], r["key"]) for r in wrong.collect()] == [("decision-without-candidate", "99")]
    assert settled.review_statuses(df.limit(0), decisions.limit(0))[0].count() == 0


def test_approved_sites(spark):
    candidates = spark.createDataFrame([(1, 10, "A", ["http://off/1"]), (2, 10, "B", ["http://x"]), (3, 11, "C", ["http://x", "http://off/3"]), (4, 12, "D", None)], "candidate long, landmark long, listing string, sources array<string>")
    approvals = spark.createDataFrame([("C2", 1, None, None), ("C1", 2, None, None), ("C3", 3, None, None), ("C4", 4, None, None), ("C5", 9, None, None), ("C6", 3, None, None), ("C6", 4, None, None), ("C7", 4, "A", "http://off/9")], "row string, candidate long, corrected_listing string, corrected_source string")
    contextual = spark.createDataFrame([("D1", 1, "beside", ["http://off/1", "http://why"]), ("D2", 1, "beside", ["http://off/1"]), ("D3", 8, "?", None), ("D4", 4, "?", ["http://why"])], "row string, candidate long, reason string, sources array<string>")
    located = spark.createDataFrame([("A",), ("B",), ("A",)], "listing string")
    links, notes, wrong = settled.approved_sites(approvals, candidates, located, contextual, "off")
    assert {(r["landmark"], r["id"], r["listing"], tuple(r["more_listings"]), r["relation"]) for r in links.collect()} == {(10, "same-site-c1", "B", ("A",), "same-listed-complex"), (12, "same-site-c7", "A", (), "same-historical-site")}
    assert {(r["kind"], r["row"], r["source"], r["evidence"]) for r in notes.collect()} == {("unlocated", "C3", "http://off/3", None), ("contextual", "D1", "http://off/1", "http://why")}
    assert {(r["rule"], r["key"]) for r in wrong.collect()} == {("row-twice", "C6"), ("approval-without-candidate", "C5"), ("context-without-candidate", "D3"), ("note-without-source", "C4"), ("note-without-source", "D2"), ("note-without-source", "D4")}


def test_replaced_lines(spark):
    features = spark.createDataFrame([("a", "line", "old", "m", None, None), ("b", "point", "old", "m", None, False), ("c", "line", "other", "m", 1, True), ("d", None, "old", None, None, None), ("e", "line", None, None, None, None)], "id string, kind string, name string, modern string, line long, verified boolean")
    verified = spark.createDataFrame([("n1", "m"), ("n2", "k"), ("n3", "t"), ("n4", "t"), ("n5", None)], "name string, modern string")
    lines = spark.createDataFrame([(1, ["m", "m", None]), (2, ["m", "t"]), (3, None)], "line long, names array<string>")
    made, wrong = settled.replaced_lines(features, verified, lines, spark.createDataFrame([("old",), ("old",), (None,)], "name string"))
    assert {(r["id"], r["name"]) for r in made.collect()} == {("b", "old"), ("d", "old"), ("e", None), ("verified-m-1", "n1"), ("verified-m-2", "n1")}
    assert {(r["rule"], r["key"]) for r in wrong.collect()} == {("no-line-of-this-name", "k"), ("no-line-of-this-name", None), ("verified-twice", "t")}


SQUARES = [(p, x, y, *to) for p, ox, oy in ((0, 0.0, 0.0), (1, 5.0, 0.0), (2, -3.0, -3.0)) for (x, y), to in [((ox + a, oy + b), (ox + c, oy + d)) for a, b, c, d in ((0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0))]]


def test_polygons_side_by_side(spark):
    edges = spark.createDataFrame(SQUARES, "polygon int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(i, i * 0.37 - 4, j * 0.41 - 4) for i in range(30) for j in range(20)], "id int, x double, y double").selectExpr("id * 1000 + cast(y * 100 as int) as id", "x", "y")
    inside = {(r["id"], p) for r in points.collect() for p, ox, oy in ((0, 0, 0), (1, 5, 0), (2, -3, -3)) if ox < r["x"] < ox + 2 and oy < r["y"] < oy + 2}
    for band in (0.05, 0.7, 50.0):
        assert {(r["id"], r["polygon"]) for r in spatial.in_polygons(points, edges, band).collect()} == inside
        assert {(r["id"], r["polygon"]) for r in spatial.winding(points, edges, band).collect()} == inside
    met = spatial._meeting(points.where("x < 3 and y > 0"), edges, 0.5)
    assert met.where("polygon = 1").count() == 0  # a polygon beside a point is not met


def test_boundary_classes(spark):
    edges = spark.createDataFrame(SQUARES[:4], "polygon int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0, "x"), (2, 1.0, 1.0, "in"), (3, 9.0, 9.0, "in"), (4, 9.0, 9.0, "x"), (5, None, None, "in"), (6, None, 1.0, None), (7, 9.0, 9.0, None)], "id int, x double, y double, class string")
    made = settled.reclassified(points, edges, spark.createDataFrame([(7,), (7,), (None,)], "id int"), "in", "out", 0.5)
    assert {r["id"]: (r["class"], r["changed"]) for r in made.collect()} == {1: ("in", True), 2: ("in", False), 3: ("out", True), 4: ("x", False), 5: ("out", True), 6: (None, False), 7: ("in", True)}
