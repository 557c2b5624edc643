"""Crosswalks, scopes and library matches on known cases."""

from pyspark.sql import functions as F

from placewright.operators import enrich


def test_codes(spark):
    cases = [(2, "E-Ⅲ-003", "2A058"), (3, "D-III-49", "3D001"), (3, "D-III-48", None), (3, "O-III-7", "3W007"), (4, "4H008", "4H007"), (4, "4A001", "4A001"), (5, "XH-J-035-V", "5D035"), (5, "ZZ-J-035-V", None), (2, "B-III-12", "2B012")]
    df = spark.createDataFrame([(b, c, w) for b, c, w in cases], "batch int, raw string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", enrich.official_code(F.col("batch"), F.col("raw")).alias("got")).collect())


def test_scopes(spark):
    rows = [("和平饭店", False, False, "", None, "building-reference"), ("圣约翰大学", False, False, "university", None, "organization"), ("张三", False, True, "", None, "person"), ("武康路", False, False, "", None, "uncertain"), ("X (Shanghai)", False, False, "old Mansion block", None, "building-reference"), ("和平饭店", True, False, "", None, "uncertain"), ("圣约翰大学", False, False, "", "complex", "complex")]
    df = spark.createDataFrame(rows, "title string, missing boolean, person boolean, types string, override string, want string")
    got = df.select("want", enrich.article_scope(F.col("title"), F.col("missing"), F.col("person"), F.col("types"), F.col("override")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_library_matches(spark):
    targets = spark.createDataFrame([
        ("a", "武康路100号", None, "某某公寓楼", "single-door", ["a"]), ("b", "武康路200-210号", "武康路204号", "住宅", "number-range", ["b"]), ("c", "武康路300号", "武康路999号", "住宅", "single-door", ["c"]),
        ("d", "武康路400号", None, "丁家花园", "single-door", ["d"]), ("e", "武康路500号", None, "住宅", "single-door", ["e"]), ("f", "武康路600号", None, "住宅", "single-door", ["f"]), ("g", "武康路700号", None, "住宅", "single-door", ["g"]), ("h", None, None, None, "missing-address", ["h"]),
    ], "id string, official string, listed string, uses string, address_class string, siblings array<string>")
    p = (121.45, 31.22)
    library = spark.createDataFrame([
        ("u1", "某某公寓楼", "武康路100号", *p), ("u2", "住宅", "武康路204号", *p), ("u3", "住宅", "武康路999号", *p), ("u4", "丁家花园", "武康路400号", *p), ("u5", "住宅", "武康路400号", 121.46, 31.2),
        ("u6", "住宅", "武康路500号", *p), ("u7", "商店", "武康路500号", 121.5, 31.2), ("u8", "住宅", "武康路600号", *p), ("u9", "商店", "武康路600号", *p), ("u10", "住宅", "武康路700号", *p), ("u11", "大楼", "别处1号", 121.47, 31.23),
    ], "uri string, name string, address string, lon double, lat double")
    none = spark.createDataFrame([], "id string, uri string")
    holds = spark.createDataFrame([("u10", "odd point")], "uri string, reason string")
    got = {r["id"]: (r["status"], r["uri"], r["scope"]) for r in enrich.match_library(targets, library, none, holds).collect()}
    door, site, review = "address-reference-point", "building-complex-reference-point", ("needs-review", None, None)
    assert got == {"a": ("accepted-reference-point", "u1", door), "b": ("accepted-reference-point", "u2", site), "c": review, "d": ("accepted-reference-point", "u4", site), "e": review, "f": ("accepted-reference-point", "u8", site), "g": review, "h": ("unmatched", None, None)}
    chosen = {r["id"]: r["uri"] for r in enrich.match_library(targets, library, spark.createDataFrame([("c", "u11")], "id string, uri string"), holds).collect()}
    assert chosen["c"] == "u11"
    wrong = spark.createDataFrame([("a", "nowhere"), ("b", "u1"), ("b", "u2")], "id string, uri string")
    told = {r["id"]: (r["status"], r["uri"], r["lon"]) for r in enrich.match_library(targets, library, wrong, holds).collect()}
    assert told["a"] == told["b"] == ("invalid-override", None, None) and told["d"][1] == "u4" and len(told) == 8


def test_plan_and_road_audit(spark):
    listings = spark.createDataFrame([("a", "武康路1号"), ("b", "武康路１号"), ("c", None)], "id string, official string")
    assert {r["id"]: (r["class"], r["siblings"]) for r in enrich.address_plan(listings).collect()} == {"a": ("single-door", ["a", "b"]), "b": ("single-door", ["a", "b"]), "c": ("missing-address", ["c"])}
    records = spark.createDataFrame([(1, "5 Rue Verte / 7 RUE ?? NORD"), (2, "9 Elsewhere"), (3, None)], "id long, address string")
    told = {(r["id"], r["status"]) for r in enrich.road_audit(records, spark.createDataFrame([("Rue verté",)], "name string")).collect()}
    assert told == {(1, "known"), (1, "deferred"), (2, "unknown"), (3, "no-expression")}
