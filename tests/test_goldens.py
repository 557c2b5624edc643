"""Known answers of names, addresses, coordinates and linkage."""

import pytest
from pyspark.sql import functions as F

from placewright.functions import address, geo, text
from placewright.operators import linkage, overlay, validate
from placewright.sources import html


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def L(v):
    return F.lit(v)


def test_western_addresses(spark):
    for written, key in [("No. 597, Rte. de Zikawei", "ROUTE DE ZIKAWEI|597"), ("597 ROUTE DE ZIKAWEI", "ROUTE DE ZIKAWEI|597"), ("Route Pottier Gardens", "ROUTE POTTIER GARDENS"), (None, ""), ("Av. Foch 12A", "AVENUE FOCH|12A")]:
        assert one(spark, address.western_key(L(written).cast("string"))["key"])[0] == key


def test_name_variants(spark):
    pairs = [("St. Joseph's Church", "St Josephs Church", True), ("Cemetery", "Seminary", False), ("", "", False), ("École Rémi", "ECOLE REMI", True)]
    for a, b, same in pairs:
        assert one(spark, text.are_variants(L(a), L(b)))[0] is same


def test_search_keys(spark):
    assert one(spark, text.search_key(L("  Rue d’Aurélie ")), text.search_key(L("復興公園")))[:] == ("rue d aurelie", "复兴公园")


def test_text_expressions(spark):
    assert one(spark, text.slug(L("École St. Jean / 復興")), text.year_in(L("built 1898, 1902")), text.half_up(L(-2.5)))[:] == ("ecole-st-jean-復興", 1898, -2.0)
    assert one(spark, text.title(L("rue DE la PAIX IV")), text.redact(L("http://a/b?key=secret&x=1")), text.years_in(L("1898 and 1902")))[:] == ("Rue de la Paix IV", "http://a/b?key=…&x=1", [1898, 1902])
    assert one(spark, text.nullable(L(" \0 ")), text.period(L(1898), L(None).cast("int")), text.period(L(1898), L(1902)))[:] == (None, "from 1898", "1898–1902")


def test_frames(spark):
    d = lambda v: L(float(v))
    assert one(spark, *geo.utm_to_wgs84(d(351450.8), d(3454972.8)))[:] == (121.440464, 31.219467)
    assert one(spark, *geo.utm_to_wgs84(d(352625.3067), d(3455110.1024)))[:] == (121.452771, 31.220854)
    x, y = one(spark, *geo.wgs84_to_utm(d(121.440464), d(31.219467)))
    assert abs(x - 351450.8) < 0.06 and abs(y - 3454972.8) < 0.06
    assert one(spark, *geo.wgs84_to_utm(d("nan"), d(31)))[:] == (None, None)
    assert one(spark, *geo.wgs84_to_gcj02(d(121.440464), d(31.219467)))[:] == (121.445076, 31.217594)
    assert one(spark, *geo.wgs84_to_gcj02(d(2.3522), d(48.8566)))[:] == (2.3522, 48.8566)
    assert one(spark, *geo.gcj02_to_wgs84(d(121.445076), d(31.217594)))[:] == (121.440464, 31.219467)
    assert one(spark, *geo.bd09_to_gcj02(d(116.404), d(39.915)))[:] == (116.397627, 39.908657)


@pytest.mark.parametrize(("a", "b", "meet"), [
    ("虎丘路142-146号", "虎丘路146号", True), ("虎丘路142-146号", "虎丘路147号", False), ("武康路2-10号（双号）", "武康路3号", False), ("武康路2-10号（双号）", "武康路4号", True),
    ("延安路10弄3号", "延安路10号", False), ("延安路10弄3号", "延安路10弄3号", True), ("延安路10弄3号", "延安路10弄5号", False), ("延安路10弄", "延安路10弄5号", True),
])
def test_door_overlap(spark, a, b, meet):
    assert one(spark, address.overlap(L(a), L(b)))[0] is meet


@pytest.mark.parametrize(("listed", "road", "number", "kind"), [
    ("岳阳路319号11号楼", "岳阳路", 11, None), ("岳阳路319号11号楼", "岳阳路", 319, "same-frontage-number"), ("华山路351弄11号", "华山路", 11, None), ("华山路351弄11号", "华山路", 351, "same-lane-entrance-number"),
    ("复兴中路543-551号", "复兴中路", 544, None), ("复兴中路543-551号", "复兴中路", 547, "frontage-range-candidate"),
])
def test_frontage(spark, listed, road, number, kind):
    assert one(spark, address.frontage(L(listed), L(road), L(number)))[0] == kind


def test_expressions_and_classes(spark):
    for written, parts in [("1/9 AMOY ROAD", ["AMOY ROAD"]), ("250 HUAYUAN / 723 TONGXIN", ["HUAYUAN", "TONGXIN"]), ("20E ROUTE PERE ROBERT", ["ROUTE PERE ROBERT"]), ("311/331 AVENUE PETAIN / 83 ROUTE PICHON", ["AVENUE PETAIN", "ROUTE PICHON"])]:
        assert one(spark, address.expressions(L(written)))[0] == parts
    for written, kind in [("武康路100号", "single-door"), ("武康路100-110号", "number-range"), ("武康路100、102号", "multiple-numbers"), ("武康路1号、复兴路2号", "multiple-streets"), ("延安路10弄3号", "lane-door"), ("岳阳路319号11号楼", "sub-building"), ("武康路安福路路口", "intersection"), ("张家宅12号", "rural-number"), ("", "missing-address")]:
        assert one(spark, address.address_class(L(written), F.size(address.components(L(written)))))[0] == kind, written


RECORD = "id long, name string, name_zh string, address string, x double, y double, start_year int, n_types int"


def clusters(spark, rows, vetoes=None):
    linked = linkage.sites(spark.createDataFrame(rows, RECORD), vetoes)
    found: dict = {}
    for r in linked.select("site", "id").collect():
        found.setdefault(r["site"], set()).add(r["id"])
    return sorted(map(sorted, found.values()))


def test_no_transitive_chain(spark):
    rows = [(i + 1, f"House {w}", "", "Rue Verte", x, 0.0, None, 0) for i, (x, w) in enumerate([(350000.0, "Alpha"), (350029.0, "Beta"), (350058.0, "Gamma")])]
    assert clusters(spark, rows) == [[1, 2], [3]]


def test_semantic_radius_vetoes_and_missing_points(spark):
    rows = [(10, "Aurora College", "", "", 100.0, 0.0, None, 0), (11, "Aurora Colege", "", "", 107.9, 0.0, None, 0), (12, "Aurora College", "", "", 116.1, 0.0, None, 0), (13, "Aurora College", "", "", None, None, None, 0)]
    assert clusters(spark, rows) == [[10, 11], [12], [13]]
    assert clusters(spark, rows, spark.createDataFrame([(11, 10)], "a long, b long")) == [[10], [11], [12], [13]]


def test_numbered_addresses_and_names(spark):
    rows = [(1, "Church", "", "No. 5 Rue Verte", 0.0, 0.0, 1890, 1), (2, "Saint Peter Church", "", "5 RUE VERTE", 200.0, 0.0, 0, 0), (3, "Other", "", "6 RUE VERTE", 10.0, 0.0, 0, 0)]
    linked = linkage.sites(spark.createDataFrame(rows, RECORD))
    table = {r["primary_id"]: r for r in linkage.site_table(linked).collect()}
    assert table[2]["n"] == 2 and table[2]["name"] == "Saint Peter Church" and table[2]["x"] == 100.0 and table[2]["start_year"] == 1890
    assert {tuple(r["names"]) for r in linkage.alias_groups(linked).collect()} == {("Saint Peter Church", "Church"), ("Other",)}


def test_table_grid(spark):
    page = "<table><tr><th colspan=2>Code</th><th>Name</th></tr><tr><td rowspan=3>A</td><td>1</td><td>x<br>y</td></tr><tr><td>2</td><td>z</td></tr><tr><td>3</td></table><table><tr><td>&amp;</td></tr></table>"
    assert [c[5] for c in html.grid(page) if c[0] == 0 and c[1] == 2] == ["A", "2", "z"] or sorted((c[2], c[5]) for c in html.grid(page) if c[:2] == (0, 2)) == [(0, "A"), (1, "2"), (2, "z")]
    rows = html.table_cells(spark.createDataFrame([(1, page), (2, None)], "id long, page string"), "id", "page").collect()
    assert [(r["table"], r["row"], r["col"], r["text"]) for r in rows if r["table"] == 1] == [(1, 0, 0, "&")]
    assert {(r["row"], r["text"]) for r in rows if r["table"] == 0 and r["col"] == 0} == {(0, "Code"), (1, "A"), (2, "A"), (3, "A")}
    assert one(spark, html.detail_map(L("<tr><td>Name</td><td> Old  hall </td></tr><tr><th>Year</th> <td>1898</td></tr>")))[0] == {"Name": "Old hall", "Year": "1898"}


def test_enforce(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    validate.enforce(validate.references(df, "k", "k", df, "k"))
    with pytest.raises(ValueError, match="unique 1: 2"):
        validate.enforce(validate.all_of(validate.required(df, "k", ["k"]), validate.unique(df, "k")))
    assert {(r["key"], r["detail"]) for r in validate.columns(df, ["k", "w"]).collect()} == {("v", "unexpected"), ("w", "missing")}


def test_guarded_update_violations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    done, wrong = overlay.guarded_update(df, spark.createDataFrame([(1, "a", "x"), (2, "c", "y")], "k long, before string, after string"), "k", "v")
    assert {(r["k"], r["v"]) for r in done.collect()} == {(1, "x"), (2, "b")} and [r["k"] for r in wrong.collect()] == [2]
    held = spark.createDataFrame([(1, "a", "b", "c", "d")], "id long, currentUse string, currentUseMatch string, currentAddress string, name string")
    assert overlay.without_current_use(held).columns == ["id", "name"]
