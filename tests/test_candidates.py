import pytest
from pyspark.sql import functions as F

from placewright.functions import text
from placewright.operators import candidates, relational, spatial

LANDMARKS = "landmark string, lon double, lat double, method string, relations array<string>, matches array<string>, members array<long>, held boolean"
LISTINGS = "listing string, lon double, lat double, title string, address string, components int, demolished boolean"


def test_spellings_and_keys(spark):
    rows = [("华安大楼（金门饭店）、旧 Pacific Hotel／太平",), ("住宅",), ("上海市福新面粉厂旧址",), ("ＡＢＣ  Mill",), ("第3栋",), (None,), ("",), ("Bank",)]
    got = [[k for k in r[0]] for r in spark.createDataFrame(rows, "t string").select(F.filter(F.transform(text.place_variants(F.col("t")), text.place_key), text.names_a_place)).collect()]
    assert got[0] == ["华安大楼金门饭店旧pacifichotel太平", "华安大楼金门饭店", "旧pacifichotel", "金门饭店", "华安大楼旧pacifichotel太平"]
    assert got[1:] == [[], ["福新面粉厂"], ["abcmill"], [], [], [], []]


def test_metres_on_the_globe(spark):
    places = [(i, lon, lat) for i, (lon, lat) in enumerate([(179.9999, 10.0), (-179.9999, 10.0), (0.0, 89.9999), (180.0, 89.9999), (121.0, 31.0), (121.001, 31.0), (None, 1.0)])]
    a = spark.createDataFrame(places, "id int, lon double, lat double").where("lon IS NOT NULL")
    b = a.select(F.col("id").alias("other"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    got = {(r["id"], r["other"]) for r in spatial.within_metres(a, b, 96.0).where("id < other").collect()}
    assert got == {(0, 1), (2, 3), (4, 5)}


def test_a_hot_key_is_dealt(spark):
    left = spark.createDataFrame([("k" if i % 3 else str(i), i) for i in range(300)] + [(None, 999)], "k string, i int")
    right = spark.createDataFrame([("k", "a"), ("k", "b"), ("3", "c"), (None, "d")], "k string, v string")
    got = sorted(map(tuple, relational.dealt_join(left, right, ["k"], "i", per=20).select("k", "i", "v").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "i", "v").collect())) and len(got) == 401


@pytest.fixture
def run(spark):
    def go(landmarks, listings, names=(), listed=(), current=(), old=(), addresses=(), urls=(), pages=(), conflicts=()):
        make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        found = candidates.candidates(
            make(landmarks, LANDMARKS), make(listings, LISTINGS), make(names, "landmark string, name string, role string"), make(listed, "listing string, name string, role string"), make(current, "landmark string, address string"),
            make(old, "landmark string, address string, number string, roads array<string>"), make(addresses, "listing string, address string"), make(urls, "landmark string, url string"), make(pages, "listing string, url string"), make(conflicts, "member long, listing string"))
        return {(r["landmark"], r["listing"]): r for r in found.collect()}

    return go


def landmark(key, lon=121.0, lat=31.0, **more):
    return tuple({"landmark": key, "lon": lon, "lat": lat, "method": "source-point", "relations": [], "matches": [], "members": [1], "held": False, **more}.values())


def listing(key, lon=121.0, lat=31.0, **more):
    return tuple({"listing": key, "lon": lon, "lat": lat, "title": "x", "address": "y", "components": 1, "demolished": False, **more}.values())


def test_every_kind_of_evidence(run):
    got = run(
        [landmark("a"), landmark("b", lon=121.001), landmark("c", lon=121.01), landmark("d", lon=None), landmark(None)], [listing("h"), listing("i", lon=121.0012), listing("j", lon=None), listing("k", lon=121.0101)],
        names=[("a", "华安大楼", "old"), ("b", "华安大楼东", "old"), ("d", "Pacific House", "old"), (None, "华安大楼", "old")], listed=[("h", "华安大楼", "official-original-name"), ("j", "PACIFIC  house", "official-original-name"), (None, "华安大楼", "x")],
        current=[("c", "上海市静安区南京西路104号"), ("a", "延安路12号")], addresses=[("j", "南京西路104号"), ("i", "延安路10-14号"), ("k", "福州路7号")], old=[("c", "7 Foochow Road", "7", ["福州路"]), ("c", "7 x", "7", ["福州路", "延安路"])],
        urls=[("b", "https://www.example.org/a/"), ("b", "https://fgj.sh.gov.cn/a")], pages=[("k", "http://example.org/A"), ("k", "http://fgj.sh.gov.cn/a")])
    assert set(got) == {("a", "h"), ("b", "h"), ("d", "j"), ("c", "j"), ("a", "i"), ("c", "k"), ("b", "k"), ("b", "i")}
    kinds = {k: sorted({e["match"] for e in r["evidence"]}) for k, r in got.items()}
    assert kinds["a", "h"] == ["normalized-exact"] and kinds["b", "h"] == ["distinctive-substring-review"] and kinds["c", "j"] == ["full-normalized-current-address"]
    assert kinds["a", "i"] == ["road-door-range-overlap-review"] and kinds["c", "k"] == ["old-road-name-and-number-coincidence-only"] and kinds["b", "k"] == ["shared-source"] and kinds["b", "i"] == []
    assert got["a", "h"]["class"] == "strong-one-to-one" and got["b", "i"]["class"] == "insufficient-evidence" and got["b", "i"]["hazards"] == ["distance-only-do-not-merge"]
    assert got["d", "j"]["distance"] is None and got["d", "j"]["class"] == "complex-site-review" and "heritage-has-no-coordinate" in got["d", "j"]["hazards"]


def test_hazards_and_rivals(run):
    name = lambda key, n, role="old": (key, n, role)
    got = run(
        [landmark("far", lon=121.01), landmark("held", held=True), landmark("one"), landmark("two"), landmark("now", lat=31.1), landmark("vs", lat=31.2, members=[7])],
        [listing("h1"), listing("h2", components=2), listing("h3", lat=31.1), listing("h4", lat=31.2), listing("h5", lon=121.0001)],
        names=[name("far", "甲乙大楼"), name("held", "丙丁大楼"), name("one", "戊己大楼"), name("two", "戊己大楼"), name("now", "庚辛大楼", "current-name"), name("vs", "壬癸大楼")],
        listed=[name("h1", "甲乙大楼"), name("h2", "丙丁大楼"), name("h5", "戊己大楼"), name("h3", "庚辛大楼"), name("h4", "壬癸大楼")], conflicts=[(7, "h4")])
    assert got["far", "h1"]["class"] == "name-match-location-conflict" and got["far", "h1"]["hazards"] == ["coordinate-separation-over-250m"]
    assert got["held", "h2"]["hazards"] == ["campus-complex-or-component-scope", "persistent-current-use-hold"]
    assert {got[k, "h5"]["class"] for k in ("one", "two")} == {"complex-site-review"} and got["one", "h5"]["hazards"] == ["multiple-strong-pairs"]
    assert got["now", "h3"]["hazards"] == ["existing-current-name-only-not-identity-proof"] and got["now", "h3"]["class"] == "complex-site-review"
    assert got["vs", "h4"]["hazards"] == ["reviewed-pair-conflict"]


def test_no_rows(run):
    assert run([], []) == {}


def test_doors_meet_once_and_on_all_cores(spark):
    """Addresses are read before the join: a pair over many blocks is one row, brings its keys, and few rows that make many pairs are still dealt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sides = []
        for key, numbers in (("landmark", ["3-90", "200", "41-47"]), ("listing", ["1-100", "41-43", "300"])):
            rows = spark.createDataFrame([(f"{key[:2]}{i}", f"南京东路{n}号") for i, n in enumerate(numbers)] * 2, f"{key} string, address string")
            sides.append(candidates._door_blocks(rows, key, F.col("address")))
        met = candidates.doors_in_common(*sides)
        got = sorted((r["landmark"], r["listing"], r["landmark_key"]) for r in met.collect())
        assert met.rdd.getNumPartitions() >= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("la0", "li0", "南京东路3-90号"), ("la0", "li1", "南京东路3-90号"), ("la2", "li0", "南京东路41-47号"), ("la2", "li1", "南京东路41-47号")]


def test_places_of_one_address_meet_in_blocks(spark, monkeypatch):
    """Pairs that only an address makes are not shuffled or written, each comes once, and one that is known by more has all of its evidence."""
    monkeypatch.setattr(candidates, "BLOCK", 4)
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    places = [landmark(f"l{i}", lon=121.0 + 0.01 * (i % 2), members=[i]) for i in range(30)]
    others = [listing(f"h{i}", lon=None if i % 5 == 0 else 121.0001, components=1 + (i % 7 == 0)) for i in range(25)]
    current = [(f"l{i}", a) for i in range(30) for a in (["上海市南京东路7号"] if i % 3 else ["南京东路7号", "福州路2号"])]
    addresses = [(f"h{i}", "南京东路5-8号" if i % 2 else "福州路2号") for i in range(25)]
    found = candidates.candidates(
        make(places, LANDMARKS), make(others, LISTINGS), make([("l3", "甲乙大楼", "old"), ("l1", "丙丁大楼", "old")], "landmark string, name string, role string"), make([("h4", "甲乙大楼", "official-original-name"), ("h7", "丙丁大楼", "official-original-name")], "listing string, name string, role string"),
        make(current, "landmark string, address string"), make([], "landmark string, address string, number string, roads array<string>"), make(addresses, "listing string, address string"), make([], "landmark string, url string"), make([], "listing string, url string"), make([(5, "h9"), (4, "h2")], "member long, listing string"))
    rows = found.collect()
    got = {(r["landmark"], r["listing"]): r for r in rows}
    assert len(got) == len(rows)
    by_address = {(f"l{i}", f"h{j}") for i in range(30) for j in range(25) if j % 2 or i % 3 == 0}
    near = {(f"l{i}", f"h{j}") for i in range(0, 30, 2) for j in range(25) if j % 5}
    assert set(got) == by_address | near
    assert all((r["n_addresses"] > 0) == (k in by_address) for k, r in got.items())
    assert [sorted(e["match"] for e in got[k]["evidence"]) for k in (("l3", "h4"), ("l1", "h7"), ("l6", "h2"))] == [["full-normalized-current-address", "normalized-exact"], ["normalized-exact", "road-door-range-overlap-review"], ["full-normalized-current-address"]]
    assert got["l1", "h3"]["hazards"] == ["coordinate-separation-over-250m"] and got["l1", "h5"]["hazards"] == ["heritage-has-no-coordinate"] and got["l1", "h21"]["hazards"] == ["campus-complex-or-component-scope", "coordinate-separation-over-250m"]
    assert "reviewed-pair-conflict" in got["l5", "h9"]["hazards"] and got["l1", "h7"]["class"] == "name-match-location-conflict"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline(_hs" in plan.split("\n+- ")[1].split("Join")[0]  # the union's second side: from blocks to rows without a join
