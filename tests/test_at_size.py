"""Operators whose answer must not turn on how rows are dealt or how long a chain is."""

import itertools
import random

from pyspark.sql import functions as F

from placewright import catalogue
from placewright.functions import address
from placewright.operators import linkage, relational, review, spatial
from placewright.sources import html, sinks


def test_chunks_are_whole_over_many_partitions(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("wide", F.repeat(F.md5(F.col("l_orderkey").cast("string")), 8))
        rows = rows.unionByName(rows)
        relational.chunked(rows, ["l_shipdate", "l_orderkey", "l_linenumber"], 50).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    got = spark.read.parquet(f"{tmp_path}/out")
    n = rows.count()
    told = got.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.max("chunk")).first()
    assert tuple(told) == (n, n, 1, n, -(-n // 50))
    dates = [r[0] for r in got.orderBy("rank").select("l_shipdate").collect()]
    assert dates == sorted(dates)
    assert relational.chunked(rows.limit(0), ["l_orderkey"], 50).count() == 0


def test_redirects_of_any_length(spark):
    edges = [(i, i + 1) for i in range(1, 90)] + [(200, 201), (201, 202), (202, 200), (300, 201)]
    got = {r["source"]: (r["final"], r["hops"]) for r in relational.redirects(spark.createDataFrame(edges, "s int, t int"), "s", "t").collect()}
    assert all(got[i] == (90, 90 - i) for i in range(1, 90))
    assert all(got[i] == (None, None) for i in (200, 201, 202, 300))


def test_large_components_merge_alike(spark):
    rng = random.Random(8)
    places = [(i, f"Hall {rng.choice('abc')}", "", rng.choice(["Rue du Sud", "No. 5 Rte. Nord", ""]), rng.uniform(0, 120), rng.uniform(0, 120), 1900, 1) for i in range(120)]
    records = spark.createDataFrame(places, "id int, name string, name_zh string, address string, x double, y double, start_year int, n_types int")
    one = {r["sid"]: r["site"] for r in linkage.sites(records).collect()}
    assert one == {r["sid"]: r["site"] for r in linkage.sites(records, most_pairs=10).collect()}
    assert len(set(one.values())) < 120


def test_links_that_compete(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 12), (4, 13), (None, 14), (None, 15)], "a int, b int")
    assert [tuple(r) for r in relational.only_once(rows, "a", "b").collect()] == [(4, 13)]
    assert {tuple(r) for r in relational.competition(rows.where("a IS NOT NULL"), "a", "b").collect()} == {(1, 10, 1, 0), (1, 11, 1, 0), (2, 12, 0, 1), (3, 12, 0, 1), (4, 13, 0, 0)}


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), a := rng.randrange(500), a + rng.randrange(-2, 300)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k int, low int, high int")
    got = sorted((r["id"], r["other"]) for r in relational.overlapping(df, ["k"], "id", "low", "high", 16).collect())
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and max(a[2], b[2]) <= min(a[3], b[3]) and a[2] <= a[3] and b[2] <= b[3])
    assert got == want


def test_greedy_name_groups(spark):
    rows = [("g", 1, "Saint Joseph Church of the City", 90), ("g", 2, "Saint Joseph Chursh of the City", 80), ("g", 3, "Seminary", 20), ("h", 4, "Saint Joseph Church of the City", 10)]
    got = {r["id"]: r["leader"] for r in review.variant_groups(spark.createDataFrame(rows, "grp string, id int, name string, score int"), "grp", "id", "name", "score").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_character_references(spark):
    rows = [("a &amp; b &eacute; &#233;&#x4E2D; &unknown; &#xD800; & c",), ("&lt;b&gt;",), (None,), ("no sign",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(html.unescape(F.col("t"))).collect()]
    assert got == ["a & b é é中 &unknown; &#xD800; & c", "<b>", None, "no sign"]
    long = "<script>" + "x<y </p>" * 50_000 + "</script>text &lt;b&gt;"
    assert spark.createDataFrame([(long,)], "t string").select(html.plain(F.col("t"))).first()[0] == "text <b>"


def test_doors_token_by_token(spark):
    def read(text):
        return [tuple(d) for d in spark.createDataFrame([(text,)], "t string").select(address.doors(F.col("t"))).first()[0]]

    assert read("上海市黄浦区南京东路100-120号(双号)") == [("南京东路", False, 100, 120, 0, None, None)]
    assert read("延安路5弄3-7号、8号") == [("延安路", True, 5, 5, None, 3, 7)]
    assert read("甲路1号，乙街2号") == [("甲路", False, 1, 1, None, None, None), ("乙街", False, 2, 2, None, None, None)]
    assert read("无号") == [] and read(None) == []


def test_feature_collections(spark):
    rows = spark.createDataFrame([(i, 1.0 * i, 2.0, "n" if i % 2 else None) for i in range(5)], "id int, x double, y double, name string")
    got = {r["chunk"]: r["value"] for r in sinks.feature_collections(rows, F.col("x"), F.col("y"), ["id", "name"], ["id"], 3).collect()}
    assert len(got) == 2 and got[2] == '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":3,"name":"n"},"geometry":{"type":"Point","coordinates":[3.0,2.0]}},{"type":"Feature","properties":{"id":4},"geometry":{"type":"Point","coordinates":[4.0,2.0]}}]}'


def test_components_of_chains_stars_and_circles(spark):
    rng = random.Random(4)
    order = list(range(100, 160))
    rng.shuffle(order)
    pairs = list(itertools.pairwise(order)) + [(500, i) for i in range(501, 530)] + [(700, 701), (701, 702), (702, 700), (701, 700), (900, 900)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "left string, right string")
    got = {int(r["sid"]): int(r["component"]) for r in linkage.components(df).collect()}
    assert got == {**{i: 100 for i in order}, 500: 500, **{i: 500 for i in range(501, 530)}, 700: 700, 701: 700, 702: 700}
    assert linkage.components(df.limit(0)).count() == 0


def test_lookups_that_are_exact_need_no_manual_table(spark):
    index = review.name_index(spark.createDataFrame([(1, "Red Hall")], "k int, name string"), "k", ["name"])
    manual = spark.createDataFrame([("red hall", 7), ("RED HALL", 8), ("Old", 9), ("old", 9)], "alias string, k int")
    got = sorted((r["asked"], r["k"] or 0, r["how"]) for r in review.by_alias(spark.createDataFrame([("Red  hall",), ("OLD",), ("x",), (None,)], "asked string"), "asked", index, "k", manual).na.fill("-").collect())
    assert got == [("-", 0, "none"), ("OLD", 9, "manual"), ("Red  hall", 1, "exact"), ("x", 0, "none")]


def test_a_veto_holds_back_one_term(spark):
    terms, vetoes = {"SZECHUEN ROAD": "四川路", "NORTH SZECHUEN ROAD": "四川北路", "BUND": "外滩"}, {"SZECHUEN ROAD": "NORTH SZECHUEN"}
    rows = spark.createDataFrame([("1 NORTH SZECHUEN ROAD, 2 SZECHUEN ROAD",), ("NORTH SZECHUEN LANE BUND SZECHUEN ROAD",), (None,)], "t string")
    assert [r[0] for r in rows.select(review.translated(F.col("t"), terms, vetoes)).collect()] == ["1 四川北路, 2 四川路", "NORTH SZECHUEN LANE 外滩 SZECHUEN ROAD", None]


def test_detail_pages_with_markup_and_repeats(spark):
    page = "<table><tr><th>Name</th><td><b>Old</b> hall</td></tr><tr><td>Year</td><td>1</td></tr><tr><td>Year</td>\n<td>1898<br>?</td></tr><tr><td>alone</td></tr></table>"
    assert spark.createDataFrame([(page,), (None,)], "t string").select(html.detail_map(F.col("t")).alias("m")).collect()[0]["m"] == {"Name": "Old hall", "Year": "1898 ?"}


def test_lines_without_a_modern_road_stay(spark):
    vertices = spark.createDataFrame([("a", "k", i, i * 1.0, 0.0) for i in range(3)] + [("b", "k", i, 50.0 + i, 90.0) for i in range(4)], "line string, key string, pos int, x double, y double")
    roads = spark.createDataFrame([(1, "k", 5, -100.0, -99.0, 100.0, 101.0)], "segment int, key string, group int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["line"], r["part"] or 0, r["segment_group"] or 0, r["n"]) for r in spatial.aligned_lines(vertices, roads, "key", 1.5, 2.0).collect())
    assert got == [("a", 1, 5, 2), ("b", 0, 0, 4)]


def test_rows_alike_merge_as_the_plain_rule_does(spark):
    """Copies, shared addresses and near names at few places, against the rule over all pairs of rows."""
    rng = random.Random(21)
    spots = [(0.0, 0.0), (0.0, 0.0), (5.0, 0.0), (12.0, 3.0), (25.0, 0.0), (180.0, 0.0), (260.0, 4.0)]
    names = ["Large Hall", "Large Hal", "Lrge Hal", "Small House", "Small Houses", ""]
    places = [(i, rng.choice(names), rng.choice(["", "", "大楼"]), rng.choice(["Rue du Sud", "No. 5 Rte. Nord", "No. 6 Rte. Nord", "", ""]), *rng.choice(spots), 1900, 1) for i in rng.sample(range(5000), 160)]
    records = spark.createDataFrame(places, "id int, name string, name_zh string, address string, x double, y double, start_year int, n_types int")
    for vetoes in (None, spark.createDataFrame([(a[0], b[0]) for a, b in zip(places[:20], places[20:40], strict=True)], "a int, b int")):
        pairs = linkage.candidate_pairs(records, vetoes).withColumn("rank", linkage._rank()).toPandas().sort_values(["rank", "distance", "left", "right"])
        plain = linkage._complete_link(pairs)
        want = {str(p[0]).zfill(12): str(p[0]).zfill(12) for p in places} | dict(zip(plain["sid"], plain["site"], strict=True))
        assert {r["sid"]: r["site"] for r in linkage.sites(records, vetoes).collect()} == want
    assert linkage.node_pairs(linkage.nodes(linkage.prepared(records))).count() < len(pairs) / 5


def test_spellings_are_compared_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.choice(["LARGERING", "LARGERIN", "HOTBOLT", "HOT", "HOTS", "", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g string, c string")
    near = lambda a, b: a == b or {a, b} == {"LARGERING", "LARGERIN"}
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] and b[2] and near(a[2], b[2]))
    assert sorted(map(tuple, linkage.spelling_pairs(df, ["g"], "k", "c").collect())) == want


def test_a_small_file_with_many_pairs_is_dealt(spark, sf_dir):
    made = catalogue.QUERIES["candidate_classification"](spark, sf_dir)
    assert made.rdd.getNumPartitions() >= 4


def test_equal_names_are_cut_once(spark):
    """Grams are cut from each name once, however many rows bear it, and every row gets its links."""
    left = spark.createDataFrame([("A", "bank"), ("B", "mill"), ("C", "ban")], "id string, name string")
    right = spark.createDataFrame([(i, "bank co" if i % 2 else "bank of a far land") for i in range(50)] + [(99, None)], "other int, name string")
    made = review.substring_pairs(left, right)
    assert sorted(map(tuple, made.collect())) == [("A", i) for i in range(1, 50, 2)]
    assert "Aggregate [other_name" in made._jdf.queryExecution().optimizedPlan().toString()


def test_rows_alike_pair_as_arrays(spark, monkeypatch):
    """All pairs against the plain rule, with ids in several rows and groups of several blocks; no exchange stands between the arrays and the pairs."""
    monkeypatch.setattr(linkage, "BLOCK", 3)
    rng = random.Random(31)
    spots = [(0.0, 0.0), (-0.0, 0.0), (5.0, 0.0), (12.0, 3.0), (25.0, 0.0), (180.0, 0.0)]
    names, streets = ["Large Hall", "Large Hal", "Small House", ""], ["Rue du Sud", "No. 5 Rte. Nord", "", ""]

    def some(ids):
        return [(i, rng.choice(names), rng.choice(["", None, "大楼"]), rng.choice(streets), *rng.choice(spots), 1900, 1) for i in ids]

    alone = some(range(90))
    near = lambda a, b: bool(a and b) and (a == b or {a, b} == {"Large Hall", "Large Hal"})

    def code(a, b):
        far = ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5
        if a[3] and a[3] == b[3] and far <= (250 if "5" in a[3] else 30):
            return (0 if "5" in a[3] else 1, far)
        return (2, far) if far <= 8 and (near(a[1], b[1]) or near(a[2], b[2])) else None

    for places in (alone, alone + some(range(5)) + alone[:9]):
        told = {}
        for a, b in itertools.product(places, places):
            if a[0] < b[0] and (c := code(a, b)):
                told.setdefault((a[0], b[0]), []).append(c)
        want = sorted((*k, min(v)[0], round(min(d for _, d in v), 6)) for k, v in told.items())
        made = linkage.candidate_pairs(spark.createDataFrame(places, "id int, name string, name_zh string, address string, x double, y double, start_year int, n_types int"))
        got = made.withColumn("rank", linkage._rank()).collect()
        assert sorted((int(r["left"]), int(r["right"]), r["rank"], round(r["distance"], 6)) for r in got) == want
        if places is alone:
            assert "Aggregate [left" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_blocks_are_made_last(spark, sf_dir):
    """Nothing that grows with the pairs is joined, broadcast or shuffled."""
    made = catalogue.QUERIES["candidate_classification"](spark, sf_dir)
    assert "Generate inline(_suppliers" in made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert made.count() == made.select("p_partkey", "s_suppkey").distinct().count() > 0
