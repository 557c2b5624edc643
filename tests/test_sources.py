"""Scans, sinks and feeds on small files."""

import json
import random
import struct

from pyspark.sql import functions as F

from placewright.sources import html, records, sinks
from placewright.streaming import feeds


def test_json_and_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 2, "name": "b"}, {"id": 1, "name": None}]))
    assert [tuple(r) for r in records.json_array(spark, str(tmp_path / "a.json"), "struct<id:bigint,name:string>").orderBy("pos").collect()] == [(0, 2, "b"), (1, 1, None)]
    doc = {"type": "FeatureCollection", "features": [{"properties": {"id": "x"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3.5, -4]]}}]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    row = records.geojson(spark, str(tmp_path / "b.json"), "id:string").select("id", "geometry_type", records.bounds_of(records.points_of(F.col("coordinates"))).alias("b")).first()
    assert (row["id"], row["geometry_type"], tuple(row["b"])) == ("x", "LineString", (1.0, -4.0, 3.5, 2.0))


def test_numbered_files_and_archive(spark, tmp_path):
    for n in ("001", "002"):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"k": int(n)}]))
    (tmp_path / "notes.json").write_text("[]")
    assert {(r["chunk"], r["k"]) for r in records.numbered(spark, str(tmp_path), "struct<k:int>").collect()} == {(1, 1), (2, 2)}
    import hashlib

    right = hashlib.sha256((tmp_path / "001.json").read_bytes()).hexdigest()
    wrong = records.archive(spark, str(tmp_path), {"001.json": (right, (tmp_path / "001.json").stat().st_size), "002.json": (right, 1), "gone.json": (right, 1)})
    assert {r["key"] for r in wrong.collect()} == {"002.json", "gone.json"}


def test_shapefile(spark, tmp_path):
    field = struct.pack("<11sc4xB15x", b"NAME", b"C", 10) + struct.pack("<11sc4xB15x", b"ID", b"N", 4)
    body = b"".join(b" " + n.encode().ljust(10) + str(i).rjust(4).encode() for i, n in enumerate(["Hall", "Hé"[:1] + "all2"]))
    (tmp_path / "P.dbf").write_bytes(b"\x03" + bytes(3) + struct.pack("<IHH", 2, 32 + len(field) + 1, 15) + bytes(20) + field + b"\r" + body)
    shape = b"".join(struct.pack(">II", i + 1, 10) + struct.pack("<Idd", 1, 10.0 + i, 20.0) for i in range(2))
    (tmp_path / "P.shp").write_bytes(bytes(100) + shape)
    rows = records.shapefile(spark, str(tmp_path), ["NAME", "ID"]).orderBy("pos").collect()
    assert [(r["x"], r["y"], r["NAME"], r["ID"]) for r in rows] == [(10.0, 20.0, "Hall", "0"), (11.0, 20.0, "Hall2", "1")]
    df = spark.createDataFrame([(" ", "v")], "a string, B string")
    assert df.select(records.alias_field(df, "A", "b", "c")).first()[0] == "v"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 1.5, 2.0, 1), (2, None, 3.0, 4.0, 2)], "id int, name string, x double, y double, chunk int")
    lines = [json.loads(r["value"]) for r in sinks.feature_lines(df, F.col("x"), F.col("y"), ["id", "name"], "id").collect()]
    assert lines[1] == {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "Point", "coordinates": [3.0, 4.0]}}
    sinks.write_chunks(df, str(tmp_path / "c"), "chunk")
    saved = spark.read.schema(df.schema).json(str(tmp_path / "c"))
    assert sinks.drift(df, saved).count() == 0 and sinks.drift(df.where("id = 1"), saved).count() == 1
    assert sinks.markdown_rows(df, ["id", "name"]).first()["value"] == "| 1 | a\\|b |"


def test_feeds(spark, tmp_path):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    fetched = spark.createDataFrame([(1, "v", "ok"), (2, None, "failed")], "k long, v string, status string")
    assert {r["k"] for r in feeds.still_to_fetch(wanted, fetched, "k").collect()} == {2, 3}
    cache = spark.createDataFrame([(2, "old"), (3, "older")], "k long, v string")
    assert {(r["k"], r["v"], r["source"]) for r in feeds.with_fallback(fetched, cache, "k", "v").collect()} == {(1, "v", "fresh"), (2, "old", "cache"), (3, "older", "cache")}
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, t long, v string").write.parquet(str(source))
    stream = spark.readStream.schema("k long, t long, v string").parquet(str(source))
    for _ in range(2):  # a second run finds nothing new
        feeds.keep_latest(stream, str(tmp_path / "out"), "k", "t", str(tmp_path / "cp")).awaitTermination()
    assert {(r["k"], r["v"]) for r in feeds.latest(spark.read.parquet(str(tmp_path / "out")), "k", "t").collect()} == {(1, "b"), (2, "c")}


def test_shapefile_parts_and_deleted_rows(spark, tmp_path):
    field = struct.pack("<11sc4xB15x", b"NAME", b"C", 4)
    table = lambda rows: b"\x03" + bytes(3) + struct.pack("<IHH", len(rows), 65, 5) + bytes(20) + field + b"\r" + b"".join(rows)
    line = struct.pack("<I32xII2I", 3, 2, 4, 0, 2) + struct.pack("<8d", *range(8))
    many = struct.pack("<I32xI4d16x2d16x2d", 18, 2, 1, 2, 3, 4, 5, 6, -1e39, 7)
    bodies = [struct.pack("<Idd", 1, 9, 9), line, many, struct.pack("<I4d", 11, 1, 2, 3, 4)]
    (tmp_path / "R.shp").write_bytes(bytes(100) + b"".join(struct.pack(">II", i, len(b) // 2) + b for i, b in enumerate(bodies)))
    (tmp_path / "R.dbf").write_bytes(table([b"*gone", b" road", b" many", b" top "]))
    rows = records.shapefile(spark, str(tmp_path), ["NAME"]).orderBy("pos").collect()
    got = [(r["NAME"], r["x"], r["z"], r["m"], r["parts"] and [[tuple(v) for v in part] for part in r["parts"]]) for r in rows]
    assert got == [
        ("road", None, None, None, [[(0, 1, None, None), (2, 3, None, None)], [(4, 5, None, None), (6, 7, None, None)]]),
        ("many", None, None, None, [[(1, 2, 5, None), (3, 4, 6, 7)]]),
        ("top", 1, 3, 4, None),
    ]
    (tmp_path / "R.dbf").write_bytes(table([b" road"]))
    try:
        records.shapefile(spark, str(tmp_path), ["NAME"]).collect()
    except Exception as e:
        assert "argument" in str(e)
    else:
        raise AssertionError("surplus shapes were cut off")


def test_plain_pages_need_no_parser(monkeypatch):
    """Plain markup is read without the parser and alike; anything else is still parsed."""
    rng = random.Random(3)
    plain = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", '<th rowspan="2">', '<TD COLSPAN="3" class="x">', '<td colspan="2" rowspan=" 2 ">', "</th>", "a", " b  c\n", "<br>", "</p>", "</LI>", '<a href="/x?1">', '<a href="">', "</a>", '<img src="q" alt="r">', "<tr>", "<td>", "x"]
    odd = ["&amp;", "&", "<", "<!-- <td> -->", "<script>", "</script>", "<br/>", "<td", "<img src=w>", "<title>", "</title>", '<td a="<">', '</td x="1">', "<td rowspan>", "<3"]
    pages = ["".join(rng.choice(plain + (odd if i % 3 == 0 else [])) for _ in range(rng.randrange(25))) for i in range(3000)]
    fast = [html.grid(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(html, "_plain_cells", lambda page: None)
        assert fast == [html.grid(p) for p in pages]
    monkeypatch.setattr(html, "_Cells", None)
    assert [html.grid(p) for p in pages[1::3]] == fast[1::3]


def test_pages_of_contracts_are_plain(spark, sf_dir):
    from placewright.plans import scans

    pages, _ = scans._order_pages(spark, sf_dir)
    assert all(html._plain_cells(r["page"]) is not None for r in pages.select("page").collect())
