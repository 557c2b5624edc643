"""Scans by position against plain loops, and tables under contracts with every fault."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placewright.functions import address, scan
from placewright.sources import contracts, html


def parts(text):
    out, depth, part = [], 0, ""
    for c in text:
        depth = depth + 1 if c in "(（" else max(0, depth - 1) if c in ")）" else depth
        if depth == 0 and c in "、,，;；/":
            out, part = out + [part], ""
        else:
            part += c
    return [p for p in out + [part] if p]


def test_top_level_parts(spark):
    texts = ["", ",", "a,b", "a(b,c(d,e),f),g", "a(b,c", "a),b(,)c", "（x、y)、z", "路1号(甲、乙(丙,丁)),弄2号", "\U0001F600,b" * 50, "((((,", "))),"]

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text("ab(),/（）、", max_size=30), min_size=60, max_size=60))
    def run(more):
        df = spark.createDataFrame([(t,) for t in texts + more], "t string")
        assert all(r["p"] == parts(r["t"]) for r in df.select("t", scan.top_level_parts(F.col("t")).alias("p")).collect())

    run()
    assert spark.range(1).select(scan.top_level_parts(F.lit(None).cast("string"))).first()[0] is None


def test_nested_brackets_hold_a_street_together(spark):
    got = spark.range(1).select(address.components(F.lit("南京路1号(甲(乙)、丙),北京路2号"))).first()[0]
    assert len(got) == 2 and got[1].endswith("北京路2号")


def told(asked, names, description, cues="原|曾名", reach=45):
    asked = re.sub(r"\s+", "", asked)
    names = [x for n in names if n and (x := re.sub(r"\s+", "", n))]
    if not asked:
        return None
    if asked in names:
        return "exact"
    if len(asked) >= 3 and any(asked in n or n in asked for n in names):
        return "partial"
    at = (description or "").find(asked)
    return "relation" if at >= 0 and re.search(cues, description[max(0, at - reach):at + len(asked) + reach]) else None


def test_evidence(spark):
    rows = [
        ("外滩 花园", ["外滩花园"], ""), ("花园", ["外滩花园"], "x"), ("大花园", ["大花园饭店", None], None), ("大花园饭店", ["花园"], ""), ("旧名", [" "], "原址" + "x" * 43 + "旧名"),
        ("旧名", [], "原址" + "x" * 44 + "旧名"), ("旧名", [], "原址" + "x" * 45 + "旧名"), ("旧名", [], "旧名" + "x" * 44 + "原"), ("旧名", [], "旧名" + "x" * 45 + "原"), (" ", ["a"], "原"), ("旧名", None, "旧名" * 30 + "原"),
    ]
    df = spark.createDataFrame(rows, "a string, n array<string>, d string")
    got = [r[0] for r in df.select(scan.evidence(F.col("a"), F.col("n"), F.col("d"), "原|曾名")).collect()]
    assert got == [told(a, n or [], d) for a, n, d in rows] and {"exact", "partial", "relation", None} == set(got)


def test_search_queries(spark):
    names = ["Club", "復興(大)楼", "复兴 大 楼", "复兴（大）楼", "银行", None, "甲", "新园"]
    got = spark.createDataFrame([(names,)], "n array<string>").select(scan.search_queries(F.col("n"), ["银行"])).first()[0]
    assert got == ["复兴 大 楼"]  # repeats count among the three


LIST = {"one": [("Code", "code"), ("Name", "name"), ("Photo", "photo")]}


def page(rows, head="<th>Co de</th><th colspan=2>Name</th><th>Photo</th>"):
    return f"<table><tr>{head}</tr>{''.join(f'<tr>{r}</tr>' for r in rows)}</table>"


def test_tables_under_contract(spark):
    full = '<td rowspan=2>A1</td><td><a href="/x">x</a></td><td>y</td><td><img src="p.png"></td>'
    pages = [
        (1, page([full, '<td>z</td><td>z</td><td><a href="/w">w</a></td>', "<td>B2</td><td>q</td><td>q</td>"])),  # the last lacks a cell that is known to be missing
        (2, page(["<td>B2</td><td>q</td><td>q</td>"])), (3, page(["<td> </td><td>a</td><td>b</td><td>c</td>"])), (4, page(["<td rowspan=3>A</td><td>a</td><td>b</td><td>c</td>"])),
        (5, page([full], "<th>Code</th><th>Name</th><th>Photo</th>")), (6, page([full], "<th>Code</th><th>Names</th><th>Photo</th>")), (7, page(["<td>A</td><td>a</td><td>b</td><td>c</td>", ""])),
        (8, page(["<td>A</td><td>a</td><td rowspan=2>b</td><td>c</td>", "<td colspan=3>B</td>"])), (9, page(["<td>A</td><td>a</td><td>b</td><td>c</td><td>d</td>"])), (10, page([full], "<th rowspan=2>Code</th><th colspan=2>Name</th><th>Photo</th>")),
        (11, page([full, "<td>z</td><td>z</td><td>w</td>"])), (12, None), (13, "no table"), (14, page([full, "<td>z</td><td>z</td><td>w</td>"]) + page(["<td>C</td><td>a</td><td></td><td>c</td>"])),
    ]
    df = spark.createDataFrame(pages, "id long, html string")
    batches = spark.createDataFrame([(i, t, None if i == 11 else "one") for i in range(1, 15) for t in (0, 1)], "id long, table int, batch string")
    omitted = spark.createDataFrame([(1, 0, 3, "B2"), (3, 0, 1, "x")], "id long, table int, row int, id_ string")
    cells = html.table_cells(df.withColumnRenamed("id", "page"), "page", "html")
    rows = contracts.contract_rows(cells, "page", batches.withColumnRenamed("id", "page"), LIST, omitted.withColumnsRenamed({"id": "page", "id_": "id"})).cache()
    assert {(r["page"], r["row"], r["fault"]) for r in contracts.violations(rows, "page").collect()} == {
        (2, 1, "incomplete-row"), (3, 1, "no-identifier"), (4, 0, "span-beyond-table"), (5, 0, "span-beyond-table"), (6, 0, "unexpected-headers"), (7, 0, "row-without-cells"), (8, 0, "overlapping-cells"), (9, 1, "incomplete-row"), (10, 0, "spanning-header"), (11, 0, "no-contract"),
    }
    made = {(r["page"], r["table"], r["row"]): r for r in contracts.records(rows, "page").collect()}
    assert set(made) == {(1, 0, 1), (1, 0, 3), (14, 0, 1), (14, 1, 1)}
    a = made[1, 0, 1]
    assert a["fields"] == {"code": "A1", "name": "x y", "photo": ""} and a["components"] == [{"code": "A1", "name": "z", "photo": "w"}] and a["rows"] == [1, 2] and a["notes"] == []
    assert {(x["role"], x["url"]) for x in a["links"]} == {("name", "/x"), ("photo", "/w")} and [(x["role"], x["url"]) for x in a["images"]] == [("photo", "p.png")]
    assert made[1, 0, 3]["fields"] == {"code": "B2", "name": "q"} and made[1, 0, 3]["notes"] == ["cells-left-out"] and made[14, 1, 1]["fields"]["name"] == "a"
    nothing = contracts.contract_rows(cells.limit(0), "page", batches.withColumnRenamed("id", "page"), LIST)
    assert contracts.records(nothing, "page").count() == contracts.violations(nothing, "page").count() == 0


def test_tables_meet_their_contract_in_one_shuffle(spark):
    """A table stays one row until it is judged: pages give what gathered cells give, and nothing is shuffled but the joins' sides."""
    page = lambda k, body: (k, f"<table><tr><th>Code</th><th>Line</th></tr>{body}</table>")
    pages = spark.createDataFrame([page(1, '<tr><td rowspan="2">a</td><td>1</td></tr><tr><td>2<a href="/x">x</a></td></tr><tr><td>b</td></tr>'), page(2, '<tr><td rowspan="3">a</td><td>1</td></tr>'), page(3, "<tr><td>a</td><td>1</td></tr>"), page(None, "<tr><td></td></tr>"), (5, None)], "k int, page string")
    batches = spark.createDataFrame([(1, 0, "A"), (2, 0, "A"), (3, 0, "Z"), (5, 0, "A")], "k int, `table` int, batch string")
    omitted = spark.createDataFrame([(1, 0, 3, "b"), (2, 0, 1, None)], "k int, `table` int, `row` int, id string")
    own = {"A": [("Code", "id"), ("Line", "line")]}
    straight = contracts.contract_tables(html.page_tables(pages, "k", "page"), "k", batches, own, omitted)
    gathered = contracts.contract_rows(html.table_cells(pages, "k", "page"), "k", batches, own, omitted)
    told = lambda rows: sorted(str(r) for r in rows.collect())
    assert told(straight) == told(gathered)
    assert sorted(map(str, (tuple(r) for r in contracts.violations(straight, "k").collect()))) == ["(2, 0, 0, 'span-beyond-table')", "(3, 0, 0, 'no-contract')", "(None, 0, 0, 'no-contract')"]
    assert sorted((r["k"], r["row"], r["rows"], r["notes"]) for r in contracts.records(straight, "k").collect()) == [(1, 1, [1, 2], []), (1, 3, [3], ["cells-left-out"])]
    plan = contracts.violations(straight, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1
