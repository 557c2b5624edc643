from pyspark.sql import functions as F

from placewright.operators import reviewed

CANDIDATE = "candidate int, landmark string, listing string, members array<long>, has_point boolean, addresses array<struct<member:bigint,address:string>>"
DECISION = "candidate int, seq int, decision string, reason string, replaces_decision string, replaces_reason string, listing string, members array<long>, relation string, card_group string, card_primary boolean, heritage_group string, heritage_primary boolean, aliases array<string>, sources array<struct<url:string,title:string>>"


def candidate(c, landmark, listing, members=(1,), point=True, addresses=None):
    return (c, landmark, listing, list(members), point, addresses)


def decision(c, listing, seq=1, decision="accept-a", reason="r", was=(None, None), members=(1,), relation="same-listed-building", card=None, primary=None, group=None, first=None, aliases=None, sources=None):
    return (c, seq, decision, reason, *was, listing, list(members), relation, card, primary, group, first, aliases, sources)


def run(spark, candidates, decisions):
    cards, wrong = reviewed.reviewed_links(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(decisions, DECISION))
    return {r["id"]: r for r in cards.collect()}, sorted((r["rule"], r["key"]) for r in wrong.collect())


def test_cards_of_both_kinds(spark):
    candidates = [candidate(1, "a", "H", addresses=[(1, "x"), (1, "x")]), candidate(2, "b", "H", addresses=[(2, "y")]), candidate(3, "c", "I"), candidate(4, "c", "J", addresses=[(3, "z")]), candidate(5, "d", "K")]
    decisions = [
        decision(1, "H", card="H", primary=False, aliases=["n"], sources=[("u", "one"), ("v", "two")]), decision(2, "H", card="H", primary=True, relation="nearby-residential-context", aliases=["m"], sources=[("u", "last"), ("https://fgj.sh.gov.cn/yxlsjz/1", "no")]),
        decision(3, "I", group="c", first=True), decision(4, "J", group="c", first=False, aliases=["q"]), decision(5, "K", seq=1, decision="reject", reason="no"), decision(5, "K", seq=2, was=("reject", "no")),
    ]
    cards, wrong = run(spark, candidates, decisions)
    assert wrong == [] and set(cards) == {2, 3, 5}
    assert cards[2]["landmark"] == "b" and cards[2]["more_landmarks"] == ["a"] and cards[2]["aliases"] == ["m", "y", "n"] and [tuple(a) for a in cards[2]["addresses"]] == [(2, "y"), (1, "x"), (1, "x")]
    assert [tuple(s) for s in cards[2]["sources"]] == [("u", "one"), ("v", "two")] and cards[2]["nearby"]
    assert cards[3]["more_listings"] == ["J"] and cards[3]["aliases"] == ["q"] and cards[5]["more_landmarks"] == []


def test_guards_see_all_links_at_once(spark):
    candidates = [candidate(1, "a", "H"), candidate(2, "a", "I"), candidate(3, "b", "J", members=[3]), candidate(4, "c", "K", point=False), candidate(6, "e", "L"), candidate(7, "f", "L")]
    decisions = [decision(1, "H"), decision(2, "I"), decision(3, "J"), decision(4, "K"), decision(5, "Z"), decision(6, "L", card="L", primary=True), decision(7, "L", card="L", primary=True), decision(8, "x", decision="reject", was=("accept-a", "r")), decision(9, "y", seq=1, decision="reject"), decision(9, "y", seq=2, decision="reject", was=("accept-a", "r"))]
    _, wrong = run(spark, candidates, decisions)
    assert wrong == sorted([
        ("competing-identity", "1"), ("competing-identity", "2"), ("membership-differs", "3"), ("unresolved-point-or-scope", "4"), ("not-in-the-audit", "5"), ("incomplete-shared-card", "6"), ("incomplete-shared-card", "7"), ("competing-identity", "6"), ("competing-identity", "7"),
        ("supersedes-nothing", "8"), ("supersedes-unnamed", "9")])


def test_no_decisions(spark):
    assert run(spark, [candidate(1, "a", "H")], []) == ({}, [])
    assert run(spark, [], [decision(1, "H")])[1] == [("not-in-the-audit", "1")]


def test_parts_against_their_inputs(spark):
    rows = [(1, "a", None), (2, "b", 1), (3, None, 2), (4, "d", 3)]
    candidates = spark.createDataFrame(rows, "id int, name string, n int")
    part = F.when(F.col("id") < 3, "x").otherwise("y")
    inputs = candidates.withColumn("part", part)
    reviews = inputs.select("id", "part")
    none = candidates.select("id").limit(0)
    run = lambda *a: sorted((r["rule"], r["key"]) for r in reviewed.assembled(*a, "id")[1].collect())
    assert run(candidates, inputs, reviews, none) == []
    drift = inputs.withColumn("name", F.coalesce("name", F.lit("")))
    assert run(candidates, drift, reviews, none) == [("input-drifted", "3")]
    assert run(candidates, inputs, reviews.where("id <> 4").unionByName(reviews.where("id = 1")), candidates.where("id = 2").select("id")) == [("duplicate-decision", "1"), ("overlapping-parts", "2"), ("undecided", "4")]
    assert run(candidates.where("id <> 2"), inputs, reviews.withColumn("part", F.when(F.col("id") == 1, "y").otherwise(F.col("part"))), none) == [("input-drifted", "2"), ("unassigned-decision", "1"), ("undecided", "1")]


def test_merging_by_field(spark):
    live = spark.createDataFrame([(1, None, "L"), (2, "l2", "L"), (3, "l3", "L"), (None, "?", "?")], "id int, name string, kind string")
    file = spark.createDataFrame([(1, "f1", 1.0), (2, "f2", None), (2, "f0", 9.0), (9, "f9", 1.0)], "id int, name string, x double")
    fields = {"name": [("live", "takes"), ("file", "fills")], "kind": [("live", "takes")], "x": [("file", "fills")]}
    made, wrong = reviewed.merged_sources([("live", live), ("file", file)], "id", fields, "live", ["file"], ["x"], {"live": 3, "file": 4})
    assert {r["id"]: (r["name"], r["kind"], r["x"], r["origin"]) for r in made.collect()} == {1: (None, "L", 1.0, {"name": "live", "kind": "live", "x": "file"}), 2: ("l2", "L", 9.0, {"name": "live", "kind": "live", "x": "file"})}
    assert sorted((r["rule"], r["key"]) for r in wrong.collect()) == [("absent-from-master", "9"), ("count", "file"), ("duplicate-in-file", "2"), ("null-key", "live"), ("pending", "3")]


def test_changes_against_a_plan(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", None), (4, "d", 1)], "id int, name string, n int")
    after = spark.createDataFrame([(1, "A", 1), (2, "b", 2), (3, "c", 5), (5, "e", 1)], "id int, name string, n int")
    plans = spark.createDataFrame([(1, "name", "A"), (2, "name", "B")], "id int, field string, value string")
    got = sorted((r["rule"], r["key"], r["detail"]) for r in reviewed.planned_changes(before, after, plans, "id", ["name", "n"], ["n"]).collect())
    assert got == [("key-removed-or-added", "4", "removed"), ("key-removed-or-added", "5", "added"), ("plan-not-applied", "2", "name"), ("protected-field-changed", "2", "n"), ("protected-field-changed", "3", "n"), ("unplanned-change", "2", "n"), ("untargeted-record-changed", "3", "n")]
    assert reviewed.planned_changes(before, before, plans.limit(0), "id", ["name", "n"], ["n"]).count() == 0


def test_planned_changes_sort_no_table_twice(spark):
    """A changed field says by itself that both versions have its key, and a plan picks its field after the join."""
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id int, name string, n int")
    after = spark.createDataFrame([(1, "c", 1), (3, "d", 2), (None, "m", 3)], "id int, name string, n int")
    plans = spark.createDataFrame([(1, "name", "c"), (1, "other", "x"), (1, "other", None), (2, "n", "2")], "id int, field string, value string")
    told = reviewed.planned_changes(before, after, plans, "id", ["name", "n"], ["n"])
    assert sorted((r["rule"], r["key"] or "", r["detail"]) for r in told.collect()) == [("key-removed-or-added", "2", "removed"), ("key-removed-or-added", "3", "added"), ("plan-not-applied", "1", "other"), ("plan-not-applied", "2", "n")]
    assert "LeftSemi" not in told._jdf.queryExecution().optimizedPlan().toString()
