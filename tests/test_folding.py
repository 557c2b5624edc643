import random

import pytest

from placewright.operators import folding

LINK = "link string, seq int, canonical string, members array<string>, buildings array<long>, parks array<long>, current_from string, name string, name_zh string, aliases array<string>"


def feature(i, kind="landmark", buildings=None, parks=(), name=None, zh=None, aliases=(), legacy=(), urls=None, current=None, records=()):
    return (i, kind, [int(i)] if buildings is None else buildings, list(parks), name or f"n{i}", zh, None, list(aliases), f"g{i}", list(legacy), [f"s{i}"], urls or {}, current or {}, list(records))


def link(key, seq, canonical, members, buildings, parks=(), current_from=None, name=None, zh=None, aliases=None):
    return (key, seq, canonical, members, buildings, list(parks), current_from, name, zh, aliases)


def sequential(features, links):
    """The links one after the other; of each feature its id, sources and group."""
    state = {f[0]: (f[1], list(f[2]), list(f[3])) for f in features}
    told = {}
    for key, _, canonical, members, buildings, parks, *_ in sorted(links, key=lambda l: (l[1], l[0])):
        ids = list(dict.fromkeys([canonical, *(members or [])]))
        present = [i for i in ids if i in state]
        if canonical not in state:
            told[key] = "canonical-missing"
        elif any(state[i][0] != "landmark" for i in present):
            told[key] = "not-a-landmark"
        elif len(present) not in (len(ids), 1):
            told[key] = "incomplete"
        elif {b for i in present for b in state[i][1]} != set(buildings or []) or {b for i in present for b in state[i][2]} != set(parks or []):
            told[key] = "sources-differ"
        else:
            told[key] = "applied"
            state[canonical] = ("landmark", list(dict.fromkeys(b for i in present for b in state[i][1])), list(dict.fromkeys(b for i in present for b in state[i][2])))
            for i in present:
                if i != canonical:
                    del state[i]
    return {i: (tuple(b), tuple(p)) for i, (_, b, p) in state.items()}, told


def check(spark, features, links):
    after, told = folding.fold_links(spark.createDataFrame(features, folding.FEATURE), spark.createDataFrame(links, LINK))
    got = {r["id"]: (tuple(r["buildings"]), tuple(r["parks"])) for r in after.collect()}, {r["link"]: r["outcome"] for r in told.collect()}
    assert got == sequential(features, links)
    return got[1]


def test_chains_stars_and_circles(spark):
    features = [feature(str(i)) for i in range(30)] + [feature("90", kind="road")]
    chain = [link(f"c{i}", i, str(i + 1), [str(i)], list(range(i + 2))) for i in range(5)]
    star = [link(f"s{i}", 50 + i, "10", [str(11 + i)], [10, *range(11, 12 + i)]) for i in range(4)]
    circle = [link("o1", 100, "20", ["21"], [20, 21]), link("o2", 101, "21", ["22"], [21, 22]), link("o3", 102, "22", ["20"], [20, 21, 22])]
    rest = [link("r", 7, "90", ["29"], [90, 29]), link("x", 8, "28", ["77"], [28]), link("y", 8, None, ["28"], [28]), link("z", 9, "28", ["27", "78"], [28, 27]), link("w", 10, "27", None, [27])]
    told = check(spark, features, chain + star + circle + rest)
    assert [told[f"c{i}"] for i in range(5)] == ["applied"] * 5 and told["o2"] == "canonical-missing" and told["o3"] == "applied" and told["r"] == "not-a-landmark"
    assert told["x"] == "applied" and told["z"] == "incomplete" and told["w"] == "applied"


@pytest.mark.parametrize("seed", [2])
def test_random_links(spark, seed):
    rng = random.Random(seed)
    features = [feature(str(i), parks=[i] if i % 4 == 0 else []) for i in range(25)]
    links = []
    for j in range(16):
        ids = rng.sample(range(25), rng.choice([2, 2, 3]))
        links.append(link(f"l{j:02}", rng.randrange(20), str(ids[0]), [str(i) for i in ids[1:]], ids if rng.random() < 0.8 else ids[:1], [i for i in ids if i % 4 == 0]))
    told = check(spark, features, links)
    assert "applied" in told.values()


def test_what_a_merged_feature_says(spark):
    features = [
        feature("1", name="Old Hall", zh="VANISHED", aliases=["A"], legacy=["g0"], urls={"u": "1", "v": "1"}, current={"currentName": "x", "currentUse": "y"}),
        feature("2", name="New Hall", zh="新厅", aliases=["A", " ", "B"], urls={"u": "2", "w": "2"}, current={"currentName": "z"}, records=['{"r":2}']),
    ]
    after, _ = folding.fold_links(spark.createDataFrame(features, folding.FEATURE), spark.createDataFrame([link("l", 1, "1", ["2"], [2, 1], current_from="2", name="Hall", aliases=["C", "NONE"])], LINK))
    r = after.first()
    assert r["name"] == "Hall" and r["name_zh"] == "VANISHED" and r["aliases"] == ["Hall", "C", "Old Hall", "A", "New Hall", "新厅", "B"] and r["legacy"] == ["g0", "g2"]
    assert r["urls"] == {"u": "1", "v": "1", "w": "2"} and r["current"] == {"currentName": "z", "currentUse": "y"} and r["sources"] == ["s1", "s2"] and r["buildings"] == [1, 2]
    assert r["records"] == ['{"name":"Old Hall","sourceRecordIds":[1],"sourceParkRecordIds":[]}', '{"r":2}']


def test_nothing_to_fold(spark):
    after, told = folding.fold_links(spark.createDataFrame([feature("1")], folding.FEATURE), spark.createDataFrame([], LINK))
    assert after.count() == 1 and told.count() == 0
    after, told = folding.fold_links(spark.createDataFrame([], folding.FEATURE), spark.createDataFrame([link("l", 1, "1", ["2"], [1])], LINK))
    assert after.count() == 0 and told.first()["outcome"] == "canonical-missing"
