"""Reviewed site links, applied in their order.

A link folds member features into a canonical one, and its guards look at what earlier links have left. So links are a sequential program; but
two links without a common feature can't see each other. Each round applies every link that is the first of those left for all of its
features: unrelated links run together, and only chains cost rounds, as many as the longest one has links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions import text
from placewright.operators.checkpoints import discard, written

LANDMARK = "landmark"
FEATURE = "id string, kind string, buildings array<bigint>, parks array<bigint>, name string, name_zh string, chinese string, aliases array<string>, grp string, legacy array<string>, sources array<string>, urls map<string,string>, current map<string,string>, records array<string>"


def _set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))))


def _each(field: str) -> Column:
    """A field's arrays of all present features, one after the other."""
    kind = "array<bigint>" if field in ("buildings", "parks") else "array<string>"
    return F.flatten(F.transform("present", lambda m: F.coalesce(m[field], F.array().cast(kind))))


def _over(low: Column, high: Column) -> Column:
    """Two maps; the second one's keys hold."""
    a, b = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (low, high))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def _own_record(m: Column) -> Column:
    """What a feature without records of its own says as one."""
    name_zh = F.when(~F.coalesce(text.is_placeholder(m["name_zh"]), F.lit(False)) & (F.trim(m["name_zh"]) != ""), m["name_zh"])
    return F.array(F.to_json(F.struct(m["name"].alias("name"), name_zh.alias("nameZh"), m["buildings"].alias("sourceRecordIds"), m["parks"].alias("sourceParkRecordIds"))))


def outcome(row: Column | None = None) -> Column:
    """Why a link is not applied, or ``applied``: from ``ids``, ``present`` (the features there are, in the order of ids), ``want_buildings``, ``want_parks``."""
    first = F.get("present", 0)
    return (
        F.when(first.isNull() | ~first["id"].eqNullSafe(F.get("ids", 0)), "canonical-missing").when(F.exists("present", lambda m: F.coalesce(m["kind"] != LANDMARK, F.lit(True))), "not-a-landmark")
        .when((F.size("present") != F.size("ids")) & (F.size("present") != 1), "incomplete")
        .when((_set(_each("buildings")) != _set(F.col("want_buildings"))) | (_set(_each("parks")) != _set(F.col("want_parks"))), "sources-differ").otherwise("applied"))


def merged() -> dict[str, Column]:
    """The canonical feature's fields after its link."""
    p = F.get("present", 0)
    chosen = F.get(F.filter("present", lambda m: m["id"] == F.col("current_from")), 0)["current"]
    names = F.flatten(F.transform("present", lambda m: F.concat(F.array(m["name"], m["name_zh"], m["chinese"]), F.coalesce(m["aliases"], F.array().cast("array<string>")))))
    aliases = F.concat(F.array("link_name", "link_name_zh"), F.coalesce("link_aliases", F.array().cast("array<string>")), names)
    records = F.flatten(F.transform("present", lambda m: F.when(F.size(m["records"]) > 0, m["records"]).otherwise(_own_record(m))))
    legacy = F.flatten(F.transform("present", lambda m: F.concat(F.array(m["grp"]), F.coalesce(m["legacy"], F.array().cast("array<string>")))))
    return {
        "id": p["id"], "kind": p["kind"], "buildings": F.array_distinct(_each("buildings")), "parks": F.array_distinct(_each("parks")), "name": F.coalesce("link_name", p["name"]), "name_zh": F.coalesce("link_name_zh", p["name_zh"]),
        "chinese": F.coalesce("link_name_zh", p["chinese"]), "aliases": F.array_distinct(F.filter(aliases, lambda a: F.coalesce((F.trim(a) != "") & ~text.is_placeholder(a), F.lit(False)))), "grp": p["grp"],
        "legacy": F.array_distinct(F.filter(legacy, lambda g: g.isNotNull() & ~g.eqNullSafe(p["grp"]))), "sources": F.array_distinct(_each("sources")),
        "urls": F.reduce("present", F.create_map().cast("map<string,string>"), lambda a, m: _over(m["urls"], a)), "current": _over(p["current"], chosen), "records": F.array_distinct(records),
    }


def fold_links(features: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``features`` (the columns of FEATURE; ids are unique) after ``links``, and what became of each link (``link, outcome``).

    ``links``: link, seq, canonical, members (array), buildings and parks (arrays of the sources that must be there), current_from, name, name_zh,
    aliases. Links of one ``seq`` go by ``link``. A link without a canonical id is ``canonical-missing``; features that no link names pass through."""
    fields = [f.split()[0] for f in FEATURE.split(", ")]
    ids = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("members", F.array().cast("array<string>"))))
    left = written(links.select("link", "seq", ids.alias("ids"), F.col("buildings").alias("want_buildings"), F.col("parks").alias("want_parks"), "current_from", F.col("name").alias("link_name"), F.col("name_zh").alias("link_name_zh"), F.col("aliases").alias("link_aliases")), "links")
    named = written(left.select(F.explode("ids").alias("id")).distinct(), "named")
    own = features.select(*fields)
    state, untouched = written(own.join(named, "id", "left_semi"), "state"), own.join(named, "id", "left_anti")
    told = None
    while left.limit(1).count():
        at = left.select("link", F.struct("seq", "link").alias("turn"), F.posexplode_outer("ids").alias("_at", "id"))
        first = at.groupBy("id").agg(F.min("turn").alias("first"))
        ready = at.join(first, "id", "left").groupBy("link").agg(F.bool_and(F.coalesce(F.col("turn") == F.col("first"), F.lit(True))).alias("_ready")).where("_ready").select("link")
        asked = at.join(ready, "link").join(state.select("id", F.struct(*fields).alias("_f")), "id", "left").groupBy("link").agg(F.array_sort(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("_at", "_f"))), lambda a, b: a["_at"] - b["_at"]).alias("_p"))
        met = asked.join(left, "link").withColumn("present", F.transform("_p", lambda p: p["_f"])).withColumn("outcome", outcome())
        done = written(met.select("link", "ids", "outcome", F.when(F.col("outcome") == "applied", F.struct(*[c.alias(n) for n, c in merged().items()])).alias("_m")), "round")
        gone = done.where("outcome = 'applied'").select(F.explode("ids").alias("id"))
        before = state, left
        state = written(state.join(gone, "id", "left_anti").unionByName(done.where("outcome = 'applied'").select("_m.*")), "state")
        told = done.select("link", "outcome") if told is None else told.unionByName(done.select("link", "outcome"))
        left = written(left.join(done.select("link"), "link", "left_anti"), "links")
        for table in before:
            discard(table)
    return untouched.unionByName(state), told if told is not None else left.select("link", F.lit("").alias("outcome"))
