"""What reviews decided, put together: links between inventories, parts of a review, merged sources and planned changes. Each gives
its result and its violations (``rule, key, detail``) as tables; a caller that has to stop enforces the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.operators.checkpoints import written
from placewright.operators.relational import field_diff
from placewright.operators.validate import _told, all_of

# Relations that an accepted link may state, and the one that is no identity.
RELATIONS = ("same-listed-building", "same-listed-complex", "same-listed-structure", "same-historical-site", "component-of-listed-complex", "nearby-residential-context", "nearby-campus-context")
NEARBY = "nearby-residential-context"
# Sources that a card shows anyway.
SHOWN_ANYWAY = r"virtualshanghai\.net|fgj\.sh\.gov\.cn/yxlsjz/"


def _by_key(items: Column, key) -> Column:
    """Structs of an array, each key once: at its first place, with its last value."""
    keys = F.array_distinct(F.transform(items, key))
    return F.transform(keys, lambda k: F.element_at(F.filter(items, lambda x: key(x).eqNullSafe(k)), -1))


def final_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last decision on each candidate (by ``seq``), and violations: later ones that don't name the decision and reason before them, first ones that
    claim to replace something."""
    w = Window.partitionBy("candidate").orderBy("seq")
    seen = decisions.withColumns({"_d": F.lag("decision").over(w), "_r": F.lag("reason").over(w), "_n": F.row_number().over(w), "_last": F.lead("seq").over(w).isNull()})
    named = F.col("replaces_decision").eqNullSafe(F.col("_d")) & F.col("replaces_reason").eqNullSafe(F.col("_r"))
    wrong = F.when((F.col("_n") > 1) & ~named, "supersedes-unnamed").when((F.col("_n") == 1) & (F.col("replaces_decision").isNotNull() | F.col("replaces_reason").isNotNull()), "supersedes-nothing")
    told = seen.withColumn("_w", wrong).where("_w IS NOT NULL")
    return seen.where("_last").drop("_d", "_r", "_n", "_last"), told.select(F.col("_w").alias("rule"), F.col("candidate").cast("string").alias("key"), F.col("seq").cast("string").alias("detail"))


def accepted_links(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted decisions with their candidates, and everything that forbids a link. All guards look at the whole set at once: an endpoint that two
    links share is a conflict, whichever is read first, unless a complete card holds them."""
    last, wrong = final_decisions(decisions)
    yes = written(last.where(F.col("decision").startswith("accept-")).join(candidates.withColumnsRenamed({"listing": "_listing", "members": "_members"}), "candidate", "left"), "accepted")
    ids = lambda c: F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))))
    n = F.count("*")
    card = yes.groupBy("listing").agg(n.alias("_n"), F.bool_and(F.coalesce(F.col("card_group") == F.col("listing"), F.lit(False))).alias("_all"), F.count_if("card_primary").alias("_first"))
    group = yes.where("heritage_group IS NOT NULL").groupBy("heritage_group").agg(n.alias("_gn"), F.count_distinct("landmark").alias("_gl"), F.min("landmark").alias("_gm"), F.count_if("heritage_primary").alias("_gfirst"), F.count_distinct("listing").alias("_go"), F.count_distinct("relation").alias("_gr"))
    per_landmark = yes.groupBy("landmark").agg(n.alias("_ln"))
    own = yes.join(card, "listing", "left").join(group, "heritage_group", "left").join(per_landmark, "landmark", "left")
    shared = F.coalesce((F.col("_n") > 1) & F.col("_all") & (F.col("_first") == 1), F.lit(False))
    listed = F.coalesce((F.col("_gn") > 1) & (F.col("_gl") == 1) & (F.col("_gm") == F.col("heritage_group")) & (F.col("_gfirst") == 1) & (F.col("_go") == F.col("_gn")) & (F.col("_gr") == 1), F.lit(False))
    rules = [
        ("not-in-the-audit", F.col("_listing").isNull()), ("membership-differs", F.col("_listing").isNotNull() & ((F.col("_listing") != F.col("listing")) | (ids(F.col("_members")) != ids(F.col("members"))))),
        ("unresolved-point-or-scope", F.col("_listing").isNotNull() & (~F.coalesce("has_point", F.lit(False)) | ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)))),
        ("incomplete-shared-card", F.col("card_group").isNotNull() & ~shared), ("incomplete-multi-listing-card", F.col("heritage_group").isNotNull() & ~listed),
        ("competing-identity", ((F.col("_n") > 1) & ~shared) | ((F.col("_ln") > 1) & ~listed)),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))
    told = own.select("candidate", F.explode(broken).alias("rule")).select("rule", F.col("candidate").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    return yes, wrong.unionByName(told)


def reviewed_links(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards (``id, listing, landmark, more_landmarks, more_listings, addresses, aliases, sources, relation, nearby``) and violations.

    ``candidates``: candidate, landmark, listing, members (array), has_point, addresses (array of member, address). ``decisions``: candidate, seq, decision,
    reason, replaces_decision, replaces_reason, listing, members, relation, card_group, card_primary, heritage_group, heritage_primary, aliases (array),
    sources (array of url, title). Conflicts are found on all links before anything is folded; then the landmarks of one listing become
    one card, and after that the listings of one landmark. A card is as large as its review made it."""
    yes, violations = accepted_links(candidates, decisions)
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    none = F.array().cast("array<struct<member:bigint,address:string>>")
    nearby = F.col("relation") == NEARBY
    addresses = F.coalesce("addresses", none)
    aliases = F.array_distinct(F.concat(texts(F.col("aliases")), F.when(nearby, F.transform(addresses, lambda a: a["address"])).otherwise(F.array().cast("array<string>"))))
    shown = F.filter(F.coalesce("sources", F.array().cast("array<struct<url:string,title:string>>")), lambda s: ~s["url"].rlike(SHOWN_ANYWAY))
    single = yes.select("candidate", "seq", "listing", "landmark", "relation", "card_group", "card_primary", "heritage_group", "heritage_primary", nearby.alias("nearby"), addresses.alias("addresses"), aliases.alias("aliases"), _by_key(shown, lambda s: s["url"]).alias("sources"))

    def folded(df: DataFrame, key: str, first: Column, extra: Column, name: str) -> DataFrame:
        """The rows of a card with its primary one first and then in order; its extra ends go to ``name``."""
        rest = [c for c in df.columns if c not in (key, "addresses", "aliases", "sources", "nearby")]
        each = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((~first).alias("_p"), F.col("seq").alias("_s"), F.col("candidate").alias("_c"), F.struct(*rest).alias("own"), extra.alias("end"), "addresses", "aliases", "sources", "nearby"))).alias("_all"))
        return each.select(
            key, *[F.get("_all", 0)["own"][c].alias(c) for c in rest], F.transform(F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))), lambda x: x["end"]).alias(name), F.flatten(F.transform("_all", lambda x: x["addresses"])).alias("addresses"),
            F.array_distinct(F.flatten(F.transform("_all", lambda x: x["aliases"]))).alias("aliases"), _by_key(F.flatten(F.transform("_all", lambda x: x["sources"])), lambda s: s["url"]).alias("sources"), F.exists("_all", lambda x: x["nearby"]).alias("nearby"))

    cards = folded(single, "listing", F.coalesce("card_primary", F.lit(False)), F.col("landmark"), "more_landmarks")
    several = cards.where("heritage_group IS NOT NULL")
    wide = folded(several, "heritage_group", F.coalesce("heritage_primary", F.lit(False)), F.col("listing"), "more_listings")
    wide = wide.withColumn("addresses", _by_key(F.col("addresses"), lambda a: F.concat_ws("|", a["member"].cast("string"), a["address"])))
    both = cards.where("heritage_group IS NULL").withColumn("more_listings", F.array().cast(dict(wide.dtypes)["more_listings"])).unionByName(wide)
    return both.select(F.col("candidate").alias("id"), "listing", "landmark", "more_landmarks", "more_listings", "addresses", "aliases", "sources", "relation", "nearby"), violations


def row_digest(df: DataFrame, key: str) -> Column:
    """SHA-256 of a row but for its key: columns by name, with nulls apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != key]), {"ignoreNullFields": "false"}), 256)


def assembled(candidates: DataFrame, inputs: DataFrame, reviews: DataFrame, baseline: DataFrame, key: str, part: str = "part") -> tuple[DataFrame, DataFrame]:
    """All ``reviews`` (part, key, ...) as one table, and violations: parts must be disjoint and apart from ``baseline`` (key), every part decides exactly
    its input, and an input row equals the candidate that it was taken from. Rows are never joined: keys and digests are counted side by side, in
    one aggregation by key and part and one by key."""
    none = F.lit(None).cast("string")
    side = lambda df, name, of, digest: df.select(F.col(key).cast("string").alias("k"), of.cast("string").alias("p"), F.lit(name).alias("side"), digest.alias("digest"))
    taken = side(inputs, "input", F.col(part), row_digest(inputs.drop(part), key))
    rows = side(candidates, "candidate", none, row_digest(candidates, key)).unionByName(taken).unionByName(side(reviews, "review", F.col(part), none)).unionByName(side(baseline, "baseline", none, none))
    count = lambda s: F.count_if(F.col("side") == s)
    of = lambda s, f: f(F.when(F.col("side") == s, F.col("digest")))
    each = rows.groupBy("k", "p").agg(count("input").alias("n_input"), count("review").alias("n_review"), count("candidate").alias("n_candidate"), count("baseline").alias("n_baseline"), of("input", F.min).alias("low"), of("input", F.max).alias("high"), of("candidate", F.min).alias("c_low"), of("candidate", F.max).alias("c_high"))
    each = written(each, "counted")
    by_part = [("duplicate-input", F.col("n_input") > 1), ("duplicate-decision", F.col("n_review") > 1), ("undecided", (F.col("n_input") > 0) & (F.col("n_review") == 0)), ("unassigned-decision", (F.col("n_review") > 0) & (F.col("n_input") == 0))]
    whole = each.groupBy("k").agg(F.count_if(F.col("n_review") > 0).alias("parts"), F.sum("n_baseline").alias("n_baseline"), F.sum("n_input").alias("n_input"), F.sum("n_candidate").alias("n_candidate"), *[f(c).alias(c) for c, f in (("low", F.min), ("high", F.max), ("c_low", F.min), ("c_high", F.max))])
    drifted = (F.col("n_input") > 0) & ~((F.col("low") == F.col("high")) & F.col("low").eqNullSafe(F.col("c_low")) & F.col("high").eqNullSafe(F.col("c_high")))
    over = [("overlapping-parts", (F.col("parts") > 1) | ((F.col("parts") > 0) & (F.col("n_baseline") > 0))), ("input-drifted", drifted), ("duplicate-candidate", F.col("n_candidate") > 1)]
    told = all_of(*[_told(each.where(rule), name, "k", F.col("p")) for name, rule in by_part], *[_told(whole.where(rule), name, "k", F.lit(None)) for name, rule in over])
    return reviews, told


def merged_sources(sources: Sequence[tuple[str, DataFrame]], key: str, fields: dict[str, Sequence[tuple[str, str]]], master: str, detail: Sequence[str], required: Sequence[str] = (), expected: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each key of ``master`` that a ``detail`` source knows too, with where each field came from (``origin``: field to source), and violations.

    ``fields`` says in which order sources are asked: ``("live", "takes")`` holds wherever the source has the row, even if its value is null, and
    ``("file", "fills")`` only where it has a value. All sources meet in one aggregation by key, which counts their rows as well: duplicates, null keys, rows
    unknown to the master, pending keys, missing required fields and totals other than ``expected`` are violations. Of duplicates the least row counts."""
    rows = None
    names = list(fields)
    for name, df in sources:
        kinds = {f: next(dict(d.dtypes)[f] for _, d in sources if f in d.columns) for f in names}
        own = df.select(F.col(key).alias("_k"), F.lit(name).alias("_source"), F.struct(*[(F.col(f) if f in df.columns else F.lit(None).cast(kinds[f])).alias(f) for f in names]).alias("_v"))
        rows = own if rows is None else rows.unionByName(own)
    of = lambda s: F.col("_source") == s
    each = rows.where("_k IS NOT NULL").groupBy("_k").agg(*[F.min(F.when(of(s), F.col("_v"))).alias(f"v_{s}") for s, _ in sources], *[F.count_if(of(s)).alias(f"n_{s}") for s, _ in sources])
    each = written(each, "merged")
    known = F.lit(False)
    for s in detail:
        known = known | (F.col(f"n_{s}") > 0)
    values, origins = {}, {}
    for f, order in fields.items():
        value = origin = None
        for s, mode in order:
            ok = F.col(f"n_{s}") > 0 if mode == "takes" else F.col(f"v_{s}")[f].isNotNull()
            value, origin = (F.when(ok, F.col(f"v_{s}")[f]), F.when(ok, s)) if value is None else (value.when(ok, F.col(f"v_{s}")[f]), origin.when(ok, s))
        values[f], origins[f] = value, origin
    made = each.where((F.col(f"n_{master}") > 0) & known).select(F.col("_k").alias(key), *[v.alias(f) for f, v in values.items()], F.map_filter(F.create_map(*[x for f, o in origins.items() for x in (F.lit(f), o)]), lambda _, o: o.isNotNull()).alias("origin"))
    others = F.lit(False)
    for s in detail:
        others = others | (F.col(f"n_{s}") > 0)
    told = [_told(each.where(F.col(f"n_{s}") > 1), f"duplicate-in-{s}", "_k", F.col(f"n_{s}")) for s, _ in sources]
    told += [_told(each.where((F.col(f"n_{master}") > 0) & ~known), "pending", "_k", F.lit(None)), _told(each.where((F.col(f"n_{master}") == 0) & others), "absent-from-master", "_k", F.lit(None))]
    told += [_told(rows.where("_k IS NULL").groupBy("_source").agg(F.count("*").alias("n")), "null-key", "_source", F.col("n"))]
    told += [_told(made.where(F.col(f).isNull()), f"missing-{f}", key, F.lit(None)) for f in required]
    for s, n in (expected or {}).items():
        told.append(_told(each.agg(F.count_if(F.col(f"n_{s}") > 0).alias("n")).where(F.col("n") != n), "count", F.lit(s), F.col("n")))
    return made, all_of(*told)


def planned_changes(before: DataFrame, after: DataFrame, plans: DataFrame, key: str, fields: Sequence[str], protected: Sequence[str]) -> DataFrame:
    """Violations of a declared plan (key, field, value as text) between two versions of a table: keys that came or went, protected fields that changed, planned
    values that are not there, and changes that no plan names (of a planned record or of another)."""
    changed = field_diff(before, after, key, fields)
    plan = plans.select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.col("value").alias("_v")).distinct()
    ids = before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(key, F.lit(0).alias("b"), F.lit(1).alias("a"))).groupBy(key).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    moved = _told(ids.where("a = 0 OR b = 0"), "key-removed-or-added", key, F.when(F.col("a") == 0, "removed").otherwise("added"))
    own = changed.where("change = 'changed'").drop("change")  # only keys that both versions have bear it
    shielded = _told(own.where(F.col("field").isin(*protected)), "protected-field-changed", key, F.col("field"))
    targeted = plan.select(F.col("_k").alias(key)).distinct().withColumn("_t", F.lit(True))
    extra = own.join(plan.select(F.col("_k").alias(key), F.col("_f").alias("field")), [key, "field"], "left_anti").join(targeted, key, "left")
    extra = _told(extra.where(F.col("_t").isNotNull()), "unplanned-change", key, F.col("field")).unionByName(_told(extra.where(F.col("_t").isNull()), "untargeted-record-changed", key, F.col("field")))
    # A plan picks its field after the join by key: written out by field, the table would be sorted as many times over.
    present = after.select(F.col(key).alias("_at"), *[F.col(f).cast("string").alias(f"_now_{i}") for i, f in enumerate(fields)])
    now = F.coalesce(*[F.when(F.col("_f") == f, F.col(f"_now_{i}")) for i, f in enumerate(fields)])
    missed = plan.withColumnRenamed("_k", key).join(present, (F.col(key) == F.col("_at")) & F.col("_f").isin(*fields), "left").where(~now.eqNullSafe(F.col("_v")))
    return all_of(moved, shielded, extra, _told(missed, "plan-not-applied", key, F.col("_f")))


def kept_apart(pairs: DataFrame, members: DataFrame, member: str, group: str) -> DataFrame:
    """Violations: pairs (a, b) that a review keeps apart but that share a group."""
    side = lambda n: members.select(F.col(member).alias(n), F.col(group).alias(f"{n}_group"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_group = b_group")
    return _told(met, "kept-apart", F.concat_ws("+", F.least("a", "b"), F.greatest("a", "b")), F.col("a_group"))


def holds_kept(features: DataFrame, holds: DataFrame, group: str, member: str, cleared: Sequence[str], status: str) -> DataFrame:
    """Violations of holds (group, members: array): features of a held group that still say what was held back, whose status is not ``held``, or that the hold
    doesn't cover; and members that no feature has."""
    held = features.join(holds.select(group, F.col("members").alias("_m")), group)
    says = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in cleared]), lambda c: c.isNotNull())
    fields = _told(held.select(member, F.explode(says).alias("_c")), "hold-not-cleared", member, F.col("_c"))
    state = _told(held.where(~F.col(status).eqNullSafe("held")), "hold-status", member, F.col(status))
    uncovered = _told(held.where(~F.array_contains("_m", F.col(member))), "hold-incomplete", member, F.col(group))
    unknown = holds.select(group, F.explode("members").alias(member)).join(features.select(member), member, "left_anti")
    return all_of(fields, state, uncovered, _told(unknown, "hold-without-feature", member, F.col(group)))
