"""Candidates for one place in two inventories, landmarks and official listings.

Every index that can bring two of them together adds rows to one stream of evidence: equal names, names that stand in one another within
a kilometre, shared sources, old doors on roads with one modern name. Each is an equi-join
on a key that spreads (a name, a door block, a cell with a gram), with names that many have dealt to several tasks. The stream is folded by
pair; neighbours without evidence are pairs too, told as such. Equal addresses and door ranges that overlap make pairs with the square of the
tables, so they are found between distinct addresses and become pairs of places last, a block of places at a time. What speaks against a pair is listed as hazards, every pair gets
one of four classes, and strong pairs that compete with others are demoted.

Defined results: an id that is null takes no part; repeated rows count once; a place without a point has no distance and meets others by
keys only; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions import address, geo, text
from placewright.operators.checkpoints import written
from placewright.operators.relational import dealt_join, in_blocks, spread
from placewright.operators.spatial import cube, cubes_around, within_metres

# Distances in whole metres.
NEIGHBOURS, CLOSE, APART, NAMED_WITHIN = 35, 180, 250, 1000
# Roles of names that don't prove a historical identity.
CURRENT_ROLE, LISTED_ROLES = "current-name", ("official-listed-name", "wikipedia-listed-name", "map-location-title")
# Hosts and pages that are sources of every listing.
COMMON_SOURCES = r"fgj\.sh\.gov\.cn|上海市优秀历史建筑"
# What was found out about a landmark's present use, and matches that were made without review.
RELOCATED, REDEVELOPED = "institutional-successor-relocated", "site-redeveloped"
SITE_ONLY = ("same-site-continuing-use", "same-site-repurposed", "partial-remains-on-original-site")
AUTOMATIC = ("historical-name-and-location", "historical-name-and-list-record")
# Words of campuses, complexes and parts of buildings.
COMPLEX = "大学|校园|校区|建筑群|[弄坊邨村]|住宅群|[号栋幢]楼|[东南西北红灰]楼|主楼|教学楼|门楼|步高里"
INSTITUTION = "中学|大学|学院|医院|学校|公学|学堂|女中|厂|码头"
# Hazards that keep a pair from being strong.
NOT_STRONG = (
    "campus-complex-or-component-scope", "landmark-polygon-reference-only", "relocated-institution-modern-information", "official-demolished-flag", "multi-source-landmark-site",
    "persistent-current-use-hold", "reviewed-pair-conflict", "same-site-rebuilt-not-same-building", "existing-research-proves-site-scope-only",
)
#: Door numbers in a block: ranges meet by equal blocks.
DOORS = 8
#: Places of one set of addresses, with what else is the same for them, and how many of them are one array.
OF_SET = {"landmark": ["landmark_addresses"], "listing": ["listing_addresses", "_other", "_placed"]}
BLOCK = 1000
PAIR = ["landmark", "listing", "class", "distance", "hazards", "n_names", "n_addresses", "n_sources", "evidence"]
EVIDENCE = ["landmark", "listing", "kind", "match", "landmark_value", "listing_value", "landmark_role", "listing_role"]


def place_names(names: DataFrame, key: str) -> DataFrame:
    """``key, value, role, norm``: every spelling of every name (key, name, role) that says which place."""
    each = spread(names.where(F.col(key).isNotNull()), key).select(key, "role", F.explode(text.place_variants(F.col("name"))).alias("value"))
    return each.withColumn("norm", text.place_key(F.col("value"))).where(text.names_a_place(F.col("norm"))).distinct()


def _evidence(df: DataFrame, kind: str, match: str | Column, landmark: str | Column, listing: str | Column, roles: bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    text_of = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        "landmark", "listing", F.lit(kind).alias("kind"), (F.lit(match) if isinstance(match, str) else match).alias("match"), text_of(landmark).alias("landmark_value"), text_of(listing).alias("listing_value"),
        (F.col("landmark_role") if roles else none).alias("landmark_role"), (F.col("listing_role") if roles else none).alias("listing_role"))


def rounded(lon: Column, lat: Column, olon: Column, olat: Column) -> Column:
    """Distances are compared in whole metres."""
    return F.round(geo.haversine(lon, lat, olon, olat)).cast("long")


def equal_names(landmark_names: DataFrame, listing_names: DataFrame) -> DataFrame:
    own = landmark_names.select("landmark", "norm", F.col("value").alias("landmark_value"), F.col("role").alias("landmark_role"))
    other = listing_names.select("listing", "norm", F.col("value").alias("listing_value"), F.col("role").alias("listing_role"))
    return _evidence(dealt_join(own, other, ["norm"], "landmark", wide=True), "name", "normalized-exact", "landmark_value", "listing_value", True)


def names_in_names(landmark_names: DataFrame, listing_names: DataFrame, landmarks: DataFrame, listings: DataFrame, ratio: float = 0.48) -> DataFrame:
    """Names of four characters and more (the landmark's with Chinese ones) that stand in one another, within a kilometre. The shorter one asks with
    one of its grams in the cubes around it, the longer one holds all of its grams in its own."""
    size, reach = 4, NAMED_WITHIN + 0.5
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))
    one = lambda c: F.array_min(F.transform(grams(c), lambda g: F.named_struct(F.lit("h"), F.xxhash64(g), F.lit("g"), g)))["g"]

    def side(names: DataFrame, points: DataFrame, key: str, more: Column) -> DataFrame:
        own = names.where((F.length("norm") >= size) & more).join(points.select(key, "lon", "lat").hint("merge"), key).where("lon IS NOT NULL AND lat IS NOT NULL")
        return spread(own, key).select(key, *[F.col(c).alias(f"{key}_{c}") for c in ("norm", "value", "role", "lon", "lat")])

    a = side(landmark_names, landmarks, "landmark", F.col("norm").rlike(r"[㐀-鿿]"))
    b = side(listing_names, listings, "listing", F.lit(True))
    found = None
    for short, long, s, l in ((a, b, "landmark", "listing"), (b, a, "listing", "landmark")):
        asks = short.withColumns({"_g": one(F.col(f"{s}_norm")), "_c": F.explode(cubes_around(F.col(f"{s}_lon"), F.col(f"{s}_lat"), reach))})
        holds = long.withColumns({"_g": F.explode(grams(F.col(f"{l}_norm"))), "_c": cube(F.col(f"{l}_lon"), F.col(f"{l}_lat"), reach)})
        n, m = F.col(f"{s}_norm"), F.col(f"{l}_norm")
        met = asks.join(holds.hint("merge"), ["_g", "_c"]).where((n != m) & F.contains(m, n) & (F.length(n) / F.length(m) >= ratio))
        met = met.where(rounded(*[F.col(f"{x}_{c}") for x in ("landmark", "listing") for c in ("lon", "lat")]) <= NAMED_WITHIN)
        own = _evidence(met, "name", "distinctive-substring-review", "landmark_value", "listing_value", True)
        found = own if found is None else found.unionByName(own)
    return found


def _address_key(c: str) -> Column:
    return F.nullif(address.chinese_key(F.col(c)), F.lit(""))


def _door_blocks(df: DataFrame, key: str, asked: Column, block: int = DOORS) -> DataFrame:
    """Every door range of an address with the blocks of numbers that it touches. Whatever is asked of an address is read here, once for each address,
    however many rows have it."""
    own = df.where(F.col(key).isNotNull()).select(key, "address", asked.alias("_asked")).distinct()
    texts = own.select("address", "_asked").distinct()
    each = spread(texts, "address", "_asked").select("address", "_asked", _address_key("address").alias(f"{key}_key"), F.explode(address.doors(F.col("_asked"))).alias(f"{key}_door"))
    d = F.col(f"{key}_door")
    each = each.where(d["road"].isNotNull() & (d["low"] <= d["high"])).withColumns({"road": d["road"], "lane": d["lane"], "_b": F.explode(F.sequence(F.floor(d["low"] / block), F.floor(d["high"] / block)))}).distinct()
    return dealt_join(own, each, ["address", "_asked"], key, wide=True).drop("_asked").withColumnRenamed("address", f"{key}_value")


def doors_in_common(own: DataFrame, other: DataFrame, *near: str) -> DataFrame:
    """``landmark, listing`` and what both sides carry where door ranges overlap: equal road and block of numbers (and ``near``), then the ranges
    themselves. Two doors meet once, in the block where their overlap starts."""
    a, b = F.col("landmark_door"), F.col("listing_door")
    met = dealt_join(own, other, ["road", "lane", "_b", *near], "landmark", per=1000, wide=True).where((F.col("_b") == F.floor(F.greatest(a["low"], b["low"]) / DOORS)) & address.doors_meet(a, b))
    return met.drop("road", "lane", "_b", "landmark_door", "listing_door", *near)


def address_sets(df: DataFrame, key: str) -> DataFrame:
    """``key`` and ``{key}_addresses``, all of its addresses in order: what it has in common with others turns on them only."""
    own = df.where(F.col(key).isNotNull() & F.col("address").isNotNull())
    return own.groupBy(key).agg(F.sort_array(F.collect_set("address")).alias(f"{key}_addresses"))  # a place's own


def meeting_addresses(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``landmark_addresses, listing_addresses, _said``: sets of addresses (of ``address_sets``) that have something in common, with the evidence. Equal addresses
    are read and compared once, so this grows with addresses that differ and not with the places that have them."""
    sides = []
    for df, key in ((mine, "landmark"), (theirs, "listing")):
        sets = df.select(f"{key}_addresses").distinct()
        sides.append(written(sets.withColumn(key, F.explode(f"{key}_addresses")).withColumn("address", F.col(key)), "addresses"))
    a, b = (side.select(key, "address").distinct() for side, key in zip(sides, ("landmark", "listing"), strict=True))
    keyed = lambda df, key: spread(df, key).select(key, F.col("address").alias(f"{key}_value"), _address_key("address").alias("_k")).where("_k IS NOT NULL")
    full = _evidence(dealt_join(keyed(a, "landmark"), keyed(b, "listing"), ["_k"], "landmark", per=1000, wide=True), "address", "full-normalized-current-address", "landmark_value", "listing_value")
    met = doors_in_common(written(_door_blocks(a, "landmark", F.col("address")), "doors"), written(_door_blocks(b, "listing", F.col("address")), "doors"))
    ranges = _evidence(met.where(~F.col("landmark_key").eqNullSafe(F.col("listing_key"))), "address", "road-door-range-overlap-review", "landmark_value", "listing_value")
    found = full.unionByName(ranges)
    for side, key in zip(sides, ("landmark", "listing"), strict=True):
        found = found.join(side.select(key, f"{key}_addresses").hint("merge"), key)
    return found.groupBy("landmark_addresses", "listing_addresses").agg(F.sort_array(F.collect_set(F.struct(*EVIDENCE[2:]))).alias("_said"))


def old_address_evidence(old: DataFrame, listed: DataFrame, landmarks: DataFrame, listings: DataFrame) -> DataFrame:
    """From ``old`` (landmark, address, number, roads: modern names of its road) and ``listed`` (listing, address): old numbers meet listings in the cubes around
    them only. Nothing is read from an address after the joins."""
    blocks = _door_blocks(listed, "listing", F.col("address"))
    asked = old.where((F.size("roads") == 1) & F.col("number").rlike(r"(?i)^\d+[a-z]?(-\d+[a-z]?)?$"))
    asks = _door_blocks(asked, "landmark", F.concat(F.get("roads", 0), F.col("number"), F.lit("号"))).join(landmarks.where("lon IS NOT NULL AND lat IS NOT NULL").select("landmark", "lon", "lat").hint("merge"), "landmark")
    here = blocks.join(listings.where("lon IS NOT NULL AND lat IS NOT NULL").select("listing", F.col("lon").alias("olon"), F.col("lat").alias("olat")).hint("merge"), "listing")
    reach = CLOSE + 0.5
    asks = asks.withColumn("_c", F.explode(cubes_around(F.col("lon"), F.col("lat"), reach)))
    hinted = doors_in_common(written(asks, "doors"), written(here.withColumn("_c", cube(F.col("olon"), F.col("olat"), reach)), "doors"), "_c")
    near = hinted.where(rounded(*map(F.col, ("lon", "lat", "olon", "olat"))) <= CLOSE)
    return _evidence(near, "address", "old-road-name-and-number-coincidence-only", "landmark_value", "listing_value")


def source_evidence(own: DataFrame, other: DataFrame) -> DataFrame:
    """From ``own`` (landmark, url) and ``other`` (listing, url): one page on both, but for pages on everything."""
    mine = spread(own, "landmark").select("landmark", F.col("url").alias("landmark_value"), F.regexp_replace(text.url_key(F.col("url")), "/$", "").alias("_k")).where("landmark IS NOT NULL")
    theirs = spread(other, "listing").select("listing", F.regexp_replace(text.url_key(F.col("url")), "/$", "").alias("_k")).where(F.col("listing").isNotNull() & ~F.col("_k").rlike(COMMON_SOURCES)).distinct()
    return _evidence(dealt_join(mine, theirs, ["_k"], "landmark", wide=True), "source", "shared-source", "landmark_value", "landmark_value")


def folded(evidence: DataFrame, neighbours: DataFrame, told: DataFrame) -> DataFrame:
    """``landmark, listing, _found, _seen, _conflict``: one row for each pair with its evidence as a set, whether anything but a conflict brings it, and
    whether ``told`` has it."""
    stream = evidence.select("landmark", "listing", F.struct(*EVIDENCE[2:]).alias("_e"), F.lit(True).alias("_seen"))
    stream = stream.unionByName(neighbours.select("landmark", "listing", F.lit(True).alias("_seen")), allowMissingColumns=True).withColumn("_told", F.lit(False))
    stream = stream.unionByName(told.select("landmark", "listing", F.lit(False).alias("_seen"), F.lit(True).alias("_told")), allowMissingColumns=True)
    return stream.groupBy("landmark", "listing").agg(F.sort_array(F.collect_set("_e")).alias("_found"), F.bool_or("_seen").alias("_seen"), F.bool_or("_told").alias("_conflict"))  # as many as the two have names, old addresses and sources in common


def weighed(pairs: DataFrame) -> DataFrame:
    """``pairs`` with what classification asks of their evidence."""
    named = F.filter("evidence", lambda e: e["kind"] == "name")
    exact = lambda e: e["match"] == "normalized-exact"
    return pairs.withColumns({
        "n_names": F.size(named), "n_addresses": F.size(F.filter("evidence", lambda e: e["kind"] == "address")), "n_sources": F.size(F.filter("evidence", lambda e: e["kind"] == "source")),
        "exact": F.exists(named, exact), "historical": F.exists(named, lambda e: exact(e) & (e["landmark_role"] != CURRENT_ROLE) & ~e["listing_role"].isin(*LISTED_ROLES)),
        "current_only": (F.size(named) > 0) & ~F.exists(named, lambda e: e["landmark_role"] != CURRENT_ROLE)})


def landmark_signs(landmarks: DataFrame) -> DataFrame:
    """``landmark, lon, lat, _signs``: the hazards that a landmark bears whatever it meets."""
    relation = lambda *names: F.arrays_overlap(F.coalesce("relations", F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    automatic = F.arrays_overlap(F.coalesce("matches", F.array().cast("array<string>")), F.array(*map(F.lit, AUTOMATIC)))
    signs = {"method": F.col("method") != "source-point", "relocated": relation(RELOCATED), "redeveloped": relation(REDEVELOPED), "site_only": relation(*SITE_ONLY), "several": F.size("members") > 1, "held": F.col("held"), "automatic": automatic}
    return landmarks.where("landmark IS NOT NULL").select("landmark", "lon", "lat", F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in signs.items()]).alias("_own")).distinct()


def listing_signs(listings: DataFrame) -> DataFrame:
    """``listing, olon, olat, _other, _placed``: the hazards that a listing bears whatever it meets, and whether it has a point."""
    complex_site = (F.col("components") > 1) | F.concat_ws(" ", "title", "address").rlike(COMPLEX) | F.col("title").rlike(INSTITUTION)
    signs = {"complex": complex_site, "demolished": F.col("demolished")}
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    own = spread(listings, "listing").where("listing IS NOT NULL")
    return own.select("listing", F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in signs.items()]).alias("_other"), placed.alias("_placed")).distinct()


def hazards(conflict: Column, apart: Column) -> Column:
    """What speaks against a pair, in a fixed order; ``apart`` says whether the two are too far from each other."""
    own, other = F.col("_own"), F.col("_other")
    no_evidence = (F.col("n_names") == 0) & (F.col("n_addresses") == 0) & (F.col("n_sources") == 0)
    # The names of the hazards.
    rules = [
        ("heritage-has-no-coordinate", ~F.col("_placed")), ("landmark-polygon-reference-only", own["method"]), ("relocated-institution-modern-information", own["relocated"]),
        ("same-site-rebuilt-not-same-building", own["redeveloped"]), ("existing-research-proves-site-scope-only", own["site_only"]), ("multi-source-landmark-site", own["several"]),
        ("campus-complex-or-component-scope", other["complex"]), ("persistent-current-use-hold", own["held"]), ("existing-current-name-only-not-identity-proof", F.col("current_only")),
        ("legacy-automatic-current-use-does-not-prove-identity", own["automatic"]), ("reviewed-pair-conflict", conflict),
        ("coordinate-separation-over-250m", apart), ("official-demolished-flag", other["demolished"]), ("distance-only-do-not-merge", no_evidence),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]))


def candidates(landmarks: DataFrame, listings: DataFrame, landmark_names: DataFrame, listing_names: DataFrame, current: DataFrame, old: DataFrame, listed: DataFrame, landmark_urls: DataFrame, listing_urls: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``landmark, listing, class, distance, hazards, evidence`` and counts of every pair that any evidence or nearness brings together.

    ``landmarks``: landmark, lon, lat, method, relations, matches, members (arrays), held. ``listings``: listing, lon, lat, title, address, components
    (a number), demolished. Names have key, name, role; URLs key, url; addresses as in ``old_address_evidence``. ``conflicts`` (member, listing): pairs
    that a review found to be different. Classes: ``strong-one-to-one``, ``name-match-location-conflict``, ``complex-site-review``, ``insufficient-evidence``."""
    own, other = written(place_names(landmark_names, "landmark"), "names"), written(place_names(listing_names, "listing"), "names")
    found = equal_names(own, other).unionByName(names_in_names(own, other, landmarks, listings))
    found = found.unionByName(old_address_evidence(old, listed, landmarks, listings)).unionByName(source_evidence(landmark_urls, listing_urls))
    points = lambda df, key, to: df.where(F.col(key).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, F.col("lon").alias(to[0]), F.col("lat").alias(to[1]))
    near = within_metres(spread(points(landmarks, "landmark", ("lon", "lat")), "landmark"), points(listings, "listing", ("olon", "olat")).hint("merge"), NEIGHBOURS + 0.5)
    near = near.where(F.round("distance") <= NEIGHBOURS)
    told = landmarks.select("landmark", F.explode("members").alias("member")).join(conflicts.hint("merge"), "member").select("landmark", "listing").distinct()
    mine, theirs = written(address_sets(current, "landmark"), "sets"), written(address_sets(listed, "listing"), "sets")
    met = written(meeting_addresses(mine, theirs), "met")
    ends = {
        "landmark": written(in_blocks(landmark_signs(landmarks).join(mine.hint("merge"), "landmark", "left"), OF_SET["landmark"], "landmark", BLOCK, "_i"), "ends"),
        "listing": written(in_blocks(listing_signs(listings).join(theirs.hint("merge"), "listing", "left"), OF_SET["listing"], "listing", BLOCK, "_j"), "ends")}
    known = written(folded(found, near, told).join(ends["landmark"].hint("merge"), "landmark").join(ends["listing"].hint("merge"), "listing"), "pairs")
    addressed = F.col("landmark_addresses").isNotNull() & F.col("listing_addresses").isNotNull()
    pairs = dealt_join(known.where(addressed), met, ["landmark_addresses", "listing_addresses"], "landmark", how="left", wide=True).unionByName(known.where(~addressed), allowMissingColumns=True)
    pairs = written(pairs.where(F.col("_seen") | F.col("_said").isNotNull()), "known")
    judged = weighed(pairs.withColumns({"evidence": F.when(F.col("_said").isNull(), F.col("_found")).otherwise(F.sort_array(F.array_union("_found", "_said"))), "distance": rounded(*map(F.col, ("lon", "lat", "olon", "olat")))}))
    judged = judged.withColumn("hazards", hazards(F.col("_conflict"), F.col("distance") > APART))
    some = (F.col("n_names") > 0) | (F.col("n_addresses") > 0) | (F.col("n_sources") > 0)
    strong = F.col("historical") & (F.col("distance") <= CLOSE) & ~F.arrays_overlap("hazards", F.array(*map(F.lit, NOT_STRONG)))
    kind = F.when(F.col("exact") & (F.col("distance") > APART), "name-match-location-conflict").when(strong, "strong-one-to-one").when(some, "complex-site-review").otherwise("insufficient-evidence")
    judged = demoted(written(judged.withColumn("class", kind), "classified")).select(*PAIR)
    return judged.unionByName(by_address_only(met, ends, pairs.where("_said IS NOT NULL")))


def by_address_only(met: DataFrame, ends: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """Pairs that nothing but their addresses brings together: all places of two sets of addresses that meet, without those that are ``known`` by more. There are as
    many as places share addresses, with the square of the tables, so no pair is shuffled, sorted or written: blocks of places meet as
    arrays, and whatever is the same for a landmark and a block of listings is told before the pairs are made."""
    mine, theirs = [*OF_SET["landmark"], "_i"], [*OF_SET["listing"], "_j"]
    gathered = lambda end, keys, to, *values: written(ends[end].where(F.col(f"{end}_addresses").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*values))).alias(to)), "blocks")
    own, other = gathered("landmark", mine, "_ls", "landmark", "lon", "lat", "_own"), gathered("listing", theirs, "_hs", "listing", "olon", "olat")
    left_out = known.groupBy(*mine, *theirs).agg(F.collect_set(F.struct("landmark", "listing")).alias("_skip"))  # a block's at most
    blocks = met.join(own.select(*mine).hint("merge"), "landmark_addresses").join(other.select(*theirs).hint("merge"), "listing_addresses").join(left_out.hint("merge"), [*mine, *theirs], "left")
    blocks = blocks.join(own.hint("merge"), mine).withColumn("_by", F.xxhash64(*mine))
    both = dealt_join(blocks, other, theirs, "_by", per=16, wide=True)
    said = {"evidence": F.col("_said"), "n_names": F.lit(0), "n_addresses": F.size("_said"), "n_sources": F.lit(0), "current_only": F.lit(False), "class": F.lit("complex-site-review")}
    each = both.select("_said", "_other", "_placed", "_skip", "_hs", F.inline("_ls")).withColumns(said)
    each = each.withColumns({"_near": hazards(F.lit(False), F.lit(False)), "_far": hazards(F.lit(False), F.lit(True)), "_skip": F.transform(F.filter("_skip", lambda p: p["landmark"] == F.col("landmark")), lambda p: p["listing"])})
    pairs = each.select("*", F.inline("_hs")).where(F.col("_skip").isNull() | (F.size("_skip") == 0) | ~F.array_contains("_skip", F.col("listing")))
    pairs = pairs.withColumn("distance", rounded(*map(F.col, ("lon", "lat", "olon", "olat"))))
    return pairs.withColumn("hazards", F.when(F.col("distance") > APART, F.col("_far")).otherwise(F.col("_near"))).select(*PAIR)


def demoted(pairs: DataFrame) -> DataFrame:
    """Strong pairs with a rival on either side are for review: several strong ones first, then any close pair of equal names. Rivals are
    counted once for each end, so no pair is compared with another."""
    strong, close = F.count_if(F.col("class") == "strong-one-to-one"), F.count_if(F.col("exact") & (F.col("distance") <= CLOSE))
    for end in ("landmark", "listing"):
        rivals = pairs.groupBy(end).agg(strong.alias(f"_strong_{end}"), close.alias(f"_close_{end}")).where(f"_strong_{end} > 0")
        pairs = pairs.join(rivals.hint("merge"), end, "left")
    is_strong = F.col("class") == "strong-one-to-one"
    several = is_strong & ((F.col("_strong_landmark") > 1) | (F.col("_strong_listing") > 1))
    rivalled = is_strong & ~several & ((F.col("_close_landmark") > 1) | (F.col("_close_listing") > 1))
    more = F.when(several, F.array(F.lit("multiple-strong-pairs"))).when(rivalled, F.array(F.lit("nearby-competing-exact-name-pair"))).otherwise(F.array().cast("array<string>"))
    return pairs.withColumns({"hazards": F.concat("hazards", F.coalesce(more, F.array().cast("array<string>"))), "class": F.when(several | rivalled, "complex-site-review").otherwise(F.col("class"))})
