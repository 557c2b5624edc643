"""Enrichment: crosswalks between listings, scopes of articles, and library places matched to listed addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import address, geo, text

# District codes of the fifth batch and letters of the earlier numbering.
DISTRICT_LETTERS = {"HP": "A", "XH": "D", "CN": "M", "JA": "B", "PT": "N", "ZB": "H", "HK": "F", "YP": "G", "BS": "K", "JD": "S", "PD": "W", "JS": "Y", "SJ": "P", "QP": "X", "FX": "Z", "CM": "R"}
OLD_LETTERS = {"O": "W", "P": "J", "Q": "K"}
# Endings of titles that name a building, or a body that may have used one.
BUILDING_TITLE = "(?:大楼|楼旧址|公寓|住宅|别墅|旧居|故居|公馆|礼拜堂|教堂|清真寺|会堂|教会堂|天主堂|礼堂|会馆|新村|里弄|小区|广场|仓库|书店|戏院|剧院|影剧院|电影院|饭店|旅馆|大酒店|宾馆|邮局|捕房|监狱|桥|塔|墓|祠|庙|堂)$"
BODY_TITLE = "(?:大学|学院|中学|小学|幼儿园|学校|银行|报社|公司|事务所|研究所|研究院|医院|总局|分局|教会|俱乐部)$"
BUILDING_TYPE = r"\b(?:building|house|apartment|residence|villa|mansion|church|cathedral|temple|mosque|synagogue|cinema|theatre|theater|hotel|palace|warehouse|bridge|cemetery)\b"
# Where a library's point may lie (low and high longitude, then latitude), and what says it stands for a whole site.
LIBRARY_BOX = (120.7, 122.3, 30.6, 32.0)
SITE_CLASSES = ("lane", "number-range", "multiple-streets", "multiple-numbers", "descriptive-area", "intersection", "sub-building")
SITE_WORDS = "弄|学校|中学|大学|校园|花园|新村|公园|码头|厂"
GENERIC_USES = "^(?:住宅|民宅|民居|待考|建筑|办公楼|学校|居民楼|多单位使用|综合办公楼|商场)$"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), lambda k, _: k == key)), 0)


def official_code(batch: Column, raw: Column) -> Column:
    """The official code that a listing's code of its batch stands for; null where there is none."""
    old = F.translate(raw, "Ⅲ", "#")
    old = F.replace(old, F.lit("#"), F.lit("III"))
    letter, number = F.regexp_extract(old, r"^([A-Z])-III-(\d+)$", 1), F.regexp_extract(old, r"^([A-Z])-III-(\d+)$", 2).try_cast("int")
    padded = lambda prefix, n: F.concat(prefix, F.lpad(n.cast("string"), 3, "0"))
    second = F.when(letter == "E", F.when(number.between(1, 3), padded(F.lit("2A"), number + 55))).when(number.isNotNull(), padded(F.concat(F.lit("2"), letter), number))
    third = F.when(letter == "D", F.when(number.between(49, 83), padded(F.lit("3D"), number - 48))).when(number.isNotNull(), padded(F.concat(F.lit("3"), F.coalesce(_lookup(OLD_LETTERS, letter), letter)), number))
    fourth = F.when(raw == "4H008", "4H007").when(raw.rlike(r"^4[A-Z]\d{3}$"), raw)
    district = _lookup(DISTRICT_LETTERS, F.regexp_extract(raw, r"^([A-Z]{2})-J-(\d{3})-V$", 1))
    fifth = F.concat(F.lit("5"), district, F.regexp_extract(raw, r"^([A-Z]{2})-J-(\d{3})-V$", 2))
    return F.when(batch == 2, second).when(batch == 3, third).when(batch == 4, fourth).when(batch == 5, fifth)


def article_scope(title: Column, is_missing: Column, is_person: Column, types: Column, override: Column | None = None) -> Column:
    """What an article speaks of, told carefully: reviewed scopes first, bodies are no buildings, and doubt stays doubt."""
    name = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*", ""))
    building = name.rlike(BUILDING_TITLE)
    own = F.when(F.coalesce(is_missing, F.lit(False)), "uncertain").when(name.rlike(BODY_TITLE) & ~building, "organization").when(F.coalesce(is_person, F.lit(False)), "person")
    own = own.when(building | F.coalesce(F.lower(types).rlike(BUILDING_TYPE), F.lit(False)), "building-reference").otherwise("uncertain")
    return F.coalesce(override, own) if override is not None else own


def names_agree(uses: Column, candidate: Column) -> Column:
    """Whether a listed name or use names the candidate: equal, or one in the other from four letters on."""
    key = lambda c: F.regexp_replace(address.chinese_key(c), r"[\p{P}\s]", "")
    own = F.filter(F.transform(F.split(F.coalesce(uses, F.lit("")), "[、，,/；;]"), key), lambda n: (F.length(n) >= 3) & ~n.rlike(GENERIC_USES))
    other = key(candidate)
    return F.exists(own, lambda n: (n == other) | ((F.least(F.length(n), F.length(other)) >= 4) & (F.contains(n, other) | F.contains(other, n))))


def match_library(targets: DataFrame, library: DataFrame, overrides: DataFrame, holds: DataFrame) -> DataFrame:
    """``id, method, status, uri, lon, lat, scope`` of every target.

    ``targets``: id, official, listed (another list's address), uses, address_class, siblings (listings at one address).
    ``library``: uri, name, address, lon, lat (BD-09). ``overrides``: id, uri. ``holds``: uri, reason.
    Reviewed places come first, then the whole official address, then the other list's where a name or a door range
    corroborates it (an override that names no place, or several, is ``invalid-override``): three equi-joins, of which each target keeps the first that finds anything. Several places at one
    address are told apart by name; if they all have one point, that is taken for the whole site."""
    own = targets.withColumns({"official_key": F.nullif(address.chinese_key(F.col("official")), F.lit("")), "listed_key": F.nullif(address.chinese_key(F.col("listed")), F.lit(""))})
    places = library.withColumn("place_key", F.nullif(address.chinese_key(F.col("address")), F.lit("")))
    way = lambda keys, on, rank, method: keys.join(places, on).withColumns({"rank": F.lit(rank), "method": F.lit(method)})
    reviewed = way(own.join(overrides.withColumnRenamed("uri", "reviewed_uri"), "id"), F.col("reviewed_uri") == F.col("uri"), 0, "reviewed-name-and-address").drop("reviewed_uri")
    # A reviewed place is the only one asked, and there must be exactly one; anything else is told and gets no point.
    invalid = overrides.select("id").distinct().join(reviewed.groupBy("id").agg(F.count("*").alias("_n")), "id", "left").where(F.coalesce("_n", F.lit(0)) != 1).select("id", F.lit(True).alias("_invalid"))
    own = own.join(overrides.select("id").distinct(), "id", "left_anti")
    official = way(own, F.col("official_key") == F.col("place_key"), 1, "official-full-address")
    listed = way(own, F.col("listed_key") == F.col("place_key"), 2, "wikipedia-full-address-with-corroboration")
    met = reviewed.unionByName(official).unionByName(listed)
    each = Window.partitionBy("id")
    met = met.withColumn("best", F.min("rank").over(each)).where("rank = best").join(holds.select("uri", F.lit(True).alias("held")), "uri", "left")
    met = met.withColumns({"named": names_agree(F.col("uses"), F.col("name")), "overlaps": address.overlap(F.col("official"), F.col("address"))})
    told = met.withColumns({
        "n": F.count("*").over(each), "n_named": F.count_if("named").over(each), "points": F.size(F.collect_set(F.struct("lon", "lat")).over(each)),
        "any_held": F.coalesce(F.max("held").over(each), F.lit(False)), "backed": F.max(F.col("named") | F.col("overlaps")).over(each)})
    told = told.where("NOT (n > 1 AND n_named = 1) OR named")
    one = told.withColumn("r", F.row_number().over(each.orderBy("uri"))).where("r = 1")
    shared = (F.col("n") > 1) & (F.col("n_named") != 1)
    inside = F.coalesce(F.col("lon").between(*LIBRARY_BOX[:2]) & F.col("lat").between(*LIBRARY_BOX[2:]), F.lit(False))
    review = F.col("any_held") | ((F.col("best") == 2) & ~F.col("backed")) | (shared & (F.col("points") > 1)) | ~inside
    lon, lat = geo.bd09_to_wgs84(F.col("lon"), F.col("lat"))
    site = shared | F.col("address_class").isin(*SITE_CLASSES) | F.concat_ws(" ", "address", "name").rlike(SITE_WORDS) | (F.size("siblings") > 1)
    found = one.select(
        "id", "method", F.when(review, "needs-review").otherwise("accepted-reference-point").alias("status"), F.when(~review, F.col("uri")).alias("uri"),
        F.when(~review, lon).alias("lon"), F.when(~review, lat).alias("lat"), F.when(~review, F.when(site, "building-complex-reference-point").otherwise("address-reference-point")).alias("scope"))
    told = targets.select("id").join(found.join(invalid, "id", "left_anti"), "id", "left").join(invalid, "id", "left")
    return told.withColumn("status", F.when(F.col("_invalid"), "invalid-override").otherwise(F.coalesce("status", F.lit("unmatched")))).drop("_invalid")


def address_plan(listings: DataFrame) -> DataFrame:
    """``id, key, class, siblings``: what kind of address each listing (id, official) has, and who shares it."""
    keyed = listings.withColumns({"key": F.nullif(address.chinese_key(F.col("official")), F.lit("")), "class": address.address_class(F.col("official"), F.size(address.components(F.col("official"))))})
    shared = keyed.where("key IS NOT NULL").groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("siblings"))
    return keyed.join(shared, "key", "left").select("id", "key", "class", F.coalesce("siblings", F.array("id")).alias("siblings"))


def road_audit(records: DataFrame, roads: DataFrame) -> DataFrame:
    """``id, expression, status``: every road expression of every record (id, address), known (to ``roads``: name), questionable or unknown; records
    without any are told too."""
    own = records.select("id", F.explode_outer(address.expressions(F.col("address"))).alias("expression"))
    known = roads.select(text.words(F.col("name")).alias("_k")).distinct().withColumn("_known", F.lit(True))
    joined = own.withColumn("_k", text.words(F.col("expression"))).join(known, "_k", "left")
    status = F.when(F.col("expression").isNull(), "no-expression").when(F.col("_known"), "known").when(F.col("expression").rlike(r"(^|[\s/])\?\?(\s|$)"), "deferred").otherwise("unknown")
    return joined.select("id", "expression", status.alias("status"))
