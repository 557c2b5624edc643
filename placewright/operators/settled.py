"""Reviewed decisions carried through a whole population: the status of every candidate, approved sites by what can be shown of them, lines
that verified ones replace, and classes by polygon. Violations are rows (``rule, key, detail``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.operators.overlay import classified
from placewright.operators.relational import only_once
from placewright.operators.spatial import in_polygons


def _violation(df: DataFrame, rule: str, key: str, detail: str | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), (F.col(detail).cast("string") if detail else F.lit(None).cast("string")).alias("detail"))


def review_statuses(candidates: DataFrame, decisions: DataFrame, far: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """Candidates (candidate, landmark, listing, near_only, held, located, distance, ...) with ``status``, ``selected`` and ``decided``, and
    violations.

    ``decisions`` (candidate, decision, seq): of several on one candidate the last counts. Decided ones are ``linked`` (a decision that starts with
    ``accept-``) or ``held-after-review``. The rest are, by the first that holds: ``alternative-not-proven`` where the landmark's accepted listing
    (the last by ``seq``) is another one, ``proximity-only``, ``held-current-use-or-member-scope``, ``needs-location-and-identity-review`` without a
    point, ``needs-location-or-branch-review`` beyond ``far``, else ``needs-address-or-scope-evidence``. Null flags are false, a null distance is not
    far. A decision on no candidate is a violation. Landmarks come to the candidates by an aggregate of accepted decisions, so a landmark with
    many candidates joins one row."""
    last = decisions.groupBy("candidate").agg(F.max_by("decision", "seq").alias("_decision"), F.max("seq").alias("_seq"))
    own = candidates.join(last, "candidate", "left")
    yes = F.coalesce(F.col("_decision").startswith("accept-"), F.lit(False))
    accepted = candidates.join(last, "candidate").where(yes).groupBy("landmark").agg(F.max_by("listing", F.struct("_seq", "candidate")).alias("selected"))
    told = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        (yes, "linked"), (F.col("_seq").isNotNull(), "held-after-review"), (F.coalesce(F.col("selected") != F.col("listing"), F.lit(False)), "alternative-not-proven"), (told("near_only"), "proximity-only"),
        (told("held"), "held-current-use-or-member-scope"), (~told("located"), "needs-location-and-identity-review"), (F.coalesce(F.col("distance") > far, F.lit(False)), "needs-location-or-branch-review"),
    ]
    made = classified(own.join(accepted, "landmark", "left"), rules, "needs-address-or-scope-evidence", "status").withColumn("decided", F.col("_seq").isNotNull()).drop("_decision", "_seq")
    return made, _violation(last.join(candidates.select("candidate"), "candidate", "left_anti"), "decision-without-candidate", "candidate", "_decision")


def approved_sites(approvals: DataFrame, candidates: DataFrame, located: DataFrame, contextual: DataFrame, official: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What approvals allow to be shown: links, notes on sites, violations.

    ``approvals``: row, candidate, and corrected_listing, corrected_source, which replace the candidate's listing and its sources where given.
    ``candidates``: candidate, landmark, listing, sources (array). ``located`` (listing): listings with a point. ``contextual``: row, candidate, reason,
    sources (array). ``official`` is a pattern of official addresses.

    Links: one for each landmark with located approvals (``landmark, id, listing, more_listings, relation, rows``), first by ``row``; several
    listings make a ``same-listed-complex``, one a ``same-historical-site``. Notes: ``kind`` (unlocated, contextual), ``row, candidate, landmark,
    listing, source, note, evidence``. Violations: rows twice, approvals and contextual decisions without candidate, notes without an official
    source, contextual ones without another. Wrong rows give neither link nor note."""
    given = approvals.join(candidates, "candidate", "left")
    fixed = F.col("corrected_listing").isNotNull()
    given = given.withColumns({"listing": F.coalesce("corrected_listing", "listing"), "sources": F.when(fixed, F.array("corrected_source")).otherwise(F.col("sources"))})
    twice = approvals.groupBy("row").count().where("count > 1")
    wrong = [_violation(twice, "row-twice", "row", "count"), _violation(given.where("landmark IS NULL"), "approval-without-candidate", "row", "candidate")]
    mapped = located.select("listing").distinct().withColumn("_located", F.lit(True))
    sound = given.where("landmark IS NOT NULL").join(twice, "row", "left_anti").join(mapped, "listing", "left")

    members = F.sort_array(F.collect_list(F.struct("row", "listing")))  # as many as a review approved for one landmark
    links = sound.where("_located").groupBy("landmark").agg(members.alias("_m")).select(
        "landmark", F.concat(F.lit("same-site-"), F.lower(F.get("_m", 0)["row"])).alias("id"), F.get("_m", 0)["listing"].alias("listing"), F.transform(F.slice("_m", 2, F.size("_m")), lambda m: m["listing"]).alias("more_listings"),
        F.when(F.size("_m") > 1, "same-listed-complex").otherwise("same-historical-site").alias("relation"), F.transform("_m", lambda m: m["row"]).alias("rows"))

    first = lambda sources, yes: F.get(F.filter(sources, lambda u: u.rlike(official) if yes else ~u.rlike(official)), 0)
    none = F.lit(None).cast("string")
    bare = sound.where("_located IS NULL").select(F.lit("unlocated").alias("kind"), "row", "candidate", "landmark", "listing", first(F.col("sources"), True).alias("source"), none.alias("note"), none.alias("evidence"))
    seen = contextual.withColumnRenamed("sources", "_own").join(candidates, "candidate", "left")
    wrong.append(_violation(seen.where("landmark IS NULL"), "context-without-candidate", "row", "candidate"))
    around = seen.where("landmark IS NOT NULL").select(F.lit("contextual").alias("kind"), "row", "candidate", "landmark", "listing", first(F.col("sources"), True).alias("source"), F.col("reason").alias("note"), first(F.col("_own"), False).alias("evidence"))
    notes = bare.unionByName(around)
    unsaid = F.col("source").isNull() | ((F.col("kind") == "contextual") & F.col("evidence").isNull())
    wrong.append(_violation(notes.where(unsaid), "note-without-source", "row", "kind"))
    violations = wrong[0]
    for more in wrong[1:]:
        violations = violations.unionByName(more)
    return links, notes.where(~unsaid), violations


def replaced_lines(features: DataFrame, verified: DataFrame, lines: DataFrame, replaced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features after verified lines took the place of old ones, and violations.

    ``features``: id, kind, name, modern, line, verified (from an earlier run). ``verified``: name, modern, and what else a feature carries. ``lines``: line, names
    (array). ``replaced``: names of old lines that go. All features of an earlier run go, and lines of a replaced name; each verified name gets
    every line that bears its modern name, once, numbered by ``line``. A verified name without a line, and one given twice, are violations. Null names match nothing; a
    null ``verified`` or ``kind`` keeps the feature."""
    bearing = lines.select("line", F.explode(F.array_distinct("names")).alias("modern")).where("modern IS NOT NULL")
    gone = replaced.select(F.col("name")).distinct().withColumn("_gone", F.lit(True))
    old = F.coalesce((F.col("kind") == "line") & F.col("_gone"), F.lit(False)) | F.coalesce(F.col("verified"), F.lit(False))
    kept = features.join(gone, "name", "left").where(~old).select(features.columns)
    once, twice = only_once(verified, "modern"), verified.groupBy("modern").count().where("count > 1")
    made = once.join(bearing, "modern").withColumns({"id": F.concat_ws("-", F.lit("verified"), "modern", "line"), "kind": F.lit("line"), "verified": F.lit(True)}).select(features.columns)
    missing = _violation(verified.join(bearing, "modern", "left_anti"), "no-line-of-this-name", "modern", "name")
    return kept.unionByName(made), missing.unionByName(_violation(twice, "verified-twice", "modern", "count"))


def reclassified(points: DataFrame, edges: DataFrame, curated: DataFrame, inside: str, outside: str, band: float) -> DataFrame:
    """``points`` (id, x, y, class) with the class that a boundary gives them, and ``changed``: those inside it or in ``curated`` (id) are ``inside``; others
    that were ``inside`` become ``outside``, the rest stay. A point of unknown place is outside. ``edges``: polygon, x1, y1, x2, y2."""
    within = in_polygons(points.select("id", "x", "y"), edges, band).select("id").unionByName(curated.select("id")).distinct().withColumn("_in", F.lit(True))
    new = F.when(F.col("_in"), inside).when(F.col("class") == inside, outside).otherwise(F.col("class"))
    return points.join(within, "id", "left").withColumn("changed", ~new.eqNullSafe(F.col("class"))).withColumn("class", new).drop("_in")
