"""Scans of one text by position: parts outside brackets, and what stands around a hit."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.functions.text import SIMPLIFIED, TRADITIONAL


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once; inside lambdas Spark would work it out again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def top_level_parts(c: Column, separators: str = "、,，;；/", opening: str = "(（", closing: str = ")）") -> Column:
    """Parts of a text between separators that stand in no bracket, without empty ones.

    Any opening sign pairs with any closing one. A closing sign too many closes nothing; what follows a bracket that is never closed is
    one part. Null gives null, an empty text no part. The fold goes over marks and the runs between them, not over characters."""
    marks = "".join(re.escape(x) for x in separators + opening + closing)
    tokens = F.regexp_extract_all(c, F.lit(f"[{marks}]|[^{marks}]+"), F.lit(0))

    def step(seen: Column, token: Column) -> Column:
        depth = F.when(token.isin(*opening), seen["depth"] + 1).when(token.isin(*closing), F.greatest(seen["depth"] - 1, F.lit(0))).otherwise(seen["depth"])
        cut = (seen["depth"] == 0) & token.isin(*separators)
        return F.struct(depth.alias("depth"), (seen["at"] + 1).alias("at"), F.when(cut, F.array_append(seen["cuts"], seen["at"])).otherwise(seen["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), F.array(F.lit(0)).alias("cuts"))

    def parts(tokens: Column) -> Column:
        def between(cuts: Column) -> Column:
            return F.transform(cuts, lambda cut, i: F.array_join(F.slice(tokens, cut + 1, F.coalesce(F.get(cuts, i + 1), F.size(tokens) + 1) - cut - 1), ""))

        return F.filter(once(F.aggregate(tokens, start, step, lambda seen: seen["cuts"]), between), lambda p: p != "")

    return once(tokens, parts)


def around(c: Column, hit: Column, reach: int) -> Column:
    """The first place of ``hit`` with up to ``reach`` characters on either side; null where it isn't found or is empty."""
    at = F.instr(c, hit)
    before = F.least(at - 1, F.lit(reach))
    return F.when((at > 0) & (hit != ""), F.substring(c, at - before, before + F.length(hit) + F.lit(reach)))


def evidence(asked: Column, names: Column, description: Column, cues: str, reach: int = 45, least: int = 3) -> Column:
    """What speaks for a record as the answer to a name: ``exact`` (one of its names), ``partial`` (a name holds the other, names asked
    of ``least`` characters and more), ``relation`` (a pattern of ``cues`` within ``reach`` characters of the name's first place in the
    description), or null. Names are compared without white space; blank and null names say nothing."""
    tight = lambda x: F.regexp_replace(x, r"\s+", "")

    def told(own: Column) -> Column:
        return (
            F.when(own["asked"] == "", None)
            .when(F.exists(own["names"], lambda n: n == own["asked"]), "exact")
            .when((F.length(own["asked"]) >= least) & F.exists(own["names"], lambda n: F.contains(n, own["asked"]) | F.contains(own["asked"], n)), "partial")
            .when(around(own["description"], own["asked"], reach).rlike(cues), "relation")
        )

    known = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), tight), lambda n: n != "")
    return once(F.struct(tight(asked).alias("asked"), known.alias("names"), description.alias("description")), told)


def search_queries(names: Column, generic: Sequence[str] = (), script: str = "[㐀-鿿]", most: int = 3) -> Column:
    """The first ``most`` names to ask a catalogue for: those with a letter of ``script``, simplified, with blanks for brackets, dots and
    strokes, of two characters and more, and not generic; without repeats (which count among the ``most``)."""
    clean = lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.translate(n, TRADITIONAL, SIMPLIFIED), "[（）()·/]", " "), r"\s+", " "))
    wanted = F.transform(F.filter(names, lambda n: n.rlike(script)), clean)
    kept = F.filter(wanted, lambda n: (F.length(n) >= 2) & (~n.isin(*generic) if generic else F.lit(True)))
    return F.array_distinct(F.slice(kept, 1, most))
