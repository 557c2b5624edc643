"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line goes if an earlier line (by doc_id, then place) is at most one character edit away: equal, or with one character
put in, left out or changed. One edit in ``near_from`` characters is allowed: shorter lines go only if equal to an earlier one
(at an edit a few characters are another word or number), however long the earlier one is.

1. Equal lines are found by a 128-bit hash; only first places go on.
2. Two lines one edit apart agree in their first or in their last half. Lines that share neither half with another
   line have no partner; the few that do are *candidates*, and only their texts are fetched.
3. Candidates emit their deletion neighbourhood in two levels, as hashed keys. First the line is cut after spaces, digits
   and punctuation into pieces, and every stretch of up to two pieces is left out: one edit touches no more. What stays
   is a key with the part left out. Where lines share a key, the parts differ by one edit, so each part emits itself, itself
   without each of its characters, and, for changed characters, the same with the character's place. Lines with a
   stretch of over ``longest_piece`` characters without a space, digit or mark, and those an edit away, have their single
   characters for pieces, so their keys grow with their length and not with its square.
4. Lines with an equal variant are joined with the earliest line that has it, and the edit distance is verified on the texts.

All members of a group of equal variants are within the bound of each other or of the one undeleted line, so the
earliest one decides and no pairs are made.

Defined results: lines are separated by line feeds; blank lines (only white space) stay; null texts stay null; a document
that loses all its lines stays with an empty text; ``n_chars`` follows the text. Decisions are made on the input, not on
what is left. doc_id is the key; rows with equal doc_id are judged as one and rows without one lose nothing. Other columns are
kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.staging import staged, unused

#: After these characters a line is cut into pieces.
AFTER = r"(?<=[\s\d.,;:!?/=&_+-])"


def fingerprint(line: Column) -> list[Column]:
    return [F.xxhash64(line, F.lit(0)).alias("h1"), F.xxhash64(F.lit(1), line, F.length(line)).alias("h2")]


def halves(line: Column, n: Column) -> Column:
    """Keys that two lines of n, or of n and n + 1, characters share if they are one edit apart."""
    keys = []
    for of in (n, n - 1):  # the shorter line's length, if this is the shorter or the longer one
        half = F.floor(of / 2).cast("int")
        keys += [F.xxhash64(of, F.lit("first"), F.substring(line, F.lit(1), half)), F.xxhash64(of, F.lit("last"), F.substring(line, (n - (of - half) + 1).cast("int"), (of - half).cast("int")))]
    return F.array(*keys)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line``: all lines that are not blank."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    return own.where(F.col("doc_id").isNotNull() & F.col("line").rlike(r"\S"))


def candidates(first: DataFrame) -> DataFrame:
    """``doc_id, pos`` of the first places whose line shares a half with another line."""
    keys = first.where(F.col("keys").isNotNull()).select("doc_id", "pos", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    return keys.join(shared, "key", "left_semi").select("doc_id", "pos").distinct()


def variants(lines: DataFrame, longest_piece: int) -> DataFrame:
    """``doc_id, pos, key, kind, i`` from ``doc_id, pos, line``: the deletion neighbourhood. Kinds: ``whole`` and ``less`` meet
    where one character more is the difference, ``place`` where one character is another."""
    cut = lines.withColumn("pieces", F.split("line", AFTER))
    # An edit leaves at least half of a long piece, so both lines of a pair with a longer one are cut into characters.
    by_piece = cut.where(F.forall("pieces", lambda p: F.length(p) <= longest_piece)).withColumn("by", F.lit(0))
    by_character = cut.where(F.exists("pieces", lambda p: F.length(p) * 2 > longest_piece)).withColumns({"pieces": F.split("line", ""), "by": F.lit(1)})
    cut = by_piece.unionByName(by_character).withColumn("pieces", F.concat("pieces", F.array(F.lit(""))))
    piece = cut.select("doc_id", "pos", "by", F.size("pieces").alias("n"), F.posexplode("pieces").alias("i", "piece"))
    line = Window.partitionBy("doc_id", "pos", "by").orderBy("i")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    before, from_end = F.expr("bit_xor(xxhash64(piece, i))").over(earlier), F.expr("bit_xor(xxhash64(piece, n - i))")
    # What is after is all without what is before: a frame to the end would be added up anew for each row.
    after = from_end.over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).bitwiseXOR(F.coalesce(from_end.over(earlier), F.lit(0)))
    hashed = piece.withColumns({"before": F.coalesce(before, F.lit(0)), "after": after})
    hashed = hashed.withColumns({f"after{m}": F.coalesce(F.lead("after", m).over(line), F.lit(0)) for m in (1, 2)} | {"next": F.lead("piece").over(line)})
    left_out = F.array(
        F.struct(F.xxhash64("before", "i", "after", F.col("n") - F.col("i")).alias("rest"), F.lit("").alias("part")),
        F.struct(F.xxhash64("before", "i", "after1", F.col("n") - F.col("i") - 1).alias("rest"), F.col("piece").alias("part")),
        F.struct(F.xxhash64("before", "i", "after2", F.col("n") - F.col("i") - 2).alias("rest"), F.concat("piece", F.coalesce("next", F.lit(""))).alias("part")),
    )
    # The last piece of a line is the empty one put there; nothing is left out from it on.
    parts = hashed.select("doc_id", "pos", F.inline(F.slice(left_out, F.lit(1), F.least(F.col("n") - F.col("i"), F.lit(3)))))
    parts = staged(parts, "parts")
    again = parts.groupBy("rest").agg(F.count("*").alias("c")).where("c > 1").select("rest")
    same_rest = parts.join(again, "rest", "left_semi")
    without = lambda p, j: F.concat(F.substring(p, F.lit(1), j - 1), F.substring(p, j + 1, F.length(p)))
    part = F.col("part")
    places = F.when(F.length(part) > 0, F.sequence(F.lit(1), F.length(part))).otherwise(F.array().cast("array<int>"))
    own = F.concat(
        F.array(F.struct(F.xxhash64("rest", part).alias("key"), F.lit("whole").alias("kind"))),
        F.transform(places, lambda j: F.struct(F.xxhash64(F.col("rest"), without(part, j)).alias("key"), F.lit("less").alias("kind"))),
        F.transform(places, lambda j: F.struct(F.xxhash64(F.col("rest"), without(part, j), j).alias("key"), F.lit("place").alias("kind"))),
    )
    return same_rest.select("doc_id", "pos", F.inline(own)).distinct()


def near_lines(lines: DataFrame, near_from: int, longest_piece: int) -> DataFrame:
    """``doc_id, pos`` of the candidates that have an earlier line one edit away."""
    own = staged(variants(lines, longest_piece), "variants")
    at = F.struct("doc_id", "pos")
    of_kind = own.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, at)).alias(k) for k in ("whole", "less", "place")), F.count("*").alias("c")).where("c > 1").drop("c")
    earliest = F.when(F.col("kind") == "whole", F.col("less")).when(F.col("kind") == "less", F.col("whole")).otherwise(F.col("place"))
    pairs = own.join(of_kind, "key").select("doc_id", "pos", earliest.alias("by")).where(F.col("by") < at).distinct()
    pairs = pairs.select("doc_id", "pos", F.col("by.doc_id").alias("by_doc"), F.col("by.pos").alias("by_pos"))
    leaders = lines.select(F.col("doc_id").alias("by_doc"), F.col("pos").alias("by_pos"), F.col("line").alias("by_line"))
    both = pairs.join(lines, ["doc_id", "pos"]).join(leaders, ["by_doc", "by_pos"])
    return both.where(F.length("line") >= near_from).where(F.expr("levenshtein(line, by_line, 1) BETWEEN 0 AND 1")).select("doc_id", "pos").distinct()


def repeated_lines(docs: DataFrame, near_from: int = 20, longest_piece: int = 1000) -> DataFrame:
    """``doc_id, pos`` of every line to remove."""
    n = F.length("line")
    hashed = lines_of(docs).select("doc_id", "pos", *fingerprint(F.col("line")), F.when(n >= near_from - 1, halves(F.col("line"), n)).alias("keys"))  # a line may be one shorter than what it decides on
    # One row for each distinct line: its first place. The halves are the same wherever it stands.
    first = staged(hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("times"), F.any_value("keys").alias("keys")), "lines")
    repeated = first.where("times > 1").select("h1", "h2", "at")
    equal = hashed.select("doc_id", "pos", "h1", "h2").join(repeated, ["h1", "h2"]).where(F.struct("doc_id", "pos") != F.col("at")).select("doc_id", "pos")
    wanted = candidates(first.select("at.doc_id", "at.pos", "keys")).groupBy("doc_id").agg(F.collect_set("pos").alias("wanted"))  # no more than a document has lines
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.col("text").cast("string"), "\n").alias("all"))
    fetched = cut.join(wanted, "doc_id").select("doc_id", F.inline(F.transform("wanted", lambda p: F.struct(p.alias("pos"), F.get("all", p).alias("line")))))
    lines = staged(fetched.where("line IS NOT NULL").dropDuplicates(["doc_id", "pos"]), "candidates")
    return equal.unionByName(near_lines(lines, near_from, longest_piece)).distinct()


def staying(lines: Column, gone: Column) -> Column:
    """The lines that are not at the places ``gone``. The places that stay are a difference of sets, so the work grows with the lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(places, lambda i: F.get(lines, i))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; ``n_chars``, if there, is the new length. Other columns, whatever their names, are kept."""
    gone, of = unused(docs, "_gone"), unused(docs, "_of")
    found = repeated_lines(docs, **options).groupBy("doc_id").agg(F.collect_set("pos").alias(gone))  # no more than a document has lines
    joined = docs.join(found.withColumnRenamed("doc_id", of), F.col("doc_id").cast("long") == F.col(of), "left")
    kept = F.array_join(staying(F.split("text", "\n"), F.col(gone)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(gone, of)


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row (lines that are not blank are counted)."""
    gone = repeated_lines(docs, **options).groupBy("doc_id").agg(F.collect_set("pos").alias("_gone"))  # no more than a document has lines
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("all"))
    joined = own.join(gone.withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of"), "left")
    stay = F.when(F.col("_gone").isNull(), F.col("all")).otherwise(staying(F.col("all"), F.col("_gone")))
    counted = F.size(F.filter("all", lambda line: line.rlike(r"\S")))
    return joined.select("doc_id", counted.cast("long").alias("n_lines"), (F.size("all") - F.size(stay)).cast("long").alias("n_removed"), F.sha2(F.array_join(stay, "\n"), 256).alias("kept_sha256"))
