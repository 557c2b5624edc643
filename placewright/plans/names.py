"""Queries on names, addresses and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import address, text
from placewright.operators.linkage import spelling_pairs
from placewright.operators.search import search, search_records
from placewright.plans.registry import query, table
from placewright.sources.html import cell_text, links

ASKED = ["green", "Red", "part 1", "PART", "goldenrod", "zzz"]

def fold_sql(c: str) -> str:
    return f"regexp_replace(strip_accents({c}), '[̀-ͯ]', '', 'g')"


def words_sql(c: str) -> str:
    plain = f"replace(regexp_replace(replace(upper({fold_sql(c)}), 'ẞ', 'SS'), '[’‘`´]', '''', 'g'), '&', ' AND ')"
    return f"trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def compact_sql(c: str) -> str:
    return f"replace({words_sql(c)}, ' ', '')"


def search_key_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({fold_sql(c)}), '[’''`.-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
WITH terms AS (SELECT p_partkey, p_name, unnest([p_name, p_brand, p_type]) AS t FROM part),
keys AS (SELECT p_partkey, p_name, {search_key_sql('t')} AS t FROM terms),
asked AS (SELECT q, {search_key_sql('q')} AS k FROM (SELECT unnest({ASKED!r}) AS q)),
best AS (SELECT q, p_partkey, p_name, min(CASE WHEN t = k THEN 0 WHEN starts_with(t, k) THEN 1 ELSE 2 END) AS r FROM keys JOIN asked ON contains(t, k) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, p_name, p_partkey) AS place FROM best)
SELECT q AS query, place::INT AS place, r::INT AS rank, p_partkey, p_name FROM ranked WHERE place <= 10""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked name search over parts, with their brand and type as further terms: exact, prefix, contains; ten best each."""
    parts = table(spark, sf_dir, "part")
    asked = spark.createDataFrame([(q,) for q in ASKED], "query string")
    records = search_records(parts.withColumn("pos", F.col("p_partkey")), "p_partkey", "pos", "p_name", ["p_name", "p_brand", "p_type"])
    return search(records, asked, "p_partkey", "p_name", "pos")


@query(f"SELECT doc_id, {words_sql('text')} AS words, length({compact_sql('text')})::INT AS letters FROM documents")
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as folded upper-case words."""
    whole = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.words(whole).alias("words"), F.length(text.compact(whole)).alias("letters"))


@query("""
SELECT s_suppkey, 'ROUTE DE ' || translate(upper(n_name), '0123456789_', 'ABCDEFGHIJX') || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '|' || (s_suppkey % 1000) END AS key,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 1000)::VARCHAR END AS number, 'ROUTE DE ' || translate(upper(n_name), '0123456789_', 'ABCDEFGHIJX') AS street
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street and number keys of addresses in several spellings."""
    number = (F.col("s_suppkey") % 1000).cast("string")
    written = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Rte. de "), "n_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("No. "), number, F.lit(", Rte. de "), "n_name"))
        .otherwise(F.concat(F.lit("Route  dé "), "n_name", F.lit(" N°"), number))
    )
    nations = table(spark, sf_dir, "nation").withColumn("n_name", F.translate("n_name", "0123456789_", "ABCDEFGHIJX"))
    key = address.western_key(written)
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", key["key"].alias("key"), key["number"].alias("number"), key["street"].alias("street"))


@query(f"""
WITH p AS (SELECT p_partkey, p_brand, p_size, {compact_sql('p_name')} AS c FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE a.c <> '' AND b.c <> '' AND (a.c = b.c OR (least(length(a.c), length(b.c)) >= 6 AND abs(length(a.c) - length(b.c)) <= 2
  AND levenshtein(a.c, b.c) <= greatest(1, floor(least(length(a.c), length(b.c)) / 10.0))))""")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one name within a block (brand and size)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", text.compact(F.col("p_name")).alias("c"))
    return spelling_pairs(p, ["p_brand", "p_size"], "p_partkey", "c")


@query(f"""
WITH s AS (SELECT p_partkey, p_brand, p_name, {words_sql('p_name')} AS w, p_size FROM part),
scored AS (SELECT *, (least(length(w), 80) + CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END * 8 + least(p_size, 5) + 2)::INT AS score FROM s)
SELECT p_brand, arg_min(p_partkey, (-score, p_partkey)) AS p_partkey, max(score) AS score FROM scored GROUP BY p_brand""")
def specificity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific name of each brand."""
    score = text.specificity(F.col("p_name"), F.lit(None).cast("string"), F.col("p_size"), F.lit(1900))
    scored = table(spark, sf_dir, "part").withColumn("score", score)
    return scored.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("score"), "p_partkey")).alias("p_partkey"), F.max("score").alias("score"))


RULES = [("(?i)brass|steel", "metal"), ("(?i)copper|nickel|tin", "soft-metal"), ("(?i)large|economy", "size"), ("(?i)promo", "offer")]


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)brass|steel') THEN 'metal' WHEN regexp_matches(p_type, '(?i)copper|nickel|tin') THEN 'soft-metal'
  WHEN regexp_matches(p_type, '(?i)large|economy') THEN 'size' WHEN regexp_matches(p_type, '(?i)promo') THEN 'offer' ELSE 'other' END AS kind FROM part""")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.first_rule(F.col("p_type"), RULES, "other").alias("kind"))


@query("""
WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(p_type, '[\\s/;,]+')) AS part, unnest(range(1, len(regexp_split_to_array(p_type, '[\\s/;,]+')) + 1)) AS i FROM part),
k AS (SELECT p_partkey, i, CASE WHEN regexp_matches(part, '(?i)brass|steel') THEN 'metal' WHEN regexp_matches(part, '(?i)copper|nickel|tin') THEN 'soft-metal'
  WHEN regexp_matches(part, '(?i)large|economy') THEN 'size' WHEN regexp_matches(part, '(?i)promo') THEN 'offer' END AS kind FROM w),
f AS (SELECT p_partkey, kind, min(i) AS i FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT p.p_partkey, coalesce(string_agg(kind, '|' ORDER BY i), '') AS kinds FROM part p LEFT JOIN f ON p.p_partkey = f.p_partkey GROUP BY p.p_partkey""")
def rule_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.all_rules(F.col("p_type"), RULES), "|").alias("kinds"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'from ' || y WHEN o_orderkey % 4 = 2 THEN 'until ' || (y + o_orderkey % 3) WHEN o_orderkey % 3 = 0 THEN y::VARCHAR ELSE y || '–' || (y + o_orderkey % 3) END AS period
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def format_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    start, end = F.when(k % 2 == 1, y), F.when((k % 4).isin(2, 3), y + (k % 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.period(start, end.cast("int")).alias("period"))


@query(f"SELECT doc_id, {search_key_sql('text')} AS key FROM documents")
def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.search_key(F.col("text")).alias("key"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_dedupe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several documents share, by digest."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""
SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS n_links,
       coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' '), '') AS links FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(own).alias("n_links"), F.array_join(F.array_sort(F.array_distinct(own)), " ").alias("links"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '<(?:br|/p|/div|/li)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g')) AS text FROM pages""")
def html_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", cell_text(F.col("html")).alias("text"))


@query("SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '(\\?[^#]*)', 1)) AS key FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("key"))
