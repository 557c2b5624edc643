"""Queries on scans of texts by position and on tables of pages under a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.functions import scan
from placewright.plans.registry import query, table
from placewright.sources import contracts, html


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
s AS (SELECT *, sum(CASE WHEN c IN ('(', 'q') THEN 1 WHEN c IN (')', 'x') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM c),
d AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s),
p AS (SELECT *, depth = 0 AND c IN (',', '.', ';') AS cut FROM d), n AS (SELECT *, sum(cut::int) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM p),
g AS (SELECT doc_id, part, string_agg(c, '' ORDER BY i) AS held FROM n WHERE NOT cut GROUP BY 1, 2),
h AS (SELECT doc_id, count(*) AS n_parts, max(length(held)) AS longest, md5(string_agg(held, '|' ORDER BY part)) AS digest FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_parts, 0) AS n_parts, longest, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN h USING (doc_id)""")
def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of whole texts between marks that stand in no bracket; two letters serve as brackets, so they nest and often don't match."""
    parts = scan.top_level_parts(F.coalesce("text", F.lit("")), ",.;", "(q", ")x")
    made = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    longest = F.array_max(F.transform("parts", lambda p: F.length(p).cast("long")))
    return made.select("doc_id", F.size("parts").cast("long").alias("n_parts"), longest.alias("longest"), F.md5(F.array_join("parts", "|")).alias("digest"))


@query(r"""
WITH q AS (SELECT doc_id + 1 AS doc_id, regexp_replace(string_split(text, ' ')[4], '\s+', '', 'g') AS asked FROM documents),
d AS (SELECT doc_id, asked, regexp_replace(string_split(text, ' ')[1], '\s+', '', 'g') AS a, regexp_replace(string_split(text, ' ')[2], '\s+', '', 'g') AS b, text, instr(text, asked) AS hit FROM documents JOIN q USING (doc_id))
SELECT doc_id, asked, CASE WHEN asked = '' THEN NULL WHEN coalesce(a = asked, false) OR coalesce(b = asked, false) THEN 'exact'
WHEN length(asked) >= 3 AND (coalesce(a <> '' AND (contains(a, asked) OR contains(asked, a)), false) OR coalesce(b <> '' AND (contains(b, asked) OR contains(asked, b)), false)) THEN 'partial'
WHEN hit > 0 AND regexp_matches(substr(text, greatest(hit - 45, 1), least(hit - 1, 45) + length(asked) + 45), 'the |enan|una') THEN 'relation' END AS evidence FROM d""")
def context_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document says about a name asked for in the one before it: one of its names, part of one, or a cue near the name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.regexp_replace(F.get(F.split("text", " "), 3), r"\s+", "").alias("asked"))
    told = scan.evidence(F.col("asked"), F.slice(F.split("text", " "), 1, 2), F.col("text"), "the |enan|una")
    return docs.join(asked, "doc_id").select("doc_id", "asked", told.alias("evidence"))


@query("""
WITH n AS (SELECT p_partkey, [p_type, p_name, p_brand || ' (' || p_type || ')', p_brand, p_type] AS names FROM part),
c AS (SELECT p_partkey, list_transform(list_filter(names, lambda x: regexp_matches(x, '[A-Z]')), lambda x: trim(regexp_replace(regexp_replace(x, '[()·/]', ' ', 'g'), '\\s+', ' ', 'g'))) AS c FROM n),
k AS (SELECT p_partkey, list_filter(c, lambda x: length(x) >= 2 AND x NOT IN ('ECONOMY', 'Brand#11'))[1:3] AS k FROM c)
SELECT p_partkey, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') AS asked FROM k""".replace("\\\\s", "\\s"))
def catalogue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a catalogue is asked for, without generic ones."""
    names = F.array("p_type", "p_name", F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")), "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scan.search_queries(names, ["ECONOMY", "Brand#11"], "[A-Z]"), "|").alias("asked"))


LISTS = {
    "O": [("Code", "code"), ("Line", "line"), ("Amount", "amount")],
    "F": [("Code", "code"), ("LineNo", "line"), ("Amount", "amount")],
}


def _order_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page with one table for each order, and rows that may lack their last cell. A code spans the lines with its flag; some tables have
    other headers, codes that are blank or reach too far, or a row cut short."""
    dealt = table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # once for both counts and the join
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.sum("l_quantity").cast("long").alias("qty"))
    lists = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("flag", "l_linenumber", "qty"))).alias("lines"))
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lists, "o_orderkey")
    k, n = F.col("o_orderkey"), F.size("lines")

    def row(line, i):
        same = F.size(F.filter("lines", lambda o: o["flag"] == line["flag"]))
        opens = (i == 0) | (F.get("lines", i - 1)["flag"] != line["flag"])
        span = same + F.when((k % 19 == 0) & (i + same == n), 1).otherwise(0)
        code = F.when((k % 17 == 0) & (line["flag"] == F.get("lines", 0)["flag"]), "").otherwise(F.concat_ws("-", k, line["flag"]))
        last = F.when((k % 13 == 0) & (i == n - 1), "").otherwise(F.concat(F.lit('<td><a href="/l/'), k, F.lit("/"), line["l_linenumber"], F.lit('">see</a></td>')))
        return F.concat(F.lit("<tr>"), F.when(opens, F.concat(F.lit('<td rowspan="'), span, F.lit('">'), code, F.lit("</td>"))).otherwise(""), F.lit("<td>"), line["l_linenumber"], F.lit("</td><td>"), line["qty"], F.lit("</td>"), last, F.lit("</tr>"))

    second = F.when(k % 11 == 0, "Lines").when(F.col("o_orderstatus") == "F", "Line No").otherwise("Line")
    page = F.concat(F.lit("<table><tr><th>Code</th><th>"), second, F.lit('</th><th colspan="2">Amount</th></tr>'), F.array_join(F.transform("lines", row), ""), F.lit("</table>"))
    short = held.where("o_orderkey % 26 = 0").select("o_orderkey", F.lit(0).alias("table"), n.alias("row"), F.concat_ws("-", "o_orderkey", F.get("lines", n - 1)["flag"]).alias("id"))
    return held.select("o_orderkey", F.col("o_orderstatus").alias("batch"), page.alias("page")), short


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, short = _order_pages(spark, sf_dir)
    batches = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).alias("table"), F.col("o_orderstatus").alias("batch"))
    return contracts.contract_tables(html.page_tables(pages, "o_orderkey", "page"), "o_orderkey", batches, LISTS, short)


ROWS = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS line, min(l_returnflag) AS flag, sum(l_quantity)::bigint AS qty FROM lineitem GROUP BY 1, 2),
r AS (SELECT l.*, o_orderstatus AS batch, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, min(flag) OVER (PARTITION BY k) AS f0 FROM l JOIN orders ON k = o_orderkey WINDOW w AS (PARTITION BY k ORDER BY flag, line)),
m AS (SELECT *, k % 13 = 0 AND i = n AS short, k % 17 = 0 AND flag = f0 AS blank, CASE WHEN batch NOT IN ('O', 'F') THEN 'no-contract' WHEN k % 11 = 0 THEN 'unexpected-headers' WHEN k % 19 = 0 THEN 'span-beyond-table' END AS whole FROM r),
v AS (SELECT *, CASE WHEN whole IS NULL THEN CASE WHEN short AND (k % 26 <> 0 OR blank) THEN 'incomplete-row' WHEN blank THEN 'no-identifier' END END AS fault FROM m)
"""


@query(ROWS + """SELECT DISTINCT k AS o_orderkey, 0 AS "table", 0 AS "row", whole AS fault FROM v WHERE whole IS NOT NULL UNION ALL SELECT k, 0, i::int, fault FROM v WHERE fault IS NOT NULL""")
def table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the contracts of tables: headers, spans, rows cut short and not known to be, rows without a code."""
    return contracts.violations(_order_rows(spark, sf_dir), "o_orderkey")


@query(ROWS + """, g AS (SELECT k, flag, min(i)::int AS "row", min(batch) AS batch, arg_min(line::varchar, i) AS line, arg_min(qty::varchar || CASE WHEN short THEN '' ELSE ' see' END, i) AS amount, string_agg(line::varchar, ',' ORDER BY i) AS lines, count(*) FILTER (NOT short) AS n_links, bool_or(short) AS short
FROM v WHERE k NOT IN (SELECT k FROM v WHERE whole IS NOT NULL OR fault IS NOT NULL) GROUP BY 1, 2)
SELECT k AS o_orderkey, "row", batch, k || '-' || flag AS id, line, amount, CASE WHEN contains(lines, ',') THEN substr(lines, instr(lines, ',') + 1) ELSE '' END AS components, n_links, CASE WHEN short THEN 'cells-left-out' ELSE '' END AS notes FROM g""")
def table_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of tables that keep their contracts, with the rows that continue them and known omissions noted."""
    made = contracts.records(_order_rows(spark, sf_dir), "o_orderkey")
    lines = F.array_join(F.transform("components", lambda c: c["line"]), ",")
    return made.select("o_orderkey", "row", "batch", "id", F.col("fields")["line"].alias("line"), F.col("fields")["amount"].alias("amount"), lines.alias("components"), F.size("links").cast("long").alias("n_links"), F.array_join("notes", ",").alias("notes"))
