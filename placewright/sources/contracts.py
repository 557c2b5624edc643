"""Tables of pages under a contract: what headers a batch of tables must have, which field a column holds, and what may be left out.
A table that breaks its contract is a violation and gives no records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Contracts = dict[str, Sequence[tuple[str, str]]]


def _literal(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.lit(None).cast("map<string,string>")


def contract_rows(cells: DataFrame, key: str, batches: DataFrame, contracts: Contracts, omitted: DataFrame | None = None) -> DataFrame:
    """``contract_tables`` of cells of ``html.table_cells``, gathered by table first; from pages, ``html.page_tables`` does without."""
    rows = cells.groupBy(key, "table", "row").agg(F.sort_array(F.collect_list(F.struct("col", "origin", "text", "from_row", "links", "images"))).alias("cells"), F.max("rows").alias("n"), F.max("clash").alias("c"))
    tables = rows.groupBy(key, "table").agg(F.max("n").alias("n_rows"), F.max("c").alias("clash"), F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("grid"))
    return contract_tables(tables, key, batches, contracts, omitted)


def contract_tables(tables: DataFrame, key: str, batches: DataFrame, contracts: Contracts, omitted: DataFrame | None = None) -> DataFrame:
    """Rows of tables (of ``html.page_tables``) with their fields: ``key, table, batch, row, from_row, id, fields, links, images, note,
    fault, table_fault``.

    ``batches`` (key, table, batch) says which contract a table is under. A contract is its headers in order with the field of each; a header
    over several columns gives them all its field, and a field's cells are joined by a blank, each cell once. Headers are compared without
    white space. The first column identifies a row; a row whose identifier comes from an earlier one (``from_row``) continues it. ``omitted``
    (key, table, row, id) names rows that are known to lack their last cells: they stay, with a note. ``links`` and ``images`` hold the field
    that each stands in. Faults of a table: no contract, other headers, a header that spans rows, a cell over another, a span beyond the last
    row, a row without cells. Faults of a row: cells missing or too many, no identifier. Of several the first in this order is told. A table without a
    header row has other headers; an unknown batch has no contract; null keys belong to no batch.

    A table is at most a page and stays one row until it is judged, so it is shuffled once, to meet its batch and omissions."""
    expected = _literal({b: "|".join(h for h, _ in c) for b, c in contracts.items()})
    named = _literal({f"{b}\n{h}": f for b, c in contracts.items() for h, f in c})
    head = F.flatten(F.transform(F.filter("grid", lambda r: r["row"] == 0), lambda r: F.transform(r["cells"], lambda c: F.struct(c["col"], c["origin"], F.regexp_replace(c["text"], r"\s+", "").alias("h")))))
    spans = F.exists("grid", lambda r: (r["row"] > 0) & F.exists(r["cells"], lambda c: c["from_row"] == 0))
    broken = F.when(F.col("clash"), "overlapping-cells").when(F.array_max(F.transform("grid", lambda r: r["row"])) >= F.col("n_rows"), "span-beyond-table").when(F.size("grid") < F.col("n_rows"), "row-without-cells")
    body = F.filter("grid", lambda r: (r["row"] > 0) & (r["row"] < F.col("n_rows")) & F.col(key).isNotNull())
    met = tables.select(key, "table", head.alias("_head"), spans.alias("_spans"), broken.alias("_broken"), body.alias("_body")).join(batches, [key, "table"], "left")
    if omitted is None:
        met = met.withColumn("_omitted", F.array().cast("array<struct<row:int,id:string>>"))
    else:
        known = omitted.where("row IS NOT NULL AND id IS NOT NULL").groupBy(key, "table").agg(F.collect_set(F.struct(F.col("row").cast("int").alias("row"), F.col("id").cast("string").alias("id"))).alias("_omitted"))
        met = met.join(known, [key, "table"], "left")
    headers = F.array_join(F.transform(F.filter("_head", lambda c: c["origin"]), lambda c: c["h"]), "|")
    wanted = F.try_element_at(expected, F.col("batch"))
    fault = F.when(wanted.isNull(), "no-contract").when(headers != wanted, "unexpected-headers").when(F.col("_spans"), "spanning-header").otherwise(F.col("_broken"))
    heads = F.map_from_entries(F.transform("_head", lambda c: F.struct(c["col"], c["h"])))
    told = met.select(key, "table", "batch", "_body", "_omitted", fault.alias("_fault"), F.size("_head").alias("_width"), heads.alias("_heads"))

    def judged(r: Column) -> Column:
        first = F.get(F.filter(r["cells"], lambda c: c["col"] == 0), 0)
        noted = (F.size(r["cells"]) < F.col("_width")) & F.coalesce(F.array_contains("_omitted", F.struct(r["row"].alias("row"), first["text"].alias("id"))), F.lit(False))
        wrong = F.when((F.size(r["cells"]) != F.col("_width")) & ~noted, "incomplete-row").when(F.coalesce(first["text"], F.lit("")) == "", "no-identifier")
        return F.struct(r["row"].alias("row"), first["from_row"].alias("from_row"), first["text"].alias("id"), r["cells"].alias("cells"), noted.alias("noted"), F.when(F.col("_fault").isNull(), wrong).alias("fault"))

    told = told.withColumn("_rows", F.transform("_body", judged)).withColumn("table_fault", F.coalesce("_fault", F.array_min(F.transform("_rows", lambda r: r["fault"]))))
    kind = told.schema["_rows"].dataType.elementType
    of_table = F.struct(*[(F.lit(0) if f.name == "row" else F.col("_fault") if f.name == "fault" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    row = told.select(key, "table", "batch", "_heads", "table_fault", F.explode(F.concat(F.filter(F.array(of_table), lambda r: r["fault"].isNotNull()), "_rows")).alias("_r"))

    field = lambda c: F.coalesce(F.try_element_at(named, F.concat_ws("\n", "batch", F.try_element_at("_heads", c["col"]))), F.lit("?"))
    cells = F.transform(F.col("_r")["cells"], lambda c: F.struct(field(c).alias("field"), c["text"].alias("text"), c["links"].alias("links"), c["images"].alias("images")))
    row = row.withColumn("_cells", cells)
    own = F.col("_cells")
    names = F.array_distinct(F.transform(own, lambda c: c["field"]))
    texts = lambda f: F.array_join(F.array_distinct(F.filter(F.transform(F.filter(own, lambda c: c["field"] == f), lambda c: c["text"]), lambda t: t != "")), " ")
    roles = lambda what: F.array_distinct(F.flatten(F.transform(own, lambda c: F.transform(c[what], lambda u: F.struct(c["field"].alias("role"), u.alias("url"))))))
    r = F.col("_r")
    return row.select(key, "table", "batch", r["row"].alias("row"), r["from_row"].alias("from_row"), r["id"].alias("id"), F.map_from_arrays(names, F.transform(names, texts)).alias("fields"), roles("links").alias("links"), roles("images").alias("images"),
                      F.when(r["noted"], "cells-left-out").alias("note"), r["fault"].alias("fault"), "table_fault")


def violations(rows: DataFrame, key: str) -> DataFrame:
    """``key, table, row, fault`` of what breaks a contract; row 0 stands for the table."""
    return rows.where("fault IS NOT NULL").select(key, "table", "row", "fault")


def records(rows: DataFrame, key: str) -> DataFrame:
    """A record for each identified row of the tables without a fault: ``key, table, row, batch, id, fields, components, rows, links, images,
    notes``. Rows that continue it are ``components`` in page order; its links and images are those of all its rows, each once."""
    sound = rows.where("table_fault IS NULL")
    ordered = F.sort_array(F.collect_list(F.struct("row", "batch", "id", "fields_", "links", "images", "note")))
    own = lambda name: F.transform("_rows", lambda r: r[name])
    entries = sound.withColumn("fields_", F.map_entries("fields"))  # maps have no order to sort by
    made = entries.groupBy(key, "table", "from_row").agg(ordered.alias("_rows"))
    start = F.get("_rows", 0)
    return made.select(
        key, "table", F.col("from_row").alias("row"), start["batch"].alias("batch"), start["id"].alias("id"), F.map_from_entries(start["fields_"]).alias("fields"),
        F.transform(F.slice("_rows", 2, F.size("_rows")), lambda r: F.map_from_entries(r["fields_"])).alias("components"), own("row").alias("rows"),
        F.array_distinct(F.flatten(own("links"))).alias("links"), F.array_distinct(F.flatten(own("images"))).alias("images"), F.array_distinct(F.array_compact(own("note"))).alias("notes"),
    )
