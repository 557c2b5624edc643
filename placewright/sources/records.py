"""Scans of record documents: JSON and GeoJSON with their order, numbered files, content-hashed archives, shapefiles' tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

GEOMETRY = "struct<type:string,coordinates:string>"


def json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Rows of a JSON array document with ``pos``; ``element`` is the DDL of one element. Texts are parsed whole, so one file
    is one task's work: data of size belong in Parquet."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", f"array<{element}>")).alias("pos", "r")).select("pos", "r.*")


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features with ``pos``, their properties, ``geometry_type`` and ``coordinates`` (JSON text)."""
    kind = f"struct<features:array<struct<properties:struct<{properties}>,geometry:{GEOMETRY}>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    return raw.select(F.posexplode("d.features").alias("pos", "f")).select("pos", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def points_of(coordinates: Column) -> Column:
    """All vertices of a geometry's coordinates, at whatever depth: array of ``x, y``."""
    pairs = F.regexp_extract_all(coordinates, F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)[^\[\]]*\]"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s*,\s*")[0].cast("double").alias("x"), F.split(p, r"\s*,\s*")[1].cast("double").alias("y")))


def bounds_of(vertices: Column) -> Column:
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def numbered(spark: SparkSession, folder: str, element: str) -> DataFrame:
    """Rows of ``NNN.json`` files with ``chunk`` (from the name) and ``pos`` within it."""
    raw = spark.read.option("pathGlobFilter", "[0-9][0-9][0-9].json").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("_file"))
    return raw.select(F.substring("_file", 1, 3).cast("int").alias("chunk"), F.posexplode(F.from_json("value", f"array<{element}>")).alias("pos", "r")).select("chunk", "pos", "r.*")


def archive(spark: SparkSession, folder: str, manifest: dict[str, tuple[str, int]]) -> DataFrame:
    """Violations of a content-hashed archive: files whose digest or size is not what its manifest (name: sha256, bytes) says."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), F.col("length").alias("size"))
    said = spark.createDataFrame([(k, h, n) for k, (h, n) in manifest.items()], "name string, sha256 string, bytes long")
    told = said.join(found, "name", "left")
    return told.where("NOT (sha <=> sha256 AND size <=> bytes)").select(F.lit("archive").alias("rule"), F.col("name").alias("key"), F.coalesce("sha", F.lit("missing")).alias("detail"))


def dbf_header(content: bytes) -> tuple[int, int, int]:
    """(rows, header length, row length) of a dBase table."""
    return struct.unpack("<IHH", content[4:12])


def dbf_fields(content: bytes) -> list[tuple[str, str, int]]:
    out, at = [], 32
    while at < len(content) and content[at] != 0x0D:
        name, kind, size = struct.unpack("<11sc4xB15x", content[at : at + 32])
        out.append((name.split(b"\0")[0].decode("latin-1"), kind.decode(), size))
        at += 32
    return out


def dbf_rows(content: bytes, encoding: str = "utf-8") -> list[dict[str, str | None] | None]:
    """All rows of a dBase table in their places; a deleted one is None."""
    rows, start, width = dbf_header(content)
    fields = dbf_fields(content)
    out = []
    for i in range(rows):
        at, row = start + i * width + 1, {}
        if content[at - 1 : at] == b"*":
            out.append(None)
            continue
        for name, _, size in fields:
            row[name] = content[at : at + size].decode(encoding, "replace").strip("\0 ") or None
            at += size
        out.append(row)
    return out


def shp_shapes(content: bytes) -> list[tuple]:
    """``x, y, z, m`` of points and ``parts`` (lists of such vertices) of multipoints, polylines and polygons in a
    shapefile's main part. Null shapes have neither; kinds that are not read raise."""
    out, at = [], 100
    measure = lambda v: None if v < -1e38 else v  # noqa: E731  "no data"
    while at + 8 <= len(content):
        own = content[at + 8 : at + 8 + 2 * struct.unpack(">I", content[at + 4 : at + 8])[0]]
        at += 8 + len(own)
        kind = struct.unpack("<I", own[:4])[0]
        if kind == 0:
            out.append((None, None, None, None, None))
        elif kind in (1, 11, 21):
            v = struct.unpack_from(f"<{(len(own) - 4) // 8}d", own, 4)
            m = v[3:4] if kind == 11 else v[2:3] if kind == 21 else ()
            out.append((v[0], v[1], v[2] if kind == 11 else None, measure(m[0]) if m else None, None))
        elif kind % 10 in (3, 5, 8) and kind < 30:
            many, to = kind % 10 != 8, 36
            n_parts = struct.unpack_from("<I", own, to)[0] if many else 1
            n = struct.unpack_from("<I", own, to + 4 * many)[0]
            to += 4 + 4 * many
            starts = [*(struct.unpack_from(f"<{n_parts}I", own, to) if many else [0]), n]
            to += 4 * n_parts * many
            xy = struct.unpack_from(f"<{2 * n}d", own, to)
            to += 16 * n
            zs = ms = [None] * n
            if 10 < kind < 20:
                zs = struct.unpack_from(f"<{n}d", own, to + 16)
                to += 16 + 8 * n
            if kind > 10 and len(own) >= to + 16 + 8 * n:  # measures can be left out
                ms = [measure(v) for v in struct.unpack_from(f"<{n}d", own, to + 16)]
            vertices = list(zip(xy[::2], xy[1::2], zs, ms, strict=True))
            out.append((None, None, None, None, [vertices[i:j] for i, j in zip(starts, starts[1:], strict=False)]))
        else:
            raise ValueError(f"shapes of kind {kind} are not read")
    return out


def shapefile(spark: SparkSession, folder: str, fields: list[str], encoding: str = "utf-8") -> DataFrame:
    """``source, pos, x, y, z, m, parts`` and ``fields`` (texts) of all pairs of .shp and .dbf in a folder: each pair is one
    task's work. A deleted row goes with its shape; files with different numbers of shapes and rows raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf,SHP,DBF}").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "").alias("source"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    pairs = named.groupBy("source").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("shp", "dbf")]).where("shp IS NOT NULL AND dbf IS NOT NULL")
    told = "source string, pos int, x double, y double, z double, m double, parts array<array<struct<x:double,y:double,z:double,m:double>>>"
    schema = T.StructType([*T.StructType.fromDDL(told).fields, *[T.StructField(f, T.StringType()) for f in fields]])
    kind = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for source, shp, dbf in zip(*(batch.column(c).to_pylist() for c in ("source", "shp", "dbf")), strict=True):
                rows = []
                for i, ((x, y, z, m, parts), row) in enumerate(zip(shp_shapes(shp), dbf_rows(dbf, encoding), strict=True)):
                    if row is not None:
                        parts = parts and [[dict(zip("xyzm", v, strict=True)) for v in part] for part in parts]
                        rows.append(dict(zip(kind.names, (source, i, x, y, z, m, parts, *(row.get(f) for f in fields)), strict=True)))
                yield pa.RecordBatch.from_pylist(rows, kind)

    return pairs.mapInArrow(run, schema)


def alias_field(df: DataFrame, *names: str) -> Column:
    """The first filled of several columns that may be there, in any case."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(have[n.lower()]).cast("string")), F.lit("")) for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")
