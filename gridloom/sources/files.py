"""Readers and writers of the file formats around the engine."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POSITION = "array<double>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a stated schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_geojson(spark: SparkSession, path: str, properties: str, polygons: bool = True) -> DataFrame:
    """Features of GeoJSON files: the properties of the stated schema, and ``ring`` or ``point``.

    Of a polygon the outer ring is taken; a multi-polygon gives one row a part.
    """
    one = "array<array<array<double>>>" if polygons else _POSITION
    many = f"array<{one}>"
    feature = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<{feature}>")["features"]).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    wrapped = F.from_json(F.concat(F.lit('{"c":'), F.when(kind.startswith("Multi"), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), F.lit("}")), f"c {many}")["c"]
    parts = raw.select("f.properties.*", F.explode(wrapped).alias("g"))
    if polygons:
        ring = F.transform(F.element_at("g", 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return parts.withColumn("ring", ring).drop("g")
    return parts.withColumn("point", F.struct(F.col("g")[0].alias("x"), F.col("g")[1].alias("y"))).drop("g")


def write_geojson(rows: DataFrame, path: str, geometry: str) -> None:
    """Rows as GeoJSON features, one on each line; ``geometry`` is a point, or an array of points taken as a line."""
    point = dict(rows.dtypes)[geometry].startswith("struct")
    g = F.col(geometry)
    coordinates = F.array(g["x"], g["y"]) if point else F.transform(g, lambda p: F.array(p["x"], p["y"]))
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point" if point else "LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*[c for c in rows.columns if c != geometry]).alias("properties"))
    rows.select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)


def _polygons(raw: bytes) -> Iterator[list[tuple[float, float]] | None]:
    """The outer ring of each record of a .shp file of polygons; null shapes are None."""
    at = 100
    while at + 8 <= len(raw):
        words = struct.unpack(">i", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            yield None
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        ends = struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]) + (points,)
        first = 44 + 4 * parts
        xy = struct.unpack(f"<{2 * ends[1]}d", body[first : first + 16 * ends[1]])
        yield list(zip(xy[::2], xy[1::2], strict=True))


def _attributes(raw: bytes) -> Iterator[dict[str, str]]:
    """The records of a .dbf file, as text by field."""
    count, header, size = struct.unpack("<iHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1").lower(), raw[at + 16]))
        at += 32
    for i in range(count):
        record, place, out = raw[header + i * size : header + (i + 1) * size], 1, {}
        for name, width in fields:
            out[name] = record[place : place + width].decode("utf-8", "replace").strip()
            place += width
        yield out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, attributes, ring) of all polygon shapefiles below a folder.

    A file is one row of Spark's binary reader, so files are read in parallel; the
    .shp and .dbf of one name meet by their name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{shp,dbf}").load(path).select("path", "content")
    stem, kind = F.regexp_extract("path", r"^(.*)\.\w+$", 1), F.regexp_extract("path", r"\.(\w+)$", 1)
    shapes = files.where(kind == "shp").select(stem.alias("file"), F.col("content").alias("shp"))
    records = files.where(kind == "dbf").select(stem.alias("file"), F.col("content").alias("dbf"))

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                pairs = zip(_polygons(bytes(row.shp)), _attributes(bytes(row.dbf)), strict=True)
                out = [(row.file, i, attributes, [{"x": x, "y": y} for x, y in ring] if ring else None) for i, (ring, attributes) in enumerate(pairs)]
                yield pd.DataFrame(out, columns=["file", "i", "attributes", "ring"])

    return shapes.join(records, "file").mapInPandas(parse, "file string, i long, attributes map<string,string>, ring array<struct<x:double,y:double>>")
