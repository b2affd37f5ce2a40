"""Polygon shapefiles as a data source whose partitions are ranges of records.

Records of a .dbf file have one length, and the .shx index tells where each shape begins,
so a task reads just the bytes of its range.  Files are opened through pyarrow's file
systems, which know local folders, HDFS and object stores; what they cannot open is read
by ``files.read_shapefiles``, one file a task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gridloom.sources.files import _attributes, _polygons

SCHEMA = "file string, code string, kind string, i long, attributes map<string,string>, ring array<struct<x:double,y:double>>"
#: Records of a partition.
RECORDS = 50_000
#: What a name tells: the kind of building first, then the code of the municipality, as in Res_9780139.
NAME = re.compile(r"^(?P<kind>[A-Za-z]+)[^A-Za-z0-9]*(?P<code>\d+)")


@dataclass
class _Range(InputPartition):
    """Records ``first`` to ``last`` of a file: the bytes of the index, of the shapes, and how records are laid out."""

    stem: str
    first: int
    last: int
    shapes: tuple[int, int]
    header: bytes
    width: int


class ShapefileReader(DataSourceReader):
    """Plans ranges of the files below a folder; equalities of ``code`` and ``kind`` choose among the files by name."""

    def __init__(self, options: dict[str, str]):
        self.system, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.records = int(options.get("records", RECORDS))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if isinstance(f, (EqualTo, In)) and name in (("code",), ("kind",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name[0]] = self.wanted.get(name[0], values) & values
            else:
                yield f

    def _named(self, stem: str) -> dict[str, str | None]:
        found = NAME.match(stem.rsplit("/", 1)[-1])
        return found.groupdict() if found else {"kind": None, "code": None}

    def partitions(self) -> list[InputPartition]:
        info = self.system.get_file_info(fs.FileSelector(self.root, recursive=True))
        stems = sorted(f.path[:-4] for f in info if f.is_file and f.path.lower().endswith(".shp"))
        out: list[InputPartition] = []
        for stem in stems:
            if all(self._named(stem)[c] in values for c, values in self.wanted.items()):
                out += self._ranges(stem)
        return out

    def _bytes(self, path: str, start: int, end: int | None = None) -> bytes:
        with self.system.open_input_file(path) as file:
            file.seek(start)
            return file.read(None if end is None else end - start)

    def _ranges(self, stem: str) -> Iterator[_Range]:
        count, size, width = struct.unpack("<iHH", self._bytes(f"{stem}.dbf", 4, 12))
        header = self._bytes(f"{stem}.dbf", 0, size)
        with self.system.open_input_file(f"{stem}.shx") as index, self.system.open_input_file(f"{stem}.shp") as shapes:
            if (index.size() - 100) // 8 != count:
                raise ValueError(f"{stem}: index and attributes differ in their number of records")
            end = shapes.size()
            for first in range(0, count, self.records):
                last = min(first + self.records, count)
                at = []
                for i in (first, last):  # two entries of the index a range
                    index.seek(100 + 8 * i)
                    at.append(2 * struct.unpack(">i", index.read(4))[0] if i < count else end)
                yield _Range(stem, first, last, (at[0], at[1]), header, width)

    def read(self, part: _Range) -> Iterator[tuple]:
        if part is None:  # no file is left
            return
        head = len(part.header)
        body = self._bytes(f"{part.stem}.dbf", head + part.first * part.width, head + part.last * part.width)
        counted = part.header[:4] + struct.pack("<i", part.last - part.first) + part.header[8:]
        named = self._named(part.stem)
        # the parser of whole files expects 100 bytes before the first shape
        shapes = _polygons(bytes(100) + self._bytes(f"{part.stem}.shp", *part.shapes))
        for i, (ring, attributes) in enumerate(zip(shapes, _attributes(counted + body), strict=True), part.first):
            yield part.stem, named["code"], named["kind"], i, attributes, [(float(x), float(y)) for x, y in ring] if ring else None


class ShapefileSource(DataSource):
    """``spark.read.format("polygon_shapefile").load(folder)``; option ``records`` is the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "polygon_shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(dict(self.options))


def read(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """(file, code, kind, i, attributes, ring) of all polygon shapefiles below a folder, in ranges of ``records``.

    ``code`` and ``kind`` come from names such as Res_9780139, and are null for other
    names.  Filters that compare them with values are answered before any file is opened.
    Null shapes have a null ring; a file without records gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("polygon_shapefile").option("records", records).load(path)
