"""Shapefiles read in ranges of records."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from gridloom.sources import files, shapefile


def write(folder, name, rings):
    """A polygon shapefile with one attribute, its index included."""
    shp, shx, dbf = b"", b"", b""
    for i, ring in enumerate(rings):
        body = struct.pack("<i", 0) if ring is None else struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(body) // 2)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        dbf += b" " + f"h{i}".encode().ljust(6)
    (folder / f"{name}.shp").write_bytes(bytes(100) + shp)
    (folder / f"{name}.shx").write_bytes(bytes(100) + shx)
    field = b"use".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BiHH", 3, 0, 0, 0, len(rings), 65, 7) + bytes(20) + field + b"\r" + dbf)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    ring = lambda: [(rng.random(), rng.random()) for _ in range(rng.randrange(4, 9))]
    (tmp_path / "more").mkdir()
    write(tmp_path, "Res_9780139", [ring() if i % 7 else None for i in range(230)])
    write(tmp_path / "more", "Oth_9780139", [ring() for _ in range(40)])
    write(tmp_path, "Res_1234567", [ring() for _ in range(10)])
    write(tmp_path, "other", [])
    return tmp_path


def test_one_file_in_several_tasks(spark, folder):
    rows = shapefile.read(spark, str(folder), 25)
    want = {(r.file.rsplit("/", 1)[-1], r.i, r.attributes["use"], None if r.ring is None else tuple(map(tuple, r.ring))) for r in files.read_shapefiles(spark, str(folder)).collect()}
    got = rows.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 280 and {(r.file.rsplit("/", 1)[-1], r.i, r.attributes["use"], None if r.ring is None else tuple(map(tuple, r.ring))) for r in got} == want
    assert len({r.part for r in got if r.file.endswith("Res_9780139")}) == 10
    assert {(r.kind, r.code) for r in got} == {("Res", "9780139"), ("Oth", "9780139"), ("Res", "1234567")}
    assert shapefile.read(spark, folder.as_uri(), 25).count() == 280


def test_names_choose_files(spark, folder):
    rows = shapefile.read(spark, str(folder), 25)
    assert rows.where("code = '9780139' and kind = 'Oth'").count() == 40
    assert rows.where("code in ('1234567', '9780139') and kind = 'Res'").count() == 240
    assert rows.where("code = '9780139' and i >= 30").count() == 210 and rows.where("code = '0'").count() == 0
    for suffix in ("shp", "shx", "dbf"):  # files of another code are not opened
        (folder / f"Res_1234567.{suffix}").write_bytes(b"broken")
    assert rows.where("code = '9780139'").count() == 270
    with pytest.raises(Exception, match="struct.error"):
        shapefile.read(spark, str(folder), 25).count()
