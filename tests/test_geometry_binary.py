"""Well-known binary against the bytes of struct."""

import random
import struct

from pyspark.sql import functions as F

from gridloom.functions import geometry as G

KIND = "i int, line array<struct<x:double,y:double>>"


def test_lines_and_polygons(spark):
    rng = random.Random(2)
    odd = [0.0, 1.0, -1.0, 2.0**-1022, 1.7976931348623157e308, -0.1, 1e-300, 4321000.0, 2.0**52 + 1]
    odd += [f(2.0**k) for k in range(-60, 61, 7) for f in (lambda v: v, lambda v: v * (1 - 2**-53), lambda v: -v * (1 + 2**-52))]
    values = odd + [rng.uniform(-1e7, 1e7) for _ in range(300)] + [rng.uniform(1, 2) * 10.0 ** rng.randrange(-300, 300) for _ in range(100)]
    lines = [list(zip(values[i : i + 10], values[i + 5 : i + 15], strict=False)) for i in range(0, len(values), 10)]
    df = spark.createDataFrame(list(enumerate(lines)), KIND)
    for r in df.select("i", G.wkb_line(F.col("line")).alias("w"), G.wkb_polygon(F.col("line")).alias("p")).collect():
        line = lines[r.i]
        pack = lambda points: struct.pack(">I", len(points)) + b"".join(struct.pack(">dd", *p) for p in points)
        assert bytes(r.w) == b"\0" + struct.pack(">I", 2) + pack(line)
        if not line:
            assert r.p is None
            continue
        assert bytes(r.p) == b"\0" + struct.pack(">II", 3, 1) + pack(line if line[0] == line[-1] else line + line[:1])


def test_what_has_no_bytes(spark):
    rows = [(0, [(float("nan"), 1.0)]), (1, [(1.0, float("inf"))]), (2, [(None, 1.0)]), (3, None)]
    assert all(r.w is None for r in spark.createDataFrame(rows, KIND).select(G.wkb_line(F.col("line")).alias("w")).collect())
    assert bytes(spark.createDataFrame([(0, [])], KIND).select(G.wkb_line(F.col("line")).alias("w")).first().w) == b"\0\0\0\0\2\0\0\0\0"
