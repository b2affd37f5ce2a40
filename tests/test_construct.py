"""Filling the table store from files."""

import json

import pytest
from pyspark.sql import functions as F
from test_shapefile_source import write

from gridloom.functions import projection
from gridloom.sources import construct
from gridloom.sources.catalog import Catalog


def test_tables_and_buildings(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store")
    (tmp_path / "equipment.csv").write_text("name,s_max_kva,max_i_a,r_mohm_per_km,x_mohm_per_km,z_mohm_per_km,cost_eur,kind,area\nTr_250,250,,,,,9000,Transformer,1\n")
    points = [{"type": "Feature", "properties": {"ogc_fid": i, "osm_id": f"node/{i}"}, "geometry": {"type": "Point", "coordinates": [10.0 + i, 48.0]}} for i in range(3)]
    (tmp_path / "t.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": points}))
    csv, found = {"equipment": str(tmp_path / "equipment.csv")}, str(tmp_path / "t.geojson")
    assert construct.construct(store, csv, found) == ["equipment", "transformers"] and construct.construct(store, csv, found) == []
    assert store.read("equipment").first().s_max_kva == 250
    back = store.read("transformers").select("ogc_fid", projection.reproject(F.col("point"), 3035, 4326).alias("p")).collect()
    assert sorted((r.ogc_fid, round(r.p.x, 9), round(r.p.y, 9)) for r in back) == [(i, 10.0 + i, 48.0) for i in range(3)]

    folder = tmp_path / "buildings"
    folder.mkdir()
    box = [(600_000.0, 5_300_000.0), (600_010.0, 5_300_000.0), (600_010.0, 5_300_010.0), (600_000.0, 5_300_000.0)]
    write(folder, "Res_1", [box, None, box])
    write(folder, "Oth_1", [box])
    write(folder, "Res_2", [box] * 4)
    write(folder, "Res_3", [box])
    (folder / "Res_3.shp").write_bytes(b"broken")  # not asked for
    assert construct.import_buildings(store, str(folder), [1]) == [1]
    assert construct.import_buildings(store, str(folder), [1, 2]) == [2] and construct.import_buildings(store, str(folder), [1, 2]) == []
    res = store.read("res").collect()
    assert sorted(r.use for r in res) == sorted(["h0", "h1", "h2", "h0", "h1", "h2", "h3"]) and store.read("oth").count() == 1
    assert sum(r.ring is None for r in res) == 1 and sorted(r.ags for r in store.read("ledger").collect()) == [1, 2]
    ring = next(r.ring for r in res if r.ring)
    assert 4_750_000 < ring[0].x < 4_850_000 and abs(((ring[1].x - ring[0].x) ** 2 + (ring[1].y - ring[0].y) ** 2) ** 0.5 - 10) < 0.05
    with pytest.raises(FileNotFoundError, match="9"):
        construct.import_buildings(store, str(folder), [1, 9])
    store.delete("ledger", ags=2)  # an import that was cut off before the ledger
    assert construct.import_buildings(store, str(folder), [2]) == [2] and store.read("res").count() == 7
