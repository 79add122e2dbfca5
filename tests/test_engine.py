"""The chainable interface on fixtures whose values follow on paper."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom import Calculator, WorkerMode
from geoloom.functions import naming, wkb
from geoloom.sources import storage

X, Y = 1_000_000.0, 2_000_000.0


def layer(spark, rows, ddl):
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], ddl)


def box(x, y, w, h):
    return wkb.encode_polygon([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])


@pytest.fixture(scope="module")
def calculator(spark):
    c = Calculator(spark=spark, verbose=False)
    c.register_layer("airport", layer(spark, [(2000, wkb.encode_point(X + 300, Y + 400)), (2000, None), (2005, wkb.encode_point(X, Y + 7))], "year int, geometry binary"))
    road = wkb.encode_line([(X - 1000, Y), (X + 1000, Y)])
    c.register_layer("roads", layer(spark, [(1, 2020, 2.0, 3.0, road), (2, 2020, None, 3.0, road)], "id long, year int, lanes double, width double, geometry binary"))
    c.register_layer("mr1", layer(spark, [(1,), (1,), (None,)], "roads_2020_id long"))
    c.register_layer("landuse_2020", layer(spark, [(110, box(X - 500, Y - 500, 1000, 1000)), (120, box(X + 9000, Y, 10, 10))], "code int, geometry binary"))
    c.register_layer("jgg_borders_2023", layer(spark, [("A", box(X - 1000, Y - 1000, 1000, 2000)), ("B", box(X, Y - 1000, 1000, 2000)), ("C", box(X + 5000, Y, 10, 10))], "tot_reg_cd string, geometry binary"))
    cells = [(X - 600 + 30 * i, Y - 600 + 30 * j, X - 570 + 30 * i, Y - 570 + 30 * j, None if i == 0 else 100.0) for i in range(40) for j in range(40)]
    c.register_layer("dem", layer(spark, cells, "xmin double, ymin double, xmax double, ymax double, value double"))
    return c.add_point_with_table(pd.DataFrame({"longitude": [127.5, 127.6], "latitude": [38.0, 38.0], "year": [7, 8]}))


def values(c, *names):
    return {(r.id, r.varname, r.year): r.value for r in c.result_df.collect() if r.varname in names}


def test_variables(calculator):
    c = calculator
    c.calculate_coordinate().calculate_airport_distance([2000, 2005]).calculate_road_llw(100, 2020).calculate_main_road_llw(["mr1"], [100], [2020])
    c.calculate_landuse_area_ratio(2020, [100]).calculate_relative_elevation("dem", [300])
    v = {(r.id, r.varname, r.year): r.value for r in c.result_df.collect()}
    assert abs(v[1, "D_Airport", 2000] - 500) < 1e-6 and abs(v[1, "D_Airport", 2005] - 7) < 1e-6
    assert abs(v[1, "TM_X", None] - X) < 1e-6 and abs(v[2, "WGS_X", None] - 127.6) < 1e-9
    assert [round(v[1, f"Road_{k}_0100", 2020], 6) for k in ("L", "LL", "LLW")] == [400, 400, 1200]
    assert [round(v[1, f"MR1_{k}_0100", 2020], 6) for k in ("L", "LL", "LLW")] == [400, 800, 2400]
    assert v[2, "Road_L_0100", 2020] == 0
    assert abs(v[1, "LS110_0100_a", 2020] - 16 * 100**2 * math.sin(math.pi / 16)) < 1e-6 and abs(v[1, "LS110_0100_p", 2020] - 1) < 1e-9
    assert v[1, "LS120_0100_a", 2020] == 0 == v[2, "LS110_0100_p", 2020]
    assert v[1, "Altitude_k", None] == 100 and v[1, "Alt_k_below_20_300", None] == 0
    # Point 2 lies outside the cells: no elevation, and no shares.
    assert not [k for k in v if k[0] == 2 and k[1].startswith("Alt")] or v[2, "Altitude_k", None] is None
    wide = c.get_result()
    assert wide.columns[:4] == ["longitude", "latitude", "year", "id"] and "year_" in wide.columns
    years = {r.year_ for r in wide.collect()}
    assert years == {2000, 2005, 2020, None} and wide.count() == 8
    long = c.get_result(pivot=False)
    assert long.columns == ["longitude", "latitude", "year", "id", "varname", "year_", "value"]


def test_regions(calculator):
    out = calculator.calculate_intersecting_oa([100]).oa_intersection_df
    got = {(r.id, r.tot_reg_cd): r.intersection_ratio for r in out.collect()}
    half = 8 * 100**2 * math.sin(math.pi / 16) / 2e6
    assert set(got) == {(1, "A"), (1, "B"), (2, None)} and got[2, None] == 0
    assert abs(got[1, "A"] - half) < 1e-9 and abs(got[1, "B"] - half) < 1e-9


def test_own_sql_and_chunks(spark):
    c = Calculator("total_single", spark=spark, verbose=False).add_point_with_table(spark.createDataFrame([(127.5, 38.0, 5)], "longitude double, latitude double, id int"))
    c.run_query_workers("", "select id, 'double_x' as varname, null as year, 2 * x as value from chunk", "")
    out = c.get_result(pivot=False).collect()
    assert out[0].id == 5 and abs(out[0].value - 2 * X) < 1e-6 and "id_" not in out[0]
    assert c.get_chunks().columns == ["id", "x", "y", "chunk_id", "wkt"]
    assert c.chunk_by_hilbert(10).get_chunks().count() == c.chunk_by_centroid().get_chunks().count() == 1


def test_checks(spark):
    c = Calculator(spark=spark, verbose=False)
    with pytest.raises(ValueError):
        c.calculate_coordinate()
    c.add_point_with_table(pd.DataFrame({"longitude": [127.5], "latitude": [38.0]}))
    with pytest.raises(ValueError, match="Invalid year '1999'. Valid years are"):
        c.calculate_airport_distance([1999])
    with pytest.raises(ValueError):
        Calculator("bad", spark=spark)
    with pytest.raises(ValueError):
        c.calculate_road_llw([100, 100.4], [2020])
    with pytest.raises(ValueError):
        c.calculate_airport_distance(2000).result_df.count()
    assert Calculator(WorkerMode.CHUNKED_SINGLE, spark=spark).mode is WorkerMode.CHUNKED_SINGLE
    alone = Calculator(spark=spark, verbose=False).add_point_with_table(pd.DataFrame({"longitude": [127.5], "latitude": [38.0]})).get_result()
    assert alone.columns == ["longitude", "latitude"]


def test_names_and_storage():
    assert naming.plain([1000]) == {1000.0: "1000"} and naming.plain([1000.0]) == {1000.0: "1000.0"}
    assert naming.plain([100, 300.5]) == {100.0: "100.0", 300.5: "300.5"} and naming.padded(2.5) == "0003"
    conf = storage.s3a_settings("k", "s", "acc", "b")
    assert conf["fs.s3a.bucket.b.endpoint"].startswith("https://acc.") and all(k.startswith("fs.s3a.bucket.b.") for k in conf)
    with pytest.raises(ValueError):
        storage.credentials("a", None, "b", "c")
    assert storage.s3a_root("b") == "s3a://b" and storage.s3a_root("b", "x/y/") == "s3a://b/x/y"
    assert naming.checked_sizes([100, 50, 100.0]) == [50, 100] and naming.checked_sizes([100, 100.4], rounded=False) == [100, 100.4]


def test_repeated_sizes_count_once(spark):
    c = Calculator(spark=spark, verbose=False)
    c.register_layer("roads", layer(spark, [(1, 2020, 2.0, 3.0, wkb.encode_line([(X - 1000, Y), (X + 1000, Y)]))], "id long, year int, lanes double, width double, geometry binary"))
    c.register_layer("landuse_2020", layer(spark, [("110", box(X - 10, Y - 10, 20, 20), X - 10, Y - 10, X + 10, Y + 10), ("999", box(X + 1e5, Y, 9, 9), X + 1e5, Y, X + 1e5 + 9, Y + 9), ("110", box(X + 50, Y, 5, 5), None, None, None, None)], "code string, geometry binary, xmin double, ymin double, xmax double, ymax double"))
    c.add_point_with_table(pd.DataFrame({"x": [X], "y": [Y]}), "x", "y", 5179).calculate_road_llw([100, 100], [2020]).calculate_landuse_area_ratio(2020, [100, 100.0])
    rows = [(r.varname, round(r.value, 6)) for r in c.result_df.collect()]
    assert len(rows) == len(set(rows)) == 3 + 4
    # Codes far from all points are listed, and plots without a box count.
    assert dict(rows)["Road_L_0100"] == 200 and dict(rows)["LS110_0100_a"] == 425 and dict(rows)["LS999_0100_a"] == 0


def test_own_sql_sees_geometry(spark):
    c = Calculator(spark=spark, verbose=False).add_point_with_table(pd.DataFrame({"x": [X], "y": [Y]}), "x", "y", 5179)
    c.run_query_workers("", "select id, 'bytes' as varname, null as year, length(geometry) as value from chunk", "")
    assert [r.value for r in c.result_df.collect()] == [21.0]


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as Made

    from geoloom import session

    none = Made(isDefined=lambda: False)
    context = Made(_jsc=Made(sc=lambda: Made(getCheckpointDir=lambda: none)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.ensure_checkpoint_dir(Made(sparkContext=context, conf=Made(get=lambda *a: None)))


def test_entry_contract():
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and {"p1_found", "p3_found", "p4_found"} <= set(queries)


def test_prefix_of_layers(spark, tmp_path):
    layer(spark, [(2000, wkb.encode_point(X, Y))], "year int, geometry binary").write.parquet(str(tmp_path / "airport.parquet"))
    c = Calculator(spark=spark, verbose=False).connect_local_database(tmp_path)
    c.add_point_with_table(pd.DataFrame({"lon": [1_000_003.0], "lat": [2_000_004.0]}), "lon", "lat", 5179).calculate_airport_distance(2000)
    assert values(c, "D_Airport") == {(1, "D_Airport", 2000): 5.0}
    assert c.get_result().where(F.col("D_Airport") == 5).count() == 1
