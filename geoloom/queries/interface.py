"""Queries through the chainable interface: points in, layers as well-known binary, variables out, each with its result in plain SQL.

Layers are made of integer keys by the same arithmetic in both engines; they
hold points, bent lines, polygons with holes and geometries of several parts.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from geoloom.engine import YEARS, Calculator
from geoloom.functions import wkb
from geoloom.operators.spatial import row_ids
from geoloom.plans import finalise
from geoloom.queries import reference as R
from geoloom.session import spread

LLW_SIZES, PLOT_SIZES, REGION_SIZES, RING_SIZE = [500, 2000], [1000, 3000], [1000.0, 5000.0], 300


@F.arrow_udf(BinaryType())
def _encoded(kind: pa.Array, shape: pa.Array) -> pa.Array:
    """Parts of rings of flat coordinates as a point, line, polygon or multipolygon; all rows have as many of each."""

    def one(kind: str, parts) -> bytes:
        if kind == "point":
            return wkb.encode_point(*parts[0][0])
        if kind == "line":
            return wkb.encode_line(parts[0][0].reshape(-1, 2))
        own = [wkb.encode_polygon(*[r.reshape(-1, 2) for r in rings]) for rings in parts]
        return own[0] if len(own) == 1 else struct.pack("<BII", 1, wkb.MULTIPOLYGON, len(own)) + b"".join(own)

    n = len(shape)
    if not n:
        return pa.array([], pa.binary())
    first = one(kind[0].as_py(), [[np.array(ring) for ring in rings] for rings in shape[0].as_py()])
    flat = shape.flatten().flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype("<f8").view(np.uint8).reshape(n, -1)
    out, done = np.tile(np.frombuffer(first, np.uint8), (n, 1)), 0
    for at, count, _, width in (ring for _, rings in wkb.places(first) for ring in rings):
        size = 8 * count * width
        out[:, at : at + size] = flat[:, done : done + size]
        done += size
    ends = np.arange(n + 1, dtype="<i4") * len(first)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def _geometry(kind: str, *parts: list[list[str]]) -> Column:
    """Geometry of rings, which are SQL expressions of coordinates."""
    shape = F.array(*[F.array(*[F.array(*[F.expr(e).cast("double") for e in ring]) for ring in rings]) for rings in parts])
    return _encoded(F.lit(kind), shape)


def _ring(x: str, y: str, w: float, h: float) -> list[str]:
    corners = [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
    return [f"{v} + {d}" for corner in corners for v, d in zip((x, y), corner)]


def _calculator(spark: SparkSession, d: str, points: dict[str, str] = R._POINTS) -> Calculator:
    """Customers as points with a few attributes, in order of their key, from 0 on; so a point's number is its key and 1."""
    attributes = R._derived(R.table(spark, d, "customer"), points | {"key": points["id"], "year": "c_nationkey"}).drop("id")
    return Calculator(spark=spark, verbose=False).add_point_with_table(attributes.coalesce(1).sortWithinPartitions("key"), "x", "y", 5179)


def _cycled(key: str, years) -> str:
    """A year of the list by key."""
    return "case " + " ".join(f"when {key} % {len(years)} = {k} then {y}" for k, y in enumerate(years)) + " end"


def _rounded(c: Calculator, digits: int = 3) -> DataFrame:
    return c.result_df.select("id", "varname", "year", F.round("value", digits).alias("value"))


# Layers of one kind each: table, key, x, y

_AT = {
    "supplier": ("s_suppkey", R._spread("s_suppkey", 15485863, R.X0), R._spread("s_suppkey", 32452843, R.Y0)),
    "orders": ("o_orderkey", R._spread("o_orderkey", 49979687, R.X0), R._spread("o_orderkey", 67867967, R.Y0)),
    "part": ("p_partkey", R._spread("p_partkey", 86028121, R.X0), R._spread("p_partkey", 15487469, R.Y0)),
}
#: Sides of port areas, and of rivers: shell, hole (offset and sides) and second part (offset and sides).
PORT = 3000
RIVER = ((1500, 900), (300, 200, 500, 300), (2500, 100, 200, 200))
#: How far the middle of a coast's piece bends: less or more than the simplification takes away.
BENDS = (0.6, 40)


def _rows(spark: SparkSession, d: str, name: str, *more: str) -> DataFrame:
    """Keys of a table over all cores, before shapes are made of them in Python."""
    key = _AT[name][0]
    return spread(R.table(spark, d, name).select(key, *more), key)


def _points_layer(spark: SparkSession, d: str, layer: str) -> DataFrame:
    key, x, y = _AT["supplier"]
    return R.table(spark, d, "supplier").select(F.expr(_cycled(key, YEARS[layer])).alias("year"), _geometry("point", [[x, y]]).alias("geometry"))


def _ports(spark: SparkSession, d: str) -> DataFrame:
    key, x, y = _AT["supplier"]
    area = F.when(F.expr(f"{key} % 2 = 0"), _geometry("point", [[x, y]])).otherwise(_geometry("polygon", [_ring(x, y, PORT, PORT)]))
    return _rows(spark, d, "supplier").select(F.expr(_cycled(key, YEARS["ports"])).alias("year"), area.alias("geometry"))


def _lines(spark: SparkSession, d: str, years, dx: int, dy: int) -> DataFrame:
    key, x, y = _AT["orders"]
    return _rows(spark, d, "orders").select(F.col(key).alias("id"), F.expr(_cycled(key, years)).alias("year"), _geometry("line", [[x, y, f"{x} + {dx}", f"{y} + {dy}"]]).alias("geometry"))


def _coast(spark: SparkSession, d: str) -> DataFrame:
    key, x, y = _AT["orders"]
    bend = f"{y} + case when {key} % 3 = 0 then {BENDS[0]} else {BENDS[1]} end"
    line = _geometry("line", [[x, y, f"{x} + 200", bend, f"{x} + 400", y]])
    return _rows(spark, d, "orders").select(F.expr(_cycled(key, YEARS["coastline"])).alias("year"), line.alias("geometry"))


def _holed(x: str, y: str) -> Column:
    (w, h), (hx, hy, hw, hh), (px, py, pw, ph) = RIVER
    return _geometry("polygon", [_ring(x, y, w, h), _ring(f"{x} + {hx}", f"{y} + {hy}", hw, hh)], [_ring(f"{x} + {px}", f"{y} + {py}", pw, ph)])


def _rivers(spark: SparkSession, d: str) -> DataFrame:
    _, x, y = _AT["part"]
    return _rows(spark, d, "part").select(F.lit(2023).alias("year"), _holed(x, y).alias("geometry"))


def _plots(spark: SparkSession, d: str) -> DataFrame:
    _, x, y = _AT["part"]
    return _rows(spark, d, "part", "p_size").select(F.expr("p_size % 7").alias("code"), _holed(x, y).alias("geometry"))


_REGION_X, _REGION_Y = f"{R.X0} + (n_nationkey % 5) * 40000", f"{R.Y0} + floor(n_nationkey / 5) * 40000"
#: Shell, hole and island of a region.
REGION = ((40000, 40000), (9000, 7000, 1500, 1200), (45000, 10000, 2500, 2500))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    (w, h), (hx, hy, hw, hh), (px, py, pw, ph) = REGION
    x, y = _REGION_X, _REGION_Y
    shape = _geometry("polygon", [_ring(x, y, w, h), _ring(f"{x} + {hx}", f"{y} + {hy}", hw, hh)], [_ring(f"{x} + {px}", f"{y} + {py}", pw, ph)])
    return R.table(spark, d, "nation").select(F.col("n_name").alias("tot_reg_cd"), shape.alias("geometry"))


def _surface(spark: SparkSession, d: str, prime: int) -> DataFrame:
    return R._derived(R.table(spark, d, "part"), R._CELLS | {"value": R._CELLS["value"].replace("7919", str(prime))})


SURFACES = {"dem": 7919, "dsm": 104729}

# Queries


def calc_airport(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_calculator(spark, d).register_layer("airport", _points_layer(spark, d, "airport")).calculate_airport_distance(list(YEARS["airport"])))


def calc_bus_stop(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_calculator(spark, d).register_layer("bus_stop", _points_layer(spark, d, "bus_stop")).calculate_bus_stop_distance(list(YEARS["bus_stop"])))


def calc_railstation(spark: SparkSession, d: str) -> DataFrame:
    """Two of the layer's four years."""
    return _rounded(_calculator(spark, d).register_layer("railstation", _points_layer(spark, d, "railstation")).calculate_railstation_distance([2020, 2005]))


def calc_port(spark: SparkSession, d: str) -> DataFrame:
    """Points and areas; 0 inside an area."""
    return _rounded(_calculator(spark, d).register_layer("ports", _ports(spark, d)).calculate_port_distance(list(YEARS["ports"])))


def calc_mdl(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_calculator(spark, d).register_layer("mdl", _lines(spark, d, YEARS["mdl"], 300, -700)).calculate_mdl_distance(list(YEARS["mdl"])))


def calc_coastline(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are simplified first."""
    return _rounded(_calculator(spark, d).register_layer("coastline", _coast(spark, d)).calculate_coastline_distance(list(YEARS["coastline"])))


def calc_river(spark: SparkSession, d: str) -> DataFrame:
    """Areas with holes and several parts; 0 inside, but not in a hole."""
    return _rounded(_calculator(spark, d).register_layer("river", _rivers(spark, d)).calculate_river_distance(2023))


def calc_road(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_calculator(spark, d).register_layer("roads", _lines(spark, d, YEARS["roads"], -150, 90)).calculate_road_distance(list(YEARS["roads"])))


def calc_main_road(spark: SparkSession, d: str) -> DataFrame:
    c = _calculator(spark, d)
    for k, kind in enumerate(("mr1", "mr2")):
        c.register_layer(kind, _lines(spark, d, YEARS["main_roads"], 500, 500 * (2 * k - 1)))
    return _rounded(c.calculate_main_road_distance(["mr1", "mr2"], list(YEARS["main_roads"])))


def _road_layer(spark: SparkSession, d: str) -> DataFrame:
    at = R._ROADS
    shape = _geometry("line", [[at["x1"], at["y1"], at["x2"], at["y2"]]])
    return _rows(spark, d, "orders").select(*[F.expr(at[c]).alias(n) for c, n in (("fid", "id"), ("year", "year"), ("lanes", "lanes"), ("width", "width"))], shape.alias("geometry"))


def calc_road_llw(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_calculator(spark, d).register_layer("roads", _road_layer(spark, d)).calculate_road_llw(LLW_SIZES, R.ROAD_YEARS))


def calc_main_road_llw(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of main roads, each naming other roads per year; numbers may be null or named twice."""
    c = _calculator(spark, d).register_layer("roads", _road_layer(spark, d))
    named = R.table(spark, d, "orders").selectExpr("o_orderkey as roads_2020_id", "case when o_orderkey % 3 > 0 then o_orderkey - o_orderkey % 3 end as roads_2005_id")
    c.register_layer("mr1", named).register_layer("mr2", named.select((F.col("roads_2020_id") - 1).alias("roads_2020_id"), F.col("roads_2020_id").alias("roads_2005_id")))
    return _rounded(c.calculate_main_road_llw(["mr1", "mr2"], [1000], [2005, 2020]))


def calc_landuse(spark: SparkSession, d: str) -> DataFrame:
    """Plots with holes and several parts."""
    return _rounded(_calculator(spark, d).register_layer("landuse_2015", _plots(spark, d)).calculate_landuse_area_ratio(2015, PLOT_SIZES))


def calc_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Both surfaces."""
    c = _calculator(spark, d, R._NEAR_POINTS)
    for kind, prime in SURFACES.items():
        c.register_layer(kind, _surface(spark, d, prime))
    return _rounded(c.calculate_relative_elevation(list(SURFACES), [RING_SIZE]), 6)


def calc_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions with a hole and an island."""
    c = _calculator(spark, d).register_layer("jgg_borders_2023", _regions(spark, d)).calculate_intersecting_oa(REGION_SIZES)
    return c.oa_intersection_df.withColumn("intersection_ratio", F.round("intersection_ratio", 7))


def calc_coordinate(spark: SparkSession, d: str) -> DataFrame:
    """Degrees in, both kinds of coordinates out."""
    at = R._derived(R.table(spark, d, "customer"), R._DEGREES).coalesce(1).sortWithinPartitions("id").drop("id")
    return _rounded(Calculator(spark=spark, verbose=False).add_point_with_table(at, "lon", "lat").calculate_coordinate(), 4)


def _chain(spark: SparkSession, d: str) -> Calculator:
    c = _calculator(spark, d)
    for name in ("airport", "bus_stop"):
        c.register_layer(name, _points_layer(spark, d, name))
    c.calculate_coordinate().calculate_airport_distance([2020, 2000]).calculate_bus_stop_distance(2020)
    return c


def calc_wide(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: attributes with one column per variable and a row per year, and each row's place in the result."""
    out = row_ids(_chain(spark, d).get_result(), "place")
    return out.select("place", "key", "year", "id", "year_", *[F.round(c, 3).alias(c) for c in ("D_Airport", "D_Bus", "TM_X", "TM_Y")])


def calc_long(spark: SparkSession, d: str) -> DataFrame:
    """The same as rows, attached to the attributes."""
    long = _chain(spark, d).get_result(pivot=False).where("varname not like 'WGS%'")
    return long.select("key", "year", "id", "varname", "year_", F.round("value", 3).alias("value"))


def long_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a long result with their place in its order."""
    long = _chain(spark, d).result_df.where("varname not like 'WGS%'")
    return row_ids(finalise.ordered(long), "place").select("place", "id", "year", "varname")


def calc_sql(spark: SparkSession, d: str) -> DataFrame:
    """Own SQL over the points, with statements before and after."""
    c = _calculator(spark, d)
    before, after = "create or replace temp view scaled as select id, x / 1000 as km from chunk", "drop view if exists scaled"
    return _rounded(c.run_query_workers(before, "select id, 'X_km' as varname, 2020 as year, km as value from scaled where km > 1000", after))


def calc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in order of the points, with their texts."""
    return _calculator(spark, d).chunk_by_order(70).get_chunks().groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("wkt").alias("first_wkt"))


QUERIES = {
    f.__name__: f
    for f in (
        calc_airport, calc_bus_stop, calc_railstation, calc_port, calc_mdl, calc_coastline, calc_river, calc_road, calc_main_road, calc_road_llw,
        calc_main_road_llw, calc_landuse, calc_elevation, calc_regions, calc_coordinate, calc_wide, calc_long, long_order, calc_sql, calc_chunks,
    )
}

# SQL twins


def _stops_sql(layer: str, years=None) -> str:
    key, x, y = _AT["supplier"]
    rows = f"select {_cycled(key, YEARS[layer])} as year, {x} as x1, {y} as y1, {x} as x2, {y} as y2 from supplier"
    return f"select * from ({rows}) where year in ({', '.join(map(str, years or YEARS[layer]))})"


def _segments_sql(year: str, source: str, *corners: tuple[str, str]) -> str:
    rows = [f"select {year} as year, {a} as x1, {b} as y1, {c} as x2, {e} as y2 from {source}" for (a, b), (c, e) in zip(corners, corners[1:])]
    return " union all ".join(rows)


def _box_sql(year: str, source: str, x: str, y: str, w: float, h: float) -> str:
    return _segments_sql(year, source, *[(f"{x} + {p}", f"{y} + {q}") for p, q in ((0, 0), (w, 0), (w, h), (0, h), (0, 0))])


def _distance_sql(name: str, segments: str) -> str:
    return f"with {R._P}, s as ({segments}), {R._SQL_DISTANCE} select id, '{name}' as varname, cast(year as int) as year, round(value, 3) as value from near"


def _area_distance_sql(name: str, segments: str, inside: str) -> str:
    """``inside`` gives (year, x0, y0, x1, y1) of boxes in which the distance is 0."""
    return f"""with {R._P}, s as ({segments}), b as ({inside}), {R._SQL_DISTANCE},
      z as (select distinct p.id, b.year from p join b on p.x > b.x0 and p.x < b.x1 and p.y > b.y0 and p.y < b.y1 and not (p.x > b.hx0 and p.x < b.hx1 and p.y > b.hy0 and p.y < b.hy1))
      select near.id, '{name}' as varname, cast(near.year as int) as year, case when z.id is not null then 0 else round(value, 3) end as value
      from near left join z on z.id = near.id and z.year = near.year"""


def _port_sql() -> str:
    key, x, y = _AT["supplier"]
    year = _cycled(key, YEARS["ports"])
    odd = f"supplier where {key} % 2 = 1"
    segments = f"select {year} as year, {x} as x1, {y} as y1, {x} as x2, {y} as y2 from supplier where {key} % 2 = 0 union all {_box_sql(year, odd, x, y, PORT, PORT)}"
    return _area_distance_sql("D_Port", segments, f"select {year} as year, {x} as x0, {y} as y0, {x} + {PORT} as x1, {y} + {PORT} as y1, 0 as hx0, 0 as hx1, 0 as hy0, 0 as hy1 from {odd}")


def _river_sql() -> str:
    _, x, y = _AT["part"]
    (w, h), (hx, hy, hw, hh), (px, py, pw, ph) = RIVER
    boxes = [_box_sql("2023", "part", f"{x} + {ox}", f"{y} + {oy}", bw, bh) for ox, oy, bw, bh in ((0, 0, w, h), (hx, hy, hw, hh), (px, py, pw, ph))]
    inside = f"""select 2023 as year, {x} as x0, {y} as y0, {x} + {w} as x1, {y} + {h} as y1, {x} + {hx} as hx0, {x} + {hx + hw} as hx1, {y} + {hy} as hy0, {y} + {hy + hh} as hy1 from part
      union all select 2023, {x} + {px}, {y} + {py}, {x} + {px + pw}, {y} + {py + ph}, 0, 0, 0, 0 from part"""
    return _area_distance_sql("D_River", " union all ".join(boxes), inside)


def _line_sql(name: str, years, dx: int, dy: int) -> str:
    key, x, y = _AT["orders"]
    return _distance_sql(name, _segments_sql(_cycled(key, years), "orders", (x, y), (f"{x} + {dx}", f"{y} + {dy}")))


def _coast_sql() -> str:
    key, x, y = _AT["orders"]
    year = _cycled(key, YEARS["coastline"])
    straight = _segments_sql(year, f"orders where {key} % 3 = 0", (x, y), (f"{x} + 400", y))
    bent = _segments_sql(year, f"orders where {key} % 3 <> 0", (x, y), (f"{x} + 200", f"{y} + {BENDS[1]}"), (f"{x} + 400", y))
    return _distance_sql("D_Coast", f"{straight} union all {bent}")


def _main_llw_sql() -> str:
    named = {
        "MR1": "select o_orderkey as fid, 2020 as year from orders union all select o_orderkey - o_orderkey % 3, 2005 from orders where o_orderkey % 3 > 0",
        "MR2": "select o_orderkey - 1 as fid, 2020 as year from orders union all select o_orderkey, 2005 from orders",
    }
    roads = R._sql(R._ROADS, "orders")
    return " union all ".join(
        f"({_sized(R._llw_sql(f'select a.* exclude year, b.year from ({roads}) a join ({rows}) b using (fid)', kind, [2005, 2020]), [1000])})" for kind, rows in named.items()
    )


def _sized(sql: str, sizes: list[int]) -> str:
    """The same with other buffer sizes."""
    return sql.replace(R._values(R.ROAD_SIZES, "r_sizes", "double"), R._values(sizes, "r_sizes", "double"))


def _signed_boxes(columns: str, source: str, x: str, y: str, shape) -> str:
    """Shells and further parts with sign 1, holes with sign -1."""
    (w, h), (hx, hy, hw, hh), (px, py, pw, ph) = shape
    rows = [
        f"select {columns}, {n} as part, {sign} as sign, cast({x} + {ox} as double) as xmin, cast({y} + {oy} as double) as ymin, cast({x} + {ox + bw} as double) as xmax, cast({y} + {oy + bh} as double) as ymax from {source}"
        for n, (sign, ox, oy, bw, bh) in enumerate(((1, 0, 0, w, h), (-1, hx, hy, hw, hh), (1, px, py, pw, ph)))
    ]
    return f"select *, row_number() over () as fid from ({' union all '.join(rows)})"


def _landuse_sql() -> str:
    _, x, y = _AT["part"]
    return f"""with {R._overlap_sql([float(s) for s in PLOT_SIZES], _signed_boxes('p_size % 7 as code', 'part', x, y, RIVER)).replace('s as (', 's as materialized (', 1)},
  q as (select a.id, a.r, s.code, sum(sign * greatest(0, overlap)) as a from a join s using (fid) group by all),
  z as (select g.id, g.r, codes.code, coalesce(q.a, 0) as a, coalesce(q.a, 0) / (g.r * g.r * 16 * sin(pi() / 16)) as p
    from g cross join (select distinct code from s) codes left join q on q.id = g.id and q.r = g.r and q.code = codes.code)
  select id, printf('LS%s_%04d_a', cast(code as varchar), cast(r as int)) as varname, 2015 as year, round(a, 3) as value from z
  union all select id, printf('LS%s_%04d_p', cast(code as varchar), cast(r as int)), 2015, round(p, 3) from z"""


def _region_sql() -> str:
    (w, h), (_, _, hw, hh), (_, _, pw, ph) = REGION
    boxes = _signed_boxes("n_name as tot_reg_cd", "nation", _REGION_X, _REGION_Y, REGION)
    return f"""with {R._overlap_sql(REGION_SIZES, boxes).replace('s as (', 's as materialized (', 1)}, {R._NORMALS},
  m as (select b.id, b.r, b.fid, b.tot_reg_cd from b, n where b.sign = 1 group by b.id, b.r, b.fid, b.tot_reg_cd
    having bool_and(nx * case when nx > 0 then l else rr end + ny * case when ny > 0 then u else o end <= b.r * cos(pi() / 32))),
  j as (select distinct id, r, tot_reg_cd from m),
  v as (select a.id, a.r, s.tot_reg_cd, sum(sign * greatest(0, overlap)) as overlap from a join s using (fid) group by all)
  select g.id, g.r as buffer_size, j.tot_reg_cd, round(coalesce(v.overlap / {w * h - hw * hh + pw * ph}, 0), 7) as intersection_ratio
  from g left join j on j.id = g.id and j.r = g.r left join v on v.id = j.id and v.r = j.r and v.tot_reg_cd = j.tot_reg_cd"""


def _ring_sql(kind: str) -> str:
    sql = R._RING_SQL.replace("7919) % 160", f"{SURFACES[kind]}) % 160")
    return sql if kind == "dem" else sql.replace("Alt_k", "Alt_a").replace("Altitude_k", "Altitude_a")


def _degrees_sql() -> str:
    """Gauss-Krueger projection of GRS 80 by its series in the third flattening, every number of it written out here."""
    n = "(1 / 298.257222101 / (2 - 1 / 298.257222101))"
    e = "sqrt(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101))"
    radius = f"(6378137.0 / (1 + {n}) * (1 + pow({n}, 2) / 4 + pow({n}, 4) / 64))"
    a1 = f"({n} / 2 - 2 * pow({n}, 2) / 3 + 5 * pow({n}, 3) / 16 + 41 * pow({n}, 4) / 180)"
    a2 = f"(13 * pow({n}, 2) / 48 - 3 * pow({n}, 3) / 5 + 557 * pow({n}, 4) / 1440)"
    a3 = f"(61 * pow({n}, 3) / 240 - 103 * pow({n}, 4) / 140)"
    a4 = f"(49561 * pow({n}, 4) / 161280)"
    turn = "asinh(tan(radians({v}))) - {e} * atanh({e} * sin(radians({v})))"
    north = lambda xi, eta: f"({xi} + " + " + ".join(f"{a} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate((a1, a2, a3, a4), 1)) + ")"
    east = lambda xi, eta: f"({eta} + " + " + ".join(f"{a} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate((a1, a2, a3, a4), 1)) + ")"
    return f"""with g as ({R._sql(R._DEGREES, 'customer')}),
  b as (select *, sinh({turn.format(v='lat', e=e)}) as t, radians(lon - 127.5) as lam from g),
  c as (select *, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) as eta from b),
  o as (select atan(sinh({turn.format(v='38.0', e=e)})) as xi0),
  m as (select id, lon, lat, 1000000 + 0.9996 * {radius} * {east('xi', 'eta')} as x, 2000000 + 0.9996 * {radius} * ({north('xi', 'eta')} - {north('xi0', '0.0')}) as y from c, o)
  select id, 'TM_X' as varname, cast(null as int) as year, round(x, 4) as value from m union all select id, 'TM_Y', null, round(y, 4) from m
  union all select id, 'WGS_X', null, round(lon, 4) from m union all select id, 'WGS_Y', null, round(lat, 4) from m"""


def _numbered(sql: str) -> str:
    """Keys into numbers of points."""
    return f"select id + 1 as id, * exclude id from ({sql})"


_CHAIN = f"""chain as (
  select id, 'D_Airport' as varname, year, value from ({_distance_sql('D_Airport', _stops_sql('airport', [2000, 2020]))})
  union all select id, 'D_Bus', year, value from ({_distance_sql('D_Bus', _stops_sql('bus_stop', [2020]))})
  union all select {R._POINTS['id']}, 'TM_X', null, {R._POINTS['x']} from customer union all select {R._POINTS['id']}, 'TM_Y', null, {R._POINTS['y']} from customer)"""

ORACLES = {
    "calc_airport": _numbered(_distance_sql("D_Airport", _stops_sql("airport"))),
    "calc_bus_stop": _numbered(_distance_sql("D_Bus", _stops_sql("bus_stop"))),
    "calc_railstation": _numbered(_distance_sql("D_Rail", _stops_sql("railstation", [2005, 2020]))),
    "calc_port": _numbered(_port_sql()),
    "calc_mdl": _numbered(_line_sql("D_North", YEARS["mdl"], 300, -700)),
    "calc_coastline": _numbered(_coast_sql()),
    "calc_river": _numbered(_river_sql()),
    "calc_road": _numbered(_line_sql("D_Road", YEARS["roads"], -150, 90)),
    "calc_main_road": _numbered(f"({_line_sql('D_MR1', YEARS['main_roads'], 500, -500)}) union all ({_line_sql('D_MR2', YEARS['main_roads'], 500, 500)})"),
    "calc_road_llw": _numbered(R._llw_sql(R._sql(R._ROADS, "orders"), "Road", R.ROAD_YEARS)),
    "calc_main_road_llw": _numbered(_main_llw_sql()),
    "calc_landuse": _numbered(_landuse_sql()),
    "calc_elevation": _numbered(f"({_ring_sql('dem')}) union all ({_ring_sql('dsm')})"),
    "calc_regions": _numbered(_region_sql()),
    "calc_coordinate": _numbered(_degrees_sql()),
    "calc_wide": f"""with {_CHAIN}, years as (select distinct year from chain),
      w as (select c_custkey as id, years.year, max(case when varname = 'D_Airport' then value end) as a, max(case when varname = 'D_Bus' then value end) as b,
        max(case when varname = 'TM_X' then value end) as x, max(case when varname = 'TM_Y' then value end) as y
        from customer cross join years left join chain on chain.id = c_custkey and chain.year is not distinct from years.year group by c_custkey, years.year)
      select row_number() over (order by id, w.year nulls last) as place, c_custkey as key, c_nationkey as year, id + 1 as id, w.year as year_, a as "D_Airport", b as "D_Bus", x as "TM_X", y as "TM_Y"
      from w join customer on c_custkey = id""",
    "calc_long": f"with {_CHAIN} select c_custkey as key, c_nationkey as year, id + 1 as id, varname, chain.year as year_, value from chain join customer on c_custkey = id",
    "long_order": f"with {_CHAIN} select row_number() over (order by id, year nulls last, varname) as place, id + 1 as id, year, varname from chain",
    "calc_sql": f"with {R._P} select id + 1 as id, 'X_km' as varname, 2020 as year, round(x / 1000, 3) as value from p where x > 1000000",
    "calc_chunks": f"with {R._P} select cast(floor(id / 70) as bigint) as chunk_id, count(*) as n, min(printf('POINT (%.1f %.1f)', x, y)) as first_wkt from p group by 1",
}
