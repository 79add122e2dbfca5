"""Queries of the geovariable engine, each with the same result in plain SQL.

Points and layers of the queries that have SQL are derived from integer keys by
the same arithmetic in both engines; those named ``layer_...`` run over the
tables that hold geometry.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import projection
from geoloom.functions.naming import ELEVATION
from geoloom.operators import chunking
from geoloom.operators.locate import distinct_points
from geoloom.operators.prepare import to_polygons, to_segments
from geoloom.operators.spatial import joined, row_ids
from geoloom.plans import finalise, variables
from geoloom.session import cut_lineage

X0, Y0 = 900_000, 1_800_000
ROAD_SIZES, LANDUSE_SIZES, OA_SIZES, RING_SIZES = [500.0, 2000.0], [1000.0, 3000.0], [1000.0, 5000.0], [300]
ROAD_YEARS = [2005, 2010, 2015, 2020]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(key: str, prime: int, origin: int, width: int = 200_000) -> str:
    return f"cast({origin} + ({key} * {prime}) % {width} as double)"


# The same expressions serve both engines.
_POINTS = {"id": "c_custkey", "x": _spread("c_custkey", 7919, X0), "y": _spread("c_custkey", 104729, Y0)}
_STOPS = {"year": "cast(2000 + 5 * (s_suppkey % 5) as int)", "x1": _spread("s_suppkey", 15485863, X0), "y1": _spread("s_suppkey", 32452843, Y0)}
_ROADS = {
    "fid": "o_orderkey",
    "year": "cast(2005 + 5 * (o_orderkey % 4) as int)",
    "lanes": "case when o_orderkey % 5 <> 0 then cast(1 + o_orderkey % 6 as double) end",
    "width": "cast(3 + o_orderkey % 4 as double)",
    "x1": _spread("o_orderkey", 49979687, X0),
    "y1": _spread("o_orderkey", 67867967, Y0),
    "x2": _spread("o_orderkey", 49979687, X0) + " + cast(o_orderkey % 401 - 200 as double)",
    "y2": _spread("o_orderkey", 67867967, Y0) + " + cast((o_orderkey * 7) % 401 - 200 as double)",
}
#: Road numbers as a main-road table lists them.
_LISTED = "array_repeat(o_orderkey, case when o_orderkey % 10 = 0 then 2 else 1 end)"
_PLOTS = {
    "fid": "p_partkey",
    "code": "cast(p_size % 7 as string)",
    "xmin": _spread("p_partkey", 86028121, X0),
    "ymin": _spread("p_partkey", 15487469, Y0),
    "xmax": _spread("p_partkey", 86028121, X0) + " + cast(100 + 20 * p_size as double)",
    "ymax": _spread("p_partkey", 15487469, Y0) + " + cast(140 + 10 * p_size as double)",
}
_REGIONS = {
    "fid": "cast(n_nationkey as bigint)",
    "tot_reg_cd": "n_name",
    "xmin": f"cast({X0} + (n_nationkey % 5) * 40000 as double)",
    "ymin": f"cast({Y0} + floor(n_nationkey / 5) * 40000 as double)",
    "xmax": f"cast({X0} + (n_nationkey % 5) * 40000 + 40000 as double)",
    "ymax": f"cast({Y0} + floor(n_nationkey / 5) * 40000 + 40000 as double)",
}
_NEAR_POINTS = {"id": "c_custkey", "x": _spread("c_custkey", 37, X0, 3000), "y": _spread("c_custkey", 53, Y0, 700)}
_CELLS = {
    "xmin": f"cast({X0} + 30 * (p_partkey % 100) as double)",
    "ymin": f"cast({Y0} + 30 * floor(p_partkey / 100) as double)",
    "xmax": f"cast({X0} + 30 * (p_partkey % 100) + 30 as double)",
    "ymax": f"cast({Y0} + 30 * floor(p_partkey / 100) + 30 as double)",
    "value": "case when p_partkey % 11 <> 0 then cast((p_partkey * 7919) % 160 as double) end",
}
_DEGREES = {
    "id": "c_custkey",
    "lon": "124.0 + cast((c_custkey * 7919) % 7000 as double) / 1000",
    "lat": "33.0 + cast((c_custkey * 104729) % 6000 as double) / 1000",
}


def _derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def _sql(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f"{e.replace('as string', 'as varchar')} as {n}" for n, e in columns.items()) + f" from {source}"


def points(spark: SparkSession, d: str) -> DataFrame:
    return _derived(table(spark, d, "customer"), _POINTS)


def _stops(spark: SparkSession, d: str) -> DataFrame:
    return _derived(table(spark, d, "supplier"), _STOPS).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})


def _roads(spark: SparkSession, d: str) -> DataFrame:
    return _derived(table(spark, d, "orders"), _ROADS)


def _boxes(df: DataFrame) -> DataFrame:
    """Rectangles as polygons, turned left."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]
    sides = [F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(e).alias("y2")) for (a, b), (c, e) in zip(corners, corners[1:] + corners[:1])]
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return df.withColumn("edges", F.array(*sides)).withColumn("feature_area", area)


def _rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select("id", "varname", "year", F.round("value", digits).alias("value"))


def distance_points(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(variables.distance(points(spark, d), _stops(spark, d), "D_Airport"))


def distance_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(variables.distance(points(spark, d), _roads(spark, d).select("year", "x1", "y1", "x2", "y2"), "D_Road"))


def road_llw(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(variables.line_lengths(points(spark, d), _roads(spark, d), ROAD_SIZES, ROAD_YEARS, "Road"))


def main_road_llw(spark: SparkSession, d: str) -> DataFrame:
    """Roads chosen by the numbers that a main-road table lists, 97 at most; a number listed twice counts twice."""
    chosen = table(spark, d, "supplier").selectExpr("s_suppkey * 3 % 97 as fid", "2020 as year")
    return _rounded(variables.line_lengths(points(spark, d), joined(_roads(spark, d).drop("year"), chosen, ["fid"]), ROAD_SIZES, [2020], "MR1"))


def main_road_llw_all(spark: SparkSession, d: str) -> DataFrame:
    """The same with a main-road table that lists every road, each tenth of them twice."""
    chosen = table(spark, d, "orders").selectExpr(f"explode({_LISTED}) as fid", "2020 as year")
    return _rounded(variables.line_lengths(points(spark, d), joined(_roads(spark, d).drop("year"), chosen, ["fid"]), ROAD_SIZES, [2020], "MR1"))


def landuse(spark: SparkSession, d: str) -> DataFrame:
    plots = _boxes(_derived(table(spark, d, "part"), _PLOTS))
    return _rounded(variables.landuse(points(spark, d), plots, LANDUSE_SIZES, 2020))


def region_overlap(spark: SparkSession, d: str) -> DataFrame:
    regions = _boxes(_derived(table(spark, d, "nation"), _REGIONS))
    out = variables.region_overlap(points(spark, d), regions, OA_SIZES)
    return out.withColumn("intersection_ratio", F.round("intersection_ratio", 7))


def elevation(spark: SparkSession, d: str) -> DataFrame:
    near = _derived(table(spark, d, "customer"), _NEAR_POINTS)
    return _rounded(variables.elevation(near, _derived(table(spark, d, "part"), _CELLS), RING_SIZES, "dem"), 6)


def coordinate(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to metres and back again."""
    at = _derived(table(spark, d, "customer"), _DEGREES)
    x, y = projection.project(F.col("lon"), F.col("lat"), projection.REFERENCE)
    return _rounded(variables.coordinates(at.select("id", x.alias("x"), y.alias("y"))), 4)


def result_wide(spark: SparkSession, d: str) -> DataFrame:
    """Distances and coordinates in one wide table, rows for every year also where only others have values."""
    p = points(spark, d)
    long = variables.distance(p, _stops(spark, d), "D_Airport")
    where = variables.coordinates(p).where("varname in ('TM_X', 'TM_Y')")
    wide = finalise.pivoted(long.unionByName(where), ["D_Airport", "TM_X", "TM_Y"])
    return wide.withColumn("D_Airport", F.round("D_Airport", 3))


def result_attached(spark: SparkSession, d: str) -> DataFrame:
    """Long results joined back to attributes that have an ``id`` and a ``year`` of their own."""
    attributes = table(spark, d, "customer").selectExpr("c_custkey as key", "c_name as id", "c_nationkey as year")
    return finalise.attached(attributes, finalise.ordered(_rounded(variables.distance(points(spark, d), _stops(spark, d), "D_Airport"))), "key")


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in input order are 1..n, once each."""
    n = row_ids(table(spark, d, "orders"), "no")
    return n.agg(F.count("*").alias("n"), F.count_distinct("no").alias("n_distinct"), F.min("no").alias("first"), F.max("no").alias("last"))


def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_order(points(spark, d), 100).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _chunk_check(chunks: DataFrame, size: int, reach: float | None) -> DataFrame:
    per = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"))
    wide = F.count(F.when(F.col("w") > (reach or math.inf), 1))
    return per.agg(F.sum("n").alias("n_points"), F.count(F.when(F.col("n") > size, 1)).alias("n_oversize"), wide.alias("n_wide"))


def chunk_closeness(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_check(chunking.by_closeness(points(spark, d), 5, 10_000.0), 5, 10_000.0)


def chunk_hilbert(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_check(chunking.by_hilbert(points(spark, d), 100), 100, None)


# Over the tables that hold geometry


def _chunk_points(spark: SparkSession, d: str) -> DataFrame:
    return distinct_points(table(spark, d, "chunk"))


def layer_distance(spark: SparkSession, d: str) -> DataFrame:
    segments = to_segments(table(spark, d, "roads").drop("loaded_at").distinct(), "year")
    return variables.distance(_chunk_points(spark, d), segments.drop("is_area"), "D_Road")


def layer_road_llw(spark: SparkSession, d: str) -> DataFrame:
    segments = to_segments(table(spark, d, "roads").drop("loaded_at").distinct(), "year", "lanes", "width")
    return variables.line_lengths(_chunk_points(spark, d), segments, [100.0, 500.0], ROAD_YEARS, "Road")


def layer_landuse(spark: SparkSession, d: str) -> DataFrame:
    """Every year that the layer has, with the codes of that year."""
    layer = table(spark, d, "aoi_landuse")
    years = sorted((r[0] for r in layer.select("year").distinct().collect()), key=lambda y: (y is None, y)) or [None]
    at = _chunk_points(spark, d)
    plots = {y: cut_lineage(to_polygons(layer.where(F.col("year").eqNullSafe(F.lit(y))).distinct(), "code")) for y in years}
    return reduce(DataFrame.unionByName, [variables.landuse(at, p, [100.0], y) for y, p in plots.items()])


def layer_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Both surfaces, each by itself."""
    layer, at = table(spark, d, "aoi_elevation"), _chunk_points(spark, d)
    cells = {k: layer.where(F.col("elev_type") == k).dropDuplicates(["cell_id"]) for k in ELEVATION}
    return reduce(DataFrame.unionByName, [variables.elevation(at, c, [100], k) for k, c in cells.items()])


def layer_region_overlap(spark: SparkSession, d: str) -> DataFrame:
    regions = to_polygons(table(spark, d, "aoi_oa").distinct(), "tot_reg_cd")
    return variables.region_overlap(_chunk_points(spark, d), regions, [500.0])


QUERIES = {
    "distance_points": distance_points,
    "distance_lines": distance_lines,
    "road_llw": road_llw,
    "main_road_llw": main_road_llw,
    "main_road_llw_all": main_road_llw_all,
    "landuse": landuse,
    "region_overlap": region_overlap,
    "elevation": elevation,
    "coordinate": coordinate,
    "result_wide": result_wide,
    "result_attached": result_attached,
    "row_numbers": row_numbers,
    "chunk_order": chunk_order,
    "chunk_closeness": chunk_closeness,
    "chunk_hilbert": chunk_hilbert,
    "layer_distance": layer_distance,
    "layer_road_llw": layer_road_llw,
    "layer_landuse": layer_landuse,
    "layer_elevation": layer_elevation,
    "layer_region_overlap": layer_region_overlap,
}

# SQL twins

_SQL_DISTANCE = """
  d as (select p.id, s.year, s.x1 - p.x as a_x, s.y1 - p.y as a_y, s.x2 - p.x as b_x, s.y2 - p.y as b_y from p, s),
  t as (select *, (b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y) as l2, -(a_x * (b_x - a_x) + a_y * (b_y - a_y)) as along from d),
  u as (select *, case when l2 > 0 then least(1.0, greatest(0.0, along / l2)) else 0.0 end as k from t),
  near as (select id, year, min(sqrt((a_x + k * (b_x - a_x)) * (a_x + k * (b_x - a_x)) + (a_y + k * (b_y - a_y)) * (a_y + k * (b_y - a_y)))) as value from u group by id, year)"""

_P = f"p as ({_sql(_POINTS, 'customer')})"
_S = f"s as (select *, x1 as x2, y1 as y2 from ({_sql(_STOPS, 'supplier')}))"
_R = f"s as ({_sql(_ROADS, 'orders')})"
_NORMALS = "n as (select k, cos((k + 0.5) * pi() / 16) as nx, sin((k + 0.5) * pi() / 16) as ny from range(32) as r(k))"


def _values(numbers, name: str, kind: str) -> str:
    return f"{name} as (select cast(unnest([{', '.join(map(str, numbers))}]) as {kind}) as {name[0]})"


def _llw_sql(roads: str, prefix: str, years: list[int]) -> str:
    return f"""with {_P}, s as ({roads}), {_NORMALS}, {_values(ROAD_SIZES, 'r_sizes', 'double')}, {_values(years, 'y_years', 'int')},
  g as (select id, x, y, r from p, r_sizes),
  e as (select row_number() over () as pair, g.id, g.r, s.year, s.lanes, s.width, s.x1 - g.x as a_x, s.y1 - g.y as a_y, s.x2 - g.x as b_x, s.y2 - g.y as b_y
    from g join s on least(s.x1, s.x2) <= g.x + g.r and greatest(s.x1, s.x2) >= g.x - g.r and least(s.y1, s.y2) <= g.y + g.r and greatest(s.y1, s.y2) >= g.y - g.r),
  h as (select e.*, nx * a_x + ny * a_y as a, nx * (b_x - a_x) + ny * (b_y - a_y) as b, r * cos(pi() / 32) as d from e, n),
  c as (select pair, id, r, year, lanes, width, any_value(sqrt((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y))) as len,
      greatest(0, max(case when b < 0 then (d - a) / b when b = 0 and a > d then 2 end)) as t0, least(1, min(case when b > 0 then (d - a) / b end)) as t1
    from h group by all),
  q as (select id, r, year, sum(len * greatest(0, coalesce(t1, 1) - coalesce(t0, 0))) as l, sum(len * greatest(0, coalesce(t1, 1) - coalesce(t0, 0)) * lanes) as ll,
      sum(len * greatest(0, coalesce(t1, 1) - coalesce(t0, 0)) * lanes * width) as llw from c group by all),
  f as (select g.id, g.r, y_years.y as year, coalesce(l, 0) as l, coalesce(ll, 0) as ll, coalesce(llw, 0) as llw
    from g cross join y_years left join q on q.id = g.id and q.r = g.r and q.year = y_years.y)
  select id, printf('{prefix}_L_%04d', cast(r as int)) as varname, year, round(l, 3) as value from f
  union all select id, printf('{prefix}_LL_%04d', cast(r as int)), year, round(ll, 3) from f
  union all select id, printf('{prefix}_LLW_%04d', cast(r as int)), year, round(llw, 3) from f"""


def _overlap_sql(sizes: list[float], boxes: str) -> str:
    """CTEs that end in ``o`` (id, r, box columns, overlap, meets) for every pair of a buffer and a box whose boxes meet."""
    return f"""{_P}, s as ({boxes}), {_values(sizes, 'r_sizes', 'double')},
  w as (select cos(k * pi() / 16) as ux, sin(k * pi() / 16) as uy, cos((k + 1) * pi() / 16) as vx, sin((k + 1) * pi() / 16) as vy,
      cos((k + 0.5) * pi() / 16) as nx, sin((k + 0.5) * pi() / 16) as ny from range(32) as q(k)),
  g as (select id, x, y, r from p, r_sizes),
  b as (select g.id, g.r, s.*, s.xmin - g.x as l, s.ymin - g.y as u, s.xmax - g.x as rr, s.ymax - g.y as o from g join s
    on s.xmin <= g.x + g.r and s.xmax >= g.x - g.r and s.ymin <= g.y + g.r and s.ymax >= g.y - g.r),
  e as (select id, r, fid, l as a_x, u as a_y, rr as b_x, u as b_y from b union all select id, r, fid, rr, u, rr, o from b
    union all select id, r, fid, rr, o, l, o from b union all select id, r, fid, l, o, l, u from b),
  f as (select *, a_x * b_y - a_y * b_x as c, a_x * nx + a_y * ny as fa, b_x * nx + b_y * ny as fb, ux * a_y - uy * a_x as ga, ux * b_y - uy * b_x as gb,
      vx * a_y - vy * a_x as ha, vx * b_y - vy * b_x as hb, r * cos(pi() / 32) as d from e, w),
  k as (select *, greatest(0, case when ga < 0 and gb >= 0 then ga / (ga - gb) when ga < 0 then 2 else 0 end, case when ha > 0 and hb <= 0 then ha / (ha - hb) when ha > 0 then 2 else 0 end) as t0,
      least(1, case when gb < 0 and ga >= 0 then ga / (ga - gb) when gb < 0 then -1 else 1 end, case when hb > 0 and ha <= 0 then ha / (ha - hb) when hb > 0 then -1 else 1 end) as t1 from f),
  i as (select *, fa + t0 * (fb - fa) as f0, fa + t1 * (fb - fa) as f1 from k where t1 > t0 and c <> 0),
  a as (select id, r, fid, sum(c * (t1 - t0) / 2 * case when f0 <= d and f1 <= d then 1 when f0 > d and f1 > d then d * d / (f0 * f1)
      when f0 <= d then (d - f0) / (f1 - f0) + (1 - (d - f0) / (f1 - f0)) * d / f1 else (d - f0) / (f1 - f0) * d / f0 + 1 - (d - f0) / (f1 - f0) end) as overlap
    from i group by id, r, fid)"""


def _krueger_sql() -> str:
    """Projection to metres, step by step."""
    tm = projection.SYSTEMS[projection.REFERENCE]
    radius, e, alpha, _ = projection._series(tm.ellipsoid)
    north = " + ".join(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    east = " + ".join(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""with g as ({_sql(_DEGREES, 'customer')}),
  a as (select *, sin(radians(lat)) as s, radians(lon - {tm.lon0}) as lam from g),
  b as (select *, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) as t from a),
  c as (select *, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) as eta from b),
  m as (select id, lon, lat, {tm.east} + {radius * tm.scale!r} * (eta + {east}) as x, {tm.north - tm.scale * projection._origin(tm)!r} + {radius * tm.scale!r} * (xi + {north}) as y from c)
  select id, 'TM_X' as varname, cast(null as int) as year, round(x, 4) as value from m union all select id, 'TM_Y', null, round(y, 4) from m
  union all select id, 'WGS_X', null, round(lon, 4) from m union all select id, 'WGS_Y', null, round(lat, 4) from m"""


_RING_SQL = f"""with p as ({_sql(_NEAR_POINTS, 'customer')}), s as (select xmin, ymin, xmax, ymax, coalesce(value, 0) as value from ({_sql(_CELLS, 'part')})), {_NORMALS},
  here as (select p.id, p.x, p.y, avg(s.value) as ref from p left join s on p.x between s.xmin and s.xmax and p.y between s.ymin and s.ymax group by p.id, p.x, p.y),
  b as (select row_number() over () as pair, h.id, h.ref, s.value, s.xmin - h.x as l, s.ymin - h.y as u, s.xmax - h.x as r, s.ymax - h.y as o from here h join s
    on s.xmin <= h.x + {RING_SIZES[0] + 30} and s.xmax >= h.x - {RING_SIZES[0] + 30} and s.ymin <= h.y + {RING_SIZES[0] + 30} and s.ymax >= h.y - {RING_SIZES[0] + 30}),
  t as (select pair, id, ref, value, bool_and(nx * case when nx > 0 then l else r end + ny * case when ny > 0 then u else o end <= {RING_SIZES[0] + 30} * cos(pi() / 32)) as meets,
      bool_and(nx * case when nx > 0 then r else l end + ny * case when ny > 0 then o else u end < {RING_SIZES[0]} * cos(pi() / 32)) as within from b, n group by pair, id, ref, value),
  c as (select id, avg(cast(value - ref > 20 as int)) as a20, avg(cast(value - ref < -20 as int)) as b20, avg(cast(value - ref > 50 as int)) as a50, avg(cast(value - ref < -50 as int)) as b50
    from t where meets and not within and ref is not null group by id)
  select id, 'Alt_k_above_20_{RING_SIZES[0]}' as varname, cast(null as int) as year, round(a20, 6) as value from c
  union all select id, 'Alt_k_below_20_{RING_SIZES[0]}', null, round(b20, 6) from c union all select id, 'Alt_k_above_50_{RING_SIZES[0]}', null, round(a50, 6) from c
  union all select id, 'Alt_k_below_50_{RING_SIZES[0]}', null, round(b50, 6) from c union all select id, 'Altitude_k', null, round(ref, 6) from here"""

_ALONE = f"with {_P}, {_S}, {_SQL_DISTANCE}"

ORACLES = {
    "distance_points": f"{_ALONE} select id, 'D_Airport' as varname, year, round(value, 3) as value from near",
    "distance_lines": f"with {_P}, {_R}, {_SQL_DISTANCE} select id, 'D_Road' as varname, year, round(value, 3) as value from near",
    "road_llw": _llw_sql(_sql(_ROADS, "orders"), "Road", ROAD_YEARS),
    "main_road_llw": _llw_sql(
        f"select a.* exclude year, 2020 as year from ({_sql(_ROADS, 'orders')}) a join (select s_suppkey * 3 % 97 as fid from supplier) b using (fid)", "MR1", [2020]
    ),
    "main_road_llw_all": _llw_sql(
        f"select a.* exclude year, 2020 as year from ({_sql(_ROADS, 'orders')}) a"
        " join (select o_orderkey as fid from orders union all select o_orderkey from orders where o_orderkey % 10 = 0) b using (fid)",
        "MR1",
        [2020],
    ),
    "landuse": f"""with {_overlap_sql(LANDUSE_SIZES, _sql(_PLOTS, 'part'))},
  q as (select a.id, a.r, s.code, sum(greatest(0, overlap)) as a, sum(greatest(0, overlap) / (a.r * a.r * 16 * sin(pi() / 16))) as p from a join s using (fid) group by all),
  z as (select g.id, g.r, codes.code, coalesce(q.a, 0) as a, coalesce(q.p, 0) as p from g cross join (select distinct code from s) codes left join q on q.id = g.id and q.r = g.r and q.code = codes.code)
  select id, printf('LS%s_%04d_a', code, cast(r as int)) as varname, 2020 as year, round(a, 3) as value from z
  union all select id, printf('LS%s_%04d_p', code, cast(r as int)), 2020, round(p, 3) from z""",
    "region_overlap": f"""with {_overlap_sql(OA_SIZES, _sql(_REGIONS, 'nation'))}, {_NORMALS},
  j as (select b.id, b.r, b.fid, b.tot_reg_cd, (xmax - xmin) * (ymax - ymin) as area from b, n group by b.id, b.r, b.fid, b.tot_reg_cd, xmin, xmax, ymin, ymax
    having bool_and(nx * case when nx > 0 then l else rr end + ny * case when ny > 0 then u else o end <= b.r * cos(pi() / 32)))
  select g.id, g.r as buffer_size, j.tot_reg_cd, round(coalesce(greatest(0, a.overlap) / j.area, 0), 7) as intersection_ratio
  from g left join j on j.id = g.id and j.r = g.r left join a on a.id = j.id and a.r = j.r and a.fid = j.fid""",
    "elevation": _RING_SQL,
    "coordinate": _krueger_sql(),
    "result_wide": f"""{_ALONE}, years as (select distinct year from near union all select null)
  select p.id, years.year, case when years.year is not null then round(near.value, 3) end as "D_Airport", case when years.year is null then x end as "TM_X", case when years.year is null then y end as "TM_Y"
  from p cross join years left join near on near.id = p.id and near.year = years.year""",
    "result_attached": f"""{_ALONE} select c_name as id, c_nationkey as year, near.year as year_, 'D_Airport' as varname, round(value, 3) as value
  from customer join near on near.id = c_custkey""",
    "row_numbers": "select count(*) as n, count(*) as n_distinct, 1 as first, count(*) as last from orders",
    "chunk_order": "select cast(floor((c_custkey - 1) / 100) as bigint) as chunk_id, count(*) as n, min(c_custkey) as first_id from customer group by 1",
    "chunk_closeness": "select count(*) as n_points, 0 as n_oversize, 0 as n_wide from customer",
    "chunk_hilbert": "select count(*) as n_points, 0 as n_oversize, 0 as n_wide from customer",
}
