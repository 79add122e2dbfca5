"""Queries of the general data-preparation operators over their whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.wkb import point_xy
from geoloom.operators.fill import Categorical, Numeric, fill_missing, filled_cells
from geoloom.operators.locate import containing, distinct_points, pairs_within
from geoloom.operators.wide import to_wide, unresolved_cells
from geoloom.session import cut_lineage

LANES, WIDTH, ELEVATION = Categorical("lanes", 1, 16), Numeric("width", 1.5, 80.0), Numeric("value", -50.0, 2500.0)

#: Metres within which two points are near each other.
NEAR = 25.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _roads(spark: SparkSession, d: str) -> DataFrame:
    """Roads, distinct records, with their class and the place where they start."""
    start = point_xy(F.col("geometry"))
    roads = table(spark, d, "roads").drop("loaded_at").withColumn("p", start)
    stretch = F.when(F.col("p.x").isNotNull(), F.concat_ws("_", F.round("p.x").cast("bigint"), F.round("p.y").cast("bigint")))
    roads = roads.withColumn("road_class", F.substring("road_no", 1, 1)).withColumn("stretch", stretch).drop("p", "geometry")
    return cut_lineage(roads.distinct())


def _fill_roads(roads: DataFrame) -> DataFrame:
    return fill_missing(roads, [LANES, WIDTH], [["road_class"], ["road_no"], ["stretch"]], time="year")


def roads_filled(spark: SparkSession, d: str) -> DataFrame:
    """Lanes and width filled by road class, route, stretch and year."""
    return _fill_roads(_roads(spark, d))


def _elevation_cells(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(table(spark, d, "aoi_elevation").drop("geometry").distinct())


def _fill_elevation(cells: DataFrame) -> DataFrame:
    levels = [["elev_type"]]
    made = {}
    for side in (7680, 1920, 480, 120):
        made |= {f"{axis}_{side}": F.floor(F.col(f"{axis}min") / side) for axis in "xy"}
        levels.append([f"x_{side}", f"y_{side}"])
    return fill_missing(cells.withColumns(made), [ELEVATION], levels)


def elevation_filled(spark: SparkSession, d: str) -> DataFrame:
    """Distinct elevation cells with values filled from ever smaller surroundings of the same surface."""
    return _fill_elevation(_elevation_cells(spark, d))


def p1_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How well known values are met when they are hidden: each tenth of them by a hash of the record, for every field."""
    out = None
    for name, rows, fill, fields in (
        ("roads", _roads(spark, d), _fill_roads, (LANES, WIDTH)),
        ("aoi_elevation", _elevation_cells(spark, d), _fill_elevation, (ELEVATION,)),
    ):
        for f in fields:
            hide = f.usable() & (F.pmod(F.xxhash64(*[c for c in rows.columns if c != f.column]), F.lit(10)) == 0)
            hidden = rows.withColumn("known", F.when(hide, F.col(f.column))).withColumn(f.column, F.when(~hide, F.col(f.column)))
            met = fill(hidden).where("known is not null").withColumn("off", F.abs(F.col("known") - F.col(f"{f.column}_value")))
            own = met.agg(F.count("*").alias("n_hidden"), F.avg((F.col("off") == 0).cast("int")).alias("share_equal"), F.avg("off").alias("mean_error"), F.stddev("known").alias("spread"))
            own = own.select(F.lit(name).alias("tbl"), F.lit(f.column).alias("field"), "*")
            out = own if out is None else out.unionByName(own)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    roads = filled_cells(roads_filled(spark, d), "id", ["lanes", "width"], "roads")
    return roads.unionByName(filled_cells(elevation_filled(spark, d), "cell_id", ["value"], "aoi_elevation"))


def p1_roads(spark: SparkSession, d: str) -> DataFrame:
    return roads_filled(spark, d).select("id", "year", "road_no", "lanes_value", "lanes_filled", "width_value", "width_filled")


def p1_elevation(spark: SparkSession, d: str) -> DataFrame:
    return elevation_filled(spark, d).select("cell_id", "elev_type", "value_value", "value_filled")


def p1_measured(spark: SparkSession, d: str) -> DataFrame:
    """Marks of every record, and its values where they were measured."""
    roads, cells = roads_filled(spark, d), elevation_filled(spark, d)
    kept = lambda c: F.when(~F.col(f"{c}_filled"), F.col(f"{c}_value"))
    rows = [
        df.where(F.col(key).isNotNull()).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), F.lit(c).alias("field"), F.col(f"{c}_filled").alias("filled"), kept(c).alias("measured"))
        for df, key, name, fields in ((roads, "id", "roads", ("lanes", "width")), (cells, "cell_id", "aoi_elevation", ("value",)))
        for c in fields
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct()


def wide(spark: SparkSession, d: str) -> DataFrame:
    return to_wide(table(spark, d, "result_df"), table(spark, d, "geovar_types"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unresolved_cells(wide(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    points = distinct_points(table(spark, d, "chunk"))
    refs = [("region", "aoi_oa", "tot_reg_cd"), ("landuse", "aoi_landuse", "landuse_id"), ("cell", "aoi_elevation", "cell_id")]
    polygons = None
    for kind, name, key in refs:
        own = table(spark, d, name).where(F.col(key).isNotNull()).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("ref"), "geometry")
        polygons = own if polygons is None else polygons.unionByName(own)
    inside = containing(points, polygons)
    near = pairs_within(points, NEAR).select(F.lit("point").alias("kind"), "id", F.col("other").cast("string").alias("other"))
    return near.unionByName(
        inside.select(
            F.substring_index("ref", ":", 1).alias("kind"), "id", F.expr("substring(ref, instr(ref, ':') + 1)").alias("other")
        )
    )


_BAD = "{c} is null or isnan({c}) or not ({c} between {lo} and {hi})"

_KEY = r"regexp_replace(regexp_replace(translate(replace(replace(lower({c}), ' ', ''), chr(9), ''), '-', '_'), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), 'x', 'x')"

_CELLS = f"""
facts as (
  select id, year, {_KEY.format(c='varname')} as k, case when not isnan(value) then value end as v from result_df where id is not null),
names as (select varname as name, {_KEY.format(c='varname')} as k, value_type from geovar_types),
cells as (
  select id, year, name, min(v) as lo, max(v) as hi,
    coalesce(bool_or(v is not null and ((value_type = 'int' and v <> floor(v)) or (value_type = 'boolean' and v not in (0, 1)))), false) as bad
  from facts left join names using (k) group by id, year, name)"""

_ATTRIBUTES = {
    "Altitude_k": "double",
    "D_North": "double",
    "In_Coast_1000": "boolean",
    "Lu_Code": "bigint",
    "N_Bus_0500": "bigint",
    "On_Bridge": "boolean",
    "Road_L_0100": "double",
    "TM_X": "double",
}


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """The whole wide table."""
    return wide(spark, d)


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the wide table, of all attributes, as a row again."""
    w = wide(spark, d)
    names = [c for c in w.columns if c not in ("id", "year", "unresolved")]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("varname"), F.col(n).cast("double").alias("value")) for n in names]))
    return w.select("id", "year", cells.alias("c")).select("id", "year", "c.varname", "c.value").where("value is not null")


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Checks every row of the wide table through sums per year over the eight attributes of ``_ATTRIBUTES``.

    Only ``n_unresolved`` covers all attributes of the catalogue; ``p3_wide`` returns them all.
    """
    w = wide(spark, d)
    sums = [
        F.count(n).alias(f"n_{n}") if t == "double" else F.sum(F.col(n).cast("bigint")).alias(f"s_{n}") for n, t in _ATTRIBUTES.items()
    ]
    return w.groupBy("year").agg(F.count("*").alias("n"), F.sum(F.size("unresolved")).cast("bigint").alias("n_unresolved"), *sums)


def _profile_sql() -> str:
    value = "max(case when name = '{n}' and not bad and hi - lo <= 0.001 then lo end) as {n}"
    columns = ", ".join(value.format(n=n) for n in _ATTRIBUTES)
    sums = ", ".join(f"count({n}) as n_{n}" if t == "double" else f"cast(sum({n}) as bigint) as s_{n}" for n, t in _ATTRIBUTES.items())
    return f"""with {_CELLS}, wide as (
      select id, year, {columns}, count(*) filter (name is not null and lo is not null and (bad or hi - lo > 0.001)) as open
      from cells group by id, year)
      select year, count(*) as n, cast(sum(open) as bigint) as n_unresolved, {sums} from wide group by year"""


QUERIES = {
    "p1_found": p1_found,
    "p1_roads": p1_roads,
    "p1_elevation": p1_elevation,
    "p1_held_out": p1_held_out,
    "p1_measured": p1_measured,
    "p3_found": p3_found,
    "p3_wide": p3_wide,
    "p3_cells": p3_cells,
    "p3_profile": p3_profile,
    "p4_found": p4_found,
}

ORACLES = {
    "p1_found": f"""
      select distinct 'roads' as tbl, id as row_id, 'lanes' as field from roads
      where id is not null and ({_BAD.format(c='lanes', lo=1, hi=16)} or lanes <> floor(lanes))
      union all select distinct 'roads', id, 'width' from roads where id is not null and ({_BAD.format(c='width', lo=1.5, hi=80)})
      union all select distinct 'aoi_elevation', cell_id, 'value' from aoi_elevation
      where cell_id is not null and ({_BAD.format(c='value', lo=-50, hi=2500)})""",
    "p3_found": f"""with {_CELLS}
      select distinct id, name as varname, coalesce(year, 0) as year from cells
      where name is not null and lo is not null and (bad or hi - lo > 0.001)""",
    "p3_profile": _profile_sql(),
    "p3_cells": f"with {_CELLS} select id, year, name as varname, lo as value from cells where name is not null and lo is not null and not bad and hi - lo <= 0.001",
    "p1_measured": " union ".join(
        f"select '{t}' as tbl, {key} as row_id, '{c}' as field, ({bad}) as filled, case when not ({bad}) then {c} end as measured from {t} where {key} is not null"
        for t, key, c, bad in (
            ("roads", "id", "lanes", f"{_BAD.format(c='lanes', lo=1, hi=16)} or lanes <> floor(lanes)"),
            ("roads", "id", "width", _BAD.format(c="width", lo=1.5, hi=80)),
            ("aoi_elevation", "cell_id", "value", _BAD.format(c="value", lo=-50, hi=2500)),
        )
    ),
}
