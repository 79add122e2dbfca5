"""The geovariables as plans over prepared layers; all but region overlap give (id, varname, year, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import kernels as K
from geoloom.functions.naming import ELEVATION, padded, plain
from geoloom.functions.projection import unproject
from geoloom.operators.overlay import overlay
from geoloom.operators.spatial import CELL, box_join, buffers, cut_at_cells, joined, nearest, side_of
from geoloom.session import cut_lineage, spread

RING = 30.0
#: Elevation differences in metres beyond which ring cells are counted, and their names.
THRESHOLDS = (("above_20", 20.0), ("below_20", -20.0), ("above_50", 50.0), ("below_50", -50.0))


def _long(df: DataFrame, names: dict[str, Column], year: Column) -> DataFrame:
    """Columns into rows; null values are left out."""
    kinds = F.explode(F.array(*[F.struct(n.alias("varname"), F.col(c).cast("double").alias("value")) for c, n in names.items()]))
    rows = df.select("id", year.cast("int").alias("year"), kinds.alias("k"))
    return rows.select("id", "k.varname", "year", "k.value").where(F.col("value").isNotNull())


def _label(sizes: Sequence[float], text) -> Column:
    """Label of column ``r`` by a literal lookup."""
    pairs = {float(s): text(s) for s in sizes}
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.col("r"))


def _place() -> Column:
    """Key of a point's place; 0 has one sign."""
    return F.struct(*[(F.col(a) + F.lit(0.0)).alias(a) for a in "xy"])


def _places(points: DataFrame) -> DataFrame:
    """(id, x, y): every place of the points once, with itself as id."""
    return points.select(_place().alias("id")).distinct().select("id", "id.x", "id.y")


def _at_points(points: DataFrame, found: DataFrame) -> DataFrame:
    """What was found at places, for every point there; points of places without any stay."""
    return joined(points.select(F.col("id").alias("__point"), _place().alias("id")), found, ["id"], "left").drop("id").withColumnRenamed("__point", "id")


def distance(points: DataFrame, segments: DataFrame, name: str) -> DataFrame:
    """Distance to the nearest feature per year; 0 inside an area; no row for years without features."""
    found = nearest(points, segments, ["year"])
    areas = segments.where("is_area") if "is_area" in segments.columns else None
    if areas is not None:
        ends = ["x1", "y1", "x2", "y2"]
        # Areas that are listed several times are kept once, and points at the same place are looked up once.
        shapes = areas.groupBy("year", "fid").agg(F.sort_array(F.collect_list(F.struct(*ends))).alias("edges"))
        shapes = cut_lineage(shapes.groupBy("year", "edges").agg(F.min("fid").alias("fid")))
        edges = shapes.select("year", "fid", F.explode("edges").alias("e")).select("year", "fid", "e.*")
        extent = [f(F.transform("edges", lambda e: g(e[f"{a}1"], e[f"{a}2"]))) for f, g in ((F.array_min, F.least), (F.array_max, F.greatest)) for a in "xy"]  # noqa: B023
        boxes = shapes.select("year", "fid", *[e.alias(n) for e, n in zip(extent, ("rx0", "ry0", "rx1", "ry1"))])
        places = points.select("x", "y").where("x is not null and y is not null").distinct()
        at = places.select("x", "y", F.col("x").alias("lx0"), F.col("y").alias("ly0"), F.col("x").alias("lx1"), F.col("y").alias("ly1"))
        hit = joined(box_join(at, boxes).select("x", "y", "year", "fid"), edges, ["year", "fid"])
        crossing = K.ray_crossing(*[F.col(c) - F.col(c[0]) for c in ends])
        inside = hit.groupBy("x", "y", "year", "fid").agg(F.sum(crossing.cast("int")).alias("n")).where("n % 2 = 1").select("x", "y", "year").distinct()
        inside = joined(points.select("id", "x", "y"), inside, ["x", "y"]).select("id", "year", F.lit(0.0).alias("__in")).distinct()
        found = joined(found, inside, ["id", "year"], "left").withColumn("distance", F.coalesce("__in", "distance"))
    return found.select("id", F.lit(name).alias("varname"), F.col("year").cast("int").alias("year"), F.col("distance").alias("value"))


def _grid_level(size: float, cells: int) -> int:
    """Finest level of which at most about ``cells`` cells make up ``size``."""
    return max(0, math.ceil(math.log2(size / cells / CELL))) if size > 0 else 0


def _level_by_size(sizes: Sequence[float], cells: int) -> Column:
    pairs = {float(s): _grid_level(float(s), cells) for s in sizes}
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.col("r"))


#: Levels between cells of buffers and those that tell first where there is anything at all.
BLOCK = 3


def _buffer_cells(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Grid cells (cx, cy) of column ``level`` near the buffer r around (x, y), and whether they lie inside it.

    Only those in ``blocks`` (level, bx, by), which are cells ``BLOCK`` levels up; a buffer meets few of these.
    """
    side = side_of(F.col("level"))
    for a in "xy":
        rows = rows.withColumns({f"__{a}0": F.floor((F.col(a) - F.col("r")) / side), f"__{a}1": F.floor((F.col(a) + F.col("r")) / side)})
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.shiftright(f"__{a}0", BLOCK), F.shiftright(f"__{a}1", BLOCK))))
    rows = joined(rows, blocks, ["level", "bx", "by"])
    for a in "xy":
        first, last = F.shiftleft(f"b{a}", BLOCK), F.shiftleft(f"b{a}", BLOCK) + (2**BLOCK - 1)
        rows = rows.withColumn(f"c{a}", F.explode(F.sequence(F.greatest(f"__{a}0", first), F.least(f"__{a}1", last))))
    low = {a: F.col(f"c{a}") * side - F.col(a) for a in "xy"}
    high = {a: (F.col(f"c{a}") + 1) * side - F.col(a) for a in "xy"}
    near = F.hypot(*[F.greatest(F.lit(0.0), low[a], -high[a]) for a in "xy"])
    far = F.hypot(*[F.greatest(-low[a], high[a]) for a in "xy"])
    return rows.where(near <= F.col("r")).withColumn("inside", far < F.col("r") * K.APOTHEM)


def line_lengths(points: DataFrame, segments: DataFrame, sizes: Sequence[float], years: Sequence[int], prefix: str) -> DataFrame:
    """Length, lane length and lane-width length of lines inside buffers, 0 where there are none.

    ``segments`` has year, lanes, width and the ends. Missing lanes or widths
    drop out of the sums that need them only. Lines are cut at grid cells that
    match the buffer sizes and summed up per cell; cells inside a buffer count
    by their sums, and only pieces in cells at its rim are clipped. Lines that
    are listed several times are kept once, with how often they count, and
    points at the same place are looked up once.
    """
    round_ = buffers(_places(points), sizes).select("id", "x", "y", "r")
    levels = sorted({_grid_level(float(s), 4) for s in sizes})
    keys = ["level", "cx", "cy"]
    same = ["year", "lanes", "width", "x1", "y1", "x2", "y2"]
    lines = spread(segments.select(*same), *same).groupBy(*same).agg(F.count("*").cast("double").alias("times"))
    pieces = cut_at_cells(lines, levels)
    blocks = cut_at_cells(lines.select(*same[3:]), [v + BLOCK for v in levels])
    blocks = blocks.select((F.col("level") - BLOCK).alias("level"), F.col("cx").alias("bx"), F.col("cy").alias("by")).distinct()
    terms = lambda n: [n, n * F.col("lanes"), n * F.col("lanes") * F.col("width")]
    names = ["L", "LL", "LLW"]
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    per_cell = pieces.groupBy(*keys, "year").agg(*[F.sum(t).alias(n) for t, n in zip(terms(length * F.col("times")), names)])

    cells = _buffer_cells(round_.withColumn("level", _level_by_size(sizes, 4)), blocks)
    whole = joined(cells.where("inside").select("id", "r", *keys), per_cell, keys).select("id", "r", "year", *names)
    rim = joined(cells.where("not inside").select("id", "x", "y", "r", *keys), pieces, keys)
    ends = [F.col(c) - F.col(c[0]) for c in ("x1", "y1", "x2", "y2")]
    rim = rim.select("id", "r", "year", "lanes", "width", (K.clipped_length(*ends, F.col("r")) * F.col("times")).alias("len"))
    rim = rim.select("id", "r", "year", *[t.alias(n) for t, n in zip(terms(F.col("len")), names)])
    sums = whole.unionByName(rim).groupBy("id", "r", "year").agg(*[F.sum(n).alias(n) for n in names])
    found = sums.groupBy("id").agg(F.collect_list(F.struct("r", "year", *names)).alias("__found"))  # one for each size and year at most
    kept = _at_points(points, found)
    listed = kept.select("*", F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("r")).select("*", F.explode(F.array(*map(F.lit, years))).alias("year"))
    own = F.get(F.filter("__found", lambda f: (f["r"] == F.col("r")) & (f["year"] == F.col("year"))), F.lit(0))
    full = listed.withColumn("__own", own).select("id", "r", "year", *[F.coalesce(F.col(f"__own.{c}"), F.lit(0.0)).alias(c) for c in names])
    label = _label(sizes, padded)
    return _long(full, {c: F.concat(F.lit(f"{prefix}_{c}_"), label) for c in names}, F.col("year"))


def _overlaps(points: DataFrame, polygons: DataFrame, sizes: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """(id, r, keep..., overlap) per pair of a buffer and a polygon part that meet."""
    boxes = spread(polygons, "fid").withColumnsRenamed({"xmin": "rx0", "ymin": "ry0", "xmax": "rx1", "ymax": "ry1"})
    boxes = boxes.withColumn("__poly", F.xxhash64("fid", "rx0", "ry0", "rx1", "ry1"))
    pairs = box_join(buffers(points, sizes), boxes).where("r > 0")
    edges = pairs.select("id", "x", "y", "r", "__poly", *keep, F.explode("edges").alias("e"))
    ends = [F.col(f"e.{c}") - F.col(c[0]) for c in ("x1", "y1", "x2", "y2")]
    edges = edges.select("id", "r", "__poly", *keep, *[e.alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"))])
    own = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    keys = ["id", "r", "__poly", *keep]
    overlap = F.greatest(F.lit(0.0), F.coalesce(F.sum("area"), F.lit(0.0))).alias("overlap")
    # An edge makes several rows, one per wedge; what is said of the edge itself counts in the first.
    enter, leave = K.clip(*own, F.col("r"))
    edges = edges.withColumn("__hit", enter <= leave).withColumn("__odd", K.ray_crossing(*own).cast("int"))
    rows = K.with_wedge_area(edges, number="__no")
    odd = F.sum(F.when(F.coalesce("__no", F.lit(0)) == 0, F.col("__odd")).otherwise(0)) % 2 == 1
    met = rows.groupBy(*keys).agg(overlap, (F.max("__hit") | F.coalesce(odd, F.lit(False))).alias("__met"))
    return met.where("__met").select("id", "r", *keep, "overlap")


def landuse(points: DataFrame, polygons: DataFrame, sizes: Sequence[float], year: int, listed: DataFrame | None = None) -> DataFrame:
    """Area and share of every land-use code inside buffers; every code of the layer for every point, 0 where absent.

    ``polygons`` has a code, or in ``codes`` those that a shape is listed with and
    how often. ``listed`` has the codes if they are only those near the points.
    Points at the same place are looked up once.
    """
    several = "codes" in polygons.columns
    named = polygons.select(F.explode("codes.code").alias("code")) if several and listed is None else polygons if listed is None else listed
    codes = sorted(r[0] for r in named.select(F.col("code").cast("string").alias("code")).where("code is not null").distinct().collect())  # a land-use classification
    if not codes:
        return points.select("id", F.lit("").alias("varname"), F.lit(year).cast("int").alias("year"), F.lit(0.0).alias("value")).where(F.lit(False))
    number = lambda c: (F.array_position(F.array(*map(F.lit, codes)), c.cast("string")) - 1).cast("int").alias("code")
    once = lambda c, n: F.struct(number(c), n.cast("double").alias("times"))
    own = F.transform(F.filter("codes", lambda c: c["code"].isNotNull()), lambda c: once(c["code"], c["times"])) if several else F.array(once(F.col("code"), F.lit(1)))
    shapes = polygons if several else polygons.where("code is not null")
    shapes = cut_lineage(shapes.select("edges", own.alias("codes"), "xmin", "ymin", "xmax", "ymax"))
    finite = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) != float("inf")) for a in "xy"]
    places = cut_lineage(_places(points).where(finite[0] & finite[1]))
    n, each = len(codes) * len(sizes), [(c, float(s)) for c in codes for s in sizes]
    sums = overlay(places, shapes, sizes, len(codes)).groupBy("x", "y", "k").agg(F.sum("a").alias("a"))
    sums = sums.groupBy(_place().alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "a"))).alias("m"))  # one for each code and size at most
    found = sums.select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("areas"))
    full = _at_points(points, found).select("id", F.posexplode(F.coalesce("areas", F.array_repeat(F.lit(0.0), n))).alias("k", "a"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("k"))
    full = full.withColumn("p", F.coalesce(F.try_divide("a", of([s * s * K.UNIT_AREA for _, s in each])), F.lit(0.0)))
    return _long(full, {v: of([f"LS{c}_{padded(s)}_{v}" for c, s in each]) for v in ("a", "p")}, F.lit(year))


def region_overlap(points: DataFrame, polygons: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """(id, buffer_size, tot_reg_cd, intersection_ratio): share of every touched region that lies in the buffer.

    A buffer that touches none has one row with a null code and ratio 0.
    """
    found = _overlaps(points, polygons, sizes, ["fid", "tot_reg_cd", "feature_area"])
    ratio = found.groupBy("id", "r", "fid", "tot_reg_cd").agg((F.sum("overlap") / F.max("feature_area")).alias("ratio"))
    grid = buffers(points, sizes).select("id", "r")
    full = joined(grid, ratio, ["id", "r"], "left")
    return full.select("id", F.col("r").alias("buffer_size"), "tot_reg_cd", F.coalesce("ratio", F.lit(0.0)).alias("intersection_ratio"))


def _ring_cells(rows: DataFrame, widest: float) -> DataFrame:
    """Grid cells (cx, cy) of column ``level`` that may hold the middle of a box that meets the ring around (x, y), column by column."""
    side, slack = side_of(F.col("level")), widest  # a box reaches less than its width beyond its middle
    outer, inner = F.col("r") + RING + slack, F.greatest(F.lit(0.0), F.col("r") * K.APOTHEM - slack)
    rows = rows.withColumn("cx", F.explode(F.sequence(F.floor((F.col("x") - outer) / side), F.floor((F.col("x") + outer) / side))))
    low, high = F.col("cx") * side - F.col("x"), (F.col("cx") + 1) * side - F.col("x")
    near, far = F.greatest(F.lit(0.0), low, -high), F.greatest(-low, high)
    rows = rows.withColumns({"__a": F.sqrt(F.greatest(F.lit(0.0), outer * outer - near * near)), "__b": F.sqrt(F.greatest(F.lit(0.0), inner * inner - far * far))})
    at = lambda v: F.floor((F.col("y") + v) / side)
    first, last = at(-F.col("__a")), at(F.col("__a"))
    below, above = at(-F.col("__b")), F.ceil((F.col("y") + F.col("__b")) / side) - 1  # cells between these lie inside
    two = F.concat(F.sequence(first, below), F.sequence(above, last))
    rows = rows.withColumn("cy", F.explode(F.when(above > below + 1, two).otherwise(F.sequence(first, last))))
    return rows.drop("__a", "__b")


def elevation(points: DataFrame, cells: DataFrame, sizes: Sequence[float], kind: str) -> DataFrame:
    """Elevation at each point, and shares of the cells around a ring that lie above or below it.

    ``cells`` has xmin, ymin, xmax, ymax and value, of which a missing one is 0.
    The elevation is the mean of the cells that touch the point. The year is null.
    Buffers look up only grid cells that their ring crosses.
    """
    letter = ELEVATION[kind]
    cells = cells.select(
        F.col("xmin").alias("rx0"), F.col("ymin").alias("ry0"), F.col("xmax").alias("rx1"), F.col("ymax").alias("ry1"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")
    )
    at = points.select("id", F.col("x").alias("lx0"), F.col("y").alias("ly0"), F.col("x").alias("lx1"), F.col("y").alias("ly1"))
    here = box_join(at, cells).groupBy("id").agg(F.avg("value").alias("ref"))
    here = joined(points.select("id"), here, ["id"], "left")

    widest = cells.agg(F.max(F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")))).first()[0] or 0.0
    around = buffers(points, sizes).select("id", "x", "y", "r").join(here.hint("merge"), "id").where("ref is not null")
    keyed = cells.withColumn("level", F.explode(F.array(*map(F.lit, sorted({_grid_level(float(s), 64) for s in sizes}))).cast("array<int>")))
    side = side_of(F.col("level"))
    keyed = keyed.withColumns({f"c{a}": F.floor((F.col(f"r{a}0") + F.col(f"r{a}1")) / 2 / side) for a in "xy"})
    pairs = _ring_cells(around.withColumn("level", _level_by_size(sizes, 64)), widest).join(keyed.hint("merge"), ["level", "cx", "cy"])
    box = [F.col(c) - F.col(a) for c, a in (("rx0", "x"), ("ry0", "y"), ("rx1", "x"), ("ry1", "y"))]
    ring = pairs.where(K.box_meets_ring(*box, F.col("r"), F.col("r") + RING))
    rise = F.col("value") - F.col("ref")
    tests = [F.avg(((rise > t) if t > 0 else (rise < t)).cast("int")).alias(n) for n, t in THRESHOLDS]
    shares = ring.groupBy("id", "r").agg(*tests)
    labels = plain(sizes)
    label = _label(sizes, lambda s: labels[float(s)])
    names = {n: F.concat(F.lit(f"Alt_{letter}_{n}_"), label) for n, _ in THRESHOLDS}
    reference = here.select("id", F.lit(f"Altitude_{letter}").alias("varname"), F.lit(None).cast("int").alias("year"), F.col("ref").alias("value"))
    return _long(shares, names, F.lit(None)).unionByName(reference)


def coordinates(points: DataFrame, epsg: int = 5179) -> DataFrame:
    """Projected and geographic coordinates of each point; the year is null."""
    lon, lat = unproject(F.col("x"), F.col("y"), epsg)
    full = points.select("id", lon.alias("WGS_X"), lat.alias("WGS_Y"), F.col("x").alias("TM_X"), F.col("y").alias("TM_Y"))
    return _long(full, {c: F.lit(c) for c in ("WGS_X", "WGS_Y", "TM_X", "TM_Y")}, F.lit(None))
