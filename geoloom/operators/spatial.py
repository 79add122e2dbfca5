"""Spatial joins as equi-joins on cells of grids whose sides are powers of two."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from geoloom.functions.kernels import segment_distance
from geoloom.session import cut_lineage, spread

#: Side of the finest cells in metres.
CELL = 64.0


def side_of(level: Column) -> Column:
    return F.lit(CELL) * F.pow(F.lit(2.0), level)


def level_of(extent: Column) -> Column:
    """Finest level whose cells are at least as wide as ``extent``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(CELL)) / CELL))).cast("int")


def _span(lo: str, hi: str, side: Column) -> Column:
    return F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join through a shuffle, whatever the sides' estimated sizes.

    Estimates know nothing of the rows that an explode makes, so a side that has
    grown to many times its table would be collected at the driver and broadcast.
    """
    return left.join(right.hint("merge"), list(on), how)


def box_join(left: DataFrame, right: DataFrame, *, finer: int = 2) -> DataFrame:
    """Every pair of a left and a right row whose boxes (lx0, ly0, lx1, ly1 and rx0, ry0, rx1, ry1) meet, once.

    Pairs meet on the right box's level, where it covers at most four cells, or
    ``finer`` levels below that of the left box if that is coarser; a left box
    then covers few cells, and these hold little more than what lies inside it.
    Of the cells a pair shares, only the one that holds the lower left corner of
    the boxes' overlap reports it.
    """
    width = lambda s: F.greatest(F.col(f"{s}x1") - F.col(f"{s}x0"), F.col(f"{s}y1") - F.col(f"{s}y0"))
    right = right.withColumn("__own", level_of(width("r")))
    left = left.withColumn("__min", F.greatest(F.lit(0), level_of(width("l")) - finer))
    # At most some thirty of each; a side takes its own level and those above that only the other side has of its own.
    lefts = {r[0] for r in left.select("__min").distinct().collect()}
    rights = {r[0] for r in right.select("__own").distinct().collect()}
    choices = lambda own, other: F.array_union(F.array(own), F.filter(F.array(*map(F.lit, sorted(other))).cast("array<int>"), lambda v: v > own))
    side = side_of(F.col("level"))
    keyed_left = left.withColumn("level", F.explode(choices(F.col("__min"), rights)))
    keyed_right = right.withColumn("level", F.explode(choices(F.col("__own"), lefts)))
    for axis in "xy":
        keyed_left = keyed_left.withColumn(f"c{axis}", F.explode(_span(f"l{axis}0", f"l{axis}1", side)))
        keyed_right = keyed_right.withColumn(f"c{axis}", F.explode(_span(f"r{axis}0", f"r{axis}1", side)))
    once = [F.floor(F.greatest(f"l{a}0", f"r{a}0") / side) == F.col(f"c{a}") for a in "xy"]
    meet = [(F.col(f"l{a}0") <= F.col(f"r{a}1")) & (F.col(f"r{a}0") <= F.col(f"l{a}1")) for a in "xy"]
    pairs = joined(keyed_left, keyed_right, ["level", "cx", "cy"])
    pairs = pairs.where(F.col("level") == F.greatest("__min", "__own")).where(reduce(lambda a, b: a & b, [*once, *meet]))
    return pairs.drop("level", "cx", "cy", "__min", "__own")


def buffers(points: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """(id, x, y, r, lx0, ly0, lx1, ly1): every point with every buffer size and the buffer's box."""
    rows = spread(points.select("id", "x", "y"), "id").withColumn("r", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    for axis in "xy":
        rows = rows.withColumn(f"l{axis}0", F.col(axis) - F.col("r")).withColumn(f"l{axis}1", F.col(axis) + F.col("r"))
    return rows


def cut_at_cells(segments: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Segments cut where they leave a grid cell, once per level: each piece, with its ends, lies in the cell (level, cx, cy).

    ``segments`` should lie spread over all cores.
    """
    rows = segments.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    side = side_of(F.col("level"))
    for a in "xy":
        start, run = F.col(f"{a}1"), F.col(f"{a}2") - F.col(f"{a}1")
        rows = rows.withColumns({"__from": F.floor(start / side), "__to": F.floor(F.col(f"{a}2") / side)})
        rows = rows.withColumn("__k", F.explode(F.sequence("__from", "__to")))  # the cells it passes, in its own direction
        enter, leave = (F.col("__k") + F.when(run > 0, k).otherwise(1 - k) for k in (0, 1))
        rows = rows.withColumns({
            "__t0": F.when(F.col("__k") == F.col("__from"), F.lit(0.0)).otherwise(F.try_divide(enter * side - start, run)),
            "__t1": F.when(F.col("__k") == F.col("__to"), F.lit(1.0)).otherwise(F.try_divide(leave * side - start, run)),
        })
        ends = {f"__{b}{k}": F.col(f"{b}1") + (F.col(f"{b}2") - F.col(f"{b}1")) * F.col(f"__t{k - 1}") for b in "xy" for k in (1, 2)}
        rows = rows.withColumns({f"c{a}": F.col("__k"), **ends}).drop("x1", "y1", "x2", "y2", "__from", "__to", "__k", "__t0", "__t1")
        rows = rows.withColumnsRenamed({n: n[2:] for n in ends})
    return rows


def _pieces(segments: DataFrame, by: Sequence[str], length: float) -> DataFrame:
    """Segments in pieces no longer than ``length``."""
    rows = spread(segments.select(*by, "x1", "y1", "x2", "y2"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / length)).cast("int")
    rows = rows.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    share = {k: F.try_divide(F.col("__i") + (k - 1), F.col("__n")) for k in (1, 2)}
    return rows.select(*by, *[(F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * share[k]).alias(f"{a}{k}") for k in (1, 2) for a in "xy"])


#: Pieces in a finest cell beyond which the search goes down to smaller cells, and how many levels further at most.
CROWDED, MAX_DEEPER = 64, 8


#: Pieces that a cell of the search may hold on average, and how many levels wider than the finest its cells are at most.
FEW, MAX_WIDER = 12, 10


def _search_side(segments: DataFrame, by: Sequence[str]) -> float:
    """Side of the cells, and length of the pieces, at which cells hold few pieces on average in every group.

    Lines that are long or far apart would else be cut to pieces many times as many as the lines.
    """
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    spans = [F.max(F.greatest(f"{a}1", f"{a}2")) - F.min(F.least(f"{a}1", f"{a}2")) for a in "xy"]
    facts = segments.groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).alias("l"), (spans[0] * spans[1]).alias("a"))
    n, length, area = (F.col(c).cast("double") for c in "nla")  # n side^2 + length side = FEW area
    side = facts.agg(F.min((F.sqrt(length * length + 4 * FEW * n * area) - length) / (2 * n))).first()[0]
    if side is None or not math.isfinite(side) or side <= CELL:
        return CELL
    return CELL * 2.0 ** min(MAX_WIDER, math.floor(math.log2(side / CELL)))


#: Cells in which a point starts its search at most, per group.
STARTS = 4


def _squared_gaps(q: Column) -> tuple[Column, Column]:
    """Squared distance from (x, y) to the extent ``q``, and one within which something that fills it surely lies."""
    least, near, far = [], [], []
    for a in "xy":
        low, high = F.col(a) - q[f"{a}l"], q[f"{a}h"] - F.col(a)
        gap = F.greatest(F.lit(0.0), -low, -high)
        least.append(gap * gap)
        near.append(F.least(low * low, high * high))
        far.append(F.greatest(low * low, high * high))
    # Every side of an extent is touched by some piece: the nearer side of one axis, somewhere along the other.
    return least[0] + least[1], F.least(near[0] + far[1], near[1] + far[0])


def nearest(points: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(id, by..., distance): distance to the nearest segment of each group of ``by``; no row where a group has none.

    Features are cut into pieces as long as a cell is wide and kept in a tree of
    cells, each with the extent of what it holds and eight times as wide as its
    children; the finest are as wide as lets them hold few pieces. The cells
    that a point lies in itself tell within what distance something surely is; its
    search starts in the few cells of about that size around it, or in the few
    widest. From there it descends the tree level by level, keeping only cells
    that may hold something nearer than what is sure to be found, and takes exact
    distances in the few finest cells that are left. How many cells a point keeps
    depends on how the features lie, not on how many they are or how far away.
    Features that are listed several times are kept once, and points at the same
    place are searched for once. Points without finite coordinates have no row.
    """
    by = list(by)
    segments = cut_lineage(segments.select(*by, "x1", "y1", "x2", "y2").distinct())
    mid = {a: (F.col(f"{a}1") + F.col(f"{a}2")) / 2 for a in "xy"}
    bounds = [f(g(f"{a}1", f"{a}2")).alias(f"{a}{n}") for a in "xy" for f, g, n in ((F.min, F.least, "l"), (F.max, F.greatest, "h"))]

    def gathered(pieces: DataFrame, side: float) -> tuple:
        pieces = pieces.withColumns({f"c{a}": F.floor(m / side) for a, m in mid.items()})
        cells = cut_lineage(pieces.groupBy(*by, "cx", "cy").agg(F.count("*").alias("n"), *bounds))
        facts = cells.agg(F.max("n"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
        return pieces, cells, facts[0], facts[1:]

    cut = side = _search_side(segments, by)
    pieces, cells, crowd, wide = gathered(_pieces(segments, by, cut), side)
    while crowd is not None and crowd > CROWDED and cut > CELL:  # features lie closer in places
        cut = side = max(CELL, cut / 2.0 ** math.ceil(math.log2(crowd / CROWDED)))
        pieces, cells, crowd, wide = gathered(_pieces(segments, by, cut), side)
    if crowd is None:
        nothing = StructType([*points.select("id").schema, *segments.select(*by).schema, StructField("distance", DoubleType())])
        return points.sparkSession.createDataFrame([], nothing)
    if crowd > CROWDED:
        deeper = min(MAX_DEEPER, math.ceil(math.log(crowd / CROWDED, 16)))
        side = CELL / 4.0**deeper
        pieces, cells, crowd, wide = gathered(pieces, side)
    top = 0
    while ((wide[1] >> 3 * top) - (wide[0] >> 3 * top) + 1) * ((wide[3] >> 3 * top) - (wide[2] >> 3 * top) + 1) > STARTS:
        top += 1
    extent = [f(f"{a}{n}").alias(f"{a}{n}") for a in "xy" for f, n in ((F.min, "l"), (F.max, "h"))]
    above = lambda k, names: [F.expr(f"shiftright(c{a}, 3 * {k})").alias(n) for a, n in zip("xy", names)]
    shown = ["qx", "qy", "xl", "xh", "yl", "yh"]
    starts: dict[tuple, list] = {}
    for r in cells.groupBy(*by, *above(top, ("qx", "qy"))).agg(*extent).collect():  # at most STARTS per group
        starts.setdefault(tuple(r[: len(by)]), []).append({n: r[n] for n in shown})
    kinds = dict(cells.dtypes)
    kids = "array<struct<qx: bigint, qy: bigint, xl: double, xh: double, yl: double, yh: double>>"
    ddl = f"array<struct<{''.join(f'`{n}`: {kinds[n]}, ' for n in by)}kids: {kids}>>"
    start = F.from_json(F.lit(json.dumps([{**dict(zip(by, key)), "kids": own} for key, own in starts.items()], default=str)), ddl)

    finite = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) != float("inf")) for a in "xy"]
    at, group = ["x", "y"], [f"__s.{n}" for n in by]
    slack = lambda c: c * (1 + 1e-9) + 1e-9
    points = points.select("id", *at).where(finite[0] & finite[1])
    near = points.select(*at).distinct()
    live = near.withColumn("__s", F.explode(start)).select(*at, *[F.col(g).alias(n) for g, n in zip(group, by)], F.col("__s.kids").alias("kids"))
    live = live.withColumn("within", F.array_min(F.transform("kids", lambda q: _squared_gaps(q)[1])))
    widest = F.transform(F.filter("kids", lambda q: _squared_gaps(q)[0] <= slack(F.col("within"))), lambda q: F.struct(q["qx"].alias("qx"), q["qy"].alias("qy")))
    tree, first = None, 0
    if top:
        up = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top))))
        kids = up.groupBy(*by, "k", *above("k", ("px", "py")), *above("(k - 1)", ("qx", "qy"))).agg(*extent)
        tree = cut_lineage(kids.groupBy(*by, "k", F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.collect_list(F.struct(*shown)).alias("kids")))
        own = near.withColumns({f"c{a}": F.floor(F.col(a) / side) for a in "xy"}).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top))))
        own = joined(own.select(*at, "k", *above("k", ("cx", "cy"))), tree, ["k", "cx", "cy"]).select(*at, *by, F.explode("kids").alias("q"))
        sure = own.select(*at, *by, _squared_gaps(F.col("q"))[1].alias("sure")).groupBy(*at, *by).agg(F.min("sure").alias("sure"))
        live = joined(live, sure, [*at, *by], "left").withColumn("within", F.least("within", "sure"))
        # Pieces are kept by their middle, which is at most half their length from any point of them.
        reach = F.sqrt(slack(F.col("within"))) + cut / 2 + 1e-3
        level = F.coalesce(*[F.when(F.col("reach") <= side * 8.0**k, k) for k in range(top)], F.lit(top))
        live = live.withColumn("reach", reach).withColumn("k", level)
        span = {a: _span(f"__{a}0", f"__{a}1", F.lit(side) * F.pow(F.lit(8.0), F.col("k"))) for a in "xy"}
        live = live.withColumns({f"__{a}{n}": F.col(a) + s * F.col("reach") for a in "xy" for n, s in ((0, -1), (1, 1))})
        around = F.flatten(F.transform(span["x"], lambda a: F.transform(span["y"], lambda b: F.struct(a.alias("qx"), b.alias("qy")))))  # at most nine
        live = live.withColumn("q", F.explode(F.when(F.col("k") < top, around).otherwise(widest)))
        live = cut_lineage(live.select(*at, *by, F.col("q.qx").alias("cx"), F.col("q.qy").alias("cy"), "within", "k"))
        first = live.agg(F.max("k")).first()[0] or 0
    else:
        live = live.withColumn("q", F.explode(widest)).select(*at, *by, F.col("q.qx").alias("cx"), F.col("q.qy").alias("cy"), "within", F.lit(0).alias("k"))
    step = None
    for k in range(first, -1, -1):
        here = live.where(F.col("k") == k).drop("k")
        here = here if step is None else here.unionByName(step)
        if not k:
            break
        step = joined(here, tree.where(F.col("k") == k).drop("k"), [*by, "cx", "cy"]).select(*at, *by, "within", F.explode("kids").alias("q"))
        low, high = _squared_gaps(F.col("q"))
        step = step.select(*at, *by, "within", "q.qx", "q.qy", low.alias("low"), high.alias("high")).where(F.col("low") <= slack(F.col("within")))
        step = step.groupBy(*at, *by).agg(F.min(F.least("high", "within")).alias("within"), F.collect_list(F.struct("low", "qx", "qy")).alias("q"))
        step = step.select(*at, *by, "within", F.explode("q").alias("q")).where(F.col("q.low") <= slack(F.col("within")))
        step = step.select(*at, *by, F.col("q.qx").alias("cx"), F.col("q.qy").alias("cy"), "within")
    ends = [F.col(c) - F.col(c[0]) for c in ("x1", "y1", "x2", "y2")]
    met = joined(here, pieces, [*by, "cx", "cy"])
    met = met.groupBy(*at, *by).agg(F.min(segment_distance(*ends)).alias("distance"))
    return joined(points, met, at).groupBy("id", *by).agg(F.min("distance").alias("distance"))


#: Partitions whose row counts may be broadcast; more are joined by a shuffle.
BROADCAST_PARTITIONS = 1_000_000


def row_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """``df`` with a 1-based number in input order, from per-partition counts instead of a global sort.

    Rows are kept in reliable storage first, so that counts and numbers see the
    same order. Only the counts of the partitions reach the driver.
    """
    part = F.shiftright("__m", 33)
    marked = cut_lineage(df.withColumn("__m", F.monotonically_increasing_id())).withColumn("__p", part)
    counts = pd.DataFrame(marked.groupBy("__p").count().orderBy("__p").collect(), columns=["__p", "n"])
    counts["__before"] = counts["n"].cumsum() - counts["n"]
    table = df.sparkSession.createDataFrame(counts[["__p", "__before"]].astype("int64"), "__p bigint, __before bigint")
    if len(counts) <= BROADCAST_PARTITIONS:
        table = F.broadcast(table)
    numbered = marked.join(table, "__p").withColumn(name, F.col("__before") + F.col("__m") - F.shiftleft("__p", 33) + 1)
    return numbered.select(*df.columns, name)


def distributed_rank(df: DataFrame, keys: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based rank by ``keys`` without a global window: rows are sorted in ranges of the keys, which are numbered one after the other."""
    return row_ids(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)
