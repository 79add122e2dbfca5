"""Grid density clustering in SQL terms.

Points are quantised to cells whose diagonal is the link distance, so all points
of a cell belong together; cells with enough points are dense; dense cells are
joined if some two of their points lie within the link distance; the smallest
label spreads over joined cells until nothing changes; and a cluster is
described by its size and by members of its densest cell.

Whether two cells join is settled by the extents of their points, then by those
of an eighth-cell grid, and only where both leave it open by the points
themselves, distinct places once each. After the first aggregation, work grows
with the number of occupied cells, not of points. Labels spread along links and
from label to label, so the number of rounds grows with the logarithm of a
chain's length; each round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut_lineage

#: Cells per axis into which a cell is divided where its extent does not settle a link.
FINE = 8
#: Clusters up to this size are measured inside one row; larger ones by merging convex hulls.
SMALL = 128
#: Points of one cluster whose hull one task makes.
HULL_POINTS = 50_000
#: Rounds after which spreading is taken to be broken; each at least doubles the reach of a label.
MAX_ROUNDS = 80


def usable_points(df: DataFrame, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Distinct (id, x, y) with an id and finite coordinates."""
    p = df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("x", "y")]
    return p.where(F.col("id").isNotNull() & finite[0] & finite[1]).distinct()



def _extents() -> list[Column]:
    return [F.min("x").alias("xl"), F.max("x").alias("xh"), F.min("y").alias("yl"), F.max("y").alias("yh")]


def _gap(a: str, b: str) -> Column:
    """Squared least distance of two extents."""
    d = [F.greatest(F.lit(0.0), F.col(f"{a}.{c}l") - F.col(f"{b}.{c}h"), F.col(f"{b}.{c}l") - F.col(f"{a}.{c}h")) for c in "xy"]
    return d[0] * d[0] + d[1] * d[1]


def _reach(a: str, b: str) -> Column:
    """Squared greatest distance of two extents."""
    d = [F.greatest(F.col(f"{a}.{c}h") - F.col(f"{b}.{c}l"), F.col(f"{b}.{c}h") - F.col(f"{a}.{c}l")) for c in "xy"]
    return d[0] * d[0] + d[1] * d[1]


def _links(points: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """(a, b) of dense cells, a before b, that hold two points within ``eps``. ``points`` are distinct places in dense cells."""
    e2 = eps * eps
    near = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0) and abs(i) + abs(j) < 4]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    shown = ["xl", "xh", "yl", "yh", "cx", "cy"]
    left = cells.select(F.struct(*shown).alias("a"), F.explode(offsets).alias("o")).select("a", (F.col("a.cx") + F.col("o.i")).alias("cx"), (F.col("a.cy") + F.col("o.j")).alias("cy"))
    right = cells.select(F.struct(*shown).alias("b"), "cx", "cy")
    pairs = left.join(right, ["cx", "cy"]).where(_gap("a", "b") <= e2)
    pairs = pairs.select(
        F.struct("a.cx", "a.cy").alias("a"), F.struct("b.cx", "b.cy").alias("b"), (_reach("a", "b") <= e2).alias("sure")
    )
    pairs = cut_lineage(pairs)
    sure = pairs.where("sure").select("a", "b")

    fine = points.groupBy("cx", "cy", "fx", "fy").agg(*_extents())
    side = lambda s: fine.select(F.struct("cx", "cy").alias(s), F.struct("fx", "fy", "xl", "xh", "yl", "yh").alias(f"{s}f"))
    open_fine = pairs.where("not sure").join(side("a"), "a").join(side("b"), "b").where(_gap("af", "bf") <= e2)
    open_fine = open_fine.select("a", "b", "af.fx", "af.fy", F.col("bf.fx").alias("gx"), F.col("bf.fy").alias("gy"), (_reach("af", "bf") <= e2).alias("sure"))
    settled = open_fine.where("sure").select("a", "b").distinct()
    rest = open_fine.where("not sure").join(settled, ["a", "b"], "left_anti")
    place = lambda s, f, g, x, y: points.select(F.struct("cx", "cy").alias(s), F.col("fx").alias(f), F.col("fy").alias(g), F.col("x").alias(x), F.col("y").alias(y))
    met = rest.join(place("a", "fx", "fy", "ax", "ay"), ["a", "fx", "fy"]).join(place("b", "gx", "gy", "bx", "by"), ["b", "gx", "gy"])
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    found = met.where(dx * dx + dy * dy <= e2).select("a", "b").distinct()
    return reduce(DataFrame.unionByName, [sure, settled, found])


def connected(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, label): the smallest cell of each cell's component. ``cells`` has cell, ``links`` a and b."""
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = both.select(F.col("a").alias("cell")).distinct()
    labels = cut_lineage(linked.withColumn("label", F.col("cell")))
    for _ in range(MAX_ROUNDS):
        # Along a link, the neighbour's label reaches a cell and the cell that gave it its label so far.
        seen = both.join(labels.select(F.col("cell").alias("b"), F.col("label").alias("new")), "b").join(labels.select(F.col("cell").alias("a"), "label"), "a")
        told = seen.where(F.col("new") < F.col("label")).select(F.explode(F.array("a", "label")).alias("cell"), "new")
        told = told.groupBy("cell").agg(F.min("new").alias("new"))
        moved = labels.join(told, "cell", "left").select("cell", F.least("label", "new").alias("label"), F.col("label").alias("old"))
        up = moved.select(F.col("cell").alias("label"), F.col("label").alias("next"))
        moved = cut_lineage(moved.join(up, "label").select("cell", F.least("label", "next").alias("label"), (F.least("label", "next") != F.col("old")).alias("changed")))
        labels = moved.select("cell", "label")
        if moved.where("changed").isEmpty():
            return cells.select("cell").join(labels, "cell", "left").select("cell", F.coalesce("label", "cell").alias("label"))
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def grid_clusters(df: DataFrame, eps: float, *, min_points: int = 1, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(cluster_id, id, x, y, cell, cell_count) of every usable point; cluster_id is the smallest id of the cluster.

    ``eps`` is the link distance; a cell is dense with at least ``min_points``
    ids. Points in other cells have a null cluster_id.

    Defined cases: rows with a null id or a null, NaN or infinite coordinate do
    not count; repeated rows count once; an id stated at two places counts at
    both; coincident points share a cell; an empty table gives an empty result;
    other columns are ignored.
    """
    side = eps / np.sqrt(2.0) * (1 - 1e-12)
    points = usable_points(df, id_col, x, y)
    floor = lambda c, s: F.floor(F.col(c) / s)
    points = cut_lineage(points.withColumns({"cx": floor("x", side), "cy": floor("y", side)}))
    cells = points.groupBy("cx", "cy").agg(F.count_distinct("id").alias("cell_count"), F.min("id").alias("least"), *_extents())
    dense = cut_lineage(cells.where(F.col("cell_count") >= min_points).withColumn("cell", F.struct("cx", "cy")))
    fine = {"fx": floor("x", side / FINE), "fy": floor("y", side / FINE)}
    places = points.join(dense.select("cx", "cy"), ["cx", "cy"], "left_semi").select("cx", "cy", "x", "y").distinct().withColumns(fine)
    labels = connected(dense, _links(places, dense, eps))
    known = dense.join(labels, "cell").select("cx", "cy", "cell", "cell_count", "least", "label")
    names = known.groupBy("label").agg(F.min("least").alias("cluster_id"))
    known = cut_lineage(known.join(names, "label").drop("label", "least"))
    return points.join(known, ["cx", "cy"], "left").select("cluster_id", "id", "x", "y", F.struct("cx", "cy").alias("cell"), "cell_count")


def describe(members: DataFrame, *, typical: int = 3, at_least: int = 1) -> DataFrame:
    """(cluster_id, size, densest, typical_ids): the ids of the densest cell nearest to its mean, ties by the smaller id.

    ``typical`` is the number of ids reported; they come out in that order.
    Clusters of fewer than ``at_least`` ids are left out.
    """
    inside = members.where(F.col("cluster_id").isNotNull())
    cells = inside.groupBy("cluster_id", "cell").agg(F.max("cell_count").alias("count"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    best = F.struct(F.col("count"), F.struct((-F.col("cell.cx")).alias("cx"), (-F.col("cell.cy")).alias("cy"), "mx", "my"))
    best = cells.groupBy("cluster_id").agg(F.max(best).alias("m")).select(
        "cluster_id", F.col("m.count").alias("densest"), F.struct((-F.col("m.col2.cx")).alias("cx"), (-F.col("m.col2.cy")).alias("cy")).alias("cell"), "m.col2.mx", "m.col2.my"
    )
    away = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    ranked = inside.select("cluster_id", "cell", "id", "x", "y").join(best, ["cluster_id", "cell"]).select("cluster_id", "densest", "id", away.alias("away"))
    order = Window.partitionBy("cluster_id").orderBy("away", "id")
    top = ranked.withColumn("no", F.row_number().over(order)).where(F.col("no") <= typical)
    ids = top.groupBy("cluster_id").agg(F.max("densest").alias("densest"), F.sort_array(F.collect_list(F.struct("no", "id"))).alias("t"))
    ids = ids.select("cluster_id", "densest", F.col("t.id").alias("typical_ids"))
    size = inside.groupBy("cluster_id").agg(F.count_distinct("id").alias("size")).where(F.col("size") >= at_least)
    return size.join(ids, "cluster_id")


def _hull(pdf: pd.DataFrame) -> np.ndarray:
    """Convex hull of the points, by the monotone chain."""
    pts = sorted(set(zip(pdf["x"], pdf["y"])))
    if len(pts) < 3:
        return np.array(pts)

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _part_hull(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    h = _hull(pdf)
    return pd.DataFrame({"cluster_id": key[0], "x": h[:, 0], "y": h[:, 1]})


def _diameter(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    h = _hull(pdf)
    d2 = max(float(((h - p) ** 2).sum(axis=1).max()) for p in h)
    return pd.DataFrame({"cluster_id": [key[0]], "diameter": [d2**0.5]})


def compact_groups(members: DataFrame, eps: float, *, at_least: int = 3) -> DataFrame:
    """(cluster_id, id) of clusters of ``at_least`` ids of which any two lie within ``eps``.

    Members of ``grid_clusters`` with one point per cell suffice: clusters are
    then linked exactly at ``eps``, so no other id lies within ``eps`` of a
    group, and a group is a cluster whose diameter is at most ``eps``.
    """
    m = members.where(F.col("cluster_id").isNotNull())
    size = m.groupBy("cluster_id").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("n"), *_extents())
    size = size.where((F.col("ids") >= at_least) & (F.col("xh") - F.col("xl") <= eps) & (F.col("yh") - F.col("yl") <= eps)).select("cluster_id", "n")
    m = cut_lineage(m.select("cluster_id", "id", "x", "y").join(size, "cluster_id"))

    far = lambda a, b: F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) > eps * eps
    small = m.where(F.col("n") <= SMALL).groupBy("cluster_id").agg(F.collect_list(F.struct("id", "x", "y")).alias("p"))
    small = small.where(~F.exists("p", lambda a: F.exists("p", lambda b: far(a, b)))).select("cluster_id", F.explode("p.id").alias("id"))

    large = m.where(F.col("n") > SMALL)
    salt = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / HULL_POINTS)))
    hulls = large.withColumn("salt", salt).groupBy("cluster_id", "salt").applyInPandas(_part_hull, "cluster_id long, x double, y double")
    close = hulls.groupBy("cluster_id").applyInPandas(_diameter, "cluster_id long, diameter double").where(F.col("diameter") <= eps)
    return small.unionByName(large.join(close, "cluster_id", "left_semi").select("cluster_id", "id")).distinct()
