"""Closed forms of the overlays the engine needs, as column expressions.

Every buffer is that of a point: a regular polygon of 32 corners, the first due
east. With the point as origin, its corners lie at k/32 of the circle, its sides
are n_k . p = d with n_k half-way between them and d = r cos(pi/32). No geometry
is ever materialised; each kernel gives the measure that is wanted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = 32
STEP = 2 * math.pi / SIDES
APOTHEM = math.cos(STEP / 2)
#: Area of the buffer of radius 1.
UNIT_AREA = SIDES / 2 * math.sin(STEP)


def _normal(k: int) -> tuple[float, float]:
    return math.cos((k + 0.5) * STEP), math.sin((k + 0.5) * STEP)


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def buffer_area(r: Column) -> Column:
    return r * r * UNIT_AREA


def segment_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from the origin to a segment, which may be a single point."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-(x1 * dx + y1 * dy), length2)))).otherwise(F.lit(0.0))
    return F.hypot(x1 + t * dx, y1 + t * dy)


def _normals(n: int) -> Column:
    """The first ``n`` side normals as one constant. Looping over it keeps generated methods short enough to be compiled."""
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in map(_normal, range(n))])


def clip(x1: Column, y1: Column, x2: Column, y2: Column, r: Column) -> tuple[Column, Column]:
    """Parameters between which a segment runs inside the buffer; the first exceeds the second if it doesn't."""
    t = clip_range(x1, y1, x2, y2, r)
    return t["t0"], t["t1"]


def clip_range(x1: Column, y1: Column, x2: Column, y2: Column, r: Column) -> Column:
    """struct(t0, t1) of ``clip``; segments wholly inside or out are told by distance, others are cut by the 16 strips."""
    inside, outside, cut = _clip_cases(x1, y1, x2, y2, r)
    return F.when(inside, _range(0.0, 1.0)).when(outside, _range(1.0, 0.0)).otherwise(cut)


def _range(a: float, b: float) -> Column:
    return F.struct(F.lit(a).alias("t0"), F.lit(b).alias("t1"))


def _clip_cases(x1: Column, y1: Column, x2: Column, y2: Column, r: Column) -> tuple[Column, Column, Column]:
    """Whether a segment is surely inside, whether it is surely outside, and struct(t0, t1) of the strips if it is neither."""
    dx, dy, d = x2 - x1, y2 - y1, r * APOTHEM

    def strip(s: Column, n: Column) -> Column:  # opposite sides bound the same strip
        a, b = n["x"] * x1 + n["y"] * y1, n["x"] * dx + n["y"] * dy
        enter = F.when(b != 0, F.try_divide(-a, b) - F.try_divide(d, F.abs(b))).when(F.abs(a) > d, F.lit(2.0))
        leave = F.try_divide(-a, b) + F.try_divide(d, F.abs(b))
        return F.struct(F.greatest(s["t0"], enter).alias("t0"), F.least(s["t1"], leave).alias("t1"))

    inside = (x1 * x1 + y1 * y1 <= d * d) & (x2 * x2 + y2 * y2 <= d * d)
    return inside, segment_distance(x1, y1, x2, y2) > r, F.aggregate(_normals(SIDES // 2), _range(0.0, 1.0), strip)


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, r: Column) -> Column:
    """Length of a segment inside the buffer. Only those that may cross its rim reach the strips, whose loop isn't compiled."""
    length = F.hypot(x2 - x1, y2 - y1)
    inside, outside, cut = _clip_cases(x1, y1, x2, y2, r)
    part = F.transform(F.array(cut), lambda t: F.greatest(F.lit(0.0), t["t1"] - t["t0"]) * length)[0]
    return F.when(inside, length).when(outside, F.lit(0.0)).otherwise(part)


def wedges(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Numbers of the buffer's wedges that an edge passes, counted from its less turned end; empty if it points at the origin."""
    c = cross(x1, y1, x2, y2)
    sx, sy = F.when(c > 0, x1).otherwise(x2), F.when(c > 0, y1).otherwise(y2)
    first = F.atan2(sy, sx)
    turn = F.atan2(F.abs(c), x1 * x2 + y1 * y2)
    k0 = F.floor(first / STEP)
    return F.when(c != 0, F.sequence(k0, F.greatest(k0, F.floor((first + turn) / STEP)))).otherwise(F.array().cast("array<bigint>"))


def with_wedge_area(df: DataFrame, name: str = "area", number: str | None = None) -> DataFrame:
    """One row per edge and wedge it passes, with the signed area between origin, edge and buffer inside that wedge.

    ``df`` has x1, y1, x2, y2 relative to the buffer's centre, and r. Summed over
    wedges and a ring's edges, the areas are the overlap. Each step is a
    projection of its own, so that no term is worked out twice. With ``number``,
    rows are numbered per edge in a column of that name, and an edge that passes
    no wedge has one row without number and area.
    """
    own = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    kept = [F.col(c) for c in df.columns]
    col = F.col
    if number:
        kept.append(col(number))
        df = df.select("*", F.posexplode_outer(wedges(*own)).alias(number, "__k"))
    else:
        df = df.withColumn("__k", F.explode(wedges(*own)))
    df = df.withColumn("__c", cross(*own))
    ahead = col("__c") > 0
    for to, one, two in (("__px", "x1", "x2"), ("__py", "y1", "y2"), ("__qx", "x2", "x1"), ("__qy", "y2", "y1")):
        df = df.withColumn(to, F.when(ahead, col(one)).otherwise(col(two)))
    for ray, turn in (("u", 0.0), ("v", 1.0), ("n", 0.5)):
        df = df.withColumns({f"__{ray}x": F.cos((col("__k") + turn) * STEP), f"__{ray}y": F.sin((col("__k") + turn) * STEP)})
    at = lambda ray, end: cross(col(f"__{ray}x"), col(f"__{ray}y"), col(f"__{end}x"), col(f"__{end}y"))
    height = lambda end: col(f"__{end}x") * col("__nx") + col(f"__{end}y") * col("__ny")
    df = df.withColumns({"__p0": at("u", "p"), "__q0": at("u", "q"), "__p1": at("v", "p"), "__q1": at("v", "q"), "__fp": height("p"), "__fq": height("q")})
    df = df.withColumns({
        "__t0": F.when(col("__p0") < 0, F.least(F.lit(1.0), F.try_divide(col("__p0"), col("__p0") - col("__q0")))).otherwise(F.lit(0.0)),
        "__t1": F.when(col("__q1") > 0, F.greatest(F.lit(0.0), F.try_divide(col("__p1"), col("__p1") - col("__q1")))).otherwise(F.lit(1.0)),
    })
    d = col("r") * APOTHEM
    df = df.withColumns({"__fa": col("__fp") + col("__t0") * (col("__fq") - col("__fp")), "__fb": col("__fp") + col("__t1") * (col("__fq") - col("__fp"))})
    df = df.withColumn("__cut", F.try_divide(d - col("__fa"), col("__fb") - col("__fa")))
    share = (
        F.when((col("__fa") <= d) & (col("__fb") <= d), F.lit(1.0))
        .when((col("__fa") > d) & (col("__fb") > d), d * d / (col("__fa") * col("__fb")))
        .when(col("__fa") <= d, col("__cut") + (1 - col("__cut")) * d / col("__fb"))
        .otherwise(col("__cut") * d / col("__fa") + (1 - col("__cut")))
    )
    piece = F.when(col("__k").isNull(), F.lit(None)).when(col("__t1") > col("__t0"), col("__c") * (col("__t1") - col("__t0")) / 2 * share).otherwise(F.lit(0.0))
    return df.select(*kept, piece.alias(name))


def ray_crossing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ray from the origin due east crosses an edge; an odd number of crossings means inside."""
    return ((y1 > 0) != (y2 > 0)) & (F.try_divide(x1 * y2 - x2 * y1, y2 - y1) > 0)


def box_meets_buffer(xmin: Column, ymin: Column, xmax: Column, ymax: Column, r: Column) -> Column:
    """Whether an axis-aligned box and the buffer share a point: no side of either separates them.

    The circles inside and around the buffer settle all but boxes at its rim.
    """
    d = r * APOTHEM
    near = F.hypot(F.greatest(xmin, -xmax, F.lit(0.0)), F.greatest(ymin, -ymax, F.lit(0.0)))
    sides = (xmin <= r) & (xmax >= -r) & (ymin <= r) & (ymax >= -r)
    low = lambda n: n["x"] * F.when(n["x"] > 0, xmin).otherwise(xmax) + n["y"] * F.when(n["y"] > 0, ymin).otherwise(ymax) <= d
    return F.when(near <= d, F.lit(True)).when(near > r, F.lit(False)).otherwise(sides & F.forall(_normals(SIDES), low))


def box_inside_buffer(xmin: Column, ymin: Column, xmax: Column, ymax: Column, r: Column) -> Column:
    """Whether a box lies in the buffer's interior; again the circles settle most."""
    d = r * APOTHEM
    far = F.hypot(F.greatest(F.abs(xmin), F.abs(xmax)), F.greatest(F.abs(ymin), F.abs(ymax)))
    high = lambda n: n["x"] * F.when(n["x"] > 0, xmax).otherwise(xmin) + n["y"] * F.when(n["y"] > 0, ymax).otherwise(ymin) < d
    return F.when(far < d, F.lit(True)).when(far > r, F.lit(False)).otherwise(F.forall(_normals(SIDES), high))


def box_meets_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column, inner: Column, outer: Column) -> Column:
    """Whether a box touches the ring between two buffers of the same point."""
    return box_meets_buffer(xmin, ymin, xmax, ymax, outer) & ~box_inside_buffer(xmin, ymin, xmax, ymax, inner)
