"""Chunks of points: by order, along a Hilbert curve, or by closeness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.spatial import distributed_rank

HILBERT_BITS = 16


def by_order(points: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` points in order of id, which numbers the points from 1."""
    return points.withColumn("chunk_id", F.floor((F.col("id") - 1) / size))


def by_hilbert(points: DataFrame, size: int, bits: int = HILBERT_BITS) -> DataFrame:
    """Chunks of ``size`` points in order of their place on a Hilbert curve over their extent."""
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return points.withColumn("chunk_id", F.lit(None).cast("bigint"))
    top = (1 << bits) - 1
    scaled = []
    for c, lo, hi in (("x", box[0], box[1]), ("y", box[2], box[3])):
        scaled.append(F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * top).cast("bigint"))
    # One projection per bit, since nested expressions would double with every bit.
    df = points.withColumn("__x", scaled[0]).withColumn("__y", scaled[1]).withColumn("__key", F.lit(0).cast("bigint"))
    for level in reversed(range(bits)):
        x, y, last = F.col("__x"), F.col("__y"), F.lit((1 << level) - 1).cast("bigint")
        df = df.withColumns({"__rx": F.shiftright(x, level).bitwiseAND(F.lit(1).cast("bigint")), "__ry": F.shiftright(y, level).bitwiseAND(F.lit(1).cast("bigint"))})
        flip = (F.col("__ry") == 0) & (F.col("__rx") == 1)
        lx, ly = x.bitwiseAND(last), y.bitwiseAND(last)
        fx, fy = F.when(flip, last - lx).otherwise(lx), F.when(flip, last - ly).otherwise(ly)
        turn = F.col("__ry") == 0
        df = df.withColumns({
            "__key": F.col("__key") * 4 + (F.col("__rx") * 3).bitwiseXOR(F.col("__ry")),
            "__x": F.when(turn, fy).otherwise(fx),
            "__y": F.when(turn, fx).otherwise(fy),
        })
    ranked = distributed_rank(df, ["__key", "id"], "__rank").withColumn("chunk_id", F.floor((F.col("__rank") - 1) / size))
    return ranked.select(*points.columns, "chunk_id")


def by_closeness(points: DataFrame, size: int, reach: float) -> DataFrame:
    """Chunks of at most ``size`` points of which no two are farther apart than ``reach``; named by their smallest id.

    Chunks are grid cells, cut into runs of ids: they keep both promises of
    complete-linkage chunks but need not be the same ones.
    """
    side = reach / math.sqrt(2)
    cell = ["__cx", "__cy"]
    keyed = points.withColumn("__cx", F.floor(F.col("x") / side)).withColumn("__cy", F.floor(F.col("y") / side))
    ranked = distributed_rank(keyed, [*cell, "id"], "__rank")  # ranges of ids split a crowded cell
    ranked = ranked.join(ranked.groupBy(*cell).agg(F.min("__rank").alias("__first")), cell)
    ranked = ranked.withColumn("__part", F.floor((F.col("__rank") - F.col("__first")) / size))
    least = F.min("id").over(Window.partitionBy(*cell, "__part"))  # at most ``size`` rows
    return ranked.withColumn("chunk_id", least).select(*points.columns, "chunk_id")
