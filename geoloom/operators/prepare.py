"""Layers prepared once: well-known binary decoded to segments, edges and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.wkb import POLYGON, alike
from geoloom.session import spread


def simplify(vertices: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: drop vertices within ``tolerance`` of the line that replaces them; ends stay."""
    keep = np.zeros(len(vertices), bool)
    keep[[0, -1]] = True
    todo = [(0, len(vertices) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = vertices[a + 1 : b] - vertices[a], vertices[b] - vertices[a]
        length2 = float(d @ d)
        t = np.clip(p @ d / length2, 0, 1) if length2 else np.zeros(len(p))
        away = np.hypot(*(p - t[:, None] * d).T)
        worst = int(away.argmax())
        if away[worst] > tolerance:
            at = a + 1 + worst
            keep[at] = True
            todo += [(a, at), (at, b)]
    return vertices[keep]


def _edges(v: np.ndarray) -> np.ndarray:
    """Edges (row, edge, ends) of rings of as many vertices; a point is an edge of no length."""
    return np.concatenate([v[:, :-1], v[:, 1:]] if v.shape[1] > 1 else [v, v], axis=2)


def _segments(tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, ends, area = [np.empty(0, int)], [np.empty((0, 4))], [np.empty(0, bool)]
            for own, found in alike(batch["geometry"].tolist()):
                is_area = any(base == POLYGON for base, _ in found)
                for v in (v for _, rings in found for v in rings):
                    short = tolerance and v.shape[1] > 2
                    for at, e in [(own[i : i + 1], _edges(simplify(v[i], tolerance)[None])) for i in range(len(own))] if short else [(own, _edges(v))]:
                        rows.append(np.repeat(at, e.shape[1]))
                        ends.append(e.reshape(-1, 4))
                        area.append(np.full(len(rows[-1]), is_area))
            out = batch.drop(columns="geometry").iloc[np.concatenate(rows)].reset_index(drop=True)
            s = np.vstack(ends)
            for i, c in enumerate(("x1", "y1", "x2", "y2")):
                out[c] = s[:, i]
            out["is_area"] = np.concatenate(area)
            yield out

    return run


def to_segments(layer: DataFrame, *keep: str, tolerance: float = 0.0) -> DataFrame:
    """(fid, keep..., x1, y1, x2, y2, is_area): one row per edge of every non-empty geometry; a point is an edge of no length."""
    source = layer.where(F.col("geometry").isNotNull()).select(F.monotonically_increasing_id().alias("fid"), *keep, "geometry")
    kinds = "".join(f"`{f}` {t}, " for f, t in source.dtypes if f != "geometry")
    return source.mapInPandas(_segments(tolerance), f"{kinds}x1 double, y1 double, x2 double, y2 double, is_area boolean")


_EDGE = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])


def _parts_alike(found: list[tuple[int, list[np.ndarray]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (row, edge, ends) and area of every polygon part, of rings as ``alike`` gives them."""
    out = []
    for base, rings in found:
        if base != POLYGON:
            continue
        edges, area = [], 0.0
        for i, ring in enumerate(rings):
            v = ring - ring[:, :1]
            signed = np.sum(v[:, :-1, 0] * v[:, 1:, 1] - v[:, 1:, 0] * v[:, :-1, 1], axis=1) / 2
            turned = (signed > 0) != (i == 0)
            ring = np.where(turned[:, None, None], ring[:, ::-1], ring)
            edges.append(np.concatenate([ring[:, :-1], ring[:, 1:]], axis=2))
            area = area + np.where(turned, -signed, signed)
        if (e := np.concatenate(edges, axis=1)).shape[1]:
            out.append((e, area))
    return out


def to_polygons(layer: DataFrame, *keep: str) -> DataFrame:
    """(fid, keep..., feature_area, xmin, ymin, xmax, ymax, edges): one row per polygon part, shells turned left and holes right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(["fid", *keep])
            for own, found in alike(batch.column(batch.num_columns - 1).to_pylist()):
                shapes = _parts_alike(found)
                whole = sum(area for _, area in shapes)
                for e, _ in shapes:
                    n = len(own) * e.shape[1]
                    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(e[:, :, k]).reshape(n)) for k in range(4)], fields=list(_EDGE))
                    edges = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * e.shape[1]), flat)
                    box = [*e[:, :, :2].min(axis=1).T, *e[:, :, :2].max(axis=1).T]
                    rows = kept.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, *map(pa.array, (whole, *box)), edges], ["fid", *keep, "feature_area", "xmin", "ymin", "xmax", "ymax", "edges"]
                    )

    source = layer.where(F.col("geometry").isNotNull()).select(F.monotonically_increasing_id().alias("fid"), *keep, "geometry")
    kinds = "".join(f"`{f}` {t}, " for f, t in source.dtypes if f != "geometry")
    edge = "array<struct<x1: double, y1: double, x2: double, y2: double>>"
    return source.mapInArrow(run, f"{kinds}feature_area double, xmin double, ymin double, xmax double, ymax double, edges {edge}")


def listed_once(layer: DataFrame) -> DataFrame:
    """(geometry, codes): every geometry of a land-use layer once, with its codes and how often it is listed with each."""
    rows = layer.where("geometry is not null and code is not null").select("geometry", F.col("code").cast("string").alias("code"))
    counts = spread(rows, "geometry").groupBy("geometry", "code").agg(F.count("*").cast("double").alias("times"))
    return counts.groupBy("geometry").agg(F.collect_list(F.struct("code", "times")).alias("codes"))
