"""The chainable interface: points in, geovariables out.

Nothing is computed while a chain is built; every ``calculate_*`` call checks its
arguments and notes a plan, and ``get_result`` makes one frame of them all.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from enum import Enum
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import naming
from geoloom.functions.projection import REFERENCE, to_reference
from geoloom.functions.wkb import point_wkb
from geoloom.operators import chunking
from geoloom.operators.prepare import listed_once, to_polygons, to_segments
from geoloom.operators.spatial import joined, row_ids
from geoloom.plans import finalise, variables
from geoloom.session import build_session, cut_lineage
from geoloom.sources import storage

KEY = "__row"

# Years that each layer has.
YEARS = {
    "airport": (2000, 2005, 2010, 2015, 2020),
    "bus_stop": (2020, 2021, 2023),
    "coastline": (2000, 2005, 2010, 2015, 2020),
    "mdl": (2000, 2005, 2010, 2015, 2020, 2023),
    "ports": (2000, 2005, 2010, 2015, 2020),
    "railstation": (2005, 2010, 2015, 2020),
    "river": (2023,),
    "roads": (2005, 2010, 2015, 2020),
    "main_roads": (2005, 2010, 2015, 2020),
    "landuse": (2000, 2005, 2010, 2015, 2020),
}
MAIN_ROADS = ("mr1", "mr2")
REGIONS = "jgg_borders_2023"
#: Tolerance in metres by which the coastline is simplified before distances are taken.
COAST_TOLERANCE = 1.0


class WorkerMode(str, Enum):
    """Accepted for compatibility; Spark distributes every plan in the same way."""

    CHUNKED_MULTI = "chunked_multi"
    CHUNKED_SINGLE = "chunked_single"
    TOTAL_SINGLE = "total_single"


def _mode(mode: str | WorkerMode) -> WorkerMode:
    try:
        return WorkerMode(mode)
    except ValueError:
        raise ValueError(f"Invalid mode '{mode}'. Valid modes are: {[m.value for m in WorkerMode]}") from None


class Calculator:
    def __init__(
        self,
        mode: str | WorkerMode = WorkerMode.CHUNKED_MULTI,
        n_workers: int = 8,
        verbose: bool = True,
        *,
        data_dir: str | Path | None = None,
        spark: SparkSession | None = None,
    ):
        self.mode, self.n_workers, self.verbose = _mode(mode), n_workers, verbose
        self.spark = spark or SparkSession.getActiveSession() or build_session(cpus=n_workers)
        self.layers = storage.Layers(self.spark, str(data_dir) if data_dir else None)
        self.started = time.time()
        self.points: DataFrame | None = None
        self.attributes: DataFrame | None = None
        self.oa_intersection_df: DataFrame | None = None
        self._plans: list[Callable[[], DataFrame]] = []
        self._results: list[DataFrame] = []
        self._chunks: Callable[[], DataFrame] | None = None
        self._extent: Row | None = None

    # Sources

    def connect_local_database(self, data_dir: str | Path) -> Calculator:
        """Layers are the Parquet files of a folder."""
        self.layers.root = str(data_dir)
        return self

    def connect_cloud_storage(
        self, s3_key_id: str | None = None, s3_secret: str | None = None, s3_account_id: str | None = None, s3_bucket_name: str | None = None, prefix: str = ""
    ) -> Calculator:
        """Layers are the Parquet files of a bucket, or of its folder ``prefix``; needs the s3a connector on the class path."""
        key, secret, account, bucket = storage.credentials(s3_key_id, s3_secret, s3_account_id, s3_bucket_name)
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name, value in storage.s3a_settings(key, secret, account, bucket).items():
            hadoop.set(name, value)
        self.layers.root = storage.s3a_root(bucket, prefix)
        return self

    def register_layer(self, name: str, layer: DataFrame) -> Calculator:
        """Use a frame as the layer ``name`` instead of a file."""
        self.layers.register(name, layer)
        return self

    def add_point_with_table(self, df: pd.DataFrame | DataFrame, x_col: str = "longitude", y_col: str = "latitude", epsg: int = 4326) -> Calculator:
        """Points with any attributes, numbered from 1 in input order; forgets earlier results."""
        if isinstance(df, pd.DataFrame):
            df = self.spark.createDataFrame(df)
        rows = row_ids(df, KEY)
        x, y = to_reference(F.col(x_col).cast("double"), F.col(y_col).cast("double"), epsg, REFERENCE)
        self.attributes = rows
        self.points = rows.select(F.col(KEY).alias("id"), x.alias("x"), y.alias("y"))
        self._plans, self._results, self.oa_intersection_df, self._extent = [], [], None, None
        return self.chunk_by_order(100)

    # Chunks

    def _point_rows(self) -> DataFrame:
        if self.points is None:
            raise ValueError("No points: call add_point_with_table first")
        return self.points

    def chunk_by_order(self, max_cluster_size: int = 50) -> Calculator:
        points = self._point_rows()
        self._chunks = lambda: chunking.by_order(points, max_cluster_size)
        return self

    def chunk_by_hilbert(self, max_cluster_size: int = 50) -> Calculator:
        points = self._point_rows()
        self._chunks = lambda: chunking.by_hilbert(points, max_cluster_size)
        return self

    def chunk_by_centroid(self, max_cluster_size: int = 50, distance_threshold: float = 2000, max_rows: int = 20000) -> Calculator:
        """Chunks no wider than the threshold: grid cells, not complete-linkage clusters, which need all distances of a block.

        ``max_rows`` is accepted, but no block of rows has to be bounded here.
        """
        points = self._point_rows()
        self._chunks = lambda: chunking.by_closeness(points, max_cluster_size, distance_threshold)
        return self

    def get_chunks(self) -> DataFrame:
        """(id, x, y, wkt, chunk_id); what a chunk is doesn't matter for any result."""
        if self._chunks is None:
            self._point_rows()
        return self._chunks().withColumn("wkt", F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string")))

    # Variables

    def _note(self, plan: Callable[[], DataFrame]) -> Calculator:
        self._point_rows()
        self._plans.append(plan)
        return self

    def _prepared(self, make: Callable[[], DataFrame]) -> DataFrame:
        """A layer decoded once; feature numbers made on the way stay the same for all that read it."""
        return cut_lineage(make())

    def _around(self, layer: DataFrame, sizes: Sequence[float]) -> DataFrame:
        """Rows of a layer whose stated box comes near the points' extent, as literals that reach the scan; rows without a box stay."""
        boxes = ("xmin", "xmax", "ymin", "ymax")
        if not set(boxes) <= set(layer.columns):
            return layer
        if self._extent is None:
            self._extent = self._point_rows().agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if self._extent[0] is None:
            return layer.limit(0)
        reach = max(map(float, sizes)) + 2 * variables.RING
        x0, x1, y0, y1 = self._extent
        near = [F.col("xmin") <= x1 + reach, F.col("xmax") >= x0 - reach, F.col("ymin") <= y1 + reach, F.col("ymax") >= y0 - reach]
        for c, test in zip(boxes, near):
            layer = layer.where(test | F.col(c).isNull())
        return layer

    def run_query_workers(
        self, pre_query: str = "", main_query: str = "", post_query: str = "", mode: str | WorkerMode = WorkerMode.CHUNKED_MULTI, desc: str = ""
    ) -> Calculator:
        """Own SQL over the view ``chunk`` (id, x, y, and geometry as well-known binary), giving id, varname, year and value; ``pre_query`` and ``post_query`` run around it."""
        _mode(mode)
        points = self._point_rows()

        def plan() -> DataFrame:
            points.withColumn("geometry", point_wkb(F.col("x"), F.col("y"))).createOrReplaceTempView("chunk")
            try:
                if pre_query.strip():
                    self.spark.sql(pre_query)
                out = self.spark.sql(main_query).select("id", "varname", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
                if post_query.strip():
                    out = cut_lineage(out)
                    self.spark.sql(post_query)
                return out
            finally:
                self.spark.catalog.dropTempView("chunk")

        return self._note(plan)

    def calculate_coordinate(self, mode: str = "centroid") -> Calculator:
        """Coordinates of the points; both modes give the point itself."""
        naming.checked(mode, ("centroid", "representative_point"), "mode")
        return self._note(lambda: variables.coordinates(self.points, REFERENCE))

    def _distance(self, layer: str, years, valid: Sequence[int], tolerance: float = 0.0) -> Calculator:
        years = naming.checked(years, valid, "year")

        def plan() -> DataFrame:
            rows = self.layers.read(layer).where(F.col("year").isin(years))
            segments = self._prepared(lambda: to_segments(rows, "year", tolerance=tolerance))
            return variables.distance(self.points, segments, naming.DISTANCE[layer])

        return self._note(plan)

    def calculate_airport_distance(self, years) -> Calculator:
        return self._distance("airport", years, YEARS["airport"])

    def calculate_bus_stop_distance(self, years) -> Calculator:
        return self._distance("bus_stop", years, YEARS["bus_stop"])

    def calculate_coastline_distance(self, years) -> Calculator:
        return self._distance("coastline", years, YEARS["coastline"], COAST_TOLERANCE)

    def calculate_mdl_distance(self, years) -> Calculator:
        return self._distance("mdl", years, YEARS["mdl"])

    def calculate_port_distance(self, years) -> Calculator:
        return self._distance("ports", years, YEARS["ports"])

    def calculate_railstation_distance(self, years) -> Calculator:
        return self._distance("railstation", years, YEARS["railstation"])

    def calculate_river_distance(self, years) -> Calculator:
        return self._distance("river", years, YEARS["river"])

    def calculate_road_distance(self, years) -> Calculator:
        return self._distance("roads", years, YEARS["roads"])

    def calculate_main_road_distance(self, mr_types, years) -> Calculator:
        for kind in naming.checked(mr_types, MAIN_ROADS, "main road type"):
            self._distance(kind, years, YEARS["main_roads"])
        return self

    def calculate_road_llw(self, buffer_sizes, years) -> Calculator:
        sizes, years = naming.checked_sizes(buffer_sizes), naming.checked(years, YEARS["roads"], "year")

        def plan() -> DataFrame:
            rows = self.layers.read("roads").where(F.col("year").isin(years))
            return variables.line_lengths(self.points, to_segments(rows, "year", "lanes", "width"), sizes, years, "Road")

        return self._note(plan)

    def calculate_main_road_llw(self, mr_types, buffer_sizes, years) -> Calculator:
        sizes, years = naming.checked_sizes(buffer_sizes), naming.checked(years, YEARS["main_roads"], "year")
        for kind in naming.checked(mr_types, MAIN_ROADS, "main road type"):

            def plan(kind: str = kind) -> DataFrame:
                chosen = self.layers.read(kind)
                ids = chosen.select(F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"roads_{y}_id").alias("id")) for y in years])).alias("k"))
                ids = ids.select("k.year", "k.id").where("id is not null")
                # Roads are chosen by number alone; a number chosen twice counts twice.
                rows = joined(self.layers.read("roads").select("id", "lanes", "width", "geometry"), ids, ["id"])
                segments = self._prepared(lambda: to_segments(rows, "year", "lanes", "width"))
                return variables.line_lengths(self.points, segments, sizes, years, kind.upper())

            self._note(plan)
        return self

    def calculate_landuse_area_ratio(self, years, buffer_sizes=None) -> Calculator:
        sizes, years = naming.checked_sizes(buffer_sizes), naming.checked(years, YEARS["landuse"], "year")
        for year in years:

            def plan(year: int = year) -> DataFrame:
                layer = self.layers.read(f"landuse_{year}")
                polygons = to_polygons(listed_once(self._around(layer, sizes)), "codes")
                return variables.landuse(self.points, polygons, sizes, year, layer.select("code"))

            self._note(plan)
        return self

    def calculate_relative_elevation(self, elev_types, buffer_sizes) -> Calculator:
        sizes = naming.checked_sizes(buffer_sizes, rounded=False)
        for kind in naming.checked(elev_types, tuple(naming.ELEVATION), "elevation type"):
            self._note(lambda kind=kind: variables.elevation(self.points, self._around(self.layers.read(kind), sizes), sizes, kind))
        return self

    def calculate_intersecting_oa(self, buffer_sizes) -> Calculator:
        """Fills ``oa_intersection_df`` (id, buffer_size, tot_reg_cd, intersection_ratio); not part of the result."""
        sizes = naming.checked_sizes(buffer_sizes, rounded=False)
        polygons = self._prepared(lambda: to_polygons(self._around(self.layers.read(REGIONS), sizes), "tot_reg_cd"))
        self.oa_intersection_df = variables.region_overlap(self._point_rows(), polygons, sizes)
        return self

    # Result

    @property
    def result_df(self) -> DataFrame:
        """All variables so far as rows (id, varname, year, value)."""
        while self._plans:
            self._results.append(self._plans.pop(0)())
        if not self._results:
            return self.spark.createDataFrame([], "id bigint, varname string, year int, value double")
        out = self._results[0]
        for more in self._results[1:]:
            out = out.unionByName(more)
        return out

    def get_result(self, pivot: bool = True) -> DataFrame:
        """Attributes with their variables: one column each, or as rows with ``pivot=False``.

        Without any variable the attributes come out alone.
        """
        self._point_rows()
        long = self.result_df
        if not self._results:
            out = self.attributes.orderBy(KEY)
            return out.drop(KEY)
        if pivot:
            long = cut_lineage(long)  # names, years and values are read from it in turn
        out = finalise.attached(self.attributes, finalise.pivoted(long) if pivot else long, KEY)
        if self.verbose:
            print(f"Elapsed: {time.time() - self.started:.1f} s")
        return out
