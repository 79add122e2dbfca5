"""Geovariables for a stream of points.

The layers are static and a point's variables depend on no other point, so each
micro-batch is an ordinary batch of the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from geoloom.engine import Calculator


def stream_variables(
    points: DataFrame, build: Callable[[Calculator], Calculator], sink: Callable[[DataFrame, int], None], *, x_col: str = "longitude", y_col: str = "latitude", epsg: int = 4326
) -> DataStreamWriter:
    """A writer that sends every micro-batch of points through ``build`` and its result to ``sink``.

    ``build`` gets a calculator that has the batch's points and adds layers and
    variables; ``sink`` gets the result and the batch's number, by which it can
    tell a batch that is repeated after a failure.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        calculator = Calculator(spark=batch.sparkSession, verbose=False).add_point_with_table(batch, x_col, y_col, epsg)
        sink(build(calculator).get_result(), number)

    return points.writeStream.foreachBatch(each)
