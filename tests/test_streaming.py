from geoloom.functions import wkb
from geoloom.streaming import stream_variables


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "points"), []
    df = spark.createDataFrame([("a", 1_000_003.0, 2_000_004.0), ("b", 1_000_000.0, 2_000_007.0)], "name string, x double, y double")
    df.write.parquet(source)
    airport = spark.createDataFrame([(2000, bytearray(wkb.encode_point(1e6, 2e6)))], "year int, geometry binary")
    build = lambda c: c.register_layer("airport", airport).calculate_airport_distance(2000)
    points = spark.readStream.schema(df.schema).parquet(source)
    writer = stream_variables(points, build, lambda r, n: out.extend(r.collect()), x_col="x", y_col="y", epsg=5179)
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.name: r.D_Airport for r in out} == {"a": 5.0, "b": 7.0}
