"""From long results to the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(long: DataFrame) -> DataFrame:
    return long.select("id", "year", "varname", "value").orderBy("id", F.asc_nulls_last("year"), "varname")


def pivoted(long: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per id and year, also for years an id has no values of; one column per variable, in order of name.

    ``names`` saves the job that looks them up.
    """
    if names is None:
        names = [r[0] for r in long.select("varname").distinct().collect()]
    names = sorted(names)
    wide = long.groupBy("id", "year").pivot("varname", names).agg(F.first("value", ignorenulls=True))
    years = [r[0] for r in long.select("year").distinct().collect()]  # a handful
    array = F.array(*[F.lit(y).cast("int") for y in years]).cast("array<int>")
    grid = long.select("id").distinct().select(F.col("id").alias("__id"), F.explode(array).alias("__year"))
    joined = grid.join(wide, (F.col("__id") == F.col("id")) & F.col("__year").eqNullSafe(F.col("year")), "left")
    return joined.select(F.col("__id").alias("id"), F.col("__year").alias("year"), *names)


def attached(attributes: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Attributes with their results, in order of number, year and variable; result columns whose name is taken get a trailing ``_``.

    ``key`` is the attributes' hidden row number. Rows without results stay. The
    number comes out as ``id`` unless the attributes have a column of that name.
    """
    taken = {c.lower() for c in attributes.columns if c != key}
    renamed = {c: c + "_" if c.lower() in taken else c for c in result.columns}
    right = result.select(*[F.col(c).alias(n) for c, n in renamed.items()])
    joined = attributes.join(right, attributes[key] == right[renamed["id"]], "left")
    out = [c for c in joined.columns if c not in (key, "id_")]
    order = [F.col(key), *[F.asc_nulls_last(renamed[c]) for c in ("year", "varname") if c in renamed]]
    if renamed["id"] == "id":
        joined = joined.withColumn("id", F.col(key))
    return joined.orderBy(*order).select(*out)
