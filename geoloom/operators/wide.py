"""Attribute-value rows into one typed row per entity.

The entity-by-attribute grid is completed inside each entity's own row: the
cells of an entity are collected once into an array sorted by attribute
position, a bit mask says which positions are there, and every attribute is
projected from its fixed index (the number of mask bits below its position)
through a type-specific try cast. No physical cross join of entities and
attributes is made, so the grid costs no shuffle, and an entity costs as many
steps as it has cells and columns.

Two exchanges, both with bounded rows: cells are pre-aggregated on the map side
(repeats of a hot entity collapse before they move), then at most one cell per
catalogue attribute travels to its entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest catalogue that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ATTRIBUTES = 50_000
#: Positions per word of an entity's mask.
WORD = 62

_SQL_TYPE = {"double": "double", "int": "bigint", "boolean": "boolean"}


def attribute_key(name: Column) -> Column:
    """Spelling-independent key: no letter case, blanks, tabs, hyphens or leading zeros of numbers."""
    bare = F.translate(F.lower(name), "- \t", "_")
    return F.regexp_replace(bare, r"(?<![0-9])0+(?=[0-9])", "")


def fits(value: Column, value_type: Column) -> Column:
    """Whether a number can be stored in the stated type without loss."""
    return (
        F.when(value_type == "int", (value == F.floor(value)) & (F.abs(value) < F.lit(2.0**63)))
        .when(value_type == "boolean", value.isin(0.0, 1.0))
        .otherwise(F.lit(True))
    )


def to_wide(
    rows: DataFrame,
    catalogue: DataFrame,
    *,
    id_col: str = "id",
    time_col: str = "year",
    name_col: str = "varname",
    value_col: str = "value",
    type_col: str = "value_type",
    tolerance: float = 0.001,
) -> DataFrame:
    """One row per (id, time) with one typed column per catalogue attribute.

    The catalogue is the result's schema, so its distinct entries are read to the
    driver. Columns: ``id``, ``time``, every catalogue attribute in order of its name
    (``int`` becomes bigint), and ``unresolved``, the names of attributes whose
    rows hold no single well-typed value; their column is null. An attribute
    called like ``id``, ``time`` or ``unresolved`` gets a trailing ``_``. One
    name with two types raises.

    Defined cases: rows with a null id belong to no entity and are left out; a
    null time is an entity of its own; null and NaN values are absent values,
    but their rows still make the entity appear, as do rows whose name matches
    no attribute; repeated rows and values within ``tolerance`` of each other
    give the smallest of them; an empty table gives an empty result; other
    columns of either table are ignored.
    """
    entries = catalogue.select(name_col, type_col).where(F.col(name_col).isNotNull()).distinct().collect()
    types = dict(entries)
    if len(types) < len(entries):
        raise ValueError("the catalogue states two types for one attribute")
    names = sorted(types)
    if unknown := sorted({t for t in types.values() if t not in _SQL_TYPE}, key=str):
        raise ValueError(f"unknown value types in the catalogue: {unknown}")

    spark = rows.sparkSession
    positions = spark.createDataFrame(
        [(n, i, types[n]) for i, n in enumerate(names)], "__name string, __pos int, __type string"
    ).select(attribute_key(F.col("__name")).alias("__key"), "__pos", "__type")

    value = F.col(value_col).cast("double")
    facts = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"),
        F.col(time_col).alias("__time"),
        attribute_key(F.col(name_col)).alias("__key"),
        F.when(~F.isnan(value), value).alias("__v"),
    )
    if len(names) <= BROADCAST_ATTRIBUTES:
        positions = F.broadcast(positions)
    cells = (
        facts.join(positions, "__key", "left")
        .groupBy("__id", "__time", "__pos")
        .agg(
            F.min("__v").alias("lo"),
            F.max("__v").alias("hi"),
            F.coalesce(F.bool_or(F.col("__v").isNotNull() & ~fits(F.col("__v"), F.col("__type"))), F.lit(False)).alias("bad"),
        )
    )
    present = F.col("__pos").isNotNull() & F.col("lo").isNotNull()
    # Inside a cell, NaN stands for values that differ or do not fit; it is no value of its own.
    single = F.when(~F.col("bad") & (F.col("hi") - F.col("lo") <= tolerance), F.col("lo")).otherwise(F.lit(float("nan")))
    bit = F.when(present, F.expr(f"shiftleft(1L, __pos % {WORD})"))
    words = range(-(-len(names) // WORD))
    masks = [F.coalesce(F.bit_or(F.when(F.expr(f"__pos div {WORD} = {w}"), bit)), F.lit(0).cast("bigint")).alias(f"__m{w}") for w in words]
    entities = cells.groupBy("__id", "__time").agg(
        F.sort_array(F.collect_list(F.when(present, F.struct("__pos", single.alias("v"))))).alias("__cells"), *masks
    )
    before = [F.lit(0)]
    for w in words:
        before.append(before[-1] + F.bit_count(f"__m{w}"))
    grid = entities.withColumns({"__values": F.col("__cells.v")} | {f"__b{w}": before[w] for w in words})

    def at(i: int) -> Column:
        mask, own = F.col(f"__m{i // WORD}"), 1 << i % WORD
        index = F.col(f"__b{i // WORD}") + F.bit_count(mask.bitwiseAND(F.lit(own - 1).cast("bigint")))
        return F.when(mask.bitwiseAND(F.lit(own).cast("bigint")) != 0, F.get("__values", index))

    reserved = {id_col.lower(), time_col.lower(), "unresolved"}
    columns = [
        F.nullif(at(i), F.lit(float("nan"))).try_cast(_SQL_TYPE[types[n]]).alias(n + "_" if n.lower() in reserved else n) for i, n in enumerate(names)
    ]
    labels = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    open_cells = F.filter("__cells", lambda c: F.isnan(c["v"]))
    unresolved = F.transform(open_cells, lambda c: F.get(labels, c["__pos"]))
    return grid.select(F.col("__id").alias(id_col), F.col("__time").alias(time_col), *columns, unresolved.alias("unresolved"))


def unresolved_cells(wide: DataFrame, *, id_col: str = "id", time_col: str = "year", name_col: str = "varname") -> DataFrame:
    """(id, name, time) of every cell of ``to_wide`` without a single well-typed value; a null time becomes 0."""
    return wide.select(
        id_col, F.explode("unresolved").alias(name_col), F.coalesce(F.col(time_col), F.lit(0)).alias(time_col)
    ).distinct()
