"""Fill missing values from records of the same group, place or time.

Numerics follow a mixed-effects model: a general mean, an effect of time and
random effects of nested groups, each shrunk towards its parent by the ratio of
its variance components (method of moments); effects of time and of groups are
fitted in turn. Categories
follow a multinomial model whose group and time frequencies are shrunk towards
their parents (Dirichlet prior).

Fitting needs sums only: usable records are aggregated once to (groups, time)
cells with map-side combine, and every later step works on those. Only records
with a missing value are joined to the effects; the rest pass through. What
reaches the driver are a handful of numbers per effect.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut_lineage


@dataclass(frozen=True)
class Numeric:
    """A field predicted by the mixed-effects model; usable inside [low, high]."""

    column: str
    low: float
    high: float

    def usable(self) -> Column:
        v = F.col(self.column).cast("double")
        return F.coalesce(~F.isnan(v) & v.between(self.low, self.high), F.lit(False))


@dataclass(frozen=True)
class Categorical:
    """A field predicted by the multinomial model; its classes are whole numbers from low to high."""

    column: str
    low: int
    high: int

    def usable(self) -> Column:
        v = F.col(self.column).cast("double")
        return F.coalesce(~F.isnan(v) & v.between(self.low, self.high) & (v == F.floor(v)), F.lit(False))


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null, where null is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def _sums(rest: Column) -> list[Column]:
    """Number, sum and sum of squares (n, r, rr) of what ``rest`` leaves of the sums n, s and q."""
    n, s, q = (F.col(c) for c in ("n", "s", "q"))
    return [F.sum(n).alias("n"), F.sum(s - n * rest).alias("r"), F.sum(q - 2 * rest * s + n * rest * rest).alias("rr")]


def _shrinkage(groups: DataFrame) -> float | None:
    """Variance within groups over that between them, by the method of moments; None if groups do not differ."""
    n, r = F.col("n"), F.col("r")
    g = groups.agg(
        F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(r).alias("r"), F.sum("rr").alias("rr"),
        F.sum(r * r / n).alias("between"), F.sum(n.cast("double") * n).alias("nn"),
    ).first()
    if not g["g"]:
        return None
    within = max(g["rr"] - g["between"], 0.0) / max(g["n"] - g["g"], 1)
    spread = g["n"] - g["nn"] / g["n"]
    between = (g["between"] - g["r"] ** 2 / g["n"] - (g["g"] - 1) * within) / spread if spread > 0 else 0.0
    return within / between if between > 0 else None


def _own_effect(ratio: float | None) -> Column:
    return F.lit(0.0) if ratio is None else F.col("r") / (F.col("n") + ratio)


def _level_effects(levels: list[tuple[str, ...]], tables: DataFrame) -> list[DataFrame]:
    """Per level its keys and ``u``, the sum of the effects of a group and of those it lies in, each shrunk towards its parent."""
    out: list[DataFrame] = []
    for k, keys in enumerate(levels):
        table = tables.where(F.col("lv") == k).select(*keys, "n", "r", "rr")
        if out:
            table = _matched(table, out[-1].withColumnRenamed("u", "up"), levels[k - 1], "inner")
        else:
            table = table.withColumn("up", F.lit(0.0))
        n, r, rr, up = (F.col(c) for c in ("n", "r", "rr", "up"))
        rest = table.select(*keys, "n", (r - n * up).alias("r"), (rr - 2 * up * r + n * up * up).alias("rr"), "up")
        own = _own_effect(_shrinkage(rest.where(_known(keys))))
        out.append(rest.select(*keys, (F.col("up") + F.when(_known(keys), own).otherwise(0.0)).alias("u")))
    return out


def _numeric_effects(usable: DataFrame, field: Numeric, levels: list[tuple[str, ...]], time: str | None, rounds: int) -> tuple:
    """General mean, effects of time (time, t) or None, and a table of the groups' summed effects by level (lv, keys, u).

    Records are summed up to (finest group, time) once. A round removes the time
    effects, sums up the finest groups and rolls them up to the coarser levels in
    one table, and goes down that table level by level.
    """
    y = F.col(field.column).cast("double")
    finest = levels[-1]
    cells = cut_lineage(
        usable.groupBy(*dict.fromkeys([*finest, *([time] if time else [])])).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    )
    total = cells.agg(F.sum("n"), F.sum("s")).first()
    if not total[0]:
        return float("nan"), None, None
    mean = total[1] / total[0]
    # Sums are kept about the mean, which spares digits.
    n, s, q = (F.col(c) for c in ("n", "s", "q"))
    cells = cells.withColumns({"s": s - n * mean, "q": q - 2 * mean * s + n * mean * mean})
    effects, times = None, None
    for _ in range(rounds if time else 1):
        left = cells.withColumn("t", F.lit(0.0))
        if time:
            met = _matched(cells, effects[-1], finest) if effects else cells.withColumn("u", F.lit(0.0))
            spans = cut_lineage(met.where(F.col(time).isNotNull()).groupBy(time).agg(*_sums(F.coalesce("u", F.lit(0.0)))))
            times = spans.select(time, _own_effect(_shrinkage(spans)).alias("t"))
            left = cells.join(times, time, "left").fillna(0.0, ["t"])
        groups = left.groupBy(*finest).agg(*_sums(F.col("t"))).withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
        first = {k: next(i for i, own in enumerate(levels) if k in own) for k in finest}
        groups = groups.withColumns({k: F.when(F.col("lv") >= i, F.col(k)) for k, i in first.items()})
        tables = cut_lineage(groups.groupBy("lv", *finest).agg(*[F.sum(c).alias(c) for c in ("n", "r", "rr")]))
        effects = _level_effects(levels, tables)
    every = [e.where(_known(keys)).withColumn("lv", F.lit(k)) for k, (keys, e) in enumerate(zip(levels, effects))]
    return mean, times, cut_lineage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every))


def _fill_numeric(rows: DataFrame, field: Numeric, levels: list[tuple[str, ...]], time: str | None, mean: float, times, effects) -> DataFrame:
    """``rows`` with __new, by the finest group that has values, and by time."""
    if mean != mean:
        return rows.withColumn("__new", F.lit(None).cast("double"))
    for k, keys in enumerate(levels):
        rows = rows.join(effects.where(F.col("lv") == k).select(*keys, F.col("u").alias(f"__u{k}")), list(keys), "left")
    guess = F.lit(mean) + F.coalesce(*[F.col(f"__u{k}") for k in reversed(range(len(levels)))], F.lit(0.0))
    if times is not None:
        rows = rows.join(times, time, "left")
        guess = guess + F.coalesce("t", F.lit(0.0))
    rows = rows.withColumn("__new", F.least(F.greatest(guess, F.lit(float(field.low))), F.lit(float(field.high))))
    return rows.drop("t", *[f"__u{k}" for k in range(len(levels))])


def _fill_categorical(rows: DataFrame, usable: DataFrame, field: Categorical, levels: list[tuple[str, ...]], time: str | None, concentration: float) -> DataFrame:
    keys = dict.fromkeys([*levels[-1], *([time] if time else [])])
    kind = (F.col(field.column).cast("double") - field.low).cast("int").alias("__class")
    cells = cut_lineage(usable.groupBy(*keys, kind).agg(F.count("*").cast("double").alias("n")))
    overall = dict(cells.groupBy("__class").agg(F.sum("n")).collect())
    total = sum(overall.values())
    if not total:
        return rows.withColumn("__new", F.lit(None).cast("double"))
    shares = [(overall.get(k, 0.0) + 1e-9) / total for k in range(field.high - field.low + 1)]
    prior = F.from_json(F.lit(json.dumps(shares)), "array<double>")

    def shrunk(df: DataFrame, term: Sequence[str], towards: Column, name: str) -> DataFrame:
        per = cells.where(_known(term)).groupBy(*term, "__class").agg(F.sum("n").alias("n"))
        per = per.groupBy(*term).agg(F.map_from_entries(F.collect_list(F.struct("__class", "n"))).alias("__n"), F.sum("n").alias("__all"))
        df = df.join(per, list(term), "left")
        own = F.transform(towards, lambda q, i: (F.coalesce(F.try_element_at("__n", i), F.lit(0.0)) + concentration * q) / (F.col("__all") + concentration))
        return df.withColumn(name, F.when(F.col("__all").isNotNull(), own).otherwise(towards)).drop("__n", "__all")

    rows = rows.withColumn("__p", prior)
    if time:
        rows = shrunk(rows, [time], prior, "__t")
    for term in levels:
        rows = shrunk(rows, term, F.col("__p"), "__p")
    score = F.transform("__p", lambda p: F.log(p))
    if time:
        score = F.zip_with(F.zip_with("__p", "__t", lambda a, b: F.log(a) + F.log(b)), prior, lambda s, q: s - F.log(q))
    best = F.array_position(F.col("__score"), F.array_max("__score"))
    return rows.withColumn("__score", score).withColumn("__new", (best - 1 + field.low).cast("double")).drop("__p", "__t", "__score")


def fill_missing(
    df: DataFrame,
    fields: Sequence[Numeric | Categorical],
    levels: Sequence[Sequence[str]],
    *,
    time: str | None = None,
    rounds: int = 2,
    concentration: float = 2.0,
) -> DataFrame:
    """``df`` with ``{field}_value`` (measured or predicted, double) and ``{field}_filled`` (mask) per field.

    ``levels`` are nested group keys from coarse to fine, as column names of
    ``df``; a level's key are its columns and those of the coarser levels.
    ``rounds`` are those of fitting time and groups in turn.

    Defined cases: a value is missing if it is null, NaN or outside the field's
    range (or, for categories, not whole). A null in a level's key means the
    record belongs to no group of that level, and a null time to no time; the
    coarser levels still serve. Ties between categories go to the smallest. If
    no value of a field is usable, its value stays null and its mask true.
    Repeated rows count as often as they occur, so pass distinct records. An
    empty table gives an empty result. Other columns pass through unchanged.
    """
    made = [f"{f.column}_{s}" for f in fields for s in ("value", "filled")]
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in made}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    levels = [tuple(dict.fromkeys(k for own in levels[: i + 1] for k in own)) for i in range(len(levels))]
    keys = list(dict.fromkeys([*levels[-1], *([time] if time else [])]))
    whole = reduce(lambda a, b: a & b, [f.usable() for f in fields])
    good, bad = df.where(whole), df.where(~whole)
    for f in fields:
        own = F.col(f.column).cast("double")
        good = good.withColumn(f"{f.column}_value", own).withColumn(f"{f.column}_filled", F.lit(False))
        usable = df.select(*keys, f.column).where(f.usable())
        if isinstance(f, Numeric):
            bad = _fill_numeric(bad, f, levels, time, *_numeric_effects(usable, f, levels, time, rounds))
        else:
            bad = _fill_categorical(bad, usable, f, levels, time, concentration)
        bad = bad.withColumn(f"{f.column}_value", F.when(f.usable(), own).otherwise(F.col("__new"))).drop("__new")
        bad = bad.withColumn(f"{f.column}_filled", ~f.usable())
    return good.unionByName(bad).select(*df.columns, *made)


def filled_cells(filled: DataFrame, key: str, fields: Sequence[str], table: str) -> DataFrame:
    """Distinct (tbl, row_id, field) of every cell that was filled and got a value; rows without a key are left out."""
    marks = F.array(*[F.when(F.col(f"{c}_filled") & F.col(f"{c}_value").isNotNull(), F.lit(c)) for c in fields])
    rows = filled.where(F.col(key).isNotNull())
    return rows.select(F.lit(table).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), F.explode(F.array_compact(marks)).alias("field")).distinct()
