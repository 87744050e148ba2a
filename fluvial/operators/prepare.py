"""From raw observations to model-ready series: daily aggregation, calendars, scalers, transforms.

Tables are long: (cell, time, variable, value). One aggregation serves all variables of a plan, so the input is read and
shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.columns import EPS32, INVERSE_TRANSFORMS, SECONDS_PER_HOUR, TIME_FEATURES, TRANSFORMS, clip, col, finite, number_label, text_label
from fluvial.operators.quantiles import quantiles

AGGREGATES = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class DailyRule:
    variable: str
    op: str = "mean"
    factor: float = 1.0
    name: str | None = None


def daily_plan(variables: Sequence[str], rules: Mapping[str, DailyRule] | None = None) -> list[DailyRule]:
    """A rule for each variable; without one, rain rates add up to a daily depth and all else is averaged."""
    rules = rules or {}
    plan = []
    for v in variables:
        rule = rules.get(v) or (DailyRule(v, "sum", SECONDS_PER_HOUR, f"{v}_daily") if v == "RAINRATE" else DailyRule(v))
        if rule.op not in AGGREGATES:
            raise ValueError(f"unknown aggregation {rule.op!r} for {v}; one of {sorted(AGGREGATES)}")
        plan.append(rule)
    return plan


def aggregate_daily(df: DataFrame, plan: Sequence[DailyRule], by: Sequence[str], time: str = "time", variable: str = "variable", value: str = "value", min_steps: int | None = None, strict: bool = False) -> DataFrame:
    """by..., date, name, value: days that have rows. A day whose values are all missing sums to 0 and has no mean.

    min_steps: days with fewer time steps are left out, or with strict raise an error.
    """
    rules = {r.variable: r for r in plan}
    factor = F.lit(1.0)
    for r in plan:
        if r.factor != 1.0:
            factor = F.when(F.col(variable) == r.variable, r.factor).otherwise(factor)
    d = df.where(F.col(variable).isin(list(rules))).select(*by, F.to_date(time).alias("date"), F.col(variable).alias("variable"), (finite(value) * factor).alias("v"), F.col(time).alias("_t"))
    ops = {r.op for r in plan}
    steps = [F.countDistinct("_t").alias("_steps")] if min_steps else []
    out = d.groupBy(*by, "date", "variable").agg(*[AGGREGATES[o]("v").alias(o) for o in sorted(ops)], *steps)
    if min_steps:
        few = F.col("_steps") < min_steps
        out = out.withColumn("_ok", F.when(few, F.raise_error(F.concat(F.lit("day with too few steps: "), F.col("date").cast("string")))).otherwise(F.lit(True))).where("_ok") if strict else out.where(~few)
    pick, name = F.lit(None).cast("double"), F.col("variable")
    for r in plan:
        is_it = F.col("variable") == r.variable
        pick, name = F.when(is_it, F.col(r.op)).otherwise(pick), F.when(is_it, F.lit(r.name or r.variable)).otherwise(name)
    return out.select(*by, "date", name.alias("name"), pick.alias("value"))


def calendar(first: Column | str, last: Column | str, spark_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., date: every day from first to last of each group of a table of (by..., first, last)."""
    return spark_df.select(*by, F.explode(F.sequence(col(first).cast("date"), col(last).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("date"))


def densify(daily: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """A row for each day between the first and last of each series; gap days have NULLs."""
    span = daily.groupBy(*by).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    return calendar("_first", "_last", span, by).withColumnRenamed("date", date).join(daily, [*by, date], "left")


def reindex(targets: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Every series on the union of all dates; missing ones are NULL. Dates are given to each series as one array."""
    # a scalar subquery; the array has one entry for each day of the record, some ten thousand for decades
    dates = targets.agg(F.sort_array(F.collect_set(date)).alias("_dates")).scalar()
    grid = targets.select(key).distinct().select(key, F.explode(dates).alias(date))
    return grid.join(targets, [key, date], "left")


def common_days(left: DataFrame, right: DataFrame, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Both tables on the days that both have."""
    l, r = left.select(date).distinct(), right.select(date).distinct()
    return left.join(r, date, "left_semi"), right.join(l, date, "left_semi")


def require_all(left: DataFrame, right: DataFrame, on: Sequence[str], what: str = "key") -> DataFrame:
    """Inner join that raises an error, when run, for rows of left without a match."""
    marked = left.join(right.withColumn("_hit", F.lit(True)), list(on), "left")
    missing = F.raise_error(F.concat(F.lit(f"no {what}: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
    return marked.where(F.when(F.col("_hit").isNull(), missing).otherwise(F.lit(True))).drop("_hit")


def same_days(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Days that only one of the tables has: empty if they agree."""
    l, r = left.select(date).distinct(), right.select(date).distinct()
    return l.join(r, date, "left_anti").withColumn("only_in", F.lit("left")).unionByName(r.join(l, date, "left_anti").withColumn("only_in", F.lit("right")))


def in_period(df: DataFrame, start, end, time: str = "date") -> DataFrame:
    """Both ends included."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))


def channels(df: DataFrame, variable: str, dims: Mapping[str, str]) -> DataFrame:
    """variable, pos, name: a row for each channel that a variable with leading dimensions has, that of the last one varying fastest.

    dims: a dimension's name to the column that holds its coordinates, an array, or its size, if it has none. A name is the variable's, then
    dimension_coordinate or, counting from 0, dimension and number. Without dimensions the variable is one channel.
    """
    d = df.select(F.col(variable).alias("variable"), F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("parts"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(dims.values())])
    for k, dim in enumerate(dims):
        kind = d.schema[f"_{k}"].dataType
        c = F.col(f"_{k}")
        if kind.typeName() == "array":
            label = number_label if kind.elementType.typeName() in ("float", "double") else lambda x: text_label(x.cast("string"))
            coordinates, size, prefix = F.transform(c, label), F.size(c), f"{dim}_"
        else:
            coordinates, size, prefix = F.when(c > 0, F.transform(F.sequence(F.lit(0), c.cast("int") - 1), lambda i: i.cast("string"))), c, dim
        d = d.withColumns({"_n": size, "_c": coordinates}).select(*d.columns, "_n", F.posexplode("_c").alias("_i", "_v"))
        d = d.withColumns({"pos": F.col("pos") * F.col("_n") + F.col("_i"), "parts": F.array_append("parts", F.concat(F.lit(prefix), "_v"))}).drop("_n", "_i", "_v")
    name = F.concat_ws("__", F.col("variable"), *([F.concat_ws("__", "parts")] if dims else []))
    return d.select("variable", "pos", name.alias("name"))


# -- scalers -----------------------------------------------------------------------------------------------------------


def standard_scaler(df: DataFrame, by: Sequence[str], value: str = "value", floor: float = 1e-6, replace: float | None = 1.0) -> DataFrame:
    """by..., mean, std (population). Deviations up to floor become `replace`, or floor itself if that is None."""
    x = finite(value)
    std = F.stddev_pop(x)
    std = F.when(std > floor, std).otherwise(F.lit(replace)) if replace is not None else F.greatest(std, F.lit(floor))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), std.alias("std"))


def percentile_scaler(df: DataFrame, by: Sequence[str], value: str = "value", low: float = 0.01, high: float = 0.99, bounds: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """by..., mean (the lower percentile or bound), std (upper less lower; 1 if that is at most 1e-6)."""
    given = {"mean": bounds[0], "_high": bounds[1]}
    found = quantiles(df, by, value, {c: share for c, share in (("mean", low), ("_high", high)) if given[c] is None})
    scale = found.select(*by, *[(F.col(c) if v is None else F.lit(float(v))).alias(c) for c, v in given.items()])
    return scale.select(*by, "mean", F.when(F.col("_high") - F.col("mean") > 1e-6, F.col("_high") - F.col("mean")).otherwise(1.0).alias("std"))


def scaler_sums(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Count, sum and sum of squares, which add up over files, batches and epochs."""
    x = finite(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("ss"))


def scaler_from_sums(sums: DataFrame, by: Sequence[str], floor: float = 1e-6) -> DataFrame:
    m = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.try_divide("s", "n")
    return m.select(*by, mean.alias("mean"), F.greatest(F.sqrt(F.greatest(F.try_divide("ss", "n") - mean * mean, F.lit(0.0))), F.lit(floor)).alias("std"))


def sample_scaler(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """As node features are scaled: the sample deviation, at least the precision of a 32-bit float."""
    x = finite(value)
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.greatest(F.stddev_samp(x), F.lit(EPS32)).alias("std"))


def scale(df: DataFrame, scaler: DataFrame, by: Sequence[str], value: str = "value", transform: str = "none", limits: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Transformed, scaled and clipped values; scaler has a row for each series and is joined."""
    x = (TRANSFORMS[transform](finite(value)) - F.col("mean")) / F.col("std")
    return df.join(scaler, list(by), "left").withColumn(value, clip(x, *limits)).drop("mean", "std")


def unscale(df: DataFrame, scaler: DataFrame, by: Sequence[str], value: str = "value", transform: str = "none") -> DataFrame:
    return df.join(scaler, list(by), "left").withColumn(value, INVERSE_TRANSFORMS[transform](finite(value) * F.col("std") + F.col("mean"))).drop("mean", "std")


def time_features(df: DataFrame, names: Sequence[str] = tuple(TIME_FEATURES), date: str = "date") -> DataFrame:
    unknown = set(names) - set(TIME_FEATURES)
    if unknown:
        raise ValueError(f"unknown time features {sorted(unknown)}; some of {sorted(TIME_FEATURES)}")
    return df.withColumns({n: TIME_FEATURES[n](date) for n in names})


def total_runoff(df: DataFrame, surface: str = "RUNSF", subsurface: str = "RUNSB", name: str = "runoff_total") -> DataFrame:
    """The sum of both runoff components where both columns exist (names in any case); missing counts as 0."""
    have = {c.lower(): c for c in df.columns}
    if surface.lower() not in have or subsurface.lower() not in have:
        return df
    zero = lambda c: F.coalesce(finite(have[c.lower()]), F.lit(0.0))
    return df.withColumn(name, zero(surface) + zero(subsurface))


def complete_years(df: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """year and n of the years with all their hours: 8760, or 8784 in leap years."""
    return df.groupBy(*by, F.year(time).alias("year")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").isin(8760, 8784))


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of names that is a column (not the first that has a value), as a number; missing otherwise."""
    for n in names:
        if n in df.columns:
            return finite(n)
    return F.lit(None).cast("double")


def exclude(df: DataFrame, unwanted: DataFrame | Sequence[str], key: str = "gauge_id") -> DataFrame:
    """df without the rows whose key is in a list, or in a table's column of that name."""
    if isinstance(unwanted, DataFrame):
        return df.join(unwanted.select(key), key, "left_anti")
    return df.where(~F.coalesce(F.col(key).isin(list(unwanted)), F.lit(False)))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in an order, as many as a report or a look at a table needs; n is small."""
    return df.orderBy(*order).limit(n)
