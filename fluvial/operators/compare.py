"""Reports: metrics by month and season, distributions, flow duration, comparison of two models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.columns import finite, half_year, seasons_of
from fluvial.operators.quantiles import quantiles as quantiles_of
from fluvial.operators.skill import analysis_metrics


def by_month(df: DataFrame, series: str = "gauge_id", date: str = "date", **names) -> DataFrame:
    """Calendar months of all years together."""
    return analysis_metrics(df.withColumn("month", F.month(date)), [series, "month"], **names)


def by_season(df: DataFrame, series: str = "gauge_id", date: str = "date", **names) -> DataFrame:
    """Overlapping seasons; each row goes to all of its seasons in one pass."""
    return analysis_metrics(df.withColumn("season", F.explode(seasons_of(date))), [series, "season"], **names)


def distribution(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, median, max of each value column."""
    aggs = []
    for v in values:
        x = finite(v)
        aggs += [F.count(x).alias(f"{v}_count"), F.avg(x).alias(f"{v}_mean"), F.stddev_samp(x).alias(f"{v}_std"), F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max")]
    out = df.groupBy(*by).agg(*aggs)
    for v in values:
        m = quantiles_of(df, by, v, {f"{v}_median": 0.5}).withColumnsRenamed({c: f"_{c}" for c in by})
        out = out.join(m, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)).drop(*[f"_{c}" for c in by])
    return out.select(*by, *[f"{v}_{n}" for v in values for n in ("count", "mean", "std", "min", "median", "max")])


def quartiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """q1, median, q3 and whiskers at 1.5 times their distance, within the data."""
    x = finite(value)
    q = quantiles_of(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    one = F.lit(1).alias("_one")
    j = (df.join(q, list(by)) if by else df.select("*", one).join(F.broadcast(q.select("*", one)), "_one")).withColumn("_x", x)  # without groups q is one row
    inside = F.min(F.when(F.col("_x") >= F.col("q1") - reach, F.col("_x"))).alias("low"), F.max(F.when(F.col("_x") <= F.col("q3") + reach, F.col("_x"))).alias("high")
    return j.groupBy(*by, "q1", "median", "q3").agg(*inside).select(*by, "q1", "median", "q3", "low", "high")


def flow_duration(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by..., rank, exceedance (percent of time at or above), value: values from the largest."""
    x = df.withColumn(value, finite(value)).where(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.desc(value)))
    return x.select(*by, rank.cast("bigint").alias("rank"), (100.0 * rank / (F.count(F.lit(1)).over(w) + 1)).alias("exceedance"), value)


def align_models(left: DataFrame, right: DataFrame, on: Sequence[str] = ("gauge_id", "date"), values: Sequence[str] = ("gnn", "observed", "other")) -> DataFrame:
    """Days that both models have, with finite values only."""
    j = left.join(right, list(on))
    j = j.withColumns({v: finite(v) for v in values})
    return j.dropna(subset=list(values))


def daily_mean(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    return df.groupBy(*by, F.to_date(time).alias("date")).agg(F.avg(finite(value)).alias(value))


def monthly(df: DataFrame, by: Sequence[str], values: Sequence[str], op: str = "sum", date: str = "date") -> DataFrame:
    """by..., month (its first day), season, and each value's sum (0 if all are missing) or mean."""
    f = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg}[op]
    m = df.groupBy(*by, F.trunc(date, "MM").alias("month")).agg(*[f(finite(v)).alias(v) for v in values])
    return m.withColumn("season", half_year("month"))


def difference(df: DataFrame, by: Sequence[str], model: str, value: str, first: str, second: str) -> DataFrame:
    """value of two models side by side and first less second."""
    p = df.groupBy(*by).pivot(model, [first, second]).agg(F.first(value, ignorenulls=True))
    return p.withColumn("difference", F.col(first) - F.col(second))


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "source", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def heat_table(df: DataFrame, row: str, column: str, keys: Sequence, value: str) -> DataFrame:
    """row by column, with the given columns in order."""
    return df.groupBy(row).pivot(column, list(keys)).agg(F.first(value))


def mapped_cells(active: DataFrame, mapped: DataFrame, cell: str = "flat_index") -> DataFrame:
    """class of each cell: mapped, unmapped (active without a source), or outside (mapped but not active)."""
    a, m = active.select(cell).distinct().withColumn("_a", F.lit(1)), mapped.select(cell).distinct().withColumn("_m", F.lit(1))
    both = a.join(m, cell, "full")
    return both.select(cell, F.when(F.col("_a").isNull(), "outside").when(F.col("_m").isNull(), "unmapped").otherwise("mapped").alias("class"))
