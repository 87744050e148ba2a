"""Skill of predictions against observations.

Four definitions of the Kling-Gupta efficiency are in use and are kept apart: in a training loss, in validation from
mergeable sums, in evaluation, and in analysis. All take long tables of (series..., prediction, observation); rows in which
either is missing or not finite are skipped. One aggregation for each result, so partial sums are combined on the map
side and a series of any length costs one row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.columns import EPS32, EPS64, col, finite, kge_skill, log_flow, ratio


def valid_pairs(df: DataFrame, prediction: str = "prediction", observation: str = "observation", mask: Column | None = None) -> DataFrame:
    """Only rows where both are finite, and the mask, if any, holds."""
    df = df.withColumns({prediction: finite(prediction), observation: finite(observation)})
    df = df.where(F.col(prediction).isNotNull() & F.col(observation).isNotNull())
    return df if mask is None else df.where(mask)


def both(prediction: str, observation: str) -> tuple[Column, Column, Column]:
    """p and o, NULL unless both are finite, and whether they are: for aggregates that must keep empty series."""
    p, o = finite(prediction), finite(observation)
    ok = p.isNotNull() & o.isNotNull()
    return F.when(ok, p), F.when(ok, o), ok


# -- evaluation --------------------------------------------------------------------------------------------------------


def series_metrics(df: DataFrame, by: Sequence[str], prediction: str = "prediction", observation: str = "observation") -> DataFrame:
    """n, mse, rmse, correlation, variability, bias, kge, nse of each series, as evaluation defines them.

    No epsilon is added: the correlation needs two points and spread in both series, variability spread in the
    observations, bias a mean observation other than 0; kge needs all three, nse spread in the observations. A series
    without valid rows has n = 0 and NULLs.
    """
    p, o, ok = both(prediction, observation)
    stats = df.groupBy(*by).agg(
        F.count_if(ok).alias("n"), F.avg(p).alias("mp"), F.avg(o).alias("mo"), F.stddev_pop(p).alias("sp"), F.stddev_pop(o).alias("so"), F.covar_pop(p, o).alias("cov"), F.avg((p - o) * (p - o)).alias("mse")
    )
    spread = lambda c: F.col(c) > EPS64
    r = F.when((F.col("n") > 1) & spread("sp") & spread("so"), ratio("cov", F.col("sp") * F.col("so")))
    a = F.when(spread("so"), ratio("sp", "so"))
    b = F.when(F.abs("mo") > EPS64, ratio("mp", "mo"))
    sst = F.col("n") * F.col("so") * F.col("so")
    stats = stats.withColumns({"correlation": r, "variability": a, "bias_ratio": b})
    distance = F.sqrt(F.pow(F.col("correlation") - 1, F.lit(2)) + F.pow(F.col("variability") - 1, F.lit(2)) + F.pow(F.col("bias_ratio") - 1, F.lit(2)))
    return stats.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "correlation", "variability", "bias_ratio", (1 - distance).alias("kge"), F.when(sst > EPS64, 1 - ratio(F.col("mse") * F.col("n"), sst)).alias("nse"))


def analysis_metrics(df: DataFrame, by: Sequence[str], prediction: str = "prediction", observation: str = "observation") -> DataFrame:
    """n, r, alpha, beta, kge, kgess, nse, bias, pbias, rmse of each group, as the analysis reports define them.

    Fewer than two valid rows: all NULL. alpha and beta have an epsilon in the denominator (beta in both), kge needs r.
    """
    p, o, ok = both(prediction, observation)
    stats = df.groupBy(*by).agg(
        F.count_if(ok).alias("n"), F.avg(p).alias("mp"), F.avg(o).alias("mo"), F.stddev_pop(p).alias("sp"), F.stddev_pop(o).alias("so"), F.covar_pop(p, o).alias("cov"),
        F.avg((p - o) * (p - o)).alias("mse"), F.sum(p - o).alias("error"), F.sum(o).alias("total"),
    )
    enough = F.col("n") >= 2
    r = F.when(enough & (F.col("sp") > EPS64) & (F.col("so") > EPS64), ratio("cov", F.col("sp") * F.col("so")))
    a = F.when(enough, ratio("sp", F.col("so") + EPS64))
    b = F.when(enough, ratio(F.col("mp") + EPS64, F.col("mo") + EPS64))
    sst = F.col("n") * F.col("so") * F.col("so")
    stats = stats.withColumns({"r": r, "alpha": a, "beta": b})
    stats = stats.withColumn("kge", 1 - F.sqrt(F.pow(F.col("r") - 1, F.lit(2)) + F.pow(F.col("alpha") - 1, F.lit(2)) + F.pow(F.col("beta") - 1, F.lit(2))))
    return stats.select(
        *by, "n", "r", "alpha", "beta", "kge", kge_skill("kge").alias("kgess"), F.when(enough & (sst > EPS64), 1 - ratio(F.col("mse") * F.col("n"), sst)).alias("nse"),
        F.when(enough, ratio("error", "n")).alias("bias"), F.when(enough, 100 * ratio("error", F.col("total") + EPS64)).alias("pbias"), F.when(enough, F.sqrt("mse")).alias("rmse"),
    )


# -- validation --------------------------------------------------------------------------------------------------------

MOMENTS = ("n", "sum_p", "sum_o", "sum_pp", "sum_oo", "sum_po", "sse")


def moments(df: DataFrame, by: Sequence[str], prediction: str = "prediction", observation: str = "observation") -> DataFrame:
    """Sums that merge over batches, files or stream epochs by adding."""
    p, o, ok = both(prediction, observation)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.groupBy(*by).agg(F.count_if(ok).alias("n"), zero(p).alias("sum_p"), zero(o).alias("sum_o"), zero(p * p).alias("sum_pp"), zero(o * o).alias("sum_oo"), zero(p * o).alias("sum_po"), zero((p - o) * (p - o)).alias("sse"))


def merge_moments(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def metrics_from_moments(df: DataFrame, by: Sequence[str], eps: float = EPS64) -> DataFrame:
    """kge_valid, r, alpha, beta, kge, nse_valid, nse, mse from moments()."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    mp, mo = F.col("sum_p") / n, F.col("sum_o") / n
    vp, vo = F.greatest(F.col("sum_pp") / n - mp * mp, F.lit(0.0)), F.greatest(F.col("sum_oo") / n - mo * mo, F.lit(0.0))
    df = df.withColumns({"mp": mp, "mo": mo, "vo": vo, "sp": F.sqrt(vp + eps), "so": F.sqrt(vo + eps), "cov": F.col("sum_po") / n - mp * mo, "sst": F.greatest(F.col("sum_oo") - n * mo * mo, F.lit(0.0))})
    df = df.withColumns({"r": ratio("cov", F.col("sp") * F.col("so") + eps), "alpha": ratio("sp", F.col("so") + eps), "beta": ratio(F.col("mp") + eps, F.col("mo") + eps)})
    kge = 1 - F.sqrt(F.pow(F.col("r") - 1, F.lit(2)) + F.pow(F.col("alpha") - 1, F.lit(2)) + F.pow(F.col("beta") - 1, F.lit(2)))
    return df.select(
        *by, "n", ((F.col("n") > 1) & (F.col("vo") > eps) & (F.abs("mo") > eps)).alias("kge_valid"), "r", "alpha", "beta", kge.alias("kge"),
        ((F.col("n") > 1) & (F.col("sst") > eps)).alias("nse_valid"), (1 - ratio("sse", F.greatest(F.col("sst"), F.lit(eps)))).alias("nse"), (F.col("sse") / n).alias("mse"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the series that are valid, and the kge of the mean components."""
    ok, okn = F.col("kge_valid"), F.col("nse_valid")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    s = metrics.agg(F.count(F.lit(1)).alias("series"), F.count_if(ok).alias("kge_series"), F.count_if(okn).alias("nse_series"), mean("kge").alias("mean_kge"), F.avg(F.when(okn, F.col("nse"))).alias("mean_nse"), mean("r").alias("mean_r"), mean("alpha").alias("mean_alpha"), mean("beta").alias("mean_beta"), F.sum("n").alias("points"))
    return s.withColumn("component_kge", 1 - F.sqrt(F.pow(F.col("mean_r") - 1, F.lit(2)) + F.pow(F.col("mean_alpha") - 1, F.lit(2)) + F.pow(F.col("mean_beta") - 1, F.lit(2))))


# -- overlapping windows -----------------------------------------------------------------------------------------------


def merge_windows(df: DataFrame, by: Sequence[str], prediction: str = "prediction", observation: str = "observation", valid: Column | None = None) -> DataFrame:
    """One row for each key from overlapping windows: mean finite prediction, mean valid observation, and how many of each."""
    p, o = finite(prediction), finite(observation)
    o = o if valid is None else F.when(valid, o)
    return df.groupBy(*by).agg(F.avg(p).alias("prediction"), F.avg(o).alias("observation"), F.count(p).alias("prediction_windows"), F.count(o).alias("observation_windows"), F.count_if(p.isNotNull() & o.isNotNull()).alias("metric_windows"))


# -- losses ------------------------------------------------------------------------------------------------------------


def series_weight(weight: Column | None) -> Column:
    """The mean weight of a series' valid rows; 1 without weights."""
    return F.lit(1.0) if weight is None else F.avg(weight)


def weighted_mean(value, weight="series_weight") -> Column:
    w = F.greatest(col(weight), F.lit(EPS64))
    return F.try_divide(F.sum(col(value) * w), F.sum(F.when(col(value).isNotNull(), w)))


def squared_error_loss(df: DataFrame, by: Sequence[str], weight: Column | None = None, transform=None, mask: Column | None = None) -> DataFrame:
    """Mean squared error in each series with its row weights, averaged over series by their mean weight."""
    pairs = valid_pairs(df, mask=mask)
    f = transform or (lambda c: c)
    error = F.pow(f(F.col("prediction")) - f(F.col("observation")), F.lit(2))
    w = F.lit(1.0) if weight is None else weight
    series = pairs.groupBy(*by).agg(F.try_divide(F.sum(w * error), F.sum(w)).alias("value"), series_weight(weight).alias("series_weight"))
    return series.agg(weighted_mean("value").alias("loss"))


def mse_loss(df, by, weight=None, mask=None):
    return squared_error_loss(df, by, weight, mask=mask)


def log_mse_loss(df, by, weight=None, mask=None):
    return squared_error_loss(df, by, weight, log_flow, mask)


def peak_weight(observation, alpha: float = 2.0, power: float = 1.0, threshold: float = 0.5, cap: float = 8.0) -> Column:
    return F.least(1 + alpha * F.pow(F.greatest(col(observation) - threshold, F.lit(0.0)), F.lit(power)), F.lit(cap))


def peak_mse_loss(df, by, weight=None, mask=None, **peak):
    w = peak_weight("observation", **peak)
    return squared_error_loss(df, by, w if weight is None else w * weight, mask=mask)


def kge_components(df: DataFrame, by: Sequence[str], eps: float = EPS32, weight: Column | None = None, mask: Column | None = None) -> DataFrame:
    """r, alpha, beta, kge of each series with more than one valid row, with epsilons as in training."""
    stats = valid_pairs(df, mask=mask).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("prediction").alias("mp"), F.avg("observation").alias("mo"), F.var_pop("prediction").alias("vp"), F.var_pop("observation").alias("vo"), F.covar_pop("prediction", "observation").alias("cov"), series_weight(weight).alias("series_weight")
    ).where("n > 1")
    n = F.col("n")
    stats = stats.select(
        *by, "series_weight", (n * F.col("cov") / (F.sqrt(n * F.col("vp") * n * F.col("vo") + eps) + eps)).alias("r"),
        (F.sqrt(F.col("vp") + eps) / (F.sqrt(F.col("vo") + eps) + eps)).alias("alpha"), ((F.col("mp") + eps) / (F.col("mo") + eps)).alias("beta"),
    )
    return stats.withColumn("kge", 1 - F.sqrt(F.pow(F.col("r") - 1, F.lit(2)) + F.pow(F.col("alpha") - 1, F.lit(2)) + F.pow(F.col("beta") - 1, F.lit(2))))


def kge_loss(df, by, weight=None, mask=None):
    return kge_components(df, by, weight=weight, mask=mask).agg((1 - weighted_mean("kge")).alias("loss"))


def kge_component_loss(df, by, weight=None, mask=None):
    """Components are averaged over series first."""
    m = kge_components(df, by, weight=weight, mask=mask).agg(*[weighted_mean(c).alias(c) for c in ("r", "alpha", "beta")])
    return m.select(F.sqrt(F.pow(F.col("r") - 1, F.lit(2)) + F.pow(F.col("alpha") - 1, F.lit(2)) + F.pow(F.col("beta") - 1, F.lit(2))).alias("loss"))


def mixed_loss(df, by, weight=None, mask=None, mse_weight: float = 0.9, kge_weight: float = 0.1):
    a, b = mse_loss(df, by, weight, mask).withColumnRenamed("loss", "mse"), kge_loss(df, by, weight, mask).withColumnRenamed("loss", "kge")
    parts = a.select(F.lit(mse_weight).alias("w"), F.col("mse").alias("x")).unionByName(b.select(F.lit(kge_weight).alias("w"), F.col("kge").alias("x")))
    return parts.agg((F.sum(F.col("w") * F.col("x")) / (mse_weight + kge_weight)).alias("loss"))


def moving_average(value: Column, window: int, by: Sequence[str], order: str) -> Column:
    """Centred mean over `window` rows of those that aren't missing; rows must stay even where missing. 1: value itself."""
    if window <= 1:
        return value
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-((window - 1) // 2), window // 2)
    return F.coalesce(F.avg(value).over(w), F.lit(0.0))


def section_mean(df: DataFrame, values: Sequence[str], length: int, by: Sequence[str], order: str, suffix: str = "_section") -> DataFrame:
    """Mean of each value over consecutive sections of `length` rows, from the first row of each series."""
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / length)
    df = df.withColumn("_section", at)
    w = Window.partitionBy(*by, "_section")
    return df.withColumns({v + suffix: F.coalesce(F.avg(v).over(w), F.lit(0.0)) for v in values}).drop("_section")


def jkge_components(df: DataFrame, by: Sequence[str], order: str, window: int = 30, section: int | None = None, eps: float = 1e-8, weight: Column | None = None) -> DataFrame:
    """Correlation, variability and benchmark mismatch of anomalies from a moving average (or a section mean)."""
    p, o, ok = both("prediction", "observation")
    d = df.select(*by, order, p.alias("p"), o.alias("o"), ok.alias("ok"), (F.lit(1.0) if weight is None else weight).alias("w"))
    if section is None:
        d = d.withColumns({"bp": moving_average(F.col("p"), window, by, order), "bo": moving_average(F.col("o"), window, by, order)})
    else:
        d = section_mean(d, ["p", "o"], section, by, order).withColumnsRenamed({"p_section": "bp", "o_section": "bo"})
    d = d.where("ok")
    sums = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("p") - F.col("bp")) * (F.col("o") - F.col("bo"))).alias("dot"), F.sum(F.pow(F.col("p") - F.col("bp"), F.lit(2))).alias("pp"),
        F.sum(F.pow(F.col("o") - F.col("bo"), F.lit(2))).alias("oo"), F.sum(F.pow(F.col("bp") - F.col("bo"), F.lit(2))).alias("dd"),
        F.var_pop("bo").alias("vb"), F.avg("bo").alias("mb"), F.avg("o").alias("mo"), F.avg("w").alias("series_weight"),
    )
    # sum of (bo - mean o) squared, from the spread of bo around its own mean
    bench = F.sqrt(F.col("n") * (F.col("vb") + F.pow(F.col("mb") - F.col("mo"), F.lit(2))))
    norm_p, norm_o = F.sqrt("pp"), F.sqrt("oo")
    return sums.where((F.col("n") > 2) & (norm_o > eps)).select(*by, "series_weight", (F.col("dot") / (norm_p * norm_o + eps)).alias("correlation"), (norm_p / (norm_o + eps)).alias("variability"), (F.sqrt("dd") / (bench + eps)).alias("mismatch"))


def jkge_loss(df: DataFrame, by: Sequence[str], order: str, **options) -> DataFrame:
    m = jkge_components(df, by, order, **options).agg(*[weighted_mean(c).alias(c) for c in ("correlation", "variability", "mismatch")])
    return m.withColumn("loss", F.sqrt(F.pow(F.col("correlation") - 1, F.lit(2)) + F.pow(F.col("variability") - 1, F.lit(2)) + F.pow(F.col("mismatch"), F.lit(2))))


LOSSES = {
    "mse": mse_loss, "log_mse": log_mse_loss, "mse_log": log_mse_loss, "peak_mse": peak_mse_loss, "peak_weighted_mse": peak_mse_loss, "kge": kge_loss,
    "kge_averaged_components": kge_component_loss, "kge_components": kge_component_loss, "jkge": jkge_loss, "mixed": mixed_loss, "mixed_mse_kge": mixed_loss,
}


def loss(name: str):
    try:
        return LOSSES[name.lower().replace("-", "_")]
    except KeyError:
        raise ValueError(f"unknown loss {name!r}; one of {sorted(LOSSES)}") from None
