"""Sample windows over time series, and features that look along time.

Windows are a table (window_id, start, end) with the end excluded; values reach them by the days they cover, an
equi-join, not by comparing every value with every window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.columns import col


def step_windows(df: DataFrame, steps: Column | str, length: int, stride: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., window_id, start, end (in steps) of a table with the number of steps of each series."""
    n = col(steps).cast("bigint")
    starts = F.when(n >= length, F.sequence(F.lit(0).cast("bigint"), n - length, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*by, F.posexplode(starts).alias("window_id", "start")).select(*by, F.col("window_id").cast("bigint").alias("window_id"), "start", (F.col("start") + length).alias("end"))


def day_windows(spans: DataFrame, length: int, stride: int, context: int = 0, first: str = "first", last: str = "last", by: Sequence[str] = ()) -> DataFrame:
    """by..., window_id, context_start, start, end: windows of `length` days, every `stride` days, after `context` days.

    spans: by..., first and last day. The end is excluded and at most the day after last.
    """
    begin = F.date_add(F.col(first), context)
    to = F.date_add(F.col(last), 1 - length)
    starts = F.when(to >= begin, F.sequence(begin, to, F.expr(f"INTERVAL {stride} DAY"))).otherwise(F.array().cast("array<date>"))
    w = spans.select(*by, F.col(first).alias("_first"), F.posexplode(starts).alias("window_id", "start"))
    return w.select(*by, F.col("window_id").cast("bigint").alias("window_id"), F.greatest(F.date_add("start", -context), F.col("_first")).alias("context_start"), "start", F.date_add("start", length).alias("end"))


def year_windows(spans: DataFrame, years: int, stride: int, first: str = "first", last: str = "last", by: Sequence[str] = ()) -> DataFrame:
    """Windows of whole years. Each start is a number of years after the one before, so one that has left 29 February stays
    on the 28th; a sequence from the origin would return to the 29th."""
    most = F.greatest(F.year(last) - F.year(first) + 1, F.lit(0))
    step = lambda d, n: F.add_months(d, 12 * n)
    starts = F.aggregate(F.sequence(F.lit(0), most), F.array(F.col(first)), lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1), stride))))
    w = spans.select(*by, F.col(last).alias("_last"), F.posexplode(starts).alias("window_id", "start"))
    w = w.withColumn("end", step(F.col("start"), years)).where(F.col("end") <= F.date_add("_last", 1))
    return w.select(*by, F.col("window_id").cast("bigint").alias("window_id"), "start", "end")


def whole_period(spans: DataFrame, first: str = "first", last: str = "last", by: Sequence[str] = ()) -> DataFrame:
    """by..., window_id, start, end: one window for the whole period, as validation and test use it."""
    return spans.select(*by, F.lit(0).cast("bigint").alias("window_id"), F.col(first).alias("start"), F.date_add(last, 1).alias("end"))


def segment_windows(blocks: DataFrame, length: int, stride: int, by: Sequence[str] = (), gap: int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """by..., segment_start, window_id, context_start, start, end: windows in each merged segment of blocks (end excluded)."""
    merged = merge_segments(blocks, by, start, end, gap).select(*by, F.col("start").alias("segment_start"), F.col("start").alias("first"), F.date_add("end", -1).alias("last"))
    return day_windows(merged, length, stride, by=[*by, "segment_start"])


def merge_segments(blocks: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """by..., start, end: blocks that touch or overlap, or lie up to `gap` days apart, are one segment (ends excluded)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = blocks.withColumn("_new", F.coalesce((F.col(start) > F.date_add(before, gap)).cast("int"), F.lit(1)))
    grouped = flagged.withColumn("_segment", F.sum("_new").over(w))
    return grouped.groupBy(*by, "_segment").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_segment")


def runs_of_days(days: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """by..., start, end (excluded), n: runs of consecutive days."""
    d = days.select(*by, date).distinct()
    n = F.row_number().over(Window.partitionBy(*by).orderBy(date))
    return d.withColumn("_run", F.date_add(F.col(date), -n)).groupBy(*by, "_run").agg(F.min(date).alias("start"), F.date_add(F.max(date), 1).alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def window_rows(windows: DataFrame, series: DataFrame, date: str = "date", start: str = "start", end: str = "end", by: Sequence[str] = (), context: str | None = None) -> DataFrame:
    """Rows of series in each window: windows are spread over their days and joined on the day."""
    begin = F.col(context or start)
    days = windows.withColumn(date, F.explode(F.sequence(begin, F.date_add(F.col(end), -1), F.expr("INTERVAL 1 DAY"))))
    return days.join(series, [*by, date])


def with_targets(windows: DataFrame, targets: DataFrame, value: str, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Windows that hold at least one target value."""
    hit = window_rows(windows, targets.where(F.col(value).isNotNull()), date, by=by).select(*by, "window_id").distinct()
    return windows.join(hit, [*by, "window_id"], "left_semi")


def overlapping(intervals: DataFrame, windows: DataFrame, by: Sequence[str] = (), start: str = "start_time", end: str = "end_time", bucket_days: int = 30) -> DataFrame:
    """Pairs of intervals and windows that overlap, both ends included: joined on the time buckets that both cover, each
    pair reported from the first bucket they share."""
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / bucket_days)
    spread = lambda df, a, b, name: df.withColumn(f"_first_{name}", number(a)).withColumn("_bucket", F.explode(F.sequence(number(a), number(b))))
    pairs = spread(intervals, start, end, "i").join(spread(windows, "start", "end", "w"), [*by, "_bucket"])
    pairs = pairs.where((F.col(start) <= F.col("end")) & (F.col(end) >= F.col("start")) & (F.col("_bucket") == F.greatest("_first_i", "_first_w")))
    return pairs.drop("_bucket", "_first_i", "_first_w")


def lags(df: DataFrame, value: str, steps: Sequence[int], by: Sequence[str], order: str, fill: str = "zero") -> DataFrame:
    """value_lag{k}: the value k rows before, else 0 or, with fill="repeat_first", the first value."""
    if any(k < 0 for k in steps):
        raise ValueError("lags must not be negative")
    w = Window.partitionBy(*by).orderBy(order)
    other = {"zero": F.lit(0.0), "repeat_first": F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))}[fill]
    n = F.row_number().over(w)
    return df.withColumns({f"{value}_lag{k}": F.when(n > k, F.lag(value, k).over(w)).otherwise(other) if k else F.col(value) for k in steps})


def drop_first(df: DataFrame, n: int, by: Sequence[str], order: str) -> DataFrame:
    """Without the first n rows of each series (warm-up, context)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") > n).drop("_n")


def align_tails(left: DataFrame, right: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Rows of both counted from the end, as far as both reach: series of unequal length meet at their last rows."""
    back = lambda df: df.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))))
    r = back(right).drop(order)
    return back(left).join(r, [*by, "_back"]).drop("_back")


def spin_up(df: DataFrame, length: int, base: int, by: Sequence[str], order: str) -> DataFrame:
    """`length` rows before each series that repeat its first `base` rows; step counts from -length."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    first = df.withColumn("_n", n).where(F.col("_n") < base)
    return first.withColumn("step", F.explode(F.sequence(F.col("_n"), F.lit(length - 1), F.lit(base)))).withColumn("step", F.col("step") - length).drop("_n")


def filtered(df: DataFrame, value: str, weights: Sequence[float], by: Sequence[str], order: str, causal: bool = False, dilation: int = 1, name: str | None = None) -> DataFrame:
    """A weighted sum along time, rows beyond the ends counting as 0: centred (odd number of weights), or causal."""
    if not causal and len(weights) % 2 == 0:
        raise ValueError("a centred filter needs an odd number of weights")
    w = Window.partitionBy(*by).orderBy(order)
    half = len(weights) - 1 if causal else len(weights) // 2
    total = F.lit(0.0)
    for k, weight in enumerate(weights):
        shift = (half - k) * dilation
        total = total + weight * F.coalesce(F.lag(value, shift).over(w) if shift >= 0 else F.lead(value, -shift).over(w), F.lit(0.0))
    return df.withColumn(name or f"{value}_filtered", total)


def reduce_steps(df: DataFrame, value: str, k: int, by: Sequence[str], order: str, op: str = "mean", strict: bool = True, start: bool = False) -> DataFrame:
    """Sum or mean over consecutive groups of k rows; a series that k doesn't divide raises an error when run. start: with the first `order` of
    each group."""
    w = Window.partitionBy(*by)
    n = F.row_number().over(w.orderBy(order)) - 1
    d = df.withColumns({"_n": n, "_all": F.count(F.lit(1)).over(w)})
    if strict:
        d = d.where(F.when(F.col("_all") % k != 0, F.raise_error(F.lit(f"the number of steps must be a multiple of {k}"))).otherwise(F.lit(True)))
    f = {"mean": F.avg, "sum": F.sum}[op]
    return d.groupBy(*by, F.floor(F.col("_n") / k).alias("step")).agg(f(value).alias(value), *([F.min(order).alias(order)] if start else []))


def median_step_seconds(df: DataFrame, by: Sequence[str], time: str = "time") -> DataFrame:
    """by..., start_time, end_time, n_steps, step_seconds: the median distance of neighbouring times."""
    w = Window.partitionBy(*by).orderBy(time)
    step = F.unix_micros(F.lead(time).over(w).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return df.select(*by, time).distinct().withColumn("_step", step / 1e6).groupBy(*by).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("n_steps"), F.median("_step").alias("step_seconds"))


def manifest_times(manifest: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """by..., time: the times that a manifest row stands for; a bad step becomes the mean step."""
    start, end = F.unix_micros(F.col("start_time").cast("timestamp")), F.unix_micros(F.col("end_time").cast("timestamp"))
    mean = F.try_divide((end - start).cast("double") / 1e6, F.col("n_steps") - 1)
    step = F.coalesce(F.when(F.col("step_seconds") > 0, F.col("step_seconds")), mean, F.lit(0.0))
    return manifest.select(*by, start.alias("_s"), step.alias("_d"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_steps") - 1)).alias("_k")).select(*by, F.timestamp_micros((F.col("_s") + F.col("_k") * F.col("_d") * 1e6).cast("bigint")).cast("timestamp_ntz").alias("time"))
