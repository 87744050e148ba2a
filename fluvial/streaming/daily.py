"""Daily aggregates and metric sums over unbounded input.

Windows are tumbling days with a watermark. Metric sums add up, so a stream keeps one row for each series. Event time must
be TIMESTAMP: a TIMESTAMP_NTZ column is read as UTC.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.functions.columns import finite
from fluvial.operators.skill import both


def event_time(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp"))


def daily_stream(df: DataFrame, by: Sequence[str], time: str = "time", value: str = "value", late: str = "1 day") -> DataFrame:
    """by..., date, n, total, mean, low, high of each day. In append mode a day is put out once the watermark has passed it."""
    x = finite(value)
    w = event_time(df, time).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), *by)
    out = w.agg(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))
    return out.select(*by, F.to_date("w.start").alias("date"), "n", "total", "mean", "low", "high")


def moment_stream(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums of skill.moments() for each series, for complete or update mode; skill.metrics_from_moments() reads them."""
    p, o, ok = both("prediction", "observation")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.groupBy(*by).agg(F.count_if(ok).alias("n"), zero(p).alias("sum_p"), zero(o).alias("sum_o"), zero(p * p).alias("sum_pp"), zero(o * o).alias("sum_oo"), zero(p * o).alias("sum_po"), zero((p - o) * (p - o)).alias("sse"))


def lstm_stream(df: DataFrame, features: Sequence[str], weights: Mapping, by: str = "node", order: str = "date", activation: str = "softplus") -> DataFrame:
    """by, order, value as routing.lstm() gives them, of a stream whose batches bring later times: a series' state is kept from batch to
    batch, whatever the length of the series. A row that isn't later than its series' last one is an error."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from fluvial.operators.routing import Recurrence

    cell = Recurrence(weights, activation)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(key, parts, state):
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        held, last = (np.array(state.get[0]).reshape(1, -1), state.get[1]) if state.exists else (np.zeros((1, cell.size)), None)
        if last is not None and str(pdf[order].iloc[0]) <= last:
            raise ValueError(f"{by} {key[0]}: {pdf[order].iloc[0]} isn't later than {last}")
        out = np.empty(len(pdf))
        for k, x in enumerate(pdf[list(features)].to_numpy(float)):
            out[k : k + 1], held = cell.step(x.reshape(1, -1), held)
        state.update((held[0].tolist(), str(pdf[order].iloc[-1])))
        yield pd.DataFrame({by: pdf[by], order: pdf[order], "value": out})

    grouped = df.select(by, order, *features).groupBy(by)
    return grouped.applyInPandasWithState(run, f"{by} {kinds[by]}, {order} {kinds[order]}, value double", "state array<double>, last string", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Put out all that has arrived, and stop. Append mode writes Parquet; complete mode replaces it with each batch."""
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(path)
    else:
        q = w.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
