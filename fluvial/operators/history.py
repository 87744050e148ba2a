"""Queries on training histories: best epochs, early stopping, stage weights. A history has a row for each epoch of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_epochs(history: DataFrame, by: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """by..., best_epoch, best_loss: the first epoch with the lowest loss; missing losses don't count."""
    ok = history.where(F.col(loss).isNotNull())
    return ok.groupBy(*by).agg(F.min(F.struct(loss, epoch)).alias("b")).select(*by, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{loss}").alias("best_loss"))


def improvements(history: DataFrame, by: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """history with is_best: epochs at which a new lowest loss was reached, that is when a checkpoint is kept."""
    before = F.min(loss).over(Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("is_best", F.col(loss).isNotNull() & (before.isNull() | (F.col(loss) < before)))


def stop_epochs(history: DataFrame, patience: int, min_delta: float = 0.0, by: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """by..., stop_epoch: the epoch after which training stops, NULL if it doesn't. An epoch improves if its loss is below
    the last improvement's by more than min_delta; training stops after `patience` epochs in a row that don't.

    The last improvement depends on all before it, so each run is folded over its losses; a run has few epochs.
    """
    runs = history.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(epoch).alias("e"), F.coalesce(F.col(loss), F.lit(float("inf"))).alias("v")))).alias("h"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"))

    def step(a, x):
        better = x["v"] < a["best"] - min_delta
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        done = F.coalesce(a["stop"], F.when(bad >= patience, x["e"].cast("bigint")))
        return F.struct(F.when(better, x["v"]).otherwise(a["best"]).alias("best"), bad.alias("bad"), done.alias("stop"))

    return runs.select(*by, F.aggregate("h", start, step)["stop"].alias("stop_epoch"))


def gauge_weights(gauges: DataFrame, weights: Mapping[str, float] | None = None, stage: Sequence[str] | None = None, outlets: Sequence[str] = (), outlet_weight: float = 1.0, gauge: str = "gauge_id") -> DataFrame:
    """gauge_id, weight of a stage's gauges: the given weight, else that of outlets, else 1. stage: its gauges; None: all."""
    w = F.when(F.col(gauge).isin(list(outlets)), outlet_weight).otherwise(1.0) if outlets else F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col(gauge) == name, float(value)).otherwise(w)
    d = gauges if stage is None else gauges.where(F.col(gauge).isin(list(stage)))
    return d.select(gauge, w.alias("weight"))
