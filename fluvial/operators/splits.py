"""Splits of a record into blocks whose flow distributions are alike in training, validation and test."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.functions.columns import log_flow
from fluvial.operators.quantiles import quantiles

PERIODS = ("train", "validation", "test")
FEATURES = ("mean_log_flow", "p10_log_flow", "p90_log_flow", "daily_std_log_flow", "gauge_mean_spread", "gauge_std_mean", "season_sin", "season_cos")


def blocks_of(targets: DataFrame, days: int, context: int = 0, date: str = "date") -> DataFrame:
    """targets with block_id, block_start and block_end (excluded): whole blocks of `days` days, counted from `context` days
    after the first day of the record; rows before the first and in a partial last block are left out."""
    first, last = targets.agg(F.min(date), F.max(date)).first()
    if first is None:
        return targets.withColumns({"block_id": F.lit(None).cast("bigint"), "block_start": F.col(date), "block_end": F.col(date)}).limit(0)
    offset = F.datediff(F.col(date), F.lit(first)) - context
    whole = ((last - first).days + 1 - context) // days
    block = F.floor(offset / days)
    d = targets.withColumn("block_id", block).where((offset >= 0) & (F.col("block_id") < whole))
    start = F.date_add(F.lit(first), (F.col("block_id") * days + context).cast("int"))
    return d.withColumns({"block_start": start, "block_end": F.date_add(start, days)})


def block_features(blocks: DataFrame, series: str = "gauge_id", value: str = "value", date: str = "date", min_valid: float = 0.0) -> DataFrame:
    """A row for each block: share of valid values, level and spread of log flow over all values, days and series, season."""
    b = blocks.select("block_id", "block_start", "block_end", F.col(series).alias("_s"), F.col(date).alias("_d"), log_flow(value).alias("x"))
    whole = b.groupBy("block_id", "block_start", "block_end").agg(
        (F.count("x") / F.count(F.lit(1))).alias("valid_fraction"), F.avg("x").alias("mean_log_flow")
    ).join(quantiles(b, ["block_id"], "x", {"p10_log_flow": 0.1, "p90_log_flow": 0.9}), "block_id")
    days = b.groupBy("block_id", "_d").agg(F.avg("x").alias("m")).groupBy("block_id").agg(F.stddev_pop("m").alias("daily_std_log_flow"))
    each = b.groupBy("block_id", "_s").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).groupBy("block_id").agg(F.stddev_pop("m").alias("gauge_mean_spread"), F.avg("s").alias("gauge_std_mean"))
    middle = F.date_add("block_start", F.floor(F.datediff("block_end", "block_start") / 2).cast("int"))
    angle = 2 * math.pi * (F.dayofyear(middle) - 1) / 366.0
    out = whole.join(days, "block_id").join(each, "block_id").withColumns({"season_sin": F.sin(angle), "season_cos": F.cos(angle)})
    return out.where(F.col("valid_fraction") >= min_valid)


def robust_scaled(features: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Less the median, over the distance of the quartiles (the deviation, or 1, where that is 0)."""
    long = features.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], list(names), "name", "value")
    s = {f"sd_{n}": v for n, v in features.agg(*[F.stddev_pop(n).alias(n) for n in names]).first().asDict().items()}
    for r in quantiles(long, ["name"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75}).collect():  # a row for each name
        s |= {f"med_{r['name']}": r.med, f"iqr_{r['name']}": None if r.q1 is None else r.q3 - r.q1}

    def scaled(n):
        width = next((w for w in (s.get(f"iqr_{n}"), s[f"sd_{n}"]) if w is not None and abs(w) > 1e-8), 1.0)
        return (F.col(n) - F.lit(s.get(f"med_{n}"))) / width

    return features.withColumns({n: scaled(n) for n in names})


def score(assigned: DataFrame, names: Sequence[str] = FEATURES, period: str = "period") -> DataFrame:
    """How far the periods' means and deviations of the scaled features lie from those of all blocks; less is better."""
    m = assigned.groupBy(period).agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"d_{n}") for n in names])
    g = assigned.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"d_{n}") for n in names]).first()
    far = lambda k: F.sqrt(sum((F.pow(F.col(f"{k}_{n}") - g[f"{k}_{n}"], F.lit(2)) for n in names), F.lit(0.0)))
    return m.agg(F.sum(far("m") + 0.25 * far("d")).alias("score"))


def shares(n: int, fractions: Mapping[str, float]) -> dict[str, int]:
    """n dealt out by largest remainder; of equal remainders the earlier period comes first."""
    whole = {p: math.floor(fractions[p] * n) for p in PERIODS}
    for p in sorted(PERIODS, key=lambda p: whole[p] - fractions[p] * n)[: n - sum(whole.values())]:
        whole[p] += 1
    return whole


class Balance:
    """Scores of many assignments of blocks at once. x: a row of scaled features for each block, missing ones NaN."""

    def __init__(self, x: np.ndarray):
        self.known = ~np.isnan(x)
        self.x = np.where(self.known, x, 0.0)
        #: values, squares and whether there is a value: what means and deviations are made of
        self.parts = np.stack([self.x, self.x * self.x, self.known.astype(float)])
        self.mean, self.std = np.nanmean(x, 0), np.nanstd(x, 0)

    @staticmethod
    def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sums: (3, ..., features) of values, squares and counts."""
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums[0] / sums[2]
            return mean, np.sqrt(np.maximum(sums[1] / sums[2] - mean * mean, 0.0))

    def far(self, sums: np.ndarray) -> np.ndarray:
        """How far periods with these sums, of shape (3, ..., features), lie from all blocks."""
        return self._far(*self._moments(sums))

    def _far(self, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
        out = np.linalg.norm(mean - self.mean, axis=-1) + 0.25 * np.linalg.norm(std - self.std, axis=-1)
        return np.where(np.isnan(out), math.inf, out)

    def scores(self, labels: np.ndarray) -> np.ndarray:
        """Of assignments, one a row: each period's sums are a matrix product, and its deviations are taken from its own mean."""
        total = np.zeros(len(labels))
        for p in range(len(PERIODS)):
            mine = (labels == p).astype(float)
            n = mine @ self.parts[2]
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = mine @ self.x / n
                apart = np.where(self.known, self.x - mean[:, None, :], 0.0)
                total += self._far(mean, np.sqrt(np.einsum("bn,bnf->bf", mine, apart * apart) / n))
        return total

    def first_swap(self, labels: np.ndarray, order: np.ndarray, begin: int, end: int, lowest: float) -> tuple[int, int, float] | None:
        """The first pair (i, j) of places in the order, i from begin to end, whose blocks had better change periods. Only the sums of two
        periods change, by the difference of two rows, so all partners of a block are scored together; those that may be better are then scored
        anew, since differences of sums are exact to the root of the precision only."""
        sums = np.stack([[(labels == p).astype(float) @ part for p in range(len(PERIODS))] for part in self.parts])
        each = self.far(sums)
        for i in range(begin, end):
            a = order[i]
            others = order[i + 1 :]
            others = others[labels[others] != labels[a]]
            if not len(others):
                continue
            change = self.parts[:, others] - self.parts[:, a : a + 1]
            mine, theirs = labels[a], labels[others]
            new = each.sum() - each[mine] - each[theirs] + self.far(sums[:, mine][:, None] + change) + self.far(sums[:, theirs] - change)
            for b in others[~(new >= lowest + 1e-5)]:
                trial = labels.copy()
                trial[a], trial[b] = labels[b], labels[a]
                exact = float(self.scores(trial[None])[0])
                if exact + 1e-10 < lowest:
                    return i, int(np.flatnonzero(order == b)[0]), exact
        return None


MOST_BLOCKS = 20_000
#: Numbers that are held to score assignments together.
TOGETHER = 1 << 21


def balanced(features: DataFrame, fractions: Mapping[str, float] | None = None, seed: int = 42, starts: int = 2000, passes: int = 25) -> DataFrame:
    """features with period: the best of `starts` random assignments, improved by swaps of two blocks while any helps.

    Assignments and swaps are dealt out to tasks, each of which has the blocks' scaled features, a row for each block of the record; more than
    MOST_BLOCKS are an error. Shuffles come from one sequence: a task shuffles on to the first of its own, so the result doesn't depend on how many tasks there are.
    Of equal scores the first assignment, and the first swap in a random order, counts.
    """
    spark = features.sparkSession
    fractions = fractions or {"train": 0.6, "validation": 0.2, "test": 0.2}
    rows = robust_scaled(features).orderBy("block_id").select("block_id", *FEATURES).limit(MOST_BLOCKS + 1).collect()
    if len(rows) > MOST_BLOCKS:
        raise ValueError(f"{len(rows)} blocks; the search is for at most {MOST_BLOCKS}")
    if not rows:
        return features.withColumn("period", F.lit(None).cast("string"))
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    counts = shares(len(rows), fractions)
    pool = np.repeat(np.arange(len(PERIODS)), [counts[p] for p in PERIODS])
    tasks = max(1, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(x)

    def assignments(batches):
        balance, rng, at = Balance(shared.value), np.random.default_rng(seed), 0
        many = max(1, TOGETHER // shared.value.size)
        for batch in batches:
            for k in range(0, len(batch), many):
                ids = batch.column(0).to_numpy()[k : k + many]
                trials = []
                for i in ids:
                    while at <= i:
                        trial = pool.copy()
                        rng.shuffle(trial)
                        at += 1
                    trials.append(trial)
                scores = balance.scores(np.stack(trials)).round(12)  # mirrored assignments score alike
                best = int(scores.argmin())
                yield pa.RecordBatch.from_arrays([pa.array([scores[best]]), pa.array([ids[best]]), pa.array([trials[best].tolist()], pa.list_(pa.int64()))], ["score", "id", "labels"])

    ids = spark.range(0, max(starts, 1), 1, tasks)
    top = ids.mapInArrow(assignments, "score double, id bigint, labels array<bigint>").agg(F.min(F.struct("score", "id", "labels")).alias("b")).first().b
    best, lowest = np.array(top.labels), top.score
    rng = np.random.default_rng(seed)
    for _ in range(starts):  # on to where the sequence of shuffles ends
        rng.shuffle(pool.copy())
    for _ in range(passes):
        order = rng.permutation(len(best))

        def swaps(batches, labels=best, order=order, lowest=lowest):
            balance = Balance(shared.value)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                found = balance.first_swap(labels, order, int(ids[0]), int(ids[-1]) + 1, lowest) if len(ids) else None
                hits = [found] if found else []
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["i", "j", "score"])

        hit = spark.range(0, len(best), 1, min(tasks, len(best))).mapInArrow(swaps, "i bigint, j bigint, score double").agg(F.min(F.struct("i", "j", "score")).alias("b")).first().b
        if hit is None:
            break
        a, b = order[hit.i], order[hit.j]
        best[a], best[b] = best[b], best[a]
        lowest = hit.score
    assigned = spark.createDataFrame([(r.block_id, PERIODS[k]) for r, k in zip(rows, best)], "block_id bigint, period string")
    return features.join(F.broadcast(assigned), "block_id")


def period_summary(assigned: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    return assigned.groupBy("period").agg(F.count(F.lit(1)).alias("blocks"), F.min("block_start").alias("first"), F.max("block_end").alias("last"), *[F.avg(n).alias(n) for n in names])


def load_blocks(blocks: DataFrame, period: str) -> DataFrame:
    """block_id, start, end, period of one period of a stored split, by start and end; "val" means validation. A block that
    ends before it begins, and a period without blocks, are errors when run."""
    named = F.lower("period")
    d = blocks.withColumn("period", F.when(named == "val", "validation").otherwise(named))
    d = d.where(F.col("period") == period)
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start"))
    d = d.where(F.when(bad, F.raise_error(F.concat(F.lit("invalid block "), F.col("block_id").cast("string")))).otherwise(F.lit(True)))
    if d.isEmpty():
        raise ValueError(f"no blocks of the period {period!r}")
    return d.select("block_id", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "period")
