"""Transfer of cell values to network nodes over a sparse weighted mapping.

mapping: source, target, weight and, as a strategy needs them, cell_area, distance, source_elevation, target_elevation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.common import checked_join, freed_shuffles, materialize, numbered, scratch, shuffled_join, small_enough, tasks_for
from fluvial.functions.columns import ACTIVATIONS, EPS64, finite, or_zero
from fluvial.operators.quantiles import quantiles

#: A source with more rows than this, of values and targets, isn't gathered into one row.
SOURCE_ROWS = 100_000
#: So many times are summed as one row.
WIDTH = 32
#: Rows of sums are made in rounds of so many.
ROUND_ROWS = 150_000
#: A task unfolds at most so many ranges of sources as they come, since it holds them all until it ends; more are written first.
RANGES = 6

STRATEGIES = ("stored", "cell_area", "inverse_distance", "exp_distance", "downhill", "downhill_distance")


def _distance() -> Column:
    """At least the side of a cell."""
    return F.greatest(F.col("distance"), F.sqrt(F.greatest(F.col("cell_area"), F.lit(0.0))))


def distance_scale(mapping: DataFrame) -> float:
    """The lower median of the distances."""
    m = quantiles(mapping, [], _distance(), {"m": (0.5, "disc")}).first()["m"]
    return 1.0 if m is None else float(m)


def transfer_weights(mapping: DataFrame, strategy: str = "stored", scale: float | None = None, preserve_sum: bool = True) -> DataFrame:
    """mapping with weight replaced. preserve_sum: each target keeps the sum of its stored weights; where all new weights of a
    target are 0, the stored ones stay."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    if strategy == "stored":
        return mapping
    area = F.col("cell_area") if "cell_area" in mapping.columns else F.col("weight")
    if strategy == "cell_area":
        new = area
    elif strategy == "inverse_distance":
        new = area / _distance()
    elif strategy == "exp_distance":
        s = scale if scale and scale > 0 else distance_scale(mapping)
        new = area * F.exp(-_distance() / max(s, EPS64))
    else:
        drop = F.greatest(F.col("source_elevation") - F.col("target_elevation"), F.lit(0.0))
        new = area * drop if strategy == "downhill" else area * drop / _distance()
    d = mapping.withColumn("_new", or_zero(new))
    if not preserve_sum:
        return d.withColumn("weight", F.col("_new")).drop("_new")
    w = Window.partitionBy("target")
    d = d.withColumns({"_sum": F.sum("_new").over(w), "_base": F.sum("weight").over(w)})
    kept = F.when(F.col("_sum") <= EPS64, F.col("weight")).otherwise(F.col("_new") * F.col("_base") / F.greatest(F.col("_sum"), F.lit(EPS64)))
    return d.withColumn("weight", kept).drop("_new", "_sum", "_base")


def normalise_by_target(mapping: DataFrame) -> DataFrame:
    total = F.sum("weight").over(Window.partitionBy("target"))
    return mapping.withColumn("weight", F.when(total > EPS64, F.col("weight") / total).otherwise(0.0))


def multipliers(mapping: DataFrame, features: dict[str, float], bias: float = 0.0, kind: str = "sigmoid") -> DataFrame:
    """weight times a learned factor of features: 2 sigmoid(z), softplus(z) over softplus(0), or z itself. Zero weights give 1
    for the first two."""
    z = F.lit(float(bias))
    for name, w in features.items():
        z = z + w * or_zero(name)
    factor = {"sigmoid": lambda: 2 * ACTIVATIONS["sigmoid"](z), "softplus": lambda: ACTIVATIONS["softplus"](z) / F.log(F.lit(2.0)), "identity": lambda: z}[kind]()
    return mapping.withColumn("weight", F.col("weight") * factor)


def _wide(v: DataFrame, times: DataFrame, time: str, width: int) -> DataFrame:
    """source, _block, _mask, _s0...: the values of v (source, time, _v), those of `width` neighbouring numbers of times (_time, _n) in a row; the mask tells which are there."""
    d = checked_join(v, times, F.col(time).eqNullSafe(F.col("_time")), "inner", row_bytes=64)
    d = d.select("source", "_v", F.floor(F.col("_n") / width).alias("_block"), F.expr(f"int(_n % {width})").alias("_slot"))
    d = d.where("source IS NOT NULL").repartition(tasks_for(v.sparkSession, v.count()), "source").groupBy("source", "_block")
    return d.agg(F.bit_or(F.expr("shiftleft(1L, _slot)")).alias("_mask"), *[F.sum(F.when(F.col("_slot") == k, F.col("_v"))).alias(f"_s{k}") for k in range(width)])


def _products(w: DataFrame, m: DataFrame, n: int, hot: DataFrame | None = None, written: bool = False) -> DataFrame:
    """target and the columns of w but its source, values weighted: w (source, _block, _mask, _s0...) times m (source, target, weight), in n tasks,
    neighbouring sources in the same.

    Both sides of a source are gathered into a row that is unfolded at once; these rows may be written, to be unfolded several times. The
    sources in hot go through a join instead.
    """
    of = [c for c in w.columns if c != "source"]
    weighted = lambda c, r="": F.col(r + c) if c in ("_block", "_mask") else (F.col(r + c) * F.col("weight")).alias(c)
    both = w.select("source", F.struct(*of).alias("_r")).unionByName(m.select("source", F.struct("target", "weight").alias("_m")), allowMissingColumns=True).where("source IS NOT NULL")
    joined = None
    if hot is not None:
        joined = shuffled_join(w.join(F.broadcast(hot), "source", "left_semi"), m.join(F.broadcast(hot), "source", "left_semi"), "source").select("target", *[weighted(c) for c in of])
        both = both.join(F.broadcast(hot), "source", "left_anti")
    gathered = both.repartitionByRange(n, "source").groupBy("source").agg(F.collect_list("_r").alias("_r"), F.collect_list("_m").alias("_m"))
    if written:
        gathered = materialize(gathered, "transfer-gathered")
    # targets first, so that a choice of them holds before their times are unfolded
    rows = gathered.select("_r", F.explode("_m").alias("_m")).select(F.explode("_r").alias("_r"), "_m.target", "_m.weight")
    rows = rows.select("target", *[weighted(c, "_r.") for c in of])
    return rows if joined is None else rows.unionByName(joined)


def _sums(v: DataFrame, m: DataFrame, value: str, time: str) -> tuple[DataFrame, DataFrame]:
    """target, time, value: the sums of the products of v (source, time, _v) and m (source, target, weight), a written table; and the times.

    The products are many more than the rows of either side, so WIDTH times are summed as one row. Ranges of sources may share all
    targets, and then each task has partial sums for every target; so no more tasks than run at once sum them. They do so in
    rounds, each for a share of the targets with at most ROUND_ROWS rows of sums, and each is written before the next starts: what a task
    holds doesn't grow with the tables, and what is shuffled at a time is a round's sums of each task. A round reads all that is
    gathered, so there are no more of them than leave a round an eighth as many products as rows are read.
    """
    spark = v.sparkSession
    with scratch(spark) as keep:
        v = materialize(v, "transfer-values")
        times = keep(numbered(v.select(F.col(time).alias("_time")).distinct(), ["_time"], "_n"), "transfer-times")
        n_times = times.count()
        width = max(1, min(WIDTH, n_times))
        w = keep(_wide(v, times, time, width), "transfer-wide")
    sizes = w.select("source", F.lit(1).alias("_w"), F.bit_count("_mask").alias("_n"), F.lit(0).alias("_m")).unionByName(m.select("source", F.lit(0).alias("_w"), F.lit(1).alias("_n"), F.lit(1).alias("_m")))
    sizes = sizes.where("source IS NOT NULL").groupBy("source").agg(*[F.sum(c).alias(c) for c in ("_w", "_n", "_m")])
    found = sizes.agg(F.sum("_n").alias("rows"), F.sum(F.col("_w").cast("double") * F.col("_m")).alias("products"), F.max("_n").alias("most")).first()
    rows, products = found.rows or 0, int(found.products or 0)
    sums = min(products, m.select("target").distinct().count() * -(-n_times // width))
    rounds = max(1, min(-(-sums // ROUND_ROWS), -(-8 * products // max(rows, 1))))
    slots, parts = [f"_s{k}" for k in range(width)], []
    with scratch(spark) as keep:
        hot = materialize(sizes.where(F.col("_n") > SOURCE_ROWS).select("source"), "transfer-hot") if (found.most or 0) > SOURCE_ROWS else None
        n, few = tasks_for(spark, rows), spark.sparkContext.defaultParallelism
        p = _products(w, m, n, hot, rounds > 1 or n > RANGES * few)
        for k in range(rounds):
            own = p.where(F.pmod(F.hash("target"), F.lit(rounds)) == k).coalesce(few)
            own = own.groupBy("target", "_block").agg(F.bit_or("_mask").alias("_mask"), *[F.sum(c).alias(c) for c in slots])
            own = own.select("target", "_block", "_mask", F.posexplode(F.array(*slots)).alias("_slot", value)).where(F.getbit("_mask", F.col("_slot")) == 1)
            own = checked_join(own.withColumn("_n", F.col("_block") * width + F.col("_slot")), times, "_n", "inner", row_bytes=64)
            parts.append(keep(own.select("target", F.col("_time").alias(time), value), "transfer-sums"))
    return reduce(DataFrame.unionByName, parts), times.select(F.col("_time").alias(time))


def transfer(values: DataFrame, mapping: DataFrame, targets: DataFrame | None = None, value: str = "value", time: str = "date") -> DataFrame:
    """target, time, value: the weighted sum of the sources' values. Missing values count as 0. With targets (target), those
    without a source have 0 at every time. The mapping is written, and broadcast if it is small; otherwise values are written, too, and both meet by
    ranges of sources, and the sums are written."""
    v = values.select("source", time, or_zero(value).alias("_v"))
    with freed_shuffles(values.sparkSession):
        m = materialize(mapping.select("source", "target", "weight"), "transfer-mapping")
        if small_enough(m, row_bytes=40):
            j = v.join(F.broadcast(m), "source").select("target", time, (F.col("_v") * F.col("weight")).alias("_p"))
            out = j.groupBy("target", time).agg(F.sum("_p").alias(value))
        else:
            out, v = _sums(v, m, value, time)
    if targets is None:
        return out
    times = v.agg(F.collect_set(time).alias("_t")).scalar()
    grid = targets.select("target").distinct().select("target", F.explode(times).alias(time))
    return grid.join(out, ["target", time], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def fraction_check(mapping: DataFrame, fraction: str = "weight") -> DataFrame:
    """Lowest, mean and highest sum of fractions of a source, and how many sources and targets there are."""
    s = mapping.groupBy("source").agg(F.sum(finite(fraction)).alias("s"))
    return s.agg(F.min("s").alias("least"), F.avg("s").alias("mean"), F.max("s").alias("most"), F.count(F.lit(1)).alias("sources"))
