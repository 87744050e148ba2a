"""Exact quantiles of groups of any size, without a task that holds a group.

A KLL sketch for each group, merged by aggregation, brackets each wanted rank; counts below and within the bracket tell whether the rank lies in it and
how far; brackets that hold too many values get a sketch of their own, until what is left in each is at most `within` distinct values, which are
counted and walked in order. Each round shrinks a bracket to a few thousandths, so a group of 10^12 values takes four
or five passes over the table, and each pass moves one row for each group and task. The values in the middle of a bracket are counted apart, and don't belong to what
is left of it, so each round ends or shrinks a bracket even where most values are equal. A sketch that misses its rank only costs a further round:
the result doesn't depend on the sketches.

Missing and not finite values don't count. A group without values has quantiles NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.common import checked_join, materialize
from fluvial.functions.columns import finite

#: Items of a sketch; its rank error is about 2.3 / K ** 0.9 of the group.
K = 1024
#: A sketch is read at so many equal shares.
GRID = 1000
#: A bracket with at most so many distinct values is walked.
WITHIN = 10_000


def _ranks(p: float, kind: str, n: Column) -> tuple[Column, Column, Column]:
    """The two order statistics, from 0, that make a quantile, and the weight of the second."""
    if kind == "cont":
        h = F.lit(p) * (n - 1)
        k = F.floor(h)
        return k, F.least(k + 1, n - 1), h - k
    k = F.greatest(F.ceil(F.round(F.lit(p) * n, 9)) - 1, F.lit(0))
    return k, k, F.lit(0.0)


def order_statistics(df: DataFrame, by: Sequence[str], value: str, wanted: DataFrame, k: int = K, within: int = WITHIN) -> DataFrame:
    """by..., rank, value for each (by..., rank) of wanted. df: by..., value without missing values; wanted also has n, the group's size."""
    keys = [*by, "rank"]
    err = 2.3 / k**0.9

    read = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))

    def bracketed(d: DataFrame, n: str, at: Column) -> DataFrame:
        """keys, lo, mid, hi for a rank by a sketch of n values between least and most, `at` being the rank among them."""
        low = F.floor(((at - 1) / F.col(n) - err) * GRID).cast("int")
        high = F.ceil(((at + 2) / F.col(n) + err) * GRID).cast("int")
        mid = F.least(F.greatest(F.round((at + 0.5) / F.col(n) * GRID), F.lit(0)), F.lit(GRID)).cast("int")
        d = d.select(*keys, "least", "most", low.alias("_low"), mid.alias("_mid"), high.alias("_high"), read.alias("_grid"))
        clipped = lambda c: F.greatest(F.least(c, F.col("most")), F.col("least"))
        lo = F.when(F.col("_low") <= 0, F.col("least")).otherwise(clipped(F.get("_grid", "_low")))
        hi = F.when(F.col("_high") >= GRID, F.col("most")).otherwise(clipped(F.get("_grid", "_high")))
        return d.select(*keys, lo.alias("lo"), clipped(F.get("_grid", "_mid")).alias("mid"), hi.alias("hi"), "least", "most")

    def joined(right: DataFrame) -> DataFrame:
        return checked_join(df, right, list(by), "inner", row_bytes=64) if by else df.crossJoin(F.broadcast(right))  # right: a row for each rank

    first = materialize(df.groupBy(*by).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"), F.min("v").alias("least"), F.max("v").alias("most")), "quantile-sketches")
    start = first.join(wanted, list(by)) if by else first.crossJoin(F.broadcast(wanted))  # without groups, one row and a few
    open_ = materialize(bracketed(start, "n", F.col("rank")), "quantile-brackets")
    done: list[DataFrame] = []
    v, lo, mid, hi = F.col("v"), F.col("b.lo"), F.col("b.mid"), F.col("b.hi")
    while not open_.isEmpty():
        # brackets of a group, in a row: each value is compared with all of them
        ranges = open_.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "mid", "hi", "least", "most"))).alias("b"))
        # what can't be in any bracket only counts as below; values of a wider range take part for a rank that the sketch missed
        seen = joined(ranges).select(*by, "v", F.explode("b").alias("b"))
        left, right = v.between(lo, hi) & (v < mid), v.between(lo, hi) & (v > mid)
        sketch = lambda c: F.kll_sketch_agg_double(F.when(c, v), F.lit(k))
        counted = seen.groupBy(*by, F.col("b.rank").alias("rank")).agg(
            F.count_if(v < lo).alias("n_below"), F.count_if(left).alias("n_left"), F.count_if(v == mid).alias("n_mid"), F.count_if(right).alias("n_right"),
            F.max(F.when(v < lo, v)).alias("top_below"), F.max(F.when(left, v)).alias("top_left"), F.min(F.when(right, v)).alias("low_right"), F.min(F.when(v > hi, v)).alias("low_above"),
            sketch(left).alias("s_left"), sketch(right).alias("s_right"),
        )
        state = open_.join(counted, keys).withColumns({"u1": F.col("n_below"), "u2": F.col("n_below") + F.col("n_left")})
        state = state.withColumns({"u3": F.col("u2") + F.col("n_mid"), "u4": F.col("u2") + F.col("n_mid") + F.col("n_right")})
        state = materialize(state, "quantile-counts")
        rank = F.col("rank")
        done.append(state.where((rank >= F.col("u2")) & (rank < F.col("u3"))).select(*keys, F.col("mid").alias("value")))
        sides = [
            state.where((rank >= F.col("u1")) & (rank < F.col("u2"))).select(*keys, F.col("lo").alias("least"), F.col("top_left").alias("most"), F.col("u1").alias("before"), F.col("n_left").alias("n"), F.col("s_left").alias("sketch")),
            state.where((rank >= F.col("u3")) & (rank < F.col("u4"))).select(*keys, F.col("low_right").alias("least"), F.col("hi").alias("most"), F.col("u3").alias("before"), F.col("n_right").alias("n"), F.col("s_right").alias("sketch")),
        ]
        inside = sides[0].unionByName(sides[1])
        # few enough values: counted by value and walked in order
        few = inside.where(F.col("n") <= within).select(*keys, "least", "most", "before")
        counts = joined(few).where(v.between(F.col("least"), F.col("most"))).groupBy(*keys, "before", "v").agg(F.count(F.lit(1)).alias("c"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
        done.append(counts.withColumn("upto", upto).where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c"))).select(*keys, v.alias("value")))
        more = inside.where(F.col("n") > within)
        more = bracketed(more, "n", rank - F.col("before"))
        missed = lambda low, high: [F.col(low).alias("lo"), F.col(low).alias("mid") if low != "least" else F.col(high).alias("mid"), F.col(high).alias("hi"), "least", "most"]
        below = state.where(rank < F.col("u1")).select(*keys, *missed("least", "top_below"))
        above = state.where(rank >= F.col("u4")).select(*keys, *missed("low_above", "most"))
        open_ = materialize(more.unionByName(below).unionByName(above), "quantile-brackets")
    if not done:
        return open_.select(*keys, F.col("lo").alias("value"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return materialize(out, "order-statistics")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, shares: Mapping[str, float | tuple[float, str]], k: int = K, within: int = WITHIN) -> DataFrame:
    """by..., one column for each of shares, with the quantile of the value's finite values in the group.

    shares: the column's name to a share, interpolated between neighbours, or to (share, "disc"), the first value whose
    cumulative share is at least that much.
    """
    kinds = {name: s if isinstance(s, tuple) else (s, "cont") for name, s in shares.items()}
    d = df.select(*by, finite(value).alias("v"))
    groups = materialize(d.groupBy(*by).agg(F.count("v").alias("n")), "quantile-groups")
    d = d.where("v IS NOT NULL")
    ranks = {name: _ranks(p, kind, F.col("n")) for name, (p, kind) in kinds.items()}
    every = F.array_distinct(F.array(*[r.cast("bigint") for a, b, _ in ranks.values() for r in (a, b)]))
    wanted = groups.where("n > 0").select(*by, "n", F.explode(every).alias("rank"))
    found = order_statistics(d, by, "v", wanted, k, within)
    listed = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    j = groups.join(listed, list(by), "left") if by else groups.join(F.broadcast(listed), F.lit(True), "left")

    def made(name):
        a, b, weight = ranks[name]
        low, high = F.col("_at")[a.cast("bigint")], F.col("_at")[b.cast("bigint")]
        return F.when(F.col("n") > 0, low + (high - low) * weight)

    return j.select(*by, *[made(name).alias(name) for name in kinds])


#: Groups with at most so many values are left to the engine's percentile, which holds a group in a task.
SMALL = 1_000_000


def quantiles(df: DataFrame, by: Sequence[str], value: Column | str, shares: Mapping[str, float | tuple[float, str]], small: int = SMALL) -> DataFrame:
    """As exact_quantiles(), in one aggregation for groups of at most `small` values and by selection for larger ones. Null keys are a group."""
    x = finite(value)
    kinds = {name: s if isinstance(s, tuple) else (s, "cont") for name, s in shares.items()}
    d = df.select(*([F.struct(*by).alias("_g")] if by else []), x.alias("v"))
    keys = ["_g"] if by else []
    large = materialize(d.groupBy(*keys).agg(F.count("v").alias("n")).where(F.col("n") > small).select(*keys, "n"), "large-groups")
    built_in = [(F.percentile("v", p) if kind == "cont" else F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY v)")).alias(name) for name, (p, kind) in kinds.items()]
    if large.isEmpty():
        out = d.groupBy(*keys).agg(*built_in)
    elif not by:
        out = exact_quantiles(d, [], "v", kinds)
    else:
        rest = checked_join(d, large, "_g", "left_anti", row_bytes=64).groupBy("_g").agg(*built_in)
        out = rest.unionByName(exact_quantiles(checked_join(d, large.select("_g"), "_g", "left_semi", row_bytes=64), ["_g"], "v", kinds))
    return out.select(*([F.col("_g")[c].alias(c) for c in by]), *kinds)
