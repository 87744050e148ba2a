"""Rules that are verified while a table is written, in the same pass, by observed metrics: no join or count of its own.

A rule is a condition that no row may meet. write_checked() writes the table and then knows, of each rule, how many rows broke it; with strict, broken rules
are an error, and what was written goes again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fluvial.common import _file_system


class RulesBroken(ValueError):
    pass


def write_checked(df: DataFrame, path: str, rules: Mapping[str, Column], keep: Sequence[str] | None = None, example: str | None = None, strict: bool = True, mode: str = "errorifexists") -> dict:
    """Write df (its columns `keep`, if given) as Parquet. Returns rows, and for each rule how many rows broke it.

    example: a column of which the smallest value of a row that breaks any rule is told.
    """
    seen = Observation()
    broken = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()]
    anyone = [F.min(F.when(F.coalesce(*[F.when(c, True) for c in rules.values()], F.lit(False)), F.col(example).cast("string"))).alias("example")] if example and rules else []
    d = df.observe(seen, F.count(F.lit(1)).alias("rows"), *broken, *anyone)
    # columns that only rules need are dropped after they have been observed
    (d.select(*keep) if keep else d).write.mode(mode).parquet(path)
    out = dict(seen.get)
    faults = {name: out[name] for name in rules if out[name]}
    if strict and faults:
        file_system, at = _file_system(df.sparkSession, path)
        file_system.delete(at, True)
        raise RulesBroken(f"{path}: {faults}" + (f", for instance {example} {out['example']}" if anyone else ""))
    return out


def aligned(left: DataFrame, right: DataFrame, on: Sequence[str], path: str, strict: bool = True) -> dict:
    """Write the join of left with right, every row of left having exactly one match; rows without one, and keys that right has more than once, are counted while
    that is done."""
    many = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in on])
    j = left.join(many, list(on), "left")
    rules = {"unmatched": F.col("_n").isNull(), "ambiguous": F.col("_n") > 1}
    keep = [*left.columns, *[c for c in right.columns if c not in on]]
    return write_checked(j, path, rules, keep, on[0], strict)


def graph_rules(tables: Mapping[str, DataFrame]) -> dict[str, tuple[DataFrame, dict[str, Column], list[str]]]:
    """For each table of a graph (nodes: node; edges: src, dst, weight; gauges: node; sources: target, weight) what is to be written, the rules, and
    its columns: nodes are numbered from 0 without gaps, and everything refers to nodes that there are."""
    nodes = tables["nodes"]
    known = nodes.select(F.col("node").alias("_node"), F.lit(True).alias("_hit")).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("_of"))
    twice = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("_times"))
    out = {"nodes": (nodes.join(twice, "node", "left").crossJoin(F.broadcast(n)), {"node missing": F.col("node").isNull(), "node twice": F.col("_times") > 1, "node out of range": (F.col("node") < 0) | (F.col("node") >= F.col("_of"))}, nodes.columns)}
    for name, refers in (("edges", ("src", "dst")), ("gauges", ("node",)), ("sources", ("target",))):
        if name not in tables:
            continue
        d, rules = tables[name], {}
        for c in refers:
            d = d.join(known.withColumnsRenamed({"_node": f"_n_{c}", "_hit": f"_h_{c}"}), F.col(c) == F.col(f"_n_{c}"), "left")
            rules[f"{c} without a node"] = F.col(f"_h_{c}").isNull()
        if "weight" in d.columns:
            rules["weight not finite"] = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf"))
        if name == "edges":
            rules["loop"] = F.col("src") == F.col("dst")
        out[name] = (d, rules, tables[name].columns)
    return out


def write_graph_checked(tables: Mapping[str, DataFrame], path: str, strict: bool = True) -> dict[str, dict]:
    """Write each table of a graph under path, and what its rules have found."""
    return {name: write_checked(d, f"{path}/{name}", rules, keep, strict=strict) for name, (d, rules, keep) in graph_rules(tables).items()}
