"""Command line: python -m fluvial.cli COMMAND ...

evaluate       daily predictions and observations to metrics by gauge, month and season, distributions and a summary
compare        two models' daily series to monthly sums, metrics and differences
daily          sub-daily long values to daily ones, written by year
split          daily targets to blocks with balanced periods; with --file to a split file, too
sources        cells, divides and flow paths to a map of which cells feed which nodes
network        nodes and successors to hydrology features
scaler         long values to a scaler of each variable
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluvial.operators import assembly, compare, network, prepare, skill, splits
from fluvial.sources import readers, sinks


def evaluate(spark: SparkSession, a) -> None:
    df = spark.read.parquet(a.input)
    if a.gauges:
        df = df.where(F.col("gauge_id").isin(a.gauges))
    if a.overlapping:
        df = skill.merge_windows(df, ["gauge_id", "date"])
    daily = df.select("gauge_id", "date", "prediction", "observation")
    m, again = skill.series_metrics(daily, ["gauge_id"]), skill.analysis_metrics(daily, ["gauge_id"])
    both = m.join(again.select("gauge_id", "kgess", "pbias", F.col("kge").alias("kge_recomputed"), F.col("nse").alias("nse_recomputed")), "gauge_id", "full")
    if a.metadata:
        both = both.join(spark.read.parquet(a.metadata), "gauge_id", "left")
    sinks.write_report(both, f"{a.output}/metrics_by_gauge", ("gauge_id",))
    sinks.write_report(compare.by_month(daily), f"{a.output}/monthly_metrics", ("gauge_id", "month"))
    sinks.write_report(compare.by_season(daily), f"{a.output}/seasonal_metrics", ("gauge_id", "season"))
    sinks.write_report(compare.distribution(daily, ["gauge_id"], ["prediction", "observation"]), f"{a.output}/distribution", ("gauge_id",))
    sinks.write_summary(skill.summary(skill.metrics_from_moments(skill.moments(daily, ["gauge_id"]), ["gauge_id"])), f"{a.output}/summary")


def compare_models(spark: SparkSession, a) -> None:
    both = compare.align_models(spark.read.parquet(a.first).select("gauge_id", "date", F.col("prediction").alias("gnn"), F.col("observation").alias("observed")), spark.read.parquet(a.second).select("gauge_id", "date", F.col("prediction").alias("other")))
    monthly = compare.monthly(both, ["gauge_id"], ["gnn", "observed", "other"], a.op)
    long = compare.long_form(monthly, ["gauge_id", "month", "season", "observed"], ["gnn", "other"], "model", "prediction").withColumnRenamed("observed", "observation")
    sinks.write_report(both, f"{a.output}/daily", ("gauge_id", "date"))
    sinks.write_report(monthly, f"{a.output}/monthly", ("gauge_id", "month"))
    metrics = skill.analysis_metrics(long, ["gauge_id", "model"])
    sinks.write_report(metrics, f"{a.output}/metrics", ("gauge_id", "model"))
    sinks.write_report(skill.analysis_metrics(long, ["gauge_id", "model", "season"]), f"{a.output}/seasonal_metrics", ("gauge_id", "model", "season"))
    sinks.write_report(compare.difference(metrics, ["gauge_id"], "model", "kgess", "gnn", "other"), f"{a.output}/kgess_difference", ("gauge_id",))


def daily(spark: SparkSession, a) -> None:
    df = spark.read.parquet(a.input)
    names = [r[0] for r in df.select("variable").distinct().collect()]
    out = prepare.aggregate_daily(df, prepare.daily_plan(names), [a.cell], min_steps=a.min_steps)
    sinks.write_yearly(out, a.output, "date", a.mode, (a.cell,))


def split(spark: SparkSession, a) -> None:
    blocks = splits.block_features(splits.blocks_of(spark.read.parquet(a.input), a.days, a.context), min_valid=a.min_valid)
    done = splits.balanced(blocks, seed=a.seed)
    sinks.write_report(done, f"{a.output}/blocks", ("block_id",))
    sinks.write_report(splits.period_summary(done), f"{a.output}/periods", ("period",))
    if a.file:
        sinks.write_split(done, a.file, {"seed": a.seed, "days": a.days})


def network_features(spark: SparkSession, a) -> None:
    network.hydrology_features(spark.read.parquet(a.nodes), spark.read.parquet(a.edges)).write.mode("overwrite").parquet(a.output)


def hydrofabric(spark: SparkSession, a) -> None:
    read = lambda path: spark.read.parquet(path) if path else None
    nodes, edges = assembly.hydrofabric(read(a.paths), read(a.junctions), read(a.path_attributes), read(a.divide_attributes))
    sinks.write_graph({"nodes": nodes, "edges": edges}, a.output, {"builder": "hydrofabric"})


def sources(spark: SparkSession, a) -> None:
    cells, divides, paths, nodes = (spark.read.parquet(p) for p in (a.cells, a.divides, a.paths, a.nodes))
    made = assembly.source_map(cells, divides, paths, nodes, a.width, a.height, a.method, a.min_fraction, a.features)
    made.write.mode("overwrite").parquet(a.output)


def runoff(spark: SparkSession, a) -> None:
    sinks.write_yearly(readers.read_runoff_days(spark, a.input, a.pattern), a.output, "date", a.mode)


def scaler(spark: SparkSession, a) -> None:
    sinks.write_yaml(sinks.scaler_mapping(prepare.scaler_from_sums(prepare.scaler_sums(spark.read.parquet(a.input), ["variable"]), ["variable"])), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fluvial", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(required=True)

    def add(name, run, *options, **more):
        c = commands.add_parser(name)
        for o in options:
            c.add_argument(o, required=True)
        for o, settings in more.items():
            c.add_argument("--" + o.replace("_", "-"), **settings)
        c.set_defaults(run=run)

    add("evaluate", evaluate, "--input", "--output", gauges={"nargs": "*"}, metadata={}, overlapping={"action": "store_true"})
    add("compare", compare_models, "--first", "--second", "--output", op={"choices": ["sum", "mean"], "default": "sum"})
    add("daily", daily, "--input", "--output", cell={"default": "flat_index"}, min_steps={"type": int}, mode={"choices": list(sinks.MODES), "default": "fail"})
    add("split", split, "--input", "--output", days={"type": int, "default": 180}, context={"type": int, "default": 0}, min_valid={"type": float, "default": 0.0}, seed={"type": int, "default": 42}, file={})
    add("sources", sources, "--cells", "--divides", "--paths", "--nodes", "--output", width={"type": float, "required": True}, height={"type": float, "required": True}, method={"choices": ["center", "fractional_area"], "default": "center"}, min_fraction={"type": float, "default": 1e-8}, features={"nargs": "*", "choices": assembly.SOURCE_FEATURES, "default": []})
    add("network", network_features, "--nodes", "--edges", "--output")
    add("hydrofabric", hydrofabric, "--paths", "--junctions", "--output", path_attributes={}, divide_attributes={})
    add("runoff", runoff, "--input", "--output", pattern={"default": "*.parquet"}, mode={"choices": list(sinks.MODES), "default": "fail"})
    add("scaler", scaler, "--input", "--output")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
