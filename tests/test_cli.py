import datetime as dt

import pytest

from fluvial import cli


@pytest.fixture()
def table(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(120)]
    rows = [(g, d, float(k % 17) + s, float(k % 17)) for s, g in ((1.0, "a"), (2.0, "b")) for k, d in enumerate(days)]
    path = str(tmp_path / "series")
    spark.createDataFrame(rows, "gauge_id string, date date, prediction double, observation double").write.parquet(path)
    return path


def test_evaluate(spark, table, tmp_path):
    cli.main(["evaluate", "--input", table, "--output", str(tmp_path / "out"), "--overlapping"])
    m = spark.read.option("header", "true").csv(str(tmp_path / "out" / "metrics_by_gauge"))
    assert m.count() == 2 and all(abs(float(r.kge) - float(r.kge_recomputed)) < 1e-9 for r in m.collect())
    assert spark.read.json(str(tmp_path / "out" / "summary")).first().series == 2
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "monthly_metrics")).count() == 8


def test_compare(spark, table, tmp_path):
    cli.main(["compare", "--first", table, "--second", table, "--output", str(tmp_path / "out")])
    d = spark.read.option("header", "true").csv(str(tmp_path / "out" / "kgess_difference"))
    assert d.count() == 2 and all(float(r.difference) == 0 for r in d.collect())


def test_split_and_scaler(spark, table, tmp_path):
    long = spark.read.parquet(table).selectExpr("gauge_id", "date", "observation AS value", "'q' AS variable")
    long.write.parquet(str(tmp_path / "long"))
    cli.main(["split", "--input", str(tmp_path / "long"), "--output", str(tmp_path / "out"), "--days", "10", "--file", str(tmp_path / "split.yml")])
    b = spark.read.option("header", "true").csv(str(tmp_path / "out" / "blocks"))
    assert b.count() == 12 and {r.period for r in b.collect()} == {"train", "validation", "test"}
    cli.main(["scaler", "--input", str(tmp_path / "long"), "--output", str(tmp_path / "s.yml")])
    from fluvial.sources.sinks import read_split, read_yaml

    assert sorted((r.block_id, r.period) for r in read_split(spark, str(tmp_path / "split.yml")).collect()) == sorted((int(r.block_id), r.period) for r in b.collect())
    assert set(read_yaml(str(tmp_path / "s.yml"))["q"]) == {"mean", "std"}


def test_sources(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    spark.sql("SELECT id AS flat_index, id + 0.5D AS x, 0.5D AS y FROM range(4)").write.parquet(at("cells"))
    spark.sql("SELECT d AS divide_id, array(named_struct('x', a, 'y', 0D), named_struct('x', b, 'y', 0D), named_struct('x', b, 'y', 1D), named_struct('x', a, 'y', 1D)) AS ring FROM VALUES ('p', 0D, 1.5D), ('q', 1.5D, 3D) AS t(d, a, b)").write.parquet(at("divides"))
    spark.sql("SELECT * FROM VALUES ('u', 'p'), ('v', 'q') AS t(id, divide_id)").write.parquet(at("paths"))
    spark.sql("SELECT * FROM VALUES ('u', 0L), ('v', 1L) AS t(id, node)").write.parquet(at("nodes"))
    cli.main(["sources", *[x for n in ("cells", "divides", "paths", "nodes") for x in (f"--{n}", at(n))], "--output", at("out"), "--width", "1", "--height", "1", "--method", "fractional_area", "--features", "x"])
    assert sorted(tuple(r) for r in spark.read.parquet(at("out")).collect()) == [(0, 0, 1.0, 1.0, 0.5), (1, 0, 0.5, 0.5, 1.5), (1, 1, 0.5, 0.5, 1.5), (2, 1, 1.0, 1.0, 2.5)]


def test_hydrofabric(spark, tmp_path):
    spark.createDataFrame([("wb-1", "nex-1", 2000.0), ("wb-2", "nex-1", 500.0), ("wb-3", "nex-2", 100.0)], "id string, toid string, Length_m double").write.parquet(str(tmp_path / "paths"))
    spark.createDataFrame([("nex-1", "wb-3")], "id string, toid string").write.parquet(str(tmp_path / "junctions"))
    cli.main(["hydrofabric", "--paths", str(tmp_path / "paths"), "--junctions", str(tmp_path / "junctions"), "--output", str(tmp_path / "graph")])
    edges = spark.read.parquet(str(tmp_path / "graph" / "edges")).collect()
    assert sorted((r.src, r.dst, r.weight) for r in edges) == [(0, 2, 1 / 2000), (1, 2, 1 / 500)]
