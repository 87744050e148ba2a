"""Work dealt out by counted rows: what one task holds doesn't grow with the tables."""

import datetime as dt
from collections import defaultdict
from contextlib import contextmanager

import duckdb
import pytest
from pyspark.sql import functions as F

from fluvial import common
from fluvial.operators import transfer
from fluvial.plans import registry, views
from tests.conftest import SF

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(3)]


def rows_a_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.fixture
def blocks(spark):
    """values, mapping and the sums: 40 blocks of 5 sources that share 4 targets; a null value, weights and sources that are null or have no partner."""
    values = [(s, d, None if s == 7 else float(s + k)) for s in range(200) for k, d in enumerate(DAYS)] + [(None, DAYS[0], 5.0), (900, DAYS[0], 5.0)]
    mapping = [(s, s // 5 * 4 + t, None if (s, t) == (11, 2) else 0.5 + t) for s in range(200) for t in range(4)] + [(None, 3, 9.0), (901, 3, 9.0)]
    want = defaultdict(float)
    of = defaultdict(list)
    for s, t, w in mapping:
        of[s].append((t, w))
    for s, d, v in values:
        for t, w in of[s] if s is not None else []:
            want[t, d] += (v or 0.0) * (w or 0.0)
    return spark.createDataFrame(values, "source bigint, date date, value double"), spark.createDataFrame(mapping, "source int, target int, weight double"), dict(want)


@pytest.mark.parametrize("source_rows", [100_000, 6])
def test_transfer_by_ranges_of_sources(blocks, monkeypatch, source_rows):
    """Large mappings, with and without sources that are too large for a row, give the same sums as small ones."""
    values, mapping, want = blocks
    monkeypatch.setattr(transfer, "small_enough", lambda *a, **k: False)
    monkeypatch.setattr(transfer, "SOURCE_ROWS", source_rows)
    got = {(r.target, r.date): r.value for r in transfer.transfer(values, mapping).collect()}
    assert got == pytest.approx(want)


def test_a_task_of_the_transfer_has_few_targets(blocks, monkeypatch):
    """160 targets in all, of which a hash of the sources gave nearly all to each task."""
    values, mapping, _ = blocks
    monkeypatch.setattr(transfer, "small_enough", lambda *a, **k: False)
    monkeypatch.setattr(common, "TASK_ROWS", 140)
    seen = []
    real = transfer._products
    monkeypatch.setattr(transfer, "_products", lambda *a: seen.append(real(*a)) or seen[-1])
    transfer.transfer(values, mapping)
    each = seen[0].groupBy(F.spark_partition_id()).agg(F.countDistinct("target").alias("n")).collect()
    assert len(each) >= 8 and max(r.n for r in each) <= 40


@pytest.mark.parametrize("source_rows", [100_000, 6])
def test_sums_in_rounds_equal_a_join(spark, monkeypatch, source_rows):
    """Several rounds and rows of several times, with targets, times and weights that are null, and a value twice; a null sum keeps its row."""
    values = [(s, None if k == 4 else k, float(s + k)) for s in range(50) for k in range(s % 6)] + [(3, 1, 7.0), (None, 1, 5.0), (60, 8, 1.0)]
    mapping = [(s, None if t == 2 else t, None if t == 3 else 0.5 + s) for s in range(50) for t in range(s % 5)] + [(60, 77, None), (None, 1, 1.0), (61, 1, 1.0)]
    values, mapping = spark.createDataFrame(values, "source int, date int, value double"), spark.createDataFrame(mapping, "source int, target int, weight double")
    want = values.join(mapping, "source").groupBy("target", "date").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    kept = []
    real = transfer.scratch

    @contextmanager
    def counted(spark):
        with real(spark) as keep:
            yield lambda df, name: kept.append(name) or keep(df, name)

    monkeypatch.setattr(transfer, "small_enough", lambda *a, **k: False)
    monkeypatch.setattr(transfer, "scratch", counted)
    monkeypatch.setattr(transfer, "SOURCE_ROWS", source_rows)
    monkeypatch.setattr(transfer, "ROUND_ROWS", 6)
    monkeypatch.setattr(transfer, "WIDTH", 4)
    got = {(r.target, r.date): r.value for r in transfer.transfer(values, mapping).collect()}
    want = {(r.target, r.date): r.value for r in want.collect()}
    assert kept.count("transfer-sums") > 1 and got.keys() == want.keys() and None in want.values()
    assert all(got[k] == want[k] or got[k] == pytest.approx(want[k]) for k in want)


def sent(spark):
    """Rows that each stage has shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().endswith(".data")}


def test_disk_of_the_transfer_does_not_grow_with_its_tasks(spark, monkeypatch):
    """All sources share all targets: 90 ranges of them sent 90 partial sums of each of the 2000 targets and times. What was shuffled is gone when the sums are there."""
    values = spark.range(16_000).select(F.expr("id div 40").alias("source"), F.expr("int(id % 40)").alias("date"), F.lit(1.0).alias("value"))
    mapping = spark.range(20_000).select(F.expr("id div 50").alias("source"), F.expr("id % 50").alias("target"), F.lit(2.0).alias("weight"))
    monkeypatch.setattr(transfer, "small_enough", lambda *a, **k: False)
    monkeypatch.setattr(common, "TASK_ROWS", 400)
    before, files = sent(spark), shuffle_files(spark)
    out = transfer.transfer(values, mapping)
    assert not shuffle_files(spark) - files
    assert [r.value for r in out.collect()] == [800.0] * 2000
    assert sum(n for k, n in sent(spark).items() if k not in before) < 120_000


@pytest.mark.parametrize("name", ["q40_runoff_transfer", "q84b_node_inputs", "q84c_runoff_to_gauges", "q84d_attention_to_gauges"])
def test_queries_with_a_large_mapping(spark, monkeypatch, name):
    """In more than a hundred tasks and several rounds, results are those of SQL, and rows that are shuffled don't grow with the tasks."""
    monkeypatch.setattr(transfer, "small_enough", lambda *a, **k: False)
    monkeypatch.setattr(transfer, "ROUND_ROWS", 12, raising=False)
    monkeypatch.setattr(common, "TASK_ROWS", 100)
    con = duckdb.connect()
    for table in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    before = sent(spark)
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(map(str, r[:2])), *r[2:]) for r in df.collect())
    want = sorted((tuple(map(str, r[:2])), *r[2:]) for r in con.execute(registry.ORACLE[name]).fetchall())
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1:] == pytest.approx(b[1:], rel=1e-9, abs=1e-9) for a, b in zip(got, want))
    assert sum(n for k, n in sent(spark).items() if k not in before) < 40_000


@pytest.mark.parametrize("view", ["runoff", "sources"])
def test_tasks_of_mapping_and_runoff_stay_small(spark, monkeypatch, view):
    monkeypatch.setattr(common, "TASK_ROWS", 300)
    got = rows_a_task(getattr(views, view)(spark, SF))
    assert len(got) > 4 and max(got) <= 600


@pytest.mark.parametrize("view", ["series", "compared"])
def test_tasks_of_daily_series_stay_small(spark, monkeypatch, view):
    monkeypatch.setattr(common, "TASK_ROWS", 300)
    got = rows_a_task(getattr(views, view)(spark, SF))
    assert len(got) > 4 and max(got) <= 600


def test_windows_keep_the_tasks_of_the_series(spark, monkeypatch):
    from fluvial.plans import window_queries

    monkeypatch.setattr(common, "TASK_ROWS", 300)
    got = rows_a_task(window_queries.q23_window_overlap_dedupe(spark, SF))
    assert len(got) > 4 and max(got) <= 600


def test_messages_of_attention_go_to_more_tasks(spark, monkeypatch):
    """The states of 40 nodes at 10 steps, with an edge each, are 800 messages: tasks of 100 are 8, where the session has 4."""
    import numpy as np

    from fluvial.operators import assembly, routing

    monkeypatch.setattr(common, "TASK_ROWS", 100)
    seen = {}
    real = routing.gat_layer
    monkeypatch.setattr(routing, "gat_layer", lambda *a, **k: seen.setdefault("out", real(*a, **k)))
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), ((F.col("node") + 1) % 40).alias("dst"))
    runoff = nodes.select(F.col("node").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("date"), F.lit(1.0).alias("value"))
    mapping = nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), (1.0 + F.col("node")).alias("weight"))
    layers = [{"kind": "gat", "weights": np.ones((1, 2)), "attend_src": [0.1, 0.2], "attend_dst": [0.3, 0.4]}]
    args = (runoff, mapping, nodes, edges, nodes.select(F.col("node").cast("string").alias("gauge_id"), "node"), layers, (np.array([[1.0], [2.0]]), [0.5]), (0,))
    got = {(r.gauge_id, r.date): r.prediction for r in assembly.routed(*args).collect()}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if tables were large
    try:
        each = [r.n for r in seen.pop("out").groupBy(F.spark_partition_id()).agg(F.count("c0").alias("n"), F.sum("c0")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(each) > 4 and sum(each) == 400
    monkeypatch.setattr(common, "TASK_ROWS", 1_000_000)
    assert got == pytest.approx({(r.gauge_id, r.date): r.prediction for r in assembly.routed(*args).collect()})
