"""Operators on hand-made cases and properties; the queries against their SQL are in test_queries.py."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.functions import columns as C
from fluvial.operators import assembly, compare, network, prepare, routing, skill, spatial, splits, transfer, windows

D = dt.date


def one(df, *cols):
    return df.select(*cols).first()


def series(spark, rows):
    return spark.createDataFrame(rows, "g string, date date, prediction double, observation double")


@pytest.fixture(scope="module")
def cases(spark):
    day = lambda k: D(2020, 1, 1) + dt.timedelta(k)
    rows = [("same", day(k), float(k), float(k)) for k in range(10)]
    rows += [("flat", day(k), float(k), 5.0) for k in range(10)] + [("flat_sim", day(k), 5.0, float(k)) for k in range(10)]
    rows += [("single", day(0), 1.0, 2.0), ("none", day(0), None, 2.0), ("none", day(1), float("nan"), 1.0), ("none", day(2), float("inf"), 1.0)]
    rows += [("zero", day(k), float(k), float(k - 1)) for k in range(3)]
    return series(spark, rows)


def test_series_metrics_edges(cases):
    m = {r.g: r for r in skill.series_metrics(cases, ["g"]).collect()}
    assert m["same"].kge == pytest.approx(1) and m["same"].nse == pytest.approx(1) and m["same"].mse == 0
    assert m["flat"].kge is None and m["flat"].nse is None and m["flat"].correlation is None and m["flat"].bias_ratio is not None
    assert m["flat_sim"].correlation is None and m["flat_sim"].variability == 0
    assert m["single"].n == 1 and m["single"].kge is None and m["none"].n == 0 and m["none"].mse is None
    assert m["zero"].bias_ratio is None and m["zero"].nse is not None


def test_four_definitions_agree_on_plain_data(cases):
    s = cases.where("g = 'same'").withColumn("prediction", F.col("prediction") * 1.2 + 3)
    e = one(skill.series_metrics(s, ["g"]), "kge").kge
    assert one(skill.analysis_metrics(s, ["g"]), "kge").kge == pytest.approx(e)
    assert one(skill.metrics_from_moments(skill.moments(s, ["g"]), ["g"]), "kge").kge == pytest.approx(e, abs=1e-4)
    assert one(skill.kge_components(s, ["g"]), "kge").kge == pytest.approx(e, abs=1e-4)


def test_moments_merge(cases):
    whole = skill.moments(cases, ["g"])
    parts = skill.merge_moments(skill.moments(cases.withColumn("part", F.dayofmonth("date") % 3), ["g", "part"]), ["g"])
    assert whole.exceptAll(parts).count() == 0


def test_losses(cases):
    s = cases.where("g IN ('same', 'flat_sim')")
    for name in ("mse", "log_mse", "peak_mse", "kge", "kge_components", "mixed"):
        assert one(skill.loss(name)(s, ["g"]), "loss").loss >= 0
    same = cases.where("g = 'same'")
    assert one(skill.jkge_loss(same, ["g"], "date", window=3), "loss").loss == pytest.approx(0, abs=1e-6)
    assert one(skill.loss("mse")(same, ["g"]), "loss").loss == 0
    with pytest.raises(ValueError):
        skill.loss("none")
    assert one(skill.mse_loss(s, ["g"], mask=F.col("g") == "same"), "loss").loss == 0


def test_moving_average_of_constant(spark):
    d = spark.createDataFrame([("a", k, None if k == 3 else 2.0) for k in range(9)], "g string, t int, v double")
    for w in (1, 2, 3, 4):
        got = [r.m for r in d.select("t", skill.moving_average(F.col("v"), w, ["g"], "t").alias("m")).orderBy("t").collect()]
        assert all(x == 2.0 for k, x in enumerate(got) if k != 3 or w > 1)


def test_daily_plan(spark):
    t = lambda d, h: dt.datetime(2020, 1, d, h)
    rows = [(1, t(1, 0), "RAINRATE", 1.0), (1, t(1, 5), "RAINRATE", 2.0), (1, t(1, 0), "T2D", 4.0), (1, t(1, 5), "T2D", 6.0), (1, t(3, 0), "RAINRATE", None), (1, t(3, 0), "T2D", None)]
    d = spark.createDataFrame(rows, "cell int, time timestamp_ntz, variable string, value double")
    got = {(r.date.day, r.name): r.value for r in prepare.aggregate_daily(d, prepare.daily_plan(["RAINRATE", "T2D"]), ["cell"]).collect()}
    assert got == {(1, "RAINRATE_daily"): 10800.0, (1, "T2D"): 5.0, (3, "RAINRATE_daily"): 0.0, (3, "T2D"): None}
    with pytest.raises(ValueError):
        prepare.daily_plan(["x"], {"x": prepare.DailyRule("x", "mode")})
    short = prepare.aggregate_daily(d, prepare.daily_plan(["T2D"]), ["cell"], min_steps=2)
    assert [r.date.day for r in short.collect()] == [1]
    with pytest.raises(Exception, match="too few steps"):
        prepare.aggregate_daily(d, prepare.daily_plan(["T2D"]), ["cell"], min_steps=2, strict=True).collect()


def test_calendar_tools(spark):
    d = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 4), 2.0), ("b", D(2020, 1, 2), 3.0)], "g string, date date, value double")
    assert prepare.densify(d, ["g"]).count() == 5
    full = prepare.reindex(d, "g")
    assert full.count() == 6 and full.where("value IS NULL").count() == 3
    with pytest.raises(Exception, match="no day"):
        prepare.require_all(d, d.where("g = 'a'").select("date"), ["date"], "day").collect()
    assert prepare.in_period(d, D(2020, 1, 2), D(2020, 1, 4)).count() == 2


def test_scalers_round_trip(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(k, "v" if k % 2 else "const", float(x) if k % 2 else 3.0) for k, x in enumerate(rng.gamma(2, 3, 60))], "id int, variable string, value double")
    for s in (prepare.standard_scaler(d, ["variable"]), prepare.percentile_scaler(d, ["variable"]), prepare.scaler_from_sums(prepare.scaler_sums(d, ["variable"]), ["variable"])):
        back = prepare.unscale(prepare.scale(d, s, ["variable"]), s, ["variable"])
        want = {r.id: r.value for r in d.collect()}
        assert all(r.value == pytest.approx(want[r.id], abs=1e-8) for r in back.collect())
    assert {r.variable: r["std"] for r in prepare.standard_scaler(d, ["variable"]).collect()}["const"] == 1.0
    assert {r.variable: r["std"] for r in prepare.standard_scaler(d, ["variable"], replace=None).collect()}["const"] == 1e-6


def test_windows(spark):
    span = spark.createDataFrame([(D(2020, 2, 29), D(2024, 3, 5))], "first date, last date")
    years = [(r.start, r.end) for r in windows.year_windows(span, 1, 1).orderBy("window_id").collect()]
    assert years[:2] == [(D(2020, 2, 29), D(2021, 2, 28)), (D(2021, 2, 28), D(2022, 2, 28))] and years[-1] == (D(2023, 2, 28), D(2024, 2, 28))
    exact = spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 10))], "first date, last date")
    got = [(r.context_start.day, r.start.day, r.end.day) for r in windows.day_windows(exact, 4, 3, 2).orderBy("start").collect()]
    assert got == [(1, 3, 7), (4, 6, 10)]
    assert windows.day_windows(exact, 11, 1).count() == 0 and windows.day_windows(exact, 10, 1).count() == 1
    steps = spark.createDataFrame([(10,), (3,)], "n int")
    assert sorted((r.start, r.end) for r in windows.step_windows(steps, "n", 4, 3).collect()) == [(0, 4), (3, 7), (6, 10)]


def test_lags(spark):
    d = spark.createDataFrame([("a", k, float(k + 1)) for k in range(3)], "g string, t int, v double")
    rows = windows.lags(d, "v", (0, 1, 5), ["g"], "t").orderBy("t").collect()
    assert [(r.v_lag0, r.v_lag1, r.v_lag5) for r in rows] == [(1, 0, 0), (2, 1, 0), (3, 2, 0)]
    rows = windows.lags(d, "v", (1, 5), ["g"], "t", "repeat_first").orderBy("t").collect()
    assert [(r.v_lag1, r.v_lag5) for r in rows] == [(1, 1), (1, 1), (2, 1)]
    with pytest.raises(ValueError):
        windows.lags(d, "v", (-1,), ["g"], "t")
    with pytest.raises(Exception, match="multiple of 2"):
        windows.reduce_steps(d, "v", 2, ["g"], "t").collect()
    assert [r.v for r in windows.drop_first(d, 2, ["g"], "t").collect()] == [3.0]


def test_segments(spark):
    b = spark.createDataFrame([("p", D(2020, 1, 1), D(2020, 1, 5)), ("p", D(2020, 1, 5), D(2020, 1, 8)), ("p", D(2020, 1, 2), D(2020, 1, 3)), ("p", D(2020, 1, 20), D(2020, 1, 22)), ("q", D(2020, 1, 6), D(2020, 1, 7))], "g string, start date, end date")
    got = sorted((r.g, r.start.day, r.end.day) for r in windows.merge_segments(b, ["g"]).collect())
    assert got == [("p", 1, 8), ("p", 20, 22), ("q", 6, 7)]
    assert windows.merge_segments(b, ["g"], gap=12).count() == 2


def test_manifest(spark):
    m = spark.createDataFrame([("f", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 3), 4, None), ("g", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1), 1, 0.0)], "path string, start_time timestamp_ntz, end_time timestamp_ntz, n_steps bigint, step_seconds double")
    assert sorted((r.path, r.time.hour) for r in windows.manifest_times(m).collect()) == [("f", 0), ("f", 1), ("f", 2), ("f", 3), ("g", 0)]


def test_columns(spark):
    d = spark.createDataFrame([("00123", "a.b c", "run.20200105.nc", 1.5, None), ("000", "__x__", "20201340_2020010203.nc", -2.0, 1.0), (" A01 ", "", "none", float("inf"), float("nan"))], "id string, name string, file string, x double, y double")
    r = d.select(C.canonical_id("id"), C.safe_name("name"), C.file_timestamp("file"), C.number_label("x"), C.or_zero("x"), C.finite("y"), C.clip("y", 2.0), C.log_flow("x")).collect()
    assert [x[0] for x in r] == ["123", "0", "A01"] and [x[1] for x in r] == ["a_b_c", "x", ""]
    assert [x[2] for x in r] == [dt.datetime(2020, 1, 5), dt.datetime(2020, 1, 2, 3), None]
    assert [x[3] for x in r][:2] == ["1p5", "-2"] and [x[4] for x in r] == [1.5, -2.0, 0.0] and [x[5] for x in r] == [None, 1.0, None]
    assert [x[6] for x in r][:2] == [None, 2.0] and r[1][7] == 0.0
    s = spark.createDataFrame([(-9999.0,), (-9999.05,), (3.0,)], "v double")
    assert [x.v for x in s.select(C.sentinel_to_null("v", -9999.0).alias("v")).collect()] == [None, None, 3.0]
    g = spark.createDataFrame([("soil_1",), ("veg",)], "n string")
    assert [x.n for x in g.where(C.glob("n", "soil*", "x?")).collect()] == ["soil_1"]
    assert one(spark.range(1).select(C.km_between(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("k")), "k").k == pytest.approx(111.32)


def grid(spark, rows):
    return spark.createDataFrame([(y * 10 + x, y, x, float(e)) for y, row in enumerate(rows) for x, e in enumerate(row) if e is not None], "flat_index bigint, y int, x int, elevation double")


def test_grid_edges(spark):
    g = grid(spark, [[1, 2], [3, None]])
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(network.grid_edges(g, 4)) == [(0, 1), (0, 10), (1, 0), (10, 0)]
    assert pairs(network.grid_edges(g, 8, directed=True)) == pairs(network.grid_edges(g, 8)) == [(0, 1), (0, 10), (1, 0), (1, 10), (10, 0), (10, 1)]
    assert len(pairs(network.grid_edges(g, 8, reverse=False))) == 3


def test_downhill_ties(spark):
    g = grid(spark, [[1, 5, 1], [2, 3, 2], [1, 1, 1]])
    down = {r.src: r.dst for r in network.downhill_edges(g).collect()}
    assert down[11] == 0 and down[1] == 0 or down[1] in (0, 2)
    assert 0 not in down and 20 not in down


def test_d8_encodings(spark):
    g = grid(spark, [[0, 0], [0, 0]]).withColumn("code", F.element_at(F.array(*[F.lit(c) for c in (1, 4, 64, 0)]), (F.col("y") * 2 + F.col("x") + 1).cast("int")))
    assert sorted(map(tuple, network.d8_edges(g).collect())) == [(0, 1), (1, 11), (10, 0)]
    h = g.withColumn("code", F.element_at(F.array(*[F.lit(c) for c in (1, 3, 7, 9)]), (F.col("y") * 2 + F.col("x") + 1).cast("int")))
    assert sorted(map(tuple, network.d8_edges(h, encoding="1to8").collect())) == [(0, 1), (1, 11), (10, 0)]


def test_active_mask(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (None,), (float("nan"),)], "v double")
    got = lambda **k: [r.a for r in d.select(network.active("v", **k).alias("a")).collect()]
    assert got() == [False, True, True, False, False] and got(invert=True) == [True, False, False, True, True]
    assert got(include=[0]) == [True, False, False, False, False] and got(exclude=[5]) == [True, True, False, False, False]
    assert got(low=0.0, high=1.0) == [True, True, False, False, False]


def test_accumulation_on_random_forests(spark):
    rng = random.Random(3)
    n = 300
    parent = {i: rng.randrange(max(0, i - 4), i) if i and rng.random() > 0.05 else None for i in range(n)}
    nodes = spark.createDataFrame([(i, float(i)) for i in range(n)], "node bigint, v double")
    nxt = spark.createDataFrame([(i, p) for i, p in parent.items() if p is not None], "node bigint, next bigint")
    up, down = defaultdict(float), {}
    for i in range(n):
        at, total = i, 0.0
        while at is not None:
            up[at] += i
            total += at
            at = parent[at]
        down[i] = total
    for r in network.accumulate(nodes, nxt, ["v"], ["v"]).collect():
        assert (r.up_v, r.down_v) == (up[r.node], down[r.node])


def test_cycles_are_errors(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, 1.0)], "node bigint, v double")
    nxt = spark.createDataFrame([(0, 1), (1, 0)], "node bigint, next bigint")
    with pytest.raises(ValueError, match="cycle"):
        network.accumulate(nodes, nxt, ["v"], max_rounds=3)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(k,) for k in sorted({*parent, 999})], "node bigint")
    got = {r.node: r.component for r in network.component_ids(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    roots = sorted({find(x) for x in parent} | {999})
    assert got == {k: roots.index(find(k) if k != 999 else 999) for k in got}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    cells, pts = rng.uniform(0, 50, (60, 2)), np.concatenate([rng.uniform(0, 50, (20, 2)), [[500.0, -300.0]]])
    c = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(cells)], "flat_index bigint, x double, y double")
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "gauge bigint, x double, y double")
    got = {r.gauge: r.flat_index for r in network.nearest(p, c, "gauge").collect()}
    assert got == {k: int(((cells - q) ** 2).sum(1).argmin()) for k, q in enumerate(pts)}
    tie = spark.createDataFrame([(5, 1.0, 0.0), (3, -1.0, 0.0)], "flat_index bigint, x double, y double")
    assert network.nearest(spark.createDataFrame([(0, 0.0, 0.0)], "gauge bigint, x double, y double"), tie, "gauge").first().flat_index == 3
    axis = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "c double")
    q = spark.createDataFrame([(1.0,), (3.1,), (-9.0,)], "v double")
    assert [r.c for r in network.nearest_on_axis(q, axis, "v", "c").collect()] == [0.0, 4.0, 0.0]


def test_gauges(spark):
    g = spark.createDataFrame([("00123", 1), ("A1", 2)], "gauge_id string, node int")
    order = spark.createDataFrame([(0, "A1"), (1, "123")], "gauge_pos int, gauge_id string")
    assert [(r.gauge_pos, r.node) for r in network.match_gauges(g, order).orderBy("gauge_pos").collect()] == [(0, 2), (1, 1)]
    with pytest.raises(Exception, match="no gauge 9"):
        network.match_gauges(g, spark.createDataFrame([(0, "9")], "gauge_pos int, gauge_id string")).collect()
    a, b = spark.createDataFrame([("x", 1)], "gauge_id string, node int"), spark.createDataFrame([("x", 2), ("y", 3)], "gauge_id string, node int")
    both = [("location", a), ("containing", b)]
    assert {r.gauge_id: r.node for r in network.gauge_cascade(both).collect()} == {"x": 1, "y": 3}
    assert {r.gauge_id: r.node for r in network.gauge_cascade(both, policy="override").collect()} == {"x": 2, "y": 3}


def test_lines(spark):
    lines = spark.createDataFrame([("1", [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]), ("2", [(2.0, 1.0), (2.0, 3.0)])], "line string, points array<struct<x:double,y:double>>")
    d = network.densify_lines(lines, 1.0)
    assert [(r.x, r.y) for r in d.where("line = '1'").orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 0), (2, 1)]
    visits = d.withColumn("flat_index", (F.col("y") * 10 + F.col("x")).cast("bigint"))
    assert sorted((r.src, r.dst) for r in network.chain_edges(visits).collect()) == [(0, 1), (1, 2), (2, 12), (12, 22), (22, 32)]
    ids = spark.createDataFrame([("1", "1.0", "2"), ("2", "2", "0")], "line string, id string, down string")
    assert network.line_links(visits.where("line = '1' OR pos > 0"), ids).collect()[0].asDict() == {"src": 12, "dst": 22}


def test_hydraulics_and_checks(spark):
    e = spark.createDataFrame([(0, 1, 100.0, 0.04, 4.0, 2.0), (1, 2, 0.0, None, 0.0, 0.0)], "src bigint, dst bigint, length_m double, slope double, tw double, bw double")
    r = network.hydraulic_features(e, top="tw", bottom="bw").orderBy("src").collect()
    assert r[0].velocity_proxy == pytest.approx(0.2 / 0.05) and r[0].width_ratio_proxy == 2 and r[0].storage_proxy == 400 and r[0].manning_travel_time_proxy == pytest.approx(25)
    assert r[1].velocity_proxy == pytest.approx(1e-3 / 0.05) and r[1].width_ratio_proxy == 1
    nodes = spark.createDataFrame([(0,), (1,), (1,)], "node bigint")
    assert {x.what: x.n for x in network.check_graph(nodes, e).collect()} == {"dst without a node": 1, "node twice": 1}
    assert network.stale({"builder": "a"}, {"builder": "b"}) and not network.stale({"builder": "a", "x": 1}, {"builder": "a"})
    assert network.unique_edges(e.unionByName(e.withColumn("length_m", F.lit(None).cast("double"))), ["length_m"]).orderBy("src").first().length_m == 50


def test_transfer_keeps_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(s, t, float(rng.uniform(0.1, 2)), float(rng.uniform(1, 9)), float(rng.uniform(0, 50)), float(rng.uniform(0, 9)), 5.0 if t else 99.0) for s in range(12) for t in range(3) if rng.random() < 0.6]
    m = spark.createDataFrame(rows, "source int, target int, weight double, cell_area double, distance double, source_elevation double, target_elevation double")
    base = {r.target: r.s for r in m.groupBy("target").agg(F.sum("weight").alias("s")).collect()}
    for strategy in transfer.STRATEGIES:
        got = transfer.transfer_weights(m, strategy).groupBy("target").agg(F.sum("weight").alias("s")).collect()
        assert all(r.s == pytest.approx(base[r.target]) for r in got), strategy
    assert transfer.transfer_weights(m, "downhill").where("target = 0").select("weight").exceptAll(m.where("target = 0").select("weight")).count() == 0
    one_ = transfer.multipliers(m, {"distance": 0.0}).select("weight")
    assert one_.exceptAll(m.select("weight")).count() == 0
    v = spark.createDataFrame([(s, D(2020, 1, 1), float(s) if s else None) for s in range(12)], "source int, date date, value double")
    out = transfer.transfer(v, m, spark.createDataFrame([(0,), (1,), (2,), (9,)], "target int"))
    want = sum(r[0] * r[2] for r in rows)
    assert out.agg(F.sum("value")).first()[0] == pytest.approx(want) and out.where("target = 9").first().value == 0
    with pytest.raises(ValueError):
        transfer.transfer_weights(m, "magic")


def test_dense_paths_agree(spark):
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(k, *map(float, rng.normal(size=4))) for k in range(5)], "node int, a double, b double, c double, d double")
    w, b = rng.normal(size=(4, 3)), rng.normal(size=3)
    old = routing.EXPRESSION_WEIGHTS
    try:
        for act in ("none", "relu", "sigmoid", "silu", "softplus"):
            routing.EXPRESSION_WEIGHTS = 256
            x = routing.dense(d, list("abcd"), w, b, ["u", "v", "w"], act).orderBy("node").collect()
            routing.EXPRESSION_WEIGHTS = 0
            y = routing.dense(d, list("abcd"), w, b, ["u", "v", "w"], act).orderBy("node").collect()
            assert np.allclose(x, y)
    finally:
        routing.EXPRESSION_WEIGHTS = old
    n = routing.layer_norm(d, list("abcd")).select(*"abcd").collect()
    assert np.allclose(np.mean(n, 1), 0) and np.allclose(np.var(n, 1), 1, atol=1e-3)


def test_lstm_and_causal_layer(spark):
    rng = np.random.default_rng(8)
    h = 3
    w = {"w_ih": rng.normal(size=(4 * h, 1)), "w_hh": rng.normal(size=(4 * h, h)), "b_ih": rng.normal(size=4 * h), "b_hh": rng.normal(size=4 * h), "head": rng.normal(size=h), "head_bias": 0.2}
    xs = rng.normal(size=6)
    d = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(xs)], "node int, t int, x double")
    got = [r.value for r in routing.lstm(d, ["x"], w, order="t", activation="none").orderBy("t").collect()]
    state, cell = np.zeros(h), np.zeros(h)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for k, x in enumerate(xs):
        z = w["w_ih"][:, 0] * x + w["b_ih"] + w["w_hh"] @ state + w["b_hh"]
        cell = sig(z[h : 2 * h]) * cell + sig(z[:h]) * np.tanh(z[2 * h : 3 * h])
        state = sig(z[3 * h :]) * np.tanh(cell)
        assert got[k] == pytest.approx(w["head"] @ state + 0.2)
    kernel = rng.normal(size=(2, 1, 3))
    out = routing.causal_layer(d, ["x"], kernel, [0.1, 0.2], 2, order="t").orderBy("t").collect()
    z = 0.1 + kernel[0, 0, 0] * xs[1] + kernel[0, 0, 1] * xs[3] + kernel[0, 0, 2] * xs[5]
    assert out[5].t0 == pytest.approx(z * sig(z))


def test_gat_heads_with_edge_features(spark):
    """Against a plain version: two heads, loops among the edges, a node without edges, a missing feature, two times."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2, 5, 4))
    edges = [(0, 1, 0.5, 1.0), (2, 1, -1.0, None), (1, 3, 2.0, 0.3), (3, 3, 9.0, 9.0), (0, 3, 0.1, -0.7)]
    src, dst, edge = rng.normal(size=4), rng.normal(size=4), rng.normal(size=(2, 2))
    nodes = spark.createDataFrame([(n, t, *map(float, x[t, n])) for t in range(2) for n in range(5)], "node int, t int, a double, b double, c double, d double")
    e = spark.createDataFrame(edges, "src int, dst int, a double, w double")
    got = {(r.node, r.t): r[2:] for r in routing.gat_layer(nodes, e, ["a", "b", "c", "d"], src, dst, ("t",), heads=2, edge_features=["a", "w"], attend_edge=edge).collect()}
    assert len(got) == 10
    plain = [(a, b, np.array([f or 0.0, g or 0.0])) for a, b, f, g in edges if a != b]
    for t in range(2):
        for n in range(5):
            into = [(a, f) for a, b, f in plain if b == n]
            into.append((n, np.mean([f for _, f in into], axis=0) if into else np.zeros(2)))
            for h in range(2):
                part = slice(2 * h, 2 * h + 2)
                z = np.array([x[t, a, part] @ src[part] + x[t, n, part] @ dst[part] + f @ edge[h] for a, f in into])
                z = np.exp(np.where(z > 0, z, 0.2 * z))
                assert got[n, t][part] == pytest.approx(z @ np.array([x[t, a, part] for a, _ in into]) / z.sum())
    one = routing.gat_layer(nodes, e, ["a", "b"], src, dst, ("t",)).count()
    assert one == 10
    with pytest.raises(ValueError, match="multiple"):
        routing.gat_layer(nodes, e, ["a", "b", "c"], src, dst, ("t",), heads=2)


@pytest.mark.parametrize("residual", [True, False])
def test_temporal_head(spark, residual):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2, 7))
    layers = [(rng.normal(size=(3, 1, 3)), rng.normal(size=3)), (rng.normal(size=(2, 3, 1)), rng.normal(size=2)), (rng.normal(size=(1, 2, 5)), rng.normal(size=1))]
    rows = [(g, t, None if (g, t) == (1, 2) else float(x[g, t])) for g in range(2) for t in range(7)]
    d = spark.createDataFrame(rows, "g int, t int, v double")
    got = {(r.g, r.t): r.v for r in routing.temporal_head(d, "v", layers, ["g"], "t", residual).collect()}
    x[1, 2] = 0
    for g in range(2):
        z = x[g][None]
        for n, (k, b) in enumerate(layers):
            half = k.shape[2] // 2
            padded = np.pad(z, ((0, 0), (half, half)))
            z = np.array([[b[o] + np.sum(k[o] * padded[:, t : t + k.shape[2]]) for t in range(7)] for o in range(len(k))])
            z = z if n == 2 else np.maximum(z, 0)
        assert [got[g, t] for t in range(7)] == pytest.approx(list(z[0] + residual * x[g]))
    for bad in ([(np.ones((1, 1, 2)), [0.0])], [(np.ones((2, 1, 3)), [0.0, 0.0])]):
        with pytest.raises(ValueError, match="odd width"):
            routing.temporal_head(d, "v", bad, ["g"], "t")


def test_dem_grid(spark):
    rows = [(10.0, 5.0, 1.0), (12.0, 5.0, 2.0), (16.0, 7.0, math.nan), (10.0, 7.0, 3.0), (10.0, 7.0, 2.5), (None, 5.0, 9.0)]
    got = network.dem_grid(spark.createDataFrame(rows, "x double, y double, elevation double")).orderBy("flat_index").collect()
    assert [(r.flat_index, r.row, r.col, r.x, r.y, r.elevation, r.active) for r in got] == [(0, 0, 0, 10, 5, 1, True), (1, 0, 1, 12, 5, 2, True), (2, 0, 2, 16, 5, None, False), (3, 1, 0, 10, 7, 2.5, True), (4, 1, 1, 12, 7, None, False), (5, 1, 2, 16, 7, None, False)]
    assert {r.cell_area for r in got} == {6.0}
    empty = spark.createDataFrame([], "x double, y double, elevation double")
    assert network.dem_grid(empty).count() == 0
    assert network.dem_grid(spark.createDataFrame(rows[:1], "x double, y double, elevation double")).first().cell_area is None


def test_source_map(spark):
    """Divides with two paths, without one, and with one that is no node; inactive cells; missing elevations and lines."""
    box = lambda a, b: [(a, 0.0), (b, 0.0), (b, 2.0), (a, 2.0)]
    point = "array<struct<x:double,y:double>>"
    divides = spark.createDataFrame([("p", box(0.0, 2.5)), ("q", box(2.5, 4.0)), ("r", box(4.0, 5.0)), ("s", box(5.0, 6.0))], f"divide_id string, ring {point}")
    paths = spark.createDataFrame([("b", "p", [(9.0, 9.0)]), ("a", "p", [(0.5, 0.0), (0.5, 2.0)]), ("c", "q", None), ("d", "s", []), ("e", None, [])], f"id string, divide_id string, points {point}")
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, node bigint")
    cells = spark.createDataFrame([(k, k + 0.5, 1.5, None if k == 1 else float(k), k != 0) for k in range(6)], "flat_index int, x double, y double, elevation double, active boolean")
    got = assembly.source_map(cells, divides, paths, nodes, 1.0, 1.0, "fractional_area", features=["elevation", "distance_to_path", "overlap_area"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1.0, 1.0, 0.0, 1.0, 1.0), (2, 0, 0.5, 0.5, 2.0, 2.0, 0.5), (2, 2, 0.5, 0.5, 2.0, 0.0, 0.5), (3, 2, 1.0, 1.0, 3.0, 0.0, 1.0)]
    moved = cells.withColumn("x", F.col("x") - 0.1)
    whole = assembly.source_map(moved, divides, paths, nodes, 1.0, 1.0)
    assert sorted((r.source, r.target, r.weight, r.fraction) for r in whole.collect()) == [(1, 0, 1.0, 1.0), (2, 0, 1.0, 1.0), (3, 2, 1.0, 1.0)]
    assert whole.columns == ["source", "target", "weight", "fraction"]
    with pytest.raises(ValueError, match="no cell"):
        assembly.source_map(cells, divides, paths, nodes.where("node > 5"), 1.0, 1.0)
    with pytest.raises(ValueError, match="unknown"):
        assembly.source_map(cells, divides, paths, nodes, 1.0, 1.0, "magic")
    d = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 0D)) AS l").select(*[spatial.distance_to_line(F.col("l"), F.lit(x), F.lit(y)) for x, y in ((1.0, 3.0), (5.0, 4.0), (-3.0, -4.0), (2.0, 0.0))]).first()
    assert list(d) == [3.0, 5.0, 5.0, 0.0]


def test_splits(spark):
    assert splits.shares(10, {"train": 0.65, "validation": 0.2, "test": 0.15}) == {"train": 7, "validation": 2, "test": 1}
    assert sum(splits.shares(7, {"train": 0.6, "validation": 0.2, "test": 0.2}).values()) == 7
    rng = np.random.default_rng(9)
    rows = [(g, D(2020, 1, 1) + dt.timedelta(k), float(rng.gamma(2, 2))) for g in "ab" for k in range(123)]
    t = spark.createDataFrame(rows, "gauge_id string, date date, value double")
    b = splits.blocks_of(t, 10, context=3)
    assert b.agg(F.countDistinct("block_id"), F.min("date"), F.max("date")).first()[:] == (12, D(2020, 1, 4), D(2020, 5, 2))
    f = splits.block_features(b)
    got = splits.balanced(f, seed=1, starts=50)
    again = splits.balanced(f, seed=1, starts=50)
    assert got.groupBy("period").count().collect() and {r.block_id: r.period for r in got.collect()} == {r.block_id: r.period for r in again.collect()}
    arbitrary = splits.robust_scaled(f).withColumn("period", F.when(F.col("block_id") < 8, "train").when(F.col("block_id") < 10, "validation").otherwise("test"))
    best = splits.robust_scaled(f).join(got.select("block_id", "period"), "block_id")
    assert splits.score(best).first().score <= splits.score(arbitrary).first().score
    assert splits.period_summary(got).count() == 3


def test_split_search_equals_a_plain_one(spark):
    """The best of all shuffles of one sequence, then the first better swap of each pass, scored from all blocks each time."""
    rng = np.random.default_rng(0)
    for n, starts in ((23, 40), (9, 7)):
        x = rng.normal(size=(n, len(splits.FEATURES)))
        x[rng.random(x.shape) < 0.05] = np.nan
        d = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "block_id bigint, " + ", ".join(f"{f} double" for f in splits.FEATURES))
        z = np.array([[np.nan if v is None else v for v in r] for r in splits.robust_scaled(d).orderBy("block_id").select(*splits.FEATURES).collect()], float)
        mean, std = np.nanmean(z, 0), np.nanstd(z, 0)
        score = lambda y: sum(np.linalg.norm(np.nanmean(z[y == p], 0) - mean) + 0.25 * np.linalg.norm(np.nanstd(z[y == p], 0) - std) for p in range(3))
        fractions = {"train": 0.6, "validation": 0.3, "test": 0.1}  # of different sizes, so that no two assignments mirror each other
        counts = splits.shares(n, fractions)
        pool, best, low = np.repeat([0, 1, 2], [counts[p] for p in splits.PERIODS]), None, np.inf
        draw = np.random.default_rng(5)
        for _ in range(starts):
            y = pool.copy()
            draw.shuffle(y)
            if score(y) < low:
                best, low = y, score(y)
        for _ in range(25):
            order, better = draw.permutation(n), None
            for i, a in enumerate(order):
                for b in order[i + 1 :]:
                    y = best.copy()
                    y[[a, b]] = y[[b, a]]
                    if better is None and best[a] != best[b] and score(y) + 1e-10 < low:
                        better = y
            if better is None:
                break
            best, low = better, score(better)
        got = splits.balanced(d, fractions, seed=5, starts=starts).orderBy("block_id").collect()
        assert [r.period for r in got] == [splits.PERIODS[k] for k in best]


def test_spatial(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 1.0), (0.0, 2.0)]
    p = spark.createDataFrame([("d", ring)], "id string, ring array<struct<x:double,y:double>>")
    c = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([(0.5, 0.5), (2.0, 1.5), (3.5, 1.5), (9.0, 9.0)])], "flat_index int, x double, y double")
    assert sorted(r.flat_index for r in spatial.cells_in_polygons(c, p, "id").collect()) == [0, 2]
    cells = spark.createDataFrame([(y * 10 + x, x + 0.5, y + 0.5) for x in range(-1, 6) for y in range(-1, 4)], "flat_index int, x double, y double")
    o = spatial.overlap(cells, p, "id", 1.0, 1.0)
    assert o.agg(F.sum("area")).first()[0] == pytest.approx(6.0)
    part = {r.flat_index: r.fraction for r in o.collect()}
    assert part[0] == pytest.approx(1.0) and part[10] == pytest.approx(0.75) and all(0 < f <= 1 + 1e-9 for f in part.values())
    assert spatial.overlap(cells, p, "id", 1.0, 1.0, min_fraction=0.99).count() < o.count()


def test_reports(spark):
    d = spark.createDataFrame([("a", D(2020, 12, 1), 1.0), ("a", D(2020, 1, 5), 2.0), ("b", D(2020, 7, 1), float("nan"))], "g string, date date, v double")
    q = compare.quartiles(d, ["g"], "v").where("g = 'a'").first()
    assert (q.q1, q.median, q.q3) == (1.25, 1.5, 1.75)
    m = {(r.g, r.month.month): (r.v, r.season) for r in compare.monthly(d, ["g"], ["v"]).collect()}
    assert m["b", 7] == (0.0, "Jun-Sep") and m["a", 12] == (1.0, "Dec-May")
    s = sorted(r.s for r in d.where("g = 'a' AND v = 1").select(F.explode(C.seasons_of("date")).alias("s")).collect())
    assert s == ["DJF", "Dec-May"]
    fd = compare.flow_duration(d, ["g"], "v").where("g = 'a'").orderBy("rank").collect()
    assert [(r.v, round(r.exceedance, 4)) for r in fd] == [(2.0, 33.3333), (1.0, 66.6667)]
    assert math.isclose(one(spark.range(1).select(C.kge_skill(F.lit(1.0)).alias("k")), "k").k, 1.0)


def test_geographic_nearest_and_gauge_places(spark):
    rng = np.random.default_rng(12)
    cells = np.stack([rng.uniform(-120, -100, 50), rng.uniform(30, 45, 50)], 1)
    pts = np.stack([rng.uniform(-120, -100, 15), rng.uniform(30, 45, 15)], 1)
    c = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(cells)], "flat_index bigint, x double, y double")
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "gauge bigint, x double, y double")
    got = {r.gauge: (r.flat_index, r.distance) for r in network.nearest(p, c, "gauge", geographic=True).collect()}
    for k, (x, y) in enumerate(pts):
        d = 111.32 * np.hypot((cells[:, 0] - x) * np.cos(np.radians(y)), cells[:, 1] - y)
        assert got[k][0] == d.argmin() and got[k][1] == pytest.approx(d.min())
    grid_ = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, -110.0, 35.0), (1, 0, 1, 10.0, 0.0, -109.0, 35.0)], "flat_index bigint, y int, x int, xc double, yc double, lon double, lat double")
    g = spark.createDataFrame([("a", 1, None, None, None, None, -110.0, 35.0), ("b", None, 0, 1, None, None, None, None), ("c", None, None, None, 9.0, 0.5, None, None), ("d", None, None, None, None, None, -109.9, 35.1)], "gauge_id string, flat_index bigint, row int, col int, x double, y double, lon double, lat double")
    assert {r.gauge_id: (r.flat_index, r.method) for r in network.resolve_gauges(g, grid_).collect()} == {"a": (1, "flat_index"), "b": (1, "grid"), "c": (1, "projected"), "d": (0, "geographic")}
    with pytest.raises(ValueError):
        network.resolve_gauges(g.select("gauge_id"), grid_)


def test_history(spark):
    from fluvial.operators import history

    h = spark.createDataFrame([("r", k, v) for k, v in enumerate([5.0, 4.0, 4.5, None, 4.0, 3.9, 1.0])] + [("s", 0, 1.0)], "run string, epoch bigint, val_loss double")
    assert {r.run: r.best_epoch for r in history.best_epochs(h).collect()} == {"r": 6, "s": 0}
    assert {r.run: r.stop_epoch for r in history.stop_epochs(h, 3).collect()} == {"r": 4, "s": None}
    assert {r.run: r.stop_epoch for r in history.stop_epochs(h, 9).collect()} == {"r": None, "s": None}
    g = spark.createDataFrame([("a",), ("b",), ("c",)], "gauge_id string")
    assert {r.gauge_id: r.weight for r in history.gauge_weights(g, {"a": 3.0}, ["a", "b"], ["b"], 2.0).collect()} == {"a": 3.0, "b": 2.0}


def test_balanced_split_query_searches_all_starts(spark, monkeypatch):
    """The registered query tries as many random assignments as the search has by default."""
    from fluvial.plans import window_queries
    from tests.conftest import SF

    starts = []
    shuffled = np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.rng = shuffled(seed)

        def shuffle(self, x):
            starts.append(1)
            self.rng.shuffle(x)

        def permutation(self, n):
            return self.rng.permutation(n)

    monkeypatch.setattr(splits.np.random, "default_rng", Counted)
    assert window_queries.q58_balanced_split(spark, SF).count() > 0
    assert len(starts) == 2000


def unforced(df):
    """Broadcasts in a plan that nothing asked for."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def square_cells(spark, n=60):
    return spark.range(n).select(F.col("id").alias("flat_index"), F.floor(F.col("id") / 6).alias("y"), (F.col("id") % 6).alias("x"), (F.col("id") * 7 % 11).cast("double").alias("elevation"), F.lit(2).alias("code"))


def test_ends_and_terrain_are_never_broadcast_by_estimates(spark):
    """a compressed file of a few MB looks small and isn't."""
    edges = network.downhill_edges(square_cells(spark))
    assert unforced(edges) == 0
    nodes = square_cells(spark).select(F.col("flat_index").alias("node"), "x", "y", "elevation")
    ended = network.with_ends(edges, nodes, ["x", "y", "elevation"])
    assert unforced(ended) == 0 and ended.count() == edges.count()


def test_grid_neighbours_are_never_broadcast_by_estimates(spark):
    """F9"""
    cells = square_cells(spark)
    for edges in (network.grid_edges(cells, 8, directed=True), network.grid_edges(cells, 4), network.d8_edges(cells)):
        assert unforced(edges) == 0 and edges.count() > 0
    assert unforced(network.compact(cells, network.grid_edges(cells, 4))[1]) == 0


def test_steps_along_the_flow_are_never_broadcast_by_estimates(spark):
    """F11, F12"""
    nodes = spark.range(40).select(F.col("id").alias("node"), F.lit(1.0).alias("one"))
    edges = spark.range(1, 40).where("id % 10 <> 0").select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))
    assert unforced(network.component_ids(nodes, edges)) == 0
    assert unforced(network.accumulate(nodes, network.successors(edges), ["one"], ["one"])) == 0
