"""LSTM over blocks of series: several layers, chunks, streams, long and uneven series, against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.operators import routing
from fluvial.streaming import daily


def stacked(rng, h=3, f=2):
    layer = lambda n: {"w_ih": rng.normal(size=(4 * h, n)), "w_hh": rng.normal(size=(4 * h, h)), "b_ih": rng.normal(size=4 * h), "b_hh": rng.normal(size=4 * h)}
    return {"layers": [layer(f), layer(h)], "head": rng.normal(size=h), "head_bias": -0.3}


def plain(xs, w):
    sig, states, out = lambda z: 1 / (1 + np.exp(-z)), [[np.zeros(3), np.zeros(3)] for _ in w["layers"]], []
    for x in xs:
        for layer, s in zip(w["layers"], states):
            i, f, g, o = np.split(layer["w_ih"] @ x + layer["b_ih"] + layer["w_hh"] @ s[0] + layer["b_hh"], 4)
            s[1] = sig(f) * s[1] + sig(i) * np.tanh(g)
            s[0] = x = sig(o) * np.tanh(s[1])
        out.append(w["head"] @ x + w["head_bias"])
    return out


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(n, t, float(rng.normal()), float(rng.normal())) for n, length in (("hot", 400), ("a", 30), ("b", 7), ("late", 5)) for t in range(100 if n == "late" else 0, (100 if n == "late" else 0) + length)]
    return rows, spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "node string, t int, x double, y double").repartition(4)


def test_layers_chunks_and_streams_agree(spark, series, tmp_path):
    rows, d = series
    w = stacked(np.random.default_rng(1))
    want = {}
    for n in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == n)
        want |= {(n, r[1]): v for r, v in zip(mine, plain([np.array(r[2:]) for r in mine], w))}
    chunked = routing.lstm_in_chunks(d, ["x", "y"], w, F.floor(F.col("t") / 150), order="t", activation="none")
    for low, high in ((-1, 20), (20, 120), (120, 1000)):
        d.where((F.col("t") > low) & (F.col("t") <= high)).write.mode("append").parquet(f"{tmp_path}/in")
        daily.run_once(daily.lstm_stream(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), ["x", "y"], w, order="t", activation="none"), f"{tmp_path}/out", f"{tmp_path}/state")
    for out in (routing.lstm(d, ["x", "y"], w, order="t", activation="none"), chunked, spark.read.parquet(f"{tmp_path}/out")):
        got = {(r.node, r.t): r.value for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert routing.lstm(d.limit(0), ["x", "y"], w, order="t").count() == 0


def test_several_rows_at_one_time_are_steps(spark):
    w = stacked(np.random.default_rng(2))
    d = spark.createDataFrame([("a", 1, 0.5, 0.5), ("a", 1, 0.5, 0.5), ("b", 1, 1.0, 0.0)], "node string, t int, x double, y double")
    got = sorted((r.node, round(r.value, 9)) for r in routing.lstm(d, ["x", "y"], w, order="t", activation="none").collect())
    assert got == sorted([("a", round(v, 9)) for v in plain([np.array([0.5, 0.5])] * 2, w)] + [("b", round(plain([np.array([1.0, 0.0])], w)[0], 9))])
