"""Message passing over networks, and models along time.

A node's state is a set of double columns. Messages are a join of edges with states and a sum by target, so partial sums
are combined before the shuffle; dense layers are column expressions while they are small and Arrow batches through numpy
beyond that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvial.common import materialize
from fluvial.functions.columns import ACTIVATIONS

#: Dense layers with up to so many weights are expressions.
EXPRESSION_WEIGHTS = 256


def dense(df: DataFrame, inputs: Sequence[str], weights: np.ndarray, bias: np.ndarray | None, outputs: Sequence[str], activation: str = "none") -> DataFrame:
    """df with outputs = activation(inputs @ weights + bias), and without the inputs that aren't outputs."""
    weights = np.asarray(weights, float)
    bias = np.zeros(weights.shape[1]) if bias is None else np.asarray(bias, float)
    kept = [c for c in df.columns if c not in inputs and c not in outputs]
    if weights.size <= EXPRESSION_WEIGHTS:
        unit = lambda j: reduce(lambda a, i: a + float(weights[i, j]) * F.col(inputs[i]), range(len(inputs)), F.lit(float(bias[j])))
        return df.select(*kept, *[ACTIVATIONS[activation](unit(j)).alias(o) for j, o in enumerate(outputs)])
    f = {"none": lambda z: z, "identity": lambda z: z, "linear": lambda z: z, "relu": lambda z: np.maximum(z, 0), "sigmoid": lambda z: 1 / (1 + np.exp(-z)), "silu": lambda z: z / (1 + np.exp(-z)), "softplus": lambda z: np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)}[activation]

    def run(batches):
        for pdf in batches:
            z = f(pdf[list(inputs)].to_numpy(float) @ weights + bias)
            out = pdf[kept].copy()
            for j, o in enumerate(outputs):
                out[o] = z[:, j]
            yield out

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(o, T.DoubleType()) for o in outputs])
    return df.mapInPandas(run, schema)


def layer_norm(df: DataFrame, columns: Sequence[str], gain: Sequence[float] | None = None, shift: Sequence[float] | None = None, eps: float = 1e-5) -> DataFrame:
    n = len(columns)
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / n
    d = df.withColumn("_m", mean)
    var = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col("_m"), F.lit(2)) for c in columns]) / n
    d = d.withColumn("_s", F.sqrt(var + eps))
    return d.withColumns({c: (F.col(c) - F.col("_m")) / F.col("_s") * (gain[k] if gain is not None else 1.0) + (shift[k] if shift is not None else 0.0) for k, c in enumerate(columns)}).drop("_m", "_s")


def gather(nodes: DataFrame, edges: DataFrame, state: Sequence[str], by: Sequence[str] = (), side: str = "src") -> DataFrame:
    """Edges with the state of their source (or target); `by` are further keys of the states, as time."""
    return edges.join(nodes.select(F.col("node").alias(side), *by, *state), side)


def collect(nodes: DataFrame, messages: DataFrame, state: Sequence[str], by: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """node, by..., state: the sum or mean of the messages (dst, ...) at each node; 0 where none arrives."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    m = messages.groupBy(F.col("dst").alias("node"), *by).agg(*[f(c).alias(f"_{c}") for c in state])
    return nodes.join(m, ["node", *by], "left").select(*nodes.columns, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(f"agg_{c}") for c in state])


def weighted(messages: DataFrame, state: Sequence[str], weight: Column | str) -> DataFrame:
    w = F.col(weight) if isinstance(weight, str) else weight
    return messages.withColumns({c: F.col(c) * w for c in state})


def sum_layer(nodes, edges, state, by=(), how="sum", weight=None):
    """agg_...: the plain (weighted) sum or mean of the neighbours' states."""
    m = gather(nodes, edges, state, by)
    return collect(nodes, m if weight is None else weighted(m, state, weight), state, by, how)


def gcn_layer(nodes: DataFrame, edges: DataFrame, state: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """States averaged with self loops of weight 1, scaled by the roots of both degrees; the dense layer comes before or after."""
    e = edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w")).where("src <> dst")
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")).distinct()
    e = e.unionByName(loops)
    degree = e.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("d"))
    root = lambda c: F.when(F.col(c) > 0, 1 / F.sqrt(c)).otherwise(0.0)
    e = e.join(degree.select(F.col("node").alias("src"), root("d").alias("a")), "src").join(degree.select(F.col("node").alias("dst"), root("d").alias("b")), "dst")
    out = collect(nodes, weighted(gather(nodes, e, state, by), state, F.col("a") * F.col("w") * F.col("b")), state, by)
    return out.select("node", *by, *[F.col(f"agg_{c}").alias(c) for c in state])


def gin_layer(nodes, edges, state, by=(), eps: float = 0.0):
    """(1 + eps) times the own state plus the sum of the neighbours'."""
    out = sum_layer(nodes, edges, state, by)
    return out.select("node", *by, *[((1 + eps) * F.col(c) + F.col(f"agg_{c}")).alias(c) for c in state])


def sage_layer(nodes, edges, state, w_neighbour: np.ndarray, w_self: np.ndarray, bias, outputs: Sequence[str], by=()):
    """The mean of the neighbours and the own state through a dense layer each, added."""
    out = sum_layer(nodes, edges, state, by, "mean")
    both = np.concatenate([np.asarray(w_neighbour), np.asarray(w_self)])
    return dense(out, [f"agg_{c}" for c in state] + list(state), both, bias, outputs)


def gat_layer(nodes, edges, state, attend_src: Sequence[float], attend_dst: Sequence[float], by=(), slope: float = 0.2, heads: int = 1, edge_features: Sequence[str] = (), attend_edge: np.ndarray | None = None, tasks: int | None = None):
    """Attention over in-edges and a self loop, on states that have been through the dense layer.

    Each head has its part of the state, in order, and its softmax; their results stand side by side. attend_edge, a row a head, weighs
    edge_features in the scores; a self loop has the mean of its node's in-edges, 0 without any. Missing features are 0. All heads share one pass
    over the messages. tasks: how many tasks take the messages of nodes, if not what the session says.
    """
    if len(state) % heads:
        raise ValueError("the width of the state must be a multiple of the heads")
    width, every = len(state) // heads, range(heads)
    parts = [range(h * width, (h + 1) * width) for h in every]
    dot = lambda w, h: reduce(lambda a, k: a + float(w[k]) * F.col(state[k]), parts[h], F.lit(0.0))
    scored = nodes.select("node", *by, *state, *[dot(attend_src, h).alias(f"_as{h}") for h in every], *[dot(attend_dst, h).alias(f"_ad{h}") for h in every])
    given = [f"_e{k}" for k in range(len(edge_features))]
    e = edges.where("src <> dst").select("src", "dst", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(g) for c, g in zip(edge_features, given)])
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct()
    if given:
        mean = e.groupBy("dst").agg(*[F.avg(g).alias(g) for g in given])
        loops = loops.join(mean, "dst", "left").select("src", "dst", *[F.coalesce(g, F.lit(0.0)).alias(g) for g in given])
    m = gather(scored.drop(*[f"_ad{h}" for h in every]), e.unionByName(loops), [*state, *[f"_as{h}" for h in every]], by)
    own = scored.select(F.col("node").alias("dst"), *by, *[f"_ad{h}" for h in every])
    m = m.join(own.repartition(tasks, "dst", *by) if tasks else own, ["dst", *by])
    score = lambda h: reduce(lambda a, k: a + float(attend_edge[h][k]) * F.col(given[k]), range(len(given)), F.col(f"_as{h}") + F.col(f"_ad{h}"))
    m = m.withColumns({f"_z{h}": score(h) for h in every})
    m = m.withColumns({f"_z{h}": F.when(F.col(f"_z{h}") > 0, F.col(f"_z{h}")).otherwise(slope * F.col(f"_z{h}")) for h in every})
    w = Window.partitionBy("dst", *by)
    m = m.withColumns({f"_p{h}": F.exp(F.col(f"_z{h}") - F.max(f"_z{h}").over(w)) for h in every})
    m = m.withColumns({f"_p{h}": F.col(f"_p{h}") / F.sum(f"_p{h}").over(w) for h in every})
    m = m.withColumns({state[k]: F.col(state[k]) * F.col(f"_p{h}") for h in every for k in parts[h]})
    out = collect(nodes, m, state, by)
    return out.select("node", *by, *[F.col(f"agg_{c}").alias(c) for c in state])


def mpnn_layer(nodes: DataFrame, edges: DataFrame, state: Sequence[str], edge_features: Sequence[str], message: list[tuple[np.ndarray, np.ndarray, str]], own: list, update: list, hidden: int, gate: list | None = None, weight: str | None = None, how: str = "sum", by: Sequence[str] = ()) -> DataFrame:
    """A directed layer: messages of source state and edge features, optionally gated and weighted, gathered at the target and
    combined with the target's own state. Each of message, gate, own, update is a list of dense layers (weights, bias,
    activation); all end in `hidden` columns h0, h1, ..."""
    hs = [f"h{k}" for k in range(hidden)]

    def mlp(df, inputs, layers, name):
        for k, (w, b, a) in enumerate(layers):
            outs = [f"{name}{j}" if k == len(layers) - 1 else f"_{name}_{k}_{j}" for j in range(np.shape(w)[1])]
            df, inputs = dense(df, inputs, w, b, outs, a), outs
        return df

    keep = [c for c in ["src", "dst", *by, *([weight] if weight else [])]]
    given = gather(nodes, edges.select("src", "dst", *edge_features, *([weight] if weight and weight not in edge_features else [])), state, by)
    ins = [*state, *edge_features]
    given = given.select(*keep, *[F.col(c).alias(f"i{k}") for k, c in enumerate(ins)], *[F.col(c).alias(f"g{k}") for k, c in enumerate(ins)])
    m = mlp(given, [f"i{k}" for k in range(len(ins))], message, "h")
    if gate:
        m = mlp(m, [f"g{k}" for k in range(len(ins))], gate, "z").withColumns({h: F.col(h) * F.col(f"z{k}") for k, h in enumerate(hs)})
    if weight:
        m = weighted(m, hs, weight)
    mine = mlp(nodes.select("node", *by, *[F.col(c).alias(f"s{k}") for k, c in enumerate(state)]), [f"s{k}" for k in range(len(state))], own, "o")
    both = collect(mine, m, hs, by, how)
    return mlp(both, [f"o{k}" for k in range(np.shape(own[-1][0])[1])] + [f"agg_{h}" for h in hs], update, "h")


def graph_forward(nodes: DataFrame, edges: DataFrame, state: Sequence[str], layers: Sequence[dict], head: tuple, by: Sequence[str] = ("date",), activation: str = "softplus", tasks: int | None = None) -> DataFrame:
    """node, by..., value: dense layer, convolution, normalisation and ReLU for each of layers (kind, weights, bias), then a
    linear head. tasks: for the messages of attention, if the session's aren't enough."""
    d, cols = nodes.select("node", *by, *state), list(state)
    for layer in layers:
        w, b, kind = np.asarray(layer["weights"], float), layer.get("bias"), layer.get("kind", "gcn")
        outs = [f"c{k}" for k in range(w.shape[1])]
        if kind == "sage":
            d = sage_layer(d, edges, cols, w, np.asarray(layer["self_weights"], float), b, outs, by)
        elif kind == "gin":
            d = dense(gin_layer(d, edges, cols, by), cols, w, b, outs)
        else:
            d = dense(d, cols, w, None, outs)
            d = gcn_layer(d, edges, outs, by, layer.get("weight")) if kind == "gcn" else gat_layer(d, edges, outs, layer["attend_src"], layer["attend_dst"], by, heads=layer.get("heads", 1), edge_features=layer.get("edge_features", ()), attend_edge=layer.get("attend_edge"), tasks=tasks)
            if b is not None:
                d = d.withColumns({o: F.col(o) + float(b[k]) for k, o in enumerate(outs)})
        d = layer_norm(d, outs)
        d, cols = d.withColumns({o: F.greatest(F.col(o), F.lit(0.0)) for o in outs}), outs
    return dense(d, cols, head[0], head[1], ["value"], activation)


# -- models along time ---------------------------------------------------------------------------------------------------


class Recurrence:
    """LSTM layers, one upon the other, and a linear head, for many series at a time.

    weights: w_ih (4H, F), w_hh (4H, H), b_ih, b_hh (4H), or layers, a list of such; head (H,), head_bias; gates in the order input,
    forget, cell, output. A state has two rows of H numbers for each layer, flat: hidden and cell.
    """

    def __init__(self, weights: Mapping, activation: str):
        self.layers = weights.get("layers") or [weights]
        self.head, self.bias = np.asarray(weights["head"], float), float(weights["head_bias"])
        self.hidden = [np.shape(x["w_hh"])[1] for x in self.layers]
        self.size = 2 * sum(self.hidden)
        self.out = {"none": lambda z: z, "relu": lambda z: np.maximum(z, 0), "softplus": lambda z: np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)}[activation]

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and next states of series with inputs x (a row each) and states (a row each)."""
        sig, kept, at = lambda z: 1 / (1 + np.exp(-z)), [], 0
        for w, h in zip(self.layers, self.hidden):
            before, cell = state[:, at : at + h], state[:, at + h : at + 2 * h]
            i, f, g, o = np.split(x @ np.asarray(w["w_ih"], float).T + before @ np.asarray(w["w_hh"], float).T + w["b_ih"] + w["b_hh"], 4, axis=1)
            cell = sig(f) * cell + sig(i) * np.tanh(g)
            x = sig(o) * np.tanh(cell)
            kept += [x, cell]
            at += 2 * h
        return self.out(x @ self.head + self.bias), np.concatenate(kept, axis=1)


def recur(df: DataFrame, features: Sequence[str], weights: Mapping, by: str = "node", order: str = "date", activation: str = "softplus", initial: DataFrame | None = None) -> DataFrame:
    """by, order, value, state: the steps of lstm(), with state null, and for each series a row without time and value that has its last state, an array.

    Series are dealt out to tasks by `by`, and each task goes through its rows in the order of time, all series of a time step as one matrix: it holds
    the states of its series and a batch of rows, however long the series are. initial: by, state, where series go on from; from zero if they have
    none. So a record may be worked off in chunks of time, the states of one being the initial ones of the next.
    """
    import pyarrow as pa

    cell, n = Recurrence(weights, activation), len(features)
    rows = df.where(F.col(order).isNotNull()).select(by, order, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)], F.lit(None).cast("array<double>").alias("_state"))
    if initial is not None:
        rows = rows.unionByName(initial.select(by, F.lit(None).cast(df.schema[order].dataType).alias(order), *[F.lit(None).cast("double").alias(f"_x{k}") for k in range(n)], F.col("state").alias("_state")))
    # states come before all rows, since they have no time
    dealt = rows.repartition(by).sortWithinPartitions(F.asc_nulls_first(order), by)

    def run(batches):
        place: dict = {}
        states, schema = np.zeros((0, cell.size)), None
        for batch in batches:
            schema = pa.schema([(by, batch.schema.field(0).type), (order, batch.schema.field(1).type), ("value", pa.float64()), ("state", pa.list_(pa.float64()))])
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [k for k in dict.fromkeys(keys) if k not in place]
            place.update({k: len(place) + i for i, k in enumerate(new)})
            states = np.concatenate([states, np.zeros((len(new), cell.size))])
            at = np.array([place[k] for k in keys], np.int64)
            x = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(n)], axis=1)
            out, begin = np.empty(len(keys)), 0
            while begin < len(keys):
                end, seen = begin + 1, {keys[begin]}
                if times[begin] is None:
                    states[at[begin]] = batch.column(2 + n)[begin].as_py()
                else:  # a time step; of a series that has several rows at one time each is a step
                    while end < len(keys) and times[end] == times[begin] and keys[end] not in seen:
                        seen.add(keys[end])
                        end += 1
                    out[begin:end], states[at[begin:end]] = cell.step(x[begin:end], states[at[begin:end]])
                begin = end
            steps = np.flatnonzero([t is not None for t in times])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(steps), batch.column(1).take(steps), pa.array(out[steps]), pa.nulls(len(steps), schema.field(3).type)], schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(place), schema.field(0).type), pa.nulls(len(place), schema.field(1).type), pa.nulls(len(place), pa.float64()), pa.array(states.tolist(), schema.field(3).type)], schema=schema)

    schema = T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField(order, df.schema[order].dataType), T.StructField("value", T.DoubleType()), T.StructField("state", T.ArrayType(T.DoubleType()))])
    return dealt.mapInArrow(run, schema)


def lstm(df: DataFrame, features: Sequence[str], weights: Mapping, by: str = "node", order: str = "date", activation: str = "softplus", initial: DataFrame | None = None) -> DataFrame:
    """by, order, value: LSTM layers along each series, from a zero state or the initial ones (by, state), and a linear head; see Recurrence for the weights."""
    return recur(df, features, weights, by, order, activation, initial).where(F.col(order).isNotNull()).drop("state")


def lstm_in_chunks(df: DataFrame, features: Sequence[str], weights: Mapping, chunk: Column, by: str = "node", order: str = "date", activation: str = "softplus") -> DataFrame:
    """As lstm(), one chunk of time after the other; each is written with its states, where a run that fails can go on. chunk: a column that rises with the order."""
    d = df.withColumn("_chunk", chunk)
    out = states = None
    for k in sorted(r[0] for r in d.select("_chunk").distinct().collect()):  # a few
        done = materialize(recur(d.where(F.col("_chunk") == k), features, weights, by, order, activation, states), "lstm-chunk")
        part = done.where(F.col(order).isNotNull()).drop("state")
        ended = done.where(F.col(order).isNull()).select(by, "state")
        states = ended  # series that rest in a chunk are in it, too, with the state they came with
        out = part if out is None else out.unionByName(part)
    return out if out is not None else lstm(df, features, weights, by, order, activation)


def causal_layer(df: DataFrame, inputs: Sequence[str], kernels: np.ndarray, bias: Sequence[float], dilation: int, by: str = "node", order: str = "date") -> DataFrame:
    """A causal dilated convolution (kernels: out, in, width) with SiLU, and the input added where the width stays the same:
    lags only, so it stays in SQL."""
    w = Window.partitionBy(by).orderBy(order)
    n_out, n_in, width = kernels.shape
    shifted = {(i, k): (F.col(c) if k == width - 1 else F.coalesce(F.lag(c, (width - 1 - k) * dilation).over(w), F.lit(0.0))) for i, c in enumerate(inputs) for k in range(width)}
    total = lambda o: reduce(lambda a, ik: a + float(kernels[o, ik[0], ik[1]]) * shifted[ik], shifted, F.lit(float(bias[o])))
    unit = lambda o: ACTIVATIONS["silu"](total(o)) + (F.col(inputs[o]) if n_in == n_out else 0.0)
    return df.select(by, order, *[unit(o).alias(f"t{o}") for o in range(n_out)])


def temporal_head(df: DataFrame, value: str, layers: Sequence[tuple[np.ndarray, Sequence[float]]], by: Sequence[str], order: str, residual: bool = True) -> DataFrame:
    """df with `value` put through centred convolutions along each series, (kernels: out, in, odd width; bias), with ReLU between them, and
    added to itself if residual. Steps beyond the ends, and missing values, count as 0. All layers share one order of the rows."""
    if np.shape(layers[0][0])[1] != 1 or np.shape(layers[-1][0])[0] != 1 or any(np.shape(k)[2] % 2 == 0 for k, _ in layers):
        raise ValueError("a temporal head goes from one value to one, by kernels of odd width")
    w = Window.partitionBy(*by).orderBy(order)
    moved = lambda c, shift: F.col(c) if not shift else F.lag(c, shift, 0.0).over(w) if shift > 0 else F.lead(c, -shift, 0.0).over(w)
    d, ins, made = df.withColumn("_t", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), ["_t"], ["_t"]
    for n, (kernels, bias) in enumerate(layers):
        kernels, last = np.asarray(kernels, float), n == len(layers) - 1
        half, outs = kernels.shape[2] // 2, [f"_t{n}_{o}" for o in range(kernels.shape[0])]
        taps = [(i, k) for i in range(kernels.shape[1]) for k in range(kernels.shape[2])]
        total = lambda o: reduce(lambda a, x: a + float(kernels[o, x[0], x[1]]) * moved(ins[x[0]], half - x[1]), taps, F.lit(float(bias[o])))  # noqa: B023, E731
        d = d.withColumns({c: total(o) if last else F.greatest(total(o), F.lit(0.0)) for o, c in enumerate(outs)})
        ins, made = outs, made + outs
    return d.withColumn(value, F.col(ins[0]) + F.col("_t") if residual else F.col(ins[0])).drop(*made)
