"""Directed graph auto-encoder over four weighted propagation channels.

``Z = S relu(sum_c A_c X W_c + X W_s) W2`` with the symmetric normalisation S;
a pair (i, j) is decoded asymmetrically as ``sigmoid(Z_i Wq . Z_j Wk)``.

Training sees every edge.  A graph within MOST_PAIRS is kept as sparse arrays on
the driver (``A_c X`` does not depend on the weights and is computed once, in
Spark); a larger one is trained by :mod:`.descent`, where it stays distributed.
Scoring is distributed:
dense layers run per node over Arrow batches, sparse products are joins and sums,
pairs are decoded by native expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import ship
from . import graph

CHANNELS = ("amount_out", "amount_in", "count_out", "count_in")
#: Edges, and nodes, up to which the driver holds the graph; beyond, the same descent is distributed.
MOST_PAIRS = 2_000_000
_B1, _B2, _EPS = 0.9, 0.999, 1e-8


class Sparse(NamedTuple):
    """Rows (sorted), columns and weights of an n-row matrix."""

    row: np.ndarray
    col: np.ndarray
    w: np.ndarray
    n: int

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]), dtype=x.dtype)
        if len(self.row):
            at = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
            out[self.row[at]] = np.add.reduceat(self.w[:, None] * x[self.col], at, axis=0)
        return out


class Model(NamedTuple):
    weights: dict[str, np.ndarray]
    columns: list[str]
    losses: list[float]


def glorot(rng: np.random.Generator, a: int, b: int) -> np.ndarray:
    limit = np.sqrt(6.0 / (a + b))
    return rng.uniform(-limit, limit, (a, b)).astype(np.float32)


def new_weights(n_features: int, hidden: int, embed: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    first = {c: glorot(rng, n_features, hidden) for c in (*CHANNELS, "self")}
    return first | {"w2": glorot(rng, hidden, embed), "q": glorot(rng, embed, embed), "k": glorot(rng, embed, embed)}


def forward(weights: dict, inputs: dict[str, np.ndarray], sym: Sparse) -> dict[str, np.ndarray]:
    pre = sum(inputs[c] @ weights[c] for c in (*CHANNELS, "self"))
    m = np.maximum(pre, 0)
    z = sym @ (m @ weights["w2"])
    return {"pre": pre, "m": m, "z": z, "zq": z @ weights["q"], "zk": z @ weights["k"]}


def decode(state: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((state["zq"][i] * state["zk"][j]).sum(axis=1), -30, 30)))


def gradients(weights: dict, inputs: dict, sym: Sparse, state: dict, i: np.ndarray, j: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of the pairs, and its gradient for every weight."""
    p = decode(state, i, j)
    loss = float(np.mean(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))))
    d = ((p - y) / len(y)).astype(np.float32)[:, None]

    def scatter(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.argsort(at, kind="stable")
        return Sparse(at[order], np.arange(len(at)), np.ones(len(at), dtype=np.float32), sym.n) @ rows[order]

    dzq, dzk = scatter(i, d * state["zk"][j]), scatter(j, d * state["zq"][i])
    out = {"q": state["z"].T @ dzq, "k": state["z"].T @ dzk}
    dh = sym @ (dzq @ weights["q"].T + dzk @ weights["k"].T)  # S is symmetric
    out["w2"] = state["m"].T @ dh
    dpre = (dh @ weights["w2"].T) * (state["pre"] > 0)
    return loss, out | {c: inputs[c].T @ dpre for c in (*CHANNELS, "self")}


def negatives(rng: np.random.Generator, n: int, taken: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` ordered pairs of different nodes whose codes i * n + j are not ``taken`` (sorted); none where no pair is free."""
    if n * n <= 8 * max(count, len(taken)):  # dense: draw from the list of what is free
        free = np.setdiff1d(np.arange(n * n), np.concatenate([taken, np.arange(n) * (n + 1)]))
        code = rng.choice(free, count) if len(free) else free
        return code // n, code % n
    i, j = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    while len(i) < count:  # most draws are free
        a, b = rng.integers(0, n, 2 * (count - len(i))), rng.integers(0, n, 2 * (count - len(i)))
        code = a * n + b
        at = np.minimum(np.searchsorted(taken, code), max(len(taken) - 1, 0))
        ok = (a != b) & ((taken[at] != code) if len(taken) else True)
        i, j = np.concatenate([i, a[ok]]), np.concatenate([j, b[ok]])
    return i[:count], j[:count]


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = _B1 * self.m[k] + (1 - _B1) * g
            self.v[k] = _B2 * self.v[k] + (1 - _B2) * g * g
            self.weights[k] = self.weights[k] - self.rate * (self.m[k] / (1 - _B1**self.t)) / (np.sqrt(self.v[k] / (1 - _B2**self.t)) + _EPS)


def fit(inputs: dict[str, np.ndarray], sym: Sparse, i: np.ndarray, j: np.ndarray, epochs: int = 200, rate: float = 0.02, hidden: int = 64, embed: int = 32, seed: int = 0, columns: list[str] | None = None) -> Model:
    """Full-batch Adam; each epoch draws as many negative pairs as there are positive ones."""
    adam = Adam(new_weights(inputs["self"].shape[1], hidden, embed, seed), rate)
    rng = np.random.default_rng(seed + 1)
    taken = np.unique(np.concatenate([i * sym.n + j, j * sym.n + i]))
    losses = []
    for _ in range(epochs):
        a, b = negatives(rng, sym.n, taken, len(i))
        y = np.concatenate([np.ones(len(i)), np.zeros(len(a))]).astype(np.float32)
        pi, pj = np.concatenate([i, a]), np.concatenate([j, b])
        loss, grad = gradients(adam.weights, inputs, sym, forward(adam.weights, inputs, sym), pi, pj, y)
        losses.append(loss)
        adam.step(grad)
    return Model({k: x.astype(np.float32) for k, x in adam.weights.items()}, columns or [], losses)


def train(edges: DataFrame, feats: DataFrame, columns: list[str], most_pairs: int = MOST_PAIRS, **options) -> Model:
    """Fit on the whole graph of ``edges`` with scaled features ``feats`` (node_id, columns); over ``most_pairs`` edges or nodes, distributed."""
    if max(edges.count(), feats.count()) > most_pairs:
        from . import descent

        return descent.fit(edges, feats, columns, **options)
    x = feats.select("node_id", *columns).orderBy("node_id").toPandas()
    place = {n: k for k, n in enumerate(x["node_id"])}
    n = len(place)
    base = x[columns].to_numpy(dtype=np.float32)
    inputs = {"self": base}
    through = graph.propagate(graph.directed_channels(edges), feats, columns).toPandas()
    for c in CHANNELS:
        own = through[through["channel"] == c]
        out = np.zeros_like(base)
        out[own["i"].map(place).to_numpy(dtype=np.int64)] = own[columns].to_numpy(dtype=np.float32)
        inputs[c] = out
    norm = graph.degree_norm(graph.adjacency(edges)).toPandas()
    si, sj = norm["i"].map(place).to_numpy(dtype=np.int64), norm["j"].map(place).to_numpy(dtype=np.int64)
    order = np.lexsort((sj, si))
    alone = np.setdiff1d(np.arange(n), si)  # nodes without edges keep themselves
    rows = np.concatenate([si[order], alone])
    cols, w = np.concatenate([sj[order], alone]), np.concatenate([norm["w"].to_numpy()[order], np.ones(len(alone))]).astype(np.float32)
    again = np.argsort(rows, kind="stable")
    got = graph.positive_pairs(edges).orderBy("src", "dst").toPandas()
    i, j = got["src"].map(place).to_numpy(dtype=np.int64), got["dst"].map(place).to_numpy(dtype=np.int64)
    return fit(inputs, Sparse(rows[again], cols[again], w[again], n), i, j, columns=columns, **options)


def _packs(edges: DataFrame, feats: DataFrame, width: int, most_pairs: int) -> bool:
    """Whether sums over ``edges`` run over packed pairs: where they are packed already, or are many and a state of ``width`` numbers a node fits a task."""
    from . import descent, packed

    return packed.known(edges, feats) is not None or edges.count() > most_pairs and feats.count() * width <= descent.MOST_CELLS


def embed(model: Model, edges: DataFrame, feats: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """node_id, z, zq, zk (arrays of double) of every node, distributed; all sums and products run in double precision."""
    from . import packed

    if _packs(edges, feats, max(model.weights["w2"].shape[1], len(model.columns) + 1), most_pairs):
        return packed.embedded(model, edges, feats)
    ship(edges.sparkSession)
    cols, weights = model.columns, {k: w.astype(np.float64) for k, w in model.weights.items()}
    dims = weights["w2"].shape[1]
    through = graph.propagate(graph.directed_channels(edges), feats, cols)
    packed = through.groupBy("i").pivot("channel", list(CHANNELS)).agg(F.first(F.array(*[F.col(c).cast("double") for c in cols])))
    rows = feats.select("node_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("self")).join(packed.withColumnRenamed("i", "node_id"), "node_id", "left")
    zero = F.array(*[F.lit(0.0) for _ in cols])
    rows = rows.select("node_id", "self", *[F.coalesce(F.col(c), zero).alias(c) for c in CHANNELS])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda k: np.asarray(batch.column(k).flatten()).reshape(batch.num_rows, -1)  # noqa: B023,E731
            h = np.maximum(sum(get(k) @ weights[c] for k, c in enumerate(("self", *CHANNELS), 1)), 0) @ weights["w2"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(h[:, k]) for k in range(dims)]], names=["j", *[f"h{k}" for k in range(dims)]])

    h = rows.mapInArrow(dense, "j string, " + ", ".join(f"h{k} double" for k in range(dims)))
    norm = graph.degree_norm(graph.adjacency(edges))
    alone = feats.select("node_id").join(norm.select(F.col("i").alias("node_id")), "node_id", "left_anti").select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("w"))
    z = norm.unionByName(alone).join(h, "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(f"h{k}")).alias(f"h{k}") for k in range(dims)])
    z = z.select(F.col("i").alias("node_id"), *[F.col(f"h{k}") for k in range(dims)])
    through_w = lambda w: F.array(*[sum((F.col(f"h{a}") * float(w[a, b]) for a in range(1, dims)), F.col("h0") * float(w[0, b])) for b in range(dims)])
    if dims <= 16:  # small products stay in generated code
        return z.select("node_id", F.array(*[f"h{k}" for k in range(dims)]).alias("z"), through_w(weights["q"]).alias("zq"), through_w(weights["k"]).alias("zk"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(dims)], axis=1)
            arrays = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, dims, dtype=np.int32)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays(x), arrays(x @ weights["q"]), arrays(x @ weights["k"])], names=["node_id", "z", "zq", "zk"])

    return z.mapInArrow(heads, "node_id string, z array<double>, zq array<double>, zk array<double>")


def decode_pairs(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) plus p, the decoded chance of the directed edge."""
    a = emb.select(F.col("node_id").alias("src"), "zq")
    b = emb.select(F.col("node_id").alias("dst"), "zk")
    rows = pairs.join(a, "src").join(b, "dst")
    return rows.withColumn("p", scalars.sigmoid(scalars.dot(F.col("zq"), F.col("zk")))).drop("zq", "zk")


def reconstruction_scores(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """node_id, score: mean surprise (1 - p) over a node's edges, parallel edges counted; 0 without edges.

    Each directed pair is decoded once and weighted by its number of edges.
    """
    made = edges.__dict__.get("_tallyweave_packed")
    if made:
        from . import packed

        if (p := packed.known(edges, made[1])) is not None:
            return packed.surprise(p, emb)
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    rows = decode_pairs(pairs, emb).withColumn("s", (1 - F.col("p")) * F.col("n"))
    ends = rows.select(F.col("src").alias("node_id"), "s", "n").unionByName(rows.select(F.col("dst").alias("node_id"), "s", "n"))
    by = ends.groupBy("node_id").agg((F.sum("s") / F.sum("n")).alias("score"))
    return emb.select("node_id").join(by, "node_id", "left").fillna(0.0, ["score"])
