"""The first version of the graph model: an undirected auto-encoder with an inner-product decoder, and its scores.

``Z = S relu(S X W0) W1`` with the symmetric normalisation S; a pair is decoded
as ``sigmoid(Z_i . Z_j)``.  It is kept for comparison and trains on the driver
only: a graph over ``model.MOST_PAIRS`` is refused, not cut.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import graph, metrics
from .model import MOST_PAIRS, Adam, Sparse, glorot, negatives


class Plain(NamedTuple):
    w0: np.ndarray
    w1: np.ndarray
    columns: list[str]
    losses: list[float]


def forward(w: dict[str, np.ndarray], sx: np.ndarray, sym: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """(S X W0, Z); ``sx`` is S X, which no weight changes."""
    pre = sx @ w["w0"]
    return pre, sym @ (np.maximum(pre, 0) @ w["w1"])


def gradients(w: dict[str, np.ndarray], sx: np.ndarray, sym: Sparse, i: np.ndarray, j: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    pre, z = forward(w, sx, sym)
    p = 1 / (1 + np.exp(-np.clip((z[i] * z[j]).sum(axis=1), -30, 30)))
    loss = float(np.mean(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))))
    d = ((p - y) / max(len(y), 1))[:, None]
    dz = np.zeros_like(z)
    np.add.at(dz, i, d * z[j])
    np.add.at(dz, j, d * z[i])
    dm = sym @ dz  # S is symmetric
    return loss, {"w1": np.maximum(pre, 0).T @ dm, "w0": sx.T @ (dm @ w["w1"].T * (pre > 0))}


def train(edges: DataFrame, feats: DataFrame, columns: list[str], epochs: int = 200, rate: float = 0.01, hidden: int = 64, embed: int = 32, seed: int = 0) -> Plain:
    pairs = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).filter("i != j").distinct()
    if max(pairs.count(), feats.count()) > MOST_PAIRS:
        raise ValueError(f"over {MOST_PAIRS} pairs or nodes: use the directed model, which trains without a driver-side graph")
    x = feats.select("node_id", *columns).orderBy("node_id").toPandas()
    place = {n: k for k, n in enumerate(x["node_id"])}
    norm = with_loops(graph.degree_norm(graph.adjacency(edges)), feats).toPandas()
    row, col = norm["i"].map(place).to_numpy(dtype=np.int64), norm["j"].map(place).to_numpy(dtype=np.int64)
    order = np.lexsort((col, row))
    sym = Sparse(row[order], col[order], norm["w"].to_numpy()[order], len(place))
    sx = sym @ x[columns].to_numpy(dtype=np.float64)
    got = pairs.orderBy("i", "j").toPandas()
    i, j = got["i"].map(place).to_numpy(dtype=np.int64), got["j"].map(place).to_numpy(dtype=np.int64)
    rng = np.random.default_rng(seed)
    adam = Adam({"w0": glorot(rng, len(columns), hidden), "w1": glorot(rng, hidden, embed)}, rate)
    taken = np.unique(np.concatenate([i * len(place) + j, j * len(place) + i]))
    losses = []
    for _ in range(epochs):
        a, b = negatives(rng, len(place), taken, len(i))
        y = np.concatenate([np.ones(len(i)), np.zeros(len(a))])
        loss, grad = gradients(adam.weights, sx, sym, np.concatenate([i, a]), np.concatenate([j, b]), y)
        losses.append(loss)
        adam.step(grad)
    return Plain(adam.weights["w0"], adam.weights["w1"], list(columns), losses)


def with_loops(norm: DataFrame, feats: DataFrame) -> DataFrame:
    """The normalisation with nodes that have no edge, which keep themselves."""
    alone = feats.select(F.col("node_id").alias("i")).join(norm.select("i").distinct(), "i", "left_anti")
    return norm.unionByName(alone.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))


def _through(norm: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    got = norm.join(rows.withColumnRenamed("node_id", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])
    return got.withColumnRenamed("i", "node_id")


def _times(columns: list[str], w: np.ndarray, name: str, relu: bool) -> list:
    out = []
    for b in range(w.shape[1]):
        total = F.lit(0.0)
        for a, c in enumerate(columns):
            total = total + F.col(c) * float(w[a, b])
        out.append((scalars.relu(total) if relu else total).alias(f"{name}{b}"))
    return out


def embed(model: Plain, edges: DataFrame, feats: DataFrame) -> DataFrame:
    """node_id, z, zq, zk (all z) of every node: two joins with the normalisation and native products."""
    norm = with_loops(graph.degree_norm(graph.adjacency(edges)), feats)
    sx = _through(norm, feats.select("node_id", *model.columns), model.columns)
    h = sx.select("node_id", *_times(model.columns, model.w0, "h", True))
    m = h.select("node_id", *_times([f"h{k}" for k in range(model.w0.shape[1])], model.w1, "m", False))
    names = [f"m{k}" for k in range(model.w1.shape[1])]
    z = _through(norm, m, names).select("node_id", F.array(*names).alias("z"))
    return z.withColumns({"zq": F.col("z"), "zk": F.col("z")})


def reconstruction_scores(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """node_id, score: mean surprise over a node's undirected pairs, each once; 0 without any."""
    from . import model

    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return model.reconstruction_scores(pairs, emb)


def recovery(scores: DataFrame, rings: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of the whole, one row a ring): area, precision at the number of synthetic nodes, mean percentiles; no cores, no tiers.

    ``label``: the column that marks synthetic nodes; else their prefix does.
    """
    rows = scores.withColumn("label", F.col(label) if label else metrics.is_synthetic().cast("int"))
    at = metrics.precision_recall_at(rows, (0,)).select(F.col("k"), F.col("precision").alias("precision_at_k"))
    whole = metrics.roc_auc(rows).crossJoin(F.broadcast(at)).crossJoin(F.broadcast(metrics.percentile_by_class(rows)))  # one row each
    sizes = rows.agg(F.sum("label").cast("bigint").alias("n_synthetic"), F.sum(1 - F.col("label")).cast("bigint").alias("n_real"))
    ranks = metrics.rank_normalize(scores).select("node_id", "rank")
    each = metrics.members(rings).join(ranks, "node_id").groupBy("ring_id", "ring_type").agg(F.count("*").alias("n_nodes"), F.avg("rank").alias("mean_percentile"), F.max("rank").alias("max_percentile"))
    return whole.crossJoin(F.broadcast(sizes)), each
