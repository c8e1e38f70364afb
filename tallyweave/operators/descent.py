"""Full-batch gradient descent of the graph auto-encoder without a driver-side graph.

The same function as the driver's trainer, for graphs beyond its bound: every
node and every edge takes part in every epoch.  What stays per node are rows;
sparse products and scattered gradients are joins and sums that pre-aggregate,
dense layers run over Arrow batches, and each weight's gradient is a sum of one
small matrix a batch.  Only the weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from . import graph
from .model import CHANNELS, Adam, Model, new_weights

INPUTS = (*CHANNELS, "self")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _spread(norm: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """node, v: the symmetric normalisation times ``rows`` (node, v)."""
    got = norm.join(rows.withColumnRenamed("node", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col("v")[k]).alias(f"v{k}") for k in range(dims)])
    return got.select(F.col("i").alias("node"), F.array(*[f"v{k}" for k in range(dims)]).alias("v"))


def _summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """name, g (flat matrices) summed by place: as many rows as there are weights."""
    rows = parts.select("name", F.posexplode("g").alias("at", "x")).groupBy("name", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["name"], []).append((r["at"], r["x"]))
    return {k: np.array([x for _, x in sorted(v)]) for k, v in out.items()}


def gradients(weights: dict[str, np.ndarray], inputs: DataFrame, norm: DataFrame, pairs: DataFrame, count: int) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over ``count`` pairs (i, j, y) and its gradient; inputs: node and an array for each of INPUTS; norm: i, j, w."""
    ship(inputs.sparkSession)
    hidden, dims = weights["w2"].shape

    def first(batch: pa.RecordBatch) -> np.ndarray:
        return sum(_matrix(batch, c) @ weights[c] for c in INPUTS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _vectors(np.maximum(first(b), 0) @ weights["w2"])], names=["node", "v"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zi, zj, y = _matrix(b, "zi"), _matrix(b, "zj"), _matrix_of(b, "y")
            zq, zk = zi @ weights["q"], zj @ weights["k"]
            p = 1 / (1 + np.exp(-np.clip((zq * zk).sum(axis=1), -30, 30)))
            d = ((p - y) / count)[:, None]
            loss = -(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).sum() / count
            ends = [(b.column(0), _vectors(d * zk @ weights["q"].T)), (b.column(1), _vectors(d * zq @ weights["k"].T))]
            for node, v in ends:
                yield _part(node, v, None, None)
            for name, g in (("q", zi.T @ (d * zk)), ("k", zj.T @ (d * zq)), ("loss", np.array([loss]))):
                yield _part(None, None, name, g)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pre, dh = first(b), _matrix(b, "v")
            dpre = dh @ weights["w2"].T * (pre > 0)
            for name, g in (("w2", np.maximum(pre, 0).T @ dh), *((c, _matrix(b, c).T @ dpre) for c in INPUTS)):
                yield _part(None, None, name, g)

    vector = "node string, v array<double>"
    z = materialize(_spread(norm, inputs.mapInArrow(encode, vector), dims), "encoded")
    end = lambda c: z.select(F.col("node").alias(c), F.col("v").alias(f"z{c}"))
    rows = pairs.join(end("i"), "i").join(end("j"), "j").select("i", "j", F.col("y").cast("double").alias("y"), "zi", "zj")
    parts = materialize(rows.mapInArrow(decode, _PART_SQL), "decoded")
    dz = parts.filter("node is not null").groupBy("node").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(dims)])
    dh = _spread(norm, dz.select("node", F.array(*[f"v{k}" for k in range(dims)]).alias("v")), dims)  # the normalisation is symmetric
    out = _summed(parts.filter("name is not null").select("name", "g")) | _summed(inputs.join(dh, "node").mapInArrow(back, _PART_SQL).select("name", "g"))
    loss = float(out.pop("loss", np.zeros(1))[0])
    return loss, {k: out[k].reshape(w.shape) if k in out else np.zeros_like(w) for k, w in weights.items()}


_PART_SQL = "node string, v array<double>, name string, g array<double>"
_PART = pa.schema([("node", pa.string()), ("v", pa.list_(pa.float64())), ("name", pa.string()), ("g", pa.list_(pa.float64()))])


def _part(node: pa.Array | None, v: pa.Array | None, name: str | None, g: np.ndarray | None) -> pa.RecordBatch:
    n = 1 if node is None else len(node)
    none = lambda k: pa.nulls(n, _PART.field(k).type)
    return pa.RecordBatch.from_arrays([
        none(0) if node is None else node, none(1) if v is None else v, none(2) if name is None else pa.array([name]), none(3) if g is None else pa.array([g.ravel().tolist()], _PART.field(3).type),
    ], schema=_PART)


def _matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


#: Numbers of a node state (nodes times the embedding's width) up to which a task holds it and pairs are packed; beyond, states are joined.
MOST_CELLS = 32_000_000


def node_inputs(edges: DataFrame, feats: DataFrame, columns: list[str]) -> DataFrame:
    """node, and an array for each of INPUTS."""
    through = graph.propagate(graph.directed_channels(edges), feats, columns)
    wide = through.groupBy("i").pivot("channel", list(CHANNELS)).agg(F.first(F.array(*[F.col(c).cast("double") for c in columns])))
    rows = feats.select(F.col("node_id").alias("node"), F.array(*[F.col(c).cast("double") for c in columns]).alias("self")).join(wide.withColumnRenamed("i", "node"), "node", "left")
    zero = F.array(*[F.lit(0.0) for _ in columns])
    return rows.select("node", *[F.coalesce(F.col(c), zero).alias(c) for c in INPUTS])


def prepared(edges: DataFrame, feats: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs, norm) of a graph, written once."""
    inputs = materialize(node_inputs(edges, feats, columns), "inputs")
    norm = graph.degree_norm(graph.adjacency(edges))
    alone = feats.select("node_id").join(norm.select(F.col("i").alias("node_id")), "node_id", "left_anti").select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("w"))
    return inputs, materialize(norm.unionByName(alone), "norm")


def fit(edges: DataFrame, feats: DataFrame, columns: list[str], epochs: int = 200, rate: float = 0.02, hidden: int = 64, embed: int = 32, seed: int = 0, most_cells: int = MOST_CELLS) -> Model:
    """Adam over all edges; each epoch draws as many negative pairs as there are positive ones."""
    if feats.count() * max(embed, len(columns) + 1) <= most_cells:
        from . import packed

        return packed.fit(edges, feats, columns, epochs, rate, hidden, embed, seed)
    inputs, norm = prepared(edges, feats, columns)
    positive = materialize(graph.positive_pairs(edges).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("y")), "positive")
    count = positive.count()
    nodes = feats.select("node_id", F.xxhash64("node_id").alias("node_seq"))
    adam, losses = Adam(new_weights(len(columns), hidden, embed, seed), rate), []
    for step in range(epochs):
        pairs = positive.unionByName(graph.negative_pairs(edges, nodes, seed=seed * 100_003 + step).withColumn("y", F.lit(0)))
        pairs = materialize(pairs, "training-pairs")
        loss, grad = gradients(adam.weights, inputs, norm, pairs, max(pairs.count(), 1))
        losses.append(loss)
        adam.step(grad)
    return Model({k: x.astype(np.float32) for k, x in adam.weights.items()}, columns, losses)
