"""Isolation forest: random trees on small subsamples, scored by mean path length.

Trees are grown on the driver from a bounded sample; every row is scored in one
pass over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

TREES, SUBSAMPLE = 200, 256


class Forest(NamedTuple):
    """Per tree: feature (-1: leaf), threshold, left child (right is the next), and at leaves the path length."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    length: list[np.ndarray]
    size: int


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, height: int) -> tuple[np.ndarray, ...]:
    feature, threshold, left, length = [0], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= height or len(rows) <= 1 or not len(wide):
            feature[at], length[at] = -1, depth + mean_path(len(rows))
            continue
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        goes = x[rows, f] < cut
        if not goes.any():
            goes = x[rows, f] <= low[f]
        feature[at], threshold[at], left[at] = f, float(cut), len(feature)
        for side in (rows[goes], rows[~goes]):
            todo.append((len(feature), side, depth + 1))
            for column, empty in ((feature, 0), (threshold, 0.0), (left, 0), (length, 0.0)):
                column.append(empty)
    return np.array(feature), np.array(threshold), np.array(left), np.array(length)


def build(x: np.ndarray, seed: int = 0, trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    height = int(np.ceil(np.log2(max(size, 2))))
    grown = [grow(x[rng.choice(len(x), size, replace=False)], rng, height) for _ in range(trees)]
    return Forest(*map(list, zip(*grown, strict=True)), size)


def score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 is isolated."""
    total = np.zeros(len(x))
    for feature, threshold, left, length in zip(*forest[:4], strict=True):
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            a = at[inner]
            at[inner] = left[a] + (x[inner, f[inner]] >= threshold[a])
        total += length[at]
    return 2.0 ** (-total / len(forest.feature) / max(mean_path(forest.size), 1e-9))


def isolation_scores(vectors: DataFrame, column: str = "z", seed: int = 0, trees: int = TREES, subsample: int = SUBSAMPLE, key: str = "node_id") -> DataFrame:
    """``key``, score.  At most trees * subsample vectors (least hash first) reach the driver."""
    ship(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(key, F.transform(column, lambda v: v.cast("double")).alias("v"))
    some = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(trees * subsample).select("v").toArrow()["v"]
    if not len(some):
        return rows.select(key, F.lit(0.0).alias("score"))
    x = np.asarray(pa.chunked_array(some).combine_chunks().flatten()).reshape(len(some), -1)
    forest = build(x, seed, trees, subsample)
    width = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(forest, x))], names=[key, "score"])

    return rows.mapInArrow(run, f"{key} {kind}, score double")
