"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (hashed; sublinear counts of unit length)
and one-hot bins of statistics of its structure (word length, symbols, capitals,
repetition, ...) and of its metadata: ``n_chars`` as the table states it, alone
and against the text's true length (a row may lack it; labels, lang, source and
doc_id are no metadata here).  The score adds a bias, linear weights and all
pairwise interactions of rank ``RANK``, the latter in linear time as
``(|sum v x|^2 - sum |v x|^2) / 2``.  Weights are learned on the driver from at
most SAMPLE labelled documents (those with the least hash of doc_id, a bounded
sample by parameter) and go to the executors as two small arrays; every document
is scored whole in one pass without a shuffle.

Defined cases.  A null text is empty; without words only the statistics count.
Labels that are null are not learned from; of several labels of a document the
largest counts.  A null doc_id is never labelled, and not held out.  Repeated
rows get equal scores.  Without any usable label every score is 0.5.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textkernel

SAMPLE = 6000
RANK = 8
BITS = 15
BINS = 16
THRESHOLD = 0.7
EPOCHS = 12

_CLASS = np.zeros((256, 5), dtype=np.int64)  # capitals, digits, symbols, other punctuation, line ends
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[ord(c) for c in "#*$%&|<>!@^~"], 2] = 1
_CLASS[[ord(c) for c in ".,;:?-_'\"()[]{}/"], 3] = 1
_CLASS[10, 4] = 1


def held_out(divisor: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor)) == rest, F.lit(False))


def features(texts: pa.Array, stated: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row of the chunk, then row bounds (rows + 1), feature indices and values; ``stated``: the lengths in the metadata."""
    said = np.nan_to_num(stated.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), nan=-1.0)
    for at, offs, raw in textkernel.chunks(texts, 1_000_000):
        w = textkernel.words(offs, raw)
        rows = w.rows
        n = np.bincount(w.row, minlength=rows).astype(float)
        size = np.maximum(np.diff(offs), 1).astype(float)
        totals = np.zeros((rows, 5))
        if len(raw):
            for k in range(5):
                c = np.concatenate([[0], np.cumsum(_CLASS[raw, k])])
                totals[:, k] = c[offs[1:]] - c[offs[:-1]]
        length = np.bincount(w.row, weights=(w.end - w.start), minlength=rows)
        h, r = textkernel.distinct(w.hash, w.row)
        kinds_of = np.bincount(r, minlength=rows)
        order = np.lexsort((w.hash, w.row))
        sh, sr = w.hash[order], w.row[order]
        cuts = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1]), [True]])) if len(sh) else np.zeros(1, dtype=int)
        tf = np.log1p(np.diff(cuts))
        norm = np.sqrt(np.bincount(r, weights=tf * tf, minlength=rows))
        tf = tf / np.maximum(norm[r], 1e-9)
        gram, gr = textkernel.shingles(w, 3)
        g2 = np.bincount(textkernel.distinct(gram, gr)[1], minlength=rows) / np.maximum(np.bincount(gr, minlength=rows), 1)
        many = np.maximum(n, 1)
        lines = totals[:, 4] + 1
        stats = np.stack([
            np.log1p(n) / 10, length / many / 16, kinds_of / many, g2, totals[:, 0] / size * 1.5, totals[:, 1] / size * 4, totals[:, 2] / size * 4,
            totals[:, 3] / size * 5, np.log1p(lines) / 7, n / lines / 120, np.log1p(size) / 13,
            *_stated(said[at : at + rows], size),
        ], axis=1)
        bins = np.clip((stats * BINS).astype(np.int64), 0, BINS - 1) + np.arange(stats.shape[1]) * BINS
        idx_w = (h >> np.uint64(64 - BITS)).astype(np.int64)
        row = np.concatenate([r, np.repeat(np.arange(rows), bins.shape[1])])
        idx = np.concatenate([idx_w, (1 << BITS) + bins.ravel()])
        val = np.concatenate([tf, np.full(bins.size, 0.5)])
        order = np.argsort(row, kind="stable")
        yield at, np.searchsorted(row[order], np.arange(rows + 1)), idx[order], val[order].astype(np.float32)


def _stated(said: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stated length, and the text's bytes for each stated character; the last bin where none is stated."""
    known = said >= 0
    return np.where(known, np.log1p(np.maximum(said, 0)) / 14, 1.0), np.where(known, np.minimum(size / np.maximum(said, 1) / 4, 0.9), 1.0)


SIZE = (1 << BITS) + 13 * BINS


def raw_scores(model: tuple, bound: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    w0, w, v = model
    vx = v[idx] * val[:, None]
    at = bound[:-1]
    s = np.add.reduceat(vx, at, axis=0)
    q = np.add.reduceat(vx * vx, at, axis=0)
    return w0 + np.add.reduceat(w[idx] * val, at) + 0.5 * (s * s - q).sum(axis=1)


def fit(bound: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-4) -> tuple:
    """Adagrad on the logistic loss; the same rows give the same model."""
    rng = np.random.default_rng(7)
    w0, w, v = 0.0, np.zeros(SIZE, dtype=np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    g0, gw, gv = 1e-3, np.full(SIZE, 1e-3, dtype=np.float32), np.full((SIZE, RANK), 1e-3, dtype=np.float32)
    n = len(y)
    if not n:
        return 0.0, w, v * 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 128)):
            lens = bound[rows + 1] - bound[rows]
            to = np.concatenate([[0], np.cumsum(lens)])
            take = np.repeat(bound[rows] - to[:-1], lens) + np.arange(to[-1])
            i, x = idx[take], val[take]
            vx = v[i] * x[:, None]
            s = np.add.reduceat(vx, to[:-1], axis=0)
            z = w0 + np.add.reduceat(w[i] * x, to[:-1]) + 0.5 * (s * s - np.add.reduceat(vx * vx, to[:-1], axis=0)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            ge = np.repeat(g, lens) * x
            dv = ge[:, None] * (np.repeat(s, lens, axis=0) - vx)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, weights=ge) + decay * w[u]
            dvs = np.stack([np.bincount(inv, weights=dv[:, k]) for k in range(RANK)], axis=1) + decay * v[u]
            g0 += g.sum() ** 2
            w0 -= rate * g.sum() / np.sqrt(g0)
            gw[u] += dw * dw
            w[u] -= rate * dw / np.sqrt(gw[u])
            gv[u] += dvs * dvs
            v[u] -= rate * dvs / np.sqrt(gv[u])
    return float(w0), w, v


@textkernel.releasing
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, bound, idx, val in features(batch.column(1), batch.column(2)):
            lists = lambda x: pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(x))  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bound) - 1), lists(idx.astype(np.int32)), lists(val)], names=["y", "idx", "val"]).append_column("o", batch.column(3).slice(at, len(bound) - 1))


def _with_length(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select("doc_id", "text", stated.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """The model, from at most ``sample`` labelled documents outside the held-out part."""
    common.ship(docs.sparkSession)
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2))
    chosen = chosen.groupBy(F.col("doc_id").alias("_d")).agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("_d"), "_d").limit(sample)
    rows = _with_length(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_d"))  # bounded by ``sample``
    rows = rows.select("y", "text", "n_chars", F.xxhash64("_d", F.col("text")).alias("o"), F.xxhash64("_d").alias("_p"))
    # of repeated rows one is enough, and of ids with many texts so many; hashes are sorted, texts stay where they are
    keys = rows.select("_p", "o").distinct().orderBy("_p", "o").limit(2 * sample).select(F.col("o").alias("_o")).distinct()
    rows = rows.join(F.broadcast(keys), F.col("o") == F.col("_o")).select("y", "text", "n_chars", "o")
    got = rows.mapInArrow(_rows, "y int, idx array<int>, val array<float>, o bigint").toArrow().sort_by("o")
    _, once = np.unique(got["o"].to_numpy(), return_index=True)
    got = got.take(once)
    if not got.num_rows:
        return fit(np.zeros(1, dtype=int), np.zeros(0, dtype=int), np.zeros(0), np.zeros(0))
    lens = pa.compute.list_value_length(got["idx"]).to_numpy()
    flat = lambda c: pa.compute.list_flatten(got[c]).to_numpy()
    return fit(np.concatenate([[0], np.cumsum(lens)]), flat("idx").astype(np.int64), flat("val"), got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (RANK + 1) floats

    @textkernel.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bound, idx, val in features(batch.column(1), batch.column(2)):
                z = raw_scores(shared.value, bound, idx, val).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(z)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    rows = _with_length(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "n_chars").mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels", "doc_id", "quality")))
