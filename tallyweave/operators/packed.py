"""The descent of :mod:`.descent` over packed pairs, for graphs whose node states fit a task but whose edges do not.

Nodes are numbered; the directed pairs lie in buckets by (i + j) modulo their
number, so a pair and its reverse share a bucket, hubs spread over all of them,
and a bucket can draw and check its own negative pairs.  A bucket is one row of
the shared folder, with the sums that channels need.  Whatever is summed by node
(channels, features, an epoch's gradient, surprise) is a pass that sends a state
of nodes to the tasks and adds up what they return; an epoch writes nothing but
the exchange of those sums, which is deleted after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import scalars
from ..session import materialize, ship, sweep
from . import graph
from .model import CHANNELS, Adam, Model, new_weights

INPUTS = (*CHANNELS, "self")
#: Pairs in a bucket, about; numbers in one row of an exchange; pairs decoded at once; edges numbered at once.
PAIRS, CELLS, CHUNK, FLUSH = 500_000, 262_144, 250_000, 1_000_000


class Packed(NamedTuple):
    buckets: DataFrame  # b, code (sorted i * n + j), and as bytes once (for each, whether it stands for its unordered pair), log_amount, count
    index: DataFrame
    n: int
    n_buckets: int
    count: int


def isin(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), dtype=bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([a, b]))
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of FLUSH rows, about."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FLUSH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _ends(t: pa.Table, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of src and dst among ``names``; -1 where there is none."""
    return tuple(pc.fill_null(pc.index_in(t[c].cast(names.type), value_set=names), -1).to_numpy().astype(np.int64) for c in ("src", "dst"))


def _index(nodes: DataFrame) -> DataFrame:
    return materialize(graph.node_index(nodes.select("node_id", F.xxhash64("node_id").alias("node_seq"))), "index")


def _names(index: DataFrame) -> pa.Array:
    return pa.chunked_array(index.orderBy("idx").select("node_id").toArrow()["node_id"]).combine_chunks()


def _rows(names: tuple[str, ...], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pack(edges: DataFrame, feats: DataFrame, pairs_each: int = PAIRS) -> Packed:
    spark = edges.sparkSession
    ship(spark)
    index = _index(feats)
    names = _names(index)
    n, b = len(names), max(1, -(-edges.count() // pairs_each))
    sent = spark.sparkContext.broadcast(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _flushed(batches):
            i, j = _ends(t, sent.value)
            amount = t["amount"].to_numpy()
            known = (i >= 0) & (j >= 0)
            i, j, amount = i[known], j[known], np.asarray(amount[known], dtype=np.float64)
            log = np.log1p(amount, where=amount > -1, out=np.zeros(len(amount)))  # none adds nothing
            order = np.argsort(i * n + j)
            at = (i + j)[order] % b
            turn = np.argsort(at.astype(np.uint16) if b < 65_536 else at, kind="stable")
            order, at = order[turn], at[turn]
            code, log = (i * n + j)[order], log[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
            for lo, hi in zip(first, [*first[1:], len(at)], strict=True):
                yield _rows(("b", "code", "log"), [int(at[lo])], pa.array([_bytes(code[lo:hi])], pa.binary()), pa.array([_bytes(log[lo:hi])], pa.binary()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                held.setdefault(batch["b"][k].as_py(), []).append((batch["code"][k].as_py(), batch["log"][k].as_py()))
        while held:
            bucket, parts = held.popitem()
            code, log = np.concatenate([np.frombuffer(c, dtype=np.int64) for c, _ in parts]), np.concatenate([np.frombuffer(x) for _, x in parts])
            order = np.argsort(code, kind="stable")
            code, log = code[order], log[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            sums, count = np.add.reduceat(log, first), np.diff(np.concatenate([first, [len(code)]]))
            code = code[first]
            i, j = code // n, code % n
            once = (i != j) & ((i < j) | ~isin(code, j * n + i))
            yield _rows(("b", "code", "once", "log_amount", "count"), [bucket], pa.array([code], pa.list_(pa.int64())), *[pa.array([_bytes(x)], pa.binary()) for x in (once, sums, count.astype(np.int64))])

    parts = edges.select("src", "dst", F.col("amount").cast("double").alias("amount")).mapInArrow(cut, "b bigint, code binary, log binary")
    buckets = materialize(parts.repartitionById(b, F.col("b").cast("int")).mapInArrow(meet, "b bigint, code array<bigint>, once binary, log_amount binary, count binary"), "pair-sums")
    sent.destroy()
    return Packed(buckets, index, n, b, buckets.agg(F.coalesce(F.sum(F.size("code")), F.lit(0))).first()[0])


def known(edges: DataFrame, feats: DataFrame) -> Packed | None:
    """What :func:`of` has packed of ``edges`` already, over the nodes of ``feats``."""
    made, nodes, packed = edges.__dict__.get("_tallyweave_packed", (None, None, None))
    return packed if made == session._cleaned and nodes is getattr(feats, "_tallyweave_nodes", feats) else None


def forget(edges: DataFrame) -> None:
    """Delete what was packed of ``edges``; whoever asks for it again packs it again."""
    packed, inputs = edges.__dict__.pop("_tallyweave_packed", None), edges.__dict__.pop("_tallyweave_inputs", None)
    for made, table in ((packed and packed[0], packed and packed[2].buckets), (inputs and inputs[0], inputs and inputs[3][0])):
        if made == session._cleaned:
            session.drop(table)


def of(edges: DataFrame, feats: DataFrame) -> Packed:
    """``edges`` packed once over the nodes of ``feats`` (or of the nodes that these are features of)."""
    found = known(edges, feats)
    if found is None:
        nodes = getattr(feats, "_tallyweave_nodes", feats)
        found = pack(edges, nodes)
        edges.__dict__["_tallyweave_packed"] = session._cleaned, nodes, found
    return found


#: What a bucket keeps beside its codes, as bytes, which pass to the tasks without a step for each number.
_KEPT = {"once": np.bool_, "log_amount": np.float64, "count": np.int64}


def _buckets(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        yield batch["b"][k].as_py(), batch["code"][k].values.to_numpy(), *[np.frombuffer(batch[c][k].as_py(), dtype=_KEPT[c]) for c in more]


def native(x: np.ndarray) -> np.ndarray:
    """``x`` under numpy's own type object: an array that was pickled has another, for which ``np.add.at`` takes sixteen times as long."""
    return x.view(np.dtype(x.dtype.name))


def _add(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
    acc += x
    return acc


def blocks(at: DataFrame, state: dict, n: int, width: int, visit: Callable, finish: Callable | None = None, empty: float = 0.0, merge: Callable = _add) -> tuple[DataFrame, object]:
    """(block, name, x), and what was sent: the ``acc`` (width by n numbers) that ``visit(batch, state, acc)`` fills, merged by block of nodes, and each (name, matrix) that it yields, by task.

    ``finish(acc, state)`` may turn a task's ``acc`` and return more matrices.
    """
    spark = at.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(state)
    out_width = state.get("out_width", width)
    step = max(1, CELLS // max(out_width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, small, own = None, {}, {c: native(x) if isinstance(x, np.ndarray) else x for c, x in sent.value.items()}
        for batch in batches:
            if acc is None:
                acc = np.zeros((width, n)) if empty == 0 else np.full((width, n), empty)
            for name, x in visit(batch, own, acc):
                small[name] = small.get(name, 0) + x
        if acc is not None and finish:
            acc, more = finish(acc, own)
            small |= more
        for name, x in small.items():
            yield _row(-1, name, np.asarray(x, dtype=np.float64))
        for at_node in range(0, n if acc is not None and width else 0, step):
            yield _row(at_node // step, "", acc[:, at_node : at_node + step])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                key, x = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), np.frombuffer(batch.column(2)[k].as_py())
                if key[0] < 0:
                    total[key] = total.get(key, 0) + x
                else:
                    x = x.reshape(out_width, -1)
                    total[key] = merge(total[key], x) if key in total else x.copy()
        for (block, name), x in total.items():
            yield _row(block, name, x)

    parts = at.mapInArrow(run, _ROW)
    if width:
        k = max(1, min(-(-n // step), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        parts = parts.repartitionById(k, F.pmod("block", F.lit(k)).cast("int")).mapInArrow(add, _ROW)
    return parts, sent


def summed(at: DataFrame, state: dict, n: int, width: int, visit: Callable, finish: Callable | None = None, empty: float = 0.0, merge: Callable = _add) -> tuple[np.ndarray, dict]:
    """:func:`blocks` on the driver: an array of width by n, and matrices by name."""
    parts, sent = blocks(at, state, n, width, visit, finish, empty, merge)
    out_width = state.get("out_width", width)
    step = max(1, CELLS // max(out_width, 1))
    got = parts.toArrow()
    out, named = np.full((out_width, n), empty), {}
    for k in range(got.num_rows):
        block, name, x = got["block"][k].as_py(), got["name"][k].as_py(), np.frombuffer(got["x"][k].as_py())
        if block < 0:
            named[name] = named.get(name, 0) + x
        else:
            out[:, block * step : (block + 1) * step] = x.reshape(out_width, -1)
    del got, parts
    sent.destroy()
    if n * width > CELLS:
        sweep(at.sparkSession)
    return out, named


_ROW = "block bigint, name string, x binary"


def _row(block: int, name: str, x: np.ndarray) -> pa.RecordBatch:
    return _rows(("block", "name", "x"), [block], [name], pa.array([_bytes(x)], pa.binary()))


def spread(p: Packed, root: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """The symmetric normalisation times ``x``; ``root``: inverse roots of degrees, or none for the bare pattern with its loops."""
    n, scaled = p.n, np.ascontiguousarray((x if root is None else x * root[:, None]).T)

    def visit(batch: pa.RecordBatch, state: dict, acc: np.ndarray) -> Iterator[tuple]:
        for _, code, once in _buckets(batch, "once"):
            i, j = code[once] // n, code[once] % n
            for into, v in zip(acc, state["x"], strict=True):
                np.add.at(into, i, v[j])
                np.add.at(into, j, v[i])
        return iter(())

    out = (summed(p.buckets.select("b", "code", "once"), {"x": scaled}, n, x.shape[1], visit)[0] + scaled).T
    return out if root is None else out * root[:, None]


def negatives(rng: np.random.Generator, p_n: int, n_buckets: int, b: int, taken: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` ordered pairs of different nodes out of bucket ``b`` that are not ``taken`` (sorted codes); none where no pair is free."""
    n = p_n
    if n * -(-n // n_buckets) <= 8 * max(count, len(taken)):  # dense: draw from the list of what is free
        i, k = np.divmod(np.arange(n * -(-n // n_buckets)), -(-n // n_buckets))
        j = (b - i) % n_buckets + n_buckets * k
        code = np.setdiff1d((i * n + j)[(j < n) & (i != j)], taken)
        code = rng.choice(code, count) if len(code) else code
        return code // n, code % n
    found = np.zeros(0, dtype=np.int64)
    while len(found) < count:  # only as many as are missing, so sorting (which makes the search fast) favours none
        a = rng.integers(0, n, count - len(found))
        c = (b - a) % n_buckets + n_buckets * rng.integers(0, -(-n // n_buckets), len(a))
        code = np.sort((a * n + c)[(c < n) & (a != c)])
        found = np.concatenate([found, code[~isin(taken, code)]])
    return found // n, found % n


def _heads(state: dict, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z Wq and z Wk of every node, made once a task."""
    if "zq" not in state:
        state["zq"], state["zk"] = native(q.T @ state["z"]), native(k.T @ state["z"])
    return state["zq"], state["zk"]


def _chance(zq: np.ndarray, zk: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    s = np.zeros(len(i))
    for a, b in zip(zq, zk, strict=True):
        s += a[i] * b[j]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def decoded(p: Packed, weights: dict[str, np.ndarray], z: np.ndarray, seed: int, step: int) -> tuple[np.ndarray, dict]:
    """Sums over all pairs and as many drawn negative ones: the gradient for z, and loss, q, k, count."""
    n, n_buckets, dims = p.n, p.n_buckets, z.shape[1]
    q, k = (weights[c].astype(np.float64) for c in ("q", "k"))

    def visit(batch: pa.RecordBatch, state: dict, acc: np.ndarray) -> Iterator[tuple]:
        zq, zk = _heads(state, q, k)
        for b, code in _buckets(batch):
            pi, pj = code // n, code % n
            drawn = negatives(np.random.default_rng((seed, step, b)), n, n_buckets, b, union(code, pj * n + pi), len(code))
            for y, (i, j) in ((1, (pi, pj)), (0, drawn)):
                for at in range(0, len(i), CHUNK):
                    ci, cj = i[at : at + CHUNK], j[at : at + CHUNK]
                    chance = _chance(zq, zk, ci, cj)
                    d = chance - y
                    for c in range(dims):
                        np.add.at(acc[c], ci, d * zk[c][cj])
                        np.add.at(acc[dims + c], cj, d * zq[c][ci])
                    yield "loss", np.array([-np.log((chance if y else 1 - chance) + 1e-7).sum()])
                yield "count", np.array([float(len(i))])

    def finish(acc: np.ndarray, state: dict) -> tuple[np.ndarray, dict]:
        dzq, dzk = acc[:dims], acc[dims:]
        return q @ dzq + k @ dzk, {"q": (state["z"] @ dzq.T).ravel(), "k": (state["z"] @ dzk.T).ravel()}

    dz, found = summed(p.buckets.select("b", "code"), {"z": np.ascontiguousarray(z.T), "out_width": dims}, n, 2 * dims, visit, finish)
    return dz.T, found


def _given(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """idx and a matrix for each of INPUTS: of rows with arrays, or of blocks of nodes (:func:`channel_inputs`)."""
    if "at" in batch.schema.names:
        for k in range(batch.num_rows):
            idx = np.arange(batch["at"][k].as_py(), batch["at"][k].as_py() + batch["size"][k].as_py())
            yield idx, {c: np.frombuffer(batch[c][k].as_py()).reshape(-1, len(idx)).T for c in INPUTS}
    else:
        yield batch["idx"].to_numpy(), {c: np.asarray(batch.column(c).flatten(), dtype=np.float64).reshape(batch.num_rows, -1) for c in INPUTS}


def _first(x: dict, weights: dict) -> np.ndarray:
    return sum(x[c] @ weights[c] for c in INPUTS)


def encoded(inputs: DataFrame, weights: dict, n: int) -> np.ndarray:
    """relu(sum of the inputs' products) W2 of every node."""
    ship(inputs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, x in _given(batch):
                h = np.maximum(_first(x, weights), 0) @ weights["w2"]
                yield _rows(("at", "x"), pa.array([_bytes(idx)], pa.binary()), pa.array([_bytes(h)], pa.binary()))

    got, out = inputs.mapInArrow(run, "at binary, x binary").toArrow(), np.zeros((n, weights["w2"].shape[1]))
    for k in range(got.num_rows):
        out[np.frombuffer(got["at"][k].as_py(), dtype=np.int64)] = np.frombuffer(got["x"][k].as_py()).reshape(-1, out.shape[1])
    return out


def backward(inputs: DataFrame, weights: dict, dh: np.ndarray) -> dict:
    def visit(batch: pa.RecordBatch, state: dict, acc: np.ndarray) -> Iterator[tuple]:
        for idx, x in _given(batch):
            pre, back = _first(x, weights), state["dh"][idx]
            dpre = back @ weights["w2"].T * (pre > 0)
            yield "w2", (np.maximum(pre, 0).T @ back).ravel()
            for c in INPUTS:
                yield c, (x[c].T @ dpre).ravel()

    return summed(inputs, {"dh": dh}, len(dh), 0, visit)[1]


def gradients(p: Packed, inputs: DataFrame, root: np.ndarray, weights: dict, seed: int, step: int) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all pairs and the step's negatives, and its gradient; inputs: as :func:`_given` reads them."""
    weights = {k: w.astype(np.float64) for k, w in weights.items()}
    dz, found = decoded(p, weights, spread(p, root, encoded(inputs, weights, p.n)), seed, step)
    count = max(found.get("count", np.zeros(1))[0], 1.0)
    out = backward(inputs, weights, spread(p, root, dz / count)) | {c: found[c] / count for c in ("q", "k") if c in found}
    return float(found.get("loss", np.zeros(1))[0] / count), {k: out[k].reshape(w.shape) if k in out else np.zeros_like(w) for k, w in weights.items()}


def degree_roots(p: Packed) -> np.ndarray:
    return 1 / np.sqrt(spread(p, None, np.ones((p.n, 1)))[:, 0])


def by_node(p: Packed, rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Columns by node: the numbers of ``rows`` (node_id, columns) at their places; 0 where there is no row."""
    got = rows.join(p.index, "node_id").select("idx", *[F.col(c).cast("double").alias(c) for c in columns]).toArrow()
    out = np.zeros((len(columns), p.n))
    for k, c in enumerate(columns):
        out[k, got["idx"].to_numpy()] = got[c].to_numpy()
    return out


def channel_inputs(p: Packed, feats: DataFrame, columns: list[str]) -> DataFrame:
    """at, size (of a block of nodes), and for each of INPUTS the block's numbers: a pass over the pairs for each channel."""
    n, width, x = p.n, len(columns) + 1, by_node(p, feats, columns)
    step, written = max(1, CELLS // width), []
    for channel in CHANNELS:
        out, sums = channel.endswith("out"), channel.startswith("amount")

        def visit(batch: pa.RecordBatch, state: dict, acc: np.ndarray) -> Iterator[tuple]:
            for _, code, log, count in _buckets(batch, "log_amount", "count"):
                i, j = code // n, code % n
                to, of = (i, j) if out else (j, i)  # noqa: B023
                w = log if sums else count.astype(np.float64)  # noqa: B023
                for into, v in zip(acc, state["x"], strict=False):
                    np.add.at(into, to, w * v[of])
                np.add.at(acc[-1], to, w)
            return iter(())

        parts, sent = blocks(p.buckets.select("b", "code", "log_amount", "count"), {"x": x}, n, width, visit)
        written.append(materialize(parts.select("block", F.lit(channel).alias("name"), "x"), "channel"))
        sent.destroy()
    own = feats.sparkSession.sparkContext.broadcast(x)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                held.setdefault(batch["block"][k].as_py(), {})[batch["name"][k].as_py()] = batch["x"][k].as_py()
        while held:
            block, got = held.popitem()
            at, to = block * step, min(n, (block + 1) * step)
            made = []
            for c in CHANNELS:
                v = np.frombuffer(got[c]).reshape(width, -1) if c in got else np.zeros((width, to - at))
                made.append(np.divide(v[:-1], v[-1], out=np.zeros((width - 1, to - at)), where=v[-1] != 0))
            yield _rows(("at", "size", *INPUTS), [at], [to - at], *[pa.array([_bytes(v)], pa.binary()) for v in (*made, own.value[:, at:to])])

    spark = feats.sparkSession
    every = spark.range(0, max(1, -(-n // step))).select(F.col("id").alias("block"), F.lit("").alias("name"), F.lit(b"").alias("x"))
    for w in written:
        every = every.unionByName(w)
    k = max(1, min(-(-n // step), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    inputs = materialize(every.repartitionById(k, F.pmod("block", F.lit(k)).cast("int")).mapInArrow(put, "at bigint, size bigint, " + ", ".join(f"{c} binary" for c in INPUTS)), "packed-inputs")
    own.destroy()
    for w in written:
        session.drop(w)
    return inputs


def inputs_of(p: Packed, edges: DataFrame, feats: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """:func:`channel_inputs` and the inverse roots of degrees, once for these ``edges`` and ``feats``."""
    made, of_feats, names, found = edges.__dict__.get("_tallyweave_inputs", (None, None, None, None))
    if made != session._cleaned or of_feats is not feats or names != columns:
        found = channel_inputs(p, feats, columns), degree_roots(p)
        edges.__dict__["_tallyweave_inputs"] = session._cleaned, feats, columns, found
    return found


def fit(edges: DataFrame, feats: DataFrame, columns: list[str], epochs: int, rate: float, hidden: int, embed: int, seed: int) -> Model:
    """Adam over all edges."""
    p = of(edges, feats)
    inputs, root = inputs_of(p, edges, feats, columns)
    adam, losses = Adam(new_weights(len(columns), hidden, embed, seed), rate), []
    for step in range(epochs):
        loss, grad = gradients(p, inputs, root, adam.weights, seed, step)
        losses.append(loss)
        adam.step(grad)
    return Model({k: x.astype(np.float32) for k, x in adam.weights.items()}, columns, losses)


def attached(p: Packed, state: dict, make: Callable, schema: str) -> DataFrame:
    """The rows that ``make(node_id, idx, state)`` (columns) gives for the nodes."""
    spark = p.index.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(tuple(c.split()[0] for c in schema.split(", ")), *make(batch["node_id"], batch["idx"].to_numpy(), sent.value))

    return p.index.select("node_id", "idx").mapInArrow(run, schema)


def embedded(model: Model, edges: DataFrame, feats: DataFrame) -> DataFrame:
    """What ``model.embed`` gives."""
    p = of(edges, feats)
    inputs, root = inputs_of(p, edges, feats, model.columns)
    weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    z = spread(p, root, encoded(inputs, weights, p.n))

    def vectors(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

    def make(node_id: pa.Array, idx: np.ndarray, state: dict) -> tuple:
        own = state["z"][idx]
        return node_id, vectors(own), vectors(own @ weights["q"]), vectors(own @ weights["k"])

    return attached(p, {"z": z}, make, "node_id string, z array<double>, zq array<double>, zk array<double>")


def surprise(p: Packed, emb: DataFrame) -> DataFrame:
    """What ``model.reconstruction_scores`` gives."""
    n, dims = p.n, len(emb.select("zq").first()[0])
    state = {c: by_node(p, emb.select("node_id", *[F.get(c, k).alias(f"v{k}") for k in range(dims)]), [f"v{k}" for k in range(dims)]) for c in ("zq", "zk")}

    def visit(batch: pa.RecordBatch, state: dict, acc: np.ndarray) -> Iterator[tuple]:
        for _, code, count in _buckets(batch, "count"):
            i, j = code // n, code % n
            many = count.astype(np.float64)
            s = (1 - _chance(state["zq"], state["zk"], i, j)) * many
            for to in (i, j):
                np.add.at(acc[0], to, s)
                np.add.at(acc[1], to, many)
        return iter(())

    s, many = summed(p.buckets.select("b", "code", "count"), state, n, 2, visit)[0]
    score = np.divide(s, many, out=np.zeros(n), where=many > 0)
    rows = attached(p, {"score": score}, lambda node_id, idx, state: (node_id, pa.array(state["score"][idx])), "node_id string, score double")
    return rows.join(emb.select("node_id"), "node_id", "left_semi")


#: Sums by node that features need, in the order of :func:`edge_sums`; the last three are maxima.
_SUMS = ("out_degree", "in_degree", "_out", "_in", "_n", "_sum", "_m2", "reversal_count", "_dated", "_weekend", "max_amount", "_last", "_first")


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums by node of two sets of edges; squared deviations from the mean join as in Chan's method, so equal amounts deviate by nothing."""
    n, m, both = a[4], b[4], (a[4] > 0) & (b[4] > 0)
    gap = np.divide(b[5], m, out=np.zeros_like(m), where=both) - np.divide(a[5], n, out=np.zeros_like(n), where=both)
    m2 = a[6] + b[6] + gap * gap * np.divide(n * m, n + m, out=np.zeros_like(n), where=both)
    top = np.maximum(a[10:], b[10:])
    a[:10] += b[:10]
    a[6], a[10:] = m2, top
    return a


def _empty(n: int) -> np.ndarray:
    acc = np.zeros((len(_SUMS), n))
    acc[10:] = -np.inf
    return acc


def edge_sums(p: Packed, edges: DataFrame) -> np.ndarray:
    """_SUMS by node over both ends of every edge, exact where they are counts or money (in units of 0.0001)."""
    n = p.n
    micros = F.unix_micros(F.col("parsed_date").cast("timestamp"))
    rows = edges.select(
        "src", "dst", F.col("amount").cast("double").alias("amount"), (F.col("amount").cast("decimal(18,4)") * 10_000).cast("bigint").alias("money"),
        F.coalesce(F.col("is_reversal"), F.lit(False)).alias("reversal"), micros.alias("us"), F.coalesce(scalars.is_weekend(F.col("parsed_date")), F.lit(False)).alias("weekend"),
    )

    def visit(batches: Iterator[pa.RecordBatch], names: pa.Array) -> np.ndarray | None:
        total = None
        for t in _flushed(batches):
            ends, acc = _ends(t, names), _empty(n)
            amount, us = (np.asarray(t[c].to_numpy(), dtype=np.float64) for c in ("amount", "us"))
            money = np.nan_to_num(np.asarray(t["money"].to_numpy(), dtype=np.float64))
            said, dated = ~np.isnan(amount), ~np.isnan(us)
            flag = lambda c: t[c].to_numpy().astype(np.float64)  # noqa: B023,E731
            reversal, weekend, here = flag("reversal"), flag("weekend"), []
            for side, at in enumerate(ends):
                k = at >= 0
                here.append((at[k & said], amount[k & said]))
                for row, x in ((side, np.ones(k.sum())), (2 + side, money[k]), (4, said[k].astype(np.float64)), (5, np.where(said, amount, 0)[k]), (7, reversal[k]), (8, dated[k].astype(np.float64)), (9, weekend[k])):
                    np.add.at(acc[row], at[k], x)
                np.maximum.at(acc[10], at[k & said], amount[k & said])
                np.maximum.at(acc[11], at[k & dated], us[k & dated])
                np.maximum.at(acc[12], at[k & dated], -us[k & dated])
            mean = np.divide(acc[5], acc[4], out=np.zeros(n), where=acc[4] > 0)
            for at, x in here:
                np.add.at(acc[6], at, (x - mean[at]) ** 2)
            total = acc if total is None else _merged(total, acc)
        return total

    return _by_edges(p, rows, len(_SUMS), visit, _merged, _empty)


def _by_edges(p: Packed, rows: DataFrame, width: int, visit: Callable, merge: Callable, empty: Callable) -> np.ndarray:
    spark = rows.sparkSession
    names = spark.sparkContext.broadcast(_names(p.index))
    n, step = p.n, max(1, CELLS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = visit(batches, names.value)
        for at in range(0, n if total is not None else 0, step):
            yield _row(at // step, "", total[:, at : at + step])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                b, x = batch["block"][k].as_py(), np.frombuffer(batch["x"][k].as_py()).reshape(width, -1).copy()
                total[b] = merge(total[b], x) if b in total else x
        for b, x in total.items():
            yield _row(b, "", x)

    k = max(1, min(-(-n // step), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = rows.mapInArrow(run, _ROW).repartitionById(k, F.pmod("block", F.lit(k)).cast("int")).mapInArrow(join, _ROW).toArrow()
    out = empty(n)
    for k in range(got.num_rows):
        b = got["block"][k].as_py()
        out[:, b * step : (b + 1) * step] = np.frombuffer(got["x"][k].as_py()).reshape(width, -1)
    names.destroy()
    sweep(spark)
    return out


def distinct_counts(p: Packed, rows: DataFrame, kinds: tuple[str, ...], visit: Callable, state: object) -> dict[str, np.ndarray]:
    """For each kind, the number of distinct values of every node; ``visit(batches, state)`` yields (kind, node, value), values from 0 to 2^32 - 1.

    A task sends each of its own (node, value) once, so a hub sends no more than its distinct values.
    """
    spark = rows.sparkSession
    ship(spark)
    sent, n = spark.sparkContext.broadcast(state), p.n
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = -(-n // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, node, value in visit(batches, sent.value):
            code = np.sort((node.astype(np.uint64) << np.uint64(32)) | value.astype(np.uint64))
            code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
            cuts = np.searchsorted(code, np.arange(parts + 1, dtype=np.uint64) * np.uint64(step) << np.uint64(32))
            for b in range(parts):
                if cuts[b] < cuts[b + 1]:
                    yield _row(b, kind, code[cuts[b] : cuts[b + 1]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                held.setdefault((batch["block"][k].as_py(), batch["name"][k].as_py()), []).append(np.frombuffer(batch["x"][k].as_py(), dtype=np.uint64))
        while held:
            (b, kind), codes = held.popitem()
            code = np.sort(np.concatenate(codes))
            code = code[np.concatenate([[True], code[1:] != code[:-1]])]
            node = (code >> np.uint64(32)).astype(np.int64) - b * step
            yield _row(b, kind, np.bincount(node, minlength=min(step, n - b * step)).astype(np.float64))

    got = rows.mapInArrow(run, _ROW).repartitionById(parts, F.col("block").cast("int")).mapInArrow(count, _ROW).toArrow()
    out = {k: np.zeros(n) for k in kinds}
    for k in range(got.num_rows):
        b = got["block"][k].as_py()
        out[got["name"][k].as_py()][b * step : (b + 1) * step] = np.frombuffer(got["x"][k].as_py())
    sent.destroy()
    sweep(spark)
    return out


def node_sums(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What ``features.node_features`` sums by node, for graphs over the driver's bound."""
    p = of(edges, nodes)
    n, spark = p.n, edges.sparkSession
    sums = dict(zip(_SUMS, edge_sums(p, edges), strict=True))
    values = lambda df, c: pa.chunked_array(df.select(F.col(c).cast("string").alias(c)).filter(F.col(c).isNotNull()).distinct().toArrow()[c]).combine_chunks()
    methods, banks = values(edges, "payment_method"), values(nodes.select(F.nullif(F.col("bank"), F.lit("")).alias("bank")), "bank")

    def dated(batches: Iterator[pa.RecordBatch], state: tuple) -> Iterator[tuple]:
        for t in _flushed(batches):
            day, method = (pc.fill_null(x, -1).to_numpy().astype(np.int64) for x in (t["day"], pc.index_in(t["method"].cast(state[1].type), value_set=state[1])))
            for at in _ends(t, state[0]):
                for kind, x in (("active_days", day), ("unique_payment_methods", method)):
                    ok = (at >= 0) & (x >= 0)
                    yield kind, at[ok], x[ok]

    rows = edges.select("src", "dst", (F.unix_date(F.to_date("parsed_date")) + F.lit(2**31 - 1).cast("bigint")).alias("day"), F.col("payment_method").cast("string").alias("method"))
    distinct = distinct_counts(p, rows, ("active_days", "unique_payment_methods"), dated, (_names(p.index), methods))

    bank_of = nodes.select("node_id", F.nullif(F.col("bank"), F.lit("")).alias("bank")).filter("bank is not null").join(p.index, "node_id").select("idx", "bank").toArrow()
    bank = np.full(n, -1, dtype=np.int64)
    bank[bank_of["idx"].to_numpy()] = pc.index_in(bank_of["bank"].cast(banks.type), value_set=banks).to_numpy()

    def met(batches: Iterator[pa.RecordBatch], bank: np.ndarray) -> Iterator[tuple]:
        for batch in batches:
            for _, code, once in _buckets(batch, "once"):
                i, j = code // n, code % n
                for at, other in ((i[once | (i == j)], j[once | (i == j)]), (j[once], i[once])):
                    ok = bank[other] >= 0
                    yield "unique_banks", at[ok], bank[other[ok]]

    distinct |= distinct_counts(p, p.buckets.select("b", "code", "once"), ("unique_banks",), met, bank)

    def others(batch: pa.RecordBatch, state: dict, acc: np.ndarray) -> Iterator[tuple]:
        for _, code, once in _buckets(batch, "once"):
            i, j = code // n, code % n
            for at in (i[once | (i == j)], j[once]):
                np.add.at(acc[0], at, np.ones(len(at)))
        return iter(())

    distinct["unique_counterparties"] = summed(p.buckets.select("b", "code", "once"), {}, n, 1, others)[0][0]
    state = sums | distinct
    whole = ("out_degree", "in_degree", "reversal_count", "_dated", "_weekend", *distinct)
    parts = ("_out", "_in", "_n", "_sum", "_m2", "max_amount", "_last", "_first")

    def make(node_id: pa.Array, idx: np.ndarray, state: dict) -> tuple:
        return node_id, *[pa.array(state[c][idx].astype(np.int64)) for c in whole], *[pa.array(np.where(np.isinf(state[c][idx]), np.nan, state[c][idx]), from_pandas=True) for c in parts]

    got = attached(p, state, make, ", ".join(["node string", *[f"{c} bigint" for c in whole], *[f"{c} double" for c in parts]]))
    at = lambda c: F.timestamp_micros(c.cast("bigint"))
    return got.filter("out_degree + in_degree > 0").select(
        "node", (F.col("out_degree") + F.col("in_degree")).alias("degree"), "in_degree", "out_degree", (F.col("_in") / 10_000).alias("total_amount_in"), (F.col("_out") / 10_000).alias("total_amount_out"),
        F.try_divide("_sum", "_n").alias("mean_amount"), F.sqrt(F.try_divide("_m2", "_n")).alias("std_amount"), "max_amount", "reversal_count",
        at(-F.col("_first")).alias("_a"), at(F.col("_last")).alias("_b"), "_dated", "_weekend", *distinct,
    )
