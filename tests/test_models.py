from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import descent, graph, iforest, metrics, model, order, plain, rings
from tallyweave.plans import catalog, reports, study, views
from tallyweave.session import materialize
from tallyweave.sources import sinks, statements

from .conftest import SMALL


@pytest.fixture(scope="module")
def real(spark):
    return materialize(views.edges(spark, SMALL).withColumns(catalog._extra())), materialize(views.nodes(spark, SMALL))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    n, f = 12, 5
    row, col = np.nonzero(rng.random((n, n)) < 0.3)
    row, col = np.concatenate([row, col]), np.concatenate([col, row])
    order = np.argsort(row, kind="stable")
    sym = model.Sparse(row[order], col[order], np.ones(len(row)), n)
    inputs = {c: rng.normal(size=(n, f)) for c in (*model.CHANNELS, "self")}
    w = {k: 0.3 * x.astype(np.float64) for k, x in model.new_weights(f, 6, 4, 1).items()}
    i, j, y = rng.integers(0, n, 20), rng.integers(0, n, 20), rng.integers(0, 2, 20).astype(float)
    _, grad = model.gradients(w, inputs, sym, model.forward(w, inputs, sym), i, j, y)
    for k in w:
        at = (1, 2)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        loss = lambda v: model.gradients(v, inputs, sym, model.forward(v, inputs, sym), i, j, y)[0]
        assert grad[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-3, abs=1e-6)


def test_training_lowers_the_loss_and_is_directed():
    rng = np.random.default_rng(3)
    n = 120
    i, j = np.nonzero((rng.random((n, n)) < 0.03) & ~np.eye(n, dtype=bool))
    row, col = np.concatenate([i, j, np.arange(n)]), np.concatenate([j, i, np.arange(n)])
    code = np.unique(row * n + col)
    row, col = code // n, code % n
    d = np.bincount(row, minlength=n)
    sym = model.Sparse(row, col, (1 / np.sqrt(d[row] * d[col])).astype(np.float32), n)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    inputs = {c: model.Sparse(*(a, b)[:2], np.ones(len(i), dtype=np.float32), n) @ x for c, (a, b) in zip(model.CHANNELS, ((i, j), (np.sort(j), i[np.argsort(j, kind="stable")])) * 2, strict=True)} | {"self": x}
    m = model.fit(inputs, sym, i, j, epochs=60, hidden=16, embed=8, seed=1)
    again = model.fit(inputs, sym, i, j, epochs=60, hidden=16, embed=8, seed=1)
    assert m.losses[-1] < m.losses[0] and m.losses == again.losses
    state = model.forward(m.weights, inputs, sym)
    assert np.abs(model.decode(state, i, j) - model.decode(state, j, i)).mean() > 1e-3


def test_distributed_embedding_equals_the_dense_formula(spark):
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 5.0), ("a", "b", 2.0), ("c", "a", 1.0)], "src string, dst string, amount double")
    feats = spark.createDataFrame([("a", 0.5, 1.0), ("b", -1.0, 0.0), ("c", 2.0, 0.3), ("d", 1.0, 1.0)], "node_id string, f double, g double")
    for width in (3, 20):
        m = model.train(edges, feats, ["f", "g"], epochs=2, hidden=4, embed=width)
        got = {r.node_id: r for r in model.embed(m, edges, feats).collect()}
        names = ["a", "b", "c", "d"]
        x = np.array([[r.f, r.g] for r in feats.orderBy("node_id").collect()])
        ch = np.zeros((4, 4, 4))
        for r in graph.directed_channels(edges).collect():
            ch[model.CHANNELS.index(r.channel), names.index(r.i), names.index(r.j)] = r.w
        s = np.zeros((4, 4))
        for r in graph.degree_norm(graph.adjacency(edges)).collect():
            s[names.index(r.i), names.index(r.j)] = r.w
        s[3, 3] = 1.0
        h = np.maximum(sum(ch[k] @ x @ m.weights[c] for k, c in enumerate(model.CHANNELS)) + x @ m.weights["self"], 0)
        z = s @ h @ m.weights["w2"]
        for k, n in enumerate(names):
            np.testing.assert_allclose(got[n].z, z[k], atol=1e-4)
            np.testing.assert_allclose(got[n].zq, (z @ m.weights["q"])[k], atol=1e-4)
        p = model.decode_pairs(graph.positive_pairs(edges), model.embed(m, edges, feats)).collect()
        assert all(0 < r.p < 1 for r in p)


def test_distributed_gradients_equal_the_driver(spark):
    rng = np.random.default_rng(4)
    rows = [(f"n{a}", f"n{b}", float(rng.integers(1, 99))) for a, b in rng.integers(0, 12, (40, 2)) if a != b]
    edges = spark.createDataFrame(rows, "src string, dst string, amount double")
    names = [f"n{k:d}" for k in range(13)]  # the last has no edge
    x = rng.normal(size=(13, 3))
    feats = spark.createDataFrame([(n, *map(float, v)) for n, v in zip(names, x, strict=True)], "node_id string, a double, b double, c double")
    weights = {k: w.astype(np.float64) for k, w in model.new_weights(3, 6, 4, 1).items()}
    pairs = [(names[i], names[j], int(y)) for i, j, y in zip(rng.integers(0, 13, 30), rng.integers(0, 13, 30), rng.integers(0, 2, 30), strict=True)]
    loss, grad = descent.gradients(weights, *descent.prepared(edges, feats, ["a", "b", "c"]), spark.createDataFrame(pairs, "i string, j string, y int"), len(pairs))
    place = {n: k for k, n in enumerate(names)}
    inputs = {"self": x}
    for c in model.CHANNELS:
        m = np.zeros((13, 13))
        for r in graph.directed_channels(edges).filter(F.col("channel") == c).collect():
            m[place[r.i], place[r.j]] = r.w
        inputs[c] = m @ x
    s = np.eye(13)
    for r in graph.degree_norm(graph.adjacency(edges)).collect():
        s[place[r.i], place[r.j]] = r.w
    row, col = np.nonzero(s)
    sym = model.Sparse(row, col, s[row, col], 13)
    i, j, y = (np.array([f(p[k]) for p in pairs]) for k, f in ((0, place.get), (1, place.get), (2, float)))
    want_loss, want = model.gradients(weights, inputs, sym, model.forward(weights, inputs, sym), i, j, y)
    assert loss == pytest.approx(want_loss, rel=1e-5)
    for k in want:
        np.testing.assert_allclose(grad[k], want[k], rtol=1e-3, atol=1e-6)
    m = model.train(edges, feats, ["a", "b", "c"], most_pairs=5, epochs=3, hidden=4, embed=3)
    assert len(m.losses) == 3 and set(m.weights) == set(weights)


def test_negative_pairs_fill_their_count(spark, real):
    for per in (1, 3):
        got = graph.negative_pairs(*real, per_positive=per)
        positive = graph.positive_pairs(real[0]).count()
        n = real[1].count()
        free = n * (n - 1) - graph.adjacency(real[0]).filter("i != j").count()
        assert got.count() == got.distinct().count() == min(per * positive, free)
    dense = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate("abcd")], "node_id string, node_seq int")
    assert {(r.i, r.j) for r in graph.negative_pairs(dense, nodes, 9).collect()} == {(a, b) for a in "abcd" for b in "abcd" if abs(ord(a) - ord(b)) > 1}
    rng = np.random.default_rng(0)
    i, j = model.negatives(rng, 50, np.sort(np.array([3, 60])), 500)
    assert len(i) == 500 and (i != j).all() and not np.isin(i * 50 + j, [3, 60]).any()
    full = np.array([a * 3 + b for a in range(3) for b in range(3) if a != b])
    assert len(model.negatives(rng, 3, full, 4)[0]) == 0 and len(model.negatives(rng, 3, full[:-1], 4)[0]) == 4


def test_plain_gradients_match_differences():
    rng = np.random.default_rng(1)
    s = rng.random((9, 9))
    s = s + s.T
    row, col = np.nonzero(s)
    sym = model.Sparse(row, col, s[row, col], 9)
    w = {"w0": rng.normal(size=(4, 5)), "w1": rng.normal(size=(5, 3)) * 0.1}
    sx = s @ rng.normal(size=(9, 4)) * 0.1
    i, j, y = rng.integers(0, 9, 12), rng.integers(0, 9, 12), rng.integers(0, 2, 12).astype(float)
    _, grad = plain.gradients(w, sx, sym, i, j, y)
    for k in w:
        up, down = ({**w, k: w[k] + d * (np.arange(w[k].size).reshape(w[k].shape) == 3)} for d in (1e-6, -1e-6))
        slope = (plain.gradients(up, sx, sym, i, j, y)[0] - plain.gradients(down, sx, sym, i, j, y)[0]) / 2e-6
        assert grad[k].ravel()[3] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_medians_of_large_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{int(rng.integers(0, 6)) ** 2 // 6}", float(rng.integers(0, 30))) for _ in range(500)] + [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for most in (10**6, 20, 0):
        got = {r.k: (r.m, r.top) for r in order.medians(df, ["k"], "v", most, top=F.max("v")).collect()}
        assert got == {k: (float(np.median(v)), max(v)) for k in {r[0] for r in rows} for v in [[x for j, x in rows if j == k]]}


def test_running_totals_in_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 3 else int(g), int(x), int(y)) for g, x, y in rng.integers(0, 4, (300, 3))]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "g int, x int, y int, k int")
    got = order.running(df, ["x", "k"], {"t": F.col("y")}, ["g"]).collect()
    for r in got:
        assert r.t == sum(b[2] for k, b in enumerate(rows) if b[0] == r.g and (b[1], k) <= (r.x, r.k))
    assert len(got) == 300


def test_located_metrics_equal_the_stacked_form(spark):
    rng = np.random.default_rng(6)
    scores = spark.createDataFrame([(m, f"n{k}", float(rng.integers(0, 12))) for m in "ab" for k in range(90)], "method string, node_id string, score double")
    slices = [("x", f"n{k}") for k in range(0, 20)] + [("y", f"n{k}") for k in range(15, 40)]
    of = spark.createDataFrame(slices, "s string, node_id string")
    rows = metrics.located(scores, of, ["method"]).join(of, "node_id")
    got = {(r.method, r.s): r.asDict() for r in metrics.located_metrics(rows, ["method", "s"]).collect()}
    real = scores.join(of.select("node_id").distinct(), "node_id", "left_anti")
    stacked = scores.join(of, "node_id").withColumn("label", F.lit(1)).unionByName(real.crossJoin(of.select("s").distinct()).withColumn("label", F.lit(0)))
    want = metrics.compute_metrics(stacked, by=["method", "s"]).collect()
    assert len(want) == len(got) == 4
    for r in want:
        mine = got[r.method, r.s]
        for k, v in r.asDict().items():
            assert mine[k] == pytest.approx(v) if isinstance(v, float) else mine[k] == v, k


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in (rng.normal(size=4) + (12 if k < 5 else 0))]) for k in range(400)]
    df = spark.createDataFrame(rows, "node_id long, z array<double>")
    got = {r.node_id: r.score for r in iforest.isolation_scores(df, trees=60).collect()}
    assert min(got[k] for k in range(5)) > np.quantile(list(got.values()), 0.98) and all(0 < s < 1 for s in got.values())
    assert got == {r.node_id: r.score for r in iforest.isolation_scores(df, trees=60).collect()}
    assert iforest.mean_path(2) == 1 and iforest.mean_path(1) == 0


def test_rings(spark, real):
    e, n, r = rings.inject(*real, per_cell=2, seed=13)
    records = r.collect()
    assert len(records) == 30 and {x.ring_type for x in records} == set(rings.TYPES)
    assert all(set(x.core_nodes) <= set(x.nodes) for x in records)
    assert all(len(x.nodes) == 2 and len(x.core_nodes) == 1 for x in records if x.ring_type == "probe_and_drain")
    assert all(6 <= len(x.nodes) <= 9 for x in records if x.ring_type != "probe_and_drain")
    again = rings.inject(*real, per_cell=2, seed=13)[0]
    key = lambda d: sorted((x.src, x.dst, x.amount) for x in d.filter("is_synthetic").collect())
    assert key(e) == key(again) and e.filter("not is_synthetic").count() == real[0].count()
    assert e.filter("is_noise and ring_id in (0, 1)").count() == 0  # easy
    chain = next(x for x in records if x.ring_type == "mule_chain")
    assert e.filter((F.col("src") == chain.nodes[0]) & (F.col("dst") == chain.nodes[1])).count() == 0


def test_partners_come_from_the_whole_graph(spark, real):
    nodes = real[1].unionByName(spark.createDataFrame([(f"CP:X{k}", "counterparty", "x", None, False, 10**9 + k) for k in range(3000)], real[1].schema))
    e, _, _ = rings.inject(real[0], nodes, per_cell=20, seed=5)
    ends = e.filter("is_synthetic").select(F.explode(F.array("src", "dst")).alias("n")).filter("n not like 'SYN:%'").distinct().count()
    assert ends > 600  # a sample of 500 nodes could not
    assert e.filter("is_synthetic").select("parsed_date").distinct().count() > 250


def test_heldout_is_disjoint(real):
    (te, tn, tr), (he, hn, hr) = rings.heldout_split(*real, "cycle", per_cell=1)
    assert {x.ring_type for x in tr.collect()} == set(rings.TYPES) - {"cycle"} and {x.ring_type for x in hr.collect()} == {"cycle"}
    assert metrics.overlap(metrics.members(tr), metrics.members(hr)).first().n_shared == 0
    assert hn.filter("is_synthetic and node_id not like 'SYNTEST:%'").count() == 0


def test_pipeline_and_study(spark, real, tmp_path):
    summary = study.run_pipeline(spark, views.transactions(spark, SMALL).withColumn("edge", F.lit(1)), str(tmp_path / "out"), per_cell=1, epochs=10, hidden=8, embed=4)
    assert 0 <= summary["evaluation"]["roc_auc"] <= 1 and summary["losses"][-1] < summary["losses"][0] + 1
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/anomaly_scores")).count() == spark.read.parquet(str(tmp_path / "out/embeddings")).count()
    m = sinks.read_model(spark, str(tmp_path / "out/model"))
    assert set(m.weights) == {*model.CHANNELS, "self", "w2", "q", "k"}
    rows = study.over_seeds(*real, seeds=(1,), per_cell=1, epochs=5, hidden=8, embed=4)
    assert rows.select("method").distinct().count() == 4
    assert rows.filter("ring_type is null and tier is null").count() == 4 and rows.count() == 4 * (1 + 5 + 3)
    assert study.contributions(rows).filter("n_seeds = 1").count() == 4 and rows.filter("roc_auc is null or pr_auc is null").count() == 0
    assert "GNN+IF" in reports.write_ablation(spark, rows, str(tmp_path / "out"), {})
    assert {r.ring_type for r in statements.seen_results(spark, str(tmp_path / "out/ablation_results")).collect()} == set(rings.TYPES)
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/ablation_pr_auc_by_tier")).count() == 12
    runs = study.benchmark(*real, seeds=(1, 2), per_cell=1, epochs=3, hidden=8, embed=4)
    assert "mule_chain" in reports.write_benchmark(spark, runs, str(tmp_path / "out"), {"seeds": [1, 2]})
    plain_run = study.run_plain(spark, views.transactions(spark, SMALL), str(tmp_path / "plain"), epochs=5, hidden=8, embed=4)
    assert 0 <= plain_run["roc_auc"] <= 1 and len(plain_run["per_ring"]) == 12


def test_heldout_study(real, tmp_path):
    rows = study.heldout(*real, "fan_in", 1, per_cell=1, epochs=3, hidden=8, embed=4)
    assert {r.overlap for r in rows.collect()} == {0}
    assert study.aggregate_heldout(rows).filter("tier is null").count() == 2
    text = reports.write_heldout(rows.sparkSession, rows, str(tmp_path / "out"), {}, None)
    assert "fan_in" in text and "training and test: 0" in text


def test_embedding_keeps_double_precision(spark):
    edges = spark.createDataFrame([("a", "b", 3.0)], "src string, dst string, amount double")
    feats = spark.createDataFrame([("a", 16777217.0), ("b", 0.1)], "node_id string, f double")  # 2^24 + 1 has no single-precision form
    one = np.ones((1, 1), dtype=np.float32)
    m = model.Model({c: one * (c == "self") for c in model.CHANNELS} | {"self": one, "w2": one, "q": one, "k": one}, ["f"], [])
    got = {r.node_id: r.z[0] for r in model.embed(m, edges, feats).collect()}
    assert got["a"] == pytest.approx((16777217.0 + 0.1) / 2, rel=1e-12)


def test_packed_descent_equals_the_driver(spark):
    from tallyweave.operators import packed

    rng = np.random.default_rng(9)
    rows = [(f"n{a}", f"n{b}", float(rng.integers(1, 99))) for a, b in rng.integers(0, 30, (90, 2))] + [("n1", "n2", 1.0), ("n2", "n1", 1.0), ("n3", "n3", 2.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, amount double")
    names = [f"n{k}" for k in range(31)]  # the last has no edge
    feats = spark.createDataFrame([(n, *map(float, v)) for n, v in zip(names, rng.normal(size=(31, 3)), strict=True)], "node_id string, a double, b double, c double")
    p = packed.pack(edges, feats, 20)
    assert p.n_buckets == 5 and p.count == len({r[:2] for r in rows})
    place = {r.node_id: r.idx for r in p.index.collect()}
    pattern = np.eye(31)
    for a, b, _ in rows:
        pattern[place[a], place[b]] = pattern[place[b], place[a]] = 1
    d = pattern.sum(axis=1)
    row, col = np.nonzero(pattern)
    sym = model.Sparse(row, col, 1 / np.sqrt(d[row] * d[col]), 31)
    root = packed.degree_roots(p)
    np.testing.assert_allclose(root, 1 / np.sqrt(d))
    made = descent.node_inputs(edges, feats, ["a", "b", "c"]).join(p.index.withColumnRenamed("node_id", "node"), "node")
    inputs = {c: np.zeros((31, 3)) for c in packed.INPUTS}
    for r in made.collect():
        for c in inputs:
            inputs[c][r.idx] = r[c]
    weights = {k: w.astype(np.float64) for k, w in model.new_weights(3, 6, 4, 1).items()}
    loss, grad = packed.gradients(p, made, root, weights, 5, 2)
    taken = {(place[a], place[b]) for a, b, _ in rows}
    i, j, y = [], [], []
    for b, code in ((r.b, np.array(r.code)) for r in p.buckets.collect()):
        pi, pj = code // 31, code % 31
        a, c = packed.negatives(np.random.default_rng((5, 2, b)), 31, 5, b, np.union1d(code, pj * 31 + pi), len(code))
        assert len(a) == len(code) and not {*zip(a, c, strict=True)} & (taken | {(v, u) for u, v in taken}) and (a != c).all() and ((a + c) % 5 == b).all()
        i, j, y = i + [*pi, *a], j + [*pj, *c], y + [1.0] * len(pi) + [0.0] * len(a)
    i, j, y = np.array(i), np.array(j), np.array(y)
    want_loss, want = model.gradients(weights, inputs, sym, model.forward(weights, inputs, sym), i, j, y)
    assert loss == pytest.approx(want_loss, rel=1e-5)
    for k in want:
        np.testing.assert_allclose(grad[k], want[k], rtol=1e-3, atol=1e-6)
    few = dict(epochs=2, hidden=4, embed=3)
    a, b = (descent.fit(edges, feats, ["a", "b", "c"], **few, **more) for more in ({}, {}))
    assert a.losses == pytest.approx(b.losses)
    assert len(descent.fit(edges, feats, ["a", "b", "c"], **few, most_cells=0).losses) == 2  # states joined


def test_packed_negatives_are_even_where_pairs_are_few():
    from tallyweave.operators import packed

    rng = np.random.default_rng(0)
    i, j = packed.negatives(rng, 1000, 7, 3, np.array([5], dtype=np.int64), 20_000)
    assert ((i + j) % 7 == 3).all() and (i != j).all() and np.bincount(i // 100).min() > 1700 and np.bincount(j // 100).min() > 1700
    assert not len(packed.negatives(rng, 2, 1, 0, np.array([1, 2], dtype=np.int64), 4)[0])


@pytest.mark.parametrize("run", [lambda e, n: study.heldout(e, n, "cycle", 1, per_cell=1, epochs=1, hidden=4, embed=2), lambda e, n: study.over_seeds(e, n, seeds=(1,), per_cell=1, epochs=1, hidden=4, embed=2)])
def test_a_study_does_not_copy_a_written_graph(spark, real, run):
    from pathlib import Path

    from tallyweave.session import run_dir

    tables = lambda: {p for kind in ("edges", "graph", "nodes") for p in Path(run_dir(spark).removeprefix("file:")).glob(f"{kind}-*")}
    before = tables()
    assert run(*real).count() > 0 and tables() == before


def test_training_and_embedding_share_the_sums_of_pairs(spark):
    from pathlib import Path

    from tallyweave.session import run_dir

    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 5.0), ("a", "b", 2.0)], "src string, dst string, amount double")
    feats = spark.createDataFrame([("a", 0.5), ("b", -1.0), ("c", 2.0)], "node_id string, f double")
    tables = lambda: {*Path(run_dir(spark).removeprefix("file:")).glob("pair-sums-*")}
    before = tables()
    assert model.embed(model.train(edges, feats, ["f"], most_pairs=1, epochs=1, hidden=2, embed=2), edges, feats).count() == 3
    assert len(tables() - before) == 1


def test_packed_features_embedding_and_surprise_equal_the_joined_forms(spark, real):
    from tallyweave.operators import features

    e, n, _ = rings.inject(*real, 1, 3)
    again, cols = e.select("*"), list(features.COLUMNS)
    a, b = features.of_graph(e, n), features.of_graph(again, n, 0)
    x, y = (pd.DataFrame([r.asDict() for r in f.orderBy("node_id").collect()]) for f in (a, b))
    assert list(x["node_id"]) == list(y["node_id"])
    np.testing.assert_allclose(x[cols], y[cols], atol=1e-9)
    m = model.Model(model.new_weights(len(cols), 4, 3, 1), cols, [])
    one, two = (f(m, g, h) for f, g, h in ((model.embed, e, a), (lambda m, g, h: model.embed(m, g, h, 1), again, b)))
    for c in ("z", "zq", "zk"):
        u, v = ({r.node_id: r[c] for r in t.collect()} for t in (one, two))
        assert u.keys() == v.keys() and all(u[k] == pytest.approx(v[k], rel=1e-9, abs=1e-9) for k in u)
    u, v = ({r.node_id: r.score for r in model.reconstruction_scores(g, t).collect()} for g, t in ((e, one), (again, two)))
    assert u == pytest.approx(v, abs=1e-9)


def test_ended_exchanges_are_deleted(spark):
    """A write's exchange goes with it, not when the driver next needs memory."""
    import time

    from tallyweave.session import materialize

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    materialize(spark.range(10))
    before = files()
    for _ in range(3):
        materialize(spark.range(1000).repartition(8, "id"))
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before


def test_numpy_adds_to_unpickled_states_fast():
    import pickle

    from tallyweave.operators import packed

    x = pickle.loads(pickle.dumps(np.arange(4.0)))
    assert packed.native(x).dtype is np.dtype(np.float64) and (packed.native(x) == x).all()


def test_rules_do_not_copy_written_edges(spark, real):
    from pathlib import Path

    from tallyweave.operators import rules
    from tallyweave.session import run_dir

    tables = lambda: {*Path(run_dir(spark).removeprefix("file:")).glob("incidence-*")}
    before = tables()
    assert rules.combined(graph.incidence(real[0]), real[1], written=True).count() == real[1].count() and tables() == before
