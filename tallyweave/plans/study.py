"""Whole studies: the pipeline, seed benchmarks, comparisons, ablations and held-out generalisation.

A study is a loop over a few seeds on the driver; everything inside a seed is a
plan.  What several plans read (graph, features, embeddings, scores) is written once
in the shared folder, so plans stay small and a lost executor costs little.
"""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import features, graph, iforest, metrics, model, packed, plain, rings, rules
from ..session import kept, materialize
from ..sources import sinks

SEEDS = (42, 43, 44, 45, 46)
METHODS = ("Rules", "IF", "GNN", "GNN+IF")
DEFAULTS = {"per_cell": 10, "epochs": 200, "hidden": 64, "embed": 32, "rate": 0.02}


def _vector(feats: DataFrame) -> DataFrame:
    return feats.select("node_id", F.array(*features.COLUMNS).alias("x"))


def fit_graph(edges: DataFrame, nodes: DataFrame, seed: int, epochs: int, hidden: int, embed: int, rate: float) -> tuple[model.Model, DataFrame]:
    """The trained model and the scaled features of a graph."""
    feats = features.of_graph(edges, nodes)
    return model.train(edges, feats, list(features.COLUMNS), epochs=epochs, rate=rate, hidden=hidden, embed=embed, seed=seed), feats


def all_scores(trained: model.Model, edges: DataFrame, nodes: DataFrame, feats: DataFrame, seed: int, forest_on: str = "z") -> DataFrame:
    """method, node_id, score of the four methods on one graph of written tables.  ``forest_on``: z (embeddings) or x (features) for the method IF."""
    emb = materialize(model.embed(trained, edges, feats), "embeddings")
    gnn = materialize(model.reconstruction_scores(edges, emb), "scores")
    on_z = materialize(iforest.isolation_scores(emb, "z", seed), "scores")
    alone = on_z if forest_on == "z" else iforest.isolation_scores(_vector(feats), "x", seed)
    packed.forget(edges)
    by_rule = rules.combined(graph.incidence(edges), nodes, written=True).select("node_id", F.col("combined").alias("score"))
    named = zip(METHODS, (by_rule, alone, gnn, metrics.combine_scores(gnn, on_z)), strict=True)
    return _stack(named)


def _stack(named) -> DataFrame:
    return materialize(functools.reduce(DataFrame.unionByName, (s.select(F.lit(m).alias("method"), "node_id", "score") for m, s in named)), "scores")


def slice_table(scores: DataFrame, records: DataFrame) -> DataFrame:
    """method, ring_type, tier (null: all) and the metrics, each slice against all real nodes.

    The real nodes of a method are ranked once and every slice is read off the
    places of its own members among them, so rows are not multiplied by slices.
    """
    own = metrics.members(records).select("node_id", "ring_type", "tier")
    none = F.lit(None).cast("string")
    slices = F.array(F.struct("ring_type", none.alias("tier")), F.struct(none.alias("ring_type"), "tier"), F.struct(none.alias("ring_type"), none.alias("tier")))
    of = own.select("node_id", F.explode(slices).alias("s")).select("node_id", "s.*").distinct()
    placed = metrics.located(scores, own, ["method"])
    rows = placed.join(F.broadcast(of), "node_id")  # members of a few rings
    return materialize(metrics.located_metrics(rows, ["method", "ring_type", "tier"]), "metrics")


def one_seed(edges: DataFrame, nodes: DataFrame, seed: int, per_cell: int, epochs: int, hidden: int, embed: int, rate: float, forest_on: str = "z") -> DataFrame:
    e, n, records = rings.inject(edges, nodes, per_cell, seed)  # a few local rows beside the written graph, which is not copied
    trained, feats = fit_graph(e, n, seed, epochs, hidden, embed, rate)
    out = slice_table(all_scores(trained, e, n, feats, seed, forest_on), records)
    return out.withColumns({"seed": F.lit(seed), "loss": F.lit(trained.losses[-1])})


def over_seeds(edges: DataFrame, nodes: DataFrame, seeds: tuple[int, ...] = SEEDS, **options) -> DataFrame:
    """Per-seed rows; ``forest_on="z"`` compares methods, ``"x"`` is the ablation."""
    options = DEFAULTS | options
    edges, nodes = kept(edges, "edges"), kept(nodes, "nodes")
    return functools.reduce(DataFrame.unionByName, (one_seed(edges, nodes, s, **options) for s in seeds))


VALUES = ("roc_auc", "pr_auc", "precision_at_n", "recall_at_n")


def aggregate(per_seed: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of every method and slice."""
    return metrics.mean_std(per_seed, ["method", "ring_type", "tier"], list(VALUES))


def contributions(per_seed: DataFrame, column: str = "pr_auc") -> DataFrame:
    """What each method adds to another on equal seeds, overall."""
    whole = per_seed.filter("ring_type is null and tier is null")
    pairs = (("GNN", "IF"), ("GNN", "Rules"), ("GNN+IF", "GNN"), ("GNN+IF", "IF"))
    out = [metrics.paired_deltas(whole, a, b, column).select(F.lit(a).alias("method"), F.lit(b).alias("against"), "*") for a, b in pairs]
    return functools.reduce(DataFrame.unionByName, out)


def benchmark(edges: DataFrame, nodes: DataFrame, seeds: tuple[int, ...] = SEEDS, **options) -> list[dict]:
    """The evaluation of the combined score, one dictionary a seed."""
    options = DEFAULTS | options
    edges, nodes = kept(edges, "edges"), kept(nodes, "nodes")
    runs = []
    for seed in seeds:
        e, n, records = rings.inject(edges, nodes, options["per_cell"], seed)
        trained, feats = fit_graph(e, n, seed, options["epochs"], options["hidden"], options["embed"], options["rate"])
        emb = materialize(model.embed(trained, e, feats), "embeddings")
        scores = materialize(metrics.combine_scores(model.reconstruction_scores(e, emb), iforest.isolation_scores(emb, "z", seed)), "scores")
        runs.append(metrics.evaluate_recovery(scores, records) | {"seed": seed, "loss": trained.losses[-1], "first_loss": trained.losses[0], "n_edges": e.count()})
    return runs


def aggregate_runs(spark: SparkSession, runs: list[dict]) -> dict:
    """Means and deviations over seeds of the whole and of each type and tier; a few rows."""
    names = ("roc_auc", "core_auc", "precision_at_n", "loss")
    rows = spark.createDataFrame([tuple(r[c] for c in names) for r in runs], ", ".join(f"{c} double" for c in names))
    cells = spark.createDataFrame([(c["ring_type"], c["tier"], c["mean_percentile"]) for r in runs for c in r["benchmark"]], "ring_type string, tier string, mean_percentile double")
    out = metrics.mean_std(rows, [], list(names)).first().asDict()
    return out | {"seeds": [r["seed"] for r in runs], "benchmark": [r.asDict() for r in metrics.mean_std(cells, ["ring_type", "tier"], ["mean_percentile"]).orderBy("ring_type", "tier").collect()]}


def heldout(edges: DataFrame, nodes: DataFrame, held: str, seed: int, per_cell: int = 10, epochs: int = 200, hidden: int = 64, embed: int = 32, rate: float = 0.02) -> DataFrame:
    """Train on the other types, score the held-out type forward only, against a forest on raw features; with the number of shared synthetic ids."""
    (e, n, r), (te, tn, tr) = rings.heldout_split(kept(edges, "edges"), kept(nodes, "nodes"), held, per_cell, seed)
    trained, _ = fit_graph(e, n, seed, epochs, hidden, embed, rate)
    packed.forget(e)
    feats = features.of_graph(te, tn)
    emb = materialize(model.embed(trained, te, feats), "embeddings")
    gnn = materialize(model.reconstruction_scores(te, emb), "scores")
    packed.forget(te)
    named = (("GNN", gnn), ("IF", iforest.isolation_scores(_vector(feats), "x", seed)))
    scores = _stack(named)
    shared = metrics.overlap(metrics.members(r), metrics.members(tr)).first().n_shared
    return slice_table(scores, tr).withColumns({"held_out_type": F.lit(held), "seed": F.lit(seed), "overlap": F.lit(shared)})


def aggregate_heldout(runs: DataFrame) -> DataFrame:
    out = metrics.mean_std(runs.filter("ring_type is null"), ["held_out_type", "method", "tier"], list(VALUES))
    shared = runs.groupBy("held_out_type").agg(F.collect_set("overlap").alias("overlaps"))
    return out.join(F.broadcast(shared), "held_out_type")  # five types


def seen_and_unseen(unseen: DataFrame, seen: DataFrame, column: str = "pr_auc_mean") -> DataFrame:
    """held_out_type, seen, unseen: the graph model's metric on types it has and has not trained on."""
    a = unseen.filter("method = 'GNN' and tier is null").select(F.col("held_out_type"), F.col(column).alias("unseen"))
    b = seen.filter("method = 'GNN' and tier is null and ring_type is not null").select(F.col("ring_type").alias("held_out_type"), F.col(column).alias("seen"))
    return a.join(b, "held_out_type").select("held_out_type", "seen", "unseen")


def hardest_rings(records: DataFrame) -> DataFrame:
    """For each type the ring to show: of the hardest tier, the first."""
    rank = F.when(F.col("tier") == "hard", 2).when(F.col("tier") == "medium", 1).otherwise(0)
    best = records.groupBy("ring_type").agg(F.min(F.struct(-rank, F.col("ring_id"), F.col("tier"), F.col("nodes"))).alias("b"))
    return best.select("ring_type", "b.ring_id", "b.tier", "b.nodes")


def ring_subgraph(edges: DataFrame, scores: DataFrame, ring: DataFrame, nodes: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a ring with its context: anonymous labels, scores, and who is in the ring."""
    seeds = ring.select(F.explode("nodes").alias("node"))
    found, inside = graph.k_hop(edges, seeds, hops)
    rows = found.withColumnRenamed("node", "node_id").join(nodes.select("node_id", "node_type"), "node_id", "left").join(scores, "node_id", "left")
    rows = rows.join(F.broadcast(seeds.select(F.col("node").alias("node_id"), F.lit(True).alias("in_ring")).distinct()), "node_id", "left").fillna(False, ["in_ring"])
    return rows.withColumn("shown", scalars.anonymous_label(F.col("node_id"), F.col("node_type"))), inside


def run_pipeline(spark: SparkSession, txns: DataFrame, out: str, seed: int = 42, **options) -> dict:
    """Transactions to artifacts under ``out``; the summary that is also written as JSON."""
    options = DEFAULTS | options
    took, began = {}, time.time()

    def done(stage: str) -> None:
        nonlocal began
        took[stage], began = time.time() - began, time.time()

    edges, nodes = materialize(graph.build_edges(txns), "edges"), materialize(graph.build_nodes(txns), "nodes")
    e, n, records = rings.inject(edges, nodes, options["per_cell"], seed)
    e, n = materialize(e, "edges"), materialize(n, "nodes")
    done("graph")
    trained, feats = fit_graph(e, n, seed, options["epochs"], options["hidden"], options["embed"], options["rate"])
    done("training")
    emb = materialize(model.embed(trained, e, feats), "embeddings")
    scores = materialize(metrics.combine_scores(model.reconstruction_scores(e, emb), iforest.isolation_scores(emb, "z", seed)), "scores")
    done("scores")
    found = metrics.evaluate_recovery(scores, records)
    done("evaluation")
    sinks.write_csv(features.node_features(e, n), f"{out}/node_features")
    sinks.write_graph(n, e, f"{out}/graph")
    sinks.write_embeddings(emb, f"{out}/embeddings")
    sinks.write_scores(metrics.rank_normalize(scores), f"{out}/anomaly_scores")
    sinks.write_model(spark, trained, f"{out}/model")
    from . import reports

    sinks.write_text(spark, reports.recovery_text(found), f"{out}/evaluation_report")
    for r in hardest_rings(records).select("ring_type").collect():
        one = hardest_rings(records).filter(F.col("ring_type") == r.ring_type)
        who, inside = ring_subgraph(e, scores, one, n)
        who.write.mode("overwrite").parquet(f"{out}/subgraphs/{r.ring_type}/nodes")
        inside.write.mode("overwrite").parquet(f"{out}/subgraphs/{r.ring_type}/edges")
    done("artifacts")
    summary = {"counts": graph.graph_report(txns).first().asDict(), "losses": trained.losses, "evaluation": found, "options": options | {"seed": seed}, "seconds": took}
    sinks.write_json(spark, summary, f"{out}/run_summary")
    return summary


def run_plain(spark: SparkSession, txns: DataFrame, out: str, seed: int = 0, n_rings: int = 12, epochs: int = 200, hidden: int = 64, embed: int = 32, rate: float = 0.01) -> dict:
    """The first version of the pipeline, with its defaults: plain rings, the undirected model, recovery without cores and tiers."""
    e, n, records = rings.inject_plain(graph.build_edges(txns), graph.build_nodes(txns), n_rings, seed)
    e, n = materialize(e, "edges"), materialize(n, "nodes")
    feats = materialize(features.scale_features(features.node_features(e, n)), "features")
    trained = plain.train(e, feats, list(features.COLUMNS), epochs, rate, hidden, embed, seed)
    emb = materialize(plain.embed(trained, e, feats), "embeddings")
    scores = materialize(metrics.combine_scores(plain.reconstruction_scores(e, emb), iforest.isolation_scores(emb, "z", seed)), "scores")
    whole, each = plain.recovery(scores, records)
    sinks.write_scores(metrics.rank_normalize(scores), f"{out}/anomaly_scores")
    found = whole.first().asDict() | {"per_ring": [r.asDict() for r in each.orderBy("ring_id").collect()], "losses": trained.losses}
    sinks.write_json(spark, found, f"{out}/run_summary")
    return found
