"""Whole studies from a directory of statements: ``python -m tallyweave pipeline --data-dir ... --out-dir ...``."""

from __future__ import annotations

import argparse

from .operators import graph
from .operators.rings import TYPES
from .plans import reports, study
from .session import clean, materialize, session
from .sources import statements

STUDIES = ("pipeline", "pipeline-v1", "benchmark", "comparison", "ablation", "heldout")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyweave")
    p.add_argument("study", choices=STUDIES)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--seeds", type=int, nargs="+", default=list(study.SEEDS))
    p.add_argument("--rings-per-type-tier", type=int, default=study.DEFAULTS["per_cell"])
    p.add_argument("--epochs", type=int, default=study.DEFAULTS["epochs"])
    p.add_argument("--hidden-dim", type=int, default=study.DEFAULTS["hidden"])
    p.add_argument("--embed-dim", type=int, default=study.DEFAULTS["embed"])
    p.add_argument("--lr", type=float, default=study.DEFAULTS["rate"])
    p.add_argument("--seen", help="an ablation's JSON, for the held-out study")
    return p


def main(argv: list[str] | None = None) -> str:
    """Run one study; the text of its report."""
    a = arguments().parse_args(argv)
    spark = session()
    txns, report = statements.ingest(spark, a.data_dir)
    txns = materialize(txns, "transactions")
    options = {"per_cell": a.rings_per_type_tier, "epochs": a.epochs, "hidden": a.hidden_dim, "embed": a.embed_dim, "rate": a.lr}
    config = options | {"seeds": a.seeds, "transactions": txns.count(), "files": {r.status: r["count"] for r in report.groupBy("status").count().collect()}}
    try:
        if a.study == "pipeline":
            return reports.recovery_text(study.run_pipeline(spark, txns, a.out_dir, a.seeds[0], **options)["evaluation"])
        if a.study == "pipeline-v1":
            return str(study.run_plain(spark, txns, a.out_dir, epochs=a.epochs, hidden=a.hidden_dim, embed=a.embed_dim))
        edges, nodes = materialize(graph.build_edges(txns), "edges"), materialize(graph.build_nodes(txns), "nodes")
        if a.study == "benchmark":
            return reports.write_benchmark(spark, study.benchmark(edges, nodes, tuple(a.seeds), **options), a.out_dir, config)
        if a.study == "heldout":
            runs = None
            for held in TYPES:
                for seed in a.seeds:
                    one = study.heldout(edges, nodes, held, seed, **options)
                    runs = one if runs is None else runs.unionByName(one)
            seen = statements.seen_results(spark, a.seen) if a.seen else None
            if seen is not None:
                seen = seen.selectExpr("'GNN' as method", "ring_type", "cast(null as string) as tier", "pr_auc_mean")
            return reports.write_heldout(spark, materialize(runs, "heldout"), a.out_dir, config, seen)
        ablation = a.study == "ablation"
        rows = materialize(study.over_seeds(edges, nodes, tuple(a.seeds), forest_on="x" if ablation else "z", **options), "study")
        return (reports.write_ablation if ablation else reports.write_comparison)(spark, rows, a.out_dir, config)
    finally:
        clean(spark)


if __name__ == "__main__":
    print(main())
