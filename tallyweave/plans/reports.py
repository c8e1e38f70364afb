"""Reports of whole studies: text, tables and JSON, from small aggregated rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics
from ..operators.rings import TIERS, TYPES
from ..sources import sinks
from . import study

NOTE = "Scores are measured on injected rings; the real transactions carry no labels."
NAMES = {"roc_auc": "AUC", "pr_auc": "PR-AUC", "precision_at_n": "Precision@K", "recall_at_n": "Recall@K"}


def grid(rows: Iterable[Iterable[object]]) -> str:
    """Rows of cells as text, columns aligned: the first to the left, the others to the right."""
    cells = [[str(c) for c in r] for r in rows]
    wide = [max(len(r[k]) for r in cells if k < len(r)) for k in range(max(map(len, cells), default=0))]
    return "\n".join("  ".join(c.rjust(w) if k else c.ljust(w) for k, (c, w) in enumerate(zip(r, wide, strict=False))).rstrip() for r in cells)


def share(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1%}"


def number(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.3f}"


def spread(mean: float | None, std: float | None, how=share) -> str:
    return "n/a" if mean is None else f"{how(mean)} ± {how(std or 0.0)}"


def titled(title: str, *parts: str) -> str:
    return "\n".join([title, "=" * len(title), *parts, ""])


def metrics_text(name: str, m: dict, ks: tuple[int, ...] = metrics.EXTRA_KS) -> str:
    """One method's metrics: the areas, and precision and recall at the number of positives and at each k."""
    rows = [("AUC", number(m["roc_auc"])), ("PR-AUC", number(m["pr_auc"]))]
    for k in ("n", *ks):
        rows.append((f"at {m['n_positive'] if k == 'n' else k}", share(m.get(f"precision_at_{k}")), share(m.get(f"recall_at_{k}"))))
    return titled(name, grid(rows))


def recovery_text(found: dict) -> str:
    """The evaluation of one run, with its table by type and tier."""
    head = grid([
        ("synthetic nodes", found["n_positive"]), ("real nodes", found["n"] - found["n_positive"]), ("AUC", number(found["roc_auc"])), ("AUC of core members", number(found["core_auc"])),
        ("precision at synthetic nodes", share(found["precision_at_n"])), ("mean percentile, synthetic", share(found["synthetic"])), ("mean percentile, real", share(found["real"])),
    ])
    table = grid([("type", "tier", "rings", "all members", "core")] + [(r["ring_type"], r["tier"], r["n_rings"], share(r["mean_percentile"]), share(r["core_percentile"])) for r in found["benchmark"]])
    return titled("Recovery of injected rings", head, "", table, "", NOTE)


def rows_of(df: DataFrame) -> list[dict]:
    """A small aggregated table on the driver: a few methods by a few slices."""
    return [r.asDict(recursive=True) for r in df.collect()]


def of(rows: list[dict], **where) -> dict | None:
    return next((r for r in rows if all(r.get(k) == v for k, v in where.items())), None)


def overall_rows(rows: list[dict], methods: tuple[str, ...] = study.METHODS) -> list[tuple]:
    out = [("method", *NAMES.values())]
    for m in methods:
        r = of(rows, method=m, ring_type=None, tier=None) or {}
        out.append((m, *(spread(r.get(f"{v}_mean"), r.get(f"{v}_std"), number if "auc" in v else share) for v in NAMES)))
    return out


def slice_rows(rows: list[dict], column: str, keys: Iterable[str], methods: tuple[str, ...] = study.METHODS, value: str = "pr_auc") -> list[tuple]:
    """PR-AUC of every method by type or by tier."""
    other = {"ring_type": "tier", "tier": "ring_type"}[column]
    out: list[tuple] = [(column, *methods)]
    for key in keys:
        found = [of(rows, method=m, **{column: key, other: None}) or {} for m in methods]
        out.append((key, *(spread(r.get(f"{value}_mean"), r.get(f"{value}_std")) for r in found)))
    return out


def contribution_rows(rows: list[dict]) -> list[tuple]:
    head = ("method", "against", "metric", "delta", "seeds in favour")
    return [head] + [(r["method"], r["against"], r["metric"], spread(r["delta_mean"], r["delta_std"], lambda x: f"{x:+.3f}"), f"{r['n_positive']} of {r['n_seeds']}") for r in rows]


def _by(rows: list[dict], column: str | None) -> dict:
    """Aggregates as nested objects: method, or slice and method."""
    other = {"ring_type": "tier", "tier": "ring_type", None: None}[column]
    out: dict = {}
    for r in rows:
        if column is None and r["ring_type"] is None and r["tier"] is None:
            out[r["method"]] = {k: v for k, v in r.items() if k.endswith(("_mean", "_std"))}
        elif column and r[column] is not None and r[other] is None:
            out.setdefault(r[column], {})[r["method"]] = {k: v for k, v in r.items() if k.endswith(("_mean", "_std"))}
    return out


def _study_json(per_seed: DataFrame, rows: list[dict], config: dict, **more) -> dict:
    return {"config": config, "per_seed": rows_of(per_seed), "aggregate_overall": _by(rows, None), "aggregate_by_type": _by(rows, "ring_type"), "aggregate_by_tier": _by(rows, "tier"), **more}


def write_benchmark(spark: SparkSession, runs: list[dict], out: str, config: dict) -> str:
    """One method over several seeds: JSON and text, with the type by tier table."""
    done = study.aggregate_runs(spark, runs)
    cells = {(r["ring_type"], r["tier"]): spread(r["mean_percentile_mean"], r["mean_percentile_std"]) for r in done["benchmark"]}
    table = grid([("type", *TIERS)] + [(t, *(cells.get((t, k), "n/a") for k in TIERS)) for t in TYPES])
    head = grid([(name, spread(done[f"{c}_mean"], done[f"{c}_std"], how)) for c, name, how in (("roc_auc", "AUC", number), ("core_auc", "AUC of core members", number), ("precision_at_n", "precision at synthetic nodes", share), ("loss", "last loss", number))])
    text = titled(f"Benchmark over {len(runs)} seeds", head, "", "Mean percentile of ring members:", table, "", NOTE)
    sinks.write_text(spark, text, f"{out}/benchmark_report")
    sinks.write_json(spark, {"config": config, "per_seed": runs, "aggregate": done}, f"{out}/benchmark_multiseed")
    return text


def write_comparison(spark: SparkSession, per_seed: DataFrame, out: str, config: dict) -> str:
    """Rules, forest, graph model and both: text, a CSV table, JSON."""
    whole = study.aggregate(per_seed)
    rows = rows_of(whole)
    text = titled("Rules, isolation forest and graph model", grid(overall_rows(rows)), "", "PR-AUC by type:", grid(slice_rows(rows, "ring_type", TYPES)), "", "PR-AUC by tier:", grid(slice_rows(rows, "tier", TIERS)), "", NOTE,
                  "Rings are made of counterparties only, so accounts alone have no positives to compare.")
    sinks.write_text(spark, text, f"{out}/comparison_report")
    sinks.write_csv(whole.filter("ring_type is null and tier is null").drop("ring_type", "tier").coalesce(1), f"{out}/comparison_table")  # a row a method
    sinks.write_json(spark, _study_json(per_seed, rows, config), f"{out}/baseline_results")
    return text


def write_ablation(spark: SparkSession, per_seed: DataFrame, out: str, config: dict) -> str:
    """Each detector alone and combined, what it adds on equal seeds, and the numbers of the plot by tier."""
    rows = rows_of(study.aggregate(per_seed))
    added = [r | {"metric": v} for v in study.VALUES for r in rows_of(study.contributions(per_seed, v))]
    text = titled("Ablation", grid(overall_rows(rows)), "", "Contributions on equal seeds:", grid(contribution_rows(added)), "", "PR-AUC by tier:", grid(slice_rows(rows, "tier", TIERS)), "",
                  "PR-AUC by type:", grid(slice_rows(rows, "ring_type", TYPES)), "", "The forest alone reads raw features, the combined one embeddings.", NOTE)
    sinks.write_text(spark, text, f"{out}/ablation_report")
    sinks.write_json(spark, _study_json(per_seed, rows, config, contribution_analysis=added), f"{out}/ablation_results")
    plot = [(t, r["method"], r["pr_auc_mean"], r["pr_auc_std"]) for t in TIERS for r in rows if r["tier"] == t and r["ring_type"] is None]
    sinks.write_csv(spark.createDataFrame(plot, "tier string, method string, pr_auc_mean double, pr_auc_std double").coalesce(1), f"{out}/ablation_pr_auc_by_tier")
    return text


def write_heldout(spark: SparkSession, runs: DataFrame, out: str, config: dict, seen: DataFrame | None = None) -> str:
    """Types that training has not seen: text, JSON, and the heat map as a table of type by tier."""
    done = rows_of(study.aggregate_heldout(runs))
    held = [t for t in TYPES if of(done, held_out_type=t)]
    cell = lambda t, m, tier: of(done, held_out_type=t, method=m, tier=tier) or {}
    both = [("held-out type", "GNN", "IF", "delta")]
    for t in held:
        a, b = cell(t, "GNN", None), cell(t, "IF", None)
        delta = None if a.get("pr_auc_mean") is None or b.get("pr_auc_mean") is None else a["pr_auc_mean"] - b["pr_auc_mean"]
        both.append((t, spread(a.get("pr_auc_mean"), a.get("pr_auc_std")), spread(b.get("pr_auc_mean"), b.get("pr_auc_std")), "n/a" if delta is None else f"{delta:+.1%}"))
    heat = [(t, *(cell(t, "GNN", k).get("pr_auc_mean") for k in TIERS)) for t in held]
    parts = ["PR-AUC:", grid(both), "", "PR-AUC of the graph model by tier:", grid([("held-out type", *TIERS)] + [(t, *map(share, v)) for t, *v in heat])]
    known = [] if seen is None else rows_of(study.seen_and_unseen(study.aggregate_heldout(runs), seen))
    if known:
        parts += ["", "Seen and unseen:", grid([("type", "seen", "unseen", "delta")] + [(r["held_out_type"], share(r["seen"]), share(r["unseen"]), f"{r['unseen'] - r['seen']:+.1%}") for r in known])]
    shared = sum(o for r in done if r["method"] == "GNN" and r["tier"] is None for o in r["overlaps"])
    text = titled("Held-out types", f"Synthetic ids shared by training and test: {shared}", "", *parts, "", NOTE)
    sinks.write_text(spark, text, f"{out}/heldout_report")
    sinks.write_json(spark, {"config": config, "per_experiment": rows_of(runs), "aggregate": done, "seen_comparison": known}, f"{out}/heldout_results")
    sinks.write_csv(spark.createDataFrame(heat, "held_out_type string, " + ", ".join(f"{k} double" for k in TIERS)).coalesce(1), f"{out}/heldout_pr_auc")
    return text
