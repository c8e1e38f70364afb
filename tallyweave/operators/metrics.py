"""Rank-based evaluation of scores, as window and aggregate plans.

Inputs have ``score`` (larger is more anomalous), ``label`` (0 or 1) and, where
ties must be broken, ``node_id`` ascending.  Grouped forms take ``by`` columns
and evaluate every group in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order import numbered, running, same

EXTRA_KS = (10, 25, 50, 100)


def rank_normalize(scores: DataFrame, column: str = "score", name: str = "rank") -> DataFrame:
    """``scores`` plus (row number - 1) / (n - 1) ascending; a single row ranks 0."""
    rows = numbered(scores, [column, "node_id"], "_place").crossJoin(F.broadcast(scores.agg(F.count("*").alias("_n"))))  # one row
    return rows.withColumn(name, F.when(F.col("_n") > 1, (F.col("_place") - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_place", "_n")


def combine_scores(recon: DataFrame, iso: DataFrame) -> DataFrame:
    """node_id, score: the mean of both ranks.  Alignment is a join on the key."""
    a = rank_normalize(recon, name="a").select("node_id", "a")
    b = rank_normalize(iso, name="b").select("node_id", "b")
    return a.join(b, "node_id").select("node_id", (0.5 * F.col("a") + 0.5 * F.col("b")).alias("score"))


def _distinct_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Positives and all rows per distinct score: everything else runs on this, which pre-aggregates."""
    return rows.groupBy(*by, "score").agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.count("*").alias("c"))


def roc_auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """roc_auc: the Mann-Whitney statistic, ties counting half; null where a class is missing."""
    by = by or []
    negative = F.col("c") - F.col("p")
    level = running(_distinct_scores(rows, by), ["score"], {"n_below": negative}, by).withColumn("n_below", F.col("n_below") - negative)
    wins = F.sum(F.col("p") * (F.col("n_below") + (F.col("c") - F.col("p")) / 2e0))
    pos, neg = F.sum("p"), F.sum(F.col("c") - F.col("p"))
    return level.groupBy(*by).agg(F.try_divide(wins, (pos * neg).cast("double")).alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pr_auc: the sum of precision times the recall gained, over distinct thresholds."""
    by = by or []
    level = running(_distinct_scores(rows, by), [F.col("score").desc()], {"tp": F.col("p"), "seen": F.col("c")}, by)
    return level.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("tp") / F.col("seen").cast("double"))), F.sum("p").cast("double")).alias("pr_auc"))


def precision_recall_at(rows: DataFrame, ks: tuple[int, ...] = EXTRA_KS, by: list[str] | None = None) -> DataFrame:
    """k, precision, recall for each k up to the number of rows; k = 0 stands for the number of positives."""
    by = by or []
    ranked = numbered(rows, [F.col("score").desc(), F.col("node_id")], by=by)
    totals = rows.groupBy(*by).agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.count("*").alias("n"))
    wanted = totals.withColumn("asked", F.explode(F.array(*[F.lit(k) for k in ks])))
    wanted = wanted.withColumn("k", F.when(F.col("asked") == 0, F.col("pos")).otherwise(F.col("asked"))).filter((F.col("k") > 0) & (F.col("k") <= F.col("n")))
    top = ranked.filter(F.col("label") == 1).select(*by, "rn")
    cond: Column = F.col("t.rn") <= F.col("w.k")
    for c in by:
        cond = cond & F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}"))
    met = F.broadcast(wanted.alias("w")).join(top.alias("t"), cond, "left")  # a few k for each group
    out = met.groupBy(*[F.col(f"w.{c}").alias(c) for c in by], F.col("w.asked").alias("asked"), F.col("w.k").alias("k"), F.col("w.pos").alias("pos")).agg(F.count("t.rn").alias("hits"))
    return out.select(*by, "asked", "k", (F.col("hits") / F.col("k")).alias("precision"), F.try_divide(F.col("hits"), F.col("pos")).alias("recall"))


def compute_metrics(rows: DataFrame, ks: tuple[int, ...] = EXTRA_KS, by: list[str] | None = None) -> DataFrame:
    """One row per group: n, n_positive, roc_auc, pr_auc, precision_at_n, recall_at_n, precision_at_k, recall_at_k for each k."""
    by = by or []
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positive"))
    at = precision_recall_at(rows, (0, *ks), by)
    wide = at.groupBy(*by).agg(*[F.max(F.when(F.col("asked") == k, F.col(m))).alias(f"{m}_at_{k or 'n'}") for k in (0, *ks) for m in ("precision", "recall")])
    for part in (roc_auc(rows, by), average_precision(rows, by), wide):
        out = same(out, part, by, "left")
    return out


def located(scores: DataFrame, positive: DataFrame, by: list[str]) -> DataFrame:
    """Every row of ``scores`` whose node_id is in ``positive``, placed among the others (the negatives) of its group ``by``.

    Adds negatives (in all), below (of lower score), equal (of equal score) and
    before (higher, or equal with a smaller node_id).  Slices of positives are
    evaluated on this: the negatives are ranked once, however many slices share
    them.
    """
    marked = same(scores, positive.select("node_id").distinct().withColumn("_pos", F.lit(1)), ["node_id"], "left")
    marked = materialize(marked.withColumn("_neg", F.col("_pos").isNull().cast("bigint")), "marked-scores")
    level = running(marked.groupBy(*by, "score").agg(F.sum("_neg").alias("equal")), ["score"], {"below": F.col("equal")}, by).withColumn("below", F.col("below") - F.col("equal"))
    rows = running(marked, [F.col("score").desc(), F.col("node_id")], {"before": F.col("_neg")}, by).filter("_pos = 1")
    rows = same(same(rows, level, [*by, "score"]), marked.groupBy(*by).agg(F.sum("_neg").alias("negatives")), by)
    return rows.drop("_pos", "_neg")


def located_metrics(rows: DataFrame, by: list[str], ks: tuple[int, ...] = EXTRA_KS) -> DataFrame:
    """What :func:`compute_metrics` gives, from located positives; windows run over the positives of one slice."""
    own = Window.partitionBy(*by)
    rows = rows.withColumns({"n_positive": F.count("*").over(own), "_rank": F.row_number().over(own.orderBy(F.col("score").desc(), "node_id")) + F.col("before")})
    rows = rows.withColumns({"_n": F.col("negatives") + F.col("n_positive"), "_tp": F.count("*").over(own.orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    seen = F.col("_tp") + F.col("negatives") - F.col("below")
    pos = F.max("n_positive")
    every = pos * F.max("negatives")
    out = rows.groupBy(*by).agg(
        F.max("_n").alias("n"), pos.alias("n_positive"), F.try_divide(F.sum(F.col("below") + F.col("equal") / 2e0), every.cast("double")).alias("roc_auc"),
        # negatives missing: every ranking is perfect, as thresholds see positives only
        (F.sum(F.col("_tp") / seen.cast("double")) / pos.cast("double")).alias("pr_auc"),
        *[F.count_if(F.col("_rank") <= (F.col("n_positive") if k == 0 else k)).alias(f"_hits_{k}") for k in (0, *ks)],
    )
    k_of = lambda k: F.col("n_positive") if k == 0 else F.lit(k)
    at = {}
    for k in (0, *ks):
        at[f"precision_at_{k or 'n'}"] = F.when(k_of(k) <= F.col("n"), F.col(f"_hits_{k}") / k_of(k))
        at[f"recall_at_{k or 'n'}"] = F.when(k_of(k) <= F.col("n"), F.col(f"_hits_{k}") / F.col("n_positive"))
    return out.withColumns(at).drop(*[f"_hits_{k}" for k in (0, *ks)])


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores, ties by node_id."""
    return scores.orderBy(F.col("score").desc(), "node_id").limit(k)


def is_synthetic(node: str = "node_id", prefix: str = "SYN:") -> Column:
    return F.startswith(F.col(node), F.lit(prefix))


def members(rings: DataFrame) -> DataFrame:
    """ring_id, ring_type, tier, node_id, is_core of every member of every ring."""
    rows = rings.select("ring_id", "ring_type", "tier", F.explode("nodes").alias("node_id"), "core_nodes")
    return rows.select("ring_id", "ring_type", "tier", "node_id", F.array_contains("core_nodes", F.col("node_id")).alias("is_core"))


def slice_labels(scores: DataFrame, rings: DataFrame, ring_type: str | None = None, tier: str | None = None) -> DataFrame:
    """Real nodes (label 0) and the synthetic nodes of the slice (label 1); other synthetic nodes are left out."""
    own = members(rings)
    if ring_type is not None:
        own = own.filter(F.col("ring_type") == ring_type)
    if tier is not None:
        own = own.filter(F.col("tier") == tier)
    every = members(rings).select("node_id").distinct()
    keep = own.select("node_id").distinct()
    real = scores.join(every, "node_id", "left_anti").withColumn("label", F.lit(0))
    return real.unionByName(scores.join(keep, "node_id", "left_semi").withColumn("label", F.lit(1)))


def core_auc(scores: DataFrame, rings: DataFrame) -> DataFrame:
    """AUC of core members against real nodes; other members are left out."""
    own = members(rings)
    core = own.filter("is_core").select("node_id").distinct()
    other = own.select("node_id").distinct().join(core, "node_id", "left_anti")
    rows = scores.join(other, "node_id", "left_anti").join(core.withColumn("label", F.lit(1)), "node_id", "left").fillna(0, ["label"])
    return roc_auc(rows).withColumnRenamed("roc_auc", "core_auc")


def ring_table(scores: DataFrame, rings: DataFrame) -> DataFrame:
    """Mean and largest percentile of each ring's members found among the scores, and the core's mean."""
    ranks = rank_normalize(scores).select("node_id", "rank")
    rows = members(rings).join(ranks, "node_id")
    return rows.groupBy("ring_id", "ring_type", "tier").agg(
        F.avg("rank").alias("mean_percentile"), F.max("rank").alias("max_percentile"), F.avg(F.when(F.col("is_core"), F.col("rank"))).alias("core_percentile")
    )


def benchmark_table(per_ring: DataFrame) -> DataFrame:
    """By type and tier, the mean of the rings' means."""
    return per_ring.groupBy("ring_type", "tier").agg(
        F.avg("mean_percentile").alias("mean_percentile"), F.avg("max_percentile").alias("max_percentile"), F.avg("core_percentile").alias("core_percentile"), F.count("*").alias("n_rings")
    )


def percentile_by_class(scores: DataFrame) -> DataFrame:
    """Mean percentile of synthetic and real nodes (``label``)."""
    ranks = rank_normalize(scores)
    return ranks.agg(F.avg(F.when(F.col("label") == 1, F.col("rank"))).alias("synthetic"), F.avg(F.when(F.col("label") == 0, F.col("rank"))).alias("real"))


def evaluate_recovery(scores: DataFrame, rings: DataFrame) -> dict:
    """The evaluation bundle on the driver: a few numbers and the small benchmark table."""
    rows = scores.withColumn("label", is_synthetic().cast("int"))
    found = compute_metrics(rows).first().asDict() | percentile_by_class(rows).first().asDict() | core_auc(scores, rings).first().asDict()
    found["benchmark"] = [r.asDict() for r in benchmark_table(ring_table(scores, rings)).orderBy("ring_type", "tier").collect()]
    return found


def mean_std(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation over seeds, nulls left out."""
    return rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def paired_deltas(rows: DataFrame, first: str, second: str, column: str, by: list[str] | None = None) -> DataFrame:
    """Method ``first`` minus ``second`` on equal seeds: mean, deviation, seeds where it is positive, seeds.

    One conditional aggregation pairs the methods; no self-join.
    """
    by = by or []
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col(column)))
    pairs = rows.groupBy(*by, "seed").agg((pick(first) - pick(second)).alias("d")).filter("d is not null")
    return pairs.groupBy(*by).agg(F.avg("d").alias("delta_mean"), F.stddev_pop("d").alias("delta_std"), F.count_if(F.col("d") > 0).alias("n_positive"), F.count("*").alias("n_seeds"))


def pivot_type_tier(cells: DataFrame, mean: str, std: str, tiers: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """ring_type by tier, as ``mean ± std`` in percent."""
    text = F.format_string("%.1f%% ± %.1f%%", F.col(mean) * 100, F.col(std) * 100)
    return cells.withColumn("cell", text).groupBy("ring_type").pivot("tier", list(tiers)).agg(F.first("cell"))


def slice_metrics(per_seed: DataFrame, columns: list[str]) -> DataFrame:
    """Method tables overall, by type and by tier in one pass, by grouping sets."""
    grouped = per_seed.groupingSets([["method"], ["method", "ring_type"], ["method", "tier"]], "method", "ring_type", "tier")
    return grouped.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """How many ids both sides share."""
    return train.select("node_id").intersect(test.select("node_id")).agg(F.count("*").alias("n_shared"))
