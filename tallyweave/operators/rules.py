"""Deterministic behavioural rules over the incidence table.

Every rule flags rows and reduces them to one 0/1 score per node; account and
counterparty nodes are treated alike.  Thresholds are parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order import medians

BURST_MINUTES, BURST_COUNT = 10, 5
HIGH_FACTOR, HIGH_FLOOR = 5.0, 5000.0
SPIKE_DAYS, SPIKE_FACTOR, SPIKE_FLOOR = 7, 4.0, 10000.0
REPEAT_COUNT, REPEAT_HOURS, REPEAT_SHARE = 3, 24, 0.02
NEAR_LOW, NEAR_HIGH, EPISODE_HOURS, NEAR_SHARE = 9000.0, 9999.0, 24, 0.50

STUBS = ("excessive_withdrawal", "late_night", "balance_drop", "circular_return", "bidirectional")


def _score(rows: DataFrame, flag) -> DataFrame:
    return rows.groupBy("node").agg(F.max(F.when(flag, 1.0).otherwise(0.0)).alias("score"))


#: Frames run inside cells of so many of their lengths: a busy node is many tasks, and few rows stand in two cells.
CELL_FRAMES = 64


def _cells(rows: DataFrame, before: int, after: int) -> DataFrame:
    """``rows`` (with _us) in time cells: _cell, and _own (false: the row is only there for frames that reach over the edge)."""
    width = max(before + after, 1) * CELL_FRAMES
    cell = F.floor(F.col("_us") / width)
    # a row is seen by frames that start up to ``after`` before it and end up to ``before`` after it
    first, last = F.floor((F.col("_us") - after) / width), F.floor((F.col("_us") + before) / width)
    return rows.withColumn("_cell", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_cell") == cell)


def _dated(inc: DataFrame) -> DataFrame:
    return inc.filter(F.col("parsed_date").isNotNull()).withColumn("_us", F.unix_micros(F.col("parsed_date").cast("timestamp")))


def burst_counts(inc: DataFrame, minutes: int = BURST_MINUTES) -> DataFrame:
    """Dated rows with the number of the node's rows within half the window on either side, itself included."""
    half = minutes * 60 * 1_000_000 // 2
    near = Window.partitionBy("node", "_cell").orderBy("_us").rangeBetween(-half, half)
    rows = _cells(_dated(inc), half, half).withColumn("nearby", F.count("*").over(near))
    return rows.filter("_own").drop("_us", "_cell", "_own")


def burst(inc: DataFrame, minutes: int = BURST_MINUTES, count: int = BURST_COUNT) -> DataFrame:
    return _score(burst_counts(inc, minutes), F.col("nearby") >= count)


def high_value(inc: DataFrame, factor: float = HIGH_FACTOR, floor: float = HIGH_FLOOR) -> DataFrame:
    """Amounts over ``factor`` times the median of the node's own direction, and over ``floor``.

    Only the largest amount of a (node, direction) can decide, so the median and
    the maximum meet in one aggregation and no row is joined back.
    """
    by = medians(inc, ["node", "direction"], "amount", x=F.max("amount"))
    return _score(by, (F.col("m") > 0) & (F.col("x") > factor * F.col("m")) & (F.col("x") > floor))


def spending_spike(inc: DataFrame, days: int = SPIKE_DAYS, factor: float = SPIKE_FACTOR, floor: float = SPIKE_FLOOR) -> DataFrame:
    """A day's outgoing total over ``factor`` times the median day's, and over ``floor``, for nodes with enough days."""
    out = inc.filter((F.col("direction") == "OUT") & F.col("parsed_date").isNotNull())
    daily = out.groupBy("node", F.to_date("parsed_date").alias("day")).agg(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("total"))
    by = daily.groupBy("node").agg(F.count("*").alias("n"), F.median("total").alias("m"), F.max("total").alias("x"))  # as many as days
    return _score(by, (F.col("n") >= days) & (F.col("x") > factor * F.col("m")) & (F.col("x") > floor))


def repeated(inc: DataFrame, count: int = REPEAT_COUNT, hours: int = REPEAT_HOURS, share: float = REPEAT_SHARE) -> DataFrame:
    """A row with ``count - 1`` others between the same two nodes within ``hours`` and ``share`` of its own amount.

    Pairs of nodes with too few rows go first, so that only the others' rows are
    exchanged; rows of equal time and amount are counted.  The others stand in
    cells of time and of the logarithm of the amount, each as wide as the largest distance, so a partner is in the same
    cell or the next; a busy pair of nodes is many small join keys.
    """
    us, band = hours * 3600 * 1_000_000, -math.log(1 - share) * (1 + 1e-9)
    rows = _dated(inc).select("node", "other", "amount", F.col("_us").alias("t"))
    busy = rows.groupBy("node", "other").agg(F.count("*").alias("c")).filter(F.col("c") >= count).select("node", "other")
    rows = rows.filter("amount is not null").join(materialize(busy, "busy"), ["node", "other"], "left_semi")
    rows = materialize(rows.groupBy("node", "other", "t", "amount").agg(F.count("*").alias("k")), "busy-pairs")
    place = F.when(F.col("amount") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("amount")) / band))
    rows = rows.withColumns({"cell": F.floor(F.col("t") / us), "side": F.signum("amount").cast("int"), "band": place})
    near = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)]))
    left = rows.drop("k").withColumn("cell", near("cell")).withColumn("band", near("band"))
    right = rows.select("node", "other", "cell", "side", "band", F.col("t").alias("u"), F.col("amount").alias("b"), F.col("k").alias("kb"))
    alike = F.when(F.col("amount") == 0, F.col("b") == 0).otherwise(F.abs(F.col("b") - F.col("amount")) / F.abs("amount") <= share)
    met = left.join(right, ["node", "other", "cell", "side", "band"]).filter((F.abs(F.col("u") - F.col("t")) <= us) & alike)
    flagged = met.groupBy("node", "other", "t", "amount").agg(F.sum("kb").alias("n")).filter(F.col("n") >= count).select("node").distinct()
    return inc.select("node").distinct().join(flagged.withColumn("score", F.lit(1.0)), "node", "left").fillna(0.0, ["score"])


def episodes(inc: DataFrame, hours: int = EPISODE_HOURS) -> DataFrame:
    """Dated rows with their episode: a new one begins after a gap of more than ``hours``; rows of one time share it."""
    us = hours * 3600 * 1_000_000
    rows = _dated(inc)
    by = Window.partitionBy("node").orderBy("_us")
    rows = rows.withColumn("_new", F.when(F.col("_us") - F.lag("_us").over(by) > us, 1).otherwise(0))
    return rows.withColumn("episode", F.sum("_new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_us", "_new")


def smurfing_episode(inc: DataFrame, low: float = NEAR_LOW, high: float = NEAR_HIGH, hours: int = EPISODE_HOURS, share: float = NEAR_SHARE) -> DataFrame:
    """An episode most of whose amounts lie just under the reporting threshold.

    No gap inside a cell of ``hours`` ends an episode, so rows are first summed
    by cell; episodes are then found among a node's cells, as many as its days.
    """
    us = hours * 3600 * 1_000_000
    rows = _dated(inc)
    near = F.count_if(F.col("amount").between(low, high))
    cells = rows.groupBy("node", F.floor(F.col("_us") / us).alias("cell")).agg(F.min("_us").alias("a"), F.max("_us").alias("b"), F.count("*").alias("n"), near.alias("near"))
    by = Window.partitionBy("node").orderBy("cell")
    cells = cells.withColumn("new", F.when(F.col("a") - F.lag("b").over(by) > us, 1).otherwise(0)).withColumn("episode", F.sum("new").over(by))
    sums = cells.groupBy("node", "episode").agg((F.sum("near") / F.sum("n")).alias("near"))
    return _score(sums, F.col("near") > share)


def smurfing_session(inc: DataFrame, low: float = NEAR_LOW, high: float = NEAR_HIGH, hours: int = EPISODE_HOURS, share: float = NEAR_SHARE) -> DataFrame:
    """The same by session windows, which also run on streams."""
    rows = inc.filter(F.col("parsed_date").isNotNull()).withColumn("_t", F.col("parsed_date").cast("timestamp"))
    # a session ends a gap after its last row, exclusive: a microsecond more keeps gaps of exactly ``hours`` together
    gap = f"{hours} hours 1 microsecond"
    by = rows.groupBy("node", F.session_window("_t", gap)).agg(F.avg(F.when(F.col("amount").between(low, high), 1.0).otherwise(0.0)).alias("near"))
    return _score(by, F.col("near") > share)


def stub(name: str, nodes: DataFrame) -> DataFrame:
    """Rules whose inputs edges do not carry (balances, times of day) score 0."""
    if name not in STUBS:
        raise KeyError(name)
    return nodes.select(F.col("node_id").alias("node"), F.lit(0.0).alias("score"))


RULES = {"burst": burst, "high_value": high_value, "spending_spike": spending_spike, "repeated_transaction": repeated, "smurfing_episode": smurfing_episode}


def combined(inc: DataFrame, nodes: DataFrame | None = None, written: bool = False, **changed) -> DataFrame:
    """node_id, the score of each rule and their maximum, for every node (of ``inc`` where no nodes are given).

    The rows that the rules read are written once, unless they come from
    ``written`` tables.  Each rule's scores, a row a node, are written in turn, so
    that its exchanges are gone when the next begins.  Scores are stacked and
    pivoted in one aggregation instead of joined five times.  ``changed`` maps a
    rule's name to its keyword arguments.
    """
    inc = inc.select("node", "other", "direction", "amount", "parsed_date")
    inc = inc if written else materialize(inc, "incidence")
    nodes = inc.select(F.col("node").alias("node_id")).distinct() if nodes is None else nodes
    stacked = nodes.select(F.col("node_id").alias("node"), F.lit("").alias("rule"), F.lit(0.0).alias("score"))
    for name, rule in RULES.items():
        scores = rule(inc, **changed.get(name, {})).select("node", F.lit(name).alias("rule"), "score")
        stacked = stacked.unionByName(materialize(scores, "rule-scores"))
    score = lambda n: F.coalesce(F.max(F.when(F.col("rule") == n, F.col("score"))), F.lit(0.0)).alias(n)
    wide = stacked.groupBy(F.col("node").alias("node_id")).agg(*[score(n) for n in RULES])
    wide = wide.withColumns({n: F.lit(0.0) for n in STUBS})
    return wide.withColumn("combined", F.greatest(*RULES, *STUBS))


def burst_volume(inc: DataFrame, minutes: int = 10, count: int = 4, floor: float = 10000.0) -> DataFrame:
    """A forward window of ``minutes`` with at least ``count`` rows and over ``floor`` in all, graded by its count."""
    us = minutes * 60 * 1_000_000
    ahead = Window.partitionBy("node", "_cell").orderBy("_us").rangeBetween(0, us)
    rows = _cells(_dated(inc), 0, us).withColumns({"n": F.count("*").over(ahead), "a": F.sum(F.col("amount").cast("decimal(18,4)")).over(ahead)})
    graded = F.least(F.lit(1.0), (F.col("n") - (count - 1)) / 6)
    return rows.filter("_own").groupBy("node").agg(F.max(F.when((F.col("n") >= count) & (F.col("a") > floor), graded).otherwise(0.0)).alias("score"))


#: Stubs of the fourth version.
PLAIN_STUBS = ("money_flow", "circular_return")


def combined_plain(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    """The fourth version: graded bursts, the plain share near the threshold, the stubs, and their maximum, for every node."""
    inc = materialize(inc.select("node", "amount", "parsed_date"), "incidence")
    out = nodes.select("node_id")
    for name, rule in (("burst", burst_volume(inc)), ("smurfing_proximity", near_share(inc))):
        out = out.join(rule.select(F.col("node").alias("node_id"), F.col("score").alias(name)), "node_id", "left").fillna(0.0, [name])
    out = out.withColumns({n: F.lit(0.0) for n in PLAIN_STUBS})
    return out.withColumn("combined", F.greatest("burst", "smurfing_proximity", *PLAIN_STUBS))


def near_share(inc: DataFrame, low: float = NEAR_LOW, high: float = NEAR_HIGH) -> DataFrame:
    """The share of a node's amounts just under the reporting threshold."""
    return inc.groupBy("node").agg(F.avg(F.when(F.col("amount").between(low, high), 1.0).otherwise(0.0)).alias("score"))
