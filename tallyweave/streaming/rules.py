"""The burst and episode rules on unbounded inputs, with watermarks for late rows.

Input columns: node, amount, ts (timestamp).  Results are emitted once a window
or session can no longer change (append mode), so state is bounded by the
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules


def episodes(stream: DataFrame, late: str = "1 hour", hours: int = rules.EPISODE_HOURS) -> DataFrame:
    """node, episode start and end, n, near: the share of amounts just under the threshold."""
    near = F.avg(F.when(F.col("amount").between(rules.NEAR_LOW, rules.NEAR_HIGH), 1.0).otherwise(0.0))
    rows = stream.withWatermark("ts", late).groupBy("node", F.session_window("ts", f"{hours} hours 1 microsecond").alias("w"))
    out = rows.agg(F.count("*").alias("n"), near.alias("near"))
    return out.select("node", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "near")


def smurfing_alerts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return episodes(stream, late).filter(F.col("near") > rules.NEAR_SHARE)


def bursts(stream: DataFrame, late: str = "1 hour", minutes: int = rules.BURST_MINUTES, count: int = rules.BURST_COUNT) -> DataFrame:
    """Sliding windows of ``minutes`` every minute that hold at least ``count`` rows of a node."""
    rows = stream.withWatermark("ts", late).groupBy("node", F.window("ts", f"{minutes} minutes", "1 minute").alias("w"))
    out = rows.agg(F.count("*").alias("n")).filter(F.col("n") >= count)
    return out.select("node", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
