"""Structural features of nodes, from the incidence table in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import materialize
from .graph import incidence

COLUMNS = (
    "is_account", "degree", "in_degree", "out_degree", "txn_count", "total_amount_in", "total_amount_out", "net_flow",
    "mean_amount", "std_amount", "max_amount", "unique_counterparties", "unique_banks", "unique_payment_methods",
    "reversal_count", "active_days", "date_span_days", "txns_per_active_day", "weekend_ratio",
)
#: Columns that stay as they are before scaling.
PLAIN = ("is_account", "weekend_ratio")


def _sums(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = incidence(edges)
    money = F.col("amount").cast("decimal(18,4)")
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, money)), F.lit(0)).cast("double")
    agg = rows.groupBy("node").agg(
        F.count("*").alias("degree"), F.count_if(F.col("direction") == "IN").alias("in_degree"), F.count_if(F.col("direction") == "OUT").alias("out_degree"),
        side("IN").alias("total_amount_in"), side("OUT").alias("total_amount_out"), F.avg("amount").alias("mean_amount"),
        F.stddev_pop("amount").alias("std_amount"), F.max("amount").alias("max_amount"), F.count_if("is_reversal").alias("reversal_count"),
        F.min("parsed_date").alias("_a"), F.max("parsed_date").alias("_b"),
        F.count("parsed_date").alias("_dated"), F.count_if(scalars.is_weekend(F.col("parsed_date"))).alias("_weekend"),
    )
    kind = lambda k, v: F.struct(F.lit(k).alias("k"), F.col(v).cast("string").alias("v") if isinstance(v, str) else v.alias("v"))
    values = rows.select("node", F.explode(F.array(kind("o", "other"), kind("m", "payment_method"), kind("d", F.to_date("parsed_date").cast("string")))).alias("x"))
    values = values.select("node", "x.*").filter("v is not null").distinct()
    banks = nodes.select(F.col("node_id").alias("v"), F.nullif(F.col("bank"), F.lit("")).alias("_bank")).filter("_bank is not null")
    held = values.filter("k = 'o'").join(banks, "v").select("node", F.lit("b").alias("k"), F.col("_bank").alias("v")).distinct()
    of = lambda k: F.count_if(F.col("k") == k)
    counts = values.unionByName(held).groupBy(F.col("node").alias("_node")).agg(of("o").alias("unique_counterparties"), of("b").alias("unique_banks"), of("m").alias("unique_payment_methods"), of("d").alias("active_days"))
    return agg.join(counts, F.col("node") == F.col("_node"), "left").drop("_node")


def node_features(edges: DataFrame, nodes: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """The 19 COLUMNS for every node, with node_id, node_type, label and is_synthetic.

    Sums run in decimal, so they do not depend on the order of rows.  Distinct
    counts are exact: the values of all four kinds are stacked, made distinct
    (which pre-aggregates) and counted, so no buffer holds a hub's values; banks
    come by an equi-join of the distinct neighbours.  ``sums``: what is summed by
    node, where it is known.
    """
    agg = _sums(edges, nodes) if sums is None else sums
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = nodes.join(agg, nodes["node_id"] == agg["node"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("degree", "in_degree", "out_degree", "unique_counterparties", "unique_banks", "unique_payment_methods", "reversal_count", "active_days")}
    zero |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("total_amount_in", "total_amount_out", "mean_amount", "std_amount", "max_amount")}
    out = out.withColumns(zero)
    out = out.withColumns({
        "is_account": (F.col("node_type") == "account").cast("int"), "txn_count": F.col("degree"),
        "net_flow": F.col("total_amount_in") - F.col("total_amount_out"),
        "date_span_days": F.coalesce(F.floor((micros("_b") - micros("_a")) / F.lit(86_400_000_000)), F.lit(0)),
        "txns_per_active_day": F.when(F.col("active_days") > 0, F.col("degree") / F.col("active_days")).otherwise(F.col("degree").cast("double")),
        "weekend_ratio": scalars.safe_divide(F.col("_weekend"), F.col("_dated")),
    })
    return out.select("node_id", "node_type", "label", "is_synthetic", *COLUMNS)


def scale_features(feats: DataFrame, columns: tuple[str, ...] = COLUMNS, bound: float = 8.0) -> DataFrame:
    """Signed logarithms (but for PLAIN), z-scores by population deviation (0 counts as 1), clipped; the statistics are one row."""
    logs = feats.select("node_id", *[(F.col(c).cast("double") if c in PLAIN else scalars.signed_log1p(F.col(c).cast("double"))).alias(c) for c in columns])
    stats = logs.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    wide = logs.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    return wide.select("node_id", *[scalars.clip(z(c), -bound, bound).alias(c) for c in columns])


def of_graph(edges: DataFrame, nodes: DataFrame, most_edges: int | None = None) -> DataFrame:
    """Scaled features of a graph, written once; over ``most_edges`` edges (the trainer's bound) they are summed over packed pairs."""
    from . import descent, model, packed

    large = edges.count() > (model.MOST_PAIRS if most_edges is None else most_edges) and nodes.count() * (len(COLUMNS) + 1) <= descent.MOST_CELLS
    out = materialize(scale_features(node_features(edges, nodes, packed.node_sums(edges, nodes) if large else None)), "features")
    out._tallyweave_nodes = nodes
    return out
