"""Transaction graphs as node and edge tables.

Nodes are accounts and counterparties, edges are transactions (parallel edges
stay).  Matrices are sparse (i, j, w) tables; nothing is dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import materialize, once
from .order import numbered


def _said(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def admitted(txns: DataFrame) -> DataFrame:
    """Transactions that become edges: a counterparty identifier, then an amount."""
    return txns.filter(_said(F.col("counterparty_identifier")) & F.col("amount").isNotNull())


def graph_report(txns: DataFrame) -> DataFrame:
    """One row: transactions seen, edges added, and the rejections, each counted once and in that order."""
    no_id = ~F.coalesce(_said(F.col("counterparty_identifier")), F.lit(False))
    no_amount = ~no_id & F.col("amount").isNull()
    undated = ~no_id & ~no_amount & scalars.parse_date(F.col("date")).isNull()
    count = lambda c, name: F.count_if(c).alias(name)
    return txns.agg(
        F.count("*").alias("n_transactions"), count(~no_id & ~no_amount, "n_edges"), count(no_id, "skipped_no_identifier"),
        count(no_amount, "skipped_no_amount"), count(undated, "undated_edges"),
    )


def build_edges(txns: DataFrame) -> DataFrame:
    """src, dst and what an edge carries.  A debit runs from the account, anything else to it."""
    acc, cp = scalars.account_node(F.col("account_id")), scalars.counterparty_node(F.col("counterparty_identifier"))
    out = F.coalesce(F.col("direction") == "DEBIT", F.lit(False))
    rows = admitted(txns)
    seq = F.col("txn_seq") if "txn_seq" in txns.columns else F.lit(None).cast("bigint")
    return rows.select(
        F.when(out, acc).otherwise(cp).alias("src"), F.when(out, cp).otherwise(acc).alias("dst"), "amount", "date",
        scalars.parse_date(F.col("date")).alias("parsed_date"), "payment_method", "transaction_id", "is_reversal", "source_file",
        F.lit(False).alias("is_synthetic"), F.lit(None).cast("int").alias("ring_id"), F.lit(None).cast("string").alias("ring_type"),
        F.lit(None).cast("boolean").alias("is_noise"), seq.alias("edge_seq"),
    )


def build_nodes(txns: DataFrame) -> DataFrame:
    """One row per node; the first transaction that names it gives its label and bank.  Minima pre-aggregate, hubs included."""
    rows = admitted(txns)
    place = F.col("txn_seq") * 2
    acc = rows.select(
        scalars.account_node(F.col("account_id")).alias("node_id"), F.lit("account").alias("node_type"), F.col("account_id").alias("label"),
        F.lit(None).cast("string").alias("bank"), place.alias("node_seq"),
    )
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("counterparty_name", "counterparty_label", "counterparty_identifier")])
    cp = rows.select(
        scalars.counterparty_node(F.col("counterparty_identifier")).alias("node_id"), F.lit("counterparty").alias("node_type"), name.alias("label"),
        F.col("counterparty_bank").alias("bank"), (place + 1).alias("node_seq"),
    )
    named = acc.unionByName(cp).groupBy("node_id", "node_type", "label", "bank").agg(F.min("node_seq").alias("node_seq"))  # a hash of longs; minima of structs are sorted
    first = named.groupBy("node_id").agg(F.min(F.struct("node_seq", "node_type", "label", "bank")).alias("f"))
    return first.select("node_id", "f.node_type", "f.label", "f.bank", F.lit(False).alias("is_synthetic"), "f.node_seq")


def incidence(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: node, other, direction (OUT, IN) and the edge's own columns; a union, not a join."""
    keep = [c for c in ("amount", "parsed_date", "payment_method", "is_reversal", "edge_seq") if c in edges.columns]
    end = lambda a, b, d: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(d).alias("direction"), *keep)
    return end("src", "dst", "OUT").unionByName(end("dst", "src", "IN"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Transactions between each ordered pair, both ways; a self-loop counts twice."""
    both = edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(edges.select(F.col("dst").alias("i"), F.col("src").alias("j")))
    return both.groupBy("i", "j").agg(F.count("*").alias("w"))


def pair_sums(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum(F.log1p("amount")).alias("log_amount"), F.count("*").alias("n"))


def directed_channels(edges: DataFrame) -> DataFrame:
    """channel, i, j, w: amounts and counts, each row-normalised outwards and (transposed) inwards.  A row of zeros stays zero.

    The four channels share one aggregation; the totals of a node's rows are
    aggregates joined back, so a hub's pairs need not meet in one task.
    """
    pairs = once(edges, "pair-sums", pair_sums)  # training and embedding share it
    total = lambda by, a, c: pairs.groupBy(by).agg(F.sum("log_amount").alias(a), F.sum("n").alias(c))
    rows = pairs.join(total("src", "sa", "sc"), "src").join(total("dst", "da", "dc"), "dst")
    share = lambda c, t: scalars.safe_divide(F.col(c), F.col(t))
    rows = rows.withColumns({"ao": share("log_amount", "sa"), "co": share("n", "sc"), "ai": share("log_amount", "da"), "ci": share("n", "dc")})
    one = lambda name, i, j, w: F.struct(F.lit(name).alias("channel"), F.col(i).alias("i"), F.col(j).alias("j"), F.col(w).alias("w"))
    every = F.array(one("amount_out", "src", "dst", "ao"), one("amount_in", "dst", "src", "ai"), one("count_out", "src", "dst", "co"), one("count_in", "dst", "src", "ci"))
    return rows.select(F.explode(every).alias("x")).select("x.*")


def positive_pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def degree_norm(adj: DataFrame) -> DataFrame:
    """i, j, w of the symmetric normalisation of the pattern of ``adj`` with self-loops."""
    loops = adj.select("i").distinct().select("i", F.col("i").alias("j"))
    pattern = adj.select("i", "j").unionByName(loops).distinct()
    degree = pattern.groupBy("i").agg(F.count("*").alias("d"))
    a, b = degree.withColumnsRenamed({"d": "di"}), degree.withColumnsRenamed({"i": "j", "d": "dj"})
    return pattern.join(a, "i").join(b, "j").select("i", "j", (1 / (F.sqrt("di") * F.sqrt("dj"))).alias("w"))


def propagate(channels: DataFrame, features: DataFrame, columns: list[str], node: str = "node_id") -> DataFrame:
    """``A X`` for every channel: a join on j and sums by (channel, i); weights do not enter, so it is done once, not per epoch."""
    rows = channels.join(features.select(F.col(node).alias("j"), *columns), "j")
    return rows.groupBy("channel", "i").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) induced by all nodes within ``hops`` undirected steps of the seeds (node)."""
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")))
    found = seeds.select("node").distinct()
    for _ in range(hops):
        found = found.unionByName(pairs.join(found, "node", "left_semi").select(F.col("to").alias("node"))).distinct()
    inside = edges.join(found.withColumnRenamed("node", "src"), "src", "left_semi").join(found.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return found, inside


def node_index(nodes: DataFrame, order: str = "node_seq") -> DataFrame:
    """node_id and its dense position, from 0, in ``order``."""
    return numbered(nodes.select("node_id", order), [order, "node_id"], "idx").select("node_id", (F.col("idx") - 1).alias("idx"))


def negative_pairs(edges: DataFrame, nodes: DataFrame, per_positive: int = 1, seed: int = 0) -> DataFrame:
    """Random ordered pairs of different nodes without an edge either way, as many as ``per_positive`` times the positive pairs.

    Seeded draws are numbered by a dense index of the nodes and those that hit
    an edge or an earlier pair are drawn again, until the count is met; where
    few pairs are free beside the count, all of them are listed and those of
    the least hash are taken, so a dense graph ends too.
    """
    spark = edges.sparkSession
    index = materialize(node_index(nodes), "index")
    n = index.count()
    both = materialize(adjacency(edges).filter("i != j").select("i", "j"), "pairs")
    free = n * (n - 1) - both.count()
    wanted = min(positive_pairs(edges).count() * per_positive, free)
    name = lambda c, as_: index.select(F.col("idx").alias(c), F.col("node_id").alias(as_))
    found, left, salt = spark.createDataFrame([], "i string, j string"), wanted, 0
    while left > 0:
        if free <= 8 * wanted:
            drawn = index.select(F.col("node_id").alias("i")).crossJoin(index.select(F.col("node_id").alias("j"))).filter("i != j")  # within nine times what is returned, and the edges
        else:
            draw = lambda end: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), F.lit(end)), F.lit(n))  # noqa: B023,E731
            drawn = spark.range(left + left // 4 + 64).select(draw("a").alias("a"), draw("b").alias("b")).filter("a != b").distinct()
            drawn = drawn.join(name("a", "i"), "a").join(name("b", "j"), "b").select("i", "j")
        fresh = drawn.join(both, ["i", "j"], "left_anti").join(found, ["i", "j"], "left_anti").withColumn("h", F.xxhash64("i", "j", F.lit(seed)))
        fresh = numbered(fresh, ["h", "i", "j"]).filter(F.col("rn") <= left).select("i", "j")
        found = materialize(found.unionByName(fresh), "negatives")
        left, salt = wanted - found.count(), salt + 1
    return found
