"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the token budget and a linear weight schedule
``w(t) = a + b t`` over training time ``t`` in [0, 1).  A source's documents
form a stream in hash order, repeated for a second pass; the mix takes the
stream's first ``target`` words.  The integral of the schedule is the source's
cumulative token demand; inverting it (a quadratic) at a document's place in
the stream gives its training position, and the mix is range-sorted by it.

A source may hold any share of the rows: running totals are two-level, inside
4096 hash bins of a source and then over the bins' sums, so no task holds a source.

Defined cases.  Null or empty texts have size 0, are taken 0 words and keep no
place in the stream.  A null source is a source of its own, last in order.
Repeated rows are separate documents.  The order of a stream is the digest of
doc_id and text, so reruns agree; ties are equal rows, which are exchangeable.
An empty table gives an empty result.  Extra columns pass through :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from . import common

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: (a, b) of the schedule, by the source's place: rising, falling, level.
SCHEDULES = ((0.5, 1.0), (1.5, -1.0), (1.0, 0.0))


def _turn(values: tuple, place: Column) -> Column:
    out = F.lit(float(values[-1]))
    for k in range(len(values) - 1):
        out = F.when(F.pmod(place - 1, F.lit(len(values))) == k, F.lit(float(values[k]))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """_src, source_size, place, target: the budget shared by weight, stopped at ``most`` times the source.

    ``sizes`` (_src, _size) is small or written down: it is read once a round.
    A round shares what the stopped sources leave by the weights of the others;
    each stops at least one more source, and a handful of rounds settles it.
    Rounds are aggregations, and places come from a range sort, so no task
    holds all sources.
    """
    one = sizes.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    one = numbered(one, [F.col("_src").asc_nulls_last()], "place")
    one = one.withColumn("_w", _turn(weights, F.col("place"))).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    one = common.materialize(one, "sources")
    total, weight = one.agg(F.sum("source_size"), F.sum("_w")).first()
    level = budget * (total or 0) / (weight or 1)
    while True:
        free = F.col("_cap") >= level * F.col("_w")
        stopped, weight = one.agg(F.sum(F.when(~free, F.col("_cap"))), F.sum(F.when(free, F.col("_w")))).first()
        if not weight:
            return one.select("_src", "source_size", "place", F.col("_cap").alias("target"))
        now = (budget * (total or 0) - (stopped or 0.0)) / weight
        if now <= level:
            break
        level = now
    return one.select("_src", "source_size", "place", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def _keyed(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, ``carry``, _src, _size, _key (a digest of doc_id and text) and _bin of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    rows = docs.select(*carry, "doc_id", F.col("source").alias("_src"), F.size(common.words(F.col("text"))).cast("long").alias("_size"), key.alias("_key"))
    return rows.withColumn("_bin", F.substring("_key", 1, 3))


def plan(docs: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, _src, _key, _copy (of how many equal rows, _copies), _size, source_size, target, taken_1, taken_2 and the positions of both passes.

    Only digests and numbers are shuffled.  Equal rows count as one block of the
    stream and are told apart by _copy.
    """
    rows = _keyed(docs).groupBy("_src", "_bin", "_key", "doc_id").agg(F.count("*").alias("_copies"), F.max("_size").alias("_size"))
    rows = common.materialize(rows, "sizes")
    bins = common.materialize(rows.groupBy("_src", "_bin").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_sum")), "bins")
    to = targets(bins.withColumnRenamed("_sum", "_size"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy("_src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("_start", start).drop("_sum")
    bins = bins.withColumnsRenamed({"_src": "_s", "_bin": "_b"}).join(to, F.col("_s").eqNullSafe(F.col("_src")))
    bins = bins.drop("_src")
    inside = Window.partitionBy("_src", "_bin").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_off", F.coalesce(F.sum(F.col("_size") * F.col("_copies")).over(inside), F.lit(0)))
    out = rows.join(bins, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    whole = F.floor(F.col("target") + 0.5)
    first = F.col("_start") + F.col("_off") + F.col("_size") * (F.col("_copy") - 1)
    take = lambda at: F.greatest(F.lit(0), F.least(F.col("_size"), whole - at)).cast("long")
    out = out.withColumns({"taken_1": take(first), "taken_2": take(first + F.col("source_size"))})
    a, b = _turn([s[0] for s in schedules], F.col("place")), _turn([s[1] for s in schedules], F.col("place"))

    def position(at: Column) -> Column:
        """The time t by which ``at`` words are due: (a t + b t^2 / 2) / (a + b / 2) = at / target."""
        due = F.least(F.lit(1.0), at / F.col("target")) * (a + b / 2)
        return 2 * due / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * b * due)))

    return out.select(
        "doc_id", F.col("_s").alias("_src"), "_key", "_copy", "_copies", "_size", "source_size", "target", "taken_1", "taken_2",
        F.when(F.col("taken_1") > 0, position(first)).alias("position_1"),
        F.when(F.col("taken_2") > 0, position(first + F.col("source_size"))).alias("position_2"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The training stream: a row for each pass over a document, with mix_pass, mix_taken and mix_position, range-sorted by position.

    The plan is joined back by digest (equal rows by their copy's number too), so
    texts move once, in the sort, where the plan is small enough to broadcast,
    and once more where it is not.
    """
    columns = docs.columns
    passes = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"taken_{k}").alias("t"), F.col(f"position_{k}").alias("p")) for k in (1, 2)]), lambda x: x["t"] > 0)
    todo = common.materialize(plan(docs.select("doc_id", "source", "text")).select("_src", "_key", "_copy", "_copies", passes.alias("_x")).filter(F.size("_x") > 0), "mix-plan")
    todo = todo.withColumnsRenamed({"_src": "_s", "_key": "_k", "_copy": "_c"})
    once, again = todo.filter("_copies = 1"), todo.filter("_copies > 1")
    n_once, n_again = (x.count() for x in (once, again))
    rows = _keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"), "_row").select("_row", "_src", "_key")
    same = F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k"))
    out = rows.join(common.small(once, n_once), same).select("_row", "_x")
    if n_again:
        keys = again.select("_s", "_k").distinct()
        equal = rows.join(common.small(keys, n_again), same, "left_semi").withColumn("_u", F.monotonically_increasing_id())
        equal = numbered(equal, ["_u"], "_n", ["_src", "_key"])  # equal rows are exchangeable; however many, they stay in many tasks
        out = out.unionByName(equal.join(common.small(again, n_again), same & (F.col("_n") == F.col("_c"))).select("_row", "_x"))
    out = out.withColumn("_x", F.explode("_x"))
    own = {"mix_pass": F.col("_x.k"), "mix_taken": F.col("_x.t"), "mix_position": F.col("_x.p")}
    out = out.select(*[F.col("_row")[c].alias(c) for c in columns if c not in own], *[v.alias(k) for k, v in own.items()])
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    rows = plan(common.read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.coalesce("position_1", F.lit(1.0))
    rows = rows.repartitionByRange(n, first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("taken_1") + F.col("taken_2")).alias("taken"), F.round("position_1", 9).alias("position_1"), F.round("position_2", 9).alias("position_2"))
