"""Global order without a single task: row numbers, running totals and medians over a whole table or its groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a group whose median one aggregation buffer may hold.
GROUP_ROWS = 1_000_000


def same(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal ``by``, nulls included; the columns of ``by`` stay once."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    right = b.withColumnsRenamed({c: f"_{c}_" for c in by})
    return a.join(right, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by)), how).drop(*[f"_{c}_" for c in by])


def running(df: DataFrame, order: list[Column | str], totals: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``df`` plus, for each name, the sum of its column (never negative) over all rows of the group ``by`` up to and with this one in ``order``.

    Rows are range-partitioned on the group and the whole order, so a large
    group and ties spread too, and the split is written down, as its sampled
    bounds would differ if it ran again.  Sums run inside partitions; the
    partitions' own sums, one row each, give the offsets, and what stands before
    a group is taken off its rows.  ``order`` should decide every pair of rows
    that differ.
    """
    by = by or []
    order = [*by, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.withColumns(totals).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy("_part").agg(*[F.sum(k).alias(f"_{k}") for k in totals])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in totals])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_own_{k}": F.col(k) for k in totals}).withColumns({k: F.sum(k).over(inside) for k in totals}).join(F.broadcast(parts), "_part")
    rows = rows.withColumns({k: F.col(k) + F.col(f"_{k}") for k in totals}).drop("_part", *[f"_{k}" for k in totals])
    if by:
        first = rows.groupBy(*by).agg(*[F.min(F.col(k) - F.col(f"_own_{k}")).alias(f"_first_{k}") for k in totals])
        rows = same(rows, first, by).withColumns({k: F.col(k) - F.col(f"_first_{k}") for k in totals}).drop(*[f"_first_{k}" for k in totals])
    return rows.drop(*[f"_own_{k}" for k in totals])


def numbered(df: DataFrame, order: list[Column | str], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """``df`` plus its row number in ``order``, from 1, in each group ``by``."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, by)


def medians(df: DataFrame, by: list[str], value: str, most: int = GROUP_ROWS, **others: Column) -> DataFrame:
    """by, m (the median of ``value``), and ``others`` (aggregates) of each group, ``by`` being without nulls.

    A group of over ``most`` rows is not buffered by its aggregation: its
    distinct values are counted, and their running counts, which spread over
    tasks, say where its middle lies.
    """
    large = materialize(df.groupBy(*by).agg(F.count(value).alias("_n")).filter(F.col("_n") > most), "large-groups")
    n_large = large.count()
    if not n_large:
        return df.groupBy(*by).agg(F.median(value).alias("m"), *[c.alias(k) for k, c in others.items()])
    keys = F.broadcast(large) if n_large <= 100_000 else large
    rest = df.join(keys, by, "left_anti").groupBy(*by).agg(F.median(value).alias("m"), *[c.alias(k) for k, c in others.items()])
    rows = df.join(keys, by)
    level = running(rows.filter(F.col(value).isNotNull()).groupBy(*by, value, "_n").agg(F.count("*").alias("_c")), [value], {"_to": F.col("_c")}, by)
    at = lambda place: F.max(F.when((F.col("_to") - F.col("_c") <= place) & (F.col("_to") > place), F.col(value)))
    middle = level.groupBy(*by).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).cast("double").alias("m"))
    if others:
        middle = middle.join(rows.groupBy(*by).agg(*[c.alias(k) for k, c in others.items()]), by)
    return rest.unionByName(middle)
