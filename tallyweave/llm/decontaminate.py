"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (powers of two of their distinct shingles).  In a
partition each item is represented by its minimum hashes, as many as make the
search complete: an item of q shingles that a document holds to 75 % misses at
most ``q - ceil(0.75 q)`` of them, so one more minimum than that always meets
the document.  Each partition has its own bound, the largest minimum in it, and
the size a document needs for its smallest item: a document looks up only those
of its hashes that some partition within its size still takes, so short ones
skip the partitions of large items, and a hash above a partition's bound does
not meet its items.  (How much of the hash space a bound covers depends on the
items: about half of it where they have 15 to 60 words, next to all of it for
items of a single shingle.)  Candidates are then verified exactly, on the
shingles themselves.

Texts are lower-cased, everything but letters and digits parts words, shingles
are five words.  Defined cases.  An item or document of fewer words has its
whole sequence as its one shingle, so such an item is found only in a document
of just those words; one without words (or null) has none and matches nothing.
Repeated rows of one (doc_id, text) give one result row; null ids are kept as
they are.  Ties cannot occur: every pair that reaches the threshold is returned,
without a cap.  Empty tables give empty results.  Extra columns of any name pass
through :func:`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
CONTAINED = 0.75


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def _windows(words: str, one) -> Column:
    """``one(i)`` for each window start; a window of the whole sequence where there are fewer words; none without words."""
    n = F.size(words)
    return F.when(n == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), one))


def _hashes(words: str) -> Column:
    get = lambda i: F.get(F.col(words), i)  # noqa: E731  (nulls beyond the end hash to nothing)
    return _windows(words, lambda i: F.xxhash64(*[get(i + k) for k in range(WORDS)]))


def shingles(words: str) -> Column:
    return F.array_distinct(_windows(words, lambda i: F.array_join(F.slice(F.col(words), i + 1, WORDS), " ")))


def sketches(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """_h, _item, _part (size partition), _least (shingles a document needs): the minima of each item."""
    rows = items.select(F.col("item_id").alias("_item"), tokens(F.col("text")).alias("_w"))
    rows = rows.withColumn("_m", F.sort_array(F.array_distinct(_hashes("_w")))).filter(F.size("_m") > 0)
    rows = rows.withColumns({"_q": F.size("_m"), "_least": F.ceil(F.size("_m") * contained).cast("int"), "_part": F.floor(F.log2(F.size("_m"))).cast("int")})
    return rows.select(F.explode(F.slice("_m", F.lit(1), F.col("_q") - F.col("_least") + 1)).alias("_h"), "_item", "_part", "_least")


def candidates(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, _t (hash of the text), _item: pairs that share a minimum within the item's partition."""
    sketch = common.materialize(sketches(items, contained).distinct(), "sketches")
    # one row per power of two: a few dozen at most
    parts = sketch.groupBy("_part").agg(F.count("*").alias("n"), F.max("_h").alias("bound"), F.min("_least").alias("least")).collect()
    docs = docs.select("doc_id", F.xxhash64("text").alias("_t"), tokens(F.col("text")).alias("_w"))
    docs = docs.select("doc_id", "_t", F.greatest(F.size("_w") - (WORDS - 1), F.lit(1)).alias("_n"), _hashes("_w").alias("_m"))
    highest = F.lit(-(2**63)).cast("long")
    for p in parts:
        highest = F.greatest(highest, F.when(F.col("_n") >= p.least, F.lit(p.bound)))
    low = docs.withColumn("_b", _once(highest)).select("doc_id", "_t", "_n", F.explode(F.filter("_m", lambda h: h <= F.col("_b"))).alias("_h"))
    met = low.join(common.small(sketch.withColumnRenamed("_h", "_k"), sum(p.n for p in parts)), (F.col("_h") == F.col("_k")) & (F.col("_n") >= F.col("_least")))
    return met.select("doc_id", "_t", "_item").distinct()


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, _t, item_id, item_shingles, common, containment of every pair at or over the threshold."""
    docs = docs.select("doc_id", "text")
    found = candidates(docs, items, contained).withColumnsRenamed({"doc_id": "_d", "_t": "_u"})
    own = items.select(F.col("item_id").alias("_i"), tokens(F.col("text")).alias("_v"))
    own = common.materialize(own.select("_i", shingles("_v").alias("_of")).filter(F.size("_of") > 0).distinct(), "item-shingles")
    own = _broadcast(own, own.agg(F.sum(_bytes("_of"))).first()[0])
    # a document meets all its items at once: its shingles are made once and never copied
    met = found.join(own, F.col("_item").eqNullSafe(F.col("_i"))).groupBy("_d", "_u").agg(F.collect_list(F.struct("_i", "_of")).alias("_items"))
    met = common.materialize(met, "leak-candidates")
    met = _broadcast(met, met.agg(F.sum(F.aggregate(F.transform("_items", lambda x: _bytes(x["_of"])), F.lit(0).cast("long"), lambda a, x: a + x))).first()[0])
    rows = docs.withColumn("_t", F.xxhash64("text")).join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")))
    rows = rows.withColumn("_w", tokens(F.col("text"))).select("doc_id", "_t", "_items", _once(shingles("_w")).alias("_has"))
    count = lambda x: F.struct(x["_i"].alias("item_id"), F.size(x["_of"]).cast("long").alias("item_shingles"), F.size(F.array_intersect("_has", x["_of"])).cast("long").alias("common"))
    rows = rows.select("doc_id", "_t", F.explode(F.transform("_items", count)).alias("_x")).select("doc_id", "_t", "_x.*")
    rows = rows.withColumn("containment", F.col("common") / F.col("item_shingles"))
    return rows.filter(F.col("common") >= F.ceil(F.col("item_shingles") * contained)).distinct()


def _once(value: Column) -> Column:
    """``value`` computed once a row: a plain column would be worked out again for each element of an array that asks for it."""
    return F.explode(F.array(value))


def _bytes(strings) -> Column:
    return F.aggregate(strings, F.lit(40).cast("long"), lambda a, x: a + F.length(x) + 16)


def _broadcast(df: DataFrame, weight: int | None) -> DataFrame:
    return F.broadcast(df) if (weight or 0) <= common.BROADCAST_BYTES else df


def decontaminate(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents that hold no item.  All columns stay."""
    bad = common.materialize(leaks(docs, items, contained).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).distinct(), "leaking")
    bad = common.small(bad, bad.count())
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    rows = rows.join(bad, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left_anti")
    return rows.select("_row.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return leaks(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text")).drop("_t")
