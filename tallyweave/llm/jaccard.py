"""N-gram Jaccard join: documents whose sets of five-word shingles are at least 75 % alike, as components.

1. A first pass counts all documents' shingles in 65,536 cells of the hash
   space.  Cells that hold clearly more than their share hold shingles of many
   documents; how much more ranks them.  Rank, then value, is one order of all
   shingles, the rare first, that every task knows from a table of fixed size.
2. A second pass turns each text into its set of 64-bit shingle hashes, of which
   it keeps the set's size, a class hash (equal sets are one class, so verbatim
   copies never meet again) and the first ``n - ceil(0.75 n) + 1 + ceil(n/20)``
   hashes in that order.  Similar sets share more than ``ceil(n/20)`` of these.
3. The kept hashes are counted exactly over all classes; of that surplus the
   most frequent may be left out on either side, and the rarest shared hash still
   stays.  A hash that one class alone holds needs no partner and goes at once.
4. Each remaining prefix hash is a bucket; its least class is the bucket's
   pivot, and the buckets of one pivot form one group.  A class without another
   of fitting length in a group leaves it before any text moves.  A group is
   verified in pairs of blocks of bounded size, so one large group is many tasks;
   a pair of a block needs a shared prefix hash, passes the length, positional
   and suffix (cells of the hash space) filters, and is then counted exactly,
   unless links found before connect it already.  A pair is left to the group
   of the least pivot that both sides know, so it is verified once.
5. Blocks return spanning links only; components follow by star contraction.

Defined cases.  A null text is empty; without words a document has no shingles
and links with nothing.  With fewer than five words the whole sequence is the
one shingle.  A null doc_id links like any other but is never a component_id
(a component of null ids only has null).  Repeated rows are one class.  An empty
table gives an empty result.  Extra columns pass through :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkernel
from .components import components

#: A block holds so many classes and shingles at most, whichever comes first.
BLOCK, BLOCK_SHINGLES = 1024, 200_000
CELLS = 64
SURPLUS = 20  # one shingle in so many is looked up beyond the plain prefix
#: Bits of a hash that name its counting cell; a cell is heavy when it holds so much more than the mean.
CELL_BITS, HEAVY = 16, 0.1

_SIG = "doc_id bigint, t bigint, n bigint, cls bigint, pre array<bigint>"


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes kept by value, and how many of them stay after the rare-first cut."""
    need = (3 * n + 3) // 4
    kept = np.minimum(n, n - need + 1 + -(-n // SURPLUS))
    # what the smallest possible partner has as surplus may go, no more
    return kept, kept - np.minimum(-(-need // SURPLUS), np.maximum(kept - 1, 0))


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    for at, offs, raw in textkernel.chunks(texts):
        h, row = textkernel.distinct(*textkernel.shingles(textkernel.words(offs, raw)))
        yield at, h, row, len(offs) - 1


@textkernel.releasing
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each cell, one row a cell and task."""
    total = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for batch in batches:
        for _, h, _, _ in _sets(batch.column(0)):
            total += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def ranks(docs: DataFrame) -> np.ndarray:
    """How far each cell is over its share of all shingles, in powers of two of HEAVY; 0 for the most."""
    common.ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_counts, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # as many as there are cells
    out = np.zeros(1 << CELL_BITS)
    for r in rows:
        out[r.cell] = r.n
    over = out / max(out.mean(), 64) - 1  # fewer than so many a cell tell nothing
    return np.where(over > HEAVY, 1 + np.floor(np.log2(np.maximum(over, HEAVY) / HEAVY)), 0).astype(np.uint8)


@textkernel.releasing
def _signatures(rank: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, t, texts = batch.column(0), batch.column(1), batch.column(2)
        for at, h, row, rows in _sets(texts):
            n = np.bincount(row, minlength=rows).astype(np.int64)
            cls = textkernel.fmix(textkernel.sums(textkernel.fmix(h), row, rows) + n.astype(np.uint64))
            kept, _ = prefix_sizes(n)
            far = rank[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            if far.any():
                h = h[np.lexsort((h, far, row))]
            begin = np.concatenate([[0], np.cumsum(n)])
            short = np.arange(len(h)) - begin[row] < kept[row]
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, kept, 0))]).astype(np.int32)
            pre = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[short].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, rows), t.slice(at, rows), pa.array(n), pa.array(cls.view(np.int64)), pre], names=["doc_id", "t", "n", "cls", "pre"]
            )


def signatures(docs: DataFrame) -> DataFrame:
    rank = ranks(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(partial(_signatures, rank), _SIG)


def _members(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """p, cls, n, pre (its prefix hashes), pivots (all pivots of cls): the groups."""
    # dealt out once, for the counts and for the rows that they pick
    rows = sig.filter("n > 0").select("cls", F.explode("pre").alias("h")).repartition("h")
    shared = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a != b").select("h", "c")
    order = rows.join(shared, "h").groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("c", "h"))).alias("o"))
    order = order.join(classes.select("cls", "n"), "cls")
    need = F.floor((3 * F.col("n") + 3) / 4)
    kept = F.least(F.col("n"), F.col("n") - need + 1 + F.ceil(F.col("n") / SURPLUS))
    stay = kept - F.least(F.ceil(need / SURPLUS), F.greatest(kept - 1, F.lit(0)))
    left = F.greatest(F.lit(0), (stay - (kept - F.size("o"))).cast("int"))  # hashes of one class come first and take their places
    order = order.select("cls", "n", F.transform(F.slice("o", F.lit(1), left), lambda x: x["h"]).alias("pre")).filter(F.size("pre") > 0)
    order = common.materialize(order, "prefixes")
    flat = order.select("cls", F.explode("pre").alias("h"))
    buckets = flat.groupBy("h").agg(F.min("cls").alias("p"), F.max("cls").alias("b")).filter("p != b").select("h", "p")
    pivots = flat.join(buckets, "h").groupBy("cls").agg(F.sort_array(F.collect_set("p")).alias("pivots"))
    members = common.materialize(pivots.join(order, "cls").withColumn("p", F.explode("pivots")), "members")
    # partners are at most a third longer, so their logarithms are in the same or the next bin
    size = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    near = members.groupBy("p", size.alias("b")).agg(F.count("*").alias("c"))
    near = near.select("p", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "c").groupBy("p", "b").agg(F.sum("c").alias("c")).filter("c > 1")
    near = near.select(F.col("p").alias("_p"), F.col("b").alias("_b"))
    return members.join(near, (F.col("p") == F.col("_p")) & (size == F.col("_b"))).drop("_p", "_b")


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """Spanning links of one block of one group."""
    p, i, j = (k.as_py() for k in key)
    cls = table["cls"].to_numpy()
    _, first = np.unique(cls, return_index=True)
    table = table.take(pa.array(first))
    cls, part = table["cls"].to_numpy(), table["part"].to_numpy()
    rows = len(cls)
    hs, rs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for at, h, row, _ in _sets(table["text"].combine_chunks()):
        hs.append(h)
        rs.append(row + at)
    h, row = np.concatenate(hs), np.concatenate(rs)
    n = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(n)])
    n = n.astype(np.int32)
    need = -(-3 * (n[:, None] + n[None, :]) // 7)
    # pairs of this block, by length
    alive = np.minimum(n[:, None], n[None, :]) >= need
    if i != j:
        alive &= part[:, None] != part[None, :]
    # pairs that a smaller pivot's group verifies are not this group's
    lists = table["pivots"].combine_chunks()
    piv, piv_at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
    piv_row = np.repeat(np.arange(rows), np.diff(piv_at))
    for q in np.unique(piv[piv < p]):
        m = piv_row[piv == q]
        if len(m) > 1:
            alive[np.ix_(m, m)] = False
    # a shared prefix hash, and the positional bound at each
    lists = table["pre"].combine_chunks()
    pre = lists.flatten().to_numpy().view(np.uint64)
    pre_row = np.repeat(np.arange(rows), pa.compute.list_value_length(lists).to_numpy())
    order = np.argsort(pre, kind="stable")
    pre, pre_row = pre[order], pre_row[order]
    cuts = np.flatnonzero(np.concatenate([[True], pre[1:] != pre[:-1], [True]]))
    met = np.zeros((rows, rows), dtype=bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        m = pre_row[a:b]
        at = np.array([np.searchsorted(h[begin[x] : begin[x + 1]], pre[a]) for x in m])
        rest = n[m] - at - 1
        grid = np.ix_(m, m)
        met[grid] = True
        alive[grid] &= np.minimum(at[:, None], at[None, :]) + 1 + np.minimum(rest[:, None], rest[None, :]) >= need[grid]
    alive &= met
    np.fill_diagonal(alive, False)
    cells = np.zeros((rows, CELLS), dtype=np.int32)
    np.add.at(cells, (row, (h >> np.uint64(58)).astype(np.int64)), 1)
    _, ids = np.unique(h, return_inverse=True)
    flag = np.zeros(len(h) + 1, dtype=bool)
    root = np.arange(rows)
    for x in range(rows):
        ys = np.flatnonzero(alive[x, x + 1 :]) + x + 1
        ys = ys[root[ys] != root[x]]
        if len(ys):
            ys = ys[np.minimum(cells[ys], cells[x]).sum(axis=1) >= need[x, ys]]
        if not len(ys):
            continue
        own = ids[begin[x] : begin[x + 1]]
        flag[own] = True
        for y in ys:
            if root[y] != root[x] and np.count_nonzero(flag[ids[begin[y] : begin[y + 1]]]) >= need[x, y]:
                a, b = root[x], root[y]
                root[root == max(a, b)] = min(a, b)
        flag[own] = False
    if table.nbytes > 2_000_000:
        textkernel.release()
    far = np.flatnonzero(root != np.arange(rows))
    return pa.table({"u": pa.array(cls[far], pa.int64()), "v": pa.array(cls[root[far]], pa.int64())})


def links(docs: DataFrame, sig: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: links between classes that connect every component."""
    members = common.materialize(_members(sig, classes), "fitting-members")
    sizes = members.groupBy("p").agg(F.count("*").alias("g"), F.sum("n").alias("s")).filter("g > 1")
    sizes = common.materialize(sizes, "groups")
    rows = members.join(common.small(sizes, sizes.count()), "p").withColumn("parts", F.ceil(F.greatest(F.col("g") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")})
    wanted = common.materialize(members.select("cls").distinct().join(classes, "cls").select("cls", F.col("rep.doc_id").alias("_d"), F.col("rep.t").alias("_t")), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    texts = texts.join(common.small(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("cls", "text")
    rows = rows.select("p", "i", "j", "part", "cls", "pre", "pivots").join(texts, "cls")
    return rows.groupBy("p", "i", "j").applyInArrow(_block, "u bigint, v bigint")


def _first(sig: DataFrame) -> DataFrame:
    """cls, n, rep (doc_id, t of its row with the least doc_id, nulls last)."""
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("t"))
    return sig.filter("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.min(order).alias("rep"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id for every document."""
    docs = docs.select("doc_id", "text")
    sig = common.materialize(signatures(docs), "signatures")
    classes = common.materialize(_first(sig), "classes")
    root = components(common.materialize(links(docs, sig, classes), "links"))
    root = common.materialize(root, "roots")
    root = common.small(root, root.count())
    of = classes.join(root, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("_root"), F.col("rep.doc_id").alias("_least"))
    least = of.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of = of.join(least, "_root").select(F.col("cls").alias("_c"), "component_id")
    out = sig.drop("pre").join(of, (F.col("cls") == F.col("_c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that whose doc_id names it, and of its repeated rows one.  All columns stay.

    Documents without words, and null ids in components of null ids only, stay.
    """
    found = common.materialize(join(docs), "components")
    keys = found.filter(F.col("n_shingles") > 0).groupBy("doc_id", "t", "component_id").agg(F.count("*").alias("_rows"))
    # only rows whose id names their component can stay: all others go by themselves, so copies never meet by component
    own = keys.filter(F.col("doc_id") == F.col("component_id"))
    lead = own.groupBy("component_id").agg(F.min("t").alias("_lead")).withColumnRenamed("component_id", "_c")
    own = own.join(lead, F.col("component_id") == F.col("_c")).withColumn("_goes", F.col("t") != F.col("_lead")).select("doc_id", "t", "_goes", "_rows")
    rest = keys.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "t", F.lit(True).alias("_goes"), "_rows")
    marks = common.materialize(own.unionByName(rest).withColumnsRenamed({"doc_id": "_d", "t": "_u"}).filter("_goes or _rows > 1"), "marks")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_t"))
    rows = rows.join(common.small(marks, marks.count()), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left").filter("not coalesce(_goes, false)")
    once = rows.filter("_rows is null").select("_row.*")
    again = rows.filter("_rows is not null").dropDuplicates(["_id", "_t"]).select("_row.*")
    return once.unionByName(again)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents", "doc_id", "text")).drop("t")
