"""Quality rules: cross-document line frequency, with per-document counts.

Lines are normalised (trimmed, A-Z folded, white space runs to one space) and
hashed; for each host (``documents.source``) the documents holding a line are
counted.  Lines above the host's limits are boilerplate: they are removed, and
a document left with too little of its own is rejected.  Copies of one text must
not make its own lines boilerplate, or none of them would be left to keep (which
of them stays is for deduplication to say).  So lines above the limits by
documents are counted again: texts that have most of their words in such lines,
and the same least common one of them (of several the first in the text), are a
family, and a family, like a text that several documents repeat, counts once.

Defined cases.  A null text has no words, no lines, and fails the base rules.
A null source is a host of its own.  Repeated rows count as documents of one
text, so they change nothing and get equal results.  Ties at a limit are not
above it.  An empty table gives an empty result.  Extra columns pass through
:func:`filter_documents` and are ignored by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate when over both this many documents of its host ...
LINE_DOCS = 5
#: ... and this share of them hold it.
LINE_SHARE = 0.01
#: A document is depleted when over this share of its words was boilerplate, or when it is left with fewer words than so many, the least of the base rules.
DEPLETED_SHARE = 0.8
LEFT_WORDS = 20


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0


def line_key(line: Column) -> Column:
    """64-bit hash of the normalised line."""
    return F.xxhash64(common.words(common.ascii_lower(line)))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: one narrow pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({
        "_w": common.words(F.col("text")),
        "_l": F.filter(F.split(text, "\n", -1), _has_word),
    })
    out = out.withColumn("_v", F.transform("_w", lambda w: F.xxhash64(w)))
    get = lambda i: F.get("_v", i)
    window = lambda i: F.xxhash64(*[get(i + k) for k in range(8)])
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.when(F.size("_w") >= 9, F.transform(F.sequence(F.lit(0), F.size("_w") - 8), window)).otherwise(F.array().cast("array<long>")),
    })
    out = out.withColumn("_r", F.size("_h") != F.size(F.array_distinct("_h")))
    # windows found twice or more, by sorting (hash, position); their positions in order
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_s", F.when(F.col("_r"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    same = lambda x, i: (F.get("_s", i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get("_s", i + 1)["h"].eqNullSafe(x["h"])
    out = out.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"])))
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("_p", i + 1) - p, F.lit(8))))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long"))
    return out.drop("_w", "_v", "_l", "_h", "_r", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per distinct non-blank line of each distinct text of a host: _host, _text (its hash), _line, _pos (its first place), _n (words in it, over its repeats), _words (those of the text), _docs (documents with the text)."""
    split = F.transform(F.split(common.ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "\n", -1), common.words)
    line = F.transform(F.filter(split, lambda w: F.size(w) > 0), lambda w, i: F.struct(F.xxhash64(w).alias("_line"), i.alias("_pos"), F.size(w).alias("_n")))
    rows = docs.select(F.col("source").alias("_host"), F.xxhash64("text").alias("_text"), F.sort_array(line).alias("_x"))
    rows = rows.withColumn("_words", F.aggregate("_x", F.lit(0), lambda a, x: a + x["_n"]))
    first = F.transform("_x", lambda x, i: F.struct(x["_line"].alias("_line"), x["_pos"].alias("_pos"), x["_n"].alias("_n"), (~F.get("_x", i - 1)["_line"].eqNullSafe(x["_line"])).cast("long").alias("_docs")))
    rows = rows.withColumn("_x", F.explode(first)).select("_host", "_text", "_words", "_x.*")
    rows = rows.groupBy("_host", "_text", "_line").agg(F.min("_pos").alias("_pos"), F.sum("_n").alias("_n"), F.max("_words").alias("_words"), F.sum("_docs").alias("_docs"))
    return rows.withColumn("_n", (F.col("_n") / F.col("_docs")).cast("long"))


def _holding(lines: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose line is in ``some``, with its other columns."""
    some = common.small(some.withColumnsRenamed({"_host": "_h", "_line": "_l"}), some.count())
    return lines.join(some, F.col("_h").eqNullSafe(F.col("_host")) & (F.col("_l") == F.col("_line"))).drop("_h", "_l")


def _candidates(docs: DataFrame, lines: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """_host, _line, _held, _all (texts) of the lines above the limits by documents.  Counts pre-aggregate on both sides of each exchange, so a hot host or line is one row a task."""
    texts = docs.select(F.col("source").alias("_host"), F.xxhash64("text").alias("_text")).groupBy("_host", "_text").agg(F.count("*").alias("_docs"))
    texts = texts.groupBy("_host").agg(F.count("*").alias("_all"), F.sum("_docs").alias("_every"))
    held = lines.groupBy("_host", "_line").agg(F.count("*").alias("_held"), F.sum("_docs").alias("_by")).filter(F.col("_by") > line_docs)
    return (
        held.withColumnRenamed("_host", "_h")
        .join(texts, F.col("_h").eqNullSafe(F.col("_host")))
        .filter(F.col("_by") > line_share * F.col("_every"))
        .select("_host", "_line", "_held", "_all")
    )


def _once_a_family(holding: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """_host, _line of the candidates that stay above the limits when a family of texts counts once."""
    texts = holding.groupBy("_host", "_text").agg(
        (2 * F.sum("_n") > F.max("_words")).alias("_most"),
        F.min(F.struct("_held", "_pos", "_line"))["_line"].alias("_rarest"),
        F.max("_all").alias("_all"),
        F.collect_list("_line").alias("_in"),
    )
    one = F.when(F.col("_most"), F.col("_rarest")).otherwise(F.col("_text"))
    units = texts.select("_host", "_all", "_most", one.alias("_one"), F.explode("_in").alias("_line")).distinct()
    held = units.groupBy("_host", "_line").agg(F.count("*").alias("_held"), F.max("_all").alias("_all"))
    return held.filter((F.col("_held") > line_docs) & (F.col("_held") > line_share * F.col("_all"))).select("_host", "_line")


def _candidate_holding(docs: DataFrame, lines: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    some = common.materialize(_candidates(docs, lines, line_docs, line_share), "candidate-lines")
    return common.materialize(_holding(lines, some), "candidate-holding")


def frequent_lines(docs: DataFrame, lines: DataFrame | None = None, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """_host, _line of the lines above the limits, a family of near copies counted once."""
    held = common.materialize(_lines(docs), "lines") if lines is None else lines
    return _once_a_family(_candidate_holding(docs, held, line_docs, line_share), line_docs, line_share)


def _worn(docs: DataFrame, frequent: DataFrame | None) -> DataFrame:
    """_host, _text, _cut (boilerplate lines), _gone (share of its words): one row per distinct text with a frequent line."""
    lines = common.materialize(_lines(docs), "lines")  # hashes and numbers; counted once, then looked up
    if frequent is None:
        lines = _candidate_holding(docs, lines, LINE_DOCS, LINE_SHARE)
        frequent = _once_a_family(lines, LINE_DOCS, LINE_SHARE)
    held = _holding(lines, common.materialize(frequent, "frequent-lines"))
    return held.groupBy("_host", "_text").agg(F.collect_set("_line").alias("_cut"), (F.sum("_n") / F.max("_words")).alias("_gone"))


def _depleted() -> Column:
    gone = F.coalesce(F.col("_gone"), F.lit(0.0))
    return (gone > DEPLETED_SHARE) | ((gone > 0) & (F.round(F.col("n_words") * (1 - gone)) < LEFT_WORDS))


def judge(docs: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, removed_share (of words, in frequent lines) and kept, for every document.

    Only hashes and numbers are shuffled, never texts.
    """
    docs = docs.select("doc_id", "text", "source")
    worn = _worn(docs, frequent).drop("_cut")
    base = base_counts(docs).withColumns({"_h": F.col("source"), "_t": F.xxhash64("text")}).drop("text", "source")
    out = base.join(worn, F.col("_h").eqNullSafe(F.col("_host")) & (F.col("_t") == F.col("_text")), "left")
    return out.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~_depleted()).alias("kept"),
        F.coalesce(F.col("_gone"), F.lit(0.0)).alias("removed_share"),
    )


def filter_documents(docs: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """Documents that pass, without their boilerplate lines; n_chars, if there, follows the text.  All columns stay."""
    columns = docs.columns
    worn = common.materialize(_worn(docs.select("text", "source"), frequent), "worn-texts")
    size = worn.agg(F.count("*") + F.coalesce(F.sum(F.size("_cut")), F.lit(0))).first()[0]
    worn = common.small(worn, size)
    packed = docs.select(F.struct("*").alias("_row"), "text", "source")  # own columns cannot clash with those of the input
    keyed = base_counts(packed).withColumns({"_h": F.col("source"), "_t": F.xxhash64("text")})
    out = keyed.join(worn, F.col("_h").eqNullSafe(F.col("_host")) & (F.col("_t") == F.col("_text")), "left")
    # one predicate over both sides of the join: split, its halves would move below and repeat the counting expressions
    out = out.filter(base_failed().cast("int") + _depleted().cast("int") == 0)
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~(_has_word(x) & F.array_contains(F.col("_cut"), line_key(x)))), "\n")
    cut = F.col("_cut").isNotNull()
    out = out.withColumn("_rest", F.when(cut, rest).otherwise(F.col("text")))
    new = {"text": F.col("_rest"), "n_chars": F.when(cut, F.length("_rest").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in columns else None)}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents", "doc_id", "text", "source"))
