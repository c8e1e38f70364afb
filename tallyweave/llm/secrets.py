"""Secret scans by a trigram index.

Each rule's regular expression is turned into a Boolean trigram query: an AND
of clauses, each an OR of alternatives, each an AND of trigrams that any match
must hold (A-Z folded).  The index keeps, for the trigrams that some query names,
which documents hold them.  It is sharded by document, each its own shard: one
pass over a text collects the named trigrams it holds, which are its entries in
all posting lists, and the queries intersect them in place.  So the postings are
never stored or moved, and a scan of 100 TB reads each text once.  Only the
candidate rules run on a document; rules without mandatory trigrams scan fully.

Defined cases.  Null texts are empty; an empty text has no spans.  Offsets are
code points, end exclusive.  Spans of one kind never overlap; spans of different
kinds may, and are listed by start, then kind.  Repeated rows give equal
results.  Extra columns of any name pass through :func:`redact`.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

sre = re._parser  # the parse tree of the standard library's regular expressions


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: capture group whose length counts, and the least length of a match that stays
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run that is long enough is matched whole either way; short runs are never stepped through
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)?"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"[sr]k_live_[0-9a-zA-Z]{16,}"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE + MORE

#: Alternatives kept while strings are multiplied out.
MOST = 64


def _strings(items) -> list[set[str] | None]:
    """The parse tree as a sequence of finite sets of lower-cased strings; None where any string may stand."""
    out: list[set[str] | None] = []
    for op, av in items:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(av).lower()})
        elif name == "IN":
            chars: set[str] | None = set()
            for o, v in av:
                if str(o) == "LITERAL":
                    chars.add(chr(v).lower())
                elif str(o) == "RANGE" and v[1] - v[0] < 8:
                    chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    chars = None
                    break
            out.append(chars if chars and len(chars) <= 8 else None)
        elif name == "SUBPATTERN":
            out += _strings(av[3])
        elif name == "BRANCH":
            found: set[str] | None = set()
            for branch in av[1]:
                got = _flat(_strings(branch))
                found = None if got is None or found is None else found | got
            out.append(found)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = av
            got = _flat(_strings(body))
            if got is not None and int(high) <= 1:
                out.append(got | ({""} if low == 0 else set()))
            else:
                for _ in range(min(int(low), 4)):
                    out.append(got)
                out.append(None)
        elif name == "AT":
            continue
        else:
            out.append(None)
    return out


def _flat(parts: list[set[str] | None]) -> set[str] | None:
    whole = {""}
    for p in parts:
        if p is None or len(whole) * len(p) > MOST:
            return None
        whole = {a + b for a in whole for b in p}
    return whole


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs of trigrams; an empty list means that the rule scans fully."""
    clauses: list[list[list[str]]] = []
    run: set[str] = {""}

    def flush() -> None:
        if run and all(len(s) >= 3 for s in run):
            alts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted(sorted(a) for a in alts if not any(b < a for b in alts)))  # a larger one adds nothing

    for part in [*_strings(sre.parse(pattern)), None]:
        if part is None or len(run) * len(part) > MOST:
            flush()
            run = {""} if part is None else set(part)
        else:
            run = {a + b for a in run for b in part}
    return clauses


def _any_of(trigrams: list[str]) -> str:
    """A pattern of the trigrams as a tree by their first letters: no letter is tried twice."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in trigrams:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    one = lambda chars: "[" + "".join(re.escape(c) for c in chars) + "]"
    return "|".join(re.escape(a) + "(?:" + "|".join(re.escape(b) + one(cs) for b, cs in at.items()) + ")" for a, at in tree.items())


def candidates(rules: tuple[Rule, ...] = RULES) -> tuple[Column, list[Column]]:
    """The document's entries in the postings, from its folded text ``_low``, and per rule whether its query holds there, from the entries ``_post``."""
    queries = [trigram_query(r.pattern) for r in rules]
    named = sorted({t for q in queries for c in q for alt in c for t in alt})
    post = F.array_distinct(F.regexp_extract_all("_low", F.lit(f"(?=({_any_of(named)}))"), F.lit(1))) if named else F.array().cast("array<string>")
    meets = lambda alt: F.size(F.array_intersect("_post", F.array(*map(F.lit, alt)))) == len(alt)
    holds = []
    for q in queries:
        ok = F.lit(True)
        for clause in q:
            any_of = F.lit(False)
            for alt in clause:
                any_of = any_of | meets(alt)
            ok = ok & any_of
        holds.append(ok)
    return post, holds


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """Spans of one rule: matches interleave with the gaps between them, so running lengths give the offsets."""
    p = F.lit(rule.pattern)
    found, value = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(
        F.transform(found, lambda x: F.length(x)).alias("m"), F.transform(value, lambda x: F.length(x)).alias("v"), F.transform(gaps, lambda x: F.length(x)).alias("g")
    )
    kind = "struct<s:int,k:int,e:int>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["g"]
        end = start + x["m"]
        one = F.array(F.struct(start.alias("s"), F.lit(at).alias("k"), end.alias("e")))
        return F.struct(F.coalesce(end, acc["pos"]).alias("pos"), F.when(x["v"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(rows, start, step, lambda a: a["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus ``_spans``: array of (s, k, e), by start, then rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    post, holds = candidates(rules)
    out = docs.withColumn("_low", common.ascii_lower(text)).withColumn("_post", post)
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    parts = []
    for k, (rule, ok) in enumerate(zip(rules, holds, strict=True)):
        name = f"_s{k}"
        out = out.withColumn(name, F.when(ok & F.rlike(text, F.lit(rule.pattern)), _spans(text, rule, k)).otherwise(none))
        parts.append(F.col(name))
    return out.withColumn("_spans", F.sort_array(F.concat(*parts))).drop("_low", "_post", *[f"_s{k}" for k in range(len(rules))])


def _digest(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    out = scan(docs.select("doc_id", "text"), rules)
    count = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("_spans", lambda x: x["k"] < len(BASE))
    return out.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_digest(base, rules), 256).alias("base_sha256"), _digest(F.col("_spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, overlaps merged, replaced by ``mark``; n_chars, if there, follows the text."""
    columns = docs.columns
    out = scan(docs.select(F.struct("*").alias("_row"), "text"), rules)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["pos"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, x["s"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    hit = F.size("_spans") > 0
    out = out.withColumn("_clean", F.when(hit, clean).otherwise(F.col("text")))
    new = {"text": F.col("_clean"), "n_chars": F.when(hit, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in columns else None)}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents", "doc_id", "text"))
