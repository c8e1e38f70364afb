"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path``.  Its literal tokens (runs
of letters and digits that every match holds whole, A-Z folded, so that a rule
may ignore case) are counted over all URLs, and the rule is indexed under the
rarest; a URL's own tokens fetch the candidate rules, and only those run.  Rules
without a literal token are fetched by every URL.  The index is a table that is
joined, so a list of any length will do: a URL's row in the shuffle, if the
list or the verdicts are too many to broadcast, is its key and a rule.

The longest rule that fits decides (list rules before pattern rules); nothing
fitting means allow.  Defined cases.  A null URL, or one without ``://``, has
an empty host and path and is allowed.  Of rules of equal length, block wins,
then the smaller text.  Repeated rows are judged alike, each on its own row.
An empty table, or an empty list, gives an empty result, or allows everything.
Long URLs are read whole.  Extra columns pass through :func:`judge`; those named
like its results are replaced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    text: str
    verdict: str
    pattern: str
    #: 1: named by host and path, decides before pattern rules
    listed: int


def listed(text: str, verdict: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with the rule's."""
    host, _, path = text.partition("/")
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", 1)


LISTED = (
    listed("com/en/", "block"), listed("example.com/en/7", "allow"), listed("net/de/", "allow"),
    listed("example.net/de/8", "block"), listed("org/es/", "block"),
)
PATTERNS = tuple(
    Rule(p, "block", p, 0)
    for p in (
        r"^(?:[^/]*[.-])?ads-track\.", r"^(?:[^/]*[.-])?cheap-pills\.", r"^(?:[^/]*[.-])?free-bets\.", r"^(?:[^/]*[.-])?spam-farm\.",
        r"^(?:[^/]*[.-])?casino[.-]", r"^(?:[^/]*[.-])?viagra[.-]", r"^(?:[^/]*[.-])?doubleclick\.", r"^(?:[^/]*[.-])?xxx[.-]",
        r"/ads/", r"/adserver/", r"/popup/", r"^(?:[^/]*\.)?\d{1,3}(?:-\d{1,3}){3}\.",
    )
)
RULES = LISTED + PATTERNS


def literal_tokens(pattern: str) -> list[str]:
    """Whole tokens, A-Z folded, that each match holds: literal runs with a literal non-token character, or the start, on both sides.

    None where letters may stand for others than A-Z and a-z (the flag u), or where the flag x changes what is literal.
    """
    if re.match(r"\(\?[a-z]*[ux]", pattern):
        return []
    flat = ""
    for op, av in re._parser.parse(pattern):
        name = str(op)
        if name == "LITERAL":
            flat += chr(av)
        elif name == "IN" and all(str(o) == "LITERAL" and not chr(v).isalnum() for o, v in av):
            flat += "/"  # some character that parts tokens
        elif name == "MAX_REPEAT" and av[0] == 0 and av[1] == 1 and _ends_apart(av[2]) and flat in ("", "^"):
            flat += "/"  # what may stand before ends in such a character
        elif name == "AT" and not flat:
            flat = "^"
        else:
            flat += "\0"
    return sorted({t.translate(_FOLD) for t in re.findall(r"(?<=[^\0A-Za-z0-9])[A-Za-z0-9]+(?=[^\0A-Za-z0-9])", flat)})


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ends_apart(items) -> bool:
    op, av = list(items)[-1]
    return str(op) == "LITERAL" and not chr(av).isalnum() or str(op) == "IN" and all(str(o) == "LITERAL" and not chr(v).isalnum() for o, v in av)


def host(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(key: Column) -> Column:
    """The tokens of a URL, and the empty one, under which rules without a token stand."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.regexp_replace(common.ascii_lower(key), "[^a-z0-9]+", " "), " ")))


def index(tokens: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules with ``_token``, the rarest of their tokens over all rows of ``tokens._name`` (the empty one: no token)."""
    spark = tokens.sparkSession
    rows = spark.createDataFrame([(k, *r, literal_tokens(r.pattern)) for k, r in enumerate(rules)], "_rule int, rule string, verdict string, _pattern string, _listed int, _of array<string>")
    own = rows.select("_rule", F.explode("_of").alias("_name"))
    names = own.select("_name").distinct()
    seen = tokens.join(common.small(names, len(rules)), "_name", "left_semi").groupBy("_name").agg(F.count("*").alias("_seen"))
    best = own.join(seen, "_name", "left").groupBy("_rule").agg(F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), F.col("_name").alias("t")))["t"].alias("_token"))
    return rows.join(best, "_rule", "left").withColumn("_token", F.coalesce("_token", F.lit(""))).drop("_of", "_rule")


def fits(keys: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_k (a key that some rule fits) and _fit, its deciding rule, for the distinct ``keys._key``."""
    tokens = keys.select("_key", F.explode(_tokens(F.col("_key"))).alias("_name"))
    table = common.materialize(index(tokens, rules), "url-rules")
    met = tokens.join(common.small(table, len(rules), 50_000), F.col("_name") == F.col("_token"))
    met = met.filter(F.regexp_like("_key", "_pattern"))
    order = F.struct(F.col("_listed").alias("l"), F.length("rule").alias("n"), (F.col("verdict") == "block").cast("int").alias("b"), "rule", "verdict")
    return met.groupBy(F.col("_key").alias("_k")).agg(F.max(order).alias("_fit"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` plus host, path, rule (of the list; else null), verdict, matched (the deciding rule of either kind)."""
    rows = pages.select(F.struct("*").alias("_row"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("_key", F.concat("host", "path"))
    found = common.materialize(fits(rows.select("_key"), rules), "url-fits")
    weight = found.agg(F.sum(F.length("_k") + F.length("_fit.rule") + 40)).first()[0] or 0
    rows = rows.join(F.broadcast(found) if weight <= common.BROADCAST_BYTES else found, F.col("_key") == F.col("_k"), "left")
    new = {
        "host": F.col("host"), "path": F.col("path"), "rule": F.when(F.col("_fit.l") == 1, F.col("_fit.rule")),
        "verdict": F.coalesce(F.col("_fit.verdict"), F.lit("allow")), "matched": F.col("_fit.rule"),
    }
    return rows.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
