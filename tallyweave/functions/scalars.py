"""Scalar helpers on text, numbers and dates, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean(x: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(x), F.lit(""))


def number(x: Column) -> Column:
    """Thousands separators dropped; what is not a number is null."""
    bare = F.replace(F.trim(x), F.lit(","), F.lit(""))
    return F.when(F.rlike(bare, F.lit(NUMBER)), bare.try_cast("double"))


def norm(x: Column) -> Column:
    """Trimmed, upper case, white space runs as one space."""
    return F.regexp_replace(F.upper(F.trim(x)), r"\s+", " ")


def clean_cell(x: Column) -> Column:
    """Trimmed; blank and the text ``nan`` are null."""
    return F.when(F.lower(F.trim(x)) != "nan", clean(x))


def number_cell(x: Column) -> Column:
    """A number that may end in CR or DR."""
    return number(F.regexp_replace(F.trim(clean_cell(x)), r"(?i)\s*(CR|DR)\s*$", ""))


def account_node(account: Column) -> Column:
    return F.concat(F.lit("ACC:"), account)


def counterparty_node(identifier: Column) -> Column:
    return F.concat(F.lit("CP:"), F.upper(F.trim(identifier)))


def anonymous_label(node: Column, node_type: Column) -> Column:
    """Synthetic ids without their prefix; others by kind and the first four digits of their SHA-256."""
    prefix = F.when(node_type == "account", "ACC_").otherwise("CP_")
    digest = F.upper(F.substring(F.sha2(node, 256), 1, 4))
    return F.when(F.startswith(node, F.lit("SYN:")), F.substring(node, 5, 1 << 20)).otherwise(F.concat(prefix, digest))


def parse_date(x: Column) -> Column:
    """The first of five day formats that fits the first 11 characters; two-digit years from 69 on are of the 1900s."""
    head = F.trim(F.substring(F.trim(x), 1, 11))
    day = lambda f: F.try_to_timestamp(head, F.lit(f)).cast("timestamp_ntz")
    short = day("d-MMM-yy")
    short = F.when(F.year(short) >= 2069, short - F.expr("interval 100 years")).otherwise(short)
    return F.coalesce(*[day(f) for f in ("d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "d-MMM-yyyy")], short)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -30.0, 30.0)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cross_entropy(p: Column, y: Column, eps: float = 1e-7) -> Column:
    """Mean binary cross-entropy (an aggregate)."""
    return F.avg(-(y * F.log(p + eps) + (1 - y) * F.log(1 - p + eps)))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def amount_rule(debit: Column, credit: Column) -> Column:
    """struct(amount, direction): a debit that is there and not 0, else such a credit, else null."""
    return F.when(debit.isNotNull() & (debit != 0), F.struct(F.abs(debit).alias("amount"), F.lit("DEBIT").alias("direction"))).when(
        credit.isNotNull() & (credit != 0), F.struct(F.abs(credit).alias("amount"), F.lit("CREDIT").alias("direction"))
    )
