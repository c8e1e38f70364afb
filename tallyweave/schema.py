"""The typed records that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
}


def _fields(spec: str) -> T.StructType:
    """A schema of flat fields; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(" ") for x in spec.split(", "))])


#: One row per statement line.
TRANSACTION = _fields(
    "transaction_id string, account_id string, date string, time string, amount double, direction string, balance double, "
    "transaction_type string, payment_method string, description string, counterparty_name string, counterparty_label string, "
    "counterparty_identifier string, counterparty_account string, counterparty_upi string, counterparty_bank string, "
    "transaction_reference string, reference_id string, is_reversal boolean, source_file string, source_format string"
)

#: What a parser reads from a file, before the narration is analysed.
NODE = _fields("node_id string, node_type string, label string, bank string, is_synthetic boolean, node_seq bigint")

EDGE = _fields(
    "src string, dst string, amount double, date string, parsed_date timestamp_ntz, payment_method string, transaction_id string, "
    "is_reversal boolean, source_file string, is_synthetic boolean, ring_id int, ring_type string, is_noise boolean, edge_seq bigint"
)

RING = _fields(
    "ring_id int, ring_type string, tier string, nodes array<string>, core_nodes array<string>, amount_variation double, timing_spread_hours int"
)
