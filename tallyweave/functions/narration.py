"""Counterparty extraction from payment narrations, as native column expressions.

Every function maps a string column to a string (or struct) column and yields
null where the narration does not carry the field, so the whole extraction stays
inside one projection and code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: handles, bank codes and bank names of the payment networks
HANDLE_BANKS = {
    "ybl": "YES_BANK",
    "ibl": "IDBI_BANK",
    "oksbi": "SBI",
    "okaxis": "AXIS_BANK",
    "okicici": "ICICI_BANK",
    "okhdfcbank": "HDFC_BANK",
    "okhdfc": "HDFC_BANK",
    "okpaytm": "PAYTM",
    "paytm": "PAYTM",
}
BANK_CODES = {
    "FDRL": "FEDERAL_BANK",
    "BARB": "BANK_OF_BARODA",
    "UTIB": "AXIS_BANK",
    "IDFB": "IDFC_FIRST_BANK",
    "ICIC": "ICICI_BANK",
    "KARB": "KARNATAKA_BANK",
    "IOBA": "INDIAN_OVERSEAS_BANK",
    "IDIB": "INDIAN_BANK",
    "HDFC": "HDFC_BANK",
    "YESB": "YES_BANK",
    "SBI": "SBI",
    "CNRB": "CANARA_BANK",
    "KKBK": "KOTAK_MAHINDRA_BANK",
    "AIRP": "AIRTEL_PAYMENTS_BANK",
    "DCBL": "DCB_BANK",
    "CBIN": "CENTRAL_BANK_OF_INDIA",
    "SBIN": "SBI",
    "KOMA": "KOTAK_MAHINDRA_BANK",
}
FULL_NAMES = {
    "STATE BANK OF INDIA": "SBI",
    "HDFC BANK": "HDFC_BANK",
    "ICICI BANK": "ICICI_BANK",
    "AXIS BANK": "AXIS_BANK",
    "UCO BANK": "UCO_BANK",
    "BANK OF BARODA": "BANK_OF_BARODA",
    "BANDHAN BANK": "BANDHAN_BANK",
    "AU SMALL FINANCE BANK": "AU_SMALL_FINANCE_BANK",
    "KOTAK MAHINDRA BANK": "KOTAK_MAHINDRA_BANK",
    "IDBI BANK": "IDBI_BANK",
    "IDFC FIRST BANK": "IDFC_FIRST_BANK",
    "CANARA BANK": "CANARA_BANK",
    "INDIAN OVERSEAS BANK": "INDIAN_OVERSEAS_BANK",
    "INDIAN BANK": "INDIAN_BANK",
    "FEDERAL BANK": "FEDERAL_BANK",
    "YES BANK": "YES_BANK",
    "KARNATAKA BANK": "KARNATAKA_BANK",
    "AIRTEL PAYMENTS BANK": "AIRTEL_PAYMENTS_BANK",
    "PAYTM PAYMENTS BANK": "PAYTM",
    "DCB BANK": "DCB_BANK",
    "CENTRAL BANK OF INDIA": "CENTRAL_BANK_OF_INDIA",
    "UNION BANK OF INDIA": "UNION_BANK_OF_INDIA",
    "PUNJAB NATIONAL BANK": "PUNJAB_NATIONAL_BANK",
}
NAME_KEYWORDS = {
    "STATE BANK": "SBI",
    "KOTAK": "KOTAK_MAHINDRA_BANK",
    "UNION BANK": "UNION_BANK_OF_INDIA",
    "HDFC": "HDFC_BANK",
    "ICICI": "ICICI_BANK",
    "AXIS": "AXIS_BANK",
    "YES BANK": "YES_BANK",
    "FEDERAL": "FEDERAL_BANK",
    "CANARA": "CANARA_BANK",
    "INDIAN OVERSEAS": "INDIAN_OVERSEAS_BANK",
    "INDIAN BANK": "INDIAN_BANK",
    "BANK OF BARODA": "BANK_OF_BARODA",
    "IDFC": "IDFC_FIRST_BANK",
    "IDBI": "IDBI_BANK",
    "KARNATAKA": "KARNATAKA_BANK",
    "AIRTEL": "AIRTEL_PAYMENTS_BANK",
    "PAYTM": "PAYTM",
}
REFERENCE_PATTERNS = (
    r"(?i)UPI/(\d{8,20})",
    r"(?i)IMPS/P2A/(\d{8,20})",
    r"(?i)UPI:(?:PAY|REC):(\d{8,20})",
    r"(?i)IMPS:(?:PAY|REC):(\d{8,20})",
    r"(?i)NEFT/([A-Za-z0-9]+)(?=/)",
)
TITLES = ("MR", "MRS", "MS", "DR")


def _blank(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def _hit(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _first(table: dict[str, str], test) -> Column:
    """The value of the first key, in table order, that passes ``test(key)``."""
    out = None
    for key, value in table.items():
        out = F.when(test(key), value) if out is None else out.when(test(key), value)
    return out


# Patterns run on the narration; what stands in their groups is worked on apart,
# so a projection can hold each pattern's result as a column of its own.
HANDLE = r"([A-Za-z0-9._-]+@[A-Za-z0-9._-]+)"
IMPS = r"(?i)IMPS/P2A/\d{8,20}/([^/]*)/(.+)$"
LABEL = r"(?i)UPI/\d{8,20}/(?:CR|DR)/([^/]+)/([A-Za-z0-9]+)(?:/|$)"
NEFT = r"(?i)NEFT/[A-Za-z0-9]+/([A-Za-z]{2,10})/(.+)$"
COLON = r"(?i)(?:UPI|IMPS):(?:PAY|REC):\d{8,20}/([^/]+)(?:/(.*))?$"
PARTICIPANT = r"(?i)UPI/\d{8,20}/[^/]+/([^/]+)(?:/(.*))?$"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """Empty where the pattern does not match."""
    return F.regexp_extract(text, pattern, group)


def upi(text: Column) -> Column:
    return F.lower(_hit(text, HANDLE))


def upi_bank(handle: Column) -> Column:
    return F.when(F.contains(handle, F.lit("@")), _lookup(HANDLE_BANKS, F.lower(F.substring_index(handle, "@", -1))))


def transaction_reference(text: Column) -> Column:
    return F.coalesce(*[_hit(text, p) for p in REFERENCE_PATTERNS])


def payment_method(text: Column) -> Column:
    up = F.upper(text)
    has = lambda s: F.contains(up, F.lit(s))
    return (
        F.when(has("UPI/") | has("UPI:"), "UPI").when(has("IMPS/P2A/") | has("IMPS:"), "IMPS")
        .when(has("NEFT"), "NEFT").when(has("RTGS"), "RTGS").when(has("LOAN DISBURSEMENT"), "LOAN")
    )


def is_reversal(text: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(F.trim(text)), F.lit("REVERSED")), F.lit(False))


def imps_counterparty(text: Column) -> Column:
    return _blank(_group(text, IMPS, 2))


def _unreversed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^\s*REVERSED\s*:\s*", "")


def _label_of(raw: Column) -> Column:
    label = F.upper(F.trim(raw))
    return F.when(~label.isin(*TITLES, ""), label)


def upi_label(text: Column) -> Column:
    return _label_of(_group(_unreversed(text), LABEL))


def bank_code(text: Column) -> Column:
    up = F.upper(text)
    return _first(BANK_CODES, lambda k: F.contains(up, F.lit(f"/{k}/")))


def _neft_of(code: Column, name: Column) -> Column:
    return F.struct(F.nullif(F.upper(code), F.lit("")).alias("code"), _blank(F.regexp_replace(F.trim(name), "/+$", "")).alias("name"))


def neft_counterparty(text: Column) -> Column:
    """struct(code, name)"""
    return _neft_of(_group(text, NEFT), _group(text, NEFT, 2))


def bank_name_keyword(segment: Column) -> Column:
    up = F.upper(segment)
    return _first(NAME_KEYWORDS, lambda k: F.contains(up, F.lit(k)))


def _colon_of(name: Column, rest: Column) -> Column:
    parts = F.filter(F.transform(F.split(rest, "/"), lambda s: F.trim(s)), lambda s: s != "")
    is_account = lambda s: F.rlike(F.upper(s), F.lit(r"^X{1,4}\d{3,6}$"))
    bank = lambda s: F.coalesce(_lookup(BANK_CODES, F.upper(s)), bank_name_keyword(s))
    banks = F.filter(F.transform(F.filter(parts, lambda s: ~is_account(s)), bank), lambda b: b.isNotNull())
    return F.struct(_blank(name).alias("name"), F.try_element_at(banks, F.lit(-1)).alias("bank"), F.try_element_at(F.filter(parts, is_account), F.lit(-1)).alias("account"))


def colon_details(text: Column) -> Column:
    """struct(name, bank, account): of the segments after the name, the last that names an account, and the last that names a bank."""
    return _colon_of(_group(text, COLON), _group(text, COLON, 2))


def bank_from_reference(reference: Column) -> Column:
    return F.when(F.length(reference) >= 4, _lookup(BANK_CODES, F.upper(F.substring(reference, 1, 4))))


def bank_full_name(segment: Column) -> Column:
    """The longest known name that the segment starts, or that starts the segment; names are often cut off."""
    names = F.array(*[F.struct(F.lit(-len(k)).alias("n"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in FULL_NAMES.items()])
    fits = F.filter(names, lambda x: F.startswith(x["k"], F.upper(segment)) | F.startswith(F.upper(segment), x["k"]))
    return F.when(F.length(segment) >= 3, F.array_min(fits)["v"])


def _participant_of(who: Column, rest: Column) -> Column:
    handle = F.contains(who, F.lit("@"))
    who = F.trim(who)
    return F.struct(
        F.when(~handle & (who != ""), who).alias("name"), F.when(handle & (who != ""), who).alias("label"),
        bank_full_name(F.trim(F.substring_index(rest, "/", 1))).alias("bank"),
    )


def upi_participant(text: Column) -> Column:
    """struct(name, label, bank)"""
    return _participant_of(_group(text, PARTICIPANT), _group(text, PARTICIPANT, 2))


FIELDS = (
    "payment_method", "transaction_reference", "counterparty_identifier", "counterparty_label", "counterparty_upi",
    "counterparty_account", "counterparty_bank", "counterparty_name", "is_reversal",
)


def extract_counterparty(df: DataFrame, description: str = "description") -> DataFrame:
    """``df`` plus the nine FIELDS.  Each pattern runs at most once a row, and only on narrations of its kind."""
    own = df.columns
    text = F.coalesce(F.col(description), F.lit(""))
    df = df.withColumns({"_text": text, "_up": F.upper(text), "_how": payment_method(text), "_upi": F.lower(_group(text, HANDLE))})
    df = df.withColumn("_colon", F.col("_how").isin("UPI", "IMPS") & F.contains("_up", F.concat("_how", F.lit(":"))))
    how = lambda name, colon=False: (F.col("_how") == name) & (F.col("_colon") == colon)
    only = lambda cond, c: F.when(cond, c).otherwise("")
    t = F.col("_text")
    df = df.withColumns({
        **{f"_r{k}": _group(t, p) for k, p in enumerate(REFERENCE_PATTERNS)},
        "_c1": only(F.col("_colon"), _group(t, COLON)), "_c2": only(F.col("_colon"), _group(t, COLON, 2)),
        "_l1": only(how("UPI"), _group(_unreversed(t), LABEL)),
        "_p1": only(how("UPI"), _group(t, PARTICIPANT)), "_p2": only(how("UPI"), _group(t, PARTICIPANT, 2)),
        "_n1": only(F.col("_how") == "NEFT", _group(t, NEFT)), "_n2": only(F.col("_how") == "NEFT", _group(t, NEFT, 2)),
        "_i2": only(how("IMPS"), F.trim(_group(t, IMPS, 2))),
    })
    refs = F.coalesce(*[F.nullif(F.col(f"_r{k}"), F.lit("")) for k in range(len(REFERENCE_PATTERNS))])
    df = df.withColumns({
        "_ref": refs, "_upl": _label_of(F.col("_l1")), "_det": _colon_of(F.col("_c1"), F.col("_c2")),
        "_par": _participant_of(F.col("_p1"), F.col("_p2")), "_nef": _neft_of(F.col("_n1"), F.col("_n2")),
        "_code": _first(BANK_CODES, lambda k: F.contains("_up", F.lit(f"/{k}/"))),
    })
    other = lambda c: F.when(F.col("_upl").isNull(), F.col(c))
    df = df.withColumns({
        "_label": F.coalesce(F.nullif(F.col("_i2"), F.lit("")), "_upl", other("_par.label"), "_nef.code"),
        "_name": F.coalesce("_det.name", other("_par.name"), "_nef.name"),
        "_bank": F.coalesce(upi_bank(F.col("_upi")), "_code", "_det.bank", other("_par.bank"), F.when(F.col("_how") == "NEFT", bank_from_reference(F.col("_ref")))),
    })
    found = {
        "payment_method": F.col("_how"), "transaction_reference": F.col("_ref"), "counterparty_identifier": F.coalesce(F.nullif(F.col("_upi"), F.lit("")), "_label", "_name"),
        "counterparty_label": F.col("_label"), "counterparty_upi": F.nullif(F.col("_upi"), F.lit("")), "counterparty_account": F.col("_det.account"),
        "counterparty_bank": F.col("_bank"), "counterparty_name": F.col("_name"), "is_reversal": is_reversal(F.col("_text")),
    }
    return df.select(*[c for c in own if c not in found], *[v.alias(k) for k, v in found.items()])
