from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import narration as N
from tallyweave.functions import scalars as S

CASES = {
    "UPI/100000000001/DR/ASHA/YESB/Asha.K@YBL/UPI": {"payment_method": "UPI", "transaction_reference": "100000000001", "counterparty_identifier": "asha.k@ybl", "counterparty_label": "ASHA", "counterparty_bank": "YES_BANK"},
    "REVERSED : UPI/100000000002/DR/Ravi/AIRP/12345": {"counterparty_identifier": "RAVI", "counterparty_bank": "AIRTEL_PAYMENTS_BANK", "is_reversal": True},
    "UPI/100000000003/DR/MR/AIRP/77": {"counterparty_label": None, "counterparty_name": "MR", "counterparty_identifier": "MR"},
    "UPI/100000000004/UPI/Mrs Lata N/State Bank Of": {"counterparty_name": "Mrs Lata N", "counterparty_bank": "SBI"},
    "UPI/100000000005/UPI/some@one1/Bandhan Bank/": {"counterparty_label": "some@one1", "counterparty_upi": "some@one1", "counterparty_bank": "BANDHAN_BANK"},
    "UPI:PAY:100000000006/MEERA S/Kotak Mahi": {"counterparty_name": "MEERA S", "counterparty_bank": "KOTAK_MAHINDRA_BANK"},
    "IMPS:PAY:100000000007/Anil Da/KARB/XX7501/1 rupe": {"counterparty_name": "Anil Da", "counterparty_bank": "KARNATAKA_BANK", "counterparty_account": "XX7501"},
    "IMPS/P2A/100000000008//Corner Shop Private": {"payment_method": "IMPS", "counterparty_label": "Corner Shop Private"},
    "IMPS/P2A/100000000009/ICIC/SOME FIRM LT": {"counterparty_label": "SOME FIRM LT", "counterparty_bank": "ICICI_BANK"},
    "MB NEFT/DCBL100000000010/RITA/KIRAN DAS/": {"counterparty_label": "RITA", "counterparty_name": "KIRAN DAS", "counterparty_bank": "DCB_BANK", "transaction_reference": "DCBL100000000010"},
    "RTGS 100000000011 INDIA": {"payment_method": "RTGS", "counterparty_identifier": None},
    "Loan Disbursement/511": {"payment_method": "LOAN", "counterparty_identifier": None},
    "CASH": {"payment_method": None, "counterparty_identifier": None, "is_reversal": False},
    "": {"payment_method": None, "is_reversal": False},
}


def test_extraction(spark):
    rows = N.extract_counterparty(spark.createDataFrame([(k,) for k in CASES] + [(None,)], "description string")).collect()
    found = {r.description: r for r in rows}
    for text, want in CASES.items():
        for field, v in want.items():
            assert found[text][field] == v, (text, field)
    assert found[None].counterparty_identifier is None


@pytest.mark.parametrize(("text", "bank"), [("STATE BANK OF", "SBI"), ("AU small Fina", "AU_SMALL_FINANCE_BANK"), ("HDFC BANK LTD", "HDFC_BANK"), ("ST", None), ("NOWHERE", None)])
def test_cut_off_bank_names(spark, text, bank):
    assert spark.range(1).select(N.bank_full_name(F.lit(text))).first()[0] == bank


def test_dates(spark):
    cases = {"05-01-2024": "2024-01-05", "2024-01-05 10:00": "2024-01-05", "2024-1-5": "2024-01-05", "5/1/2024": "2024-01-05", "05-Jan-2024": "2024-01-05", "05-Jan-24": "2024-01-05", "05-Jan-85": "1985-01-05", "31-02-2024": None, "soon": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d and r.d[:10] for r in rows} == cases


def test_numbers(spark):
    cases = {"1,234.50": 1234.5, "-7": -7.0, "12d": None, "": None, " 3 ": 3.0, "1e3": 1000.0, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
    assert spark.range(1).select(S.number_cell(F.lit("2,500.00 Cr"))).first()[0] == 2500.0
