from __future__ import annotations

import io
import json
import zipfile

import pytest

from tallyweave.sources import sinks, statements, workbook

BANK = """Some Bank
Statement of Account No - 123456789012

TRAN_DATE,CHQNO,PARTICULARS,DR,CR,BAL,SOL
05-01-2024,-,UPI/100000000001/DR/ASHA/YESB/asha@ybl/UPI,"9,500.00",,12000.00,001
06-01-2024,77,"NEFT/YESB100000000002/REKH/FIRM, OF MANY PARTS",,25000,37000,001
,78,no date,5,,1,001
07-01-2024,79,nothing moved,0,0,1,001
08-01-2024,80,taken back,-50,,1,001
"""
TAB = "998877\tsavings\t\nTRAN-DATE\tCHQ-NUM\tTRAN\\_PARTICULAR\tWITHDRAWAL\tDEPOSIT\tBALANCE\t\n05-01-2024\t\tIMPS/P2A/100000000003//Corner Shop\t\t100\t5\t\n06-01-2024\t12\tPaid\\: rent\t40\t\t5\t\n"
CORE = "Ac_No,Ac_Name,Tran_ID,Tran_Date,Narration,Dr_Amt,Cr_Amt,Balance,pstd_dt,Tran_Type\n55,Someone,T1,05-01-2024,RTGS 1,10,,5,05-01-2024 10:00:00,T\n,Someone,T2,05-01-2024,RTGS 2,10,,5,,T\n"


def xlsx(sheets):
    """A workbook of inline strings."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("statements")
    (root / "deep").mkdir()
    (root / "a.csv").write_text("﻿" + BANK, encoding="utf-8")
    (root / "b.CSV").write_text(TAB)
    (root / "deep" / "c.csv").write_text(CORE)
    (root / "d.csv").write_text("hello,world\n1,2\n")
    (root / "e.pdf").write_bytes(b"%PDF")
    (root / "f.xlsx").write_bytes(xlsx({
        "one": [["My bank"], ["Account No", "", "44556677"], [], ["Value Date", "Txn Date", "Narration", "Debit", "Credit", "Balance"], ["1", "05-01-2024", "OPENING BALANCE", "", "9", "9"], ["1", "05-01-2024", "UPI:PAY:100000000006/MEERA S/Union Bank", "10.00 Dr", "", "9"]],
        "two": [["Tran Date", "Particulars", "Txn_Amt", "Cod_DrCr", "Balance"], ["06-01-2024", "shop", "70", "C", "1"], ["06-01-2024", "odd", "70", "?", "1"]],
        "notes": [["nothing", "to", "see"]],
    }))
    (root / "g.xlsx").write_bytes(b"not a workbook")
    return str(root)


def test_directory(spark, folder):
    txns, report = statements.ingest(spark, folder)
    status = {r.file: (r.status, r.error_type, r.n_txns) for r in report.collect()}
    assert status == {
        "a.csv": ("ingested", None, 3), "b.CSV": ("ingested", None, 2), "c.csv": ("ingested", None, 1), "d.csv": ("failed", "ValueError", 0),
        "e.pdf": ("skipped", None, 0), "f.xlsx": ("ingested", None, 2), "g.xlsx": ("failed", "BadZipFile", 0),
    }
    rows = {(r.source_file, r.description): r for r in txns.collect()}
    first = rows["a.csv", "UPI/100000000001/DR/ASHA/YESB/asha@ybl/UPI"]
    assert (first.account_id, first.amount, first.direction, first.transaction_id, first.counterparty_upi) == ("123456789012", 9500.0, "DEBIT", "a.csv:0", "asha@ybl")
    assert rows["a.csv", "NEFT/YESB100000000002/REKH/FIRM, OF MANY PARTS"].direction == "CREDIT"
    assert rows["a.csv", "taken back"].amount == 50.0
    assert rows["b.CSV", "Paid: rent"].transaction_id == "12" and rows["b.CSV", "Paid: rent"].account_id == "998877"
    assert rows["c.csv", "RTGS 1"].time == "05-01-2024 10:00:00" and rows["c.csv", "RTGS 1"].transaction_type == "T"
    book = rows["f.xlsx", "UPI:PAY:100000000006/MEERA S/Union Bank"]
    assert (book.account_id, book.amount, book.date, book.source_format, book.counterparty_bank) == ("44556677", 10.0, "05-01-2024", "xlsx_generic:one", "UNION_BANK_OF_INDIA")
    assert rows["f.xlsx", "shop"].direction == "CREDIT" and rows["f.xlsx", "shop"].transaction_id == "f.xlsx:two:0"
    order = [r.source_file for r in txns.orderBy("txn_seq").collect()]
    assert order == sorted(order, key=["a.csv", "b.CSV", "c.csv", "f.xlsx"].index)


def test_layouts():
    assert [statements.layout(x.splitlines()) for x in (BANK, TAB.replace("\\_", "_"), CORE, "x")] == ["BANK_METADATA", "TABULAR", "ICORE", "UNKNOWN"]
    assert workbook.find_column(["VALUE DATE", "TXN DATE"], workbook.DATE, ("VALUE",)) == 1
    assert workbook.header_score(["a", "b", "c"]) == 0


def test_json_sources_and_sinks(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"r{k}.json").write_text(json.dumps({"held_out_type": "cycle", "seed": k}))
    assert statements.checkpoints(spark, str(tmp_path)).count() == 5
    (tmp_path / "r9.json").write_text(json.dumps({"held_out_type": "fan_in", "seed": 1}))
    with pytest.raises(ValueError, match="fan_in"):
        statements.checkpoints(spark, str(tmp_path))
    (tmp_path / "ab.json").write_text(json.dumps({"aggregate_by_type": {"cycle": {"GNN": {"pr_auc_mean": 0.5}}, "fan_in": {"GNN": {"pr_auc_mean": 0.25}}}}))
    assert {r.ring_type: r.pr_auc_mean for r in statements.seen_results(spark, str(tmp_path / "ab.json")).collect()} == {"cycle": 0.5, "fan_in": 0.25}
    sinks.write_json(spark, {"a": 1}, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"a": 1}


def test_small_files_share_batches():
    import pyarrow as pa

    book = xlsx({"one": [["Tran Date", "Particulars", "Txn_Amt", "Cod_DrCr", "Balance"], ["06-01-2024", "shop", "70", "C", "1"]]})
    paths = [f"x/{k}.{'csv' if k % 2 else 'xlsx'}" for k in range(100)] + ["x/bad.xlsx"]
    contents = [BANK.encode() if k % 2 else book for k in range(100)] + [b"no workbook"]
    files = pa.RecordBatch.from_pydict({"file_seq": list(range(101)), "path": paths, "content": contents})
    got = list(statements._parser(statements.READERS)(iter([files])))
    rows = [r for b in got for r in b.to_pylist()]
    assert len(got) == 1  # a batch for each file before
    assert [r["file_seq"] for r in rows if r["status"] == "ingested"] == list(range(100)) and rows[-1]["error_type"] == "BadZipFile"
    assert sum(r["status"] == "row" for r in rows) == 50 * 5 + 50


@pytest.mark.parametrize("cells", [["Tran Date", "Particulars", "Debit", "Balance"], ["Value Date", "Narration", "Credit"], ["Tran Date", "Particulars", "Amount", "x"], ["Date", "", None, "Desc"], ["06-01-2024", "shop", "70"], ["Desc", "Debit", "Balance"], [" dr/cr ", "txn  dt", "amount", "my remarks"]])
def test_header_score_counts_the_columns_found(cells):
    found = {role for role, at in workbook.columns(cells).items() if at is not None}
    there = [any(found.issuperset(roles) for roles in group) for group in workbook.SCORED]
    want = sum(there) if all(there[k] for k in workbook.NEEDED) and sum(there) >= workbook.LEAST_SCORE and sum(bool(workbook.norm(c)) for c in cells) >= 3 else 0
    assert workbook.header_score(cells) == want


def test_statements_are_a_table_of_one_file_an_account(spark):
    from pyspark.sql import functions as F

    from tallyweave.plans import catalog, catalog_studies, views

    from .conftest import SMALL

    accounts = views.view(spark, SMALL, "txn").select("account_id").distinct().count()
    heads = {0: lambda a: F.concat(F.lit("account "), a)}  # before, a folder of an own file for each account
    files = catalog._statements(spark, SMALL, heads, lambda *c: F.concat_ws(",", *c))
    assert files.columns == ["path", "content"] and files.count() == files.select("path").distinct().count() == accounts
    assert catalog_studies._workbooks(spark, SMALL).count() == accounts
