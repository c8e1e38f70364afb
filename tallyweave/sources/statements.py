"""Bank statement files: a directory scan, per-file parsers with error isolation, and typed transactions.

Files are read with Spark's binary reader, so any store will do; a parser runs
per file inside a task and a file that fails becomes a status row, not a failed
job.  Parsers only split files into raw fields; narrations, numbers and rules are
native expressions over the raw rows.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import narration, scalars
from ..operators.order import numbered
from ..schema import TRANSACTION
from ..session import materialize, ship
from . import workbook

SUPPORTED = (".csv", ".xlsx", ".xls")
SCAN_LINES = 15
# fixed values: headers of the three text layouts
BANK_COLUMNS = ("TRAN_DATE", "CHQNO", "PARTICULARS", "DR", "CR", "BAL", "SOL")
BANK_HEADER = "TRAN_DATE,CHQNO,PARTICULARS,DR,CR,BAL,SOL"
CORE_HEADER = "AC_NO,AC_NAME,TRAN_ID"
TAB_WORDS = ("TRAN-DATE", "TRAN_PARTICULAR", "WITHDRAWAL", "DEPOSIT", "BALANCE")
PREAMBLE = re.compile(r"STATEMENT OF ACCOUNT NO\s*-\s*(\d+)", re.I)

#: Raw fields of a parsed line, all text.
FIELDS = ("row", "sheet", "transaction_id", "account_id", "date", "time", "debit", "credit", "amount", "indicator", "balance", "transaction_type", "description", "format")
Raw = dict[str, str | int | None]


def decode(content: bytes) -> str:
    return content.decode("utf-8-sig", errors="replace")


def layout(lines: list[str]) -> str:
    """ICORE, BANK_METADATA, TABULAR or UNKNOWN, by the first lines, in this order."""
    head = "\n".join(lines[:SCAN_LINES]).upper().replace("\\_", "_")
    if CORE_HEADER in head.replace(" ", ""):
        return "ICORE"
    if BANK_HEADER in head.replace(" ", ""):
        return "BANK_METADATA"
    if all(w in head for w in TAB_WORDS[:2]):
        return "TABULAR"
    return "UNKNOWN"


def preamble_account(lines: list[str]) -> str | None:
    return next((m[1] for x in lines[:SCAN_LINES] if (m := PREAMBLE.search(x))), None)


def _said(x: str | None) -> str | None:
    x = (x or "").strip()
    return x or None


def bank_rows(text: str, stem: str) -> Iterator[Raw]:
    """Quoted CSV of seven fixed columns below a preamble that names the account; blank lines do not count."""
    lines = text.splitlines()
    account = preamble_account(lines) or stem
    top = next((k for k, x in enumerate(lines) if x.replace(" ", "").upper().startswith(BANK_HEADER)), None)
    if top is None:
        return
    rows = (r for r in csv.reader(lines[top + 1 :], skipinitialspace=True) if any(c.strip() for c in r))
    for k, cells in enumerate(rows):
        r = dict(zip(BANK_COLUMNS, cells, strict=False))
        number = _said(r.get("CHQNO"))
        yield {
            "row": k, "transaction_id": None if number == "-" else number, "account_id": account, "date": r.get("TRAN_DATE"), "debit": r.get("DR"),
            "credit": r.get("CR"), "balance": r.get("BAL"), "description": r.get("PARTICULARS"), "format": "csv",
        }


def tab_rows(text: str, stem: str) -> Iterator[Raw]:
    """Tab-separated; the first cell is the account, backslash escapes stand for themselves; nameless columns are skipped."""
    lines = text.splitlines()
    if len(lines) < 3:
        return
    plain = lambda x: x.replace("\\_", "_").replace("\\:", ":").strip()
    account = _said(lines[0].split("\t")[0])
    top = next((k for k, x in enumerate(lines) if all(w in plain(x).upper() for w in TAB_WORDS)), None)
    if top is None:
        return
    names = [plain(x).upper() for x in lines[top].split("\t")]
    for k, line in enumerate(x for x in lines[top + 1 :] if x.strip()):
        r = {n: plain(c) for n, c in zip(names, line.split("\t"), strict=False) if n}
        yield {
            "row": k, "transaction_id": _said(r.get("CHQ-NUM")), "account_id": account, "date": r.get("TRAN-DATE"), "debit": r.get("WITHDRAWAL"),
            "credit": r.get("DEPOSIT"), "balance": r.get("BALANCE"), "description": r.get("TRAN_PARTICULAR"), "format": "csv",
        }


def core_rows(text: str, stem: str) -> Iterator[Raw]:
    """A header row, and the account on every row."""
    for k, r in enumerate(csv.DictReader(io.StringIO(text), skipinitialspace=True)):
        r = {(n or "").strip(): c for n, c in r.items() if isinstance(c, str)}
        yield {
            "row": k, "transaction_id": _said(r.get("Tran_ID")), "account_id": r.get("Ac_No"), "date": r.get("Tran_Date"), "time": _said(r.get("pstd_dt")),
            "debit": r.get("Dr_Amt"), "credit": r.get("Cr_Amt"), "balance": r.get("Balance"), "transaction_type": _said(r.get("Tran_Type")),
            "description": r.get("Narration"), "format": "csv",
        }


LAYOUTS: dict[str, Callable[[str, str], Iterator[Raw]]] = {"BANK_METADATA": bank_rows, "TABULAR": tab_rows, "ICORE": core_rows}


def text_statement(content: bytes, stem: str) -> list[Raw]:
    text = decode(content)
    kind = layout(text.splitlines())
    if kind not in LAYOUTS:
        raise ValueError(f"unknown layout: {text[:40]!r}")
    return list(LAYOUTS[kind](text, stem))


#: By suffix; replace an entry to plug in another reader.
READERS: dict[str, Callable[[bytes, str], list[Raw]]] = {".csv": text_statement, ".xlsx": workbook.statement, ".xls": workbook.statement}

_OUT = pa.schema([("file_seq", pa.int64()), ("file", pa.string()), ("status", pa.string()), ("error_type", pa.string()), ("error", pa.string())] + [(f, pa.int64() if f == "row" else pa.string()) for f in FIELDS])
_DDL = "file_seq bigint, file string, status string, error_type string, error string, " + ", ".join(f"`{f}` {'bigint' if f == 'row' else 'string'}" for f in FIELDS)


#: Rows that a parser gathers before it hands them on, over as many files as it takes.
BATCH_ROWS = 8192


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _OUT], schema=_OUT)


def _parser(readers: dict[str, Callable]) -> Callable:
    def read(seq: int, path: str, content: pa.Scalar) -> list[dict]:
        name = path.rsplit("/", 1)[-1]
        stem, dot, suffix = name.rpartition(".")
        head = {"file_seq": seq, "file": name}
        reader = readers.get(dot + suffix.lower())
        if reader is None:
            return [head | {"status": "skipped"}]
        try:
            return [*(head | {"status": "row"} | r for r in reader(content.as_py(), stem)), head | {"status": "ingested"}]
        except Exception as e:  # noqa: BLE001  one bad file must not end the batch
            return [head | {"status": "failed", "error_type": type(e).__name__, "error": str(e)[:80]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for seq, path, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                rows += read(seq.as_py(), path.as_py(), content)
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return run


def parse(spark: SparkSession, root: str, readers: dict[str, Callable] | None = None) -> DataFrame:
    """Status rows and raw rows of every file under ``root``; ``file_seq`` follows the sorted paths."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), readers)


def parse_files(files: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """The same for files at hand: path, content."""
    ship(files.sparkSession)
    order = numbered(files.select("path"), ["path"], "file_seq")
    return files.select("path", "content").join(order, "path").select("file_seq", "path", "content").mapInArrow(_parser(readers or READERS), _DDL)


def report(parsed: DataFrame) -> DataFrame:
    """file, status (ingested, skipped, failed), error_type, error, n_txns."""
    n = typed(parsed).groupBy("file_seq").agg(F.count("*").alias("n_txns"))
    rows = parsed.filter("status != 'row'").join(n, "file_seq", "left")
    return rows.select("file", "status", "error_type", "error", F.coalesce("n_txns", F.lit(0)).alias("n_txns"))


def typed(parsed: DataFrame) -> DataFrame:
    """Raw rows that make transactions: a date, a description, an account where rows carry it, and an amount."""
    sheet = F.col("format").startswith("xlsx")
    text = lambda c: F.when(sheet, scalars.clean_cell(F.col(c))).otherwise(scalars.clean(F.col(c)))
    num = lambda c: F.when(sheet, scalars.number_cell(F.col(c))).otherwise(scalars.number(F.col(c)))
    rows = parsed.filter("status = 'row'").select(
        "file_seq", "file", "row", "sheet", "format", "transaction_id", "time", "transaction_type",
        *[text(c).alias(c) for c in ("account_id", "date", "description", "indicator")], *[num(c).alias(c) for c in ("debit", "credit", "amount", "balance")],
    )
    side = F.upper(F.substring("indicator", 1, 1))
    single = F.when(F.col("amount").isNotNull() & (F.col("amount") != 0) & side.isin("D", "C"), F.struct(F.abs("amount").alias("amount"), F.when(side == "D", "DEBIT").otherwise("CREDIT").alias("direction")))
    rows = rows.withColumn("_m", F.coalesce(scalars.amount_rule(F.col("debit"), F.col("credit")), single))
    rows = rows.filter(F.col("date").isNotNull() & F.col("description").isNotNull() & F.col("account_id").isNotNull() & F.col("_m").isNotNull())
    return rows.filter(~(sheet & scalars.norm(F.col("description")).isin(*workbook.SKIP)))


def transactions(parsed: DataFrame) -> DataFrame:
    """Typed transactions, with ``file_seq`` and ``txn_seq`` after the columns of the schema."""
    rows = narration.extract_counterparty(typed(parsed))
    made = F.concat_ws(":", "file", "sheet", "row")
    place = F.row_number().over(Window.partitionBy("file_seq").orderBy("sheet", "row"))
    # files stay apart: a file's rows are numbered within 2^32 places of its own
    rows = rows.withColumn("txn_seq", (F.col("file_seq") * F.lit(1 << 32) + place).cast("bigint"))
    kinds = {f.name: f.dataType for f in TRANSACTION}
    put = {
        "transaction_id": F.coalesce("transaction_id", made), "amount": F.col("_m.amount"), "direction": F.col("_m.direction"),
        "reference_id": F.lit(None), "source_file": F.col("file"), "source_format": F.col("format"),
    }
    return rows.select(*[put.get(n, F.col(n)).cast(k).alias(n) for n, k in kinds.items()], "file_seq", "txn_seq")


def ingest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, report) of a directory."""
    parsed = materialize(parse(spark, root), "parsed")  # both read it; files are parsed once
    return transactions(parsed), report(parsed)


def core_table(spark: SparkSession, root: str) -> DataFrame:
    """Core exports (a header row, the account on every row) of any size under ``root``, as :func:`parse` gives them.

    The CSV reader splits large files, so none is held in memory; quoted line
    breaks are the one thing that needs :func:`parse`.
    """
    read = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("recursiveFileLookup", "true").option("quote", '"').option("escape", '"').csv(root)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    rows = materialize(read.select("*", F.col("_metadata.file_path").alias("_path"), place.alias("_at")), "core-rows")
    paths = numbered(rows.select("_path").distinct(), ["_path"], "file_seq")
    rows = numbered(rows, ["_path", "_at"], "_row").join(paths, "_path")
    said = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    has = lambda c, v: v if c in read.columns else F.lit(None).cast("string")
    put = {
        "file_seq": F.col("file_seq"), "file": F.element_at(F.split("_path", "/"), -1), "status": F.lit("row"), "row": F.col("_row"), "transaction_id": has("Tran_ID", said("Tran_ID")), "account_id": F.col("Ac_No"),
        "date": F.col("Tran_Date"), "time": has("pstd_dt", said("pstd_dt")), "debit": F.col("Dr_Amt"), "credit": F.col("Cr_Amt"), "balance": has("Balance", F.col("Balance")),
        "transaction_type": has("Tran_Type", said("Tran_Type")), "description": F.col("Narration"), "format": F.lit("csv"),
    }
    return rows.select(*[put.get(f.name, F.lit(None)).cast("bigint" if f.type == pa.int64() else "string").alias(f.name) for f in _OUT])


def checkpoints(spark: SparkSession, root: str, per_type: int = 5) -> DataFrame:
    """JSON results of held-out runs; each held-out type must have ``per_type`` of them."""
    rows = spark.read.option("multiLine", "true").json(root)
    counts = {r.held_out_type: r["count"] for r in rows.groupBy("held_out_type").count().collect()}  # a handful of types
    if any(n != per_type for n in counts.values()):
        raise ValueError(f"results per held-out type: {counts}")
    return rows


def seen_results(spark: SparkSession, path: str) -> DataFrame:
    """ring_type and the seen-type results of the graph model, from an ablation's JSON."""
    rows = spark.read.option("multiLine", "true").json(path)
    types = rows.schema["aggregate_by_type"].dataType.names
    each = F.array(*[F.struct(F.lit(t).alias("ring_type"), F.col(f"aggregate_by_type.{t}.GNN").alias("gnn")) for t in types])
    return rows.select(F.explode(each).alias("x")).select("x.ring_type", "x.gnn.*")
