"""Canonical inputs for the operators, over the star-schema and event tables.

Each view is one SQL text that Spark and the oracle engine both read, so that
oracles start from the same rows; the operators under test are not in here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_REF = "lpad(cast(l_orderkey * 10 + l_linenumber as varchar(20)), 12, '5')"

#: Transactions out of order lines, with a narration of every form that the payment networks print.
TXN = f"""
select cast(o_custkey as varchar(20)) as account_id, l_suppkey, 'SUPPLIER#' || cast(l_suppkey as varchar(20)) as identifier,
       cast(l_extendedprice * (1 - l_discount) as double) as amount, l_shipdate as ts,
       case when l_returnflag = 'R' then 'CREDIT' else 'DEBIT' end as direction,
       case substr(o_orderpriority, 1, 1) when '1' then 'UPI' when '2' then 'IMPS' when '3' then 'NEFT' when '4' then 'RTGS' end as method,
       (l_returnflag = 'R' and l_linestatus = 'F') as is_reversal, n_name as bank, l_orderkey, l_linenumber,
       case substr(o_orderpriority, 1, 1)
         when '1' then case l_linenumber % 4
           when 1 then 'UPI/' || {_REF} || '/DR/' || upper(substr(n_name, 1, 4)) || '/YESB/' || lower(replace(s_name, '#', '.')) || '@ybl/UPI'
           when 2 then 'UPI:PAY:' || {_REF} || '/' || s_name || '/Kotak Mahi'
           when 3 then 'UPI/' || {_REF} || '/UPI/Mrs ' || n_name || '/State Bank Of'
           else 'REVERSED : UPI/' || {_REF} || '/DR/MR/AIRP/' || cast(l_suppkey as varchar(20)) end
         when '2' then case l_linenumber % 3
           when 1 then 'IMPS/P2A/' || {_REF} || '/KARB/' || s_name
           when 2 then 'IMPS/P2A/' || {_REF} || '//Nearby ' || n_name || ' Private'
           else 'IMPS:PAY:' || {_REF} || '/' || s_name || '/KARB/XX' || cast(1000 + l_suppkey % 9000 as varchar(20)) || '/1 rupe' end
         when '3' then case l_linenumber % 2
           when 1 then 'NEFT/YESB' || {_REF} || '/REKH/' || s_name
           else 'MB NEFT/DCBL' || {_REF} || '/RITU/' || n_name || ' DUBEY/' end
         when '4' then 'RTGS ' || {_REF} || ' ' || n_name
         else 'Loan Disbursement/' || {_REF} end as narration
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
"""

#: The graph's edges by those transactions.
EDGE = f"""
select case when direction = 'DEBIT' then 'ACC:' || account_id else 'CP:' || identifier end as src,
       case when direction = 'DEBIT' then 'CP:' || identifier else 'ACC:' || account_id end as dst,
       amount, ts as parsed_date, method as payment_method, is_reversal
from ({TXN}) t
"""

#: Edges with real times of day.
EVENT_EDGE = """
select 'ACC:' || cast(user_id as varchar(20)) as src, 'CP:' || event_type as dst, value as amount, ts as parsed_date, event_type as payment_method, false as is_reversal
from events
"""

#: Scores and labels of documents: the length as a score of quality.
SCORED = """
select cast(d.doc_id as varchar(20)) as node_id, cast(d.n_chars as double) as score, l.quality as label, d.lang as lang, d.source as source, l.toxic as toxic
from documents d join labels l on d.doc_id = l.doc_id
"""

VIEWS = {"txn": TXN, "edge": EDGE, "event_edge": EVENT_EDGE, "scored": SCORED}


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Resolved at once, so that later registrations of another folder do not matter."""
    register(spark, sf_dir)
    return spark.sql(VIEWS[name])


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The txn view in the transaction schema's terms, for graph building."""
    register(spark, sf_dir)
    return spark.sql(f"""
        select account_id, identifier as counterparty_identifier, identifier as counterparty_name, cast(null as string) as counterparty_label, bank as counterparty_bank,
               amount, date_format(ts, 'dd-MM-yyyy') as date, direction, method as payment_method, cast(l_orderkey as string) as transaction_id, is_reversal,
               'lineitem' as source_file, l_orderkey * 100 + l_linenumber as txn_seq, narration as description
        from ({TXN}) t""")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the edge view: accounts, and counterparties with their bank."""
    from ..operators.graph import build_nodes

    return build_nodes(transactions(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edge")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "event_edge")
