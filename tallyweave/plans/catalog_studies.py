"""Queries of studies, learned models, sinks and files.

What is random is queried by invariants that any right result has (counts,
sizes, disjointness), and models by fixed weights, so that SQL can state them.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, graph, metrics, model, plain, rings, rules
from ..operators.order import numbered
from ..session import materialize, run_dir, ship
from ..sources import sinks, statements
from . import reports, study, views
from .catalog import _AP, _AUC, _CHANNELS, _FEATURES, _PAIRS, _PER, _RING, _ROC, _embedding, _extra, _per_seed, _rings, _scored, _vector_pairs, query


def _at(spark, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    return materialize(views.edges(spark, d).withColumns(_extra()), "edges"), materialize(views.nodes(spark, d), "nodes")


# scalars and small operators ---------------------------------------------------------------------------------------

_CELLS = "select c_custkey, case c_custkey % 6 when 0 then ' 1,2' || cast(c_custkey as varchar(20)) || '.50 Cr' when 1 then '-' || cast(c_custkey as varchar(20)) || 'DR ' when 2 then ' NaN ' when 3 then '  ' when 4 then 'Tran   date ' || cast(c_custkey as varchar(20)) else cast(c_custkey as varchar(20)) end as t from customer"


@query(f"""select c_custkey, case when c_custkey % 6 in (0, 1, 5) then cast(regexp_replace(replace(trim(t), ',', ''), '(?i)\\s*(CR|DR)$', '') as double) end as number,
case when lower(trim(t)) not in ('nan', '') then trim(t) end as cleaned, regexp_replace(upper(trim(t)), '\\s+', ' ', 'g') as normal from ({_CELLS}) x""")
def workbook_cells(spark, d):
    views.register(spark, d)
    t = F.col("t")
    return spark.sql(_CELLS).select("c_custkey", S.number_cell(t).alias("number"), S.clean_cell(t).alias("cleaned"), S.norm(t).alias("normal"))


@query("""select label, round(avg(greatest(embedding[1], 0e0)), 6) as relu, round(avg(-(y * ln(p + 1e-7) + (1 - y) * ln(1 - p + 1e-7))), 6) as loss
from (select label, embedding, label % 2 as y, 1 / (1 + exp(-cast(embedding[1] as double))) as p from embeddings) x group by label""")
def relu_and_cross_entropy(spark, d):
    first = F.get("embedding", 0).cast("double")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", first.alias("x"), (F.col("label") % 2).alias("y"), S.sigmoid(first).alias("p"))
    return rows.groupBy("label").agg(F.round(F.avg(S.relu(F.col("x"))), 6).alias("relu"), F.round(S.cross_entropy(F.col("p"), F.col("y")), 6).alias("loss"))


@query("""select node_id, row_number() over (order by s, node_id) - 1 as idx from (
select 'ACC:' || account_id as node_id, min(l_orderkey * 100 + l_linenumber) * 2 as s from txn group by account_id union all select 'CP:' || identifier, min(l_orderkey * 100 + l_linenumber) * 2 + 1 from txn group by identifier) x""")
def node_index(spark, d):
    return graph.node_index(views.nodes(spark, d))


@query("select count(*) as n, count(distinct i || j) as n_distinct, 0::bigint as loops, 0::bigint as linked from (select distinct src as i, dst as j from edge) x")
def negative_invariants(spark, d):
    """As many as the positives, all different, no loops, no edge either way."""
    e = materialize(views.edges(spark, d), "edges")
    rows = materialize(graph.negative_pairs(e, views.nodes(spark, d)), "negatives")
    linked = rows.join(graph.adjacency(e).select("i", "j"), ["i", "j"], "left_semi").agg(F.count("*").alias("linked"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct(F.concat("i", "j")).alias("n_distinct"), F.count_if(F.expr("i = j")).alias("loops")).crossJoin(F.broadcast(linked))  # one row each


# metrics -------------------------------------------------------------------------------------------------------------

_BUNDLE = f"""{_AUC.format(by="lang,", part="partition by lang")}, a as (select lang, cast(sum(n) as bigint) as n, cast(sum(p) as bigint) as n_positive, {_ROC} as roc_auc, {_AP} as pr_auc from d group by lang),
r as (select lang, label, row_number() over (partition by lang order by score desc, node_id) as rn from scored),
h as (select r.lang, count(*) filter (where label = 1 and rn <= n_positive) as hn, count(*) filter (where label = 1 and rn <= 10) as h10, count(*) filter (where label = 1 and rn <= 25) as h25 from r join a on r.lang is not distinct from a.lang group by r.lang)
select a.lang, n, n_positive, round(roc_auc, 9) as roc_auc, round(pr_auc, 9) as pr_auc, case when n_positive > 0 then round(hn / n_positive, 9) end as precision_at_n, case when n >= 10 then round(h10 / 10, 9) end as precision_at_10, case when n >= 25 then round(h25 / nullif(n_positive, 0), 9) end as recall_at_25
from a join h on a.lang is not distinct from h.lang"""
_SHOWN = ("roc_auc", "pr_auc", "precision_at_n", "precision_at_10", "recall_at_25")


@query(_BUNDLE)
def metrics_bundle(spark, d):
    out = metrics.compute_metrics(_scored(spark, d), by=["lang"])
    return out.select("lang", "n", "n_positive", *[F.round(c, 9).alias(c) for c in _SHOWN])


@query(_BUNDLE)
def metrics_located(spark, d):
    """The same, read off the places of the positives among the negatives."""
    s = _scored(spark, d)
    rows = metrics.located(s.select("lang", "node_id", "score"), s.filter("label = 1").select("node_id"), ["lang"])
    return metrics.located_metrics(rows, ["lang"]).select("lang", "n", "n_positive", *[F.round(c, 9).alias(c) for c in _SHOWN])


_SYN = "(select case when label = 1 then 'SYN:' else '' end || node_id as node_id, score, label from scored)"
_RECOVERY = f"""with r as (select *, row_number() over (order by score, node_id) as up, row_number() over (order by score desc, node_id) as rn, count(*) over () as n, sum(label) over () as pos from {_SYN} x),
c as (select score, sum(label) as p, count(*) as n from r group by score), d as (select *, coalesce(sum(n - p) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from c)"""


@query(f""", z as ({_RECOVERY} select (select sum(p * (below + (n - p) / 2e0)) / nullif(sum(p) * sum(n - p), 0) from d) as roc_auc, cast(max(pos) as bigint) as k, count(*) filter (where label = 1 and rn <= pos) / max(pos) as precision_at_k,
avg((up - 1) / (n - 1)) filter (where label = 1) as synthetic, avg((up - 1) / (n - 1)) filter (where label = 0) as real, cast(max(pos) as bigint) as n_synthetic, cast(max(n) - max(pos) as bigint) as n_real from r)
select round(roc_auc, 9) as roc_auc, k, round(precision_at_k, 9) as precision_at_k, round(synthetic, 9) as synthetic, round(real, 9) as real, n_synthetic, n_real from z""")
def recovery_plain(spark, d):
    """The first version's evaluation: no cores, no tiers."""
    s = _scored(spark, d).select(F.concat(F.when(F.col("label") == 1, "SYN:").otherwise(""), "node_id").alias("node_id"), "score")
    none = spark.createDataFrame([], "ring_id int, ring_type string, tier string, nodes array<string>, core_nodes array<string>")
    out = plain.recovery(s, none)[0]
    return out.select(*[F.round(c, 9).alias(c) if c in ("roc_auc", "precision_at_k", "synthetic", "real") else F.col(c).cast("bigint").alias(c) for c in ("roc_auc", "k", "precision_at_k", "synthetic", "real", "n_synthetic", "n_real")])


@query(_RING + """, x as (select row_number() over (order by score, node_id) - 1 as rk, count(*) over () - 1 as m1, node_id from scored)
select ring_id, ring_type, count(*) as n_nodes, round(avg(rk / m1), 9) as mean_percentile, round(max(rk / m1), 9) as max_percentile from m join x using (node_id) group by ring_id, ring_type""")
def recovery_by_ring(spark, d):
    out = plain.recovery(_scored(spark, d).select("node_id", "score", "label"), _rings(spark, d), "label")[1]
    return out.select("ring_id", "ring_type", "n_nodes", F.round("mean_percentile", 9).alias("mean_percentile"), F.round("max_percentile", 9).alias("max_percentile"))


@query(_RING + """, r as (select node_id, (row_number() over (order by score, node_id) - 1) / (count(*) over () - 1) as rank from scored),
y as (select node_id, score, 0 as label from scored where node_id not in (select node_id from m) union all select node_id, score, 1 from m where is_core),
e as (select score, sum(label) as p, count(*) as n from y group by score), g as (select *, coalesce(sum(n - p) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from e)
select (select round(sum(p * (below + (n - p) / 2e0)) / nullif(sum(p) * sum(n - p), 0), 9) from g) as core_auc, count(distinct ring_type || tier) as cells, round(avg(rank), 9) as mean_of_members from m join r using (node_id)""")
def recovery_evaluation(spark, d):
    """The evaluation bundle: area of cores, cells of the benchmark table, and the members' mean percentile from it."""
    found = metrics.evaluate_recovery(_scored(spark, d).select("node_id", "score"), _rings(spark, d))
    ranks = metrics.rank_normalize(_scored(spark, d).select("node_id", "score"))
    own = metrics.members(_rings(spark, d)).join(ranks, "node_id").agg(F.round(F.avg("rank"), 9).alias("mean_of_members"))
    one = spark.createDataFrame([(found["core_auc"], len(found["benchmark"]))], "core_auc double, cells bigint")
    return one.select(F.round("core_auc", 9).alias("core_auc"), "cells").crossJoin(F.broadcast(own))  # one row each


@query(_RING + "select ring_type, arg_min(ring_id, (case tier when 'hard' then 0 else 1 end, ring_id)) as ring_id, arg_min(tier, (case tier when 'hard' then 0 else 1 end, ring_id)) as tier from m group by ring_type")
def hardest_rings(spark, d):
    return study.hardest_rings(_rings(spark, d)).select("ring_type", "ring_id", "tier")


def _as_heldout(spark, d):
    rows = _per_seed(spark, d).withColumns({"precision_at_n": F.col("roc_auc"), "recall_at_n": F.col("pr_auc"), "held_out_type": F.col("ring_type"), "overlap": F.lit(0).cast("bigint")})
    return rows.withColumns({"ring_type": F.lit(None).cast("string"), "method": F.when(F.col("method") == "en", "GNN").otherwise(F.upper("method"))})


@query(_PER + "select ring_type as held_out_type, case method when 'en' then 'GNN' else upper(method) end as method, tier, round(avg(pr_auc), 9) as pr_auc_mean, round(stddev_pop(pr_auc), 9) as pr_auc_std, round(avg(roc_auc), 9) as precision_at_n_mean, 1 as n_overlaps from per group by ring_type, method, tier")
def heldout_aggregates(spark, d):
    out = study.aggregate_heldout(_as_heldout(spark, d))
    return out.select("held_out_type", "method", "tier", *[F.round(c, 9).alias(c) for c in ("pr_auc_mean", "pr_auc_std", "precision_at_n_mean")], F.size("overlaps").alias("n_overlaps"))


@query(_PER + "select ring_type as held_out_type, round(max(pr) filter (where method = 'de'), 9) as seen, round(max(pr) filter (where method = 'en'), 9) as unseen from (select ring_type, method, avg(pr_auc) as pr from per group by ring_type, method) x group by ring_type having count(*) filter (where method = 'en') > 0 and count(*) filter (where method = 'de') > 0")
def seen_and_unseen(spark, d):
    rows = _as_heldout(spark, d).withColumn("tier", F.lit(None).cast("string"))
    seen = metrics.mean_std(rows.filter("method = 'DE'").withColumns({"method": F.lit("GNN"), "ring_type": F.col("held_out_type")}), ["method", "ring_type", "tier"], ["pr_auc"])
    out = study.seen_and_unseen(study.aggregate_heldout(rows), seen)
    return out.select("held_out_type", F.round("seen", 9).alias("seen"), F.round("unseen", 9).alias("unseen"))


@query(_PER + "select method || ' ' || coalesce(printf('%.3f ± %.3f', avg(roc_auc), stddev_pop(roc_auc)), 'n/a') || ' ' || coalesce(printf('%.3f ± %.3f', avg(pr_auc), stddev_pop(pr_auc)), 'n/a') as line from per group by method")
def formatted_table(spark, d):
    """The overall table of a report as text lines."""
    rows = _per_seed(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("ring_type", "tier")}).withColumns({"precision_at_n": F.lit(0.5), "recall_at_n": F.lit(0.25)})
    got = reports.rows_of(study.aggregate(rows))
    names = tuple(sorted({r["method"] for r in got}))
    lines = reports.grid([r[:3] for r in reports.overall_rows(got, names)]).split("\n")[1:]
    return spark.createDataFrame([(" ".join(x.split()),) for x in lines], "line string")


# rings, held-out splits, models ----------------------------------------------------------------------------------------

_KINDS = "(values " + ", ".join(f"('{t}', '{k}')" for t in rings.TYPES for k in rings.TIERS) + ") v(ring_type, tier)"


@query(f"select ring_type, tier, 2::bigint as n_rings, true as sizes, true as cores, true as named, true as dated, true as partners, true as noise from {_KINDS}")
def ring_invariants(spark, d):
    """Of each type and tier: how many rings, and whether sizes, cores, ids, dates, partners and noise are as they must be."""
    e, n, r = rings.inject(*_graph(spark, d), per_cell=2, seed=13)
    new = materialize(e.filter("is_synthetic"), "synthetic")
    real = n.filter("not is_synthetic").select(F.col("node_id").alias("_real"))
    other = F.when(F.col("src").startswith("SYN:"), F.col("dst")).otherwise(F.col("src"))
    known = new.withColumn("_o", other).join(real, F.col("_o") == F.col("_real"), "left").withColumn("_ok", F.col("_o").startswith("SYN:") | F.col("_real").isNotNull())
    per = known.groupBy("ring_id").agg(
        F.bool_and(F.col("date") == F.date_format("parsed_date", "dd-MM-yyyy")).alias("dated"), F.bool_and("_ok").alias("partners"), F.count_if("is_noise").alias("noisy"), F.bool_and((F.col("amount") > 0) & (F.col("payment_method") == "UPI")).alias("paid"),
    )
    rows = r.join(per, "ring_id")
    wanted = F.when(F.col("ring_type") == "probe_and_drain", F.size("nodes") == 2).when(F.col("ring_type").startswith("fan"), F.size("nodes").between(7, 9)).otherwise(F.size("nodes").between(6, 8))
    core = F.when(F.col("ring_type") == "probe_and_drain", 1).when(F.col("ring_type") == "mule_chain", 2).otherwise(F.size("nodes"))
    return rows.groupBy("ring_type", "tier").agg(
        F.count("*").alias("n_rings"), F.bool_and(wanted).alias("sizes"), F.bool_and((F.size("core_nodes") == core) & (F.size(F.array_except("core_nodes", "nodes")) == 0)).alias("cores"),
        F.bool_and(F.forall("nodes", lambda x: F.startswith(x, F.concat(F.lit("SYN:R"), F.col("ring_id").cast("string"), F.lit("_N"))))).alias("named"),
        F.bool_and(F.col("dated") & F.col("paid")).alias("dated"), F.bool_and("partners").alias("partners"), F.bool_and((F.col("tier") != "easy") | (F.col("noisy") == 0)).alias("noise"),
    )


@query("select t as ring_type, 4::bigint as n_rings, true as sizes, 0::bigint as noise from (values ('cycle'), ('fan_out'), ('fan_in')) v(t)")
def plain_ring_invariants(spark, d):
    """The first version's rings: three types in turn, small, without tiers or noise."""
    e, _, r = rings.inject_plain(*_graph(spark, d), n_rings=12, seed=13)
    noise = e.filter("is_synthetic").groupBy("ring_id").agg(F.count_if("is_noise").alias("noisy"))
    return r.join(noise, "ring_id").groupBy("ring_type").agg(F.count("*").alias("n_rings"), F.bool_and(F.size("nodes").between(4, 7) & F.col("tier").isNull()).alias("sizes"), F.sum("noisy").alias("noise"))


@query("select 0::bigint as shared_ids, 0::bigint as shared_edges, 24::bigint as train_rings, 6::bigint as test_rings, 4::bigint as train_types, true as renamed, count(*) as real_edges from edge")
def heldout_invariants(spark, d):
    """Training and test share no synthetic id and no synthetic edge; both hold all real edges."""
    (e, _, r), (te, tn, tr) = rings.heldout_split(*_graph(spark, d), "cycle", 2)
    ids = metrics.overlap(metrics.members(r), metrics.members(tr)).withColumnRenamed("n_shared", "shared_ids")
    key = lambda x: x.filter("is_synthetic").select("src", "dst", "amount", "parsed_date")
    edges = key(e).intersect(key(te)).agg(F.count("*").alias("shared_edges"))
    kinds = r.agg(F.count("*").alias("train_rings"), F.count_distinct("ring_type").alias("train_types"))
    tests = tr.agg(F.count("*").alias("test_rings"))
    named = tn.filter("is_synthetic").agg(F.bool_and(F.col("node_id").startswith("SYNTEST:")).alias("renamed"))
    real = e.filter("not is_synthetic").agg(F.count("*").alias("real_edges"))
    out = ids
    for one in (edges, kinds, tests, named, real):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


_W = {"w0": np.array([[0.5, -0.25], [0.001, 0.002]]), "w1": np.array([[0.25, 0.5], [-0.5, 0.125]])}
_X = "x as (select node, cast(count(*) as double) as f, max(amount) as g from inc group by node)"
_NORM = "pat as (select src as i, dst as j from edge union select dst, src from edge), lp as (select * from pat union select i, i from pat), deg as (select i, count(*) as d from lp group by i), nm as (select lp.i, lp.j, 1 / (sqrt(a.d) * sqrt(b.d)) as w from lp join deg a on lp.i = a.i join deg b on lp.j = b.i)"


def _two(spark, d):
    e = materialize(views.edges(spark, d), "edges")
    feats = graph.incidence(e).groupBy(F.col("node").alias("node_id")).agg(F.count("*").cast("double").alias("f"), F.max("amount").alias("g"))
    return e, materialize(feats, "features")


_ROW = lambda w, a, b: " + ".join(f"{c} * ({float(w[k, b])!r})" for k, c in enumerate(a))


@query(f""", {_X}, {_NORM}, sx as (select nm.i, sum(w * f) as f, sum(w * g) as g from nm join x on nm.j = x.node group by nm.i),
h as (select i, greatest(0e0, {_ROW(_W['w0'], ('f', 'g'), 0)}) as h0, greatest(0e0, {_ROW(_W['w0'], ('f', 'g'), 1)}) as h1 from sx),
m as (select i, {_ROW(_W['w1'], ('h0', 'h1'), 0)} as m0, {_ROW(_W['w1'], ('h0', 'h1'), 1)} as m1 from h)
select nm.i as node_id, round(sum(w * m0), 3) as z0, round(sum(w * m1), 3) as z1 from nm join m on nm.j = m.i group by nm.i""")
def plain_embedding(spark, d):
    """The first version's forward pass at fixed weights."""
    out = plain.embed(plain.Plain(_W["w0"], _W["w1"], ["f", "g"], []), *_two(spark, d))
    return out.select("node_id", F.round(F.get("z", 0), 3).alias("z0"), F.round(F.get("z", 1), 3).alias("z1"))


_DIRECTED = {c: (k + 1) * 0.125 * np.array([[1.0, -0.5], [0.0078125, 0.00390625]]) for k, c in enumerate((*model.CHANNELS, "self"))}
_PRE = lambda b: " + ".join(f"coalesce({c}_{x}, 0) * ({float(w[k, b])!r})" for c, w in _DIRECTED.items() for k, x in enumerate(("f", "g")))


@query(_CHANNELS + f""", {_X}, {_NORM}, th as (select channel, i, sum(w * f) as f, sum(w * g) as g from ch join x on ch.j = x.node group by channel, i),
wide as (select i, {', '.join(f"max({v}) filter (where channel = '{c}') as {c}_{v}" for c in model.CHANNELS for v in ('f', 'g'))} from th group by i),
h as (select x.node as i, greatest(0e0, {_PRE(0)}) as h0, greatest(0e0, {_PRE(1)}) as h1 from (select node, f as self_f, g as self_g from x) x left join wide on x.node = wide.i),
m as (select i, {_ROW(_W['w1'], ('h0', 'h1'), 0)} as m0, {_ROW(_W['w1'], ('h0', 'h1'), 1)} as m1 from h)
select nm.i as node_id, round(sum(w * m0), 1) as z0, round(sum(w * m1), 1) as z1 from nm join m on nm.j = m.i group by nm.i""")
def gae_forward(spark, d):
    """The directed model's forward pass at fixed weights."""
    w = {k: x.astype(np.float32) for k, x in _DIRECTED.items()} | {"w2": _W["w1"].astype(np.float32), "q": np.eye(2, dtype=np.float32), "k": np.eye(2, dtype=np.float32)}
    e, feats = _two(spark, d)
    out = model.embed(model.Model(w, ["f", "g"], []), e, feats)
    return out.select("node_id", F.round(F.get("z", 0), 1).alias("z0"), F.round(F.get("z", 1), 1).alias("z1"))


@query(f""", x as ({_PAIRS}), u as (select distinct least(src, dst) as a, greatest(src, dst) as b from x),
y as (select a, b, 1 - 1 / (1 + exp(-greatest(-30, least(30, list_dot_product(cast(p.embedding as double[]), cast(q.embedding as double[])))))) as s from u join embeddings p on p.vec_id = a join embeddings q on q.vec_id = b),
z as (select a as node_id, s from y union all select b, s from y) select vec_id as node_id, round(coalesce(avg(s), 0), 6) as score from embeddings left join z on node_id = vec_id group by vec_id""")
def plain_reconstruction(spark, d):
    """Undirected pairs, each once."""
    return plain.reconstruction_scores(_vector_pairs(spark, d), _embedding(spark, d)).select("node_id", F.round("score", 6).alias("score"))


@query(""", w as (select node, count(*) over r as c, sum(cast(amount as decimal(18,4))) over r as a from inc window r as (partition by node order by parsed_date range between current row and interval 10 minutes following)),
b as (select node, max(case when c >= 4 and a > 10000 then least(1e0, (c - 3) / 6e0) else 0 end) as burst from w group by node), s as (select node, avg(case when amount between 9000 and 9999 then 1e0 else 0e0 end) as near from inc group by node)
select node as node_id, round(burst, 9) as burst, round(near, 9) as smurfing_proximity, 0e0 as money_flow, 0e0 as circular_return, round(greatest(burst, near), 9) as combined from b join s using (node)""")
def plain_rules(spark, d):
    """The fourth version's rules with their stubs and maximum."""
    inc = graph.incidence(views.edges(spark, d))
    out = rules.combined_plain(inc, inc.select(F.col("node").alias("node_id")).distinct())
    return out.select("node_id", *[F.round(c, 9).alias(c) for c in ("burst", "smurfing_proximity")], *rules.PLAIN_STUBS, F.round("combined", 9).alias("combined"))


_SLICES = "(select null as ring_type, null as tier union all select t, null from (values " + ", ".join(f"('{t}')" for t in rings.TYPES) + ") a(t) union all select null, t from (values " + ", ".join(f"('{t}')" for t in rings.TIERS) + ") b(t)) s"
_QUICK = {"per_cell": 1, "epochs": 4, "hidden": 8, "embed": 4, "rate": 0.02}


def _ranges(rows: DataFrame, *names: str) -> DataFrame:
    ok = (F.col("roc_auc").between(0, 1)) & F.col("pr_auc").between(0, 1) & (F.col("n_positive") > 0) & (F.col("precision_at_n") == F.col("recall_at_n"))
    return rows.select(*names, F.coalesce(ok, F.lit(False)).alias("ok"))


def _study_sql(columns: str, methods: tuple[str, ...]) -> str:
    return f"select m.method, s.ring_type, s.tier, {columns} from (values " + ", ".join(f"('{m}')" for m in methods) + f") m(method), {_SLICES}"


@query(_study_sql("true as ok", study.METHODS))
def comparison_study(spark, d):
    """One seed, four methods, every slice."""
    return _ranges(study.over_seeds(*_graph(spark, d), seeds=(1,), **_QUICK), "method", "ring_type", "tier")


@query(_study_sql("true as ok", study.METHODS))
def ablation_study(spark, d):
    return _ranges(study.over_seeds(*_graph(spark, d), seeds=(2,), forest_on="x", **_QUICK), "method", "ring_type", "tier")


@query("select m.method, s.ring_type, s.tier, 0::bigint as overlap, true as ok from (values ('GNN'), ('IF')) m(method), (select null as ring_type, null as tier union all select 'cycle', null union all select null, t from (values " + ", ".join(f"('{t}')" for t in rings.TIERS) + ") b(t)) s")
def heldout_study(spark, d):
    """One held-out type, one seed."""
    return _ranges(study.heldout(*_graph(spark, d), "cycle", 1, **_QUICK), "method", "ring_type", "tier", "overlap")


# sinks: written, and read back ---------------------------------------------------------------------------------------

@query(_FEATURES + "select node_id, degree, round(max_amount, 4) as max_amount, active_days, round(weekend_ratio, 6) as weekend_ratio from f")
def sink_features(spark, d):
    at = _at(spark, "node-features")
    sinks.write_csv(features.node_features(views.edges(spark, d), views.nodes(spark, d)), at)
    rows = spark.read.option("header", "true").csv(at)
    return rows.select("node_id", F.col("degree").cast("bigint").alias("degree"), F.round(F.col("max_amount").cast("double"), 4).alias("max_amount"), F.col("active_days").cast("bigint").alias("active_days"), F.round(F.col("weekend_ratio").cast("double"), 6).alias("weekend_ratio"))


@query(f", r as {_SYN} select node_id, label = 1 as is_synthetic, score as anomaly_score, round((row_number() over (order by score, node_id) - 1) / (count(*) over () - 1), 9) as percentile_rank, row_number() over (order by score desc, node_id) as place from r")
def sink_scores(spark, d):
    """Scores, highest first: the place is that of the line in the sorted files."""
    s = _scored(spark, d).select(F.concat(F.when(F.col("label") == 1, "SYN:").otherwise(""), "node_id").alias("node_id"), "score")
    at = _at(spark, "scores")
    sinks.write_scores(metrics.rank_normalize(s), at)
    rows = spark.read.option("header", "true").csv(at).select("*", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_k"))
    out = numbered(rows, ["_f", "_k"], "place")
    return out.select("node_id", F.col("is_synthetic").cast("boolean").alias("is_synthetic"), F.col("anomaly_score").cast("double").alias("anomaly_score"), F.round(F.col("percentile_rank").cast("double"), 9).alias("percentile_rank"), "place")


@query("select (select count(*) from edge) as n_edges, round((select sum(amount) from edge), 0) as amount, (select count(*) from (select src from edge union select dst from edge) x) as n_nodes")
def sink_graph(spark, d):
    at = _at(spark, "graph")
    sinks.write_graph(views.nodes(spark, d), views.edges(spark, d), at)
    n = spark.read.parquet(f"{at}/nodes").agg(F.count("*").alias("n_nodes"))
    return spark.read.parquet(f"{at}/edges").agg(F.count("*").alias("n_edges"), F.round(F.sum("amount"), 0).alias("amount")).crossJoin(F.broadcast(n))  # one row each


@query("select vec_id as node_id, len(embedding) as dims, round(embedding[1], 5) as first from embeddings")
def sink_embeddings(spark, d):
    at = _at(spark, "embeddings")
    sinks.write_embeddings(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("z")), at)
    return spark.read.parquet(at).select("node_id", F.size("embedding").alias("dims"), F.round(F.get("embedding", 0), 5).alias("first"))


@query("select c_custkey as k, cast(floor(c_acctbal) as double) as weight, 'c_acctbal' as column_name from customer")
def sink_model(spark, d):
    """A model whose first layer is a column of a table, written and loaded again."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal").orderBy("c_custkey").toPandas()
    at = _at(spark, "model")
    sinks.write_model(spark, model.Model({"w2": rows[["c_acctbal"]].to_numpy()}, ["c_acctbal"], [0.5]), at)
    again = sinks.read_model(spark, at)
    return spark.createDataFrame([(int(k), float(np.floor(w)), again.columns[0]) for k, w in zip(rows["c_custkey"], again.weights["w2"][:, 0], strict=True)], "k bigint, weight double, column_name string")


@query("select count(*) as n_transactions, count(*) filter (where method is not null) as n_edges, 2::bigint as losses, 'line one' as text from txn")
def sink_reports(spark, d):
    """A summary as JSON and a report as text."""
    at = _at(spark, "summary")
    t = views.transactions(spark, d).withColumn("counterparty_identifier", F.when(F.col("payment_method").isNotNull(), F.col("counterparty_identifier")))
    sinks.write_json(spark, {"counts": graph.graph_report(t).first().asDict(), "losses": [0.5, np.float32(0.25)]}, f"{at}/json")
    sinks.write_text(spark, "line one\nline two", f"{at}/text")
    text = spark.read.text(f"{at}/text").filter("value = 'line one'").select(F.col("value").alias("text"))
    return spark.read.json(f"{at}/json").select("counts.n_transactions", "counts.n_edges", F.size("losses").cast("bigint").alias("losses")).crossJoin(F.broadcast(text))  # one row each


@query(_PER + "select method, round(avg(pr_auc), 6) as pr_auc_mean, true as in_json, true as in_text from per where method in ('en', 'de', 'fr', 'es') group by method")
def sink_study(spark, d):
    """A comparison written as text, CSV and JSON, and read back."""
    base = _per_seed(spark, d).withColumns({"precision_at_n": F.col("roc_auc"), "recall_at_n": F.col("pr_auc"), "ring_type": F.lit(None).cast("string"), "tier": F.lit(None).cast("string")})
    at = _at(spark, "comparison")
    text = reports.write_comparison(spark, base, at, {"seeds": [1]})
    kept = json.loads(spark.read.text(f"{at}/baseline_results").first().value)
    stored = "\n".join(r.value for r in spark.read.text(f"{at}/comparison_report").collect())  # a report
    table = spark.read.option("header", "true").csv(f"{at}/comparison_table")
    in_json = F.col("method").isin(list(kept["aggregate_overall"]))
    return table.select("method", F.round(F.col("pr_auc_mean").cast("double"), 6).alias("pr_auc_mean"), in_json.alias("in_json"), F.lit(sorted(stored.split()) == sorted(text.split())).alias("in_text"))


@query(_PER + "select ring_type, round(avg(pr_auc), 9) as pr_auc_mean from per where method = 'en' group by ring_type")
def seen_scan(spark, d):
    """An ablation's JSON, and the seen-type results out of it."""
    mean = metrics.mean_std(_per_seed(spark, d).filter("method = 'en'"), ["ring_type"], ["pr_auc"]).collect()
    at = _at(spark, "ablation")
    sinks.write_json(spark, {"aggregate_by_type": {r.ring_type: {"GNN": {"pr_auc_mean": r.pr_auc_mean, "pr_auc_std": r.pr_auc_std}} for r in mean}}, at)
    return statements.seen_results(spark, at).select("ring_type", F.round("pr_auc_mean", 9).alias("pr_auc_mean"))


@query("select r_name as held_out_type, k as seed from region, range(5) s(k)")
def checkpoint_scan(spark, d):
    """Five JSON results of each of five types, one file each."""
    at = _at(spark, "checkpoints")
    rows = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("held_out_type"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seed"))
    rows.write.option("maxRecordsPerFile", 1).json(at)
    return statements.checkpoints(spark, at).select("held_out_type", "seed")


# files ---------------------------------------------------------------------------------------------------------------

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook_of(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet of inline strings."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {_NS}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def _workbooks(spark, d) -> DataFrame:
    """path, content: a workbook for every account, with a preamble, an opening balance, and one amount column with its indicator for every other account."""
    ship(spark)
    t = views.view(spark, d, "txn").select("account_id", F.struct(F.date_format("ts", "dd-MM-yyyy").alias("day"), "narration", F.col("amount").cast("string").alias("amount"), "direction").alias("r"))

    def book(account: str, rows: list[dict]) -> bytes:
        single = int(account) % 2 == 0
        head = ["Tran Date", "Particulars", "Txn_Amt", "Cod_DrCr", "Balance"] if single else ["Value Date", "Txn Date", "Narration", "Debit", "Credit", "Balance"]
        out = [["My bank"], ["Account No", "", f"{int(account):08d}"], head, ["1", "01-01-2024", "OPENING BALANCE", "", "9", "9"] if not single else ["01-01-2024", "Opening Balance", "9", "C", "9"]]
        for day, narration, amount, direction in (r.values() for r in rows):
            out.append([day, narration, amount, direction[:1], "0"] if single else ["1", day, narration, amount + " Dr" if direction == "DEBIT" else "", amount if direction == "CREDIT" else "", "0"])
        return workbook_of(out)

    def build(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                accounts, rows = (batch.column(c)[k : k + 256].to_pylist() for c in (0, 1))
                yield pa.RecordBatch.from_pydict({"path": [f"books/{a}.xlsx" for a in accounts], "content": [book(a, r) for a, r in zip(accounts, rows, strict=True)]})

    return t.groupBy("account_id").agg(F.collect_list("r").alias("r")).mapInArrow(build, "path string, content binary")


@query("select lpad(account_id, 8, '0') as account_id, strftime(ts, '%d-%m-%Y') as date, amount, direction, narration as description, account_id || '.xlsx' as source_file, 'xlsx_generic:one' as source_format from txn")
def ingest_excel(spark, d):
    """Every account's workbook, in two layouts, back as transactions."""
    files = materialize(_workbooks(spark, d), "workbooks")
    out = statements.transactions(statements.parse_files(files))
    return out.select("account_id", "date", "amount", "direction", "description", "source_file", "source_format")


@query("""select * from (values (1, 'a.csv', 'ingested', null, 2::bigint), (2, 'b.CSV', 'ingested', null, 1), (3, 'c.csv', 'ingested', null, 1), (4, 'd.csv', 'failed', 'ValueError', 0), (5, 'e.pdf', 'skipped', null, 0), (6, 'f.xlsx', 'ingested', null, 1), (7, 'g.xlsx', 'failed', 'BadZipFile', 0), (8, 'h.xlsx', 'failed', 'ValueError', 0)) v(place, file, status, error_type, n_txns)""")
def ingest_report(spark, d):
    """A directory of every kind of file: three layouts, a mark and bad bytes, an unknown layout, an unsupported suffix, workbooks good, broken and empty."""
    bank = "Bank\nStatement of Account No - 1234567\n" + statements.BANK_HEADER + "\n05-01-2024,-,RTGS 1,\"9,500.00\",,1,1\n06-01-2024,7,RTGS 2,,25,1,1\n07-01-2024,8,nothing moved,0,0,1,1\n"
    tab = "99\tsavings\nTRAN-DATE\tCHQ-NUM\tTRAN\\_PARTICULAR\tWITHDRAWAL\tDEPOSIT\tBALANCE\n05-01-2024\t\tshop\t\t100\t5\n"
    core = "Ac_No,Ac_Name,Tran_ID,Tran_Date,Narration,Dr_Amt,Cr_Amt,Balance,pstd_dt,Tran_Type\n55,x,T1,05-01-2024,RTGS 1,10,,5,,T\n,x,T2,05-01-2024,RTGS 2,10,,5,,T\n"
    book = [["Account No", "4455667"], ["Tran Date", "Particulars", "Debit", "Credit", "Balance"], ["05-01-2024", "CLOSING BALANCE", "1", "", "1"], ["05-01-2024", "shop", "70", "", "1"]]
    files = [("x/a.csv", b"\xef\xbb\xbf" + bank.encode()), ("x/b.CSV", tab.encode() + b"\xff\n"), ("x/c.csv", core.encode()), ("x/d.csv", b"hello,world\n1,2\n"), ("x/e.pdf", b"%PDF"), ("x/f.xlsx", workbook_of(book)), ("x/g.xlsx", b"no workbook"), ("x/h.xlsx", workbook_of([["a", "b", "c"]]))]
    parsed = materialize(statements.parse_files(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")), "parsed")
    seq = parsed.filter("status != 'row'").select("file", F.col("file_seq").cast("int").alias("place"))
    return statements.report(parsed).join(seq, "file").select("place", "file", "status", "error_type", "n_txns")
