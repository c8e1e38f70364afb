from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tallyweave.operators import graph, rules
from tallyweave.streaming import rules as stream_rules

BASE = datetime(2025, 1, 1, 12)


def score(spark, rule, events, node="X", **options):
    """events: (hours, amount, outward)"""
    rows = [("X", f"o{k}", a, BASE + timedelta(hours=h)) if out else (f"o{k}", "X", a, BASE + timedelta(hours=h)) for k, (h, a, out) in enumerate(events)]
    edges = spark.createDataFrame(rows, "src string, dst string, amount double, parsed_date timestamp_ntz")
    return {r.node: r.score for r in rule(graph.incidence(edges), **options).collect()}.get(node)


def minutes(*ms, amount=500.0):
    return [(m / 60, amount, k % 2 == 0) for k, m in enumerate(ms)]


@pytest.mark.parametrize(("times", "want"), [((0, 2, 4, 6), 0), ((0, 2, 4, 6, 8), 1), ((0, 2.5, 5, 7.5, 10), 1), ((0, 3, 6, 9, 12), 0), ((0, 120, 240, 360, 480), 0)])
def test_burst(spark, times, want):
    assert score(spark, rules.burst, minutes(*times)) == want


@pytest.mark.parametrize("rule", [rules.smurfing_episode, rules.smurfing_session])
@pytest.mark.parametrize(("amounts", "gap", "want"), [((9000, 9999, 9500, 20000), 1, 1), ((8999, 10000, 8999, 10000), 1, 0), ((9500, 9500, 100, 100), 1, 0), ((9500, 100, 100), 24, 0), ((9500, 100, 100), 24.001, 1)])
def test_smurfing(spark, rule, amounts, gap, want):
    assert score(spark, rule, [(k * gap, float(a), True) for k, a in enumerate(amounts)]) == want


def test_high_value_is_by_direction(spark):
    quiet = [(k, 100.0, False) for k in range(5)]
    assert score(spark, rules.high_value, [*quiet, (9, 6000.0, False)]) == 1
    assert score(spark, rules.high_value, [*quiet, (9, 6000.0, True)]) == 0
    assert score(spark, rules.high_value, [*quiet, (9, 4000.0, False)]) == 0


@pytest.mark.parametrize(("days", "want"), [(6, 0), (7, 1)])
def test_spike_needs_days(spark, days, want):
    assert score(spark, rules.spending_spike, [(24 * k, 20000.0 if k == 0 else 1000.0, True) for k in range(days)]) == want


@pytest.mark.parametrize(("times", "amounts", "want"), [((0, 10, 20), (100, 101, 102), 1), ((0, 24, 48), (100, 100, 100), 1), ((0, 10, 20), (100, 110, 120), 0), ((0, 30, 60), (100, 100, 100), 0), ((0, 0, 0), (0, 0, 0), 1), ((0, 1), (100, 100), 0)])
def test_repeated(spark, times, amounts, want):
    rows = [("X", "Y", float(a), BASE + timedelta(hours=h)) for h, a in zip(times, amounts, strict=True)]
    edges = spark.createDataFrame(rows, "src string, dst string, amount double, parsed_date timestamp_ntz")
    assert {r.node: r.score for r in rules.repeated(graph.incidence(edges)).collect()}["X"] == want


def test_combined_covers_every_node(spark):
    edges = spark.createDataFrame([("A", "B", 9500.0, BASE)], "src string, dst string, amount double, parsed_date timestamp_ntz")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string")
    rows = {r.node_id: r for r in rules.combined(graph.incidence(edges), nodes).collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"].combined == 1 and rows["C"].combined == 0 and rows["A"].late_night == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("X", 9500.0, BASE + timedelta(hours=h)) for h in (0, 1, 2)] + [("X", 10.0, BASE + timedelta(hours=100)), ("X", 10.0, BASE + timedelta(hours=300))]
    spark.createDataFrame(rows, "node string, amount double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("node string, amount double, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_rules.smurfing_alerts(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("alerts").collect()
    assert [(r.node, r.n, r.near) for r in got] == [("X", 3, 1.0)]
    q = stream_rules.bursts(stream, count=1).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bursts").count() > 0
