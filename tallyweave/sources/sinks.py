"""Writers for tables, reports and models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Model


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """node_id, is_synthetic, anomaly_score, percentile_rank, highest first: a range sort, not one task."""
    out = scores.select("node_id", F.startswith("node_id", F.lit("SYN:")).alias("is_synthetic"), F.col("score").alias("anomaly_score"), F.col("rank").alias("percentile_rank"))
    write_csv(out.orderBy(F.col("anomaly_score").desc(), "node_id"), path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_embeddings(emb: DataFrame, path: str) -> None:
    emb.select("node_id", F.transform("z", lambda x: x.cast("float")).alias("embedding")).write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One JSON document on one line."""
    write_text(spark, json.dumps(value, default=lambda x: x.item() if isinstance(x, np.generic) else str(x)), path)


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    rows = [(k, w.tolist()) for k, w in model.weights.items()]
    spark.createDataFrame(rows, "name string, weights array<array<float>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    write_json(spark, {"columns": model.columns, "losses": model.losses}, f"{path}/about")


def read_model(spark: SparkSession, path: str) -> Model:
    weights = {r.name: np.array(r.weights, dtype=np.float32) for r in spark.read.parquet(f"{path}/weights").collect()}
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    return Model(weights, about["columns"], about["losses"])
