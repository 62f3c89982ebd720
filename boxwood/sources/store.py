"""Saving and loading a tree: parquet tables and a JSON row under one folder."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from boxwood.plans.model import TreeModel

TABLES = ("nodes", "leaves", "membership")


def save(tree: TreeModel, path: str, data_version: int | None = None, mode: str = "errorifexists") -> None:
    """Adjacency is not stored; it follows from the leaves. Membership is laid out
    by leaf range, so reading one leaf prunes files by their statistics."""
    spark = tree.nodes.sparkSession
    for name in TABLES:
        df = getattr(tree, name)
        if name == "membership":
            df = df.repartitionByRange("leaf_id").sortWithinPartitions("leaf_id", "idx_pos")
        df.write.mode(mode).parquet(f"{path}/{name}")
    meta = tree.meta | ({} if data_version is None else {"data_version": data_version})
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def load(spark: SparkSession, path: str, data_version: int | None = None) -> TreeModel:
    """``OSError`` if the tree was saved with another ``data_version``."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if data_version is not None and meta["data_version"] != data_version:
        raise OSError(f"data version {meta['data_version']}, not {data_version}")
    return TreeModel(*[spark.read.parquet(f"{path}/{name}") for name in TABLES], meta)
