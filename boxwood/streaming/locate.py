"""Locating a stream of positions in a tree that was built before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.operators.locate import locate
from boxwood.plans.model import TreeModel


def locate_stream(tree: TreeModel, stream: DataFrame, coords: list[str]) -> DataFrame:
    """``stream`` with ``leaf_id``: no state, one pass per micro-batch."""
    return locate(tree, stream, coords)


def counts_by_leaf(tree: TreeModel, stream: DataFrame, coords: list[str], time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Positions per leaf and time window, late ones up to ``late``."""
    at = locate(tree, stream, coords).filter("leaf_id IS NOT NULL").withWatermark(time, late)
    return at.groupBy(F.window(time, window), "leaf_id").agg(F.count(F.lit(1)).alias("n"))
