"""Ordering, selection and splitting along one dimension. Ties go by point id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwood.functions.points import PointSet
from boxwood.plans.select import global_rank, kth


def order_dim(points: PointSet, dim: int) -> DataFrame:
    """``point_id, value, rank``: the sorting permutation along ``dim``."""
    c = f"c{dim}"
    return global_rank(points.df.select("point_id", F.col(c).alias("value")), ["value", "point_id"])


def pivot(points: PointSet, dim: int) -> tuple[int, float, int]:
    """Median of medians of five: (q, value, point id), q being the pivot's place
    in the order; (-1, nan, -1) without points. Each round keeps one row in five."""
    d = global_rank(points.df.select("point_id", F.col(f"c{dim}").alias("value")), ["point_id"], "pos")
    n = d.count()
    if not n:
        return -1, float("nan"), -1
    m = n
    while m > 1:
        w = Window.partitionBy("grp")
        g = d.withColumn("grp", F.floor(F.col("pos") / 5).cast("long"))
        g = g.withColumn("r", F.row_number().over(w.orderBy("value", "point_id"))).withColumn("k", F.count(F.lit(1)).over(w))
        d = g.filter(F.col("r") == F.floor((F.col("k") + 1) / 2)).select("point_id", "value", F.col("grp").alias("pos"))
        m = -(-m // 5)
    row = d.first()
    q = points.df.filter((F.col(f"c{dim}") < row["value"]) | ((F.col(f"c{dim}") == row["value"]) & (F.col("point_id") < row["point_id"]))).count()
    return q, row["value"], row["point_id"]


def partition_at(points: PointSet, dim: int, pivot_id: int) -> DataFrame:
    """``point_id, side, q``: -1 before the pivot point, 0 the pivot, 1 after; q is
    the pivot's place. The pivot is one broadcast row."""
    c = F.col(f"c{dim}")
    one = F.broadcast(points.df.filter(F.col("point_id") == pivot_id).limit(1).select(c.alias("v")))
    d = points.df.select("point_id", c.alias("x")).join(one)
    before = (F.col("x") < F.col("v")) | ((F.col("x") == F.col("v")) & (F.col("point_id") < pivot_id))
    sided = d.select("point_id", F.when(F.col("point_id") == pivot_id, 0).when(before, -1).otherwise(1).alias("side"))
    q = F.broadcast(sided.agg(F.count_if(F.col("side") == -1).alias("q")))
    return sided.join(q)


def partition_value(points: PointSet, dim: int, value: float) -> DataFrame:
    """``point_id, less, q``: less is x <= value, q the last such place (-1: none)."""
    less = F.col(f"c{dim}") <= F.lit(float(value))
    q = F.broadcast(points.df.agg((F.count_if(less) - 1).alias("q")))
    return points.df.select("point_id", less.alias("less")).join(q)


def select(points: PointSet, dim: int, t: int) -> DataFrame:
    """The t smallest points, ``point_id, value``: an exact threshold, then a filter."""
    c = F.col(f"c{dim}")
    if t <= 0:
        return points.df.select("point_id", c.alias("value")).limit(0)
    v, i = kth(points.df, c, t)
    return points.df.filter((c < v) | ((c == v) & (F.col("point_id") <= i))).select("point_id", c.alias("value"))


def split(points: PointSet, mins: list[float] | None = None, maxs: list[float] | None = None, use_sliding_midpoint: bool = False) -> DataFrame:
    """One row ``q, split_dim, split_val``: the split of a whole point set, q being
    the last place of the less side; no rows for no points, ``split_dim`` null if
    all spreads are 0."""
    from boxwood.functions.points import bounds

    b = bounds(points)
    spark, schema = points.df.sparkSession, "q long, split_dim int, split_val double"
    if not b.n:
        return spark.createDataFrame([], schema)
    mins, maxs = mins or b.mins, maxs or b.maxs
    spread = [hi - lo for lo, hi in zip(mins, maxs, strict=True)]
    d = spread.index(max(spread))
    if spread[d] == 0:
        return spark.createDataFrame([(-1, None, None)], schema)
    c = F.col(f"c{d}")
    if not use_sliding_midpoint:
        k = (b.n + 1) // 2
        return spark.createDataFrame([(k - 1, d, kth(points.df, c, k, b.n)[0])], schema)
    mid = (mins[d] + maxs[d]) / 2
    key = F.struct(c.alias("v"), F.col("point_id").alias("i"))
    row = points.df.agg(F.count_if(c <= mid).alias("k"), F.min(c).alias("lo"), F.max(key).alias("hi")).first()
    if row["k"] == 0:
        return spark.createDataFrame([(0, d, row["lo"])], schema)
    if row["k"] == b.n:
        hi = row["hi"]
        below = points.df.filter((c < hi["v"]) | ((c == hi["v"]) & (F.col("point_id") < hi["i"]))).agg(F.max(c)).first()[0]
        return spark.createDataFrame([(b.n - 2, d, below if below is not None else hi["v"])], schema)
    return spark.createDataFrame([(row["k"] - 1, d, mid)], schema)
