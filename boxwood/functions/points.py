"""Point sets: a DataFrame ``point_id, c0 .. c{m-1}`` and its statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PointSet:
    """Points of ``ndim`` dimensions. Coordinates are flat DOUBLE columns, so a
    plan that needs one dimension reads one column."""

    df: DataFrame
    ndim: int

    @classmethod
    def from_df(cls, df: DataFrame, id_col: str | Column, coords: list[str | Column]) -> PointSet:
        """``coords``: columns or expressions, cast to DOUBLE."""
        if not coords:
            raise ValueError("a point set needs at least one coordinate")
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        return cls(df.select(as_col(id_col).cast("long").alias("point_id"), *[as_col(c).cast("double").alias(f"c{d}") for d, c in enumerate(coords)]), len(coords))

    @property
    def coords(self) -> list[str]:
        return [f"c{d}" for d in range(self.ndim)]

    def array(self) -> Column:
        return F.array(*self.coords)

    def in_box(self, left: list[float], right: list[float]) -> PointSet:
        """Points in the half-open box; plain comparisons, so they reach the scan."""
        cond = F.lit(True)
        for c, lo, hi in zip(self.coords, left, right, strict=True):
            cond = cond & (F.col(c) >= lo) & (F.col(c) < hi)
        return PointSet(self.df.filter(cond), self.ndim)


@dataclass(frozen=True)
class Bounds:
    n: int
    mins: list[float]
    maxs: list[float]

    @property
    def width(self) -> list[float]:
        return [b - a for a, b in zip(self.mins, self.maxs, strict=True)]


def bounds_df(points: PointSet) -> DataFrame:
    """One row: ``n, min_d, max_d, width_d`` for each dimension; partial sums first."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for d, c in enumerate(points.coords):
        aggs += [F.min(c).alias(f"min_{d}"), F.max(c).alias(f"max_{d}")]
    got = points.df.agg(*aggs)
    return got.select("*", *[(F.col(f"max_{d}") - F.col(f"min_{d}")).alias(f"width_{d}") for d in range(points.ndim)])


def bounds(points: PointSet) -> Bounds:
    """Bounds on the driver. Null and NaN coordinates and null ids are refused:
    comparisons would misplace them silently."""
    bad = F.col("point_id").isNull()
    for c in points.coords:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")]
    for d, c in enumerate(points.coords):
        aggs += [F.min(c).alias(f"min_{d}"), F.max(c).alias(f"max_{d}")]
    row = points.df.agg(*aggs).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} points have a null id or a null or NaN coordinate")
    m = range(points.ndim)
    return Bounds(row["n"], [row[f"min_{d}"] for d in m], [row[f"max_{d}"] for d in m])


def arg_extreme(points: PointSet, dim: int, first: int, last: int, largest: bool, size: int | None = None) -> DataFrame:
    """``pos, value``: position of the extreme of ``c{dim}`` among points whose id
    (a position 0..n-1) lies in first..last inclusive; the first position on ties.

    Negative positions count from the end (``size`` points); ``last <= first``
    gives ``first``; a position outside raises ``IndexError``.
    """
    if size is not None:
        first, last = (p + size if p < 0 else p for p in (first, last))
        if not (0 <= first < max(size, 1) and last < max(size, 1)):
            raise IndexError(f"slice {first}..{last} of {size} points")
    c = f"c{dim}"
    if last <= first:
        return points.df.filter(F.col("point_id") == first).select(F.col("point_id").alias("pos"), F.col(c).alias("value"))
    some = points.df.filter(F.col("point_id").between(first, last))
    best = F.max_by("point_id", F.struct(c, -F.col("point_id"))) if largest else F.min_by("point_id", F.struct(c, "point_id"))
    value = F.max(c) if largest else F.min(c)
    return some.agg(best.alias("pos"), value.alias("value"))
