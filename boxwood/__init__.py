"""Spatial partition trees over DataFrames of points."""

from boxwood.functions.points import PointSet
from boxwood.plans.build import build
from boxwood.plans.model import TreeModel

__all__ = ["PointSet", "TreeModel", "build", "make_tree"]


def make_tree(points, id_col=None, coords=None, nproc: int = 0, **kw) -> TreeModel:
    """A tree over a PointSet, or over a DataFrame with ``id_col`` and ``coords``.
    ``nproc`` > 0 asks for at least so many subtrees to be finished in parallel."""
    if not isinstance(points, PointSet):
        if id_col is None or not coords:
            raise ValueError("give id_col and coords with a DataFrame")
        points = PointSet.from_df(points, id_col, list(coords))
    if nproc > 0:
        kw.setdefault("subtree_points", max(1, -(-points.df.count() // nproc)))
    return build(points, **kw)
