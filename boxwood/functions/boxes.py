"""Column expressions over boxes and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(pos: Column, left: float, right: float) -> Column:
    """A position brought into [left, right) of a periodic dimension. Operands of
    ``%`` are never negative; a result that meets the right edge becomes the left; NaN stays NaN."""
    width = right - left
    r, low = F.lit(float(right)), F.lit(float(left))
    moved = F.when(pos < low, r - (r - pos) % F.lit(width)).otherwise(low + (pos - low) % F.lit(width))
    return F.when(F.isnan(moved), moved).when(moved >= r, low).otherwise(moved)


def closed_overlap(a_left: Column, a_right: Column, b_left: Column, b_right: Column) -> Column:
    """The closed intervals meet."""
    return (a_left <= b_right) & (a_right >= b_left)


def boxes_touch(ndim: int, skip: int, a: str = "a", b: str = "b") -> Column:
    """Closed overlap in every dimension but ``skip`` (pass -1 for none)."""
    cond = F.lit(True)
    for e in range(ndim):
        if e != skip:
            cond = cond & closed_overlap(*(F.col(f"{t}.{side}")[e] for t, side in ((a, "left_edge"), (a, "right_edge"), (b, "left_edge"), (b, "right_edge"))))
    return cond


def wraps_to(ndim: int, dim: int, a: str = "a", b: str = "b") -> Column:
    """Box ``a`` at the low side and ``b`` at the high side of periodic ``dim``
    meet across the boundary. In each other dimension the open intervals overlap
    or both touch the boundary there, which costs an escape; fewer than ndim - 1
    escapes are allowed, so one dimension alone never wraps."""
    cond = (F.col(f"{a}.leaf_id") <= F.col(f"{b}.leaf_id")) & F.col(f"{a}.periodic_left")[dim] & F.col(f"{b}.periodic_right")[dim]
    escapes: Column = F.lit(0)
    for e in range(ndim):
        if e == dim:
            continue
        le, re = (lambda t, e=e: F.col(f"{t}.left_edge")[e]), (lambda t, e=e: F.col(f"{t}.right_edge")[e])
        pl, pr = (lambda t, e=e: F.col(f"{t}.periodic_left")[e]), (lambda t, e=e: F.col(f"{t}.periodic_right")[e])
        above, below = le(a) >= re(b), re(a) <= le(b)
        cond = cond & ~(above & ~(pr(a) & pl(b))) & ~(below & ~(pr(b) & pl(a)))
        escapes = escapes + above.cast("int") + below.cast("int")
    return cond & (escapes < ndim - 1)
