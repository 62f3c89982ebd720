"""Outlines of two-dimensional leaf boxes, and a plot of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.plans.model import TreeModel


def leaf_segments(boxes: DataFrame) -> DataFrame:
    """``leaf_id, label, seg, x0, y0, x1, y1``: bottom, right, top and left sides.
    ``label`` is the subtree, where there is one."""
    l, r = F.col("left_edge"), F.col("right_edge")  # noqa: E741
    side = lambda n, *p: F.struct(F.lit(n).alias("seg"), *[x.alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), p, strict=True)])
    sides = F.array(side(0, l[0], l[1], r[0], l[1]), side(1, r[0], l[1], r[0], r[1]), side(2, l[0], r[1], r[0], r[1]), side(3, l[0], l[1], l[0], r[1]))
    label = F.col("subtree") if "subtree" in boxes.columns else F.lit(None).cast("string")
    return boxes.select("leaf_id", label.alias("label"), F.explode(sides).alias("s")).select("leaf_id", "label", "s.*")


def svg(tree: TreeModel, points: DataFrame | None = None, label_boxes: bool = False, width: int = 600, most: int = 100_000) -> str:
    """A drawing of at most ``most`` leaves and points of a two-dimensional tree,
    without any plotting library."""
    if tree.ndim != 2:
        raise ValueError("only trees of two dimensions are drawn")
    (x0, y0), (w, h) = tree.left_edge, (max(v, 1e-300) for v in tree.domain_width)
    height = max(1, round(width * h / w)) if h / w < 10 else 10 * width
    at = lambda x, y: (round((x - x0) / w * width, 2), round(height - (y - y0) / h * height, 2))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    if points is not None:
        out += [f'<circle cx="{cx}" cy="{cy}" r="1"/>' for cx, cy in (at(r.c0, r.c1) for r in points.select("c0", "c1").limit(most).collect())]
    for r in leaf_segments(tree.leaves).limit(4 * most).collect():
        (a, b), (c, d) = at(r.x0, r.y0), at(r.x1, r.y1)
        out.append(f'<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="black"/>')
        if label_boxes and r.seg == 0:
            out.append(f'<text x="{a}" y="{b}" font-size="8">{r.leaf_id if r.label is None else f"{r.leaf_id} {r.label}"}</text>')
    return "\n".join([*out, "</svg>"])


def plot2d(tree: TreeModel, points: DataFrame | None = None, file: str | None = None, label_boxes: bool = False, most: int = 100_000):
    """Draws at most ``most`` leaves and points with matplotlib, if it is there."""
    if tree.ndim != 2:
        raise ValueError("only trees of two dimensions are drawn")
    import matplotlib.pyplot as plt
    from matplotlib.collections import LineCollection

    rows = leaf_segments(tree.leaves).limit(4 * most).collect()
    _, ax = plt.subplots()
    ax.add_collection(LineCollection([((r.x0, r.y0), (r.x1, r.y1)) for r in rows]))
    if points is not None:
        got = points.select("c0", "c1").limit(most).toPandas()
        ax.scatter(got["c0"], got["c1"], s=2)
    if label_boxes:
        for r in rows:
            if r.seg == 0:
                ax.text(r.x0, r.y0, str(r.leaf_id))
    ax.set_xlim(tree.left_edge[0], tree.right_edge[0])
    ax.set_ylim(tree.left_edge[1], tree.right_edge[1])
    if file:
        plt.savefig(file)
    return ax
