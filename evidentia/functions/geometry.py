"""Rectangles as arrays [x0, y0, x1, y1], colours, rotations and affine maps, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colours that mean something, and how near a colour must be.
COLOURS = {
    "yellow": (1.0, 1.0, 0.5137255),
    "blue": (0.3450828, 0.6941177, 1.0),
    "orange": (1.0, 0.7254902, 0.3294118),
    "red": (1.0, 0.1647059, 0.1333181),
    "purple": (0.75, 0.5, 0.95),
}
COLOUR_TOLERANCE = 0.18


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[v.cast("double") for v in (x0, y0, x1, y1)])


def edge(b: Column, n: int) -> Column:
    return F.get(b, F.lit(n))


def width(b: Column) -> Column:
    return edge(b, 2) - edge(b, 0)


def height(b: Column) -> Column:
    return edge(b, 3) - edge(b, 1)


def intersection_area(a: Column, b: Column) -> Column:
    x = F.least(edge(a, 2), edge(b, 2)) - F.greatest(edge(a, 0), edge(b, 0))
    y = F.least(edge(a, 3), edge(b, 3)) - F.greatest(edge(a, 1), edge(b, 1))
    return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection as a share of the first rectangle."""
    return intersection_area(a, b) / F.greatest(width(a) * height(a), F.lit(1e-9))


def intersects(a: Column, b: Column) -> Column:
    """Whether two rectangles share an inner point."""
    return (
        (edge(a, 0) < edge(b, 2)) & (edge(b, 0) < edge(a, 2)) & (edge(a, 1) < edge(b, 3)) & (edge(b, 1) < edge(a, 3))
    )


def covers(outer: Column, inner: Column, tolerance: float = 1.0) -> Column:
    return (
        (edge(outer, 0) <= edge(inner, 0) + tolerance)
        & (edge(outer, 1) <= edge(inner, 1) + tolerance)
        & (edge(outer, 2) >= edge(inner, 2) - tolerance)
        & (edge(outer, 3) >= edge(inner, 3) - tolerance)
    )


def shrink(b: Column, pad: Column) -> Column:
    """A rectangle without its padding, unless nothing would be left."""
    pad = F.greatest(pad, F.lit(0.0))
    vanishes = (width(b) <= pad * 2) | (height(b) <= pad * 2)
    return F.when(vanishes, b).otherwise(box(edge(b, 0) + pad, edge(b, 1) + pad, edge(b, 2) - pad, edge(b, 3) - pad))


def clip(b: Column, page_width: Column, page_height: Column, pad: float) -> Column:
    """A rectangle grown by `pad` and cut to its page."""
    return box(
        F.greatest(edge(b, 0) - pad, F.lit(0.0)),
        F.greatest(edge(b, 1) - pad, F.lit(0.0)),
        F.least(edge(b, 2) + pad, page_width),
        F.least(edge(b, 3) + pad, page_height),
    )


def paint_box(b: Column, paint: Column, stroke: Column) -> Column:
    """What a mark paints: a stroke flatter than its width is as high as it."""
    half = F.greatest(F.coalesce(stroke, F.lit(0.0)) / 2, F.lit(0.5))
    middle = (edge(b, 1) + edge(b, 3)) / 2
    flat = (paint == "stroke") & (height(b) < half * 2)
    return F.when(flat, box(edge(b, 0), middle - half, edge(b, 2), middle + half)).otherwise(b)


def paint_band(b: Column, paint: Column, stroke: Column) -> Column:
    """struct(lo, hi): the vertical band of a fragment."""
    half = F.greatest(F.coalesce(stroke, F.lit(0.0)) / 2, F.lit(0.5))
    middle = (edge(b, 1) + edge(b, 3)) / 2
    lo = F.when(paint == "stroke", middle - half).otherwise(edge(b, 1))
    hi = F.when(paint == "stroke", middle + half).otherwise(edge(b, 3))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def marker_hits(char: Column, mark: Column, paint: Column, stroke: Column) -> Column:
    """Whether a mark, padded, holds a character's centre or part of its area."""
    pad = F.when(paint == "stroke", F.coalesce(stroke, F.lit(0.0)) / 2 + 1.0).otherwise(0.5)
    padded = box(edge(mark, 0) - 0.5, edge(mark, 1) - pad, edge(mark, 2) + 0.5, edge(mark, 3) + pad)
    x, y = (edge(char, 0) + edge(char, 2)) / 2, (edge(char, 1) + edge(char, 3)) / 2
    centre = x.between(edge(padded, 0), edge(padded, 2)) & y.between(edge(padded, 1), edge(padded, 3))
    return centre | (intersection_area(char, padded) > 0)


def rotated(b: Column, page_width: Column, page_height: Column, rotation: Column) -> Column:
    """A rectangle in the space of the rendered page of the given size; a rotation that isn't a quarter turn is an error."""
    turn = F.pmod(rotation, F.lit(360))
    x0, y0, x1, y1 = (edge(b, n) for n in range(4))
    return (
        F.when(turn == 0, b)
        .when(turn == 90, box(page_width - y1, x0, page_width - y0, x1))
        .when(turn == 180, box(page_width - x1, page_height - y1, page_width - x0, page_height - y0))
        .when(turn == 270, box(y0, page_height - x1, y1, page_height - x0))
        .otherwise(F.raise_error(F.lit("rotation must be a multiple of 90")).cast("array<double>"))
    )


def affine(b: Column, m: Column) -> Column:
    """Bounding box of a rectangle under the map x' = ax + cy + e, y' = bx + dy + f, m = [a, b, c, d, e, f]."""
    k = [F.get(m, F.lit(n)) for n in range(6)]
    corners = [(edge(b, i), edge(b, j)) for i in (0, 2) for j in (1, 3)]
    xs = [k[0] * x + k[2] * y + k[4] for x, y in corners]
    ys = [k[1] * x + k[3] * y + k[5] for x, y in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def page_coverage(b: Column, page_width: Column, page_height: Column) -> Column:
    area = F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))
    return area / F.greatest(page_width * page_height, F.lit(1.0))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """Name of the nearest known colour within tolerance, the first of equals; else null."""
    ranked = [
        F.struct(
            F.sqrt((r - c[0]) * (r - c[0]) + (g - c[1]) * (g - c[1]) + (b - c[2]) * (b - c[2])).alias("d"),
            F.lit(n).alias("n"),
            F.lit(name).alias("name"),
        )
        for n, (name, c) in enumerate(COLOURS.items())
    ]
    best = F.least(*ranked)
    return F.when(best["d"] <= COLOUR_TOLERANCE, best["name"])


def signature_similarity(a: Column, b: Column) -> Column:
    """1 less the mean absolute difference of two equally long image signatures of values 0 to 255."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) - apart / F.size(a) / 255.0
