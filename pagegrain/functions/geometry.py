"""Boxes, transforms and polygons. Boxes are array<double> of x0, y0, x1, y1 unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "array(0D, 0D, 0D, 0D)"


def parse_bbox(text: Column) -> Column:
    """A box from JSON, parsed once; zeros if it is malformed or has fewer than four numbers."""
    read = F.transform(F.array(F.from_json(text, "array<double>")), lambda box: F.when(F.size(box) >= 4, box))
    return F.coalesce(F.get(read, 0), F.expr(ZERO))


def bbox_from_points(points: Column) -> Column:
    """The hull of four points or more (array<array<double>>), missing coordinates being 0; else zeros."""
    def axis(i: int) -> Column:
        return F.transform(points, lambda p: F.coalesce(F.get(p, i), F.lit(0.0)))

    xs, ys = axis(0), axis(1)
    return F.when(F.size(points) >= 4, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(F.expr(ZERO))


def bbox_from_bounds(bounds: Column) -> Column:
    """The first four of four bounds or more, those that aren't numbers being 0; else zeros."""
    first = F.transform(F.slice(bounds, 1, 4), lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))))
    return F.when(F.size(bounds) >= 4, first).otherwise(F.expr(ZERO))


def fit(page_w: Column, page_h: Column, width: float, height: float, image: bool = False) -> Column:
    """The transform that fits a page into a canvas. Pages count y from below and are flipped, images aren't."""
    k = F.least(F.lit(width) / page_w, F.lit(height) / page_h)
    none = F.lit(0.0)
    return F.struct(k.alias("scaleX"), k.alias("scaleY"), none.alias("offsetX"), none.alias("offsetY"), none.alias("rotation"), F.lit(not image).alias("flipY"))


def apply_transform(box: Column, t: Column, page_h: Column | None = None) -> Column:
    """Optional flip, scale and offset; rotation is not applied."""
    flip = (t["flipY"] & page_h.isNotNull()) if page_h is not None else F.lit(False)
    h = page_h if page_h is not None else F.lit(None).cast("double")
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    y0, y1 = F.when(flip, h - y1).otherwise(y0), F.when(flip, h - y0).otherwise(y1)
    return F.array(x0 * t["scaleX"] + t["offsetX"], y0 * t["scaleY"] + t["offsetY"], x1 * t["scaleX"] + t["offsetX"], y1 * t["scaleY"] + t["offsetY"])


def overlay_rect(box: Column, k: Column, height: Column, flip: Column, dx: Column, dy: Column) -> Column:
    """A box as x, y, w, h on screen."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    y0, y1 = F.when(flip, height - y1).otherwise(y0), F.when(flip, height - y0).otherwise(y1)
    return F.struct((x0 * k + dx).alias("x"), (y0 * k + dy).alias("y"), ((x1 - x0) * k).alias("w"), ((y1 - y0) * k).alias("h"))


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting: whether an odd number of edges lie to the right. Horizontal edges have a slope guard."""
    n = F.size(polygon)
    before = F.concat(F.slice(polygon, n, F.lit(1)), F.slice(polygon, F.lit(1), F.greatest(n - 1, F.lit(0))))

    def crosses(a: Column, b: Column) -> Column:
        rise = F.when(b[1] == a[1], F.lit(1e-9)).otherwise(b[1] - a[1])
        return ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / rise + a[0])

    return F.size(F.filter(F.zip_with(polygon, before, crosses), lambda c: c)) % 2 == 1


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Boxes whose greatest value is 1.01 at most are shares of the page; others are pixels already."""
    scaled = F.array(box[0] * width, box[1] * height, box[2] * width, box[3] * height)
    return F.when(F.array_max(box) <= 1.01, scaled).otherwise(box)


def clip_xywh(box: Column) -> Column:
    """Whole pixels from 0 on, as x, y, w, h; 0 for what is no 32-bit number."""
    x0, y0, x1, y1 = (F.greatest(F.get(box, i).try_cast("int"), F.lit(0)) for i in range(4))
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def grid(n: int = 5, lo: float = 0.1, hi: float = 0.9) -> Column:
    """n by n evenly spaced points, row by row."""
    axis = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) + i * ((hi - lo) / max(1, n - 1)))
    return F.flatten(F.transform(axis, lambda y: F.transform(axis, lambda x: F.array(x, y))))
