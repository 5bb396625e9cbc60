"""Boxes as four columns x, y, w, h of page ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in "xywh")


def overlap_area(a: Box, b: Box) -> Column:
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def share_of(a: Box, b: Box) -> Column:
    """How much of a lies in b; 0 where a has no area."""
    return F.when(a[2] * a[3] > 0, overlap_area(a, b) / (a[2] * a[3])).otherwise(0.0)


def share_of_smaller(a: Box, b: Box) -> Column:
    least = F.least(a[2] * a[3], b[2] * b[3])
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(0.0)


def transposed(a: Box) -> Box:
    """A vertical page as if it were written in rows from right to left columns."""
    return a[1], 1 - a[0] - a[2], a[3], a[2]


def usable(a: Box) -> Column:
    finite = ~(F.isnan(a[0]) | F.isnan(a[1]) | F.isnan(a[2]) | F.isnan(a[3]))
    return finite & (a[0] >= -0.01) & (a[1] >= -0.01) & (a[2] > 0) & (a[3] > 0) & (a[0] + a[2] <= 1.01) & (a[1] + a[3] <= 1.01)


def unrotated(a: Box, angle: Column, width: Column, height: Column) -> Box:
    """The box, on the page before it was turned by angle (degrees) about its centre; clipped to the page."""
    cos, sin = F.cos(F.radians(-angle)), F.sin(F.radians(-angle))
    xs, ys = [], []
    for u in (a[0], a[0] + a[2]):
        for v in (a[1], a[1] + a[3]):
            dx, dy = (u - 0.5) * width, (v - 0.5) * height
            xs.append((dx * cos - dy * sin) / width + 0.5)
            ys.append((dx * sin + dy * cos) / height + 0.5)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    x, y, right, bottom = clip(F.least(*xs)), clip(F.least(*ys)), clip(F.greatest(*xs)), clip(F.greatest(*ys))
    turned = angle != 0
    return tuple(F.when(turned, t).otherwise(o) for t, o in zip((x, y, right - x, bottom - y), a))


def pixels(a: Box, width: Column, height: Column) -> Box:
    """Whole pixels: cut off, at least one, inside the image."""
    x, y = F.greatest(F.lit(0), (a[0] * width).cast("int")), F.greatest(F.lit(0), (a[1] * height).cast("int"))
    x, y = F.least(x, width - 1), F.least(y, height - 1)
    w = F.least(F.greatest(F.lit(1), (a[2] * width).cast("int")), width - x)
    h = F.least(F.greatest(F.lit(1), (a[3] * height).cast("int")), height - y)
    return x, y, w, h


def target_size(width: Column, height: Column, longest: int | None) -> tuple[Column, Column]:
    if not longest or longest <= 0:
        return width, height
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.bround(c * scale).cast("int")) for c in (width, height))


def upper_median(x: Column | str) -> Column:
    """sorted[n // 2], an aggregate; null if there is nothing."""
    name = x if isinstance(x, str) else x._jc.toString()
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")
