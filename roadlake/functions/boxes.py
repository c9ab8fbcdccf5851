"""Column functions on axis-aligned boxes. Boxes are half-open pixel ranges: area is (x2 - x1) * (y2 - y1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """The four columns of a box."""

    x1: str = "x1"
    y1: str = "y1"
    x2: str = "x2"
    y2: str = "y2"

    @classmethod
    def prefixed(cls, prefix: str) -> Box:
        return cls(*(prefix + n for n in ("x1", "y1", "x2", "y2")))

    @property
    def columns(self) -> list[Column]:
        return [F.col(n) for n in (self.x1, self.y1, self.x2, self.y2)]


def area(box: Box = Box(), inclusive: bool = False) -> Column:
    """Width times height; ``inclusive`` counts both end pixels."""
    x1, y1, x2, y2 = box.columns
    one = 1 if inclusive else 0
    return (x2 - x1 + one) * (y2 - y1 + one)


def intersection(a: Box, b: Box) -> Column:
    """Shared area; 0 for boxes that only touch."""
    ax1, ay1, ax2, ay2 = a.columns
    bx1, by1, bx2, by2 = b.columns
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    known = F.lit(True)
    for c in (*a.columns, *b.columns):
        known = known & c.isNotNull()
    return F.when(known, F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)))


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; null for null boxes and for two empty ones."""
    return F.try_divide(intersection(a, b).cast("double"), union_area(a, b).cast("double"))


def overlaps(a: Box, b: Box, percent: Column) -> Column:
    """Whether IoU reaches percent / 100, in integers, so that equality is exact."""
    return intersection(a, b) * 100 >= percent * union_area(a, b)


def is_valid(width: Column, height: Column, box: Box = Box()) -> Column:
    """0 <= x1 < x2 <= width and 0 <= y1 < y2 <= height; false where anything is null."""
    x1, y1, x2, y2 = box.columns
    return F.coalesce((x1 >= 0) & (x1 < x2) & (x2 <= width) & (y1 >= 0) & (y1 < y2) & (y2 <= height), F.lit(False))


def from_center(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """x1, y1, x2, y2 in pixels, rounded half up, from a centre and size in shares of the image."""
    pixel = lambda share, size: F.floor(share * size + 0.5).cast("int")
    return [pixel(xc - w / 2, width), pixel(yc - h / 2, height), pixel(xc + w / 2, width), pixel(yc + h / 2, height)]


def size_category(area_: Column, small: Column, large: Column) -> Column:
    """``small`` up to the first cut, ``large`` above the second."""
    return F.when(area_ <= small, "small").when(area_ <= large, "medium").when(area_.isNotNull(), "large")


def suspicious(width: Column, height: Column, box: Box = Box(), least: float = 0.0001, most: float = 0.9, ratio: float = 10.0) -> Column:
    """A reason where a box's share of the image or aspect ratio is extreme, else null. The limits are parameters, as no document sets them."""
    x1, y1, x2, y2 = box.columns
    share = F.try_divide(area(box).cast("double"), (width * height).cast("double"))
    long_, short = F.greatest(x2 - x1, y2 - y1), F.least(x2 - x1, y2 - y1)
    return F.when(share < least, "tiny").when(share > most, "huge").when(long_ > short * ratio, "aspect")
