"""Boxes as structs of left, top, right, bottom: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def area(b: Column) -> Column:
    return F.greatest(b["right"] - b["left"], F.lit(0.0)) * F.greatest(b["bottom"] - b["top"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    high = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def coverage(own: Column, other: Column, floor: float = 0.0) -> Column:
    """Share of the own area that the other covers; an empty box is covered by nothing."""
    mine = F.greatest(area(own), F.lit(floor))
    return F.when(mine > 0, overlap(own, other) / mine).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return F.when((area(a) > 0) & (area(b) > 0), both / (area(a) + area(b) - both)).otherwise(0.0)


def clamped(b: Column) -> Column:
    """Every side within 0..1."""
    return box(*(F.least(F.greatest(b[s], F.lit(0.0)), F.lit(1.0)) for s in SIDES))


def valid(b: Column) -> Column:
    """The box if it is ordered and within 0..1, else null."""
    inside = [b[s].between(0.0, 1.0) for s in SIDES]
    return F.when((b["left"] <= b["right"]) & (b["top"] <= b["bottom"]) & inside[0] & inside[1] & inside[2] & inside[3], b)


def rotated(b: Column, degrees: Column) -> Column:
    """A box of the unit page after a clockwise turn."""
    turned = {
        90: box(1 - b["bottom"], b["left"], 1 - b["top"], b["right"]),
        180: box(1 - b["right"], 1 - b["bottom"], 1 - b["left"], 1 - b["top"]),
        270: box(b["top"], 1 - b["right"], b["bottom"], 1 - b["left"]),
    }
    return F.when(degrees == 90, turned[90]).when(degrees == 180, turned[180]).when(degrees == 270, turned[270]).otherwise(b)
