"""Boxes (x, y, w, h) and landmarks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def div(a: Column, b: int | Column) -> Column:
    """Integer division that truncates toward zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - a % b) / b).cast("int")


def area(w: Column, h: Column) -> Column:
    return w * h


def centre_x(x: Column, w: Column) -> Column:
    return x + div(w, 2)


def centre_y(y: Column, h: Column) -> Column:
    return y + div(h, 2)


def aspect(w: Column, h: Column) -> Column:
    return w.cast("double") / h


def overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Area shared by two boxes; touching edges share none."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    both = overlap(ax, ay, aw, ah, bx, by, bw, bh)
    return both.cast("double") / (aw * ah + bw * bh - both)


def contains_point(x, y, w, h, px, py) -> Column:
    """Half-open: the right and lower edges are outside."""
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def contains_box(x, y, w, h, bx, by, bw, bh) -> Column:
    """Closed."""
    return (bx >= x) & (by >= y) & (bx + bw <= x + w) & (by + bh <= y + h)


def expand(x, y, w, h, factor: float) -> Column:
    """A box of factor times the size about the same centre; sizes and shifts truncate toward zero."""
    nw, nh = (w * F.lit(float(factor))).cast("int"), (h * F.lit(float(factor))).cast("int")
    return F.struct((x - div(nw - w, 2)).alias("x"), (y - div(nh - h, 2)).alias("y"), nw.alias("w"), nh.alias("h"))


def region(x, y, w, h, confidence) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), confidence.alias("confidence"))


#: Landmark points by type (fixed values).
LANDMARKS = {"FIVE": 5, "SIXTY_EIGHT": 68, "ONE_HUNDRED_SIX": 106}


def landmarks(points: Column, kind: str, confidence: Column) -> Column:
    """A landmark struct; an error if the number of points does not fit the type."""
    ok = F.when(F.size(points) == LANDMARKS[kind], points).otherwise(F.raise_error(F.lit(f"{kind} landmarks need {LANDMARKS[kind]} points")))
    return F.struct(F.lit(kind).alias("type"), ok.alias("points"), confidence.alias("confidence"))


def eye_distance(lx, ly, rx, ry) -> Column:
    return F.hypot(rx - lx, ry - ly)


def face_angle(lx, ly, rx, ry) -> Column:
    return F.degrees(F.atan2((ry - ly).cast("double"), (rx - lx).cast("double")))


def midpoint(ax: Column, bx: Column) -> Column:
    return div(ax + bx, 2)


def face_scale(lx, ly, rx, ry, standard: float) -> Column:
    return eye_distance(lx, ly, rx, ry) / F.lit(float(standard))
