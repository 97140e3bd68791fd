"""Colour and local-pattern expressions on integer channel columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from likeness.functions.geometry import div


#: Hue, saturation and value of skin, least and largest (fixed values).
SKIN_LOW, SKIN_HIGH = (0.0, 0.1, 0.2), (0.14, 0.7, 0.95)


def gray_mean(r: Column, g: Column, b: Column) -> Column:
    return div(r + g + b, 3)


def gray_luma(r: Column, g: Column, b: Column) -> Column:
    return div(r * 299 + g * 587 + b * 114, 1000)


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue, saturation and value in 0..1. Of equal largest channels red wins, then green."""
    rf, gf, bf = r / F.lit(255.0), g / F.lit(255.0), b / F.lit(255.0)
    top, low = F.greatest(rf, gf, bf), F.least(rf, gf, bf)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(rf == top, (gf - bf) / d + F.when(gf < bf, F.lit(6.0)).otherwise(F.lit(0.0))).when(gf == top, (bf - rf) / d + 2.0).otherwise((rf - gf) / d + 4.0) / 6.0
    return F.struct(hue.alias("h"), F.when(top == 0, F.lit(0.0)).otherwise(d / F.when(top == 0, F.lit(1.0)).otherwise(top)).alias("s"), top.alias("v"))


def ycbcr(r: Column, g: Column, b: Column) -> Column:
    """Luma and chroma, each truncated (weights are fixed values)."""
    y = (r * 0.299 + g * 0.587 + b * 0.114).cast("int")
    cb = (F.lit(128.0) - r * 0.169 - g * 0.331 + b * 0.5).cast("int")
    cr = (F.lit(128.0) + r * 0.5 - g * 0.419 - b * 0.081).cast("int")
    return F.struct(y.alias("y"), cb.alias("cb"), cr.alias("cr"))


def skin_hsv(h: Column, s: Column, v: Column, lo=SKIN_LOW, hi=SKIN_HIGH) -> Column:
    """Closed ranges; hue also from 0.9 up to 1."""
    hue = h.between(lo[0], hi[0]) if lo[0] <= hi[0] else (h >= lo[0]) | (h <= hi[0])
    return (hue | ((h > 0.9) & (h <= 1.0))) & s.between(lo[1], hi[1]) & v.between(lo[2], hi[2])


def skin_ycbcr(cb: Column, cr: Column) -> Column:
    return cb.between(77, 127) & cr.between(133, 173)


def is_uniform(code: Column) -> Column:
    """Whether the eight bits, in a circle, change at most twice."""
    turned = F.shiftleft(code, 1).bitwiseAND(F.lit(255)).bitwiseOR(F.shiftright(code, 7).bitwiseAND(F.lit(1)))
    return F.bit_count(code.bitwiseXOR(turned)) <= 2
