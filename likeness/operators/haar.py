"""Cascades of weighted rectangles: XML reader and sliding-window detector."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, functions as F

from likeness.operators import raster
from likeness.operators.boxes import union_find
from likeness.operators.images import box_sum, integral, luma
from likeness.runtime import cut


@dataclass
class Cascade:
    width: int
    height: int
    stages: list[tuple[float, list[tuple[int, float, float, float]]]]
    features: list[list[tuple[int, int, int, int, float]]]


def read_cascade(xml: str | bytes) -> Cascade:
    """Window, stages (threshold, weak classifiers) and features. What is missing or not a number raises ValueError."""
    text = xml.decode() if isinstance(xml, bytes) else xml
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types are not allowed")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"not well-formed: {e}") from e
    node = root.find("cascade") if root.tag != "cascade" else root
    if node is None:
        raise ValueError("no cascade element")
    try:
        w, h = int(node.findtext("width")), int(node.findtext("height"))
        stages = []
        for s in node.find("stages"):
            weak = []
            for c in s.find("weakClassifiers"):
                at, leaves = c.findtext("internalNodes").split(), c.findtext("leafValues").split()
                weak.append((int(at[2]), float(at[3]), float(leaves[0]), float(leaves[1])))
            stages.append((float(s.findtext("stageThreshold")), weak))
        features = []
        for f in node.find("features"):
            rects = []
            for r in f.find("rects"):
                p = r.text.split()
                rects.append((*(int(float(v)) for v in p[:4]), float(p[4].rstrip("."))))
            features.append(rects)
    except (TypeError, AttributeError, IndexError, ValueError) as e:
        raise ValueError(f"the cascade is incomplete: {e}") from e
    if not stages or not features:
        raise ValueError("the cascade has no stages or no features")
    return Cascade(w, h, stages, features)


def scan(img: np.ndarray, c: Cascade, least_side: int = 30, grow: float = 1.1, largest_side: int | None = None) -> list[dict]:
    """All windows that pass every stage. Windows are dropped stage by stage, all positions of a scale at once."""
    g = luma(img)
    ih, iw = g.shape
    ii, sq = integral(g), integral(g.astype(np.int64) ** 2)
    out, scale = [], least_side / c.width
    nearest = lambda v: int(np.floor(v + 0.5))  # noqa: E731  halves go up
    while scale <= min(iw / c.width, ih / c.height):
        w, h = nearest(c.width * scale), nearest(c.height * scale)
        if largest_side and max(w, h) > largest_side:
            break
        if min(w, h) < least_side or w > iw or h > ih:
            scale *= grow
            continue
        step = max(1, nearest(2 * scale))
        y, x = (a.ravel() for a in np.mgrid[0 : ih - h + 1 : step, 0 : iw - w + 1 : step])
        n = w * h
        mean = box_sum(ii, x, y, w, h) / n
        var = np.maximum(box_sum(sq, x, y, w, h) / n - mean**2, 0)
        live = var >= 1
        x, y, dev = x[live], y[live], np.sqrt(var[live])
        for threshold, weak in c.stages:
            total = np.zeros(len(x))
            for at, node, left, right in weak:
                v = np.zeros(len(x))
                for rx, ry, rw, rh, weight in c.features[at]:
                    bx, by = int(rx * scale + 0.5), int(ry * scale + 0.5)
                    bw, bh = min(int(rw * scale + 0.5), w - bx), min(int(rh * scale + 0.5), h - by)
                    v += weight * box_sum(ii, x + bx, y + by, bw, bh)
                total += np.where(v / n < node * dev, left, right)
            ok = total >= threshold
            x, y, dev = x[ok], y[ok], dev[ok]
        out += [{"x": int(a), "y": int(b), "w": w, "h": h, "confidence": 1.0} for a, b in zip(x, y)]
        scale *= grow
    return out


#: Stages that one plan holds; then the windows that are left are written.
_STAGES = 4


def _grid(c: Cascade, least_side: int, grow: float, largest: float) -> list[tuple[float, int, int, int]]:
    """Scale, width, height and step of the windows, up to a scale of ``largest``."""
    nearest = lambda v: int(np.floor(v + 0.5))  # noqa: E731  halves go up
    out, scale = [], least_side / c.width
    while scale <= largest:
        w, h = nearest(c.width * scale), nearest(c.height * scale)
        if min(w, h) >= least_side:
            out.append((scale, w, h, max(1, nearest(2 * scale))))
        scale *= grow
    return out


def _corners(rects: list[tuple[int, int, int, int, float]], scale: float, w: int, h: int) -> dict[tuple[int, int], float]:
    """What the integral counts for at each corner (dx, dy) of a window in a feature's value."""
    out = {(w, h): 0.0}  # a corner that every window has, so that no feature is without rows
    for rx, ry, rw, rh, weight in rects:
        x, y = int(rx * scale + 0.5), int(ry * scale + 0.5)
        bw, bh = min(int(rw * scale + 0.5), w - x), min(int(rh * scale + 0.5), h - y)
        if bw > 0 and bh > 0:
            for dx, dy, sign in ((0, 0, 1), (bw, bh, 1), (bw, 0, -1), (0, bh, -1)):
                out[x + dx, y + dy] = out.get((x + dx, y + dy), 0.0) + sign * weight
    return out


def _literal(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def windows(pixels: DataFrame, c: Cascade, least_side: int = 30, grow: float = 1.1) -> DataFrame:
    """(image_id, x, y, w, h) of all windows of grey pixels (image_id, y, x, v) that pass every stage.

    All positions of all scales are one table. A stage asks the integral table
    for the corners of its features, adds up the leaves and keeps the windows
    that reach its threshold, so the table thins out from stage to stage. Rows are dealt by position, and votes by
    picture where pictures are small; no side of a join is sent to all tasks.
    Windows of a variance below 1 are dropped before the first.
    """
    side = raster.sizes(pixels)
    most = side.agg(F.max(F.least(F.col("w") / c.width, F.col("h") / c.height))).collect()[0][0]
    scales = _grid(c, least_side, grow, most or 0)
    if not scales:
        return pixels.where("false").select("image_id", *[F.lit(0).alias(k) for k in "xywh"])
    how = raster.dealing(side)
    spread = lambda rows: rows.repartition(4 * how[0], "image_id", "cy", "cx")
    table = cut(raster.integral(raster.dealt(pixels.select("image_id", "y", "x", "v"), how, "y")))
    table = spread(table.select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "s", "q"))
    grid = _literal([(k, *s) for k, s in enumerate(scales)], ("k", "scale", "ww", "wh", "step"))
    at = raster.dealt(side, how, "w").select("image_id", "w", "h", F.explode(grid).alias("g")).where("g.scale <= least(w / {0}, h / {1}) AND g.ww <= w AND g.wh <= h".format(float(c.width), float(c.height)))
    along = lambda room, size: F.explode(F.sequence(F.lit(0), (F.col(room) - F.col(f"g.{size}")).cast("int"), F.col("g.step")))
    at = at.select("*", along("h", "wh").alias("y")).select("image_id", "g.k", "y", along("w", "ww").alias("x"))

    def met(live: DataFrame, corners: Column, keep: list[str]) -> DataFrame:
        asked = live.select("image_id", "k", "y", "x", *keep, F.explode(F.get(corners, F.col("k"))).alias("c"))
        asked = asked.select("image_id", "k", F.col("y").alias("wy"), F.col("x").alias("wx"), *keep, "c.*", (F.col("y") + F.col("c.dy")).alias("cy"), (F.col("x") + F.col("c.dx")).alias("cx"))
        return raster.dealt(spread(asked).join(table.hint("merge"), ["image_id", "cy", "cx"]), (4 * how[0], how[1]), "wy", "wx")

    frame = F.array(*[_literal([(w, h, 1), (0, 0, 1), (w, 0, -1), (0, h, -1)], ("dx", "dy", "sign")) for _, w, h, _ in scales])
    area = F.get(F.array(*[F.lit(float(w * h)) for _, w, h, _ in scales]), F.col("k"))
    own = met(at, frame, []).groupBy("image_id", "k", "wy", "wx").agg(F.sum(F.col("s") * F.col("sign")).alias("s"), F.sum(F.col("q") * F.col("sign")).alias("q"))
    mean = F.col("s") / area
    own = own.withColumn("var", F.greatest(F.lit(0.0), F.col("q") / area - mean * mean)).where("var >= 1")
    live = own.select("image_id", "k", F.col("wy").alias("y"), F.col("wx").alias("x"), F.sqrt("var").alias("dev"))
    for n, (threshold, weak) in enumerate(c.stages, 1):
        asked = F.array(*[_literal([(i, dx, dy, v) for i, (at_, *_) in enumerate(weak) for (dx, dy), v in sorted(_corners(c.features[at_], scale, w, h).items())], ("weak", "dx", "dy", "coef")) for scale, w, h, _ in scales])
        facts = _literal([(float(node), float(left), float(right)) for _, node, left, right in weak], ("node", "left", "right"))
        value = met(live, asked, ["dev"]).groupBy("image_id", "k", "wy", "wx", "dev", "weak").agg(F.sum(F.col("s") * F.col("coef")).alias("value"))
        fact = F.get(facts, F.col("weak"))
        leaf = F.when(F.col("value") / area < fact["node"] * F.col("dev"), fact["left"]).otherwise(fact["right"])
        voted = value.withColumn("leaf", leaf).groupBy("image_id", "k", "wy", "wx", "dev").agg(F.array_sort(F.collect_list(F.struct("weak", "leaf"))).alias("leaves"))
        total = F.aggregate("leaves", F.lit(0.0), lambda a, x: a + x["leaf"])  # in the order of the stage
        live = voted.where(total >= float(threshold)).select("image_id", "k", F.col("wy").alias("y"), F.col("wx").alias("x"), "dev")
        if n % _STAGES == 0 and n < len(c.stages):
            live = cut(live)
    size = lambda i: F.get(F.array(*[F.lit(s[i]) for s in scales]), F.col("k"))
    return live.select("image_id", "x", "y", size(1).alias("w"), size(2).alias("h"))


def detect(img: np.ndarray, c: Cascade, min_members: int = 3, at_least: float = 0.4, min_confidence: float = 0.0, **how) -> list[dict]:
    """Windows merged by overlap; confidence is a group's size by the largest's; most confident first."""
    found = scan(img, c, **how)
    if not found:
        return []
    groups: dict[int, list[dict]] = {}
    for r, k in zip(found, union_find(found, at_least)):
        groups.setdefault(k, []).append(r)
    top = max(map(len, groups.values()))
    out = [{**{k: sum(r[k] for r in m) // len(m) for k in "xywh"}, "confidence": len(m) / top} for m in groups.values() if len(m) >= min_members]
    return sorted((r for r in out if r["confidence"] >= min_confidence), key=lambda r: -r["confidence"])
