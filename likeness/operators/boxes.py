"""Joins and merges of boxes (image_id, box_id, x, y, w, h, confidence)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from likeness.functions.geometry import area, aspect, iou
from likeness.operators.graph import components
from likeness.operators.images import box_iou, greedy_merge
from likeness.runtime import ship

SCHEMA = "image_id long, box_id long, x int, y int, w int, h int, confidence double"


def overlapping_pairs(boxes: DataFrame, at_least: float = 0.4) -> DataFrame:
    """(image_id, a, b, iou) of the pairs of an image, a < b, that overlap by at least so much.

    An equi-join on the image with the overlap as a filter; a pair that does
    not touch in x is dropped before the division.
    """
    a = boxes.select("image_id", *[F.col(c).alias(f"a_{c}") for c in ("box_id", "x", "y", "w", "h")])
    b = boxes.select("image_id", *[F.col(c).alias(f"b_{c}") for c in ("box_id", "x", "y", "w", "h")])
    touch = (F.col("a_box_id") < F.col("b_box_id")) & (F.col("a_x") < F.col("b_x") + F.col("b_w")) & (F.col("b_x") < F.col("a_x") + F.col("a_w"))
    v = iou(*[F.col(f"{s}_{c}") for s in "ab" for c in "xywh"])
    return a.join(b, "image_id").where(touch).select("image_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), v.alias("iou")).where(F.col("iou") >= at_least)


def near_pairs(boxes: DataFrame, at_least: float = 0.4) -> DataFrame:
    """``overlapping_pairs`` for images of any number of boxes: only boxes that share a cell of a grid meet.

    Boxes that overlap by ``at_least`` (above 0) have sides of which none is longer than the other by more than its
    inverse. So a box stands in the cells of a grid for its own size, at most four, and as a guest in those
    for sizes up to that factor larger; a pair meets on the larger one's grid and counts in the cell of its overlap's corner.
    """
    if not at_least > 0:
        raise ValueError("pairs that do not overlap are not near")
    names = ("box_id", "x", "y", "w", "h")
    own = boxes.select("image_id", *names, (F.length(F.bin(F.greatest("w", "h"))) - 1).alias("size")).where("w > 0 AND h > 0")
    steps = max(0, math.ceil(math.log2(1 / at_least)))

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        cell = F.pow(F.lit(2.0), F.col("grid") + 1)
        span = lambda at, long: F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(long) - 1) / cell)))
        rows = rows.select("*", span("x", "w").alias("cx")).select("*", span("y", "h").alias("cy"))
        return rows.select("image_id", "grid", "cx", "cy", *[F.col(c).alias(f"{side}_{c}") for c in (*names, "size")])

    a = dealt(own.withColumn("grid", F.explode(F.sequence(F.col("size"), F.col("size") + steps))), "a")
    b = dealt(own.withColumn("grid", F.col("size")), "b")
    cell = F.pow(F.lit(2.0), F.col("grid") + 1)
    touch = (F.col("a_x") < F.col("b_x") + F.col("b_w")) & (F.col("b_x") < F.col("a_x") + F.col("a_w")) & (F.col("a_y") < F.col("b_y") + F.col("b_h")) & (F.col("b_y") < F.col("a_y") + F.col("a_h"))
    once = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_box_id") < F.col("b_box_id")))
    here = (F.floor(F.greatest("a_x", "b_x") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y", "b_y") / cell) == F.col("cy"))
    v = iou(*[F.col(f"{s}_{c}") for s in "ab" for c in "xywh"])
    met = a.join(b.hint("merge"), ["image_id", "grid", "cx", "cy"]).where(touch & once & here)
    return met.select("image_id", F.least("a_box_id", "b_box_id").alias("a"), F.greatest("a_box_id", "b_box_id").alias("b"), v.alias("iou")).where(F.col("iou") >= at_least)


def plausible(boxes: DataFrame, least: int, largest: int, min_confidence: float, fill: str | None = None) -> DataFrame:
    """Boxes by side, aspect in [0.5, 2], confidence, and fill of at least 0.3 where known."""
    side = (F.least("w", "h") >= least) & (F.greatest("w", "h") <= largest)
    ok = side & aspect(F.col("w"), F.col("h")).between(0.5, 2.0) & (F.col("confidence") >= min_confidence)
    return boxes.where(ok & (F.col(fill) >= 0.3) if fill else ok)


def group_average(boxes: DataFrame, group: str, min_members: int = 1) -> DataFrame:
    """Mean box of each group of an image (integer division); confidence is the group's size by the image's largest."""
    out = boxes.groupBy("image_id", group).agg(F.count("*").alias("members"), *[F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in "xywh"])
    from pyspark.sql import Window

    top = F.max("members").over(Window.partitionBy("image_id"))
    return out.withColumn("confidence", F.col("members") / top).where(F.col("members") >= min_members)


def largest(boxes: DataFrame) -> DataFrame:
    """Of each image the box of largest area, of equals the first."""
    return boxes.groupBy("image_id").agg(F.max_by(F.struct("box_id", "x", "y", "w", "h", "confidence"), F.struct(area(F.col("w"), F.col("h")), -F.col("box_id"))).alias("b")).select("image_id", "b.*")


def most_confident(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("image_id").agg(F.max_by(F.struct("box_id", "x", "y", "w", "h", "confidence"), F.struct("confidence", -F.col("box_id"))).alias("b")).select("image_id", "b.*")


def placed(boxes: DataFrame) -> DataFrame:
    """``place`` (from 1) of each box in its image: the most confident first, then the largest, then by box_id."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy(F.desc("confidence"), F.desc(area(F.col("w"), F.col("h"))), "box_id")
    return boxes.withColumn("place", F.row_number().over(w).cast("long"))


def _per_image(boxes: DataFrame, f) -> DataFrame:
    """Apply f(list of boxes in order) to each image's boxes; images are streamed from sorted partitions."""
    ship(boxes.sparkSession)
    src = boxes.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition("image_id").sortWithinPartitions("image_id", "box_id")

    def run(batches):
        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and r["image_id"] != held[0]["image_id"]:
                    out += f(held)
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=b.schema)
            schema = b.schema
        if held:
            yield pa.RecordBatch.from_pylist(f(held), schema=schema)

    return src.mapInArrow(run, SCHEMA)


def merged_greedily(boxes: DataFrame, over: float = 0.3) -> DataFrame:
    """Greedy overlap suppression of each image, in the order of box_id."""
    return _per_image(boxes, lambda rows: greedy_merge(rows, over))


def union_find(rows: list[dict], at_least: float = 0.4) -> list[int]:
    """Index of the first member of each box's connected group."""
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i]["x"])
    open_: list[int] = []
    for i in order:  # sweep in x: only boxes that still reach this one
        open_ = [j for j in open_ if rows[j]["x"] + rows[j]["w"] > rows[i]["x"]]
        for j in open_:
            if box_iou(rows[i], rows[j]) >= at_least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        open_.append(i)
    return [find(i) for i in range(len(rows))]


#: Pairs of boxes whose overlap is computed at once, unless one box alone has more.
_PAIRS = 1 << 20


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _groups(image: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, at_least: float) -> np.ndarray:
    """For rows of whole images (image ascending): the first row of each box's connected group, as ``union_find`` has it for one image."""
    n = len(image)
    rank = np.cumsum(np.append(False, image[1:] != image[:-1]))
    order = np.lexsort((x, rank))
    low, room = int(x.min()), int(x.max()) - int(x.min()) + 2
    key = rank[order] * room + (x[order] - low)
    end = np.searchsorted(key, rank[order] * room + np.clip(x[order] + w[order] - low, 0, room - 1))  # boxes after it that begin before it ends
    many = np.maximum(end - np.arange(1, n + 1), 0)
    upto = np.cumsum(many)
    label, lo = np.arange(n), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, side="right")))
        first = np.repeat(np.arange(lo, hi), many[lo:hi])
        then = np.arange(len(first)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi]) + first + 1
        a, b, lo = order[first], order[then], hi
        both = np.maximum(0, np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b])) * np.maximum(0, np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b]))
        union = w[a] * h[a] + w[b] * h[b] - both
        near = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0) >= at_least
        a, b = a[near], b[near]
        while len(a):
            p, q = label[a], label[b]
            apart = p != q
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
    return label


def _merged(parts: list[pa.RecordBatch], at_least: float, min_members: int) -> pa.RecordBatch:
    """The groups of whole images (image_id and box_id ascending), as one batch."""
    b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    image = _ids(b)
    box = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2, 6)]
    label = _groups(image, *box, at_least)
    order = np.argsort(label, kind="stable")
    at = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
    size, first = np.diff(np.append(at, len(order))), label[order][at]  # the groups are in the order of their first rows
    begin = np.flatnonzero(np.append(True, image[first][1:] != image[first][:-1]))
    top = np.repeat(np.maximum.reduceat(size, begin), np.diff(np.append(begin, len(first))))
    kept = size >= min_members
    mean = [pa.array((np.add.reduceat(v[order], at) // size)[kept], pa.int32()) for v in box]
    whole = pa.array(first[kept])
    return pa.RecordBatch.from_arrays([b.column(0).take(whole), b.column(1).take(whole), *mean, pa.array((size / top)[kept])], names=b.schema.names)


def merged_detections(boxes: DataFrame, at_least: float = 0.4, min_members: int = 3, spread: bool = False) -> DataFrame:
    """Connected groups of overlapping boxes, averaged; groups of fewer members go.

    An image's boxes are merged in one task, all whole images of a batch at once, or, with ``spread``, by joins, as where
    a detector leaves more windows of a picture than a task should hold.
    """
    if spread:
        edges = near_pairs(boxes, at_least).select(F.col("image_id").alias("g"), F.col("a").alias("u"), F.col("b").alias("v"))
        found = components(boxes.select(F.col("image_id").alias("g"), F.col("box_id").alias("id")), edges)
        own = boxes.join(found.select(F.col("g").alias("image_id"), F.col("id").alias("box_id"), "label"), ["image_id", "box_id"])
        out = group_average(own, "label", min_members)
        return out.select("image_id", F.col("label").alias("box_id"), *"xywh", "confidence")

    ship(boxes.sparkSession)
    src = boxes.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition("image_id").sortWithinPartitions("image_id", "box_id")

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the image that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            ids = _ids(b)
            last = int(np.searchsorted(ids, ids[-1]))
            if last or held and _ids(held[0])[0] != ids[0]:
                yield _merged([*held, b.slice(0, last)], at_least, min_members)
                held = []
            held.append(b.slice(last))
        if held:
            yield _merged(held, at_least, min_members)

    return src.mapInArrow(run, SCHEMA)
