"""Pictures as tables of pixels (image_id, y, x, v): work on rasters of any size, without an array a task.

Every step is a join or a window over one row or one column of a picture. Sums
are of integers wherever the definition allows it, so results do not depend on
the order in which partial sums meet. Rows with a null position take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.functions import colour
from likeness.operators.boxes import merged_greedily
from likeness.operators.graph import components as graph_components

_WIDE = 1 << 32  # a position is y * _WIDE + x
#: Pixels in a partition, about.
ROWS = 1 << 16


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, w, h)."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def dealing(side: DataFrame, each: int = 1) -> tuple[int, bool]:
    """Partitions for work on pictures of sizes ``side`` of at least ``each`` rows a picture, and whether a picture fits one.

    Rows that are exploded from few are many more than Spark expects of their source, so the
    number of partitions follows from their own count: about ROWS pixels each.
    """
    area = F.col("w").cast("long") * F.col("h")
    n, most = side.agg(F.sum(F.greatest(area, F.lit(each))), F.max(area)).collect()[0]
    return min(20_000, max(1, -(-int(n or 0) // ROWS))), (most or 0) <= ROWS


def dealt(rows: DataFrame, how: tuple[int, bool], *keys: str) -> DataFrame:
    """Rows dealt by picture, or by ``keys`` as well if a picture does not fit."""
    return rows.repartition(how[0], "image_id", *(() if how[1] else keys))


# ----------------------------------------------------------------- components
def components(pixels: DataFrame, mask: Column, least: int = 100) -> DataFrame:
    """Four-connected parts of the pixels where ``mask`` holds, of at least ``least`` pixels each.

    image_id, first_y, first_x (the first pixel in row-major order), x, y, w, h
    (box), count, cx, cy (centre, whole numbers). Pixels of a row are put
    together to runs; runs of neighbouring rows that share a column are edges of a
    graph, whose components are found by joins.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    on = pixels.where(mask).where("y IS NOT NULL AND x IS NOT NULL").select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    begins = F.coalesce(F.lag("x").over(row) != F.col("x") - 1, F.lit(True))
    on = on.withColumn("begin", F.when(begins, F.col("x"))).withColumn("x0", F.last("begin", ignorenulls=True).over(row))
    runs = on.groupBy("image_id", "y", "x0").agg(F.max("x").alias("x1"), F.sum("x").alias("sx"), F.count("*").alias("n"))
    below = on.withColumns({"up": F.lag("y").over(column), "up_x0": F.lag("x0").over(column)}).where("up = y - 1")
    at = lambda y, x: F.col(y) * _WIDE + F.col(x)
    nodes = runs.select(F.col("image_id").alias("g"), at("y", "x0").alias("id"))
    found = graph_components(nodes, below.select(F.col("image_id").alias("g"), at("y", "x0").alias("u"), at("up", "up_x0").alias("v")))
    whole = runs.withColumn("id", at("y", "x0")).join(found.withColumnRenamed("g", "image_id"), ["image_id", "id"])
    part = whole.groupBy("image_id", "label").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.sum("n").alias("count"), F.sum("sx").alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"),
    ).where(F.col("count") >= least)
    centre = lambda s: F.floor(F.col(s) / F.col("count"))
    return part.select("image_id", F.floor(F.col("label") / _WIDE).alias("first_y"), (F.col("label") % _WIDE).alias("first_x"), "x", "y", "w", "h", "count", centre("sx").alias("cx"), centre("sy").alias("cy"))


# ------------------------------------------------------------------ resampling
def _targets(frame: DataFrame, w: int, h: int) -> DataFrame:
    """Each row of ``frame`` for each pixel (ty, tx) of a target of w x h."""
    rows = frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("ty"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("tx"))


def _gathered(targets: DataFrame, pixels: DataFrame, keep: list[str]) -> DataFrame:
    """image_id, ty, tx, ``keep`` and the values v00, v01, v10, v11 at (y0, x0), (y0, x1), (y1, x0), (y1, x1)."""
    corner = lambda k, y, x: F.struct(F.lit(k).alias("k"), F.col(y).alias("y"), F.col(x).alias("x"))
    four = F.array(corner("00", "y0", "x0"), corner("01", "y0", "x1"), corner("10", "y1", "x0"), corner("11", "y1", "x1"))
    asked = targets.select("image_id", "ty", "tx", *keep, F.explode(four).alias("c")).select("image_id", "ty", "tx", *keep, "c.*")
    met = asked.join(pixels.select("image_id", "y", "x", "v").hint("merge"), ["image_id", "y", "x"])
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}")
    return met.groupBy("image_id", "ty", "tx", *keep).agg(*[value(k) for k in ("00", "01", "10", "11")])


def resized(pixels: DataFrame, w: int, h: int, of: DataFrame | None = None) -> DataFrame:
    """Bilinear by pixel centres, halves up: (image_id, y, x, v) of w x h for each picture.

    A target pixel's place in the source is a fraction with denominator twice the
    target's side, so the four weights are whole numbers and the value is exact. A source pixel counts
    for the targets less than a pixel away from it, so pixels meet their picture's size and no other pixel.
    A target of which a source is missing or null is null.
    """

    def axis(at: str, side: str, to: int, t: str) -> Column:
        """The targets t near a source row or column, with weights of 0 at the ends of the range."""
        near = lambda d: F.floor((F.lit(2 * to) * (F.col(at) + d) + to) / (2 * F.col(side)) - 0.5).cast("int")
        low = F.when(F.col(at) == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), near(-1)))
        high = F.when(F.col(at) == F.col(side) - 1, F.lit(to - 1)).otherwise(F.least(F.lit(to - 1), near(1) + 1))
        return F.explode(F.when(low <= high, F.sequence(low, high))).alias(t)

    def weight(at: str, side: str, to: int, t: str) -> Column:
        top = F.greatest(F.lit(0), F.least((2 * F.col(t) + 1) * F.col(side) - to, (F.col(side) - 1) * 2 * to)).cast("long")
        return F.greatest(F.lit(0), 2 * to - F.abs(top - F.col(at).cast("long") * (2 * to)))

    side = of if of is not None else sizes(pixels)
    how = dealing(side, w * h)
    own = dealt(pixels.select("image_id", "y", "x", "v"), how, "y")
    side = (of if of is not None else sizes(own)).select("image_id", "w", "h")
    one = own.groupBy("image_id", "y", "x").agg(F.max("v").alias("v")).join(side.hint("merge"), "image_id")
    rows = one.select("*", axis("y", "h", h, "ty")).withColumn("wy", weight("y", "h", h, "ty")).where("wy > 0")
    both = rows.select("image_id", "v", "x", "w", "ty", "wy", axis("x", "w", w, "tx")).withColumn("wx", weight("x", "w", w, "tx")).where("wx > 0")
    by = F.when(F.col("v").isNotNull(), F.col("wy") * F.col("wx"))
    got = both.groupBy("image_id", "ty", "tx").agg(F.sum(F.col("v") * by).alias("total"), F.sum(by).alias("whole"))
    whole = 4 * w * h
    value = F.when(F.col("whole") == whole, F.floor((2 * F.col("total") + whole) / (2 * whole))).cast("int")
    return got.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), value.alias("v"))


def cropped(pixels: DataFrame, boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """The pixels of each box (image_id, bx, by, bw, bh), widened by a margin and clamped to the picture; positions count from the crop's corner."""
    side = sizes(pixels)
    mx, my = F.floor(F.col("bw") * margin), F.floor(F.col("bh") * margin)
    b = boxes.join(side, "image_id").withColumns({"x0": F.greatest(F.lit(0), F.col("bx") - mx), "y0": F.greatest(F.lit(0), F.col("by") - my)})
    b = b.withColumns({"x1": F.least(F.col("w"), F.col("x0") + F.col("bw") + 2 * mx), "y1": F.least(F.col("h"), F.col("y0") + F.col("bh") + 2 * my)})
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return pixels.join(b.select("image_id", "x0", "y0", "x1", "y1"), "image_id").where(inside).select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def aligned_region(pixels: DataFrame, boxes: DataFrame, w: int, h: int, margin: float = 0.1) -> DataFrame:
    """Each picture's box with a tenth more on each side, clamped, in w x h."""
    return resized(cropped(pixels, boxes, margin), w, h)


def aligned(pixels: DataFrame, eyes: DataFrame, w: int, h: int, eye_distance: float = 0.35, eye_height: float = 0.35) -> DataFrame:
    """Pictures of w x h with the eyes level: centred at half the width and ``eye_height`` of the height, ``eye_distance`` of the width apart.

    eyes (image_id, lx, ly, rx, ry), one row a picture. A target's place in the
    source follows from the eyes without an angle: the turn and the scale cancel
    to the vector between the eyes over the distance wanted. Outside is black.
    """
    at = _targets(eyes.join(sizes(pixels), "image_id"), w, h)
    dx, dy = F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")
    tx, ty, unit = F.col("tx") - w / 2, F.col("ty") - eye_height * h, F.lit(float(eye_distance * w))
    at = at.withColumns({"sx": (tx * dx - ty * dy) / unit + (F.col("lx") + F.col("rx")) / 2, "sy": (tx * dy + ty * dx) / unit + (F.col("ly") + F.col("ry")) / 2})
    inside = (F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") <= F.col("w") - 1) & (F.col("sy") <= F.col("h") - 1)
    on = at.where(inside).withColumns({"x0": F.floor("sx"), "y0": F.floor("sy")})
    on = on.withColumns({"x1": F.least(F.col("x0") + 1, F.col("w") - 1), "y1": F.least(F.col("y0") + 1, F.col("h") - 1), "fx": F.col("sx") - F.col("x0"), "fy": F.col("sy") - F.col("y0")})
    got = _gathered(on, pixels, ["fx", "fy"])
    value = (F.col("v00") * (1 - F.col("fx")) + F.col("v01") * F.col("fx")) * (1 - F.col("fy")) + (F.col("v10") * (1 - F.col("fx")) + F.col("v11") * F.col("fx")) * F.col("fy")
    lit = got.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), F.floor(value + 0.5).cast("int").alias("v"))
    dark = at.where(~inside).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), F.lit(0).alias("v"))
    return lit.unionByName(dark)


# ---------------------------------------------------------------- equalisation
def clahe(pixels: DataFrame, tile: int, limit: float) -> DataFrame:
    """Equalised by tiles whose histograms are clipped at ``limit`` times their mean, tables blended bilinearly.

    What is clipped is dealt evenly to all 256 values, as far as it divides. Only
    the values that a picture's pixels ask of a tile's table are worked out: those
    of its own and of its neighbours' pixels, at most 256 a tile.
    """
    how = dealing(sizes(pixels), 1)
    pixels = dealt(pixels.select("image_id", "y", "x", "v"), how, "y")
    side = sizes(pixels).select("image_id", F.ceil(F.col("w") / tile).alias("nx"), F.ceil(F.col("h") / tile).alias("ny")).hint("merge")
    spot = lambda c: F.floor(F.col(c) / tile)
    counts = pixels.groupBy("image_id", spot("y").alias("ty"), spot("x").alias("tx"), "v").agg(F.count("*").alias("n"))
    one = Window.partitionBy("image_id", "ty", "tx")
    top = F.floor(F.lit(float(limit)) * F.col("total") / 256)
    clipped = counts.withColumn("total", F.sum("n").over(one)).withColumns({"cut": F.least(F.col("n"), top), "over": F.greatest(F.col("n") - top, F.lit(0))})
    place = lambda c: F.col(c) / tile - 0.5
    low = lambda c: F.greatest(F.lit(0), F.floor(place(c)))
    at = pixels.join(side, "image_id").withColumns({"x0": low("x"), "y0": low("y")})
    at = at.withColumns({"x1": F.least(F.col("nx") - 1, F.col("x0") + 1), "y1": F.least(F.col("ny") - 1, F.col("y0") + 1), "fx": place("x") - F.col("x0"), "fy": place("y") - F.col("y0")})
    corner = lambda k, y, x: F.struct(F.lit(k).alias("k"), F.col(y).alias("ty"), F.col(x).alias("tx"))
    four = F.array(corner("00", "y0", "x0"), corner("01", "y0", "x1"), corner("10", "y1", "x0"), corner("11", "y1", "x1"))
    asked = at.select("image_id", "y", "x", "v", "fx", "fy", F.explode(four).alias("c")).select("image_id", "y", "x", "v", "fx", "fy", "c.*")
    none = F.lit(0).cast("long")
    both = clipped.select("image_id", "ty", "tx", "v", "cut", "over", "n").unionByName(asked.select("image_id", "ty", "tx", "v", none.alias("cut"), none.alias("over"), none.alias("n")).distinct())
    both = dealt(both, how, "ty", "tx")
    table = both.groupBy("image_id", "ty", "tx", "v").agg(*[F.sum(k).alias(k) for k in ("cut", "over", "n")])
    table = table.withColumns({"total": F.sum("n").over(one), "dealt": F.floor(F.sum("over").over(one) / 256), "sum": F.sum("cut").over(one.orderBy("v"))})
    table = table.withColumn("cdf", F.col("sum") + (F.col("v") + 1) * F.col("dealt"))
    # The least table value above none: with something dealt, that of value 0.
    first = F.when(F.col("dealt") > 0, F.coalesce(F.max(F.when(F.col("v") == 0, F.col("cut"))).over(one), F.lit(0)) + F.col("dealt")).otherwise(F.coalesce(F.min(F.when(F.col("cdf") > 0, F.col("cdf"))).over(one), F.lit(0)))
    table = table.withColumn("first", first)
    room = F.col("total") - F.col("first")
    level = F.when(room > 0, F.floor((F.col("cdf") - F.col("first")) / F.when(room > 0, room) * 255 + 0.5)).otherwise(F.col("v"))
    spread = lambda rows: rows.repartition(4 * how[0], "image_id", "ty", "tx", "v")
    got = dealt(spread(asked).join(spread(table.select("image_id", "ty", "tx", "v", level.alias("level"))).hint("merge"), ["image_id", "ty", "tx", "v"]), how, "y", "x")
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("level"))).alias(f"v{k}")
    got = got.groupBy("image_id", "y", "x", "fx", "fy").agg(*[value(k) for k in ("00", "01", "10", "11")])
    fx, fy = F.col("fx"), F.col("fy")
    mixed = (F.col("v00") * (1 - fx) + F.col("v01") * fx) * (1 - fy) + (F.col("v10") * (1 - fx) + F.col("v11") * fx) * fy
    return got.select("image_id", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(mixed + 0.5))).cast("int").alias("v"))


# ------------------------------------------------------------- integral tables
def integral(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, s, q): sums of the values and of their squares over all pixels above and left of the corner (y, x); corners at 0 have no row."""
    across = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    v = F.col("v").cast("long")
    s = pixels.withColumns({"s": F.sum(v).over(across), "q": F.sum(v * v).over(across)})
    s = s.withColumns({"s": F.sum("s").over(down), "q": F.sum("q").over(down)})
    return s.select("image_id", (F.col("y") + 1).cast("int").alias("y"), (F.col("x") + 1).cast("int").alias("x"), "s", "q")


# -------------------------------------------------------------- neighbourhoods
def neighbours(pixels: DataFrame) -> DataFrame:
    """The pixels inside a picture with their eight neighbours n, ne, e, se, s, sw, w, nw; the border has not all of them and goes."""
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = pixels.select("image_id", "y", "x", "v").withColumns({"w": F.lag("v").over(across), "e": F.lead("v").over(across)})
    p = p.withColumns({f"{a}{b}": f(b or "v").over(down) for a, f in (("n", F.lag), ("s", F.lead)) for b in ("", "w", "e")})
    return p.where(" AND ".join(f"{k} IS NOT NULL" for k in ("n", "s", "w", "e", "nw", "ne", "sw", "se")))


def patterns(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, code): bit i of the local pattern is set where the neighbour at an eighth of a turn times i, one pixel away, is not darker.

    Neighbours on the diagonals lie between pixels and are blended of four.
    """

    def blend(i: int, a: str, b: str, c: str, d: str) -> Column:
        turn = 2 * math.pi * i / 8
        sx, sy = F.col("x") + F.lit(math.cos(turn)), F.col("y") - F.lit(math.sin(turn))
        fx, fy = sx - F.floor(sx), sy - F.floor(sy)
        return F.floor((F.col(a) * (1 - fx) + F.col(b) * fx) * (1 - fy) + (F.col(c) * (1 - fx) + F.col(d) * fx) * fy + 0.5)

    near = [F.col("e"), blend(1, "n", "ne", "v", "e"), F.col("n"), blend(3, "nw", "n", "w", "v"), F.col("w"), blend(5, "w", "v", "sw", "s"), F.col("s"), blend(7, "v", "e", "s", "se")]
    bits = [F.when(x >= F.col("v"), 1 << i).otherwise(0) for i, x in enumerate(near)]
    return neighbours(pixels).select("image_id", "y", "x", sum(bits[1:], bits[0]).cast("int").alias("code"))


def quality(pixels: DataFrame) -> DataFrame:
    """(image_id, brightness, contrast, sharpness, score) of grey pictures; the weights are fixed values. A picture without an inside is not sharp."""
    v = F.col("v") / F.lit(255.0)
    own = pixels.groupBy("image_id").agg(F.avg(v).alias("brightness"), F.stddev_pop(v).alias("contrast"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    lap = 4 * F.col("v") - F.col("w") - F.col("e") - F.col("n") - F.col("s")
    sharp = neighbours(pixels).groupBy("image_id").agg((F.sqrt(F.avg(lap * lap)) / 255).alias("sharpness"))
    out = own.join(sharp, "image_id", "left").withColumn("sharpness", F.coalesce("sharpness", F.lit(0.0)))
    one = lambda c: F.least(c, F.lit(1.0))
    score = 0.2 * (1 - 2 * F.abs(F.col("brightness") - 0.5)) + 0.3 * one(4 * F.col("contrast")) + 0.3 * one(10 * F.col("sharpness")) + 0.2 * one(F.least("w", "h") / 160)
    return out.select("image_id", "brightness", "contrast", "sharpness", score.alias("score"))


def skin(pixels: DataFrame, adaptive: bool = True, most: int = 10_000) -> DataFrame:
    """(image_id, y, x, skin) of colour pixels (image_id, y, x, r, g, b), by hue, saturation and value and by chroma.

    ``adaptive``: in a picture whose saturation or value is low on average, both
    ends of that range move by a margin; the average is over every n-th pixel in
    row-major order, about ``most`` of them.
    """
    p = pixels.withColumn("k", colour.hsv(F.col("r"), F.col("g"), F.col("b"))).withColumn("m", colour.ycbcr(F.col("r"), F.col("g"), F.col("b")))
    low, high = [list(map(F.lit, x)) for x in (colour.SKIN_LOW, colour.SKIN_HIGH)]
    if adaptive:
        side = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), F.count("*").alias("_n"))
        sized = p.join(side, "image_id")
        step = F.greatest(F.floor(F.col("_n") / F.least(F.col("_n"), F.lit(most))), F.lit(1))
        drawn = (F.col("y") * F.col("_w") + F.col("x")) % step == 0
        mean = sized.where(drawn).groupBy("image_id").agg(F.avg("k.s").alias("_s"), F.avg("k.v").alias("_v"))
        p = p.join(mean, "image_id")
        by = [F.lit(0.02), F.when(F.col("_s") < 0.3, 0.1).otherwise(0.0), F.when(F.col("_v") < 0.4, 0.1).otherwise(0.0)]
        low = [F.greatest(F.lit(0.0), x - d) for x, d in zip(low, by)]
        high = [F.least(F.lit(1.0), x + d) for x, d in zip(high, by)]
    h = F.col("k.h")
    inside = lambda c, i: (F.col(c) >= low[i]) & (F.col(c) <= high[i])
    by_hue = (inside("k.h", 0) | ((h > 0.9) & (h <= 1.0))) & inside("k.s", 1) & inside("k.v", 2)
    return p.select("image_id", "y", "x", (by_hue & colour.skin_ycbcr(F.col("m.cb"), F.col("m.cr"))).alias("skin"))


# ------------------------------------------------------------------ morphology
def _window(mask: DataFrame, k: int, f) -> DataFrame:
    """``f`` of the column m over the k x k window of each pixel, clipped at the borders, as two one-dimensional passes."""
    r = k // 2
    across, down = (Window.partitionBy("image_id", a).orderBy(b).rowsBetween(-r, r) for a, b in (("y", "x"), ("x", "y")))
    return mask.select("image_id", "y", "x", "m").withColumn("m", f("m").over(across)).withColumn("m", f("m").over(down))


def eroded(mask: DataFrame, k: int) -> DataFrame:
    """(image_id, y, x, m) of a mask of every pixel: true where the whole window is; the border of k // 2 is false."""
    r = k // 2
    inside = (F.col("y") >= r) & (F.col("x") >= r) & (F.col("y") < F.col("h") - r) & (F.col("x") < F.col("w") - r)
    return _window(mask, k, F.min).join(sizes(mask).hint("merge"), "image_id").select("image_id", "y", "x", (F.col("m") & inside).alias("m"))


def dilated(mask: DataFrame, k: int) -> DataFrame:
    """(image_id, y, x, m) of a mask of every pixel: true where any of the window is."""
    return _window(mask, k, F.max)


def skin_regions(pixels: DataFrame, least_side: int = 30, largest_side: int | None = None, min_confidence: float = 0.3, least: int = 100, adaptive: bool = True) -> DataFrame:
    """Boxes of skin (image_id, box_id, x, y, w, h, confidence) of colour pixels: mask, erosion and dilation, parts, filters, greedy merge.

    box_id follows the first pixel of the part, in row-major order.
    """
    mask = dealt(skin(pixels, adaptive).withColumnRenamed("skin", "m"), dealing(sizes(pixels)), "y")
    found = components(dilated(eroded(mask, 3), 5), F.col("m"), least)
    fill, shape = F.col("count") / (F.col("w") * F.col("h")), F.col("w") / F.col("h")
    side = F.least("w", "h")
    by_size = F.when(side < 2 * least_side, 0.7).when(side < 5 * least_side, 1.0).otherwise(0.8)
    sure = F.least(F.lit(1.0), F.least(fill / 0.6, F.lit(1.0)) * 0.4 + F.greatest(F.lit(0.0), 1 - F.abs(shape - 0.85)) * 0.3 + by_size * 0.3)
    ok = (side >= least_side) & shape.between(0.5, 2.0) & (fill >= 0.3) & (sure >= min_confidence)
    if largest_side is not None:
        ok = ok & (F.greatest("w", "h") <= largest_side)
    order = Window.partitionBy("image_id").orderBy("first_y", "first_x")
    kept = found.withColumn("confidence", sure).where(ok).withColumn("box_id", F.row_number().over(order).cast("long"))
    whole = [F.col(c).cast("int").alias(c) for c in "xywh"]
    return merged_greedily(kept.select(F.col("image_id").cast("long").alias("image_id"), "box_id", *whole, "confidence"))
