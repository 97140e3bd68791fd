"""Queries on pictures as tables of pixels: parts, resampling, alignment, equalisation by tiles, cascades."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from likeness.functions import colour as K
from likeness.operators import boxes as B, gallery as G, haar, images as I, raster
from likeness.plans import pictures as P
from likeness.plans import fixtures as X
from likeness.plans.catalogue import query
from likeness.runtime import cut

c = F.col


@query(f"""
WITH RECURSIVE {X.PIXELS_SQL}, lit AS (
  SELECT image_id, y * 8 + x AS p, y, x FROM pixels WHERE v >= 120
), near AS (
  SELECT a.image_id, a.p, b.p AS q FROM lit a JOIN lit b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), reach AS (
  SELECT image_id, p, p AS q FROM lit
  UNION
  SELECT reach.image_id, reach.p, near.q FROM reach JOIN near ON near.image_id = reach.image_id AND near.p = reach.q
), part AS (
  SELECT image_id, p, min(q) AS label FROM reach GROUP BY image_id, p
)
SELECT image_id, CAST(label AS BIGINT) AS label, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x) - min(x) + 1 AS BIGINT) AS w, CAST(max(y) - min(y) + 1 AS BIGINT) AS h,
       count(*) AS count, CAST(sum(x) // count(*) AS BIGINT) AS cx, CAST(sum(y) // count(*) AS BIGINT) AS cy
FROM part JOIN lit USING (image_id, p) GROUP BY image_id, label HAVING count(*) >= 2
""")
def pixel_components(spark, sf):
    """Four-connected parts of at least two pixels of 120 or more."""
    found = raster.components(X.pixels(spark, sf), c("v") >= 120, 2)
    return found.select("image_id", (c("first_y") * X.SIDE + c("first_x")).alias("label"), "x", "y", "w", "h", "count", "cx", "cy")


_FOUR = "JOIN pixels a ON a.image_id = t.image_id AND a.y = t.y0 AND a.x = t.x0 JOIN pixels b ON b.image_id = t.image_id AND b.y = t.y0 AND b.x = t.x1 JOIN pixels d ON d.image_id = t.image_id AND d.y = t.y1 AND d.x = t.x0 JOIN pixels e ON e.image_id = t.image_id AND e.y = t.y1 AND e.x = t.x1"


@query(f"""
WITH {X.PIXELS_SQL}, t AS (
  SELECT image_id, ty, tx, x0, y0, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1, sx - x0 * 24 AS fx, sy - y0 * 20 AS fy
  FROM (SELECT *, sx // 24 AS x0, sy // 20 AS y0 FROM (
    SELECT image_id, ty, tx, least(greatest((2 * tx + 1) * 8 - 12, 0), 168) AS sx, least(greatest((2 * ty + 1) * 8 - 10, 0), 140) AS sy
    FROM (SELECT DISTINCT image_id FROM pixels), range(0, 10) r(ty), range(0, 12) s(tx)))
)
SELECT t.image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x,
       CAST((2 * ((a.v * (24 - fx) + b.v * fx) * (20 - fy) + (d.v * (24 - fx) + e.v * fx) * fy) + 480) // 960 AS INTEGER) AS v
FROM t {_FOUR}
""")
def image_resize(spark, sf):
    """Every picture in 12 x 10."""
    return raster.resized(X.pixels(spark, sf), 12, 10)


_EYES = "SELECT DISTINCT image_id, image_id % 3 AS lx, 2 + image_id % 2 AS ly, 4 + image_id % 4 AS rx, 1 + image_id % 5 AS ry FROM pixels"


def _eyes(spark, sf):
    i = c("image_id")
    return X.pictures(spark, sf).select("image_id", (i % 3).alias("lx"), (2 + i % 2).alias("ly"), (4 + i % 4).alias("rx"), (1 + i % 5).alias("ry"))


@query(f"""
WITH {X.PIXELS_SQL}, eyes AS ({_EYES}), spot AS (
  SELECT image_id, ty, tx,
         ((tx - 5.0::DOUBLE) * (rx - lx) - (ty - 0.25::DOUBLE * 8) * (ry - ly)) / 5.0::DOUBLE + (lx + rx) / 2.0::DOUBLE AS sx,
         ((tx - 5.0::DOUBLE) * (ry - ly) + (ty - 0.25::DOUBLE * 8) * (rx - lx)) / 5.0::DOUBLE + (ly + ry) / 2.0::DOUBLE AS sy
  FROM eyes, range(0, 8) r(ty), range(0, 10) s(tx)
), t AS (
  SELECT *, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1, sx - x0 AS fx, sy - y0 AS fy FROM (SELECT *, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0 FROM spot WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7)
), lit AS (
  SELECT t.image_id, ty, tx, floor((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (d.v * (1 - fx) + e.v * fx) * fy + 0.5) AS v FROM t {_FOUR}
)
SELECT image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, CAST(coalesce(v, 0) AS INTEGER) AS v FROM spot LEFT JOIN lit USING (image_id, ty, tx)
""")
def image_align(spark, sf):
    """Every picture in 10 x 8, turned and scaled by two eyes."""
    return raster.aligned(X.pixels(spark, sf), _eyes(spark, sf), 10, 8, 0.5, 0.25)


@query(f"""
WITH {X.PIXELS_SQL}, b AS (
  SELECT DISTINCT image_id, image_id % 5 AS bx, image_id % 4 AS by_, 3 + image_id % 4 AS bw, 4 + image_id % 3 AS bh FROM pixels
), k AS (
  SELECT image_id, greatest(0, bx - bw // 4) AS x0, greatest(0, by_ - bh // 4) AS y0, bw + 2 * (bw // 4) AS cw, bh + 2 * (bh // 4) AS ch FROM b
), s AS (SELECT image_id, x0 AS ox, y0 AS oy, least(8 - x0, cw) AS w, least(8 - y0, ch) AS h FROM k),
t AS (
  SELECT image_id, ty, tx, ox + px AS x0, oy + py AS y0, ox + least(px + 1, w - 1) AS x1, oy + least(py + 1, h - 1) AS y1, sx - px * 12 AS fx, sy - py * 12 AS fy
  FROM (SELECT *, sx // 12 AS px, sy // 12 AS py FROM (
    SELECT *, least(greatest((2 * tx + 1) * w - 6, 0), (w - 1) * 12) AS sx, least(greatest((2 * ty + 1) * h - 6, 0), (h - 1) * 12) AS sy
    FROM s, range(0, 6) r(ty), range(0, 6) q(tx)))
)
SELECT t.image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x,
       CAST((2 * ((a.v * (12 - fx) + b.v * fx) * (12 - fy) + (d.v * (12 - fx) + e.v * fx) * fy) + 144) // 288 AS INTEGER) AS v
FROM t {_FOUR}
""")
def image_align_region(spark, sf):
    """A box of every picture with a quarter more on each side, in 6 x 6."""
    i = c("image_id")
    box = X.pictures(spark, sf).select("image_id", (i % 5).alias("bx"), (i % 4).alias("by"), (3 + i % 4).alias("bw"), (4 + i % 3).alias("bh"))
    return raster.aligned_region(X.pixels(spark, sf), box, 6, 6, 0.25)


@query(f"""
WITH {X.PIXELS_SQL}, h AS (
  SELECT image_id, y // 4 AS ty, x // 4 AS tx, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id, y // 4, x // 4) AS total FROM pixels GROUP BY image_id, y // 4, x // 4, v
), k AS (
  SELECT *, CAST(floor(48.0::DOUBLE * total / 256) AS BIGINT) AS top FROM h
), tiles AS (
  SELECT image_id, ty, tx, any_value(total) AS total, sum(greatest(n - top, 0)) // 256 AS dealt FROM k GROUP BY image_id, ty, tx
), every AS (
  SELECT tiles.*, v.v, least(coalesce(n, 0), coalesce(top, 0)) + dealt AS n FROM tiles, range(0, 256) v(v) LEFT JOIN k ON k.image_id = tiles.image_id AND k.ty = tiles.ty AND k.tx = tiles.tx AND k.v = v.v
), cdf AS (
  SELECT *, sum(n) OVER (PARTITION BY image_id, ty, tx ORDER BY v) AS cdf FROM every
), first AS (
  SELECT *, coalesce(min(cdf) FILTER (WHERE cdf > 0) OVER (PARTITION BY image_id, ty, tx), 0) AS low FROM cdf
), lut AS (
  SELECT image_id, ty, tx, v, CASE WHEN total > low THEN floor(CAST(cdf - low AS DOUBLE) / CAST(total - low AS DOUBLE) * 255 + 0.5) ELSE v END AS lv FROM first
), spot AS (
  SELECT *, least(x0 + 1, 1) AS x1, least(y0 + 1, 1) AS y1, x / 4.0::DOUBLE - 0.5::DOUBLE - x0 AS fx, y / 4.0::DOUBLE - 0.5::DOUBLE - y0 AS fy
  FROM (SELECT *, CAST(greatest(0, floor(x / 4.0::DOUBLE - 0.5::DOUBLE)) AS BIGINT) AS x0, CAST(greatest(0, floor(y / 4.0::DOUBLE - 0.5::DOUBLE)) AS BIGINT) AS y0 FROM pixels)
)
SELECT t.image_id, t.y, t.x, CAST(greatest(0, least(255, floor((a.lv * (1 - fx) + b.lv * fx) * (1 - fy) + (d.lv * (1 - fx) + e.lv * fx) * fy + 0.5))) AS INTEGER) AS v
FROM spot t JOIN lut a ON a.image_id = t.image_id AND a.ty = t.y0 AND a.tx = t.x0 AND a.v = t.v JOIN lut b ON b.image_id = t.image_id AND b.ty = t.y0 AND b.tx = t.x1 AND b.v = t.v
JOIN lut d ON d.image_id = t.image_id AND d.ty = t.y1 AND d.tx = t.x0 AND d.v = t.v JOIN lut e ON e.image_id = t.image_id AND e.ty = t.y1 AND e.tx = t.x1 AND e.v = t.v
""")
def image_clahe(spark, sf):
    """Every picture equalised by tiles of 4 x 4, counts clipped at 3."""
    return raster.clahe(X.pixels(spark, sf), 4, 48.0)


#: A cascade of two stages on windows of 4 x 4: lighter left than right, then one of two more.
CASCADE = haar.Cascade(
    4, 4,
    [(-0.5, [(0, 0.125, -0.75, 0.75)]), (0.0, [(1, -0.0625, -0.5, 0.5), (2, 0.25, 0.25, -0.25)])],
    [[(0, 0, 4, 4, -1.0), (0, 0, 2, 4, 2.0)], [(0, 0, 4, 4, -1.0), (0, 1, 4, 2, 2.0)], [(0, 0, 2, 2, 1.0), (2, 2, 2, 2, 1.0)]],
)
_RECTS = "(0, 0, 0, 4, 4, -1), (0, 0, 0, 2, 4, 2), (1, 0, 0, 4, 4, -1), (1, 0, 1, 4, 2, 2), (2, 0, 0, 2, 2, 1), (2, 2, 2, 2, 2, 1)"


_SCAN = f"""{X.PIXELS_SQL}, scales AS (
  SELECT 1.0::DOUBLE AS s UNION ALL SELECT s * 1.25::DOUBLE FROM scales WHERE s * 1.25::DOUBLE <= 2
), sized AS (
  SELECT s, CAST(floor(4 * s + 0.5) AS BIGINT) AS w, greatest(1, CAST(floor(2 * s + 0.5) AS BIGINT)) AS step FROM scales
), win AS (
  SELECT i.image_id, s, w, x, y FROM (SELECT DISTINCT image_id FROM pixels) i, sized, range(0, 8) a(x), range(0, 8) b(y)
  WHERE x + w <= 8 AND y + w <= 8 AND x % step = 0 AND y % step = 0
), var AS (
  SELECT win.image_id, s, w, win.x, win.y, sqrt(greatest(0, sum(v * v) / CAST(w * w AS DOUBLE) - (sum(v) / CAST(w * w AS DOUBLE)) * (sum(v) / CAST(w * w AS DOUBLE)))) AS dev
  FROM win JOIN pixels p ON p.image_id = win.image_id AND p.x >= win.x AND p.x < win.x + w AND p.y >= win.y AND p.y < win.y + w
  GROUP BY win.image_id, s, w, win.x, win.y
), rects(f, rx, ry, rw, rh, weight) AS (VALUES {_RECTS}),
placed AS (
  SELECT var.*, f, weight, x + CAST(floor(rx * s + 0.5) AS BIGINT) AS x0, y + CAST(floor(ry * s + 0.5) AS BIGINT) AS y0,
         x + least(CAST(floor(rx * s + 0.5) AS BIGINT) + CAST(floor(rw * s + 0.5) AS BIGINT), w) AS x1, y + least(CAST(floor(ry * s + 0.5) AS BIGINT) + CAST(floor(rh * s + 0.5) AS BIGINT), w) AS y1
  FROM var, rects WHERE dev * dev >= 1
), val AS (
  SELECT placed.image_id, s, w, placed.x, placed.y, dev, f, sum(weight * v) / CAST(w * w AS DOUBLE) AS val
  FROM placed JOIN pixels p ON p.image_id = placed.image_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1
  GROUP BY placed.image_id, s, w, placed.x, placed.y, dev, f
), votes AS (
  SELECT image_id, w, x, y,
         sum(CASE WHEN f = 0 THEN CASE WHEN val < 0.125 * dev THEN -0.75 ELSE 0.75 END ELSE 0 END) AS one,
         sum(CASE WHEN f = 1 THEN CASE WHEN val < -0.0625 * dev THEN -0.5 ELSE 0.5 END WHEN f = 2 THEN CASE WHEN val < 0.25 * dev THEN 0.25 ELSE -0.25 END ELSE 0 END) AS two
  FROM val GROUP BY image_id, s, w, x, y
)"""
_PASSED = "SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(w AS INTEGER) AS h FROM votes WHERE one >= -0.5 AND two >= 0"


@query(f"WITH RECURSIVE {_SCAN} {_PASSED}")
def cascade_windows(spark, sf):
    """All windows of every picture that pass the two stages, at four scales."""
    return haar.windows(X.pixels(spark, sf), CASCADE, 4, 1.25)


_AROUND = X.PIXELS_SQL + """, r AS (
  SELECT *, lag(v) OVER q AS w, lead(v) OVER q AS e FROM pixels WINDOW q AS (PARTITION BY image_id, y ORDER BY x)
), around AS (
  SELECT * FROM (SELECT *, lag(v) OVER d AS n, lead(v) OVER d AS s, lag(w) OVER d AS nw, lag(e) OVER d AS ne, lead(w) OVER d AS sw, lead(e) OVER d AS se FROM r WINDOW d AS (PARTITION BY image_id, x ORDER BY y))
  WHERE nw IS NOT NULL AND ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL AND e IS NOT NULL
)"""


def _blend(i, a, b, d, e):
    """Four neighbours around the point an eighth of a turn times i away."""
    sx, sy = f"(x + {math.cos(2 * math.pi * i / 8)!r}::DOUBLE)", f"(y - {math.sin(2 * math.pi * i / 8)!r}::DOUBLE)"
    fx, fy = f"({sx} - floor({sx}))", f"({sy} - floor({sy}))"
    return f"floor(({a} * (1 - {fx}) + {b} * {fx}) * (1 - {fy}) + ({d} * (1 - {fx}) + {e} * {fx}) * {fy} + 0.5)"


_CODES = _AROUND + f""", codes AS (
  SELECT image_id, y, x, CAST(e >= v AS INT) + 2 * CAST({_blend(1, "n", "ne", "v", "e")} >= v AS INT) + 4 * CAST(n >= v AS INT)
         + 8 * CAST({_blend(3, "nw", "n", "w", "v")} >= v AS INT) + 16 * CAST(w >= v AS INT) + 32 * CAST({_blend(5, "w", "v", "sw", "s")} >= v AS INT)
         + 64 * CAST(s >= v AS INT) + 128 * CAST({_blend(7, "v", "e", "s", "se")} >= v AS INT) AS code
  FROM around
)"""


@query(f"WITH {_CODES} SELECT image_id, y, x, CAST(code AS INTEGER) AS code FROM codes")
def lbp_codes(spark, sf):
    """The full local pattern of every pixel inside a picture."""
    return raster.patterns(X.pixels(spark, sf))


@query(f"WITH {_CODES} SELECT CAST(code AS INTEGER) AS code, count(*) AS n, len(list_filter(range(0, 8), lambda i: ((code >> i) & 1) <> ((code >> ((i + 1) % 8)) & 1))) <= 2 AS uniform FROM codes GROUP BY code")
def lbp_uniform(spark, sf):
    """How often each local pattern occurs, and whether its bits, in a circle, change at most twice."""
    return lbp_codes(spark, sf).groupBy("code").agg(F.count("*").alias("n")).select("code", "n", K.is_uniform(c("code")).alias("uniform"))


@query(f"""
WITH {_AROUND}, b AS (
  SELECT image_id, avg(v / 255.0::DOUBLE) AS b, stddev_pop(v / 255.0::DOUBLE) AS c, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image_id
), l AS (
  SELECT image_id, sqrt(avg((4 * v - w - e - n - s) * (4 * v - w - e - n - s))) / 255 AS s FROM around GROUP BY image_id
), q AS (
  SELECT image_id, round(0.2 * (1 - 2 * abs(b - 0.5)) + 0.3 * least(4 * c, 1) + 0.3 * least(10 * s, 1) + 0.2 * least(least(w, h) / 160.0::DOUBLE, 1), 6) AS score FROM b JOIN l USING (image_id)
)
SELECT image_id, score, score >= 0.5825 AS kept FROM q
""")
def quality_gate(spark, sf):
    """The quality score of every picture, and whether it passes the gate."""
    return raster.quality(X.pixels(spark, sf)).withColumn("score", F.round("score", 6)).select("image_id", "score", G.meets_quality(c("score"), 0.5825).alias("kept"))


_COLOURS = "colours AS (SELECT image_id, y, x, v AS r, (v * 3 + y * 20) % 256 AS g, (v * 2 + x * 9) % 256 AS b FROM pixels)"


@query(f"""
WITH {X.PIXELS_SQL}, {_COLOURS}, k AS (
  SELECT *, CASE WHEN d = 0 THEN 0 WHEN rf = top THEN ((gf - bf) / d + CASE WHEN gf < bf THEN 6 ELSE 0 END) / 6 WHEN gf = top THEN ((bf - rf) / d + 2) / 6 ELSE ((rf - gf) / d + 4) / 6 END AS h,
         CASE WHEN top = 0 THEN 0 ELSE d / top END AS s, trunc(128.0::DOUBLE - r * 0.169::DOUBLE - g * 0.331::DOUBLE + b * 0.5::DOUBLE) AS cb, trunc(128.0::DOUBLE + r * 0.5::DOUBLE - g * 0.419::DOUBLE - b * 0.081::DOUBLE) AS cr
  FROM (SELECT *, greatest(rf, gf, bf) AS top, greatest(rf, gf, bf) - least(rf, gf, bf) AS d FROM (SELECT *, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM colours))
), m AS (
  SELECT image_id, CASE WHEN avg(s) FILTER (WHERE (y * 8 + x) % 3 = 0) < 0.3 THEN 0.1::DOUBLE ELSE 0 END AS ds, CASE WHEN avg(top) FILTER (WHERE (y * 8 + x) % 3 = 0) < 0.4 THEN 0.1::DOUBLE ELSE 0 END AS dv FROM k GROUP BY image_id
)
SELECT image_id, y, x, ((h >= greatest(0, 0 - 0.02::DOUBLE) AND h <= 0.14::DOUBLE + 0.02::DOUBLE) OR (h > 0.9 AND h <= 1)) AND s >= 0.1::DOUBLE - ds AND s <= 0.7::DOUBLE + ds
       AND top >= 0.2::DOUBLE - dv AND top <= least(1, 0.95::DOUBLE + dv) AND cb BETWEEN 77 AND 127 AND cr BETWEEN 133 AND 173 AS skin
FROM k JOIN m USING (image_id)
""")
def skin_adaptive(spark, sf):
    """The skin mask of every picture in colour, its ranges widened by the averages over every third pixel."""
    v = c("v")
    seen = X.pixels(spark, sf).select("image_id", "y", "x", v.alias("r"), ((v * 3 + c("y") * 20) % 256).alias("g"), ((v * 2 + c("x") * 9) % 256).alias("b"))
    return raster.skin(seen, most=20)


_PARTS = """lit AS (
  SELECT image_id, y * 8 + x AS p, y, x FROM pixels WHERE v >= 120
), near AS (
  SELECT a.image_id, a.p, b.p AS q FROM lit a JOIN lit b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), reach AS (
  SELECT image_id, p, p AS q FROM lit
  UNION
  SELECT reach.image_id, reach.p, near.q FROM reach JOIN near ON near.image_id = reach.image_id AND near.p = reach.q
), part AS (
  SELECT image_id, p, min(q) AS label FROM reach GROUP BY image_id, p
)"""


@query(f"""
WITH RECURSIVE {_CODES}, {_PARTS}, sized AS (
  SELECT image_id, count(*) AS parts FROM (SELECT image_id, label FROM part GROUP BY image_id, label HAVING count(*) >= 3) GROUP BY image_id
), sharp AS (
  SELECT image_id, round(sqrt(avg((4 * v - w - e - n - s) * (4 * v - w - e - n - s))) / 255, 6) AS sharpness FROM around GROUP BY image_id
), lists AS (
  SELECT p.image_id, list(CAST(coalesce(c.code, 0) AS INTEGER) ORDER BY p.y, p.x) AS patterns FROM pixels p LEFT JOIN codes c USING (image_id, y, x) GROUP BY p.image_id
)
SELECT image_id, patterns, sharpness, CAST(coalesce(parts, 0) AS INTEGER) AS parts, CAST(NULL AS VARCHAR) AS error FROM lists JOIN sharp USING (image_id) LEFT JOIN sized USING (image_id)
""")
def image_kernels(spark, sf):
    """Full local patterns, sharpness and components of every picture, by the array kernels."""
    data = X.pictures(spark, sf).select("image_id", "width", F.lit(X.SIDE).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("data"))

    def kernels(g):
        return {"patterns": I.lbp(g).ravel().tolist(), "sharpness": round(I.sharpness(g), 6), "parts": len(I.components(g >= 120, 3))}

    return I.map_images(data, kernels, "patterns array<int>, sharpness double, parts int")


@query(f"WITH {X.PIXELS_SQL} SELECT image_id, y, x, v FROM pixels")
def decode_pgm(spark, sf):
    """Every picture written as a PGM file, raw or as text, and decoded again."""
    from likeness.sources import images as S

    own = X.pictures(spark, sf)
    raw = F.concat(F.lit(f"P5\n# a comment\n{X.SIDE} {X.SIDE}\n255\n").cast("binary"), F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    written = F.concat(F.lit(f"P2 {X.SIDE} {X.SIDE} 255\n"), F.array_join(c("v").cast("array<string>"), " ")).cast("binary")
    found = own.select("image_id", F.when(c("image_id") % 2 == 0, raw).otherwise(written).alias("content"))
    seen = S.decoded(found, size=None)
    byte = lambda i: F.conv(F.hex(F.substring(c("data"), i + 1, F.lit(1))), 16, 10).cast("int")
    values = F.transform(F.sequence(F.lit(0), c("width") * c("height") - 1), byte)
    return I.pixels(seen.select("image_id", "width", values.alias("v"))).select("image_id", "y", "x", "v")


@query(f"""
WITH {X.PIXELS_SQL}, b AS (SELECT DISTINCT image_id, image_id % 5 AS bx, image_id % 4 AS by_, 2 + image_id % 9 AS bw, 3 + image_id % 3 AS bh FROM pixels)
SELECT image_id, CAST(y - by_ AS BIGINT) AS y, CAST(x - bx AS BIGINT) AS x, v FROM pixels JOIN b USING (image_id) WHERE x >= bx AND x < bx + bw AND y >= by_ AND y < by_ + bh
""")
def image_crop(spark, sf):
    """A box of every picture; where it reaches beyond, what is inside."""
    i = c("image_id")
    box = X.pictures(spark, sf).select("image_id", (i % 5).alias("bx"), (i % 4).alias("by"), (2 + i % 9).alias("bw"), (3 + i % 3).alias("bh"))
    return raster.cropped(X.pixels(spark, sf), box).select("image_id", c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), "v")


_LINK = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"


@query(f"""
WITH RECURSIVE {_SCAN}, boxes AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w, y, x) AS box_id FROM ({_PASSED})
), linked AS (
  SELECT a.image_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id
  WHERE {_LINK} >= 0.4 * (a.w * a.h + b.w * b.h - {_LINK})
), met AS (
  SELECT image_id, box_id, box_id AS other FROM boxes
  UNION
  SELECT met.image_id, met.box_id, linked.b FROM met JOIN linked ON linked.image_id = met.image_id AND linked.a = met.other
), head AS (
  SELECT image_id, box_id, min(other) AS head FROM met GROUP BY image_id, box_id
), merged AS (
  SELECT image_id, head AS box_id, CAST(sum(x) // count(*) AS INTEGER) AS x, CAST(sum(y) // count(*) AS INTEGER) AS y, CAST(sum(w) // count(*) AS INTEGER) AS w, CAST(sum(h) // count(*) AS INTEGER) AS h, count(*) AS n
  FROM boxes JOIN head USING (image_id, box_id) GROUP BY image_id, head
)
SELECT image_id, box_id, x, y, w, h, confidence FROM (SELECT *, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY image_id) AS confidence FROM merged) WHERE n >= 3
""")
def cascade_faces(spark, sf):
    """The windows that pass the cascade, merged where they overlap by two fifths; groups of fewer than three go."""
    w = Window.partitionBy("image_id").orderBy("w", "y", "x")
    found = cut(haar.windows(X.pixels(spark, sf), CASCADE, 4, 1.25))  # read several times
    boxes = found.select("image_id", F.row_number().over(w).cast("long").alias("box_id"), "x", "y", "w", "h", F.lit(1.0).alias("confidence"))
    return B.merged_detections(boxes, spread=True)


def _sliding(name: str, source: str, f: str, r: int) -> str:
    between = f"ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING"
    return f"{name}_row AS (SELECT image_id, y, x, {f}(m) OVER (PARTITION BY image_id, y ORDER BY x {between}) AS m FROM {source}), {name} AS (SELECT image_id, y, x, {f}(m) OVER (PARTITION BY image_id, x ORDER BY y {between}) AS m FROM {name}_row)"


_TINTS = """colours AS (
  SELECT image_id, y, x, CASE WHEN i THEN least(255, v + 60) ELSE v END AS r, CASE WHEN i THEN CAST(floor(v * 0.75::DOUBLE + 20.5::DOUBLE) AS INTEGER) ELSE v END AS g,
         CASE WHEN i THEN CAST(floor(v * 0.5::DOUBLE + 30.5::DOUBLE) AS INTEGER) ELSE v END AS b
  FROM (SELECT *, (x < 3 + image_id % 4 AND y < 3 + image_id % 5) OR (x >= 6 AND y >= 5) AS i FROM pixels)
)"""
_REGIONS_SQL = f"""{X.PIXELS_SQL}, {_TINTS}, k AS (
  SELECT *, CASE WHEN d = 0 THEN 0 WHEN rf = top THEN ((gf - bf) / d + CASE WHEN gf < bf THEN 6 ELSE 0 END) / 6 WHEN gf = top THEN ((bf - rf) / d + 2) / 6 ELSE ((rf - gf) / d + 4) / 6 END AS h,
         CASE WHEN top = 0 THEN 0 ELSE d / top END AS s, trunc(128.0::DOUBLE - r * 0.169::DOUBLE - g * 0.331::DOUBLE + b * 0.5::DOUBLE) AS cb, trunc(128.0::DOUBLE + r * 0.5::DOUBLE - g * 0.419::DOUBLE - b * 0.081::DOUBLE) AS cr
  FROM (SELECT *, greatest(rf, gf, bf) AS top, greatest(rf, gf, bf) - least(rf, gf, bf) AS d FROM (SELECT *, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM colours))
), seen AS (
  SELECT image_id, y, x, ((h >= 0 AND h <= 0.14::DOUBLE) OR (h > 0.9 AND h <= 1)) AND s >= 0.1::DOUBLE AND s <= 0.7::DOUBLE AND top >= 0.2::DOUBLE AND top <= 0.95::DOUBLE AND cb BETWEEN 77 AND 127 AND cr BETWEEN 133 AND 173 AS m FROM k
), {_sliding("worn", "seen", "bool_and", 1)}, inside AS (
  SELECT image_id, y, x, m AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AS m FROM worn
), {_sliding("grown", "inside", "bool_or", 2)}, lit AS (
  SELECT image_id, y * 8 + x AS p, y, x FROM grown WHERE m
), touch AS (
  SELECT a.image_id, a.p, b.p AS q FROM lit a JOIN lit b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), reach AS (
  SELECT image_id, p, p AS q FROM lit
  UNION
  SELECT reach.image_id, reach.p, touch.q FROM reach JOIN touch ON touch.image_id = reach.image_id AND touch.p = reach.q
), part AS (
  SELECT image_id, p, min(q) AS label FROM reach GROUP BY image_id, p
), sized AS (
  SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM part JOIN lit USING (image_id, p) GROUP BY image_id, label HAVING count(*) >= 4
), sure AS (
  SELECT *, least(1.0::DOUBLE, least(n / (w * h) / 0.6::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + greatest(0.0::DOUBLE, 1 - abs(w / h - 0.85::DOUBLE)) * 0.3::DOUBLE + CASE WHEN least(w, h) < 4 THEN 0.7::DOUBLE WHEN least(w, h) < 10 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END * 0.3::DOUBLE) AS confidence FROM sized
), boxes AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY label) AS box_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, confidence
  FROM sure WHERE least(w, h) >= 2 AND w / h BETWEEN 0.5 AND 2 AND n / (w * h) >= 0.3 AND confidence >= 0.3
)"""


@query("SELECT image_id, box_id, x, y, w, h, round(confidence, 6) AS confidence FROM (" + P.GREEDY_SQL.replace(X.BOXES_SQL, _REGIONS_SQL) + ")")
def skin_regions(spark, sf):
    """Boxes of skin of every picture in colour: mask, erosion and dilation, parts, filters and greedy merge."""
    v = c("v")
    i = ((c("x") < 3 + c("image_id") % 4) & (c("y") < 3 + c("image_id") % 5)) | ((c("x") >= 6) & (c("y") >= 5))
    warm = {"r": F.least(F.lit(255), v + 60), "g": F.floor(v * 0.75 + 20.5).cast("int"), "b": F.floor(v * 0.5 + 30.5).cast("int")}
    tint = X.pixels(spark, sf).select("image_id", "y", "x", *[F.when(i, k).otherwise(v).alias(n) for n, k in warm.items()])  # grey elsewhere
    return raster.skin_regions(tint, least_side=2, least=4, adaptive=False).withColumn("confidence", F.round("confidence", 6))
