"""Queries on boxes, colours and pictures."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from likeness.functions import colour as K, geometry as Q
from likeness.operators import boxes as B
from likeness.plans import fixtures as X
from likeness.plans.catalogue import query

c = F.col


def _xywh():
    return [c(k) for k in "xywh"]


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id, w * h AS area, CAST(x + w // 2 AS INTEGER) AS cx, CAST(y + h // 2 AS INTEGER) AS cy, round(w / h, 6) AS aspect FROM boxes")
def box_geometry(spark, sf):
    return X.boxes(spark, sf).select("image_id", "box_id", Q.area(c("w"), c("h")).alias("area"), Q.centre_x(c("x"), c("w")).alias("cx"), Q.centre_y(c("y"), c("h")).alias("cy"), F.round(Q.aspect(c("w"), c("h")), 6).alias("aspect"))


_IOU = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"


@query(f"WITH {X.BOXES_SQL}, p AS (SELECT a.image_id, a.box_id AS a, b.box_id AS b, {_IOU} AS s, a.w * a.h + b.w * b.h AS t FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id) SELECT image_id, a, b, round(s / (t - s), 6) AS iou FROM p WHERE s / (t - s) >= 0.05")
def box_iou_pairs(spark, sf):
    return B.overlapping_pairs(X.boxes(spark, sf), 0.05).withColumn("iou", F.round("iou", 6))


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id FROM boxes WHERE least(w, h) >= 30 AND greatest(w, h) <= 60 AND w / h BETWEEN 0.5 AND 2 AND confidence >= 0.95")
def box_filter(spark, sf):
    return B.plausible(X.boxes(spark, sf), 30, 60, 0.95).select("image_id", "box_id")


@query(f"WITH {X.BOXES_SQL}, e AS (SELECT *, CAST(trunc(w * 1.5) AS INTEGER) AS nw, CAST(trunc(h * 1.5) AS INTEGER) AS nh FROM boxes) SELECT image_id, box_id, CAST(x - (nw - w) // 2 AS INTEGER) AS x, CAST(y - (nh - h) // 2 AS INTEGER) AS y, nw AS w, nh AS h FROM e")
def box_expand(spark, sf):
    return X.boxes(spark, sf).select("image_id", "box_id", Q.expand(*_xywh(), 1.5).alias("e")).select("image_id", "box_id", "e.*")


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id, 100 >= x AND 100 < x + w AND 50 >= y AND 50 < y + h AS has_point, x <= 100 AND y <= 50 AND x + w >= 105 AND y + h >= 55 AS has_box FROM boxes")
def box_contains(spark, sf):
    p = F.lit(100), F.lit(50)
    return X.boxes(spark, sf).select("image_id", "box_id", Q.contains_point(*_xywh(), *p).alias("has_point"), Q.contains_box(*_xywh(), *p, F.lit(5), F.lit(5)).alias("has_box"))


@query(f"WITH {X.BOXES_SQL}, g AS (SELECT image_id, CAST(x // 100 AS INTEGER) AS grp, count(*) AS members, CAST(sum(x) // count(*) AS INTEGER) AS x, CAST(sum(y) // count(*) AS INTEGER) AS y, CAST(sum(w) // count(*) AS INTEGER) AS w, CAST(sum(h) // count(*) AS INTEGER) AS h FROM boxes GROUP BY image_id, x // 100), t AS (SELECT *, round(members / max(members) OVER (PARTITION BY image_id), 6) AS confidence FROM g) SELECT * FROM t WHERE members >= 2")
def box_group_average(spark, sf):
    return B.group_average(X.boxes(spark, sf).withColumn("grp", F.floor(c("x") / 100).cast("int")), "grp", 2).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, box_id) AS rn FROM boxes) WHERE rn = 1")
def box_largest(spark, sf):
    return B.largest(X.boxes(spark, sf)).select("image_id", "box_id", (c("w") * c("h")).alias("area"))


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS rn FROM boxes) WHERE rn = 1")
def box_most_confident(spark, sf):
    return B.most_confident(X.boxes(spark, sf)).select("image_id", "box_id", "confidence")


GREEDY_SQL = f"""
WITH RECURSIVE {X.BOXES_SQL}, p AS (
  SELECT a.image_id, a.box_id AS a, b.box_id AS b, {_IOU} AS s, a.w * a.h + b.w * b.h AS t
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id
), near AS (
  SELECT image_id, a AS box_id, list(b) AS others FROM p WHERE s / (t - s) > 0.3 GROUP BY image_id, a
), turns AS (
  SELECT image_id, box_id, coalesce(others, []) AS others FROM boxes LEFT JOIN near USING (image_id, box_id)
), walk AS (
  SELECT image_id, box_id, others AS used, others AS taken, TRUE AS kept FROM turns WHERE box_id = 1
  UNION ALL
  SELECT image_id, box_id, CASE WHEN gone THEN used ELSE list_concat(used, others) END,
         list_filter(others, lambda o: NOT gone AND NOT list_contains(used, o)), NOT gone
  FROM (
    SELECT turns.image_id, turns.box_id, turns.others, walk.used, list_contains(walk.used, turns.box_id) AS gone
    FROM walk JOIN turns ON turns.image_id = walk.image_id AND turns.box_id = walk.box_id + 1
  )
), best AS (
  SELECT k.image_id, k.box_id, max(b.confidence) AS confidence
  FROM (SELECT image_id, box_id, unnest(list_append(taken, box_id)) AS member FROM walk WHERE kept) k
  JOIN boxes b ON b.image_id = k.image_id AND b.box_id = k.member
  GROUP BY k.image_id, k.box_id
), sizes AS (
  SELECT image_id, count(*) AS n FROM boxes GROUP BY image_id
)
SELECT image_id, box_id, x, y, w, h,
       CASE WHEN n = 1 THEN best.confidence ELSE least(CAST(1 AS DOUBLE), CAST(1.1 AS DOUBLE) * best.confidence) END AS confidence
FROM boxes JOIN best USING (image_id, box_id) JOIN sizes USING (image_id)
"""


@query(GREEDY_SQL)
def box_greedy_merge(spark, sf):
    return B.merged_greedily(X.boxes(spark, sf))


_GROUPS_SQL = f"""
WITH RECURSIVE {X.BOXES_SQL}, p AS (
  SELECT a.image_id, a.box_id AS a, b.box_id AS b, {_IOU} AS s, a.w * a.h + b.w * b.h AS t
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id
), linked AS (
  SELECT image_id, a, b FROM p WHERE s / (t - s) >= 0.1
), reach AS (
  SELECT image_id, box_id, box_id AS other FROM boxes
  UNION
  SELECT reach.image_id, reach.box_id, linked.b FROM reach JOIN linked ON linked.image_id = reach.image_id AND linked.a = reach.other
), first AS (
  SELECT image_id, box_id, min(other) AS head FROM reach GROUP BY image_id, box_id
), merged AS (
  SELECT image_id, head AS box_id, sum(x) // count(*) AS x, sum(y) // count(*) AS y, sum(w) // count(*) AS w, sum(h) // count(*) AS h, count(*) AS n
  FROM boxes JOIN first USING (image_id, box_id) GROUP BY image_id, head
)
SELECT image_id, box_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h,
       CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY image_id) AS confidence
FROM merged
"""


@query(_GROUPS_SQL)
def box_merge_detections(spark, sf):
    return B.merged_detections(X.boxes(spark, sf), 0.1, 1)


@query("SELECT image_id, box_id, x, y, w, h, confidence FROM (" + _GROUPS_SQL.replace(">= 0.1", ">= 0.2").replace("AS confidence\nFROM merged", "AS confidence, n\nFROM merged").strip().replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ") WHERE n >= 2")
def box_merge_members(spark, sf):
    """Groups of two and more, linked by an overlap of a fifth."""
    return B.merged_detections(X.boxes(spark, sf), 0.2, 2)


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id, round(sqrt(w * w + h * h), 6) AS eyes, round(degrees(atan2(CAST(h AS DOUBLE), CAST(w AS DOUBLE))), 6) AS angle, CAST((x + x + w) // 2 AS INTEGER) AS mid, round(sqrt(w * w + h * h) / 60.0, 6) AS scale FROM boxes")
def landmark_geometry(spark, sf):
    p = c("x"), c("y"), c("x") + c("w"), c("y") + c("h")
    return X.boxes(spark, sf).select("image_id", "box_id", F.round(Q.eye_distance(*p), 6).alias("eyes"), F.round(Q.face_angle(*p), 6).alias("angle"), Q.midpoint(p[0], p[2]).alias("mid"), F.round(Q.face_scale(*p, 60.0), 6).alias("scale"))


# -------------------------------------------------------------------- colours
@query(f"WITH {X.RGB_SQL} SELECT CAST((r + g + b) // 3 AS INTEGER) AS gray, count(*) AS n FROM rgb GROUP BY gray")
def pixel_gray_mean(spark, sf):
    return X.rgb(spark, sf).groupBy(K.gray_mean(c("r"), c("g"), c("b")).alias("gray")).agg(F.count("*").alias("n"))


@query(f"WITH {X.RGB_SQL} SELECT CAST((299 * r + 587 * g + 114 * b) // 1000 AS INTEGER) AS luma, count(*) AS n FROM rgb GROUP BY luma")
def pixel_gray_luma(spark, sf):
    return X.rgb(spark, sf).groupBy(K.gray_luma(c("r"), c("g"), c("b")).alias("luma")).agg(F.count("*").alias("n"))


_HSV = "hsv AS (SELECT r, g, b, v, CASE WHEN d = 0 THEN 0 WHEN rf = v THEN ((gf - bf) / d + CASE WHEN gf < bf THEN 6 ELSE 0 END) / 6 WHEN gf = v THEN ((bf - rf) / d + 2) / 6 ELSE ((rf - gf) / d + 4) / 6 END AS h, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s FROM (SELECT *, greatest(rf, gf, bf) AS v, greatest(rf, gf, bf) - least(rf, gf, bf) AS d FROM (SELECT *, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM rgb)))"


@query(f"WITH {X.RGB_SQL}, {_HSV} SELECT DISTINCT r, g, b, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM hsv")
def pixel_hsv(spark, sf):
    own = X.rgb(spark, sf).distinct().withColumn("k", K.hsv(c("r"), c("g"), c("b")))
    return own.select("r", "g", "b", *[F.round(c("k")[n], 6).alias(n) for n in "hsv"])


_YCC = "CAST(trunc(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS INTEGER) AS y, CAST(trunc(128.0::DOUBLE - r * 0.169::DOUBLE - g * 0.331::DOUBLE + b * 0.5::DOUBLE) AS INTEGER) AS cb, CAST(trunc(128.0::DOUBLE + r * 0.5::DOUBLE - g * 0.419::DOUBLE - b * 0.081::DOUBLE) AS INTEGER) AS cr"


@query(f"WITH {X.RGB_SQL} SELECT DISTINCT r, g, b, {_YCC} FROM rgb")
def pixel_ycbcr(spark, sf):
    return X.rgb(spark, sf).distinct().withColumn("k", K.ycbcr(c("r"), c("g"), c("b"))).select("r", "g", "b", "k.*")


@query(f"WITH {X.RGB_SQL}, {_HSV}, k AS (SELECT *, {_YCC} FROM hsv) SELECT (h BETWEEN 0.0 AND 0.14 OR (h > 0.9 AND h <= 1.0)) AND s BETWEEN 0.1 AND 0.7 AND v BETWEEN 0.2 AND 0.95 AND cb BETWEEN 77 AND 127 AND cr BETWEEN 133 AND 173 AS skin, count(*) AS n FROM k GROUP BY skin")
def pixel_skin_mask(spark, sf):
    own = X.rgb(spark, sf).withColumn("k", K.hsv(c("r"), c("g"), c("b"))).withColumn("m", K.ycbcr(c("r"), c("g"), c("b")))
    skin = K.skin_hsv(c("k.h"), c("k.s"), c("k.v")) & K.skin_ycbcr(c("m.cb"), c("m.cr"))
    return own.groupBy(skin.alias("skin")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- pictures
def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


_NB = X.PIXELS_SQL + ", nb AS (SELECT *, lag(v) OVER r AS west, lead(v) OVER r AS east, lag(v) OVER d AS north, lead(v) OVER d AS south FROM pixels WINDOW r AS (PARTITION BY image_id, y ORDER BY x), d AS (PARTITION BY image_id, x ORDER BY y)), inner_ AS (SELECT * FROM nb WHERE west IS NOT NULL AND east IS NOT NULL AND north IS NOT NULL AND south IS NOT NULL)"


def _near(spark, sf):
    p = X.pixels(spark, sf).withColumns({"west": F.lag("v").over(_row()), "east": F.lead("v").over(_row())}).withColumns({"north": F.lag("v").over(_column()), "south": F.lead("v").over(_column())})
    return p.where(c("west").isNotNull() & c("east").isNotNull() & c("north").isNotNull() & c("south").isNotNull())


@query(f"WITH {X.PIXELS_SQL} SELECT image_id, round(avg(v / 255.0::DOUBLE), 6) AS brightness, round(stddev_pop(v / 255.0::DOUBLE), 6) AS contrast FROM pixels GROUP BY image_id")
def image_quality(spark, sf):
    v = c("v") / F.lit(255.0)
    return X.pixels(spark, sf).groupBy("image_id").agg(F.round(F.avg(v), 6).alias("brightness"), F.round(F.stddev_pop(v), 6).alias("contrast"))


@query(f"WITH {_NB} SELECT image_id, round(sqrt(avg((4 * v - west - east - north - south) * (4 * v - west - east - north - south))) / 255, 6) AS sharpness FROM inner_ GROUP BY image_id")
def image_sharpness(spark, sf):
    lap = 4 * c("v") - c("west") - c("east") - c("north") - c("south")
    return _near(spark, sf).groupBy("image_id").agg(F.round(F.sqrt(F.avg(lap * lap)) / 255, 6).alias("sharpness"))


@query(f"WITH {X.PIXELS_SQL}, h AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY ALL) SELECT image_id, v, n, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY v) AS BIGINT) AS cdf FROM h")
def image_histogram(spark, sf):
    h = X.pixels(spark, sf).groupBy("image_id", "v").agg(F.count("*").alias("n"))
    return h.withColumn("cdf", F.sum("n").over(Window.partitionBy("image_id").orderBy("v")))


@query(f"WITH {X.PIXELS_SQL}, h AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY ALL), k AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS cdf, sum(n) OVER (PARTITION BY image_id) AS total FROM h), l AS (SELECT *, min(cdf) OVER (PARTITION BY image_id) AS low FROM k) SELECT p.image_id, p.y, p.x, CAST(CASE WHEN total = low THEN 0 ELSE floor((cdf - low) * 255.0::DOUBLE / (total - low) + 0.5) END AS INTEGER) AS v FROM pixels p JOIN l ON p.image_id = l.image_id AND p.v = l.v")
def image_equalize(spark, sf):
    px = X.pixels(spark, sf)
    one = Window.partitionBy("image_id")
    h = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    k = h.withColumn("cdf", F.sum("n").over(one.orderBy("v"))).withColumn("total", F.sum("n").over(one))
    k = k.withColumn("low", F.min("cdf").over(one))
    new = F.when(c("total") == c("low"), 0).otherwise(F.floor((c("cdf") - c("low")) * 255.0 / F.when(c("total") == c("low"), 1).otherwise(c("total") - c("low")) + 0.5)).cast("int")
    return px.join(k.select("image_id", "v", new.alias("new")), ["image_id", "v"]).select("image_id", "y", "x", c("new").alias("v"))


@query(f"WITH {_NB} SELECT image_id, y, x, CAST(CAST(east >= v AS INT) + 4 * CAST(north >= v AS INT) + 16 * CAST(west >= v AS INT) + 64 * CAST(south >= v AS INT) AS INTEGER) AS code FROM inner_")
def lbp_axis(spark, sf):
    """The four axis bits of the local pattern."""
    bit = lambda k, w: (c(k) >= c("v")).cast("int") * w
    return _near(spark, sf).select("image_id", "y", "x", (bit("east", 1) + bit("north", 4) + bit("west", 16) + bit("south", 64)).alias("code"))


@query(f"WITH {_NB}, k AS (SELECT image_id, CAST(least(y // 4, 1) * 2 + least(x // 4, 1) AS INTEGER) AS region, CAST(CAST(east >= v AS INT) + 4 * CAST(north >= v AS INT) + 16 * CAST(west >= v AS INT) + 64 * CAST(south >= v AS INT) AS INTEGER) AS code FROM inner_), n AS (SELECT image_id, region, code, count(*) AS n FROM k GROUP BY ALL) SELECT image_id, region, code, round(n / sum(n) OVER (PARTITION BY image_id, region), 6) AS share FROM n")
def lbp_histogram(spark, sf):
    part = lambda k: F.least(F.floor(c(k) / 4), F.lit(1))
    n = lbp_axis(spark, sf).groupBy("image_id", (part("y") * 2 + part("x")).cast("int").alias("region"), "code").agg(F.count("*").alias("n"))
    return n.select("image_id", "region", "code", F.round(c("n") / F.sum("n").over(Window.partitionBy("image_id", "region")), 6).alias("share"))


@query(f"WITH {X.PIXELS_SQL}, s AS (SELECT image_id, y, x, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM pixels) SELECT image_id, y, x, CAST(sum(s) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS total FROM s")
def integral_image(spark, sf):
    s = X.pixels(spark, sf).withColumn("s", F.sum("v").over(_row()))
    return s.withColumn("total", F.sum("s").over(_column())).select("image_id", "y", "x", "total")


def _window3(p, f):
    """f over the 3 x 3 neighbourhood, clipped at the borders, as two one-dimensional passes."""
    return p.withColumn("m", f("m").over(_row().rowsBetween(-1, 1))).withColumn("m", f("m").over(_column().rowsBetween(-1, 1)))


_MASK = X.PIXELS_SQL + ", m0 AS (SELECT *, v >= 120 AS m FROM pixels), m1 AS (SELECT image_id, y, x, {f}(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM m0), m2 AS (SELECT image_id, y, x, {f}(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM m1)"


@query(f"WITH {_MASK.format(f='bool_and')} SELECT image_id, y, x, m AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AS m FROM m2")
def morph_erode(spark, sf):
    inside = c("y").between(1, X.SIDE - 2) & c("x").between(1, X.SIDE - 2)
    return _window3(X.pixels(spark, sf).withColumn("m", c("v") >= 120), F.min).select("image_id", "y", "x", (c("m") & inside).alias("m"))


@query(f"WITH {_MASK.format(f='bool_or')} SELECT image_id, y, x, m FROM m2")
def morph_dilate(spark, sf):
    return _window3(X.pixels(spark, sf).withColumn("m", c("v") >= 120), F.max).select("image_id", "y", "x", "m")
