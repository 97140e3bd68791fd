"""Queries on gates, flags, names and small lookups: what decides whether a sample or a result is used."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import text as T, vectors as V
from likeness.operators import boxes as B, gallery as G, matching as M, order as O
from likeness.plans import fixtures as X
from likeness.plans.catalogue import query
from likeness.runtime import table

c = F.col


@query("SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality >= 0.5")
def quality_filter(spark, sf):
    """The samples that meet a quality threshold."""
    own = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", c("quality").cast("double").alias("quality")), "doc_id")
    return own.where(G.meets_quality(c("quality"), 0.5))


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'RECOGNIZED' WHEN 'F' THEN 'UNKNOWN' ELSE 'ERROR' END"


@query(f"SELECT o_orderkey, s = 'RECOGNIZED' AS recognized, s IN ('RECOGNIZED', 'UNKNOWN') AS detected, s = 'ERROR' AS failed FROM (SELECT o_orderkey, {_STATUS} AS s FROM orders)")
def status_flags(spark, sf):
    status = F.when(c("o_orderstatus") == "O", "RECOGNIZED").when(c("o_orderstatus") == "F", "UNKNOWN").otherwise("ERROR")
    return table(spark, sf, "orders").select("o_orderkey", *[f.alias(n) for n, f in M.status_flags(status).items()])


@query("SELECT doc_id, CASE WHEN n = 0 THEN 'Image file is required' WHEN kind IS NULL OR NOT starts_with(kind, 'image/') THEN 'File must be an image' WHEN n > 10485760 THEN 'Image file is too large (max 10MB)' END AS error FROM (SELECT doc_id, CAST(n_chars AS BIGINT) * (doc_id % 3) * 5000 AS n, CASE lang WHEN 'en' THEN 'image/png' WHEN 'de' THEN 'image/jpeg' WHEN 'fr' THEN 'text/plain' END AS kind FROM documents)")
def upload_checks(spark, sf):
    kind = F.when(c("lang") == "en", "image/png").when(c("lang") == "de", "image/jpeg").when(c("lang") == "fr", "text/plain")
    size = c("n_chars").cast("long") * (c("doc_id") % 3) * 5000
    return table(spark, sf, "documents").select("doc_id", T.upload_error(kind, size).alias("error"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' WHEN 3 THEN 'BMP' ELSE 'UNKNOWN' END AS format FROM documents")
def image_formats(spark, sf):
    name = F.concat(F.lit("/in/"), "source", F.lit("."), F.element_at(F.array(*map(F.lit, ("JPG", "jpeg", "png", "Bmp", "pgm"))), (c("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", T.image_format(name).alias("format"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, list_extract(string_split(url, '/'), -2) AS folder FROM pages")
def path_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.base_name(c("url")).alias("name"), T.parent_name(c("url")).alias("folder"))


_MESSAGE = "p_name || ': ' || CASE p_size % 8 WHEN 0 THEN 'No face found' WHEN 1 THEN 'Multiple faces in view' WHEN 2 THEN 'poor QUALITY' WHEN 3 THEN 'too small' WHEN 4 THEN 'bad dimension' WHEN 5 THEN 'file too large' WHEN 6 THEN 'unknown format' ELSE 'something else' END"


@query(f"SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'FACE_NOT_DETECTED' WHEN 1 THEN 'MULTIPLE_FACES' WHEN 2 THEN 'POOR_QUALITY' WHEN 3 THEN 'IMAGE_TOO_SMALL' WHEN 4 THEN 'IMAGE_TOO_SMALL' WHEN 5 THEN 'IMAGE_TOO_LARGE' WHEN 6 THEN 'INVALID_IMAGE_FORMAT' ELSE 'VALIDATION_ERROR' END AS code, length({_MESSAGE}) AS n FROM part")
def error_codes_of_messages(spark, sf):
    """Every branch of the message rules."""
    phrases = ("No face found", "Multiple faces in view", "poor QUALITY", "too small", "bad dimension", "file too large", "unknown format", "something else")
    message = F.concat("p_name", F.lit(": "), F.element_at(F.array(*map(F.lit, phrases)), (c("p_size") % 8 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", T.error_code(message).alias("code"), F.length(message).cast("long").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'none' END AS name, CAST(n_regionkey AS VARCHAR) AS region, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS entries FROM nation")
def metadata_merge(spark, sf):
    base = F.create_map(F.lit("name"), F.lit("none"), F.lit("region"), c("n_regionkey").cast("string"))
    more = F.create_map(F.lit("name"), c("n_name"), F.lit("extra"), F.lit("x"))
    both = F.when(c("n_nationkey") % 2 == 0, T.merged_map(base, more)).otherwise(base)
    return table(spark, sf, "nation").withColumn("m", both).select("n_nationkey", F.element_at("m", "name").alias("name"), F.element_at("m", "region").alias("region"), F.size("m").alias("entries"))


@query(f"WITH {X.PIXELS_SQL} SELECT image_id, CAST(sum(v) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6) AS BIGINT) AS total FROM pixels GROUP BY image_id")
def rectangle_sum(spark, sf):
    """The sum over a 6 x 4 box at (1, 2), from four corners of the summed table."""
    from likeness.plans import pictures

    at = {(1, 0): 1, (5, 0): -1, (1, 6): -1, (5, 6): 1}
    total = pictures.integral_image(spark, sf)
    sign = F.lit(0)
    for (y, x), k in at.items():
        sign = F.when((c("y") == y) & (c("x") == x), k).otherwise(sign)
    return total.groupBy("image_id").agg(F.sum(sign * c("total")).alias("total"))


@query(f"WITH {X.PAIRS_SQL}, s AS (SELECT vec_id, v, CASE WHEN vec_id % 2 = 1 THEN list_slice(u, 1, len(u) - 1) ELSE u END AS u FROM pairs) SELECT vec_id, CASE WHEN len(v) = len(u) THEN 'fits' ELSE 'differs' END AS guard, CASE WHEN len(v) = len(u) THEN round(list_sum(list_transform(list_zip(v, u), lambda t: t[1] * t[2])), 6) END AS dot FROM s")
def dimension_guard(spark, sf):
    """Vectors of another length are never compared: every second one is cut short here. The guard raises for those that reach it."""
    short = F.when(c("vec_id") % 2 == 1, F.slice("u", 1, F.size("u") - 1)).otherwise(c("u"))
    own = X.pairs(spark, sf).select("vec_id", "v", short.alias("u"))
    fits = V.compatible(c("v"), F.lit(""), c("u"), F.lit(""))
    return own.select("vec_id", F.when(fits, "fits").otherwise("differs").alias("guard"), F.round(F.when(fits, V.checked(c("v"), c("u"), V.dot(c("v"), c("u")))), 6).alias("dot"))


@query(f"WITH {X.BOXES_SQL} SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, w * h DESC, box_id) AS BIGINT) AS place FROM boxes")
def face_order(spark, sf):
    return B.placed(X.boxes(spark, sf)).select("image_id", "box_id", "place")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY c_nationkey LIMIT 5)")
def limit_identities(spark, sf):
    return O.first_groups(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)


@query("SELECT o.o_orderkey, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def sample_identity(spark, sf):
    return G.identity_of(table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("identity")), table(spark, sf, "customer").select(c("c_custkey").alias("identity"), c("c_name").alias("name"))).select("o_orderkey", "name")


@query(f"WITH {X.GALLERY_SQL}, d AS (SELECT p.probe_id, min(list_distance(p.v, g.v)) AS d FROM probes p LEFT JOIN gallery g ON g.identity = p.actual AND p.probe_id % 3 <> 0 GROUP BY p.probe_id) SELECT probe_id, CASE WHEN d IS NULL THEN 1.7976931348623157e308 ELSE round(d, 6) END AS distance, d IS NULL AS missing FROM d")
def missing_distance(spark, sf):
    """Probes without a match have the largest double as their distance."""
    g, p = X.gallery(spark, sf), X.probes(spark, sf)
    d = M.nearest_of_own(p.where(c("probe_id") % 3 != 0), g.select(c("identity").alias("actual"), "v"), "actual").withColumnRenamed("distance", "d")
    return p.select("probe_id").join(d, "probe_id", "left").select("probe_id", M.known_distance(F.round("d", 6)).alias("distance"), c("d").isNull().alias("missing"))


@query(f"WITH {X.VECTORS_SQL}, n AS (SELECT a.vec_id, a.identity AS actual, first(b.identity ORDER BY list_distance(a.v, b.v), b.identity) AS predicted FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.identity) SELECT actual, count(*) AS n, count(*) FILTER (actual = predicted) AS correct FROM n GROUP BY actual")
def cv_leave_one_out(spark, sf):
    """Each sample by all the others."""
    own = X.vectors(spark, sf)
    found = M.leave_one_out(own, "vec_id", "identity", "v", "euclidean")
    return found.groupBy("actual").agg(F.count("*").alias("n"), F.count_if(c("actual") == c("predicted")).alias("correct"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def time_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.stamp(c("ts")).alias("stamp"))


@query("SELECT p_partkey, printf('%.2f%%', 100.0 * p_size / 50) AS percent, printf('%.4f', CAST(p_retailprice AS DOUBLE)) AS fixed FROM part")
def number_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.percent(c("p_size") / 50).alias("percent"), T.fixed(c("p_retailprice").cast("double"), 4).alias("fixed"))
