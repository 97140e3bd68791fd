"""Queries on vectors: scalars, distances, matching, centroids and subspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import vectors as V
from likeness.operators import gallery as G, matching as M, models
from likeness.plans import fixtures as X
from likeness.plans.catalogue import query

r6 = lambda c: F.round(c, 6)
c = F.col

SUM = "list_sum(list_transform(list_zip({a}, {b}), lambda t: {e}))"
SQL_DISTANCE = {
    "euclidean": "list_distance({a}, {b})",
    "cosine": "(1 - list_cosine_similarity({a}, {b}))",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))",
    "chi_square": "list_sum(list_transform(list_zip({a}, {b}), lambda t: CASE WHEN t[1] + t[2] > 0 THEN (t[1] - t[2]) * (t[1] - t[2]) / (t[1] + t[2]) ELSE 0 END))",
}
SHIFT = "list_transform({v}, lambda x: x + 1)"


@query(f"WITH {X.VECTORS_SQL} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vectors")
def vec_norm(spark, sf):
    return X.vectors(spark, sf).select("vec_id", r6(V.norm(c("v"))).alias("norm"))


@query(f"WITH {X.VECTORS_SQL} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS total FROM vectors")
def vec_normalize_sum(spark, sf):
    return X.vectors(spark, sf).select("vec_id", r6(V._sum(V.normalize(c("v")))).alias("total"))


@query(f"WITH {X.PAIRS_SQL} SELECT vec_id, round(list_inner_product(v, u), 6) AS dot FROM pairs")
def vec_dot_pairs(spark, sf):
    return X.pairs(spark, sf).select("vec_id", r6(V.dot(c("v"), c("u"))).alias("dot"))


@query(f"WITH {X.PAIRS_SQL} SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda t: 2 * (t[1] + t[2]) - (t[1] - t[2]))), 6) AS mixed FROM pairs")
def vec_arithmetic(spark, sf):
    a, b = c("v"), c("u")
    return X.pairs(spark, sf).select("vec_id", r6(V._sum(V.subtract(V.scale(V.add(a, b), 2.0), V.subtract(a, b)))).alias("mixed"))


@query(f"WITH {X.PAIRS_SQL} SELECT vec_id, len(v) = len(u) AND identity = other AS compatible FROM pairs")
def vec_compatible(spark, sf):
    return X.pairs(spark, sf).select("vec_id", V.compatible(c("v"), c("identity"), c("u"), c("other")).alias("compatible"))


def _register_distances() -> None:
    for metric, sql in SQL_DISTANCE.items():
        shift = metric == "chi_square"
        a, b = (SHIFT.format(v="v"), SHIFT.format(v="u")) if shift else ("v", "u")

        def pair(spark, sf, metric=metric, shift=shift):
            v, u = (F.transform(c(x), lambda e: e + 1) if shift else c(x) for x in "vu")
            return X.pairs(spark, sf).select("vec_id", r6(V.checked(v, u, V.distance(metric, v, u))).alias("distance"))

        query(f"WITH {X.PAIRS_SQL} SELECT vec_id, round({sql.format(a=a, b=b)}, 6) AS distance FROM pairs", f"dist_{metric}")(pair)

        scale = {"euclidean": 1.0, "manhattan": 8.0}.get(metric)
        threshold = 0.35
        pv, gv = (SHIFT.format(v="p.v"), SHIFT.format(v="g.v")) if shift else ("p.v", "g.v")
        by = scale or V.SCALES[metric]

        def knn(spark, sf, metric=metric, shift=shift, scale=scale):
            p, g = X.probes(spark, sf), X.gallery(spark, sf)
            if shift:
                p, g = (t.withColumn("v", F.transform("v", lambda e: e + 1)) for t in (p, g))
            got = M.classify(M.nearest_by_identity(p, g, metric, keep=5), threshold, metric, 5, scale)
            return got.select("probe_id", "status", "identity", r6("confidence").alias("confidence"), r6("distance").alias("distance"), F.array_join(F.transform("alternatives", lambda x: x["identity"]), ",").alias("alternatives"))

        query(
            f"""WITH {X.GALLERY_SQL}, d AS (SELECT p.probe_id, g.identity, min({sql.format(a=pv, b=gv)}) AS distance FROM probes p CROSS JOIN gallery g GROUP BY ALL),
ranked AS (SELECT *, exp(-distance / {by}) AS confidence, row_number() OVER (PARTITION BY probe_id ORDER BY distance, identity) AS rn FROM d),
best AS (SELECT *, confidence >= {threshold} AS ok FROM ranked WHERE rn = 1)
SELECT b.probe_id, CASE WHEN ok THEN 'RECOGNIZED' ELSE 'UNKNOWN' END AS status, CASE WHEN ok THEN b.identity END AS identity,
  round(CASE WHEN ok THEN b.confidence ELSE 0 END, 6) AS confidence, round(CASE WHEN ok THEN b.distance END, 6) AS distance,
  (SELECT string_agg(r.identity, ',' ORDER BY r.rn) FROM ranked r WHERE r.probe_id = b.probe_id AND CASE WHEN b.ok THEN r.rn BETWEEN 2 AND 5 ELSE r.rn <= 5 END) AS alternatives
FROM best b""",
            f"knn_classify_{metric}",
        )(knn)


_register_distances()


@query(
    f"""WITH {X.GALLERY_SQL}, m AS (SELECT identity, p, avg(x) AS x FROM (SELECT identity, unnest(range(len(v))) AS p, unnest(v) AS x FROM gallery) GROUP BY ALL),
cent AS (SELECT identity, list(x ORDER BY p) AS v FROM m GROUP BY identity),
d AS (SELECT p.probe_id, c.identity, list_distance(p.v, c.v) AS distance FROM probes p CROSS JOIN cent c)
SELECT probe_id, identity, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, identity) AS rn FROM d) WHERE rn = 1"""
)
def knn_centroid(spark, sf):
    cent = M.centroids(X.gallery(spark, sf))
    got = M.top_matches(M.nearest_by_identity(X.probes(spark, sf), cent, keep=1), 1, 0.0)
    return got.select("probe_id", "identity", r6("distance").alias("distance"))


@query(
    f"""WITH {X.GALLERY_SQL}, d AS (SELECT p.probe_id, g.identity, min(1 - list_cosine_similarity(p.v, g.v)) AS distance FROM probes p CROSS JOIN gallery g GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY distance, identity) AS INTEGER) AS rn, min(distance) OVER (PARTITION BY probe_id) AS best FROM d)
SELECT probe_id, rn, identity, round(distance, 6) AS distance, round(exp(-distance / 0.5), 6) AS confidence, CASE WHEN exp(-best / 0.5) < 0.35 THEN 'UNKNOWN' ELSE 'RECOGNIZED' END AS status FROM r WHERE rn <= 3"""
)
def knn_top_matches(spark, sf):
    got = M.top_matches(M.nearest_by_identity(X.probes(spark, sf), X.gallery(spark, sf), "cosine", keep=3), 3, 0.35, "cosine")
    return got.select("probe_id", "rn", "identity", r6("distance").alias("distance"), r6("confidence").alias("confidence"), "status")


@query(
    f"""WITH {X.GALLERY_SQL}, d AS (SELECT p.probe_id, g.identity, min(1 - list_cosine_similarity(p.v, g.v)) AS distance FROM probes p CROSS JOIN gallery g GROUP BY ALL),
r AS (SELECT *, exp(-distance / 0.5) AS confidence, row_number() OVER (PARTITION BY probe_id ORDER BY distance, identity) AS rn FROM d)
SELECT probe_id, string_agg(identity, ',' ORDER BY rn) AS names FROM r WHERE rn <= 3 AND confidence >= 0.3 GROUP BY probe_id"""
)
def knn_alternatives_floor(spark, sf):
    """The first three matches, then those of enough confidence."""
    d = M.nearest_by_identity(X.probes(spark, sf), X.gallery(spark, sf), "cosine", keep=8)
    alts = M.top_matches(d, 8, 0.0, "cosine").groupBy("probe_id").agg(F.collect_list(F.struct("confidence", "identity")).alias("a"))
    names = F.transform(M.top_alternatives(c("a"), 3, 0.3), lambda x: x["identity"])
    return alts.select("probe_id", F.array_join(names, ",").alias("names")).where(c("names") != "")


@query(f"WITH {X.VECTORS_SQL} SELECT identity, CAST(p AS INTEGER) AS p, round(avg(x), 6) AS x FROM (SELECT identity, unnest(range(len(v))) AS p, unnest(v) AS x FROM vectors) GROUP BY ALL")
def identity_means(spark, sf):
    """The mean of all vectors of each identity; nothing is held out."""
    return M.centroids(X.vectors(spark, sf)).select("identity", F.posexplode("v").alias("p", "x")).withColumn("x", r6("x"))


@query("SELECT l_suppkey, l_orderkey, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey) AS rn FROM lineitem) WHERE rn = 1")
def identity_best_sample(spark, sf):
    return G.best_sample(X.table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", "l_discount")


@query("SELECT l_suppkey, round(avg(l_discount), 6) AS avg_quality FROM lineitem GROUP BY l_suppkey")
def identity_avg_quality(spark, sf):
    return G.average_quality(X.table(spark, sf, "lineitem"), "l_suppkey", "l_discount").withColumn("avg_quality", r6("avg_quality"))


@query(f"WITH {X.VECTORS_SQL} SELECT CAST(count(*) AS BIGINT) AS n_images, count(DISTINCT identity) AS n_classes, CAST(count(*) // greatest(1, count(DISTINCT identity)) AS BIGINT) AS images_per_class FROM vectors")
def dataset_info(spark, sf):
    return G.dataset_info(X.vectors(spark, sf), "identity")


# ------------------------------------------------------------------ subspaces
_LONG = X.VECTORS_SQL + ", e AS (SELECT vec_id, identity, unnest(range(len(v))) AS p, unnest(v) AS x FROM vectors)"


@query(f"WITH {_LONG} SELECT CAST(p AS INTEGER) AS p, round(avg(x), 6) AS m FROM e GROUP BY p")
def pca_mean(spark, sf):
    return models.mean_vector(X.vectors(spark, sf)).select("p", r6("m").alias("m"))


def _cells(spark, m):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "i int, j int, s double").withColumn("s", F.round("s", 5))


@query(f"WITH {_LONG}, m AS (SELECT p, avg(x) AS m FROM e GROUP BY p), z AS (SELECT vec_id, e.p, x - m AS z FROM e JOIN m ON e.p = m.p) SELECT CAST(a.p AS INTEGER) AS i, CAST(b.p AS INTEGER) AS j, round(sum(a.z * b.z), 5) AS s FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY ALL")
def pca_scatter(spark, sf):
    _, within, between, _ = models.scatter(models.moments(X.vectors(spark, sf)))
    return _cells(spark, within + between)


@query(f"WITH {_LONG}, m AS (SELECT identity, p, avg(x) AS m FROM e GROUP BY ALL), z AS (SELECT vec_id, e.p, x - m AS z FROM e JOIN m ON e.p = m.p AND e.identity = m.identity) SELECT CAST(a.p AS INTEGER) AS i, CAST(b.p AS INTEGER) AS j, round(sum(a.z * b.z), 5) AS s FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY ALL")
def lda_within(spark, sf):
    return _cells(spark, models.scatter(models.moments(X.vectors(spark, sf), "v", "identity"))[1])


@query(f"WITH {_LONG}, m AS (SELECT identity, p, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT p, avg(x) AS g FROM e GROUP BY p), z AS (SELECT identity, m.p, m - g AS z, n FROM m JOIN g ON m.p = g.p) SELECT CAST(a.p AS INTEGER) AS i, CAST(b.p AS INTEGER) AS j, round(sum(a.n * a.z * b.z), 5) AS s FROM z a JOIN z b ON a.identity = b.identity GROUP BY ALL")
def lda_between(spark, sf):
    return _cells(spark, models.scatter(models.moments(X.vectors(spark, sf), "v", "identity"))[2])


def _eigen(source: str, k: int, squarings: int = 17) -> str:
    """CTEs on a matrix ``a`` (rows of ``source``): ``axes`` (k, value, v) of its first eigenvectors by squaring its powers and deflating.

    The normed power of a matrix tends to the projector on its first eigenvector;
    the matrix less its product with that projector has the others left. The
    component of largest size is positive.
    """
    return f"""
it AS (
  SELECT 1 AS k, 0 AS s, a, a AS p FROM {source}
  UNION ALL
  SELECT CASE WHEN s < {squarings} THEN k ELSE k + 1 END, CASE WHEN s < {squarings} THEN s + 1 ELSE 0 END,
         CASE WHEN s < {squarings} THEN a ELSE less END, CASE WHEN s < {squarings} THEN list_transform(q, lambda r: list_transform(r, lambda x: x / t)) ELSE less END
  FROM (
    SELECT k, s, a, q, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS t,
           CASE WHEN s = {squarings} THEN list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: a[i][j] - q[i][j])) END AS less
    FROM (
      SELECT k, s, a, list_transform(CASE WHEN s = {squarings} THEN a ELSE p END, lambda r: list_transform(pt, lambda col: list_dot_product(r, col))) AS q
      FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda j: list_transform(p, lambda r: r[j])) AS pt FROM it) WHERE k <= {k}
    )
  )
), found AS (
  SELECT k, list_sum(list_transform(range(1, len(a) + 1), lambda i: list_dot_product(a[i], list_transform(p, lambda r: r[i])))) AS value,
         list_transform(p, lambda r: r[list_position(diagonal, list_max(diagonal))]) AS u
  FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda i: p[i][i]) AS diagonal FROM it WHERE s = {squarings} AND k <= {k})
), axes AS (
  SELECT k, value, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u)) * sign(u[list_position(sizes, list_max(sizes))])) AS v
  FROM (SELECT *, list_transform(u, lambda x: abs(x)) AS sizes FROM found)
)"""


_MATRIX = "(SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS r FROM {cells} GROUP BY i))"
_ALL_SQL = _LONG + ", m AS (SELECT p, avg(x) AS m FROM e GROUP BY p), z AS (SELECT vec_id, e.p, x - m AS z FROM e JOIN m ON e.p = m.p), total AS (SELECT a.p AS i, b.p AS j, sum(a.z * b.z) AS s FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY ALL), centred AS (SELECT vec_id, list(z ORDER BY p) AS z FROM z GROUP BY vec_id)"
_FEATURES = """, raw AS (
  SELECT vec_id, list(list_dot_product(z, v) ORDER BY k) AS f FROM centred, axes GROUP BY vec_id
)
SELECT vec_id, list_transform(f, lambda x: round(x / CASE WHEN list_dot_product(f, f) = 0 THEN 1 ELSE sqrt(list_dot_product(f, f)) END, 5) + 0.0) AS features FROM raw"""


@query(f"WITH RECURSIVE {_ALL_SQL}, {_eigen(_MATRIX.format(cells='total'), 10)}, t AS (SELECT sum(s) AS whole FROM total WHERE i = j) SELECT CAST(k - 1 AS INTEGER) AS i, round(value, 6) AS value, round(value / whole, 6) AS ratio, round(sum(value / whole) OVER (ORDER BY k), 6) AS cumulative FROM axes, t")
def pca_explained(spark, sf):
    m = models.fit_pca(X.vectors(spark, sf), 10)
    rows = spark.createDataFrame([(i, float(v), float(q), float(t)) for i, (v, q, t) in enumerate(zip(m.values, m.ratio, models.cumulative(m)))], "i int, value double, ratio double, cumulative double")
    return rows.withColumns({k: F.round(k, 6) for k in ("value", "ratio", "cumulative")})


@query(f"WITH RECURSIVE {_ALL_SQL}, {_eigen(_MATRIX.format(cells='total'), 10)}{_FEATURES}")
def pca_project(spark, sf):
    v = X.vectors(spark, sf)
    return models.fit_pca(v, 10).transform(v).select("vec_id", F.transform("features", lambda x: F.round(x, 5)).alias("features"))


_INVERSE = """
ridge AS (
  SELECT list(r ORDER BY i) AS w FROM (SELECT i, list(s + CASE WHEN i = j THEN 1e-6 ELSE 0 END ORDER BY j) AS r FROM inside GROUP BY i)
), inv AS (
  SELECT 0 AS n, w, list_transform(w, lambda r: list_transform(r, lambda x: x / pow(list_max(list_transform(w, lambda q: list_sum(list_transform(q, lambda y: abs(y))))), 2))) AS x FROM ridge
  UNION ALL
  SELECT n + 1, w, list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) + 1), lambda j: 2 * x[i][j] - xwx[i][j]))
  FROM (
    SELECT n, w, x, list_transform(list_transform(x, lambda r: list_transform(w, lambda q: list_dot_product(r, q))), lambda r: list_transform(list_transform(range(1, len(x) + 1), lambda j: list_transform(x, lambda y: y[j])), lambda q: list_dot_product(r, q))) AS xwx
    FROM inv WHERE n < 30
  )
), ratio AS (
  SELECT list_transform(x, lambda r: list_transform(b, lambda q: list_dot_product(r, q))) AS a FROM inv, (SELECT list(r ORDER BY i) AS b FROM (SELECT i, list(s ORDER BY j) AS r FROM outside GROUP BY i)) WHERE n = 30
)"""
_LABELS_SQL = _ALL_SQL + """, own AS (SELECT identity, p, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), y AS (SELECT vec_id, e.p, x - m AS z FROM e JOIN own ON e.p = own.p AND e.identity = own.identity),
inside AS (SELECT a.p AS i, b.p AS j, sum(a.z * b.z) AS s FROM y a JOIN y b ON a.vec_id = b.vec_id GROUP BY ALL),
outside AS (SELECT t.i, t.j, t.s - w.s AS s FROM total t JOIN inside w ON t.i = w.i AND t.j = w.j)"""


@query(f"WITH RECURSIVE {_LABELS_SQL}, {_INVERSE}, {_eigen('ratio', 9)}{_FEATURES}")
def lda_project(spark, sf):
    v = X.vectors(spark, sf)
    return models.fit_lda(v, "identity", 9).transform(v).select("vec_id", F.transform("features", lambda x: F.round(x, 5)).alias("features"))


@query(f"""WITH RECURSIVE {_ALL_SQL}, {_eigen(_MATRIX.format(cells='total'), 10)}, middle AS (SELECT list(m ORDER BY p) AS m FROM m), f AS (
  SELECT vec_id, k, list_dot_product(z, v) AS f, v FROM centred, axes
), parts AS (
  SELECT vec_id, unnest(range(1, len(v) + 1)) AS p, unnest(v) * f AS x FROM f
)
SELECT vec_id, CAST(p - 1 AS INTEGER) AS p, round(sum(x) + any_value(middle.m[p]), 5) + 0.0 AS x FROM parts, middle GROUP BY vec_id, p""")
def pca_reconstruct(spark, sf):
    """Every vector from its ten components."""
    v = X.vectors(spark, sf)
    model = models.fit_pca(v, 10, normalise=False)
    return models.restored(model.transform(v), model).select("vec_id", F.posexplode("restored").alias("p", "x")).select("vec_id", "p", F.round("x", 5).alias("x"))
