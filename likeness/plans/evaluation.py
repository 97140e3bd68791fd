"""Queries on splits, predictions, metrics, curves and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions.vectors import confidence
from likeness.operators import curves as C, matching as M, metrics as E, order as O
from likeness.plans import fixtures as X
from likeness.plans.catalogue import query

c = F.col
SEED, T = 42, 0.3


def r6(df, *cols):
    return df.withColumns({k: F.round(k, 6) for k in cols})


# --------------------------------------------------------------------- splits
_ORD = X.VECTORS_SQL + f", o AS (SELECT vec_id, identity, v, row_number() OVER (ORDER BY md5(concat(vec_id, ':{SEED}')), vec_id) AS rn, count(*) OVER () AS cnt FROM vectors)"
_STRAT = X.VECTORS_SQL + f", o AS (SELECT vec_id, identity, v, row_number() OVER (PARTITION BY identity ORDER BY md5(concat(vec_id, ':{SEED}')), vec_id) AS rn, count(*) OVER (PARTITION BY identity) AS cnt FROM vectors)"
_FOLD = "CAST(CASE WHEN cnt < 5 THEN 4 ELSE least((rn - 1) // greatest(cnt // 5, 1), 4) END AS INTEGER)"


@query(f"WITH {_ORD} SELECT vec_id, rn <= floor(cnt * 0.7) AS is_train FROM o")
def split_holdout(spark, sf):
    return O.holdout(X.vectors(spark, sf), "vec_id", 0.7, SEED).select("vec_id", "is_train")


@query(f"WITH {_ORD} SELECT vec_id, {_FOLD} AS fold FROM o")
def split_kfold(spark, sf):
    return O.k_fold(X.vectors(spark, sf), "vec_id", 5, SEED).select("vec_id", "fold")


@query(f"WITH {_STRAT} SELECT vec_id, {_FOLD} AS fold FROM o")
def split_stratified(spark, sf):
    return O.stratified_k_fold(X.vectors(spark, sf), "vec_id", "identity", 5, SEED).select("vec_id", "fold")


@query(f"WITH {_STRAT} SELECT vec_id, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM o")
def split_round_robin(spark, sf):
    return O.round_robin(X.vectors(spark, sf), "vec_id", "identity", 5, SEED).select("vec_id", "fold")


@query(f"WITH {_STRAT} SELECT vec_id, rn - 1 = 7 % cnt AS is_test FROM o")
def split_leave_one_out(spark, sf):
    return O.leave_one_out(X.vectors(spark, sf), "vec_id", "identity", 7, SEED).select("vec_id", "is_test")


@query(f"WITH {_STRAT} SELECT vec_id, CAST(CASE WHEN (rn - 1) // 4 < cnt // 4 THEN (rn - 1) // 4 END AS INTEGER) AS iteration FROM o")
def split_leave_p_out(spark, sf):
    return O.leave_p_out(X.vectors(spark, sf), "vec_id", "identity", 4, SEED).select("vec_id", "iteration")


@query(f"WITH {_STRAT} SELECT vec_id, rn <= greatest(1, floor(cnt * 0.2)) AND greatest(1, floor(cnt * 0.2)) < cnt AS is_val FROM o")
def split_stratified_holdout(spark, sf):
    return O.stratified_holdout(X.vectors(spark, sf), "vec_id", "identity", 0.2, SEED).select("vec_id", "is_val")


@query(f"WITH {X.VECTORS_SQL}, s AS (SELECT unnest([0, 1]) AS r), o AS (SELECT r, vec_id, row_number() OVER (PARTITION BY r ORDER BY md5(concat(vec_id, ':', 42 + r)), vec_id) AS rn, count(*) OVER (PARTITION BY r) AS cnt FROM vectors, s) SELECT vec_id, CAST(r * 5 + {_FOLD} AS INTEGER) AS fold FROM o")
def split_repeated(spark, sf):
    return O.repeated_k_fold(X.vectors(spark, sf), "vec_id", 5, 2, SEED).select("vec_id", "fold")


@query(f"WITH {_ORD} SELECT vec_id, CAST(rn AS INTEGER) AS rn FROM o")
def seeded_shuffle(spark, sf):
    return O.seeded(X.vectors(spark, sf), "vec_id", SEED).select("vec_id", "rn")


# ---------------------------------------------------------------- predictions
_NEAR = X.GALLERY_SQL + """, d AS (SELECT p.probe_id, p.actual, g.identity, min(1 - list_cosine_similarity(p.v, g.v)) AS distance FROM probes p CROSS JOIN gallery g GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, identity) AS rn FROM d) WHERE rn = 1)"""
_PRED = _NEAR + f", pred AS (SELECT probe_id, actual, CASE WHEN exp(-distance / 0.5) >= {T} THEN identity ELSE 'UNKNOWN' END AS predicted, CASE WHEN exp(-distance / 0.5) >= {T} THEN distance END AS distance FROM near)"
_COUNTS = """, counts AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT actual AS label, CAST(actual = predicted AS INT) AS tp, 0 AS fp, CAST(actual <> predicted AS INT) AS fn FROM pred
  UNION ALL SELECT predicted, 0, 1, 0 FROM pred WHERE predicted NOT IN (actual, 'UNKNOWN')) GROUP BY label),
cm AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM counts),
cmf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM cm)"""


def _distances(spark, sf):
    return M.nearest_by_identity(X.probes(spark, sf), X.gallery(spark, sf), "cosine", keep=1)


def _pred(spark, sf):
    return M.predictions(_distances(spark, sf), X.probes(spark, sf), T, "cosine")


@query(f"WITH {_PRED} SELECT probe_id, actual, predicted, round(distance, 6) AS distance FROM pred")
def predictions(spark, sf):
    return r6(_pred(spark, sf), "distance").select("probe_id", "actual", "predicted", "distance")


@query(f"WITH {_PRED} SELECT actual, predicted, count(*) AS n FROM pred WHERE predicted <> 'UNKNOWN' GROUP BY ALL")
def confusion_matrix(spark, sf):
    return E.confusion(_pred(spark, sf))


@query(f"WITH {_PRED} SELECT actual AS label FROM pred UNION SELECT predicted FROM pred WHERE predicted <> 'UNKNOWN'")
def label_union(spark, sf):
    return E.labels(_pred(spark, sf))


@query(f"WITH {_PRED}{_COUNTS} SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM cmf")
def class_metrics(spark, sf):
    return r6(E.class_metrics(E.class_counts(_pred(spark, sf))), "precision", "recall", "f1")


@query(f"WITH {_PRED}{_COUNTS}, m AS (SELECT avg(p) AS p, avg(r) AS r FROM cm) SELECT (SELECT round(avg(CAST(actual = predicted AS INT)), 6) FROM pred) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m")
def macro_metrics_list(spark, sf):
    return r6(E.macro(_pred(spark, sf)), "accuracy", "precision", "recall", "f1")


_MATRIX = """, known AS (SELECT * FROM pred WHERE predicted <> 'UNKNOWN'), lab AS (SELECT actual AS label FROM pred UNION SELECT predicted FROM known),
mc AS (SELECT label, (SELECT count(*) FROM known WHERE actual = label AND predicted = label) AS tp, (SELECT count(*) FROM known WHERE actual <> label AND predicted = label) AS fp,
  (SELECT count(*) FROM known WHERE actual = label AND predicted <> label) AS fn, (SELECT count(*) FROM known WHERE actual <> label AND predicted <> label) AS tn FROM lab),
mm AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM mc),
mf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM mm)"""


@query(f"WITH {_PRED}{_MATRIX} SELECT label, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(s, 6) AS specificity FROM mf")
def class_metrics_matrix(spark, sf):
    return r6(E.matrix_class_metrics(_pred(spark, sf)), "precision", "recall", "f1", "specificity")


@query(f"WITH {_PRED}{_MATRIX} SELECT round(coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, round(avg(s), 6) AS specificity FROM mf")
def macro_metrics_matrix(spark, sf):
    return r6(E.macro_matrix(_pred(spark, sf)), "accuracy", "precision", "recall", "f1", "specificity")


@query(f"WITH {_PRED}, q AS (SELECT count(*) FILTER (actual = predicted) AS tp, count(*) FILTER (predicted NOT IN (actual, 'UNKNOWN')) AS fp, count(*) FILTER (predicted = 'UNKNOWN') AS fn, count(*) AS n FROM pred), w AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM q) SELECT tp, fp, fn, n, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(tp / n, 6) AS accuracy FROM w")
def micro_metrics(spark, sf):
    return r6(E.micro(_pred(spark, sf)), "precision", "recall", "f1", "accuracy")


@query(f"WITH {X.PAIRS_SQL}, t AS (SELECT identity = other AS same, list_distance(v, u) < 1.3 AS said FROM pairs), q AS (SELECT count(*) FILTER (same AND said) AS tp, count(*) FILTER (NOT same AND said) AS fp, count(*) FILTER (same AND NOT said) AS fn, count(*) FILTER (NOT same AND NOT said) AS tn FROM t), w AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM q) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS far, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS frr FROM w")
def verification_metrics(spark, sf):
    from likeness.functions.vectors import euclidean

    p = X.pairs(spark, sf).select((c("identity") == c("other")).alias("same"), (euclidean(c("v"), c("u")) < 1.3).alias("said_same"))
    return r6(E.verification(p), "precision", "recall", "f1", "accuracy", "far", "frr")


# --------------------------------------------------------------------- curves
def _scored(spark, sf):
    """Every probe with its nearest identity, whatever the distance."""
    return M.predictions(_distances(spark, sf), X.probes(spark, sf), 0.0, "cosine")


_POINTS = _NEAR + """, own AS (SELECT distance, actual = identity AS ok FROM near), ends AS (SELECT min(distance) AS lo, (max(distance) - min(distance)) / 100 AS step FROM own),
grid AS (SELECT CAST(i AS INTEGER) AS i, lo + step * i AS threshold, step, i = 100 AS last FROM ends, range(0, 101) t(i)),
pts AS (SELECT i, threshold, step, count(*) FILTER (ok AND (distance <= threshold OR last)) AS tp, count(*) FILTER (NOT ok AND (distance <= threshold OR last)) AS fp, count(*) FILTER (NOT ok AND NOT (distance <= threshold OR last)) AS tn, count(*) FILTER (ok AND NOT (distance <= threshold OR last)) AS fn FROM grid, own GROUP BY ALL),
roc AS (SELECT i, threshold, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(tp / nullif(tp + fn, 0), 0) AS tpr FROM pts UNION ALL SELECT -1, 0, 0, 0 UNION ALL SELECT 101, max(threshold) + max(step), 1, 1 FROM pts)"""


@query(f"WITH {_POINTS} SELECT i, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_curve(spark, sf):
    return r6(E.roc(E.curve_points(_scored(spark, sf))), "threshold", "fpr", "tpr")


@query(f"WITH {_POINTS} SELECT i, round(threshold, 6) AS threshold, round(fpr, 6) AS far, round(1 - tpr, 6) AS frr FROM roc")
def det_curve(spark, sf):
    return r6(E.det(E.curve_points(_scored(spark, sf))), "threshold", "far", "frr")


@query(f"WITH {_POINTS} SELECT round(threshold, 6) AS threshold, round((fpr + 1 - tpr) / 2, 6) AS eer FROM roc WHERE i BETWEEN 0 AND 100 ORDER BY abs(fpr - (1 - tpr)), i LIMIT 1")
def eer(spark, sf):
    return r6(E.equal_error(E.curve_points(_scored(spark, sf))), "threshold", "eer")


@query(f"WITH {_POINTS} SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, i) AS pf, lag(tpr) OVER (ORDER BY fpr, i) AS pt FROM roc)")
def auc(spark, sf):
    return r6(E.auc(E.curve_points(_scored(spark, sf))), "auc")


@query(f"WITH {_POINTS}, h AS (SELECT roc.* FROM roc JOIN pts ON roc.i = pts.i WHERE abs(roc.threshold - 0.6) < pts.step ORDER BY roc.i LIMIT 1) SELECT round(max(fpr), 6) AS far, round(max(1 - tpr), 6) AS frr FROM h")
def operating_point(spark, sf):
    return r6(E.operating_point(E.curve_points(_scored(spark, sf)), 0.6), "far", "frr")


_STEPS = [0.25, 0.3, 0.35, 0.4, 0.45]


@query(f"WITH {_NEAR} SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CAST(actual = identity AND exp(-distance / 0.5) >= t AS INT)), 6) AS accuracy FROM near, (SELECT unnest({_STEPS}) AS t) GROUP BY t")
def threshold_sweep(spark, sf):
    near = _scored(spark, sf).select("actual", c("predicted").alias("identity"), "distance")
    return r6(E.threshold_sweep(near, _STEPS, confidence(c("distance"), "cosine")), "accuracy")


# ----------------------------------------------------------- cross-validation
def _folds(spark, sf, metric="cosine"):
    rows = O.stratified_k_fold(X.vectors(spark, sf), "vec_id", "identity", 5, SEED)
    p = rows.select(c("vec_id").alias("probe_id"), "v", "fold", c("identity").alias("actual"))
    d = M.nearest_by_identity(p, rows.select("identity", "v", "fold"), metric, fold="fold", keep=1)
    return M.predictions(d, p, 0.0, metric, extra=("fold",))


_CV = _STRAT + f", f AS (SELECT vec_id, identity, v, {_FOLD} AS fold FROM o), d AS (SELECT p.vec_id, p.fold, p.identity AS actual, g.identity, min({{dist}}) AS distance FROM f p JOIN f g ON p.fold <> g.fold GROUP BY ALL), pred AS (SELECT fold, actual, identity AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, identity) AS rn FROM d) WHERE rn = 1)"
_CV_COS, _CV_EUC = _CV.format(dist="1 - list_cosine_similarity(p.v, g.v)"), _CV.format(dist="list_sum(list_transform(list_zip(p.v, g.v), lambda t: abs(t[1] - t[2])))")
_FC = """, counts AS (SELECT fold, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT fold, actual AS label, CAST(actual = predicted AS INT) AS tp, 0 AS fp, CAST(actual <> predicted AS INT) AS fn FROM pred UNION ALL SELECT fold, predicted, 0, 1, 0 FROM pred WHERE predicted <> actual) GROUP BY ALL),
m AS (SELECT fold, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS p, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS r FROM counts GROUP BY fold), a AS (SELECT fold, avg(CAST(actual = predicted AS INT)) AS accuracy FROM pred GROUP BY fold)"""


@query(f"WITH {_CV_COS}{_FC} SELECT m.fold, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m JOIN a ON m.fold = a.fold")
def cv_folds(spark, sf):
    return r6(E.macro(_folds(spark, sf), ("fold",)), "accuracy", "precision", "recall", "f1")


@query(f"WITH {_CV_COS}, a AS (SELECT fold, avg(CAST(actual = predicted AS INT)) AS x FROM pred GROUP BY fold), s AS (SELECT avg(x) AS mean, stddev_pop(x) AS std, count(*) AS folds FROM a) SELECT round(mean, 6) AS mean, round(std, 6) AS std, folds, round(greatest(0, mean - 1.96 * std / sqrt(folds)), 6) AS ci_low, round(least(1, mean + 1.96 * std / sqrt(folds)), 6) AS ci_high FROM s")
def cv_summary(spark, sf):
    return r6(E.fold_summary(E.macro(_folds(spark, sf), ("fold",))), "mean", "std", "ci_low", "ci_high")


@query(f"WITH x AS (WITH {_CV_COS} SELECT fold, avg(CAST(actual = predicted AS INT)) AS v FROM pred GROUP BY fold), y AS (WITH {_CV_EUC} SELECT fold, avg(CAST(actual = predicted AS INT)) AS v FROM pred GROUP BY fold), s AS (SELECT avg(x.v - y.v) AS m, var_samp(x.v - y.v) AS s, count(*) AS n FROM x JOIN y ON x.fold = y.fold) SELECT round(m / sqrt(s / n), 5) AS t, n - 1 AS df, round(pow((n - 1) / (n - 1 + m * m / (s / n)), (n - 1) / 2), 5) AS p FROM s")
def cv_ttest(spark, sf):
    a, b = (E.macro(_folds(spark, sf, m), ("fold",)) for m in ("cosine", "manhattan"))
    return E.paired_t_test(a, b).withColumns({"t": F.round("t", 5), "p": F.round("p", 5)})


@query(f"WITH {_CV_COS} SELECT 'cosine' AS algorithm, round(avg(CAST(actual = predicted AS INT)), 6) AS accuracy FROM pred UNION ALL SELECT * FROM (WITH {_CV_EUC} SELECT 'manhattan', round(avg(CAST(actual = predicted AS INT)), 6) FROM pred)")
def compare_algorithms(spark, sf):
    return r6(E.compared({m: _folds(spark, sf, m) for m in ("cosine", "manhattan")}), "accuracy")


@query(f"WITH {_PRED}, k AS (SELECT probe_id % 20 AS condition, avg(CAST(actual = predicted AS INT)) AS accuracy, count(*) AS n FROM pred GROUP BY ALL) SELECT condition, round(accuracy, 6) AS accuracy, n FROM k")
def condition_test(spark, sf):
    return r6(E.accuracy_by(_pred(spark, sf).withColumn("condition", c("probe_id") % 20), "condition"), "accuracy")


@query(f"""
WITH {_ORD}, r(ratio) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)),
d AS (
  SELECT p.vec_id, p.identity AS actual, p.rn AS prn, g.identity, g.rn AS grn, p.cnt, list_sum(list_transform(list_zip(p.v, g.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS distance
  FROM o p JOIN o g ON g.rn < p.rn
), pred AS (
  SELECT ratio, actual, identity AS predicted FROM (
    SELECT ratio, actual, identity, row_number() OVER (PARTITION BY ratio, vec_id ORDER BY distance, identity) AS k
    FROM d JOIN r ON prn > floor(cnt * ratio) AND grn <= floor(cnt * ratio)
  ) WHERE k = 1
), counts AS (
  SELECT ratio, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT ratio, actual AS label, CAST(actual = predicted AS INT) AS tp, 0 AS fp, CAST(actual <> predicted AS INT) AS fn FROM pred
    UNION ALL SELECT ratio, predicted, 0, 1, 0 FROM pred WHERE predicted <> actual
  ) GROUP BY ALL
), m AS (
  SELECT ratio, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS p, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS r FROM counts GROUP BY ratio
), a AS (SELECT ratio, avg(CAST(actual = predicted AS INT)) AS accuracy, count(*) AS tested FROM pred GROUP BY ratio)
SELECT m.ratio, tested, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m JOIN a ON m.ratio = a.ratio
""")
def learning_curve(spark, sf):
    rows = X.vectors(spark, sf).select(c("vec_id").alias("id"), "identity", "v")
    return r6(C.learning_curve(rows, [0.1, 0.3, 0.5, 0.7, 0.9], "euclidean", SEED), "accuracy", "precision", "recall", "f1")
