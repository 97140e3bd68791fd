"""Evaluation of predictions (actual, predicted, confidence, distance): counts, curves and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNKNOWN = "UNKNOWN"


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b))


def labels(pred: DataFrame) -> DataFrame:
    """All actual and known predicted labels, once each."""
    return pred.select(F.col("actual").alias("label")).union(pred.where(F.col("predicted") != UNKNOWN).select("predicted")).distinct()


def confusion(pred: DataFrame) -> DataFrame:
    """(actual, predicted, n) in long form; predictions without an identity are no cell."""
    return pred.where(F.col("predicted") != UNKNOWN).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def confusion_wide(pred: DataFrame) -> DataFrame:
    return confusion(pred).groupBy("actual").pivot("predicted").agg(F.first("n")).na.fill(0)


def class_counts(pred: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """label, tp, fp, fn; a probe left unknown is a miss of its own label."""
    hit = F.col("actual") == F.col("predicted")
    own = pred.select(*extra, F.col("actual").alias("label"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"), (~hit).cast("int").alias("fn"))
    other = pred.where(~hit & (F.col("predicted") != UNKNOWN)).select(*extra, F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    return own.unionByName(other).groupBy(*extra, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def class_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of each label, 0 where undefined."""
    p, r = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(pred: DataFrame, extra: tuple[str, ...] = (), only: DataFrame | None = None) -> DataFrame:
    """accuracy, precision, recall, and f1 of these two: means over the labels that occur (or over ``only``)."""
    each = class_metrics(class_counts(pred, extra))
    if only is not None:
        each = each.join(only, ["label"], "left_semi")
    mean = each.groupBy(*extra).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    acc = pred.groupBy(*extra).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    out = acc.join(mean, [*extra]) if extra else acc.crossJoin(mean)  # one row each
    return out.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matrix_class_metrics(pred: DataFrame) -> DataFrame:
    """label, tp, fp, fn, tn, precision, recall, f1, specificity by the matrix, in which unknown predictions do not count."""
    cells = confusion(pred)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("row"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("col"))
    own = labels(pred).join(rows, "label", "left").join(cols, "label", "left").na.fill(0).crossJoin(total)
    own = own.select("label", "tp", (F.col("col") - F.col("tp")).alias("fp"), (F.col("row") - F.col("tp")).alias("fn"), (F.col("total") - F.col("row") - F.col("col") + F.col("tp")).alias("tn"))
    return class_metrics(own).withColumn("specificity", _safe(F.col("tn"), F.col("tn") + F.col("fp")))


def macro_matrix(pred: DataFrame) -> DataFrame:
    """accuracy (trace by total) and the means of the class metrics over all labels."""
    each = matrix_class_metrics(pred)
    return each.agg(_safe(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "specificity")])


def micro(pred: DataFrame) -> DataFrame:
    """tp: right; fp: another name; fn: unknown; and what follows from them."""
    hit, unknown = F.col("actual") == F.col("predicted"), F.col("predicted") == UNKNOWN
    c = pred.agg(F.count_if(hit).alias("tp"), F.count_if(~hit & ~unknown).alias("fp"), F.count_if(unknown).alias("fn"), F.count("*").alias("n"))
    return class_metrics(c).withColumn("accuracy", _safe(F.col("tp"), F.col("n")))


def verification(pairs: DataFrame) -> DataFrame:
    """From (same, said_same): accuracy, precision, recall, f1, false accept and false reject rates."""
    s, p = F.col("same"), F.col("said_same")
    c = pairs.agg(F.count_if(s & p).alias("tp"), F.count_if(~s & p).alias("fp"), F.count_if(s & ~p).alias("fn"), F.count_if(~s & ~p).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return class_metrics(c).withColumn("accuracy", _safe(F.col("tp") + F.col("tn"), n)).withColumn("far", _safe(F.col("fp"), F.col("fp") + F.col("tn"))).withColumn("frr", _safe(F.col("fn"), F.col("tp") + F.col("fn")))


def curve_points(pred: DataFrame, steps: int = 100) -> DataFrame:
    """i, threshold, tp, fp, tn, fn on the grid of thresholds from the least to the largest distance.

    Positive: the prediction is right; predicted so: its distance is at most
    the threshold. Each prediction is binned to the first grid point that it
    reaches, so the cost does not grow with the grid. Rows without a distance take no part.
    """
    own = pred.where(F.col("distance").isNotNull()).select("distance", (F.col("actual") == F.col("predicted")).alias("right"))
    ends = own.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    grid = ends.select("lo", "hi", ((F.col("hi") - F.col("lo")) / steps).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("threshold", F.col("lo") + F.col("step") * F.col("i"))
    points = ends.select("lo", ((F.col("hi") - F.col("lo")) / steps).alias("step"))
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("distance") <= F.col("lo") + F.col("step") * i), F.lit(True))
    binned = own.crossJoin(F.broadcast(points)).select("right", F.when(first == 0, F.lit(steps)).otherwise(first - 1).cast("int").alias("i"))
    counts = binned.groupBy("i").agg(F.count_if("right").alias("r"), F.count_if(~F.col("right")).alias("w"))
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    out = grid.join(counts, "i", "left").na.fill(0, ["r", "w"])  # steps + 1 rows
    out = out.withColumn("tp", F.sum("r").over(w)).withColumn("fp", F.sum("w").over(w))
    return out.select("i", "threshold", "step", "tp", "fp", (F.sum("w").over(whole) - F.col("fp")).alias("tn"), (F.sum("r").over(whole) - F.col("tp")).alias("fn"))


def roc(points: DataFrame) -> DataFrame:
    """i, threshold, fpr, tpr, with the end points (0, 0) and (1, 1)."""
    own = points.select("i", "threshold", _safe(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), _safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"))
    first = points.agg(F.lit(-1).alias("i"), F.lit(0.0).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    last = points.agg((F.max("i") + 1).alias("i"), (F.max("threshold") + F.max("step")).alias("threshold"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return first.unionByName(own).unionByName(last)


def det(points: DataFrame) -> DataFrame:
    """i, threshold, far, frr, with the end points (0, 1) and (1, 0)."""
    r = roc(points)
    return r.select("i", "threshold", F.col("fpr").alias("far"), (1 - F.col("tpr")).alias("frr"))


def equal_error(points: DataFrame) -> DataFrame:
    """threshold and eer where the two error rates are closest; the first of equals."""
    d = det(points).where((F.col("i") >= 0))
    d = d.join(points.select("i"), "i", "left_semi")
    return d.agg(F.min_by(F.struct("threshold", ((F.col("far") + F.col("frr")) / 2).alias("eer")), F.struct(F.abs(F.col("far") - F.col("frr")), "i")).alias("b")).select("b.threshold", "b.eer")


def auc(points: DataFrame) -> DataFrame:
    """Trapezoids under the curve."""
    w = Window.orderBy("fpr", "i")
    r = roc(points).withColumn("pf", F.lag("fpr").over(w)).withColumn("pt", F.lag("tpr").over(w))
    return r.agg(F.coalesce(F.sum((F.col("fpr") - F.col("pf")) * (F.col("tpr") + F.col("pt")) / 2), F.lit(0.0)).alias("auc"))


def operating_point(points: DataFrame, threshold: float) -> DataFrame:
    """far and frr of the first point within a step of the threshold."""
    d = det(points).join(points.select("i", "step"), "i").where(F.abs(F.col("threshold") - threshold) < F.col("step"))
    return d.agg(F.min_by("far", "i").alias("far"), F.min_by("frr", "i").alias("frr"))


def threshold_sweep(nearest: DataFrame, thresholds: list[float], conf: Column) -> DataFrame:
    """threshold, accuracy: a row (actual, identity, distance) is right if its identity is and the confidence is not below."""
    each = nearest.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.groupBy("threshold").agg(F.avg(((F.col("actual") == F.col("identity")) & ~(conf < F.col("threshold"))).cast("double")).alias("accuracy"))


def fold_summary(folds: DataFrame, metric: str = "accuracy") -> DataFrame:
    """mean, population deviation, and the 95 % interval within [0, 1]."""
    out = folds.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count("*").alias("folds"))
    half = F.lit(1.96) * F.col("std") / F.sqrt("folds")
    return out.withColumn("ci_low", F.greatest(F.lit(0.0), F.col("mean") - half)).withColumn("ci_high", F.least(F.lit(1.0), F.col("mean") + half))


#: Coefficients of the rational Chebyshev fit of the complementary error function, from the constant up (fixed values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function for x of at least 0, to about 1e-7."""
    t = F.lit(1.0) / (1 + F.lit(0.5) * x)
    return t * F.exp(sum((F.lit(c) * F.pow(t, F.lit(float(k))) for k, c in enumerate(ERFC)), -x * x))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided: normal beyond 30 degrees of freedom, else (df / (df + t^2))^(df / 2)."""
    return F.when(df > 30, erfc(F.abs(t) / F.sqrt(F.lit(2.0)))).otherwise(F.pow(df / (df + t * t), df / 2))


def paired_t_test(a: DataFrame, b: DataFrame, key: str = "fold", metric: str = "accuracy") -> DataFrame:
    """t, df, p of the differences of two results on the same folds. No difference at all leaves t not a number."""
    d = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key).select((F.col("x") - F.col("y")).alias("d"))
    s = d.agg(F.avg("d").alias("mean"), F.var_samp("d").alias("var"), F.count("*").alias("n"))
    se = F.sqrt(F.col("var") / F.col("n"))
    t = F.when(se == 0, F.when(F.col("mean") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")) * F.signum("mean"))).otherwise(F.col("mean") / F.when(se == 0, F.lit(1.0)).otherwise(se))
    return s.select(t.alias("t"), (F.col("n") - 1).alias("df")).withColumn("p", t_p_value(F.col("t"), F.col("df")))


def timing_stats(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, min, max, mean, median, population deviation; p95 and p99 are the sorted values at floor(p * (n - 1)).

    A group may hold all rows, so it is never sorted as a whole: counts of 4096
    equal intervals between its least and largest value tell in which of them
    a rank lies, and only the different values of those are put in order.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.to_json(F.struct(F.lit(1).alias("_"), *by)).alias("_g"))
    stats = own.groupBy("_g").agg(*[F.first(k).alias(k) for k in by], F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    last = F.col("n") - 1
    ranks = {"lo": F.floor(last / 2), "hi": F.ceil(last / 2), "p95": F.floor(F.lit(0.95) * last), "p99": F.floor(F.lit(0.99) * last)}
    stats = stats.select("*", *[r.alias(f"_{k}") for k, r in ranks.items()])
    width = F.col("max") - F.col("min")
    part = F.when(width > 0, F.floor((F.col("_v") - F.col("min")) / width * 4095)).otherwise(0).alias("_p")
    placed = own.select("_g", "_v").join(stats.select("_g", "min", "max"), "_g").select("_g", "_v", part)
    before = lambda *keys: Window.partitionBy("_g", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_g", "_p").agg(F.count("*").alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before("_p")), F.lit(0)))
    holds = lambda k: (F.col(f"_{k}") >= F.col("_o")) & (F.col(f"_{k}") < F.col("_o") + F.col("_c"))
    wanted = counts.join(stats.select("_g", *[f"_{k}" for k in ranks]), "_g").where(holds("lo") | holds("hi") | holds("p95") | holds("p99")).withColumnRenamed("_o", "_start").drop("_c")
    inside = placed.join(wanted, ["_g", "_p"]).groupBy("_g", "_p", "_start", *[f"_{k}" for k in ranks], "_v").agg(F.count("*").alias("_c"))
    inside = inside.withColumn("_o", F.col("_start") + F.coalesce(F.sum("_c").over(before("_p", "_v")), F.lit(0)))
    found = inside.groupBy("_g").agg(*[F.max(F.when(holds(k), F.col("_v"))).alias(f"at_{k}") for k in ranks])
    out = stats.join(found, "_g")
    return out.select(*by, "n", "min", "max", "mean", ((F.col("at_lo") + F.col("at_hi")) / 2).alias("median"), "std", F.col("at_p95").alias("p95"), F.col("at_p99").alias("p99"))


def throughput(runs: DataFrame, amount: str) -> DataFrame:
    """per_unit: rows by the sum of ``amount``; peak; above_base: mean less the least."""
    return runs.agg((F.count("*") / F.sum(amount)).alias("per_unit"), F.max(amount).alias("peak"), (F.avg(amount) - F.min(amount)).alias("above_base"))


def accuracy_by(pred: DataFrame, by: str) -> DataFrame:
    """(by, accuracy, n): the predictions of each condition."""
    return pred.groupBy(by).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def compared(predictions: dict[str, DataFrame]) -> DataFrame:
    """(algorithm, accuracy) of several algorithms' predictions."""
    rows = [p.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy")).select(F.lit(k).alias("algorithm"), "accuracy") for k, p in predictions.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
