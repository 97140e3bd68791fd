"""Seeded order and exact splits without a single-task sort.

A seeded order sorts by md5 of key and seed. Ranks over a whole table are
found by buckets of the hash's first digits: a bucket's offset is the count of
rows in the buckets before it, so rows are ranked within buckets in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_DIGITS = 3


def seeded(df: DataFrame, key: str, seed: int, by: str | None = None) -> DataFrame:
    """``rn`` (from 1) and ``cnt``: place of each row in the seeded order, and how many rows there are; within ``by`` if given."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    df = df.withColumn("_h", h)
    df = df.withColumn("_b", F.substring("_h", 1, _DIGITS))
    if by:  # a label may hold most rows, so it is ranked by buckets too
        group = df.groupBy(F.col(by).alias("_g"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
        of = Window.partitionBy("_g")
        group = group.select("_g", "_c", F.coalesce(F.sum("_n").over(of.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_n").over(of).alias("cnt"))
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", key)))
        both = ranked.join(group, ranked[by].eqNullSafe(group["_g"]) & (ranked["_b"] == group["_c"]))
        return both.withColumn("rn", F.col("_r") + F.col("_o")).drop("_h", "_b", "_r", "_o", "_g", "_c")
    counts = df.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 16 ** _DIGITS rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("cnt"))
    inside = Window.partitionBy("_b").orderBy("_h", key)
    return df.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(offsets), "_b").withColumn("rn", F.col("_r") + F.col("_o")).drop("_h", "_b", "_r", "_o")


def holdout(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """is_train: the first int(n * ratio) rows of the seeded order."""
    return seeded(df, key, seed).withColumn("is_train", F.col("rn") <= F.floor(F.col("cnt") * F.lit(ratio)))


def _block(k: int) -> Column:
    size = F.greatest(F.floor(F.col("cnt") / k), F.lit(1))
    return F.when(F.col("cnt") < k, F.lit(k - 1)).otherwise(F.least(F.floor((F.col("rn") - 1) / size), F.lit(k - 1))).cast("int")


def k_fold(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """fold: contiguous blocks of n div k; the last takes the rest."""
    return seeded(df, key, seed).withColumn("fold", _block(k))


def stratified_k_fold(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """As ``k_fold`` within each label; a label of fewer rows than folds is wholly in the last."""
    return seeded(df, key, seed, by=label).withColumn("fold", _block(k))


def round_robin(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    return seeded(df, key, seed, by=label).withColumn("fold", ((F.col("rn") - 1) % k).cast("int"))


def leave_one_out(df: DataFrame, key: str, label: str, index: int, seed: int) -> DataFrame:
    """is_test: of each label the row at ``index`` modulo the label's size."""
    return seeded(df, key, seed, by=label).withColumn("is_test", F.col("rn") - 1 == F.lit(index) % F.col("cnt"))


def leave_p_out(df: DataFrame, key: str, label: str, p: int, seed: int) -> DataFrame:
    """iteration: windows of p rows of each label; rows beyond the last full window have none."""
    full = F.floor(F.col("cnt") / p)
    it = F.floor((F.col("rn") - 1) / p)
    return seeded(df, key, seed, by=label).withColumn("iteration", F.when(it < full, it).cast("int"))


def repeated_k_fold(df: DataFrame, key: str, k: int, repetitions: int, seed: int) -> DataFrame:
    """fold = repetition * k + block, each repetition with the next seed."""
    out = None
    for r in range(repetitions):
        one = k_fold(df, key, k, seed + r).withColumn("fold", (F.col("fold") + r * k).cast("int"))
        out = one if out is None else out.unionByName(one)
    return out


def stratified_holdout(df: DataFrame, key: str, label: str, ratio: float, seed: int) -> DataFrame:
    """is_val: of each label max(1, int(n * ratio)) rows, unless that leaves none to train on."""
    take = F.greatest(F.lit(1), F.floor(F.col("cnt") * F.lit(ratio)))
    return seeded(df, key, seed, by=label).withColumn("is_val", (F.col("rn") <= take) & (take < F.col("cnt")))


def limited_groups(df: DataFrame, key: str, label: str, at_least: int, at_most: int = 0) -> DataFrame:
    """Rows of labels with at least so many, of each the first ``at_most`` by key (0: all)."""
    sizes = df.groupBy(F.col(label).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least)
    out = df.join(sizes, df[label].eqNullSafe(sizes["_g"]), "left_semi")
    if at_most > 0:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("_r") <= at_most).drop("_r")
    return out


def first_groups(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows of the first ``n`` labels in order."""
    return df.join(df.select(label).distinct().orderBy(label).limit(n), label, "left_semi").select(*df.columns)
