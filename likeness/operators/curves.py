"""Accuracy by the share of rows that are trained on, from one matching pass.

The training sets of a seeded order are nested: what a share takes, all larger
ones take too. So a training row has the least share that takes it as its step,
a test row meets the steps before its own, and the nearest identity for a share
is the least of the nearest ones of the steps up to it. Each pair of rows is
compared once, whatever the number of shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.operators import metrics as E, order as O
from likeness.operators.matching import BLOCK, GROUPS, SHARD, block_distances, coded, matrix, part_minima
from likeness.runtime import ship


def _step(ratios: list[float]) -> Column:
    """How many of the shares (ascending) do not take a row of rank ``rn`` among ``cnt``."""
    out = F.lit(0)
    for r in ratios:
        out = out + (F.col("rn") > F.floor(F.col("cnt") * F.lit(float(r)))).cast("int")
    return out


def nearest_by_step(probes: DataFrame, gallery: DataFrame, metric: str, n: int, m: int) -> DataFrame:
    """(probe_id, step, identity, distance): the nearest identity of the gallery's samples of each step before the probe's own.

    ``n`` rows of gallery and ``m`` probes are dealt into shards and blocks; a
    task returns one row for a probe and step. Equal distances go to the first
    identity; a distance that is not a number counts as farther than all others.
    """
    ship(probes.sparkSession)
    shards = max(1, -(-n // SHARD))
    blocks = max(1, -(-m // BLOCK), min(-(-m // 1024), -(-GROUPS // shards)))
    left = probes.select("probe_id", F.col("v").alias("pv"), F.col("step").alias("pt"), F.pmod(F.xxhash64("probe_id"), F.lit(blocks)).alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("ps"))
    right = gallery.select("identity", F.col("v").alias("gv"), F.col("step").alias("gt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("gb"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("gs"))
    names = ["probe_id", "step", "identity", "distance"]

    def least(p: pa.Table, g: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if p.num_rows and g.num_rows:
            (who, at_), step = coded(g.column("identity")), g.column("gt").to_numpy()
            order = np.lexsort((at_, step))
            who, step, b = who[at_[order]], step[order], matrix(g.column("gv"))[order]
            ids, own, a = p.column("probe_id").to_numpy(), p.column("pt").to_numpy(), matrix(p.column("pv"))
            cuts = [*np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step)]
            for i, j in zip(cuts, cuts[1:]):
                rows = np.flatnonzero(own > step[i])
                if metric != "cosine" and np.isfinite(a).all() and np.isfinite(b).all():
                    parts = np.flatnonzero(np.append(True, who[i + 1 : j] != who[i : j - 1]))
                    at, part, d = part_minima(metric, a[rows], b[i:j], parts, 1)
                    at, name = rows[at], who[i + parts[part]]
                else:  # what is not a number is farther than all others
                    at, name, d = rows, [], []
                    for lo in range(0, len(rows), 64):
                        some = block_distances(metric, a[rows[lo : lo + 64]], b[i:j])
                        best = np.where(np.isnan(some), np.inf, some).argmin(1)
                        name += who[i + best].tolist()
                        d += some[np.arange(len(some)), best].tolist()
                found[0] += ids[at].tolist()
                found[1] += [int(step[i])] * len(at)
                found[2] += list(name)
                found[3] += list(d)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=names)

    groups = min(4096, 2 * shards * blocks)
    left, right = left.repartition(groups, "pb", "ps"), right.repartition(groups, "gb", "gs")
    met = left.groupBy("pb", "ps").cogroup(right.groupBy("gb", "gs")).applyInArrow(least, "probe_id long, step int, identity string, distance double")
    best = F.min(F.struct("distance", "identity"))
    return met.groupBy("probe_id", "step").agg(best.alias("best"))


def curve_predictions(samples: DataFrame, ratios: list[float], metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """(ratio, probe_id, actual, predicted, distance) of the rows (id, identity, v) that each share leaves for testing.

    A share takes the first int(n * share) rows of the seeded order. Test rows of
    a share that takes none have no prediction and are left out.
    """
    shares = sorted({float(r) for r in ratios})
    rows = O.seeded(samples.select("id", F.col("identity").cast("string").alias("identity"), "v"), "id", seed).withColumn("step", _step(shares))
    n = samples.count()
    taken = lambda r: int(n * r)
    probes = rows.where("step > 0").select(F.col("id").alias("probe_id"), F.col("identity").alias("actual"), "v", "step")
    gallery = rows.where(F.col("step") < len(shares))
    best = nearest_by_step(probes, gallery, metric, taken(shares[-1]) if shares else 0, n - taken(shares[0]) if shares else 0)
    asked = probes.select("probe_id", "actual", F.explode(F.sequence(F.lit(0), F.col("step") - 1)).alias("step"))
    upto = Window.partitionBy("probe_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.join(best, ["probe_id", "step"], "left").withColumn("best", F.min("best").over(upto)).where("best IS NOT NULL")
    return met.select(F.get(F.array(*[F.lit(r) for r in shares]), F.col("step")).alias("ratio"), "probe_id", "actual", F.col("best.identity").alias("predicted"), F.col("best.distance").alias("distance"))


def learning_curve(samples: DataFrame, ratios: list[float], metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """accuracy, precision, recall, f1 (macro) of each share, with the number of rows tested."""
    p = curve_predictions(samples, ratios, metric, seed)
    return E.macro(p, ("ratio",)).join(p.groupBy("ratio").agg(F.count("*").alias("tested")), "ratio")
