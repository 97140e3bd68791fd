"""Nearest-identity matching of probes against a gallery.

The gallery (identity, v) is dealt into shards and the probes into blocks, both
of bounded size, and every block meets every shard in one task, where numpy
keeps the least distance for each identity. Only those minima are shuffled;
ranking then works on probe and identity alone. Where a probe's first identities
are all that is asked, a screen in short numbers bounds every distance from below
(one product of matrices, or sums of whole numbers), and only pairs that
the screen cannot rule out are computed, by the defining sums. Rows for which no bound holds
(not finite, too large or small, no direction) are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.functions.vectors import SCALES, confidence
from likeness.runtime import ship

#: Rows of the gallery in a shard, and probes in a block, at most; blocks are smaller while there are fewer pairs of them than GROUPS.
SHARD, BLOCK, GROUPS = 16384, 16384, 64
#: Distances in a tile of the screen, and pairs whose distances are computed at once.
TILE, PAIRS = 1 << 20, 1 << 16
#: The distance of an identity without samples.
FAR = 1.7976931348623157e308


def matrix(column) -> np.ndarray:
    arr = pa.concat_arrays(column.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    if len(arr) and len(flat) % len(arr):
        raise ValueError("vectors must have the same dimension")
    return flat.reshape(len(arr), -1)


def coded(column) -> tuple[np.ndarray, np.ndarray]:
    """The different texts of a column in order, and the index of each row's among them."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    names = np.array(found.dictionary.to_pylist(), object)
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return names[order], rank[found.indices.to_numpy(zero_copy_only=False)]


def _added(metric: str, out: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Add what a component counts for to the sums that a distance follows from."""
    if metric == "cosine":
        out += x * y
    elif metric == "manhattan":
        out += np.abs(x - y)
    elif metric == "chi_square":
        s = x + y
        out += np.where(s > 0, (x - y) ** 2 / np.where(s > 0, s, 1), 0)
    else:
        out += (x - y) ** 2


def _distance(metric: str, out: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        size = a_size * b_size
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(size == 0, np.nan, 1 - out / size)
    return np.sqrt(out) if metric in ("euclidean", "mahalanobis") else out


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def block_distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b, by the defining sums."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors must have the same dimension")
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        _added(metric, out, a[:, i, None], b[None, :, i])
    return _distance(metric, out, _norms(a)[:, None], _norms(b)[None, :])


class Screen:
    """Bounds of the distances of rows of a to rows of b; ``odd`` rows of a have none.

    ``tile(lo, hi)`` gives numbers whose order within a row follows the distances: a pair
    whose distance is not above that of another has a number at most ``gap`` of its row
    above the other's. For chi-square the numbers are bounds from below only, by the tangent of 1 / s
    at twice the mean, and ``level`` gives the number that no pair of a smaller distance is above.
    """

    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray):
        self.metric, self.level = metric, None
        self.odd = np.ones(len(a), bool)
        d = a.shape[1]
        a_size, b_size = _norms(a), _norms(b)
        most = np.abs(b).max(initial=0.0)
        if not d or not np.isfinite(b_size).all() or not 1e-8 < most < 1e8:
            return
        fits = np.isfinite(a_size) & (np.abs(a).max(1) < 1e8)
        if metric == "cosine":
            if (b_size < 1e-100).any():
                return
            fits &= a_size >= 1e-100
        if metric == "chi_square" and b.min() < 0:
            return
        if metric == "chi_square":
            fits &= (a >= 0).all(1)
        if metric == "manhattan" and d > 2047:
            return
        if not fits.any():
            return
        x = np.where(fits[:, None], a, b[:1])  # a row in place of the odd ones
        if metric == "manhattan":
            middle = (b.max(0) + b.min(0)) / 2
            x, y = x - middle, b - middle
            unit = min(16383, 65534 // (2 * d)) / max(np.abs(x).max(), np.abs(y).max(), 1e-30)
            self.left, right = np.rint(x * unit).astype(np.int16), np.rint(y * unit).astype(np.int16)
            loss = lambda v, q: np.abs(v * unit - q).sum(1)
            self.gap = np.ceil(2 * (loss(x, self.left) + loss(y, right).max())) + 1
            self.right, self.none = np.ascontiguousarray(right.T), np.uint16(65535)
        else:
            one = np.ones((len(x), 1))
            if metric == "cosine":
                left, right = -x / _norms(x)[:, None], b / b_size[:, None]
            elif metric == "chi_square":
                m = 2 * b.mean()
                x, y = x - m / 2, b - m / 2
                left, right = np.hstack([one, x * x / m**2 - 2 * x / m, x / m**2]), np.hstack([((y * y / m) - y**3 / m**2).sum(1)[:, None], y, y * y])
                own = (x * x / m - x**3 / m**2).sum(1)
            else:
                middle = b.mean(0)
                x, y = x - middle, b - middle
                left, right = np.hstack([one, -2 * x]), np.hstack([(y * y).sum(1)[:, None], y])
            # what rounding to 24 bits and adding up can change, twice over
            near = (left.shape[1] + 16) * 2.0**-23 * _norms(left) * _norms(right).max()
            if not np.isfinite(near).all() or np.abs(left).max() > 1e30 or np.abs(right).max() > 1e30:
                return
            self.gap, self.none = 2 * near, np.float32(np.inf)
            if metric == "chi_square":
                self.level = lambda lo, hi, t: t * (1 + 1e-9) - own[lo:hi] + near[lo:hi]
            self.left, self.right = left.astype(np.float32), np.ascontiguousarray(right.T.astype(np.float32))
        self.at, self.bt, self.a_size, self.b_size = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), a_size, b_size
        self.odd = ~fits

    def tile(self, lo: int, hi: int) -> np.ndarray:
        if self.metric != "manhattan":
            return self.left[lo:hi] @ self.right
        out = np.zeros((hi - lo, self.right.shape[1]), np.int16)
        step = max(1, (1 << 18) // (hi - lo))
        for at in range(0, out.shape[1], step):
            part = out[:, at : at + step]
            total, one = np.zeros(part.shape, np.int16), np.empty(part.shape, np.int16)
            for k in range(len(self.right)):
                np.subtract(self.left[lo:hi, k, None], self.right[k, at : at + step], out=one)
                np.abs(one, out=one)
                np.add(total, one, out=total)
            part[:] = total
        return out.view(np.uint16)  # sums of at most 65534

    def above(self, t: np.ndarray) -> np.ndarray:
        """The least numbers of the screen's kind that are not below t."""
        if self.metric == "manhattan":
            return np.clip(t, 0, 65534).astype(np.uint16)
        return np.nextafter(t.astype(np.float32), np.float32(np.inf))

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of pairs of rows, by the defining sums in the order of ``block_distances``."""
        found = [np.zeros(0)]
        for lo in range(0, len(i), PAIRS):
            p, q = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            out = np.zeros(len(p))
            for x, y in zip(self.at, self.bt):
                _added(self.metric, out, x[p], y[q])
            found.append(_distance(self.metric, out, self.a_size[p], self.b_size[q]))
        return np.concatenate(found)


def _first(row: np.ndarray, part: np.ndarray, d: np.ndarray, keep: int) -> np.ndarray:
    """Whether each of (row, part, d) is among its row's first ``keep`` by d and part."""
    order = np.lexsort((part, d, row))
    begins = np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1])) if len(row) else np.zeros(0, int)
    place = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
    out = np.zeros(len(row), bool)
    out[order[place < keep]] = True
    return out


def part_minima(metric: str, a: np.ndarray, b: np.ndarray, cuts: np.ndarray, keep: int | None = None, own: np.ndarray | None = None, theirs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, distance): the least distance of each row of a to the parts of b that begin at ``cuts``, NaN if any is.

    With ``keep`` only the first so many parts of a row, by distance and then in order, and those that are
    NaN. With ``own`` and ``theirs`` (a number for each row of a and of b) rows of equal numbers do not meet.
    """
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors must have the same dimension")
    screen = Screen(metric, a, b) if keep is not None else None
    odd = np.ones(len(a), bool) if screen is None else screen.odd
    rows, found = max(1, TILE // max(1, len(b))), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    part_of = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(b))))

    def least(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = i * len(cuts) + part_of[j]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        return i[at], part_of[j[at]], np.minimum.reduceat(d, at) if len(at) else d

    def kth(x: np.ndarray, none) -> np.ndarray:
        """The keep-th least of each row, or the last that is not none."""
        x = x.astype(float)
        x = np.partition(x, keep - 1, axis=1)[:, :keep] if keep < x.shape[1] else x
        return np.where(x >= none, -1e30, x).max(1)

    for lo in range(0, len(a), rows) if not odd.all() else ():
        hi = min(lo + rows, len(a))
        s = screen.tile(lo, hi)
        if own is not None:
            np.copyto(s, screen.none, where=theirs[None, :] == own[lo:hi, None])
        s[odd[lo:hi]] = screen.none
        top = kth(np.minimum.reduceat(s, cuts, axis=1), float(screen.none))

        def met(limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.divmod(np.flatnonzero(s <= screen.above(limit)[:, None]), s.shape[1])
            real = s[i, j] < screen.none
            return i[real] + lo, j[real]

        if screen.level is None:
            limit = np.where(top == -1e30, -1e30, top + screen.gap[lo:hi])
        else:  # the distances of the pairs first by their bounds say how far others can be
            i, part, d = least(*(p := met(top)), screen.distances(*p))
            far = np.full((hi - lo, len(cuts)), np.inf)
            far[i - lo, part] = d
            t = kth(far, np.inf)
            limit = np.where(top == -1e30, -1e30, screen.level(lo, hi, t))
        live = limit > -1e30
        i, j = met(np.where(live, limit, 0 if metric == "manhattan" else -1e30))
        ok = live[i - lo]
        i, part, d = least(i[ok], j[ok], screen.distances(i[ok], j[ok]))
        few = _first(i, part, d, keep)
        found.append((i[few], part[few], d[few]))
    rest, rows = np.flatnonzero(odd), max(1, rows // 2)
    for lo in range(0, len(rest), rows):
        at = rest[lo : lo + rows]
        d = block_distances(metric, a[at], b)
        if own is not None:
            d[own[at][:, None] == theirs[None, :]] = np.inf
        d = np.minimum.reduceat(d, cuts, axis=1)  # keeps NaN
        i, part = np.nonzero(~np.isposinf(d))
        d = d[i, part]
        few = _first(i, part, d, keep) | np.isnan(d) if keep is not None else slice(None)
        found.append((at[i[few]], part[few], d[few]))
    i, part, d = (np.concatenate(x) for x in zip(*found))
    return i, part, d


def dealt(n: int, m: int) -> tuple[int, int]:
    """Numbers of shards and of blocks for n rows of a gallery and m probes."""
    shards = max(1, -(-n // SHARD))
    return shards, max(1, -(-m // BLOCK), min(-(-m // 1024), -(-GROUPS // shards)))


def nearest_by_identity(probes: DataFrame, gallery: DataFrame, metric: str = "euclidean", fold: str | None = None, keep: int | None = None) -> DataFrame:
    """(probe_id, identity, distance[, fold]): least distance of each probe to each identity's samples; NaN if any is NaN.

    probes (probe_id, v), gallery (identity, v), identities as text. With ``fold`` both have that column,
    and a probe of a fold meets the samples of all other folds. With ``keep`` only each probe's first ``keep``
    by distance and identity, and those that are NaN, return. A task returns a probe's first ``keep`` of its shard:
    where an identity among the first has its nearest sample, fewer than ``keep`` others are nearer. Identities of
    more than a shard's samples are spread over all shards.
    """
    ship(probes.sparkSession)
    own = gallery.withColumn("identity", F.col("identity").cast("string"))
    sizes = own.groupBy("identity").count()
    counted = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).crossJoin(probes.agg(F.count("*")))  # one row each
    n, most, m = counted.collect()[0]
    shards, blocks = dealt(n, m)
    if keep is None:
        own = own.withColumn("spread", F.lit(True))
    elif most <= SHARD:
        own = own.withColumn("spread", F.lit(False))
    else:
        own = own.join(sizes.where(F.col("count") > SHARD).select("identity", F.lit(True).alias("spread")), "identity", "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
    f = (F.col(fold) if fold else F.lit(0)).cast("long")
    kind = dict(probes.dtypes)["probe_id"]
    left = probes.select("probe_id", F.col("v").alias("pv"), f.alias("pf"), F.pmod(F.xxhash64("probe_id"), F.lit(blocks)).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("ps"))
    shard = F.pmod(F.xxhash64("identity", F.when(F.col("spread"), F.col("v"))), F.lit(shards)).cast("int")
    right = own.select("identity", F.col("v").alias("gv"), f.alias("gf"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("gb"), shard.alias("gs"))

    def least(key, p, g):
        names = ["probe_id", "identity", "distance", "fold"]
        if not p.num_rows or not g.num_rows:
            return pa.table([p.column("probe_id").slice(0, 0), pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)
        who, where = coded(g.column("identity"))
        order = np.argsort(where, kind="stable")
        where, b = where[order], matrix(g.column("gv"))[order]
        ids, a, pf = p.column("probe_id").combine_chunks(), matrix(p.column("pv")), p.column("pf").to_numpy()
        cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        i, j, d = part_minima(metric, a, b, cuts, keep, *((pf, g.column("gf").to_numpy()[order]) if fold else ()))
        return pa.table([ids.take(pa.array(i)), pa.array(who).take(pa.array(j)), pa.array(d), pa.array(pf[i], pa.int64())], names=names)

    groups = min(4096, 2 * shards * blocks)  # so that few pairs of a block and a shard share a task
    left, right = left.repartition(groups, "pb", "ps"), right.repartition(groups, "gb", "gs")
    part = left.groupBy("pb", "ps").cogroup(right.groupBy("gb", "gs")).applyInArrow(least, f"probe_id {kind}, identity string, distance double, fold long")
    nan = F.max(F.isnan("distance"))
    out = part.groupBy("probe_id", "identity", "fold").agg(F.when(nan, F.lit(float("nan"))).otherwise(F.min("distance")).alias("distance"))
    if keep is not None:  # what a shard returns of an identity that is not among the first may not be its least
        out = out.withColumn("_rn", F.row_number().over(_by([]))).where((F.col("_rn") <= keep) | F.isnan("distance")).drop("_rn")
    return out.withColumn("fold", F.col("fold").cast(dict(probes.dtypes)[fold])) if fold else out.drop("fold")


def nearest_of_own(probes: DataFrame, gallery: DataFrame, label: str, metric: str = "euclidean") -> DataFrame:
    """(probe_id, distance): least distance of each probe (probe_id, label, v) to the samples (label, v) of its own label.

    Probes without such samples have no row; NaN counts as farther than all others. Blocks of a
    label's probes meet shards of its samples, as in ``nearest_by_identity``.
    """
    ship(probes.sparkSession)
    p, g = (t.where(F.col(label).isNotNull() & F.col("v").isNotNull()) for t in (probes, gallery))
    most = lambda t: t.groupBy(label).count().agg(F.max("count"))
    m, n = most(p).crossJoin(most(g)).collect()[0]  # one row each
    shards, blocks = dealt(n or 0, m or 0)
    kind = dict(probes.dtypes)["probe_id"]
    left = p.select("probe_id", F.col("v").alias("pv"), F.col(label).alias("pl"), F.pmod(F.xxhash64("probe_id"), F.lit(blocks)).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("ps"))
    right = g.select(F.col("v").alias("gv"), F.col(label).alias("gl"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("gb"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("gs"))

    def least(key, p, g):
        if not p.num_rows or not g.num_rows:
            return pa.table([p.column("probe_id").slice(0, 0), pa.array([], pa.float64())], names=["probe_id", "distance"])
        ids, a, b = p.column("probe_id").combine_chunks(), matrix(p.column("pv")), matrix(g.column("gv"))
        if np.isfinite(a).all() and np.isfinite(b).all():
            i, _, d = part_minima(metric, a, b, np.zeros(1, int), 1)
            return pa.table([ids.take(pa.array(i)), pa.array(d)], names=["probe_id", "distance"])
        rows = max(1, TILE // 2 // len(b))
        d = [np.fmin.reduce(block_distances(metric, a[lo : lo + rows], b), axis=1) for lo in range(0, len(a), rows)]
        return pa.table([ids, pa.array(np.concatenate(d))], names=["probe_id", "distance"])

    part = left.groupBy("pl", "pb", "ps").cogroup(right.groupBy("gl", "gb", "gs")).applyInArrow(least, f"probe_id {kind}, distance double")
    return part.groupBy("probe_id").agg(F.min("distance").alias("distance"))


def centroids(gallery: DataFrame, label: str = "identity", vec: str = "v") -> DataFrame:
    """(label, v): mean vector of each label; partial sums by component before the shuffle."""
    each = gallery.select(label, F.posexplode(vec).alias("_p", "_x"))
    mean = each.groupBy(label, "_p").agg(F.avg("_x").alias("_m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("v"))


def _by(extra: list[str]) -> Window:
    return Window.partitionBy("probe_id", *extra).orderBy("distance", "identity")


def accepted(d: Column, threshold: float, metric: str, scale: float | None = None) -> Column:
    """Confidence is not below the threshold; NaN is not below anything."""
    c = confidence(d, metric, scale)
    return F.isnan(d) | ~(c < F.lit(threshold))


def classify(distances: DataFrame, threshold: float, metric: str = "euclidean", k: int = 5, scale: float | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """probe_id, status, identity, confidence, distance, alternatives.

    The nearest identity is accepted or not; it is no vote. Accepted: the
    alternatives are the next k - 1; otherwise the first k and no best one.
    """
    ranked = distances.withColumn("rn", F.row_number().over(_by([*extra]))).where(F.col("rn") <= max(k, 1)).withColumn("confidence", confidence(F.col("distance"), metric, scale))
    entry = F.struct("rn", "identity", "confidence", "distance")
    got = ranked.groupBy("probe_id", *extra).agg(F.array_sort(F.collect_list(entry)).alias("top")).withColumn("best", F.element_at("top", 1))
    ok = accepted(F.col("best.distance"), threshold, metric, scale)
    rest = F.when(ok, F.slice("top", 2, max(k - 1, 1))).otherwise(F.slice("top", 1, max(k, 1)))
    return got.select("probe_id", *extra, F.when(ok, "RECOGNIZED").otherwise("UNKNOWN").alias("status"), F.when(ok, F.col("best.identity")).alias("identity"), F.when(ok, F.col("best.confidence")).otherwise(0.0).alias("confidence"), F.when(ok, F.col("best.distance")).alias("distance"), rest.alias("alternatives"))


def top_matches(distances: DataFrame, n: int, threshold: float, metric: str = "euclidean", scale: float | None = None) -> DataFrame:
    """probe_id, rn, identity, distance, confidence, status: the first n (at least one); status is that of the nearest."""
    out = distances.withColumn("rn", F.row_number().over(_by([]))).where(F.col("rn") <= max(n, 1))
    best = F.min("distance").over(Window.partitionBy("probe_id"))
    return out.withColumn("confidence", confidence(F.col("distance"), metric, scale)).withColumn("status", F.when(accepted(best, threshold, metric, scale), "RECOGNIZED").otherwise("UNKNOWN"))


def top_alternatives(alternatives: Column, n: int, min_confidence: float | None = None) -> Column:
    """The n of most confidence; the floor is applied after the limit."""
    out = F.slice(F.array_sort(alternatives, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)), 1, n)
    return F.filter(out, lambda a: a["confidence"] >= min_confidence) if min_confidence is not None else out


def predictions(distances: DataFrame, truth: DataFrame, threshold: float, metric: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """probe_id, actual, predicted ("UNKNOWN" if none), confidence, distance (null if none) of probes with a truth."""
    got = classify(distances, threshold, metric, 1, extra=extra)
    return truth.select("probe_id", "actual", *extra).join(got, ["probe_id", *extra]).select("probe_id", *extra, "actual", F.coalesce("identity", F.lit("UNKNOWN")).alias("predicted"), "confidence", "distance")


def status_flags(status: Column) -> dict[str, Column]:
    """What a result's status says: recognised, a face was found at all, an error."""
    return {"recognized": status == "RECOGNIZED", "detected": status.isin("RECOGNIZED", "UNKNOWN"), "failed": status == "ERROR"}


def known_distance(d: Column) -> Column:
    """The distance, or the largest double where there was nothing to compare with."""
    return F.coalesce(d, F.lit(1.7976931348623157e308))


def leave_one_out(samples: DataFrame, key: str, label: str, vector: str, metric: str) -> DataFrame:
    """(key, actual, predicted): each sample by the nearest identity of all the others.

    Every sample is a fold of its own, so blocks meet shards as in any
    cross-validation and only an identity's least distance leaves a task. Keys are whole numbers of up to 64 bits.
    """
    own = samples.select(F.col(key).alias("probe_id"), F.col(label).alias("actual"), F.col(vector).alias("v"), F.col(key).cast("long").alias("fold"))
    found = nearest_by_identity(own.select("probe_id", "v", "fold"), own.select(F.col("actual").alias("identity"), "v", "fold"), metric, "fold", 1)
    best = found.groupBy("probe_id").agg(F.min_by("identity", F.struct("distance", "identity")).alias("predicted"))
    return own.select("probe_id", "actual").join(best, "probe_id").select(F.col("probe_id").alias(key), "actual", "predicted")


__all__ = ["SCALES", "accepted", "block_distances", "centroids", "classify", "nearest_by_identity", "nearest_of_own", "part_minima", "predictions", "top_alternatives", "top_matches"]
