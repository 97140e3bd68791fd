"""Subspace models of feature vectors: principal components and discriminants.

Means and scatter matrices are sums of products, aggregated where the data is;
only matrices of dimension by dimension reach the driver, for their
eigenvectors. Projection runs over Arrow batches with the fitted matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from likeness.operators.images import lbp_histogram
from likeness.runtime import ship

LEAST_EIGENVALUE = 1e-4


def mean_vector(df: DataFrame, vec: str = "v") -> DataFrame:
    """(p, m): mean of each component."""
    return df.select(F.posexplode(vec).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))


#: Rows of a scatter matrix in one block of it.
_BLOCK = 64


@dataclass
class Moments:
    """Rows n, labels k, the sums of x, of x x^T, and over the labels of n m m^T (m: the label's mean)."""

    n: float
    k: int
    total: np.ndarray
    outer: np.ndarray
    own: np.ndarray


def moments(df: DataFrame, vec: str = "v", by: str | None = None, weight: str | None = None) -> Moments:
    """Sums of the vectors and their products; with ``weight`` a row counts as so many equal ones (0: not at all).

    Each task adds up its own rows, by label within a batch and all products
    together. Partial sums are dealt by label, sorted, and added one label after
    another; what is left are matrices, dealt by blocks of rows. So no task holds
    more than one batch's labels and two matrices, and the driver gets two,
    whatever the number of labels.
    """
    ship(df.sparkSession)
    label = F.col(by).cast("string") if by else F.lit("")
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    src = df.select(label.alias("label"), F.col(vec).cast("array<double>").alias("v"), times.alias("times")).where("times > 0")
    schema = "kind string, label string, block int, data binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.binary()))], names=names)

    def matrix(kind: str, m: np.ndarray) -> list[tuple]:
        return [(kind, None, at // _BLOCK, m[at : at + _BLOCK].tobytes()) for at in range(0, len(m), _BLOCK)]

    def run(batches):
        outer = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            w = b.column(2).to_numpy().astype(float)
            names_, at = np.unique(np.array(["" if k is None else "=" + k for k in b.column(0).to_pylist()], object), return_inverse=True)
            sums = np.zeros((len(names_), x.shape[1] + 1))
            np.add.at(sums, at, np.column_stack([w, x * w[:, None]]))
            part = x.T @ (x * w[:, None])
            outer = part if outer is None else outer + part
            yield rows([("label", k, -1, v.tobytes()) for k, v in zip(names_.tolist(), sums)])
        if outer is not None:
            yield rows(matrix("outer", outer))

    def by_label(batches):
        own = total = last = held = None
        labels = 0
        found: list[tuple] = []

        def close():
            nonlocal own, total, labels
            if held is not None:
                m = np.outer(held[1:], held[1:]) / held[0]
                own, total = (m, held.copy()) if own is None else (own + m, total + held)
                labels += 1

        for b in batches:
            for kind, k, block, data in zip(*(c.to_pylist() for c in b.columns)):
                v = np.frombuffer(data)
                if kind != "label":
                    found.append((kind, None, block, data))
                elif held is not None and k == last:
                    held = held + v
                else:
                    close()
                    last, held = k, v
            if found:
                yield rows(found)
                found = []
        close()
        if own is not None:
            yield rows([*matrix("own", own), ("total", None, 0, np.append(total, labels).tobytes())])

    def add(key, t):
        total = sum(np.frombuffer(x) for x in t.column("data").to_pylist())
        return pa.Table.from_batches([rows([(key[0].as_py(), None, key[1].as_py(), total.tobytes())])])

    dealt = src.mapInArrow(run, schema).repartition("kind", "label", "block").sortWithinPartitions("kind", "label")
    got = dealt.mapInArrow(by_label, schema).groupBy("kind", "block").applyInArrow(add, schema).collect()
    if not got:
        raise ValueError("there are no vectors")
    parts = {k: np.concatenate([np.frombuffer(bytes(r["data"])) for r in sorted((r for r in got if r["kind"] == k), key=lambda r: r["block"])]) for k in ("total", "outer", "own")}
    total = parts["total"]
    d = len(total) - 2
    return Moments(total[0], int(total[-1]), total[1:-1], parts["outer"].reshape(d, d), parts["own"].reshape(d, d))


def scatter(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Mean, scatter within labels, scatter between labels, and the number of rows."""
    mean = m.total / m.n
    return mean, m.outer - m.own, m.own - m.n * np.outer(mean, mean), int(m.n)


def _few(df: DataFrame, vec: str, by: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """All vectors and labels where there are fewer of them than components, else nothing."""
    head = df.select(F.size(vec).alias("d")).limit(1).collect()
    if not head:
        raise ValueError("there are no vectors")
    d = head[0]["d"]
    rows = df.select(F.col(vec).alias("v"), (F.col(by).cast("string") if by else F.lit("")).alias("label")).limit(d).collect()
    return None if len(rows) == d else (np.array([r["v"] for r in rows], float), np.array([r["label"] for r in rows], object))


def signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the component of largest size is positive."""
    at = np.abs(v).argmax(0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1, 1)


@dataclass
class Subspace:
    """A fitted projection: mean (d), axes (d, k), eigenvalues (k) and their share of the whole."""

    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    ratio: np.ndarray
    algorithm: str = "pca"
    normalise: bool = True
    extra: dict = field(default_factory=dict)

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.axes
        if self.normalise:
            size = np.sqrt((y * y).sum(1, keepdims=True))
            y = y / np.where(size == 0, 1, size)
        return y

    def reconstruct(self, y: np.ndarray) -> np.ndarray:
        return self.mean + y @ self.axes.T

    def component(self, i: int) -> np.ndarray:
        if not 0 <= i < self.axes.shape[1]:
            raise IndexError(f"no component {i}")
        return self.axes[:, i].copy()

    def transform(self, df: DataFrame, vec: str = "v", out: str = "features") -> DataFrame:
        """All columns, and the projected vector."""
        ship(df.sparkSession)
        model = self

        def run(batches):
            for b in batches:
                col = b.column(b.schema.get_field_index(vec))
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(model.mean)))
                y = model.project(x.astype(float))
                offs = np.arange(0, y.size + 1, max(y.shape[1], 1)).astype(np.int32)[: b.num_rows + 1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offs), pa.array(y.ravel()))], names=[*b.schema.names, out])

        from pyspark.sql.types import ArrayType, DoubleType, StructType

        return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, ArrayType(DoubleType())))


def fit_pca(df: DataFrame, components: int, vec: str = "v", normalise: bool = True, weight: str | None = None) -> Subspace:
    """Eigenvectors of the scatter about the mean, by falling eigenvalue; eigenvalues up to 1e-4 are dropped. With ``weight`` a row counts as so many equal ones."""
    few = None if weight else _few(df, vec, None)
    if few:  # the eigenvectors of the small side
        n, mean = len(few[0]), few[0].mean(0)
        _, size, axes = np.linalg.svd(few[0] - mean, full_matrices=False)
        w, v = size**2, axes.T
    else:
        mean, within, between, n = scatter(moments(df, vec, None, weight))
        w, v = np.linalg.eigh(within + between)
        order = np.argsort(-w, kind="stable")
        w, v = w[order], v[:, order]
    live = w > LEAST_EIGENVALUE
    whole = w[live].sum()
    k = min(components, int(live.sum()))
    return Subspace(mean, signed(v[:, :k]), w[:k], w[:k] / whole if whole else w[:k], "pca", normalise, {"n": n})


def fit_pca_wide(df: DataFrame, components: int, vec: str = "v", normalise: bool = True, over: int = 10, rounds: int = 60, tolerance: float = 1e-12) -> Subspace:
    """``fit_pca`` for vectors so long that dimension by dimension is too much for a driver: only dimension by ``components`` + ``over`` reaches it.

    Subspace iteration on the rows: a round sends the current axes to all tasks,
    adds up each row times its projections, dealt by blocks of components, and
    makes the sum orthonormal. It ends when no wanted eigenvalue moves by more
    than ``tolerance`` of the first, or after ``rounds``.
    """
    ship(df.sparkSession)
    src = df.select(F.col(vec).cast("array<double>").alias("v"))
    means = src.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("n")).orderBy("p").collect()
    if not means:
        raise ValueError("there are no vectors")
    n, mean = means[0]["n"], np.array([r["m"] for r in means])
    whole = sum(r["q"] for r in means) - n * float(mean @ mean)
    d = len(mean)
    width = min(d, n, components + over)
    axes = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))[0]
    values = np.zeros(width)

    def pushed(axes: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros((d, width))
            for b in batches:
                if b.num_rows:
                    z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean
                    total += z.T @ (z @ axes)
            for at in range(0, d, _BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at // _BLOCK], pa.int32()), pa.array([total[at : at + _BLOCK].tobytes()])], names=["block", "data"])

        def add(key, t):
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": [sum(np.frombuffer(x) for x in t.column("data").to_pylist()).tobytes()]})

        rows = src.mapInArrow(run, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary").collect()
        return np.concatenate([np.frombuffer(x).reshape(-1, width) for _, x in sorted((r["block"], bytes(r["data"])) for r in rows)])

    for _ in range(rounds):
        got = pushed(axes)
        w, u = np.linalg.eigh(axes.T @ got)
        order = np.argsort(-w, kind="stable")
        w, ritz = w[order], axes @ u[:, order]
        moved, values = np.abs(w - values)[:components].max(), w
        if moved <= tolerance * max(w[0], 1e-300):
            break
        axes = np.linalg.qr(got @ u[:, order])[0]
    k = min(components, int((values > LEAST_EIGENVALUE).sum()))
    return Subspace(mean, signed(ritz[:, :k]), values[:k], values[:k] / whole if whole > 0 else values[:k], "pca", normalise, {"n": n})


def fit_lda(df: DataFrame, label: str, components: int, vec: str = "v", normalise: bool = True, weight: str | None = None) -> Subspace:
    """Discriminants in the space of the first n - c principal components; at least two labels. With ``weight`` a row counts as so many equal ones."""
    few = None if weight else _few(df, vec, label)
    if few:
        x, names = few
        means = {k: (int((names == k).sum()), x[names == k].mean(0)) for k in sorted(set(names.tolist()))}
        n, k, mean = len(x), len(means), x.mean(0)
        base = np.linalg.svd(x - mean, full_matrices=False)[2].T
    else:
        m = moments(df, vec, label, weight)
        k = m.k
        mean, within, between, n = scatter(m)
        w, v = np.linalg.eigh(within + between)
        base = v[:, np.argsort(-w, kind="stable")]
    if k < 2:
        raise ValueError("discriminants need at least two labels")
    base = signed(base[:, : min(n - k, len(mean))])
    if few:
        within_rows = (x - np.array([means[x_][1] for x_ in names.tolist()])) @ base
        off = np.array([np.sqrt(c) * (mu - mean) for c, mu in means.values()]) @ base
        sw, sb = within_rows.T @ within_rows, off.T @ off
    else:
        sw, sb = base.T @ within @ base, base.T @ between @ base
    for ridge in (1e-6, 1e-3):
        try:
            val, vec_ = np.linalg.eig(np.linalg.solve(sw + ridge * np.eye(len(sw)), sb))
            break
        except np.linalg.LinAlgError:
            continue
    else:
        raise ValueError("the scatter within labels cannot be inverted")
    order = np.argsort(-val.real, kind="stable")[: min(components, k - 1)]
    val, axes = val.real[order], base @ vec_.real[:, order]
    total = np.abs(val).sum()
    return Subspace(mean, signed(axes), val, val / total if total else val, "lda", normalise, {"n": n, "labels": k})


def restored(df: DataFrame, model: Subspace, features: str = "features", out: str = "restored") -> DataFrame:
    """All columns, and the vector that the features stand for (of a model that does not normalise): the mean and the axes times them, in JVM expressions."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in model.axes.tolist()])
    dot = lambda r: F.aggregate(F.zip_with(r, F.col(features), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, F.zip_with(F.array(*map(F.lit, model.mean.tolist())), F.transform(rows, dot), lambda m, x: m + x))


def cumulative(model: Subspace) -> np.ndarray:
    return model.ratio.cumsum()


@dataclass(frozen=True)
class Extractor:
    """How features come about: ``features`` of one grey raster, and ``fit`` of a model on the features of all, if there is one to fit.

    ``fit`` takes (rows, vector column, label column, components, weight column or None).
    """

    features: Callable[..., np.ndarray]
    fit: Callable[..., Subspace] | None = None


def pixel_values(g: np.ndarray) -> np.ndarray:
    return g.astype(float).ravel()


#: Extractors by name. More can be added: a registry asks for the one of its algorithm's name.
EXTRACTORS: dict[str, Extractor] = {
    "pca": Extractor(pixel_values, lambda df, vec, label, k, weight=None: fit_pca(df, k, vec, weight=weight)),
    "lda": Extractor(pixel_values, lambda df, vec, label, k, weight=None: fit_lda(df, label, k, vec, weight=weight)),
    "lbph": Extractor(lbp_histogram),
}


def deep_extractor(path: str):
    """A slot for a network file: a blank path is an error; no network comes with the package."""
    if not (path or "").strip():
        raise ValueError("no model file is configured")
    raise NotImplementedError("deep extraction needs a network file and its own pre-processing")
