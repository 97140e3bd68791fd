"""Enrol, train, recognise and evaluate: the flows that a user calls, on DataFrames.

A ``Registry`` holds three tables and a fitted extractor, all immutable: every
call returns a new one. Images are rows (label or probe_id, width, height,
channels, data); extractors and detectors are chosen by name and can be added.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from likeness.operators import curves as C, gallery as G, images as I, matching as M, metrics as E, order as O
from likeness.operators.haar import Cascade, detect
from likeness.operators.models import EXTRACTORS, Subspace
from likeness.sources import images as S
from likeness.sources.store import Snapshots
from likeness.runtime import table  # noqa: F401  part of the surface

#: Detectors by name: raster, settings -> boxes, most confident first.
DETECTORS: dict[str, Callable[..., list[dict]]] = {"none": lambda img: [], "skin": lambda img, **how: I.skin_regions(img, **how) if img.ndim == 3 else [], "haar": lambda img, cascade, **how: detect(img, cascade, **how)}
SIZE = (48, 64)


def preprocess(img: np.ndarray, detector: str = "none", size: tuple[int, int] = SIZE, align: bool = False, required: bool = False, cascade: Cascade | None = None, equalize: bool = False, options: dict | None = None) -> np.ndarray | None:
    """Largest region, cropped, aligned, scaled and grey, and equalised if so wanted. Without a detector the image passes through.

    Where none is found the whole image is used, or None returned if one is ``required``. ``options`` are the detector's.
    """
    done = I.equalize if equalize else lambda g: g
    if detector != "none":
        how = options or {}
        found = DETECTORS[detector](img, cascade, **how) if detector == "haar" else DETECTORS[detector](img, **how)
        if found:
            r = max(found, key=lambda b: b["w"] * b["h"])
            if align:
                return done(I.align_region(img, r["x"], r["y"], r["w"], r["h"], *size))
            img = I.crop(img, r["x"], r["y"], r["w"], r["h"])
        elif required:
            return None
    return done(I.resize(I.gray(img), *size))


def raw_features(images: DataFrame, key: str, algorithm: str, patterns: dict | None = None, **how) -> DataFrame:
    """(key, v, quality, error): the features of the algorithm's extractor (``patterns``: its options). A failing image stays, with its error."""
    extractor = EXTRACTORS[algorithm]

    def one(img: np.ndarray) -> dict:
        g = preprocess(img, **how)
        if g is None:
            raise ValueError("no face detected")
        v = np.asarray(extractor.features(g, **(patterns or {})))
        return {"v": v.tolist(), "quality": float(I.quality(img)["score"])}

    return I.map_images(images, one, "v array<double>, quality double", key)


@dataclass(frozen=True)
class Registry:
    """identities (id, name, external_id, active), images (identity id, sample_id, raster columns), and after training samples and model."""

    spark: SparkSession
    identities: DataFrame
    images: DataFrame
    samples: DataFrame | None = None
    model: Subspace | None = None
    algorithm: str = "pca"
    error: str | None = None

    def enroll(self, images: DataFrame) -> Registry:
        """Rows (name, sample_id, width, height, channels, data): known names keep their identity, others get one; training is then due."""
        fresh = images.select("name").distinct().withColumn("id", F.sha2("name", 256)).withColumn("external_id", F.lit(None).cast("string")).withColumn("active", F.lit(True))
        everyone = G.upsert(self.identities, fresh.select(*self.identities.columns))
        own = images.join(everyone.select("id", "name"), "name").select(F.col("id").alias("identity_id"), "sample_id", "width", "height", "channels", "data")
        return replace(self, identities=everyone, images=self.images.unionByName(own), samples=None, model=None)

    def deactivate(self, ids: DataFrame) -> Registry:
        return replace(self, identities=G.soft_delete(self.identities, ids))

    def update(self, changes: DataFrame) -> Registry:
        stamped = self.identities.withColumn("updated_at", F.lit(None).cast("timestamp"))
        return replace(self, identities=G.updated(stamped, changes).drop("updated_at"))

    def train(self, components: int = 10, min_quality: float | None = None, force: bool = False, **how) -> Registry:
        """Fit on all enrolled images and make the gallery anew. A no-op if trained, unless forced; an error without images."""
        if self.samples is not None and not force:
            return self
        keyed = self.images.withColumn("key", F.concat_ws("|", "identity_id", "sample_id"))
        raw = raw_features(keyed, "key", self.algorithm, **how).where(F.col("error").isNull())
        if min_quality is not None:
            raw = raw.where(F.col("quality") >= min_quality)
        raw = raw.select(F.substring_index("key", "|", 1).alias("identity_id"), F.substring_index("key", "|", -1).alias("sample_id"), "v", "quality")
        if raw.isEmpty():
            raise ValueError("there is nothing to train on")
        fit = EXTRACTORS[self.algorithm].fit
        if fit is None:
            return replace(self, samples=raw.withColumnRenamed("v", "features"))
        model = fit(raw, "v", "identity_id", components)
        return replace(self, samples=model.transform(raw).drop("v"), model=model)

    def status(self) -> DataFrame:
        """state, identities, images."""
        counts = self.identities.agg(F.count("*").alias("identities")).crossJoin(self.images.agg(F.count("*").alias("images")))  # one row each
        return counts.withColumn("state", G.model_state(F.lit(False), F.lit(self.error is not None), F.lit(self.samples is not None), F.col("images")))

    def gallery(self, averaged: bool = False) -> DataFrame:
        """(identity, v) of active identities; ``averaged``: one mean vector each."""
        if self.samples is None:
            raise ValueError("the registry is not trained")
        live = self.samples.join(G.active(self.identities).select(F.col("id").alias("identity_id")), "identity_id", "left_semi")
        out = live.select(F.col("identity_id").alias("identity"), F.col("features").alias("v"))
        return M.centroids(out) if averaged else out

    def recognize(self, probes: DataFrame, threshold: float = 0.6, k: int = 5, metric: str = "euclidean", scale: float | None = None, averaged: bool = False, features: bool = False, **how) -> DataFrame:
        """Rows (probe_id, raster): status, identity id and name, confidence, distance, alternatives, error.

        An image that fails has status ERROR, one without a face NO_FACE_DETECTED; both stay in the result.
        """
        raw = raw_features(probes, "probe_id", self.algorithm, required=True, **how)
        good = raw.where(F.col("error").isNull()).select("probe_id", "v")
        own = good if self.model is None else self.model.transform(good).select("probe_id", F.col("features").alias("v"))
        got = M.classify(M.nearest_by_identity(own, self.gallery(averaged), metric, keep=max(k, 1)), threshold, metric, k, scale)
        names = self.identities.select(F.col("id").alias("identity"), "name")
        out = raw.select("probe_id", "error").join(got, "probe_id", "left").join(names, "identity", "left")
        status = F.when(F.col("error").contains("no face"), "NO_FACE_DETECTED").when(F.col("error").isNotNull(), "ERROR").otherwise(F.coalesce("status", F.lit("UNKNOWN")))
        out = out.select("probe_id", status.alias("status"), "identity", "name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "distance", "alternatives", "error")
        return out.join(own.withColumnRenamed("v", "features"), "probe_id", "left") if features else out


    def recognize_folder(self, path: str, kind: str = "custom", threshold: float = 0.6, k: int = 5, metric: str = "euclidean", reader: dict | None = None, **how) -> DataFrame:
        """Results of all image files under a folder, with ``expected``, the label that the folder's layout gives.

        One plan from the files to the results. probe_id is the path; a file that cannot be decoded stays, with status ERROR.
        """
        found = S.read(self.spark, path, kind, size=None, to_gray=False, keep_bad=True, **(reader or {}))
        probe = F.struct(F.col("path"), F.col("label").alias("expected"))  # travels with the picture, which is decoded once
        got = self.recognize(found.select(probe.alias("probe_id"), "width", "height", "channels", "data"), threshold, k, metric, **how)
        return got.select("probe_id.path", "probe_id.expected", *[c for c in got.columns if c != "probe_id"]).withColumnRenamed("path", "probe_id")

    def snapshot(self, to: Snapshots, name: str) -> int:
        """Keep identities, images, samples and model under a name, all at once."""
        if self.samples is None:
            raise ValueError("the registry is not trained")
        tables = {"identities": self.identities, "images": self.images, "samples": self.samples}
        if self.model is not None:
            m = self.model
            rows = [(-1, m.mean.tolist(), 0.0, 0.0), *((i, m.axes[:, i].tolist(), float(m.values[i]), float(m.ratio[i])) for i in range(m.axes.shape[1]))]
            tables["model"] = self.spark.createDataFrame(rows, "i int, v array<double>, value double, ratio double")
        return to.publish(name, tables, {"algorithm": self.algorithm, "normalise": self.model.normalise if self.model else None})

    def train_on_pairs(self, pairs: DataFrame, components: int = 10, **how) -> Subspace:
        """The extractor fitted on the pictures of verification pairs; the registry stays as it is.

        pairs (a, b): keys of pictures, "identity id|sample id". A picture counts as often as it occurs, by its
        weight; it is read and kept once. Keys without a picture are ignored.
        """
        fit = EXTRACTORS[self.algorithm].fit
        if fit is None:
            raise ValueError(f"{self.algorithm} is not trained")
        times = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("weight"))
        keyed = self.images.withColumn("key", F.concat_ws("|", "identity_id", "sample_id")).join(times.select("key"), "key", "left_semi")
        raw = raw_features(keyed, "key", self.algorithm, **how).where(F.col("error").isNull()).join(times, "key")
        return fit(raw.withColumn("label", F.substring_index("key", "|", 1)), "v", "label", components, "weight")


def restored(spark: SparkSession, kept: Snapshots, name: str, version: int | None = None) -> Registry | None:
    """The registry of a snapshot, the last one unless a version is named; nothing where there is none."""
    found = kept.read(name, version)
    if found is None:
        return None
    info, tables = found
    model = None
    if "model" in tables:
        rows = sorted(tables["model"].collect(), key=lambda r: r["i"])
        axes = np.array([r["v"] for r in rows[1:]]).T if len(rows) > 1 else np.zeros((len(rows[0]["v"]), 0))
        model = Subspace(np.array(rows[0]["v"]), axes, np.array([r["value"] for r in rows[1:]]), np.array([r["ratio"] for r in rows[1:]]), info["algorithm"], info["normalise"])
    return Registry(spark, tables["identities"], tables["images"], tables["samples"], model, info["algorithm"])


def validation(results: DataFrame) -> DataFrame:
    """correct, total, no_face, errors and accuracy (percent) of results with ``expected``; files in error do not count in the total."""
    s = F.col("status")
    right = (s == "RECOGNIZED") & F.col("name").eqNullSafe(F.col("expected"))
    counts = results.agg(F.count_if(right).alias("correct"), F.count_if(s != "ERROR").alias("total"), F.count_if(s == "NO_FACE_DETECTED").alias("no_face"), F.count_if(s == "ERROR").alias("errors"))
    return counts.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") * 100.0 / F.col("total")).otherwise(0.0))


def registry(spark: SparkSession, algorithm: str = "pca") -> Registry:
    people = spark.createDataFrame([], "id string, name string, external_id string, active boolean")
    images = spark.createDataFrame([], "identity_id string, sample_id string, width int, height int, channels int, data binary")
    return Registry(spark, people, images, algorithm=algorithm)


def summary(results: DataFrame) -> DataFrame:
    """n and percent of each status."""
    from pyspark.sql import Window

    out = results.groupBy("status").agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


# ------------------------------------------------------------------ evaluation
def evaluate(samples: DataFrame, metric: str = "euclidean", ratio: float = 0.7, threshold: float = 0.0, seed: int = 42) -> dict[str, DataFrame]:
    """Split (id, identity, v), match the test rows against the train rows, and measure: predictions and their metrics by name."""
    rows = O.holdout(samples, "id", ratio, seed)
    probes = rows.where(~F.col("is_train")).select(F.col("id").alias("probe_id"), F.col("identity").cast("string").alias("actual"), "v")
    d = M.nearest_by_identity(probes, rows.where("is_train").select("identity", "v"), metric, keep=1)
    p = M.predictions(d, probes, threshold, metric)
    points = E.curve_points(p)
    return {"predictions": p, "macro": E.macro(p), "matrix": E.macro_matrix(p), "micro": E.micro(p), "confusion": E.confusion(p), "classes": E.class_metrics(E.class_counts(p)), "roc": E.roc(points), "auc": E.auc(points), "eer": E.equal_error(points)}


def cross_validate(samples: DataFrame, k: int = 5, metric: str = "euclidean", stratified: bool = True, seed: int = 42) -> DataFrame:
    """Metrics by fold; all folds in one job."""
    rows = O.stratified_k_fold(samples, "id", "identity", k, seed) if stratified else O.k_fold(samples, "id", k, seed)
    p = rows.select(F.col("id").alias("probe_id"), F.col("identity").cast("string").alias("actual"), "v", "fold")
    d = M.nearest_by_identity(p, rows.select("identity", "v", "fold"), metric, fold="fold", keep=1)
    return E.macro(M.predictions(d, p, 0.0, metric, extra=("fold",)), ("fold",))


def learning_curve(samples: DataFrame, ratios: list[float], metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """Metrics by train share of one seeded order; each pair of rows is compared once for all shares."""
    return C.learning_curve(samples, ratios, metric, seed)


def timings(action: Callable[[], object], runs: int = 10, warm_up: int = 2) -> list[float]:
    """Milliseconds of each run after the warm-up."""
    out = []
    for i in range(warm_up + runs):
        began = time.perf_counter()
        action()
        if i >= warm_up:
            out.append((time.perf_counter() - began) * 1000)
    return out


def scalability(samples: DataFrame, sizes: list[int], metric: str = "euclidean", runs: int = 3) -> DataFrame:
    """Timing statistics of matching one probe against the first sample of the first g identities."""
    spark = samples.sparkSession
    first = samples.groupBy("identity").agg(F.min_by("v", "id").alias("v"))
    probe = samples.orderBy("id").limit(1).select(F.col("id").alias("probe_id"), "v")
    rows = []
    for g in sizes:
        few = first.orderBy("identity").limit(g)
        rows += [(g, t) for t in timings(lambda: M.nearest_by_identity(probe, few, metric).collect(), runs, 1)]
    return E.timing_stats(spark.createDataFrame(rows, "size int, ms double"), "ms", ("size",))
