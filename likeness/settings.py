"""Which detector, extractor, metric and limits a registry works with, chosen by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from likeness import api
from likeness.functions.vectors import SCALES
from likeness.operators.haar import Cascade

DETECTORS = ("haar", "skin", "none")
EXTRACTORS = ("pca", "lda", "lbph")

#: Setting, type, and the range or the names it may have; the values are those of an empty configuration.
FIELDS = {
    "detection.type": (str, "none", DETECTORS),
    "detection.min_face_size": (int, 30, (1, 10_000)),
    "detection.min_confidence": (float, 0.5, (0.0, 1.0)),
    "detection.scale_factor": (float, 1.1, (1.0001, 10.0)),
    "detection.min_neighbours": (int, 3, (1, 1000)),
    "extraction.algorithm": (str, "pca", EXTRACTORS),
    "extraction.components": (int, 10, (1, 100_000)),
    "extraction.lbph.grid": (int, 8, (1, 64)),
    "extraction.lbph.radius": (int, 1, (1, 16)),
    "classification.neighbours": (int, 3, (1, 1000)),
    "classification.metric": (str, "euclidean", tuple(SCALES)),
    "classification.average": (bool, False, (False, True)),
    "recognition.threshold": (float, 0.6, (0.0, 1.0)),
    "quality.min_score": (float, 0.3, (0.0, 1.0)),
    "quality.on_enrol": (bool, True, (False, True)),
    "image.width": (int, 100, (20, 4096)),
    "image.height": (int, 100, (20, 4096)),
    "image.equalize": (bool, True, (False, True)),
    "image.align": (bool, True, (False, True)),
}


def _value(name: str, given: object) -> object:
    kind, _, may = FIELDS[name]
    try:
        if kind is bool:
            value = {"true": True, "false": False}[str(given).strip().lower()]
        else:
            value = str(given).strip().lower() if kind is str else kind(given)
    except (KeyError, ValueError) as e:
        raise ValueError(f"{name}: {given!r} is no {kind.__name__}") from e
    if kind in (int, float) and not may[0] <= value <= may[1]:
        raise ValueError(f"{name}: {value} is not in {may[0]} to {may[1]}")
    if kind is str and value not in may:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(may)}")
    return value


def settings(given: Mapping[str, object] | None = None) -> dict[str, object]:
    """All settings, those ``given`` by name checked and the others as in FIELDS. Dashes count as underscores; an unknown name raises."""
    own = {k.strip().lower().replace("-", "_"): v for k, v in (given or {}).items()}
    unknown = sorted(set(own) - set(FIELDS))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {k: _value(k, own[k]) if k in own else default for k, (_, default, _) in FIELDS.items()}


def from_session(spark: SparkSession, prefix: str = "spark.likeness.") -> dict[str, object]:
    """The settings that the session has under a prefix."""
    conf = {**dict(spark.sparkContext.getConf().getAll()), **spark.conf.getAll}
    return settings({k.removeprefix(prefix): v for k, v in conf.items() if k.startswith(prefix)})


@dataclass(frozen=True)
class Recognizer:
    """A registry with settings: every call passes on what they say."""

    registry: api.Registry
    settings: dict = field(default_factory=settings)
    cascade: Cascade | None = None

    def _how(self) -> dict:
        s = self.settings
        how = {"detector": s["detection.type"], "size": (s["image.width"], s["image.height"]), "align": s["image.align"], "equalize": s["image.equalize"], "patterns": {"grid": s["extraction.lbph.grid"], "radius": s["extraction.lbph.radius"]} if s["extraction.algorithm"] == "lbph" else None}
        if s["detection.type"] == "haar":
            how |= {"cascade": self.cascade, "options": {"least_side": s["detection.min_face_size"], "grow": s["detection.scale_factor"], "min_members": s["detection.min_neighbours"], "min_confidence": s["detection.min_confidence"]}}
        elif s["detection.type"] == "skin":
            how["options"] = {"least_side": s["detection.min_face_size"], "min_confidence": s["detection.min_confidence"]}
        return how

    def enroll(self, images: DataFrame) -> Recognizer:
        return replace(self, registry=self.registry.enroll(images))

    def train(self, force: bool = False) -> Recognizer:
        s = self.settings
        least = s["quality.min_score"] if s["quality.on_enrol"] else None
        return replace(self, registry=self.registry.train(s["extraction.components"], least, force, **self._how()))

    def recognize(self, probes: DataFrame) -> DataFrame:
        s = self.settings
        return self.registry.recognize(probes, s["recognition.threshold"], s["classification.neighbours"], s["classification.metric"], averaged=s["classification.average"], **self._how())


def configured(spark: SparkSession, given: Mapping[str, object] | None = None, cascade: Cascade | None = None) -> Recognizer:
    """An empty registry that works by the settings ``given`` or, without them, by the session's. The cascade detector needs its ``cascade``."""
    own = settings(given) if given is not None else from_session(spark)
    if own["detection.type"] == "haar" and cascade is None:
        raise ValueError("detection.type haar needs a cascade")
    return Recognizer(api.registry(spark, own["extraction.algorithm"]), own, cascade)
