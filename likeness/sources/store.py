"""Models and results on storage, through Hadoop's file system only.

A model is a folder: ``components`` and ``identities`` as Parquet, and a JSON
row ``info`` that is written last, so a folder without it is not a model.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from likeness.operators.models import Subspace

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise ValueError("a model's name has letters, digits, dots, dashes and underscores, at most 128")
    return name


def problems(algorithm: Column, version: Column, model_id: Column, rows: Column, mean_length: Column) -> Column:
    """All errors of a model row, as an array of texts."""
    rules = [(algorithm.isNull() | (F.trim(algorithm) == ""), "algorithm is missing"), (version < 1, "version is below 1"), (model_id.isNull(), "id is missing"), (rows != mean_length, "mean and components differ in length")]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))


_INFO = "name string, algorithm string, version int, dimension int, components int, normalise boolean, checksum string, saved_at long, corrupt string"


class Store:
    """A folder of models and one of backups."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._copy = jvm.org.apache.hadoop.fs.FileUtil.copy
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str, kind: str = "models") -> str:
        return f"{self.root}/{kind}/{checked_name(name)}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self._at(name)}/info"))

    def save(self, name: str, model: Subspace, identities: DataFrame | None = None, overwrite: bool = False) -> None:
        """identities: (identity, v). Components, identities, and last the info row with their checksum."""
        if self.exists(name) and not overwrite:
            raise FileExistsError(name)
        at = self._at(name)
        self._fs.delete(self._path(f"{at}/info"), True)
        rows = [(-1, model.mean.tolist(), 0.0, 0.0), *((i, model.axes[:, i].tolist(), float(model.values[i]), float(model.ratio[i])) for i in range(model.axes.shape[1]))]
        self.spark.createDataFrame(rows, "i int, v array<double>, value double, ratio double").coalesce(1).write.mode("overwrite").parquet(f"{at}/components")
        if identities is not None:
            identities.write.mode("overwrite").parquet(f"{at}/identities")
        info = {"name": name, "algorithm": model.algorithm, "version": 1, "dimension": len(model.mean), "components": model.axes.shape[1], "normalise": model.normalise, "checksum": self._checksum(at)}
        self.spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in info.items()], F.unix_millis(F.current_timestamp()).alias("saved_at"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{at}/info")

    def _checksum(self, at: str) -> str:
        rows = self.spark.read.parquet(f"{at}/components").select(F.sha2(F.to_json(F.struct("i", "v")), 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)).collect()
        return rows[0][0]

    def load(self, name: str, validate: bool = True) -> Subspace | None:
        if not self.exists(name):
            return None
        at = self._at(name)
        info = self.info(name)
        if validate and info["checksum"] != self._checksum(at):
            raise ValueError(f"{name}: the checksum does not fit")
        rows = sorted(self.spark.read.parquet(f"{at}/components").collect(), key=lambda r: r["i"])
        axes = np.array([r["v"] for r in rows[1:]]).T if len(rows) > 1 else np.zeros((len(rows[0]["v"]), 0))
        return Subspace(np.array(rows[0]["v"]), axes, np.array([r["value"] for r in rows[1:]]), np.array([r["ratio"] for r in rows[1:]]), info["algorithm"], info["normalise"])

    def identities(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._at(name)}/identities")

    def info(self, name: str) -> dict | None:
        return json.loads(self.spark.read.text(f"{self._at(name)}/info").collect()[0][0]) if self.exists(name) else None

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.root}/{kind}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def catalogue(self) -> DataFrame:
        """A row for each model's sidecar: its fields, ``folder``, and ``corrupt`` with the text of one that is no JSON of them.

        One scan of all sidecars, whatever the number of models. Folders without one are not models.
        """
        at = f"{self.root}/models/*/info"
        found = self._fs.globStatus(self._path(at))
        if not found:
            return self.spark.createDataFrame([], f"{_INFO}, folder string")
        read = self.spark.read.schema(_INFO).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(at)
        rows = read.select("*", F.regexp_extract("_metadata.file_path", r"/([^/]+)/info/[^/]+$", 1).alias("folder"))
        lost = F.col("corrupt").isNull() & F.col("name").isNull()
        return rows.withColumn("corrupt", F.when(lost, "the name is missing").otherwise(F.col("corrupt")))

    def models(self, algorithm: str | None = None) -> list[dict]:
        """Info rows, last saved first; folders without one and broken ones are skipped."""
        rows = self.catalogue().where("corrupt IS NULL")
        rows = rows if algorithm is None else rows.where(F.col("algorithm") == algorithm)
        return sorted((r.asDict() for r in rows.drop("corrupt", "folder").collect()), key=lambda i: (-(i["saved_at"] or 0), i["name"]))

    def size(self) -> int:
        at = self._path(f"{self.root}/models")
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(self._at(name)), True)

    def _copied(self, a: str, b: str) -> None:
        if not self._fs.exists(self._path(a)):
            raise FileNotFoundError(a)
        self._fs.delete(self._path(b), True)
        self._fs.mkdirs(self._path(b).getParent())
        self._copy(self._fs, self._path(a), self._fs, self._path(b), False, self._conf)

    def backup(self, name: str, to: str) -> None:
        self._copied(self._at(name), self._at(to, "backups"))

    def restore(self, backup: str, name: str) -> None:
        self._copied(self._at(backup, "backups"), self._at(name))

    def backups(self) -> list[str]:
        return self._names("backups")

    def delete_backup(self, name: str) -> bool:
        return self._fs.delete(self._path(self._at(name, "backups")), True)

    def export(self, name: str, to: str) -> None:
        self._copied(self._at(name), to)

    def import_(self, from_: str, name: str) -> dict | None:
        """Take in an exported model. It is checked under a name of its own first: a bad one leaves the model of that name as it was."""
        probe = f"{name}-incoming-{uuid.uuid4().hex}"
        self._copied(from_, self._at(probe))
        try:
            if self.load(probe) is None:
                raise ValueError(f"{from_} is no model")
            self._copied(self._at(probe), self._at(name))
        finally:
            self.delete(probe)
        return self.info(name)


class Snapshots:
    """Named sets of tables that are replaced in one step.

    The tables of a snapshot are written to a folder of its own; then a numbered
    manifest that names this folder is moved into place. Readers take the
    manifest with the highest number, so they see all tables of the old snapshot
    or all of the new one; what a failed writer leaves is named by no manifest.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/snapshots"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/{checked_name(name)}/manifest-*.json"))
        return sorted(int(re.search(r"manifest-(\d+)\.json$", s.getPath().getName())[1]) for s in found or [])

    def _write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, name: str, tables: dict[str, DataFrame], info: dict) -> int:
        """Write ``tables`` and ``info``, then let readers see them; the version's number. A writer that comes second to a number takes the next."""
        at = f"{self.root}/{checked_name(name)}"
        data = f"data-{uuid.uuid4().hex}"
        for key, df in tables.items():
            df.write.parquet(f"{at}/{data}/{checked_name(key)}")
        text = json.dumps({"data": data, "tables": sorted(tables), "info": info})
        while True:
            version = (self._versions(name) or [0])[-1] + 1
            draft = f"{at}/.draft-{uuid.uuid4().hex}"
            self._write(draft, text)
            to = self._path(f"{at}/manifest-{version:010d}.json")
            if not self._fs.exists(to) and self._fs.rename(self._path(draft), to):
                return version
            self._fs.delete(self._path(draft), False)

    def manifest(self, name: str, version: int | None = None) -> dict | None:
        known = self._versions(name)
        if not known or (version is not None and version not in known):
            return None
        rows = self.spark.read.text(f"{self.root}/{name}/manifest-{version or known[-1]:010d}.json").collect()
        return json.loads("\n".join(r[0] for r in rows))

    def read(self, name: str, version: int | None = None) -> tuple[dict, dict[str, DataFrame]] | None:
        """Info and tables of the last version, or of one by its number; nothing where there is none."""
        found = self.manifest(name, version)
        if found is None:
            return None
        at = f"{self.root}/{name}/{found['data']}"
        return found["info"], {k: self.spark.read.parquet(f"{at}/{k}") for k in found["tables"]}

    def prune(self, name: str, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and data that no manifest names; how many folders went. Not to be run beside a writer."""
        known = self._versions(name)
        for v in known[: max(len(known) - max(keep, 1), 0)]:
            self._fs.delete(self._path(f"{self.root}/{name}/manifest-{v:010d}.json"), False)
        live = {self.manifest(name, v)["data"] for v in self._versions(name)}
        gone = [s.getPath() for s in self._fs.globStatus(self._path(f"{self.root}/{name}/data-*")) if s.getPath().getName() not in live]
        return sum(self._fs.delete(g, True) for g in gone)


def markdown(rows: list[dict], title: str = "Results") -> str:
    """A table of result rows; numbers with four decimals."""
    if not rows:
        return f"# {title}\n"
    cols = list(rows[0])
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(r.get(c)) for c in cols) + " |" for r in rows)]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"


def html(rows: list[dict], title: str = "Results") -> str:
    from html import escape

    cols = list(rows[0]) if rows else []
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in cols) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in cols)}</tr>{body}</table></body></html>"


def comparison(results: DataFrame, name: str, measures: tuple[str, ...], larger: tuple[str, ...] | None = None) -> DataFrame:
    """Each row of ``results`` with, for each measure, its rank (1: best), its difference from the best, and ``wins``: measures in which it is best.

    Larger is better for the measures in ``larger`` (by default all), smaller for
    the others. A null measure ranks last. Only few rows: one for each thing compared.
    """
    from pyspark.sql import Window

    up = measures if larger is None else larger
    out = results.select(name, *measures)
    for m in measures:
        best = (F.max if m in up else F.min)(m).over(Window.partitionBy())
        order = F.desc_nulls_last(m) if m in up else F.asc_nulls_last(m)
        out = out.withColumns({f"{m}_rank": F.rank().over(Window.partitionBy().orderBy(order)), f"{m}_from_best": F.abs(F.col(m) - best)})
    wins = [F.when((F.col(f"{m}_rank") == 1) & F.col(m).isNotNull(), 1).otherwise(0) for m in measures]
    return out.withColumn("wins", sum(wins[1:], wins[0]))


def comparison_text(compared: DataFrame, name: str, measures: tuple[str, ...]) -> str:
    """The comparison in words: a line for each measure with its best and its spread, and the one that wins most; ties by name."""
    rows = [r.asDict() for r in compared.orderBy(name).collect()]
    if not rows:
        return "Nothing to compare.\n"
    lines = []
    for m in measures:
        known = [r for r in rows if r[m] is not None]
        if not known:
            lines.append(f"{m}: not measured")
            continue
        best = min(known, key=lambda r: (r[f"{m}_rank"], r[name]))
        spread = max(r[f"{m}_from_best"] for r in known)
        lines.append(f"{m}: {best[name]} is best with {best[m]:.4f}; the others are up to {spread:.4f} away")
    top = max(rows, key=lambda r: r["wins"])
    lines.append(f"Overall: {top[name]} is best in {top['wins']} of {len(measures)}")
    return "\n".join(lines) + "\n"


def write_results(results: DataFrame, to: str, kind: str = "csv") -> None:
    """CSV with quotes doubled, or JSON lines without null fields, or Parquet."""
    w = results.write.mode("overwrite")
    if kind == "csv":
        w.option("header", "true").option("quote", '"').option("escape", '"').csv(to)
    elif kind == "json":
        w.option("ignoreNullFields", "true").json(to)
    else:
        w.parquet(to)
