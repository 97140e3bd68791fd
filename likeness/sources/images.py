"""Image sets on disk as DataFrames (path, label, width, height, channels, data[, metadata]).

PGM files are read by Spark's ``binaryFile`` source and decoded in Arrow batches
by this package; JPEG, PNG, BMP and GIF are decoded by Spark's ``image`` source.
Both give the same columns. What cannot be decoded is dropped, or kept with a
null raster (``keep_bad``); ``undecoded`` counts it by suffix.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from likeness.functions import text
from likeness.operators.images import gray, read_pgm, resize
from likeness.runtime import ship

SIZE = (48, 64)


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, content) of the files under a folder, in no order."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return (r.option("recursiveFileLookup", "true") if recursive else r).load(path).select("path", "content")


def decoded(found: DataFrame, size: tuple[int, int] | None = SIZE, to_gray: bool = True, keep_bad: bool = False) -> DataFrame:
    """Adds width, height, channels and data (row-major bytes) to rows with path and content (PGM)."""
    ship(found.sparkSession)
    cols = [c for c in found.columns if c != "content"]
    src = found.select(*cols, "content")
    from pyspark.sql.types import BinaryType, IntegerType, StructType

    schema = StructType([f for f in src.schema.fields if f.name != "content"])
    for n in ("width", "height", "channels"):
        schema = schema.add(n, IntegerType())
    schema = schema.add("data", BinaryType())

    def one(data: bytes):
        try:
            g = read_pgm(data)
            g = gray(g) if to_gray else g
            g = resize(g, *size) if size else g
            return g.shape[1], g.shape[0], 1, np.clip(g, 0, 255).astype(np.uint8).tobytes()
        except (ValueError, IndexError, OverflowError):
            return None, None, None, None

    def run(batches):
        for b in batches:
            got = [one(x) for x in b.column(len(cols)).to_pylist()]
            extra = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], names=schema.names)
            yield out if keep_bad else out.filter(pa.array([g[0] is not None for g in got], pa.bool_()))

    return src.mapInArrow(run, schema)


def _glob(suffixes: tuple[str, ...]) -> str:
    return "*.{" + ",".join(x for s in suffixes for x in (s, s.upper(), s.capitalize())) + "}"


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = text.IMAGE_SUFFIXES, recursive: bool = False, size: tuple[int, int] | None = SIZE, to_gray: bool = True, keep_bad: bool = False, strict: bool = False) -> DataFrame:
    """path, width, height, channels, data of the image files of any of the formats under a folder.

    ``strict``: a file that cannot be decoded fails the job with its path, rather than being dropped or kept.
    """
    if strict:
        kept = images(spark, path, suffixes, recursive, size, to_gray, keep_bad=True)
        data = F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("cannot be decoded: "), F.col("path"))).cast("binary"))
        return kept.select("path", "width", "height", "channels", data.alias("data"))
    out = None
    if "pgm" in suffixes:
        out = decoded(files(spark, path, _glob(("pgm",)), recursive), size, to_gray, keep_bad)
    coded = tuple(s for s in suffixes if s != "pgm")
    if coded:
        rest = decoded_by_spark(spark, path, coded, recursive, size, to_gray, keep_bad)
        out = rest if out is None else out.unionByName(rest)
    return out


def decoded_by_spark(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "gif"), recursive: bool = False, size: tuple[int, int] | None = SIZE, to_gray: bool = True, keep_bad: bool = False) -> DataFrame:
    """JPEG, PNG, BMP and GIF by Spark's image source, as ``decoded`` gives PGM; colours are in the order red, green, blue."""
    ship(spark)
    r = spark.read.format("image").option("dropInvalid", str(not keep_bad).lower()).option("pathGlobFilter", _glob(suffixes))
    found = (r.option("recursiveFileLookup", "true") if recursive else r).load(path)
    i = F.col("image")
    src = found.select(F.regexp_replace(i["origin"], "^file:/+", "file:/").alias("path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("data"))

    def one(w, h, k, data):
        if not w or w < 1 or not data or k not in (1, 3, 4):
            return None, None, None, None
        g = np.frombuffer(data, np.uint8).reshape(h, w, k)
        g = g[..., 0] if k == 1 else g[..., 2::-1]
        g = gray(g.astype(np.int64)) if to_gray and g.ndim == 3 else g
        g = resize(g, *size) if size and g.ndim == 2 else g
        return g.shape[1], g.shape[0], 1 if g.ndim == 2 else 3, np.clip(g, 0, 255).astype(np.uint8).tobytes()

    def run(batches):
        for b in batches:
            got = [one(*x) for x in zip(*(b.column(c).to_pylist() for c in range(1, 5)))]
            extra = [pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
            out = pa.RecordBatch.from_arrays([b.column(0), *extra], names=["path", "width", "height", "channels", "data"])
            yield out if keep_bad else out.filter(pa.array([g[0] is not None for g in got], pa.bool_()))

    return src.mapInArrow(run, "path string, width int, height int, channels int, data binary")


def one(spark: SparkSession, path: str, size: tuple[int, int] | None = None, to_gray: bool = False) -> DataFrame:
    """The row of one image file. A file that is missing or no image raises at once, one that cannot be decoded when the row is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in text.IMAGE_SUFFIXES:
        raise ValueError(f"{path} has no image's suffix")
    return images(spark, path, (suffix,), size=size, to_gray=to_gray, strict=True)


def undecoded(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """suffix, n: the image files under a folder that no decoder can read."""
    bad = images(spark, path, recursive=recursive, size=None, keep_bad=True).where(F.col("data").isNull())
    return bad.groupBy(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("suffix")).agg(F.count("*").alias("n"))


def orl(spark: SparkSession, path: str, **how) -> DataFrame:
    """Folders s*, files .pgm; the label is the folder."""
    return images(spark, f"{path}/s*", ("pgm",), **how).withColumn("label", text.parent_name(F.col("path")))


def yale(spark: SparkSession, path: str, **how) -> DataFrame:
    """One folder; names subjectNN.condition.ext in any case. Files without an image's suffix take no part."""
    name = text.base_name(F.col("path"))
    found = images(spark, path, **how).withColumn("label", text.yale_label(name)).where(F.col("label").isNotNull())
    return found.withColumn("metadata", F.create_map(F.lit("condition"), text.yale_condition(name)))


def lfw(spark: SparkSession, path: str, **how) -> DataFrame:
    """A folder for each person; underscores in its name are blanks."""
    return images(spark, f"{path}/*", **how).withColumn("label", F.replace(text.parent_name(F.col("path")), F.lit("_"), F.lit(" ")))


def lfw_pairs(spark: SparkSession, pairs_file: str, images: DataFrame) -> DataFrame:
    """(same, a, b): paths of the pairs whose two files were decoded. The first line is skipped; three fields name one person, four two."""
    line = spark.read.text(pairs_file).select(F.col("value"), F.monotonically_increasing_id().alias("i"), F.split(F.trim("value"), r"\s+").alias("p"))
    pair = line.where((F.col("i") > 0) & F.size("p").isin(3, 4)).select("i", (F.size("p") == 3).alias("same"), F.element_at("p", 1).alias("n1"), F.element_at("p", 2).alias("k1"), F.when(F.size("p") == 3, F.element_at("p", 1)).otherwise(F.element_at("p", 3)).alias("n2"), F.element_at("p", -1).alias("k2"))
    name = text.base_name(F.col("path"))
    keyed = images.select("path", F.regexp_replace(name, r"_\d+\.[^.]+$", "").alias("n"), F.regexp_extract(name, r"_(\d+)\.[^.]+$", 1).cast("int").alias("k"))
    a, b = (keyed.select(F.col("path").alias(x), F.col("n").alias(f"n{s}"), F.col("k").alias(f"m{s}")) for x, s in (("a", 1), ("b", 2)))
    both = pair.withColumn("m1", F.col("k1").cast("int")).withColumn("m2", F.col("k2").cast("int"))
    return both.join(a, ["n1", "m1"]).join(b, ["n2", "m2"]).select("same", "a", "b")


def by_person(spark: SparkSession, path: str, **how) -> DataFrame:
    """A folder for each person, image files by suffix."""
    return images(spark, f"{path}/*", **how).withColumn("label", text.parent_name(F.col("path")))


def flat(spark: SparkSession, path: str, separator: str = "_", **how) -> DataFrame:
    """One folder; the label is the name up to its last separator."""
    return images(spark, path, **how).withColumn("label", text.flat_label(text.base_name(F.col("path")), separator))


def tree(spark: SparkSession, path: str, **how) -> DataFrame:
    """Image files at any depth; the label is the folder right below ``path``."""
    plain = re.sub(r"^[a-z0-9]+:/+([^/]*)", r"/\1", path.rstrip("/"))
    below = F.try_element_at(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "/"), F.lit(len(plain.split("/")) + 1))
    return images(spark, path, recursive=True, **how).withColumn("label", below)


def enrol_labels(name: Column, parent: Column, mode: str, fixed: str = "", pattern: str = r"(.+?)(?:_\d+)?\.[^.]+$") -> Column:
    """Labels by one of four modes: a fixed name, the folder, a pattern's first group, or the pattern and else the folder."""
    by_name = text.regex_label(name, pattern)
    return {"fixed": F.lit(fixed), "directory": parent, "pattern": by_name}.get(mode, F.coalesce(by_name, parent))


READERS = {"orl": orl, "att": orl, "yale": yale, "lfw": lfw, "flat": flat, "custom": by_person, "tree": tree}


def read(spark: SparkSession, path: str, kind: str = "custom", **how) -> DataFrame:
    """An image set by the name of its layout; unknown names read as one folder for each person."""
    return READERS.get(kind.lower(), by_person)(spark, path, **how)
