"""Session helpers that every part of the package shares."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch, at most: whole texts travel in them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context.

    Functions handed to Arrow operators are pickled by reference, so workers
    must be able to import them. A zip of the package travels through
    ``addPyFile``; no folder has to be shared between driver and executors.
    The session's Arrow batches are bounded (``BATCH``), if they are larger.
    """
    sc = spark.sparkContext
    if getattr(sc, "_likeness_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="likeness-"), "likeness_pkg.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(to)
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    sc._likeness_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    session in one process (as in tests) gets a temporary one; on a cluster it is
    an error. Never a local checkpoint: the copies must survive the loss of an
    executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        conf = sc.getConf().get("spark.checkpoint.dir", None)
        if conf is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="likeness-checkpoint-"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and checkpoints of plans that nothing refers to any more: it learns of them only when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
