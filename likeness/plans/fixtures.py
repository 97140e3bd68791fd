"""Tables derived from the given ones, for the registered queries: in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from likeness.runtime import table

EVERY = 10  # a probe is a vector whose id this divides
SIDE = 8  # a vector of 64 as a picture


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("identity"), F.col("embedding").cast("array<double>").alias("v"))


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where(F.col("vec_id") % EVERY != 0)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("probe_id"), F.col("identity").alias("actual"), "v")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the one of the next id."""
    a = vectors(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"), F.col("identity").alias("other"))
    return a.join(b, "vec_id")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    i = lambda c: c.cast("int")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.row_number().over(w).cast("long").alias("box_id"), i(F.col("l_partkey") % 200).alias("x"), i(F.col("l_suppkey") % 200).alias("y"), i(20 + F.floor("l_quantity")).alias("w"), i(20 + F.col("l_linenumber") * 5).alias("h"), F.round(1 - F.col("l_discount"), 6).alias("confidence"))


def rgb(spark: SparkSession, sf: str) -> DataFrame:
    i = lambda c: (F.col(c) % 256).cast("int")
    return table(spark, sf, "lineitem").select(i("l_partkey").alias("r"), i("l_suppkey").alias("g"), i("l_orderkey").alias("b"))


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Values 0..255 of each vector, row-major."""
    return vectors(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), F.transform("v", lambda x: F.floor((x + 1) * 127.5).cast("int")).alias("v"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pictures(spark, sf).select("image_id", F.posexplode("v").alias("p", "v")).select("image_id", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), "v")


VECTORS_SQL = "vectors AS (SELECT vec_id, CAST(label AS VARCHAR) AS identity, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
GALLERY_SQL = VECTORS_SQL + ", gallery AS (SELECT * FROM vectors WHERE vec_id % 10 <> 0), probes AS (SELECT vec_id AS probe_id, identity AS actual, v FROM vectors WHERE vec_id % 10 = 0)"
PAIRS_SQL = VECTORS_SQL + ", pairs AS (SELECT a.vec_id, a.identity, b.identity AS other, a.v, b.v AS u FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)"
BOXES_SQL = "boxes AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS box_id, CAST(l_partkey % 200 AS INTEGER) AS x, CAST(l_suppkey % 200 AS INTEGER) AS y, CAST(20 + floor(l_quantity) AS INTEGER) AS w, CAST(20 + l_linenumber * 5 AS INTEGER) AS h, round(1 - l_discount, 6) AS confidence FROM lineitem)"
RGB_SQL = "rgb AS (SELECT CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_orderkey % 256 AS INTEGER) AS b FROM lineitem)"
PIXELS_SQL = VECTORS_SQL + ", pixels AS (SELECT image_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(floor((e + 1) * 127.5) AS INTEGER) AS v FROM (SELECT vec_id AS image_id, unnest(range(len(v))) AS p, unnest(v) AS e FROM vectors))"
