"""Connected components of a graph of any size, by joins."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from likeness.runtime import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, label): the least id that each node of (g, id) reaches over the edges (g, u, v), within its graph g.

    Rounds of hooking and shortcutting on parent pointers (the FastSV scheme of
    Zhang, Azad and Hu, 2020): a node's and its parent's pointer take the least
    grandparent among the neighbours. A path of n nodes ends after about log n
    rounds. Each round is written, so none is computed twice, and joins read
    what was written, so that a parent of very many nodes can be split.
    Nodes without edges are their own label; edges between unknown nodes are ignored.
    """
    f = cut(nodes.select("g", "id", F.col("id").alias("p")).distinct())
    both = cut(edges.select("g", "u", "v").unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    while True:
        up = f.select("g", F.col("id").alias("p"), F.col("p").alias("gp"))
        gf = f.join(up.hint("merge"), ["g", "p"]).select("g", "id", "p", "gp").persist(StorageLevel.MEMORY_AND_DISK)  # what is lost of it is made anew
        near = both.join(gf.select("g", F.col("id").alias("u"), F.col("p").alias("pu")).hint("merge"), ["g", "u"]).join(gf.select("g", F.col("id").alias("v"), "gp").hint("merge"), ["g", "v"])
        hooks = near.select("g", F.explode(F.array("u", "pu")).alias("id"), F.col("gp").alias("to"))
        found = gf.select("g", "id", F.col("gp").alias("to"), F.col("p").alias("was")).unionByName(hooks.withColumn("was", F.lit(None).cast("long")))
        new = cut(found.groupBy("g", "id").agg(F.min("to").alias("p"), F.max("was").alias("was")))
        gf.unpersist()
        f = new.select("g", "id", "p")
        if new.where("p <> was").isEmpty():
            return f.withColumnRenamed("p", "label")
