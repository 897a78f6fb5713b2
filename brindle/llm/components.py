"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v) links of longs in; (node, root) for every linked node out, root being the component's smallest node.

    Each round has two exchanges and writes its edges to the shared folder, so lineage stays short; one more exchange tells whether
    they are stars, and nothing but that count reaches the driver. The number of edges never grows from round to round: each
    gives one of the next round. Rounds grow with the logarithm of the longest chain; a run that hasn't settled after
    ``max_rounds`` raises.
    """
    of_node = Window.partitionBy("u")
    now = edges.where("u <> v").select("u", "v")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or to itself)
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.repartition("u").distinct().withColumn("m", F.least("u", F.min("v").over(of_node)))
        large = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of a node goes to the smallest of them, and so does the node
        least = large.repartition("u").distinct().withColumn("m", F.min("v").over(of_node))
        now = written(least.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")), "edges")
        # stars, where no node has two roots
        ends = now.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))))
        roots = ends.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        if not roots.where("root < other").count():
            return roots.select("node", "root")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
