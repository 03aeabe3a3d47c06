"""Connected components by alternating stars, DataFrame functions only.

Every round has a large star (each node hands its larger neighbours the least node around it) and a small star (each node hands its
smaller neighbours, and itself, the least of them); edges only ever move towards the least node, and after O(log^2 n) rounds
every node points at it (Kiveris et al., 2014). A node's least neighbour is a partial aggregate, so a hub sends one row
per task; a hub's edges meet that one row in an inner join that adaptive execution splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v); component is the least node reachable.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    own = edges.where("u is not null and v is not null and u <> v")
    path = common.scratch(spark, "components")
    now = common.materialize(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components", path)
    mark, paths = None, [path]
    for _ in range(max_rounds):
        path = common.scratch(spark, "components")
        now = common.materialize(_small_star(_large_star(now).distinct()).distinct(), "components", path)
        common.drop_folder(spark, paths.pop())  # the round before
        paths.append(path)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
