"""Connected components by alternating large-star and small-star joins.

Each round replaces the edges by stars that point to smaller ids; the edges reach a fixed point, at which every node
points to the smallest id of its component, after a number of rounds logarithmic in the size of the components.
Only minima are joined back, no neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    stars = down.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node.

    Loops and repeated edges change nothing; edges with a null end are dropped; no edges give no rows.
    """
    clean = edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct()
    state = scratch.write(clean, "stars")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        state = scratch.write(_small_star(_large_star(state)), "stars")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
