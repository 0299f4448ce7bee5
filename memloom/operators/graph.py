"""Bounded walks and communities over directed edges (source, target), separately for each value of the key columns ``by``.

A name means something within its tenant only, so edges, anchors and results carry the tenant's key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.scratch import Scratch


def hops(edges: DataFrame, anchors: DataFrame, most: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(*by, name, depth): what lies within so many edges of the anchors (*by, name), either way, at its smallest depth.

    Both directions are a union of edges, so every step is an equality join; what was seen is left out of the next step.
    """
    scratch = Scratch(edges.sparkSession, "hops")
    both = edges.select(*by, F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(*by, F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    both = scratch.write(both, "edges")
    key = [*by, "name"]
    seen = scratch.write(anchors.select(*key).distinct().withColumn("depth", F.lit(0)), "seen")
    for depth in range(1, most + 1):
        edge_of = seen.filter(F.col("depth") == depth - 1)
        reached = edge_of.join(both.withColumnRenamed("a", "name"), key).select(*by, F.col("b").alias("name")).distinct()
        fresh = reached.join(seen.select(*key), key, "left_anti").withColumn("depth", F.lit(depth))
        seen = scratch.write(seen.unionByName(fresh), "seen")
    return seen


def walks(edges: DataFrame, seeds: DataFrame, most: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(*by, path, depth): directed paths without repetition from the seeds (*by, name), names joined by '>'."""
    step = edges.select(*by, F.col("source").alias("last"), F.col("target").alias("b")).distinct()
    now = seeds.select(*by, F.array("name").alias("names"), F.lit(0).alias("depth"))
    out = now
    for depth in range(1, most + 1):
        ends = now.withColumn("last", F.element_at("names", -1))
        now = ends.join(step, [*by, "last"]).filter(~F.array_contains("names", F.col("b"))).select(*by, F.array_append("names", F.col("b")).alias("names"), F.lit(depth).alias("depth"))
        out = out.unionByName(now)
    return out.select(*by, F.array_join("names", ">").alias("path"), "depth")


def communities(edges: DataFrame, rounds: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """(*by, name, community): label propagation; each name takes the most frequent label around it, ties to the smallest."""
    both = edges.select(*by, F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(*by, F.col("target").alias("a"), F.col("source").alias("b")))
    scratch = Scratch(edges.sparkSession, "communities")
    both = scratch.write(both, "edges")
    labels = scratch.write(both.select(*by, F.col("a").alias("name")).distinct().withColumn("community", F.col("name")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("name", "b"), [*by, "b"]).groupBy(*by, "a", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(*by, "a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best"))
        labels = scratch.write(best.select(*by, F.col("a").alias("name"), F.col("best.community").alias("community")), "labels")
    return labels
