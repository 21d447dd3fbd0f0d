"""Connected components of links as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm._store import checkpointed


ROWS = 1 << 15  # links that a task of a round takes


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each node of links(a, b); nodes without links are absent.

    Alternating large-star and small-star steps; each is a grouped minimum and a join, and each round is
    checkpointed. A round has as many tasks a stage as its links ask for, so a few links in many shuffle partitions
    don't make thousands of tasks, whose shuffle files and states the driver would keep. Minima are joined by sorting, as a broadcast
    for each join of each round would pass through the driver. Null ends and loops are ignored. No links give an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = checkpointed(links.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        parts = -(-state[0] // ROWS)
        edges = edges.coalesce(parts)
        ups = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = edges.unionByName(ups).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
        large = ups.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u <> v").coalesce(parts).distinct().coalesce(parts))
        last, state = state, _state(edges)
        if state == last:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
