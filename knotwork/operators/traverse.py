"""Bounded traversals and shortest paths; the driver steps through levels, Spark holds the frontiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, scratch, within
from .graph import PropertyGraph


def bfs(g: PropertyGraph, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(id, level) of what is reached and (source, target, level) of every step to a node not visited before its level."""
    frontier = cut(starts.select("id").distinct())
    visited = frontier.withColumn("level", F.lit(0))
    steps = None
    for level in range(1, depth + 1):
        near = g.neighbours.where(within(frontier.select(F.xxhash64("id").alias("h")))(F.xxhash64("id")))
        found = cut(near.join(frontier, "id").join(visited.select(F.col("id").alias("nbr")), "nbr", "left_anti"))
        step = found.select(F.col("id").alias("source"), F.col("nbr").alias("target"), F.lit(level).alias("level"))
        steps = step if steps is None else steps.union(step)
        frontier = found.select(F.col("nbr").alias("id")).distinct()
        visited = visited.union(frontier.withColumn("level", F.lit(level)))
    if steps is None:
        steps = visited.select(F.col("id").alias("source"), F.col("id").alias("target"), "level").limit(0)
    return visited, steps


def dfs(g: PropertyGraph, starts: Iterable[str], depth: int) -> DataFrame:
    """(id, place): nodes in the order in which a depth-first walk with ascending neighbours first takes them.

    The walk never leaves the ball of `depth` steps, which Spark finds; walking itself is one sequential task.
    """
    starts = list(starts)
    spark = g.nodes.sparkSession
    ball, _ = bfs(g, spark.createDataFrame([(s,) for s in starts], "id string"), depth)
    near = g.neighbours.join(ball.select("id"), "id").join(ball.select(F.col("id").alias("nbr")), "nbr", "left_semi")
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))

    def walk(frames):
        import pandas as pd

        nbrs = {i: list(n) for f in frames for i, n in zip(f["id"], f["nbrs"], strict=True)}
        seen: dict[str, int] = {}
        stack = [(s, 0) for s in reversed(starts)]
        while stack:
            node, level = stack.pop()
            if node in seen or level > depth:
                continue
            seen[node] = len(seen)
            stack += [(n, level + 1) for n in reversed(nbrs.get(node, [])) if n not in seen]
        yield pd.DataFrame({"id": list(seen), "place": list(seen.values())})

    return lists.coalesce(1).mapInPandas(walk, "id string, place long")


def shortest_path(g: PropertyGraph, source: str, target: str) -> list[str] | None:
    """The path of fewest hops; of several the one whose ids come first, which is what ascending discovery finds.

    Each hop is made from the end that reached fewer nodes at last, until one reaches what the other did or nothing new; None
    without a path."""
    if source == target:
        return [source]
    spark = g.nodes.sparkSession
    with scratch() as own:
        ends = [own(spark.createDataFrame([(x, [x])], "id string, path array<string>")) for x in (source, target)]
        before, sizes, side = list(ends), [1, 1], 1
        while True:
            side = 1 - side if sizes[0] == sizes[1] else int(sizes[1] < sizes[0])
            last, other = ends[side], ends[1 - side]
            near = g.neighbours.where(within(last.select(F.xxhash64("id").alias("h")))(F.xxhash64("id")))
            nbr = F.array("nbr")
            step = near.join(last, "id").select(F.col("nbr").alias("id"), F.concat(*(("path", nbr) if side == 0 else (nbr, "path"))).alias("path"))
            # Edges go both ways, so what was reached before the last hop but one is no neighbour.
            fresh = step.join(last.union(before[side]).select("id"), "id", "left_anti")
            found = own(fresh.groupBy("id").agg(F.min("path").alias("path")))
            there, back = (found, other) if side == 0 else (other, found)
            both = there.join(back.select("id", F.slice("path", 2, F.size("path")).alias("rest")), "id")
            best = both.agg(F.min(F.concat("path", "rest"))).first()[0]
            if best is not None:
                return list(best)
            before[side], ends[side], sizes[side] = last, found, found.count()
            if not sizes[side]:
                return None
