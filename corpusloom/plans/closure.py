"""Reachability over a table of edges, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.storage import materialize


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(url, depth) of everything that is reachable from ``seeds`` (url) over ``edges`` (src, dst), with the least number of steps.

    Each round takes the edges out of the last frontier, drops what was visited (anti-join) and writes the new frontier into the shared folder, so plans
    stay short and an executor may be lost at any time. Ends when a round finds nothing new. Null urls are never visited.
    """
    edges = materialize(edges.filter("src is not null and dst is not null"), "edges")
    new = materialize(seeds.select("url").filter("url is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, depth = new, 0
    while not new.isEmpty() and (max_rounds is None or depth < max_rounds):
        depth += 1
        step = edges.join(new.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        new = materialize(step.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        visited = visited.unionByName(new)
        if depth % 16 == 0:
            visited = materialize(visited, "visited")
    return visited
