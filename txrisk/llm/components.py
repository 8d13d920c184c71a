"""Connected components of an undirected link table, as rounds of Spark joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.session import ensure_checkpoint_dir, max_broadcast_bytes


#: Rows of a link table one task handles; a small table is not spread over hundreds of tasks, whose shuffles would be
#: hundreds of files each.
TASK_ROWS = 100_000


def tasks_for(rows: int) -> int:
    return max(1, math.ceil(rows / TASK_ROWS))


def settled(df: DataFrame) -> DataFrame:
    """The table checkpointed, in as many partitions as its rows need."""
    kept = df.checkpoint()
    return kept.coalesce(tasks_for(kept.count()))


def _closer(links: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step: every link moves to a smaller common neighbour.

    While they are few, the smallest neighbours are broadcast, so that a node with very many links stays spread out.
    """
    few, tasks = 2 * rows * 96 <= max_broadcast_bytes(links.sparkSession), tasks_for(2 * rows)

    def smallest_of(table: DataFrame) -> DataFrame:
        return table.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)

    def sized(smallest: DataFrame) -> DataFrame:
        return F.broadcast(smallest) if few else smallest

    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = both.join(sized(smallest_of(both)), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    up = up.where("u > v").distinct().coalesce(tasks)
    smallest = smallest_of(up)
    down = up.join(sized(smallest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return down.union(smallest.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(u, v)``; the component is its smallest node.

    Nodes may be of any ordered type. Links may be repeated, in either direction or loops; links with
    a null end are ignored. An empty link table gives an empty result. The minimum per node is
    combined map-side before the join, so a node with very many links is never gathered; a table
    is checkpointed per round, and rounds grow with the logarithm of the longest path.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = settled(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
        links = _closer(links, now[0]).checkpoint()
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
