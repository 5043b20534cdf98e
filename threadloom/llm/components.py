"""Connected components of a graph of longs, by alternating star contractions.

Each round connects every node's larger neighbours to its least neighbour (large
star), then every node and its smaller neighbours to the least of them (small
star), until nothing changes; the number of rounds grows with the logarithm of the
graph's size. Edges stay in the shared folder between rounds: nothing is gathered
in the driver, and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def roots(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) of every node with an edge, roots left out. edges: u, v with u <> v."""
    now = materialize(spark, edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while True:
        last, now = now, materialize(spark, _small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        discard(last)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
