"""Connected components of links in Spark, by alternating star operations.

Each round points every node's larger neighbours, then its smaller ones, at
its least neighbour, until nothing changes. Minima are combined before they
are shuffled, so a node with many links needs no task of its own; nothing but
a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: each node's larger neighbours point at its least one; small: it and its smaller ones do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select("v", "m", "u")
    if not large:
        out = out.select(F.col("v").alias("a"), "m").unionByName(out.select(F.col("u").alias("a"), "m")).select(F.col("a").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component (the least node it reaches), for nodes that have a link."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = shared.written(edges, "components-0")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))  # no sum of ids, which may be of any size
    before = edges.agg(mark.alias("x")).first()["x"]
    for k in range(MAX_ROUNDS):
        edges = shared.written(_star(_star(edges, True), False), f"components-{k + 1}")
        now = edges.agg(mark.alias("x")).first()["x"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
