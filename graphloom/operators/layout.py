"""Force-directed layouts in two or three dimensions, with cells instead of pairs (row G12).

Nodes repel each other and edges pull their ends together. Repulsion goes
through a hierarchy of cells: at each level a cell is pushed by the centres of
the cells that are near its parent but not beside itself; what all cells around
a node's own say is added up. Only in the finest cells does a node meet its
neighbour cells itself, by their sums, less what it adds to them. So a round is
a fixed number of joins by cell or node, each of about as many rows as there are
nodes and edges, and no task holds more than its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traversal import _step, symmetric

#: Finest cells are about as many as nodes; more levels than this are not used.
MOST_LEVELS = 20
START, COOLING = 0.1, 0.93


def _names(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}{d}" for d in range(dims)]


def _cells(P: DataFrame, dims: int, levels: int) -> tuple[DataFrame, float]:
    """Positions with their finest cell (c0, ...), and the side of the box."""
    found = P.agg(*(F.min(x).alias(f"a{x}") for x in _names("x", dims)), *(F.max(x).alias(f"b{x}") for x in _names("x", dims))).first()
    side = max(max(found[f"b{x}"] - found[f"a{x}"] for x in _names("x", dims)), 1e-9)
    n = 1 << levels
    cell = [F.least(F.floor((F.col(x) - found[f"a{x}"]) / side * n), F.lit(n - 1)).cast("int").alias(c) for x, c in zip(_names("x", dims), _names("c", dims), strict=True)]
    return P.select("*", *cell), side


def _push(own: list[Column], other: list[Column], weight: Column, k: float) -> list[Column]:
    """The repulsion that ``weight`` nodes at ``other`` put on one at ``own``: k * k / distance each, away from them."""
    square = sum(((a - b) * (a - b) for a, b in zip(own, other, strict=True)), F.lit(1e-12))
    return [weight * (k * k) * (a - b) / square for a, b in zip(own, other, strict=True)]


def repulsion(P: DataFrame, dims: int, k: float, levels: int) -> DataFrame:
    """positions (node, x0, ...) -> node and the force on it (f0, ...)."""
    xs, cs, fs, qs = (_names(p, dims) for p in "xcfq")
    P, _ = _cells(P, dims, levels)
    P = _step(P)
    fine = _step(P.groupBy(*cs).agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{x}") for x in xs)))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = fine.select("*", level).select("level", "n", *(f"s{x}" for x in xs), *(F.expr(f"shiftright({c}, {levels} - level)").alias(c) for c in cs))
    every = _step(up.groupBy("level", *cs).agg(F.sum("n").alias("n"), *(F.sum(f"s{x}").alias(f"s{x}") for x in xs)))
    # cells near the parent that are not beside the cell
    near = every.where("level >= 2").select("level", *cs, *((F.col(f"s{x}") / F.col("n")).alias(x) for x in xs))
    for c, q in zip(cs, qs, strict=True):
        first = 2 * (F.floor(F.col(c) / 2).cast("int") - 1)
        near = near.withColumn(q, F.explode(F.sequence(first, first + 5)))
    apart = F.greatest(*(F.abs(F.col(c) - F.col(q)) for c, q in zip(cs, qs, strict=True)))
    others = every.select("level", *(F.col(c).alias(q) for c, q in zip(cs, qs, strict=True)), "n", *((F.col(f"s{x}") / F.col("n")).alias(f"m{x}") for x in xs))
    pushes = _push([F.col(x) for x in xs], [F.col(f"m{x}") for x in xs], F.col("n"), k)
    met = near.where(apart > 1).join(others, ["level", *qs]).select("level", *cs, *(p.alias(f) for p, f in zip(pushes, fs, strict=True)))
    of_cell = met.groupBy("level", *cs).agg(*(F.sum(f).alias(f) for f in fs))
    below = fine.select(*(F.col(c).alias(q) for c, q in zip(cs, qs, strict=True)), level).select("*", *(F.expr(f"shiftright({q}, {levels} - level)").alias(c) for c, q in zip(cs, qs, strict=True)))
    far = below.join(of_cell, ["level", *cs]).groupBy(*qs).agg(*(F.sum(f).alias(f) for f in fs)).select(*(F.col(q).alias(c) for c, q in zip(cs, qs, strict=True)), *fs)
    # the finest cells around a node, less the node itself in its own
    around = P
    for c, q in zip(cs, qs, strict=True):
        around = around.withColumn(q, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    own = F.lit(True)
    for c, q in zip(cs, qs, strict=True):
        own = own & (F.col(c) == F.col(q))
    n = F.col("n") - own.cast("int")
    centre = [(F.col(f"s{x}") - F.when(own, F.col(x)).otherwise(0.0)) / n for x in xs]
    sums = fine.select(*(F.col(c).alias(q) for c, q in zip(cs, qs, strict=True)), "n", *(f"s{x}" for x in xs))
    pushes = [F.when(n > 0, p).otherwise(0.0) for p in _push([F.col(x) for x in xs], centre, n, k)]
    close = around.join(sums, qs).select("node", *(p.alias(f) for p, f in zip(pushes, fs, strict=True))).groupBy("node").agg(*(F.sum(f).alias(f) for f in fs))
    whole = close.join(P.select("node", *cs), "node").join(far.select(*cs, *(F.col(f).alias(f"far{f}") for f in fs)), cs, "left")
    return whole.select("node", *((F.col(f) + F.coalesce(f"far{f}", F.lit(0.0))).alias(f) for f in fs))


def attraction(P: DataFrame, ends: DataFrame, dims: int, k: float) -> DataFrame:
    """node and the pull of its edges: distance * distance / k each, combined before the shuffle."""
    xs, fs = _names("x", dims), _names("f", dims)
    there = P.select(F.col("node").alias("other"), *(F.col(x).alias(f"o{x}") for x in xs))
    both = ends.join(P, "node").join(there, "other")
    apart = [F.col(f"o{x}") - F.col(x) for x in xs]
    length = F.sqrt(sum((a * a for a in apart), F.lit(0.0)))
    return both.select("node", *((a * length / k).alias(f) for a, f in zip(apart, fs, strict=True))).groupBy("node").agg(*(F.sum(f).alias(f) for f in fs))


def force_layout(R: DataFrame, dims: int = 2, rounds: int = 30, levels: int | None = None) -> DataFrame:
    """node, x0, x1 (and x2): places of all ends of edges, those without outgoing ones too; the same graph gives the same places up to rounding."""
    ends = _step(symmetric(R).select("node", "other").distinct())
    nodes = ends.select("node").distinct()
    xs, fs = _names("x", dims), _names("f", dims)
    P = _step(nodes.select("node", *((F.pmod(F.xxhash64("node", F.lit(d)), F.lit(1 << 30)) / float(1 << 30)).alias(x) for d, x in enumerate(xs))))
    n = P.count()
    if n == 0:
        return P
    pulls = ends.where("node <> other")
    k = (1.0 / n) ** (1 / dims)
    levels = levels or min(MOST_LEVELS, max(2, math.ceil(math.log2(n) / dims)))
    heat = START
    for _ in range(rounds):
        push = repulsion(P, dims, k, levels)
        both = push.unionByName(attraction(P, pulls, dims, k)).groupBy("node").agg(*(F.sum(f).alias(f) for f in fs))
        size = F.sqrt(sum((F.col(f) * F.col(f) for f in fs), F.lit(1e-18)))
        step = F.least(size, F.lit(heat)) / size
        P = _step(P.join(both, "node").select("node", *((F.col(x) + F.col(f) * step).alias(x) for x, f in zip(xs, fs, strict=True))))
        heat *= COOLING
    return P
