"""Subgraphs that answer a question in words (row G7)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import type_rank
from .traversal import reach, shortest_path, symmetric

# Bounds of an answer.
MAX_SEEDS, MAX_NODES, MAX_DEPTH, MAX_EDGES = 8, 40, 5, 500
#: Tokens that stand between the two ends of a connection, the clearest first.
JOINTS = ("->", "→", "↔", "to", "with", "and")
#: Words that hold an English question together and name no node.
GLUE = frozenset(
    "what which who whose where when why how does did can could is are was were be been has have "  # asking
    "a an the this that these those it its "  # pointing
    "there in on at of by for from into between through via to with and or path paths way ways".split()  # relating
)


def terms_of(question: str) -> list[str]:
    """The words that may name nodes; the two ends of a connection, where there is a joint between two names, come first."""
    tokens = re.findall(r"->|→|↔|\w(?:[\w.:/-]*\w)?", question.lower())
    names = [k for k, t in enumerate(tokens) if t[0].isalnum() and len(t) > 1 and t not in GLUE and not t.startswith("connect")]
    ends: list[int] = []
    for joint in JOINTS:
        for at in (k for k, t in enumerate(tokens) if t == joint):
            left, right = [k for k in names if k < at], [k for k in names if k > at]
            if left and right and not ends:
                ends = [left[-1], right[0]]
    ordered = [*ends, *(k for k in names if k not in ends)]
    return list(dict.fromkeys(tokens[k] for k in ordered))[:MAX_SEEDS]


def seeds_of(E: DataFrame, terms: list[str]) -> DataFrame:
    """term, node: for each term the best element, by one scan: exact name, then part of the name, then of the id."""
    name, key = F.lower("name"), F.lower("qualified_name")
    level = lambda t: F.when(name == t, 0).when(name.contains(t), 1).when(key.contains(t), 2)
    tries = F.array(*(F.struct(F.lit(t).alias("term"), level(t).alias("level")) for t in terms))
    hits = E.select("qualified_name", type_rank(F.col("element_type")).alias("rank"), F.explode(tries).alias("x")).where("x.level is not null")
    best = hits.groupBy("x.term").agg(F.min(F.struct("x.level", "rank", "qualified_name")).alias("b"))
    return best.select("term", F.col("b.qualified_name").alias("node"))


def question_subgraph(E: DataFrame, R: DataFrame, question: str, budget: int = 2000, depth: int = 2) -> DataFrame:
    """Edges that answer the question: those of a path between the first two terms' nodes, then those near the seeds.

    The edges are ranked by on_path, confidence and ends, and the first stay
    whose tokens fit the budget. No term or no match: no row.
    """
    terms = terms_of(question)
    if not terms:
        raise ValueError("the question names nothing")
    spark = E.sparkSession
    seeds = {r["term"]: r["node"] for r in seeds_of(E, terms).collect()}  # at most MAX_SEEDS rows
    schema = "node string"
    start = spark.createDataFrame([(n,) for n in sorted(set(seeds.values()))], schema)
    ends = [seeds[t] for t in terms[:2] if t in seeds]
    path: list[str] = []
    if len(set(ends)) == 2:
        row = shortest_path(R, *ends).first()
        path = list(row["path"]) if row else []
    near = reach(symmetric(R).select("node", "other", "confidence"), start, max(1, min(depth, MAX_DEPTH)))
    near = near.orderBy("depth", "node").limit(MAX_NODES).select("node")
    nodes = F.broadcast(near.unionByName(spark.createDataFrame([(n,) for n in path], schema)).distinct())  # at most MAX_NODES and a path
    inside = R.join(nodes.withColumnRenamed("node", "source_qualified"), "source_qualified", "left_semi")
    inside = inside.join(nodes.withColumnRenamed("node", "target_qualified"), "target_qualified", "left_semi")
    steps = [f"{a}\t{b}" for x, y in zip(path, path[1:], strict=False) for a, b in ((x, y), (y, x))]
    on_path = F.concat_ws("\t", "source_qualified", "target_qualified").isin(steps) if steps else F.lit(False)
    edges = inside.select("source_qualified", "target_qualified", "rel_type", "confidence", on_path.alias("on_path")).distinct()
    tokens = F.ceil(F.octet_length(F.to_json(F.struct("source_qualified", "target_qualified", "rel_type", "confidence"))) / 4).cast("long")
    order = [F.desc("on_path"), F.desc("confidence"), F.asc("source_qualified"), F.asc("target_qualified"), F.asc("rel_type")]
    top = edges.orderBy(*order).limit(MAX_EDGES).withColumn("tokens", tokens)
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= max(200, min(budget, 20_000)))
