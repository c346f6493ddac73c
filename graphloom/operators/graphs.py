"""Connected components, descent to functions and mergeable sketches (rows G15, G5, F19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traversal import _step, symmetric

ROUNDS = 64


def connected_components(R: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every node that has an edge to another.

    Hooking and pointer jumping: every node points at its least neighbour if
    that is smaller, pointers are followed until they end at roots, and the
    edges are drawn between roots, until none is left. Least neighbours are
    combined before the shuffle, so a hub needs no task of its own.
    """
    edges = _step(symmetric(R).where("node <> other").select("node", "other").distinct())
    found = edges.select("node", F.col("node").alias("component")).distinct()
    for _ in range(ROUNDS):
        if edges.isEmpty():
            return found
        hooks = edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root"))
        hooks = _step(hooks)
        for _ in range(ROUNDS):  # pointers double in length
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = _step(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("component"), "root")
        found = _step(found.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        first = edges.join(hooks, "node").select(F.col("root").alias("a"), "other")
        both = first.join(hooks.select(F.col("node").alias("other"), F.col("root").alias("b")), "other")
        edges = _step(both.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct())
    raise RuntimeError(f"components still change after {ROUNDS} rounds")


# From what stands above code down to functions

_CONCEPT = ["owns_concept", "implements_concept", "exposes_endpoint", "reads_from", "writes_to", "documents_concept"]
_STEP = ["next_step", "branches_to", "implemented_by", "handled_by_playbook", "has_failure_mode", "resolved_by_playbook"]
_WORKFLOW = ["has_step", "next_step", "branches_to", "implemented_by", "entry_point_of", "step_in_process"]
_ISSUE = ["has_known_issue", "resolved_by_playbook", "documents_concept"]
_CLASS = ["contains", "defines", "has_method", "has_property"]
_FILE = ["contains", "defines", "imports", "references", "tested_by", "documented_by"]
#: Hops, fan-out and edge types for the types of seeds (fixed values); '' is for all other types.
DOWNWARD: list[tuple[list[str], int, int, list[str]]] = [
    (["class", "struct", "interface", "trait"], 1, 12, _CLASS),
    (["module"], 2, 16, _CLASS),
    (["file"], 1, 12, _FILE),
    (["document"], 1, 10, ["references", "documented_by"]),
    (["doc_section"], 2, 10, ["contains", "references", "documented_by"]),
    (["workflow"], 2, 15, _WORKFLOW),
    (["workflow_step", "decision_point", "failure_mode"], 1, 12, _STEP),
    (["domain_entity", "service", "api_endpoint", "data_store"], 2, 12, _CONCEPT),
    (["known_issue", "playbook", "playbook_step", "team_knowledge"], 1, 8, _ISSUE),
    ([""], 1, 5, ["documented_by", "documents_concept"]),
]
FUNCTION_TYPES = ("function", "method", "constructor")
FUNCTION_CAP = 80


def _rule(of: Column, place: int) -> Column:
    """One part of the rule of a type: 1 hops, 2 fan-out, 3 edge types."""
    lit = (lambda v: F.array(*map(F.lit, v))) if place == 3 else F.lit
    out = lit(DOWNWARD[-1][place])
    for rule in DOWNWARD[:-1]:
        out = F.when(of.isin(rule[0]), lit(rule[place])).otherwise(out)
    return out


def functions_below(E: DataFrame, R: DataFrame, seeds: DataFrame, cap: int = FUNCTION_CAP) -> DataFrame:
    """Seeds (seed, element_type) -> the functions below them: qualified_name, hop, seed, via_edge.

    A labelled frontier: (seed, node) pairs move along the edges that the seed's
    type allows, in both directions, to elements that exist; functions end a way.
    Each seed gets its fan-out's first functions by hop and name. A seed that
    reaches none takes the code_refs of its metadata: an element's name, a
    ``path::symbol``, or a file or folder. A function has its least hop and of equal ones the
    least seed; of all, the first ``cap`` by hop, seed and name.
    """
    kinds = E.groupBy("qualified_name").agg(F.min("element_type").alias("kind")).withColumnRenamed("qualified_name", "other")
    asked = _step(seeds.select("seed", "element_type").distinct().select("seed", _rule(F.col("element_type"), 1).alias("hops"), _rule(F.col("element_type"), 2).alias("fan_out"), _rule(F.col("element_type"), 3).alias("allowed")))
    moves = symmetric(R).select("node", "other", "rel_type").where(F.col("rel_type").isin(sorted({t for rule in DOWNWARD for t in rule[3]})))
    front = asked.select("seed", F.col("seed").alias("node"))
    seen, found = front, None
    for hop in range(1, max(rule[1] for rule in DOWNWARD) + 1):
        live = front.join(asked.where(F.col("hops") >= hop), "seed")
        step = live.join(moves, "node").where(F.array_contains("allowed", F.col("rel_type"))).groupBy("seed", "other", "hops").agg(F.min("rel_type").alias("via_edge"))
        fresh = step.join(seen.withColumnRenamed("node", "other"), ["seed", "other"], "left_anti").join(kinds, "other")
        fresh = _step(fresh.select("seed", F.col("other").alias("node"), "hops", "via_edge", F.col("kind").isin(*FUNCTION_TYPES).alias("ends")))
        hit = fresh.where("ends").select("seed", F.col("node").alias("qualified_name"), F.lit(hop).alias("hop"), "via_edge")
        found = hit if found is None else found.unionByName(hit)
        seen = seen.unionByName(fresh.select("seed", "node"))
        front = fresh.where("NOT ends").select("seed", "node")
    found = found.unionByName(_by_references(E, asked.join(found.select("seed").distinct(), "seed", "left_anti")))
    of_seed = Window.partitionBy("seed").orderBy("hop", "qualified_name")
    kept = found.join(asked.select("seed", "fan_out"), "seed").withColumn("k", F.row_number().over(of_seed)).where("k <= fan_out")
    best = kept.groupBy("qualified_name").agg(F.min(F.struct("hop", "seed", "via_edge")).alias("x")).select("qualified_name", "x.*")
    return best.orderBy("hop", "seed", "qualified_name").limit(cap)


def _by_references(E: DataFrame, alone: DataFrame) -> DataFrame:
    """The functions that the code_refs of seeds name: joined by the element's name, or by its path and every folder above it."""
    listed = F.explode(F.from_json(F.get_json_object("metadata", "$.code_refs"), "array<string>"))
    refs = E.join(alone.select(F.col("seed").alias("qualified_name")), "qualified_name").select(F.col("qualified_name").alias("seed"), listed.alias("ref")).withColumn("ref", F.trim("ref"))
    parts = F.split("ref", "::", 2)
    refs = refs.distinct().select("seed", "ref", F.element_at(parts, 1).alias("place"), F.lower(F.get(parts, 1)).alias("symbol"))
    functions = E.where(F.col("element_type").isin(*FUNCTION_TYPES)).select("qualified_name", "name", "file_path")
    exact = refs.join(functions.withColumn("ref", F.col("qualified_name")), "ref").select("seed", "ref", "qualified_name")
    folders = F.split("file_path", "/")
    above = functions.withColumn("place", F.explode(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, 1, k), "/"))))
    named = (F.lower("name") == F.col("symbol")) | F.lower("qualified_name").endswith(F.concat(F.lit("::"), "symbol"))
    other = refs.join(exact.select("seed", "ref").distinct(), ["seed", "ref"], "left_anti").join(above, "place").where(F.col("symbol").isNull() | named)
    both = exact.select("seed", "qualified_name").unionByName(other.select("seed", "qualified_name")).distinct()
    return both.select("seed", "qualified_name", F.lit(1).alias("hop"), F.lit("code_ref").alias("via_edge"))


# sketches that are kept for each part and merged

#: The logarithm of a distinct sketch's size, and the size of a quantile sketch.
DISTINCT_BITS, QUANTILE_SIZE = 14, 400


def sketches(rows: DataFrame, by: list[str | Column], distinct: str, value: str) -> DataFrame:
    """For each part (a day, a file): its number of rows, a sketch of the distinct values of one column and one of the quantiles of another."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), DISTINCT_BITS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("value_sketch"))


def merge_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger parts from those of smaller ones; no row is read again."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(parts: DataFrame, shares: list[float]) -> DataFrame:
    """The estimates of merged sketches: n_distinct, and a quantile for each share."""
    q = [F.kll_sketch_get_quantile_double("value_sketch", F.lit(s)).alias(f"q{round(100 * s)}") for s in shares]
    return parts.select(*(c for c in parts.columns if not c.endswith("_sketch")), F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *q)


def days_of(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with the day of an instant as a column, the part that is refreshed."""
    return rows.withColumn("day", F.to_date(at))
