"""Joins between elements, edges and satellite tables (rows E1-E22)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import traversal

UNRESOLVED = "__unresolved__"


def resolve_calls(E: DataFrame, R: DataFrame) -> DataFrame:
    """Unresolved call targets become the function of that name in the hinted file, else the first of that name."""
    calls = R.where((F.col("rel_type") == "calls") & F.col("target_qualified").startswith(UNRESOLVED))
    calls = calls.withColumn("callee", F.expr(f"substring(target_qualified, {len(UNRESOLVED) + 1})")).withColumn("hint", F.get_json_object("metadata", "$.callee_file_hint"))
    functions = E.where(F.col("element_type").isin("function", "method")).select("name", "file_path", "qualified_name")
    first = functions.groupBy("name").agg(F.min("qualified_name").alias("by_name")).withColumnRenamed("name", "callee")
    hinted = functions.groupBy("name", "file_path").agg(F.min("qualified_name").alias("by_file")).withColumnsRenamed({"name": "callee", "file_path": "hint"})
    found = calls.join(hinted, ["callee", "hint"], "left").join(first, "callee", "left")
    fixed = found.withColumn("target_qualified", F.coalesce("by_file", "by_name", "target_qualified"))
    method = F.when(F.col("by_file").isNotNull(), "name_file_hint").when(F.col("by_name").isNotNull(), "name").otherwise("unresolved")
    return fixed.select("source_qualified", "target_qualified", "rel_type", "confidence", method.alias("resolution_method"), "env")


def upgrade_typed(R: DataFrame, types: DataFrame) -> DataFrame:
    """Calls whose (source, target) the type registry knows get confidence 1 and the method ``typed``."""
    known = types.select("source_qualified", "target_qualified").distinct().withColumn("typed", F.lit(True))
    out = R.join(known, ["source_qualified", "target_qualified"], "left")
    return out.withColumn("confidence", F.when(F.col("typed"), 1.0).otherwise(F.col("confidence"))).withColumn("resolution_method", F.when(F.col("typed"), "typed")).drop("typed")


def callers(E: DataFrame, R: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """E3."""
    to = R.where((F.col("rel_type") == "calls") & F.col("target_qualified").contains(name)).select(F.col("source_qualified").alias("qualified_name"))
    return E.join(to, "qualified_name", "left_semi").orderBy("qualified_name").limit(limit)


def dependencies(R: DataFrame, path: str) -> DataFrame:
    """Imports out of a path, with its stored confidence."""
    bare = path.removeprefix("./")
    return R.where(F.col("source_qualified").isin(bare, f"./{bare}") & (F.col("rel_type") == "imports")).select("target_qualified", "confidence")


def dependents(R: DataFrame, name: str) -> DataFrame:
    """Every incoming edge."""
    return R.where(F.col("target_qualified") == name).select("source_qualified", "rel_type", "confidence")


def _clusters(E: DataFrame, end: str) -> DataFrame:
    return E.select(F.col("qualified_name").alias(f"{end}_qualified"), F.col("cluster_id").alias(f"{end}_cluster"))


def tunnels(E: DataFrame, R: DataFrame) -> DataFrame:
    """E5: edges between two different clusters."""
    out = R.join(_clusters(E, "source"), "source_qualified").join(_clusters(E, "target"), "target_qualified")
    return out.where(F.col("source_cluster") != F.col("target_cluster"))


def surprising_edges(E: DataFrame, R: DataFrame, gods: DataFrame, limit: int = 10) -> DataFrame:
    """Edges across clusters that touch one of ``gods`` (qualified_name).

    Both ends are looked up by equality, and only the edges that touch a god go
    on to have their clusters compared. A list of gods that Spark knows to be
    short, as a top list is, is broadcast; one of any other length is shuffled.
    """
    known = gods.select("qualified_name").distinct()
    source = known.select(F.col("qualified_name").alias("source_qualified"), F.lit(True).alias("__source_god"))
    target = known.select(F.col("qualified_name").alias("target_qualified"), F.lit(True).alias("__target_god"))
    touched = R.join(source, "source_qualified", "left").join(target, "target_qualified", "left")
    touched = touched.where("__source_god or __target_god").drop("__source_god", "__target_god")
    return tunnels(E, touched).orderBy(F.desc("confidence"), "source_qualified", "target_qualified", "rel_type").limit(limit)


def induced(E: DataFrame, R: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The elements that satisfy ``keep`` and the edges between them."""
    nodes = E.where(keep)
    key = nodes.select("qualified_name").distinct()
    inside = R.join(key.withColumnRenamed("qualified_name", "source_qualified"), "source_qualified", "left_semi")
    return nodes, inside.join(key.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_semi")


def consistency(E: DataFrame, R: DataFrame, now: int) -> DataFrame:
    """Stale edges, then missing targets, then missing sources.

    The names at edges' ends are looked up once each, and only the names that no
    element has meet the edges again; no metadata travels.
    """
    valid_to = F.get_json_object("metadata", "$.valid_to").cast("long")
    edges = R.select("source_qualified", "target_qualified", "rel_type", F.coalesce(valid_to < now, F.lit(False)).alias("stale"))
    key = E.select("qualified_name")

    def missing(end: str, mark: str) -> DataFrame:
        names = edges.where(~F.col("stale") & F.col(end).isNotNull()).select(F.col(end).alias("qualified_name")).distinct()
        return traversal._step(names.join(key, "qualified_name", "left_anti")).select(F.col("qualified_name").alias(end), F.lit(True).alias(mark))

    no_s, no_t = missing("source_qualified", "no_s"), missing("target_qualified", "no_t")
    out = edges.join(no_t, "target_qualified", "left").join(no_s, "source_qualified", "left")
    gone = lambda end, mark: F.col(mark).isNotNull() | F.col(end).isNull()
    issue = F.when(F.col("stale"), "STALE").when(gone("target_qualified", "no_t"), "TARGET_MISSING").when(gone("source_qualified", "no_s"), "SOURCE_MISSING")
    return out.select("source_qualified", "target_qualified", "rel_type", issue.alias("issue")).where(F.col("issue").isNotNull())


def dead_code(E: DataFrame, R: DataFrame, min_lines: int) -> DataFrame:
    """Functions with span >= 2 * min_lines - 1 that nothing calls, tests or refers to by name, and that call nothing."""
    candidates = E.where(F.col("element_type").isin("function", "method") & (F.col("line_end") - F.col("line_start") >= 2 * min_lines - 1))
    live = R.where(F.col("rel_type").isin("calls", "tests", "tested_by")).select(F.col("target_qualified").alias("qualified_name"))
    bare = R.where(F.col("rel_type") == "references").select(F.element_at(F.split("target_qualified", "::"), -1).alias("name"))
    calling = R.where(F.col("rel_type") == "calls").select(F.col("source_qualified").alias("qualified_name"))
    return candidates.join(live, "qualified_name", "left_anti").join(bare, "name", "left_anti").join(calling, "qualified_name", "left_anti")


def orphans(state: DataFrame, E: DataFrame) -> DataFrame:
    """E10."""
    return state.join(E, "qualified_name", "left_anti")


def stale_items(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items (qualified_name, content_hash and others) that are not fresh with the same non-empty hash."""
    known = state.select("qualified_name", "state", F.col("content_hash").alias("old_hash")).hint("merge")  # states grow with the items: no side is broadcast
    fresh = (F.col("state") == "fresh") & (F.col("old_hash") != "") & (F.col("old_hash") == F.col("content_hash"))
    return items.join(known, "qualified_name", "left").where(~F.coalesce(fresh, F.lit(False))).select(items.columns)


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, hash) that differ or are new."""
    old = before.select("path", F.col("hash").alias("old"))
    return now.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("path", "hash")


def cross_repo_similar(E: DataFrame, repo: Column, symbol: Column, limit: int) -> DataFrame:
    """The same symbol in two repositories. Pairs are made of the repositories' least names, not of all elements."""
    one = E.select(repo.alias("repo"), symbol.alias("symbol"), "qualified_name").groupBy("symbol", "repo").agg(F.min("qualified_name").alias("qualified_name"))
    a, b = one.withColumnsRenamed({"repo": "repo_a", "qualified_name": "a"}), one.withColumnsRenamed({"repo": "repo_b", "qualified_name": "b"})
    return a.join(b, "symbol").where("repo_a < repo_b").orderBy("symbol", "a", "b").limit(limit)


def traceability(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """Each annotated element's documents, as a sorted list."""
    listed = annotations.join(docs, "element_qualified", "left").groupBy("element_qualified", "user_story_id", "feature_id")
    return listed.agg(F.sort_array(F.collect_set("doc")).alias("docs"))


def traceability_matrix(features: DataFrame, workflows: DataFrame, annotated: DataFrame, docs: DataFrame) -> DataFrame:
    """The number of workflows, annotated elements and documents of each feature."""
    out = features.select("feature_id").distinct()
    for name, side in (("workflows", workflows), ("annotated", annotated), ("docs", docs)):
        out = out.join(side.groupBy("feature_id").agg(F.count("*").alias(name)), "feature_id", "left").fillna(0, [name])
    return out


def feature_flow(features: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """Feature, its workflows and their steps in order."""
    ordered = steps.groupBy("workflow_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "step"))), lambda x: x["step"]).alias("steps"))
    return features.join(links, "feature_id").join(ordered, "workflow_id", "left").select("feature_id", "workflow_id", "steps")


def related_docs(R: DataFrame, path: str) -> DataFrame:
    """E17a."""
    out = R.where((F.col("source_qualified") == path) & (F.col("rel_type") == "documented_by")).select(F.col("target_qualified").alias("doc"))
    back = R.where((F.col("target_qualified") == path) & (F.col("rel_type") == "references")).select(F.col("source_qualified").alias("doc"))
    return out.unionByName(back).distinct()


def files_of_doc(R: DataFrame, doc: str) -> DataFrame:
    """E17b."""
    return R.where((F.col("source_qualified") == doc) & (F.col("rel_type") == "references")).select("target_qualified").distinct()


def tests_of(R: DataFrame, path: str) -> DataFrame:
    """E17c."""
    t = F.lower("target_qualified")
    return R.where((F.col("source_qualified") == path) & (F.col("rel_type").isin("tested_by", "tests") | t.contains("test") | t.contains("spec")))


def nav_graph(E: DataFrame, R: DataFrame) -> DataFrame:
    """Navigation edges with their source's file."""
    nav = R.where(F.col("rel_type").startswith("nav"))
    return nav.join(E.select(F.col("qualified_name").alias("source_qualified"), "file_path"), "source_qualified", "left")


def screen_args(E: DataFrame, screen: str) -> DataFrame:
    """E18."""
    parents = E.where(F.col("name").contains(screen)).select(F.col("qualified_name").alias("parent_qualified"))
    return E.where(F.col("element_type") == "nav_argument").join(parents, "parent_qualified", "left_semi")


def find_route(E: DataFrame, needle: str) -> DataFrame:
    """E18."""
    return E.where((F.col("element_type") == "route") & (F.col("name").contains(needle) | F.col("metadata").contains(needle)))


def valid_at(R: DataFrame, at: int) -> DataFrame:
    """Edges whose validity, open at either end, holds at epoch second ``at``."""
    start, end = F.get_json_object("metadata", "$.valid_from").cast("long"), F.get_json_object("metadata", "$.valid_to").cast("long")
    return R.where((start.isNull() | (start <= at)) & (end.isNull() | (end >= at)))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each row of ``left`` the latest ``value`` of ``right`` no later than it (null if none), as a column of that name.

    Time is cut into parts (days, if it is a timestamp, else a number's 86,400ths; ``part``
    says otherwise), so that a task sorts a key's rows of one part; the last value of each earlier part
    is carried on from a row for each key and part. Of values of one time the largest counts; null values don't.
    """
    number = isinstance(left.schema[left_time].dataType, NumericType)
    coarse = part or ((lambda t: F.floor(t / 86_400)) if number else (lambda t: F.date_trunc("day", t)))
    mark = "as_of_" + uuid.uuid4().hex[:8]  # no column of the caller's
    at, own, held, when, last = (f"{mark}_{c}" for c in ("time", "own", "held", "part", "last"))
    names = [f"{mark}_{k}" for k in range(len(keys))]
    kind = right.schema[value].dataType
    key = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    facts = right.where(F.col(value).isNotNull() & F.col(right_time).isNotNull()).select(*key, F.col(right_time).alias(at), F.col(value).alias(held)).withColumn(when, coarse(F.col(at)))
    asked = left.select("*", *key, F.col(left_time).alias(at)).withColumn(when, coarse(F.col(at)))
    both = asked.withColumn(held, F.lit(None).cast(kind)).withColumn(own, F.lit(1)).unionByName(facts.withColumn(own, F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*names, when).orderBy(at, own, held).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn(held, F.last(held, ignorenulls=True).over(inside)).where(F.col(own) == 1).drop(own)
    lasts = facts.groupBy(*names, when).agg(F.max_by(held, F.struct(at, held)).alias(last))
    parts = lasts.unionByName(asked.select(*names, when).distinct().withColumn(last, F.lit(None).cast(kind))).groupBy(*names, when).agg(F.max(last).alias(last))
    before = Window.partitionBy(*names).orderBy(when).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*(F.col(c).alias(f"{c}_b") for c in (*names, when)), F.last(last, ignorenulls=True).over(before).alias(last))
    same = F.lit(True)
    for c in (*names, when):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return near.join(carried, same, "left").withColumn(value, F.coalesce(held, last)).select(*left.columns, *([value] if value not in left.columns else []))


def service_context(services: DataFrame, R: DataFrame, incidents: DataFrame) -> DataFrame:
    """Calls out, calls in and open incidents of each service."""
    calls = R.where(F.col("rel_type") == "service_calls")
    out = calls.groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count("*").alias("calls_out"))
    back = calls.groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count("*").alias("calls_in"))
    broken = incidents.groupBy("qualified_name").agg(F.count("*").alias("incidents"))
    joined = services.join(out, "qualified_name", "left").join(back, "qualified_name", "left").join(broken, "qualified_name", "left")
    return joined.fillna(0, ["calls_out", "calls_in", "incidents"])


def env_conflicts(services: DataFrame) -> DataFrame:
    """Services missing somewhere or with another version than the first environment that has them."""
    versions = [F.max(F.when(F.col("env") == e, F.col("version"))).alias(e) for e in ("local", "staging", "production")]
    wide = services.groupBy("name").agg(*versions).withColumn("base", F.coalesce("local", "staging", "production"))
    parts = []
    for env in ("local", "staging", "production"):
        kind = F.when(F.col(env).isNull(), "missing").when(F.col(env) != F.col("base"), "version")
        parts.append(wide.select("name", F.lit(env).alias("env"), kind.alias("conflict"), "base", F.col(env).alias("version")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("conflict").isNotNull())


def set_quality(returned: DataFrame, expected: DataFrame, key: str = "item") -> DataFrame:
    """Precision, recall and F1 of two distinct sets; 0 where undefined."""
    r, e = returned.select(key).distinct().withColumn("r", F.lit(1)), expected.select(key).distinct().withColumn("e", F.lit(1))
    n = r.join(e, key, "full").agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_returned"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_expected"),
        F.coalesce(F.sum(F.when(F.col("r").isNotNull() & F.col("e").isNotNull(), 1)), F.lit(0)).alias("n_hit"),
    )
    p = F.when(F.col("n_returned") > 0, F.col("n_hit") / F.col("n_returned")).otherwise(0.0)
    c = F.when(F.col("n_expected") > 0, F.col("n_hit") / F.col("n_expected")).otherwise(0.0)
    return n.withColumn("precision", p).withColumn("recall", c).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
