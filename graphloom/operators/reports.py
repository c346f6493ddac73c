"""Reports and answers put together from the other operators (rows C5, D18, E21, F3, F17, F19, G15, I6, N1, N2, N6, N8)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, ranking, scans, tables, traversal

# Names of entry points, parts of the paths of worktree copies, environments.
ENTRY_NAMES = ["main", "Main", "start", "serve", "Start"]
WORKTREES = ["/.claude/worktrees/", "/.worktrees/"]
ENVS = ["local", "staging", "production"]


def architecture(E: DataFrame, R: DataFrame, hot: int = 10) -> DataFrame:
    """(section, name, n): languages, types, clusters, relations, entry points, routes and the ``hot`` files with most functions.

    Every section is whole but the hotspots, a top list; a null language or cluster is left out.
    """

    def count(df: DataFrame, section: str, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")

    entry = E.where((F.col("element_type") == "function") & F.col("name").isin(ENTRY_NAMES))
    routes = E.where(F.col("element_type") == "route").select(F.concat_ws(" ", F.get_json_object("metadata", "$.method"), F.coalesce(F.get_json_object("metadata", "$.path"), "name")).alias("name"))
    files = count(E.where("element_type = 'function'"), "hotspot", "file_path").orderBy(F.desc("n"), "name").limit(hot)
    parts = [count(E, "language", "language"), count(E, "type", "element_type"), count(E, "cluster", "cluster_id"), count(R, "relation", "rel_type"), count(entry, "entry_point", "qualified_name"), count(routes, "route", "name"), files]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def review_context(E: DataFrame, R: DataFrame, files: list[str]) -> DataFrame:
    """(kind, subject, detail): the files' elements without worktree copies, the edges leaving them or the files, and a prompt row with the totals."""
    copy = F.lit(False)
    for part in WORKTREES:
        copy = copy | F.col("file_path").contains(part)
    own = scans.among(E, "file_path", files).where(~copy)
    elements = own.select(F.lit("element").alias("kind"), F.col("qualified_name").alias("subject"), F.concat_ws(" ", "element_type", F.concat_ws("-", "line_start", "line_end")).alias("detail"))
    sources = own.select(F.col("qualified_name").alias("source_qualified")).unionByName(E.sparkSession.createDataFrame([(f,) for f in files], "source_qualified string")).distinct()
    edges = R.join(sources, "source_qualified", "left_semi").select(F.lit("edge").alias("kind"), F.col("source_qualified").alias("subject"), F.concat_ws(" ", "rel_type", "target_qualified").alias("detail"))
    both = elements.unionByName(edges)
    n = both.agg(F.count(F.when(F.col("kind") == "element", 1)).alias("e"), F.count(F.when(F.col("kind") == "edge", 1)).alias("r"))
    prompt = n.select(F.lit("prompt").alias("kind"), F.lit("review").alias("subject"), F.format_string(f"Review {len(files)} files with %d elements and %d outgoing edges.", "e", "r").alias("detail"))
    return both.unionByName(prompt)


def change_set(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of two listings (path, content_hash): added, deleted or modified; equal ones are left out."""
    both = before.select("path", F.col("content_hash").alias("was"), F.lit(True).alias("b")).join(now.select("path", F.col("content_hash").alias("is"), F.lit(True).alias("n")), "path", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def self_test(E: DataFrame, R: DataFrame) -> DataFrame:
    """(check_name, ok, n_bad), one row a check; one pass over each table and one join for the ends."""
    e = E.agg(
        F.count(F.when(F.col("qualified_name").isNull(), 1)).alias("named"), F.count(F.when(F.col("line_end") < F.col("line_start"), 1)).alias("line_order"),
        F.count(F.when(~F.coalesce(F.col("env"), F.lit("")).isin(ENVS), 1)).alias("known_env"),
        (F.count("qualified_name") - F.count_distinct("qualified_name")).alias("unique_names"),
    )
    r = R.agg(F.count(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), 1)).alias("confidence_range"), F.count(F.when(F.col("source_qualified") == F.col("target_qualified"), 1)).alias("no_loops"))
    ends = R.groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count("*").alias("n"))
    lost = ends.join(E.select("qualified_name"), "qualified_name", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("resolved_targets"))

    def long(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("n_bad")) for c in df.columns]
        return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.check_name", (F.col("x.n_bad") == 0).alias("ok"), "x.n_bad")

    return long(e).unionByName(long(r)).unionByName(long(lost))


def env_drift(services: DataFrame) -> DataFrame:
    """(name, env, conflict, risk) from rows (name, env, version, config): missing in an environment, another
    version than the first environment that has the service, or the same version with another configuration.

    Of several rows of one service in one environment the one with the least (version, config) counts.
    """
    first = [F.min(F.when(F.col("env") == e, F.struct("version", "config"))).alias(e) for e in ENVS]
    wide = services.groupBy("name").agg(*first).withColumn("base", F.coalesce(*ENVS))

    def conflict(e: str) -> Column:
        here, base = F.col(e), F.col("base")
        kind = F.when(here.isNull(), "missing").when(~here["version"].eqNullSafe(base["version"]), "version").when(~here["config"].eqNullSafe(base["config"]), "drift")
        return F.struct(F.lit(e).alias("env"), kind.alias("conflict"), F.when(kind == "version", "HIGH").when((kind == "missing") & (F.lit(e) == "production"), "HIGH").otherwise("MEDIUM").alias("risk"))

    rows = wide.select("name", F.explode(F.array(*map(conflict, ENVS))).alias("x"))
    return rows.select("name", "x.*").where("conflict is not null")


def orchestrate(E: DataFrame, R: DataFrame, request: str, target: str) -> DataFrame:
    """The request's intent decides which operator answers for ``target``: rows (intent, item)."""
    words = set(re.split(r"\W+", request.lower()))
    intent = max(ranking.INTENTS, key=lambda k: (len(words & set(ranking.INTENTS[k])) / len(ranking.INTENTS[k]), k == "context"))
    answers: dict[str, Callable[[], DataFrame]] = {
        "impact": lambda: traversal.impact_radius(E, R, target, 2).select(F.col("node").alias("item")),
        "dependencies": lambda: scans.out_edges(R, target).select(F.col("target_qualified").alias("item")).distinct(),
        "search": lambda: scans.search_by_name(E, target).select(F.col("qualified_name").alias("item")),
        "doc": lambda: R.where((F.col("target_qualified") == target) & (F.col("rel_type") == "references")).select(F.col("source_qualified").alias("item")).distinct(),
        "context": lambda: scans.touching(R, target).select(F.when(F.col("source_qualified") == target, F.col("target_qualified")).otherwise(F.col("source_qualified")).alias("item")).distinct(),
    }
    return answers[intent]().select(F.lit(intent).alias("intent"), "item")


def rerank(candidates: DataFrame, score: Column | None = None) -> DataFrame:
    """Candidates of (query_id, item, distance) ranked by a pluggable ``score``, highest first; without one, by distance."""
    order = [score.desc_nulls_last()] if score is not None else []
    w = Window.partitionBy("query_id").orderBy(*order, F.col("distance").asc_nulls_last(), "item")
    return candidates.withColumn("rank", F.row_number().over(w).cast("long"))


def module_summary(E: DataFrame) -> DataFrame:
    """one sentence about each top directory: files, elements and its types in order."""
    module = F.substring_index("file_path", "/", 1)
    types = F.concat_ws(", ", F.sort_array(F.collect_set("element_type")))
    out = E.groupBy(module.alias("module")).agg(F.countDistinct("file_path").alias("f"), F.count("*").alias("n"), types.alias("t"))
    return out.select("module", F.format_string("%s: %d files, %d elements (%s)", "module", "f", "n", "t").alias("summary"))


def cubed(E: DataFrame) -> DataFrame:
    """counts by type and environment with the subtotals of both."""
    return E.cube("element_type", "env").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def grouping_sets(E: DataFrame) -> DataFrame:
    """counts by type and language, and by environment, in one pass."""
    sets = [[F.col("element_type"), F.col("language")], [F.col("env")]]
    return E.groupingSets(sets, "element_type", "language", "env").agg(F.count("*").alias("n"))


def quantiles(E: DataFrame) -> DataFrame:
    """exact median and 0.9 quantile of the lines of each type, interpolated."""
    lines = F.col("line_end") - F.col("line_start") + 1
    return E.groupBy("element_type").agg(F.round(F.percentile(lines, 0.5), 6).alias("median"), F.round(F.percentile(lines, 0.9), 6).alias("p90"))


def read_range(lines: DataFrame, spec: str) -> DataFrame:
    """The rows whose ``line`` is in a specification such as 3-5,9; an empty one takes all, a part that is no range fails."""
    keep = F.lit(not spec.strip())
    for part in filter(None, (p.strip() for p in spec.split(","))):
        found = re.fullmatch(r"(\d+)(?:-(\d+)?)?", part)
        if not found:
            raise ValueError(f"no line range: {part!r}")
        a, b = int(found[1]), found[2]
        keep = keep | ((F.col("line") >= a) & (F.col("line") <= int(b)) if b else (F.col("line") >= a if part.endswith("-") else F.col("line") == a))
    return lines.where(keep)


def triangles(R: DataFrame) -> DataFrame:
    """Triangles of the undirected graph, each (a, b, c) once.

    Edges point from the end of lower degree to the other, so that no node, however connected, has more than
    the square root of twice the edges going out: wedges stay bounded at hot nodes. A wedge goes on from an edge's far
    end, where few edges go out, and is closed by an edge of its first node.
    """
    ends = traversal._step(R.select(F.least("source_qualified", "target_qualified").alias("u"), F.greatest("source_qualified", "target_qualified").alias("v")).where("u < v").distinct())
    degree = ends.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    known = ends.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
    low, high = F.struct("du", "u"), F.struct("dv", "v")
    out = traversal._step(known.select(F.when(low < high, F.col("u")).otherwise(F.col("v")).alias("p"), F.when(low < high, F.col("v")).otherwise(F.col("u")).alias("q")))
    wedge = out.join(out.toDF("q", "r"), "q")
    closed = wedge.join(out.withColumnRenamed("q", "r"), ["p", "r"])
    return closed.select(F.sort_array(F.array("p", "q", "r")).alias("t")).select(*(F.get("t", F.lit(i)).alias(c) for i, c in enumerate("abc")))


def page_rank(R: DataFrame, sweeps: int = 10, damping: float = 0.85) -> DataFrame:
    """Rank of each node; a repeated edge counts once, the rank of a node without edges going out is let go.

    Every sweep joins ranks with edges on the node and combines what each target gets before the shuffle.
    """
    moves = R.select("source_qualified", "target_qualified").distinct()
    nodes = traversal._step(moves.select(F.explode(F.array("source_qualified", "target_qualified")).alias("node")).distinct())
    fan = moves.groupBy("source_qualified").agg(F.count("*").alias("fan"))
    moves = traversal._step(moves.join(fan, "source_qualified").select(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("other"), "fan"))
    n = max(nodes.count(), 1)
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(sweeps):
        got = moves.join(rank, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") / F.col("fan")).alias("got"))
        rank = traversal._step(nodes.join(got, "node", "left").select("node", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return rank


def html(E: DataFrame, R: DataFrame) -> DataFrame:
    """(place, value), the lines of a page with a section for each element and a link for each edge; sort by place and value."""
    x = tables._xml
    head = E.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("<!doctype html><title>Graph</title>").alias("value")))).alias("x")).select("x.*")
    nodes = E.select(F.lit(1).alias("place"), F.format_string('<section id="%s">%s %s</section>', x(F.col("qualified_name")), x(F.col("element_type")), x(F.col("name"))).alias("value"))
    links = R.select(F.lit(2).alias("place"), F.format_string('<a href="#%s" data-from="%s">%s</a>', x(F.col("target_qualified")), x(F.col("source_qualified")), x(F.col("rel_type"))).alias("value"))
    return head.unionByName(nodes).unionByName(links)


def svg(E: DataFrame, R: DataFrame, budget: int = 100) -> DataFrame:
    """The lines of a picture of the ``budget`` best connected nodes on a circle in that order, with the edges between them."""
    nodes, edges = tables.select_for_export(E, R, budget)
    w = Window.orderBy(F.desc("degree"), "qualified_name")  # over at most ``budget`` rows
    turn = 2 * F.pi() * (F.row_number().over(w) - 1) / budget
    at = nodes.select("qualified_name", "name", turn.alias("t")).select("qualified_name", "name", (500 + F.round(400 * F.cos("t"))).cast("long").alias("x"), (500 + F.round(400 * F.sin("t"))).cast("long").alias("y"))
    circles = at.select(F.format_string('<circle cx="%d" cy="%d" r="6"><title>%s</title></circle>', "x", "y", tables._xml(F.col("name"))).alias("value"))
    ends = edges.select("source_qualified", "target_qualified").distinct()
    ends = ends.join(F.broadcast(at.select(F.col("qualified_name").alias("source_qualified"), F.col("x").alias("x1"), F.col("y").alias("y1"))), "source_qualified")
    ends = ends.join(F.broadcast(at.select(F.col("qualified_name").alias("target_qualified"), F.col("x").alias("x2"), F.col("y").alias("y2"))), "target_qualified")
    return circles.unionByName(ends.select(F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"/>', "x1", "y1", "x2", "y2").alias("value")))
