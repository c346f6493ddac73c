"""Reports on a graph small enough to check by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import reports

E = "qualified_name string, element_type string, name string, file_path string, line_start long, line_end long, language string, cluster_id string, metadata string, env string"
R = "source_qualified string, target_qualified string, rel_type string, confidence double"


def graph(spark, elements=(), edges=()):
    rows = [(q, t, q, f, 1, 5, None, None, '{"method":"GET","path":"/a"}', "local") for q, t, f in elements]
    return spark.createDataFrame(rows, E), spark.createDataFrame([(a, b, "calls", 1.0) for a, b in edges], R)


def test_triangles_against_brute_force(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(60)} | {("hub", f"n{k}") for k in range(14)}
    _, edges = graph(spark, (), list(pairs) * 2)  # repeated edges and loops
    linked = {frozenset(p) for p in pairs if len(set(p)) == 2}
    want = {t for t in itertools.combinations(sorted({x for p in pairs for x in p}), 3) if all(frozenset(p) in linked for p in itertools.combinations(t, 2))}
    got = [tuple(r) for r in reports.triangles(edges).collect()]
    assert len(got) == len(want) and set(got) == want


def test_page_rank_of_a_ring_is_even(spark):
    _, edges = graph(spark, (), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "a")])
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in reports.page_rank(edges, 5).collect())


def test_architecture_and_review(spark):
    els, edges = graph(spark, [("main", "function", "f"), ("r", "route", "f"), ("w", "class", "x/.worktrees/f")], [("main", "w"), ("r", "main"), ("w", "r")])
    found = {(r["section"], r["name"]): r["n"] for r in reports.architecture(els, edges).collect()}
    assert found["entry_point", "main"] == found["route", "GET /a"] == found["hotspot", "f"] == 1 and found["relation", "calls"] == 3
    rows = reports.review_context(els, edges, ["f", "x/.worktrees/f"]).collect()
    assert sorted(r["subject"] for r in rows if r["kind"] == "edge") == ["main", "r"]
    assert [r["detail"] for r in rows if r["kind"] == "prompt"] == ["Review 2 files with 2 elements and 2 outgoing edges."]


def test_self_test_names_what_is_wrong(spark):
    els, edges = graph(spark, [("a", "function", "f"), ("a", "function", "f")], [("a", "a"), ("a", "gone")])
    bad = {r["check_name"]: r["n_bad"] for r in reports.self_test(els, edges).collect() if not r["ok"]}
    assert bad == {"unique_names": 1, "no_loops": 1, "resolved_targets": 1}


def test_change_set_drift_and_ranges(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, content_hash string")
    now = spark.createDataFrame([("a", "2"), ("c", None), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in reports.change_set(before, now).collect()} == {("a", "modified"), ("b", "deleted"), ("d", "added")}
    s = spark.createDataFrame([("x", "local", "1", "p"), ("x", "staging", "1", "q"), ("y", "staging", "1", None), ("y", "production", "2", "p")], "name string, env string, version string, config string")
    got = {tuple(r) for r in reports.env_drift(s).collect()}
    assert got == {("x", "staging", "drift", "MEDIUM"), ("x", "production", "missing", "HIGH"), ("y", "local", "missing", "MEDIUM"), ("y", "production", "version", "HIGH")}
    lines = spark.range(1, 11).withColumnRenamed("id", "line")
    assert [r["line"] for r in reports.read_range(lines, "2-3, 9-").orderBy("line").collect()] == [2, 3, 9, 10]
    assert reports.read_range(lines, "").count() == 10
    with pytest.raises(ValueError):
        reports.read_range(lines, "x-3")


def test_rerank_breaks_ties_and_falls_back(spark):
    d = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (1, "c", 0.5), (1, "d", None)], "query_id long, item string, distance double")
    assert [r["item"] for r in reports.rerank(d).orderBy("rank").collect()] == ["b", "a", "c", "d"]
    assert [r["item"] for r in reports.rerank(d, F.col("distance")).orderBy("rank").collect()] == ["a", "c", "b", "d"]


def test_exports_escape_and_empty_graphs(spark):
    els, edges = graph(spark, [('<a "q">', "function", "f"), ("b", "function", "f")], [('<a "q">', "b")])
    assert '<section id="&lt;a &quot;q&quot;&gt;">function &lt;a &quot;q&quot;&gt;</section>' in [r["value"] for r in reports.html(els, edges).collect()]
    assert reports.svg(els, edges).count() == 3
    none, no_edges = graph(spark)
    assert reports.triangles(no_edges).isEmpty() and reports.page_rank(no_edges, 2).isEmpty() and reports.architecture(none, no_edges).isEmpty()
    assert reports.svg(none, no_edges).isEmpty() and all(r["ok"] for r in reports.self_test(none, no_edges).collect())
