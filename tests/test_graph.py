"""The graph engine on hand-made graphs."""

import os

import pytest
from graphloom.functions import text as T
from graphloom.operators import aggregates as A
from graphloom.operators import joins as J
from graphloom.operators import ranking as K
from graphloom.operators import scans as S
from graphloom.operators import tables as W
from graphloom.operators import traversal as G
from graphloom.plans import catalog, views
from graphloom.plans.datalog import Database, DatalogError, mutable
from graphloom.sources import files
from pyspark.sql import functions as F

E_SCHEMA = "qualified_name string, element_type string, name string, file_path string, line_start long, line_end long, language string, parent_qualified string, cluster_id string, metadata string, env string"
R_SCHEMA = "source_qualified string, target_qualified string, rel_type string, confidence double, metadata string, env string"


@pytest.fixture(scope="module")
def graph(spark):
    e = [(f"f.rs::{n}", "function", n, "f.rs", 1, 40, "rust", None, c, "{}", "local") for n, c in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("lone_100%", None))]
    r = [("f.rs::a", "f.rs::b", "calls", 1.0, "{}", "local"), ("f.rs::b", "f.rs::c", "calls", 0.7, '{"valid_from":10,"valid_to":20}', "local"), ("f.rs::c", "f.rs::d", "calls", 0.4, "{}", "local"), ("f.rs::d", "f.rs::gone", "imports", 1.0, "{}", "local")]
    return spark.createDataFrame(e, E_SCHEMA), spark.createDataFrame(r, R_SCHEMA)


def names(df, c="qualified_name"):
    return sorted(x[c].split("::")[-1] for x in df.collect())


def test_needles_are_literal(graph):
    assert names(S.search_by_name(graph[0], "100%")) == ["lone_100%"]
    assert names(S.search_by_name(graph[0], "e_1")) == ["lone_100%"]
    assert names(S.search_by_name(graph[0], "a%")) == []


def test_impact_radius_stops_at_depth_and_confidence(graph):
    assert names(G.impact_radius(*graph, "f.rs::a", 2), "node") == ["b", "c"]
    assert names(G.impact_radius(*graph, "f.rs::a", 3, 0.6), "node") == ["b", "c"]


def test_shortest_path_and_call_graph(graph):
    assert G.shortest_path(graph[1], "f.rs::a", "f.rs::d").first()["hops"] == 3
    assert G.call_graph(graph[1], "f.rs::a", 2).count() == 2


def test_degree_sum_is_twice_the_edges(graph):
    assert A.degrees(graph[1]).agg(F.sum("degree")).first()[0] == 2 * graph[1].count()


def test_consistency_dead_code_tunnels_and_time(graph):
    E, R = graph
    assert {(r["issue"], r["target_qualified"]) for r in J.consistency(E, R, 50).collect()} == {("STALE", "f.rs::c"), ("TARGET_MISSING", "f.rs::gone")}
    assert names(J.dead_code(E, R, 10)) == ["lone_100%"]
    assert J.tunnels(E, R).count() == 1
    assert J.valid_at(R, 15).count() == 4 and J.valid_at(R, 25).count() == 3


def test_communities_are_a_partition(graph):
    out = G.communities(graph[1], 4)
    assert out.count() == out.select("node").distinct().count() == 5


def test_resolve_calls(spark):
    e = spark.createDataFrame([("b.rs::f", "function", "f", "b.rs", 1, 2, "", None, None, "{}", ""), ("a.rs::f", "function", "f", "a.rs", 1, 2, "", None, None, "{}", "")], E_SCHEMA)
    r = spark.createDataFrame([("x", "__unresolved__f", "calls", 1.0, '{"callee_file_hint":"b.rs"}', ""), ("x", "__unresolved__f", "calls", 1.0, "{}", ""), ("x", "__unresolved__g", "calls", 1.0, "{}", "")], R_SCHEMA)
    assert sorted(x["target_qualified"] for x in J.resolve_calls(e, r).collect()) == ["__unresolved__g", "a.rs::f", "b.rs::f"]


def test_datalog_reads_and_writes(spark, graph):
    db = Database({"code_elements": graph[0], "relationships": graph[1], "index_hashes": spark.createDataFrame([("p", "1")], "path string, hash string")})
    assert db.query('?[q] := *code_elements[q, "function", n], n in ["a", "b"], not *relationships{source_qualified: q, target_qualified: "f.rs::b"}').count() == 1
    assert db.query("?[count(q)] := *code_elements[q], *relationships[q, t]").first()[0] == 4
    assert mutable('?[p, h] <- [["p", "2"]] :put index_hashes {path => hash}') and not mutable('?[q] := *x[q, ":put"]')
    with pytest.raises(DatalogError):
        db.query('?[p] <- [["p"]] :rm index_hashes {path}')
    assert db.run('?[path, hash] <- [["p", "2"], ["q", "3"]] :put index_hashes {path => hash}').count() == 2
    assert db.run('?[path] <- [["p"]] :rm index_hashes {path}').count() == 1
    assert db.run(':delete index_hashes where path = "q"').count() == 0


def test_upsert_keeps_other_rows_and_newest_version(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    n = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert sorted(map(tuple, W.upsert(t, n, ["k"], "at").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]


def test_extractors(spark):
    f = spark.createDataFrame([("src/a.js", "app.get('/x', h)\nbus.emit('go'); bus.on(\"went\")\n// NOTE: why\ncreate table t (id int, name varchar(3), primary key (id));")], "path string, text string")
    assert [r["target_qualified"] for r in T.event_edges(f).orderBy("rel_type").collect()] == ["event::go", "event::went"]
    assert [tuple(r)[1:] for r in T.routes(f).collect()] == [("GET", "/x")]
    assert [r["name"] for r in T.ddl_elements(f).orderBy("name").collect()] == ["id", "name", "t"]
    assert T.rationale(f).first()["note"] == "why"
    assert T.physical_structure(f).count() == 1


def test_entropy_intent_and_empty_tables(spark, graph):
    one = spark.createDataFrame([("aabb", "what is the impact of this change")], "a string, b string")
    assert one.select(T.shannon_entropy(F.col("a"))).first()[0] == 1.0
    assert one.select(K.classify_intent(F.col("b")).alias("x")).first()["x"]["intent"] == "impact"
    E, R = graph[0].limit(0), graph[1].limit(0)
    assert A.god_nodes(E, R).count() == 0 and G.impact_radius(E, R, "x", 2).count() == 0 and J.dead_code(E, R, 1).count() == 0


def test_files_are_walked(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    g()\n")
    (tmp_path / "node_modules/b.py").write_text("x")
    got = files.walk(spark, str(tmp_path), ["py"])
    assert [r["path"] for r in got.collect()] == ["src/a.py"]
    assert T.functions_and_calls(got)[0].first()["name"] == "f"
    assert files.parse_uri("gs://b/x")[0] == "gcs"


SF = "/root/testdata/sf0.001"


def test_communities_and_processes_are_registered_whole(monkeypatch, graph):
    seen = {}
    monkeypatch.setattr(catalog, "elements", lambda spark, d: graph[0])
    monkeypatch.setattr(catalog, "edges", lambda spark, d: graph[1])
    monkeypatch.setattr(G, "communities", lambda R, *more: seen.update(g9=(R, more)) or R.select(F.lit("x").alias("community")))
    monkeypatch.setattr(G, "processes", lambda R, E, *more: seen.update(g10=(R, more)))
    for name in ("g9_communities", "g10_processes"):
        catalog.QUERIES[name](None, "")
    assert seen == {"g9": (graph[1], ()), "g10": (graph[1], ())}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_whole_tables_are_exported(spark):
    tables = {"elements": views.elements(spark, SF), "edges": views.edges(spark, SF)}
    n, m = tables["elements"].count(), tables["edges"].count()
    assert catalog.QUERIES["c5_json"](spark, SF).count() == catalog.QUERIES["c5_cypher"](spark, SF).count() == n + m
    for name in ("c5_cypher", "c5_graphml", "c5_obsidian", "i2_text_blob", "a26_upsert", "f8_service_graph"):
        sql = catalog.ORACLES[name].removeprefix(views.CTE).replace("sha256(blob)", "sha2(blob, 256)").replace("{", "{{").replace("}", "}}")
        want = spark.sql(sql.replace("FROM elements", "FROM {elements}").replace("FROM edges", "FROM {edges}"), **tables)
        got = catalog.QUERIES[name](spark, SF)
        assert want.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name
    assert sum(r["page"].count("\n- `") for r in catalog.QUERIES["c5_wiki"](spark, SF).collect()) == n


def test_surprising_edges_touch_a_god_at_either_end(graph, spark):
    e, r = graph
    gods = lambda *names: spark.createDataFrame([(n and f"f.rs::{n}",) for n in names], "qualified_name string")
    for given in (("b", "b", None), ("c",), ("b", "c")):
        assert [(x["source_qualified"], x["target_qualified"]) for x in J.surprising_edges(e, r, gods(*given)).collect()] == [("f.rs::b", "f.rs::c")]
    assert J.surprising_edges(e, r, gods("a", "d")).isEmpty() and J.surprising_edges(e, r, gods()).isEmpty()
    assert "NestedLoop" not in J.surprising_edges(e, r, gods("b"))._jdf.queryExecution().toString()
