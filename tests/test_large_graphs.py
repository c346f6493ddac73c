"""What travels when graphs are too large to broadcast, and results beside brute force."""

import random
import re
from collections import Counter

import pytest
from graphloom.operators import joins, pack, reports, tables, vectors
from graphloom.operators import traversal as G

EDGES = "source_qualified string, target_qualified string, rel_type string, confidence double, metadata string, env string"


@pytest.fixture
def travelled(spark):
    """A function: the rows that a call shuffles and the rows that it writes, with no side small enough for Spark to broadcast by itself."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())

    def totals():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = stages()
        rows = [found.apply(k) for k in range(found.size())]
        return sum(r.shuffleWriteRecords() for r in rows), sum(r.outputRecords() for r in rows)

    def measure(call):
        before = totals()
        result = call()
        return result, tuple(b - a for a, b in zip(before, totals(), strict=True))

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield measure
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def graph_of(spark, pairs):
    return spark.createDataFrame([(a, b, kind, c, "{}", "local") for a, b, kind, c in pairs], EDGES)


def test_impact_radius_cuts_nothing(spark):
    edges = spark.range(12_000).selectExpr("'hub' AS source_qualified", "concat('n', id) AS target_qualified", "'calls' AS rel_type", "1.0D AS confidence")
    elements = edges.selectExpr("target_qualified AS qualified_name")
    assert G.impact_radius(elements, edges, "hub", 2).count() == 12_000
    assert G.impact_radius(elements, edges, "hub", 2, cap=5).count() == 5


def brute_path(pairs, start, goal, most):
    """hops, cost and nodes of the best shortest path, by all of them."""
    near = {}
    for a, b, _, c in pairs:
        rank = 0 if c >= 0.9 else 1 if c >= 0.6 else 2
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = min(rank, near.get(x, {}).get(y, 9))
    ways = {start: (0, [start])}
    seen = {start}
    for hop in range(most + 1):
        if goal in ways:
            return hop, *ways[goal]
        step = {}
        for x, (cost, path) in ways.items():
            for y, rank in near.get(x, {}).items():
                if y not in seen:
                    step[y] = min(step.get(y, (999, [])), (cost + rank, [*path, y]))
        ways = step
        seen |= set(ways)
    return None


def test_shortest_path_from_both_ends(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}", "calls", rng.choice([0.3, 0.7, 1.0])) for _ in range(33)]
    R = graph_of(spark, pairs).cache()
    found = set()
    for start, goal, most in (("n00", "n19", 10), ("n03", "n11", 10), ("n05", "n05", 10), ("n07", "n29", 10), ("n02", "n14", 2), ("n01", "gone", 10)):
        want, got = brute_path(pairs, start, goal, most), G.shortest_path(R, start, goal, most).collect()
        assert [(r["hops"], r["cost"], r["path"]) for r in got] == ([want] if want else []), (start, goal)
        found.add(want and want[0])
    assert len(found) > 2


def test_searches_between_far_ends_move_no_whole_graph(spark, travelled):
    # two stars of 2,000 arms apart from a path of four steps between two of their arms
    pairs = [(f"{end}", f"{end}{k}", "calls", 1.0) for end in "ab" for k in range(2000)] + [("a7", "m", "calls", 0.7), ("m", "b9", "calls", 0.7)]
    pairs += [(f"x{k}", f"y{k}", "calls", 1.0) for k in range(60_000)]
    R = graph_of(spark, pairs)
    row, (moved, wrote) = travelled(lambda: G.shortest_path(R, "a", "b").first())
    assert (row["path"], row["cost"]) == (["a", "a7", "m", "b9", "b"], 2) and moved < 40_000 and wrote < 40_000
    near, (moved, wrote) = travelled(lambda: G.reach(G.symmetric(R).select("node", "other", "confidence"), spark.createDataFrame([("m",)], "node string"), 3).count())
    assert near == 1 + 2 + 2 + 2 * 1999 and moved < 40_000 and wrote < 40_000


def test_triangles_make_few_wedges(spark, travelled):
    # 200 parts of 30 suppliers each, one nation: a pair of suppliers closes nothing
    pairs = {(f"p{k}", f"s{(7 * k + j) % 90}") for k in range(200) for j in range(30)} | {(f"s{k}", "n") for k in range(90)} | {(f"p{k}", "n") for k in range(200)}
    R = graph_of(spark, [(a, b, "calls", 1.0) for a, b in sorted(pairs)])
    rows, (moved, _) = travelled(lambda: reports.triangles(R).collect())
    links = {frozenset(p) for p in pairs}
    want = sorted(tuple(sorted((a, b, "n"))) for a, b in pairs if b != "n" and {frozenset((a, "n")), frozenset((b, "n"))} <= links)
    assert sorted(map(tuple, rows)) == want and len(want) == 6000
    assert moved < 12 * len(pairs)  # pairs of suppliers alone were 87,000


def test_pack_of_a_folder_moves_its_own_edges(spark, travelled):
    E = spark.range(20_000).selectExpr("concat('n', id) AS qualified_name", "concat('f', id % 100, '/a') AS file_path")
    R = spark.range(20_000).selectExpr("concat('n', id) AS source_qualified", "concat('n', id + 100) AS target_qualified", "'calls' AS rel_type")
    (lines, manifest), (moved, _) = travelled(lambda: (lambda p: (p[0].collect(), p[1].first()))(pack.context_pack(E, R, "f3", None)))
    assert (manifest["elements"], manifest["relationships"], len(lines)) == (200, 199, 399) and moved < 2000


def test_only_unknown_names_meet_the_edges_again(spark, travelled):
    E = spark.range(1000).selectExpr("concat('n', id) AS qualified_name")
    of = lambda s, t, meta="{}": spark.range(30_000).selectExpr(f"{s} AS source_qualified", f"{t} AS target_qualified", "'calls' AS rel_type", f"'{meta}' AS metadata")
    known, odd = of("concat('n', id % 1000)", "concat('n', id % 77)"), spark.createDataFrame([("n1", "x", "{}"), ("y", "n2", "{}"), ("y", "x", "{}"), ("n1", None, "{}"), (None, "n1", "{}"), ("n1", "x", '{"valid_to":5}'), ("n1", "n2", '{"valid_to":50}')], "source_qualified string, target_qualified string, metadata string").selectExpr("source_qualified", "target_qualified", "'calls' AS rel_type", "metadata")
    rows, (moved, _) = travelled(lambda: joins.consistency(E, known.unionByName(odd), 10).collect())
    found = Counter((r["source_qualified"], r["target_qualified"], r["issue"]) for r in rows)
    assert found == Counter([("n1", "x", "TARGET_MISSING"), ("y", "x", "TARGET_MISSING"), ("n1", None, "TARGET_MISSING"), ("y", "n2", "SOURCE_MISSING"), (None, "n1", "SOURCE_MISSING"), ("n1", "x", "STALE")])
    assert moved < 90_000


def test_states_and_notes(spark):
    blobs = spark.createDataFrame([(f"f{k}", f"h{k}", f"text {k}") for k in range(6)], "qualified_name string, content_hash string, blob string")
    state = spark.createDataFrame([("f0", "h0", "fresh"), ("f1", "h1", "stale"), ("f2", "old", "fresh")], "qualified_name string, content_hash string, state string")
    done = vectors.refresh(blobs, state)
    assert sorted(r["qualified_name"] for r in done.collect()) == ["f1", "f2", "f3", "f4", "f5"]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and done._jdf.queryExecution().optimizedPlan().toString().count(" Join ") == 1
    E = spark.createDataFrame([("a/b.c", "n", "t", "f")], "qualified_name string, name string, element_type string, file_path string")
    R = spark.createDataFrame([("a/b", "c d/é", "calls"), ("a.b", "c/d_é", "calls"), ("a/b", None, "x"), ("a/b", None, "y")], "source_qualified string, target_qualified string, rel_type string")
    notes, plan = tables.obsidian(E, R), tables.obsidian(E, R)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, notes.collect()), key=str) == sorted([("a_b_c", 0, "# n"), ("a_b_c", 1, "type: t, file: f"), ("a_b", 2, "- calls [[c_d__]]"), ("a_b", 2, None)], key=str)
    assert re.search(r"Aggregate \[note#\d+, x#\d+\]", plan)  # lines are written out after repeats are gone


def moves_by_hand(pairs, odd, sweeps):
    """The communities of a graph by the same local moves, a node at a time."""
    near = {}
    for a, b, kind, _ in pairs:
        for x, y in ((a, b), (b, a)):
            if x != y:
                near.setdefault(x, Counter())[y] += 2 if kind == "calls" else 1
    k = {x: sum(c.values()) for x, c in near.items()}
    twice, label = sum(k.values()), {x: x for x in near}
    for sweep in range(sweeps):
        total, new = Counter(), dict(label)
        for x, c in label.items():
            total[c] += k[x]
        for x in near:
            into = Counter()
            for y, w in near[x].items():
                into[label[y]] += w
            gain = {c: round(w - k[x] * (total[c] - (k[x] if c == label[x] else 0)) / twice, 9) for c, w in into.items()}
            best = max((g, c) for c, g in gain.items())
            if odd[x] == sweep % 2 and best[0] > gain.get(label[x], 0.0) + 0.001:
                new[x] = best[1]
        label = new
    return label


def test_communities_move_labels_and_not_links(spark, travelled):
    rng = random.Random(3)
    pairs = [(f"n{a}", f"n{a // 20 * 20 + rng.randrange(20) if rng.random() < 0.6 else rng.randrange(300)}", rng.choice(["calls", "imports"]), 1.0) for a in range(300) for _ in range(20)]
    R = graph_of(spark, pairs).cache()
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(300)], "node string")
    odd = {r["node"]: r["odd"] for r in nodes.selectExpr("node", "pmod(xxhash64(node), 2) AS odd").collect()}
    _, (still, _) = travelled(lambda: G.communities(R, 0).collect())
    rows, (moved, _) = travelled(lambda: G.communities(R, 4).collect())
    assert {r["node"]: r["community"] for r in rows} == moves_by_hand(pairs, odd, 4)
    assert len({r["community"] for r in rows}) < 100 and moved - still < 4 * 9000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("links_")]


def test_a_sweep_takes_the_rows_of_a_node_from_several_batches(spark, monkeypatch):
    """A hub's links are more than are taken together; the moves are decided in workers, without a plan's sorts and joins after the shuffle."""
    pairs = [("hub", f"n{k}", "calls", 1.0) for k in range(120)] + [(f"n{k}", f"n{k // 4 * 4}", "imports", 1.0) for k in range(120)] + [("far", "away", "imports", 1.0)]
    R = graph_of(spark, pairs).cache()
    names = ["hub", "far", "away", *(f"n{k}" for k in range(120))]
    odd = {r["node"]: r["odd"] for r in spark.createDataFrame([(n,) for n in names], "node string").selectExpr("node", "pmod(xxhash64(node), 2) AS odd").collect()}
    monkeypatch.setattr(G, "ROWS_AT_ONCE", 16)
    was, plans, step = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), [], G._step
    monkeypatch.setattr(G, "_step", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or step(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["node"]: r["community"] for r in G.communities(R, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == moves_by_hand(pairs, odd, 5)
    sweeps = plans[-5:]
    assert all(p.count("Join") == 1 and "Aggregate" not in p for p in sweeps)
