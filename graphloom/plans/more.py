"""Further registered queries: writing statements, extractors over generated sources, satellite tables.

Where an operator reads texts or tables that the star schema lacks, the query
makes them from its rows, so that the oracle can state the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compress as C
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as K
from ..operators import scans as S
from ..operators import tables as W
from ..operators import traversal as G
from ..operators import vectors as V
from .catalog import _BRIEF, _REDGE, _add, _brief, _datalog, _e, _raw, _redge
from .datalog import Database
from .views import load


def _of(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _raw(name, lambda spark, d: make(load(spark, d, table)), sql)


# The query language: text functions, writing
_datalog("a13_substring", '?[q] := *code_elements[q, "struct", n], str_includes(n, "ring")', "SELECT qualified_name AS q FROM elements WHERE element_type = 'struct' AND contains(name, 'ring')")
_datalog("a15_case", '?[q, n] := *code_elements[q, t, n], lowercase(n) = "nation_3"', "SELECT qualified_name AS q, name AS n FROM elements WHERE lower(name) = 'nation_3'")
_datalog("a15_upper", '?[q] := *code_elements[q, "struct", n], uppercase(n) = "SMALL RING"', "SELECT qualified_name AS q FROM elements WHERE element_type = 'struct' AND upper(name) = 'SMALL RING'")
_datalog("a16_json_text", '?[q] := *code_elements{qualified_name: q, metadata: m}, str_includes(m, ":77}")', "SELECT qualified_name AS q FROM elements WHERE contains(metadata, ':77}')")
_datalog("a23_anti", '?[q] := *code_elements[q, t], t in ["class", "directory"], not *relationships{target_qualified: q, rel_type: "calls"}', "SELECT qualified_name AS q FROM elements WHERE element_type IN ('class', 'directory') AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE rel_type = 'calls')")
_datalog("a22_unordered_limit", '?[q] := *code_elements[q, "class"] :limit 9', "SELECT qualified_name AS q FROM elements WHERE element_type = 'class' ORDER BY q LIMIT 9")


def _write(name: str, script: str, sql: str, params: dict | None = None) -> None:
    """A script over notes (a bag) and knowledge_entries (keyed by id), both with a row for each nation."""

    def make(spark: SparkSession, d: str) -> DataFrame:
        notes = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
        return Database({"notes": notes, "knowledge_entries": notes}).run(script, params)

    _raw(name, make, sql)


_N = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation"
_write("a25_insert", '?[id, title] <- [[3, "again"], [100, "new"]] :put notes {id, title}', f"{_N} UNION ALL VALUES (3, 'again'), (100, 'new')")
_write("a26_put", '?[id, title] <- [[3, "first"], [3, "changed"], [100, "new"]] :put knowledge_entries {id => title}', f"{_N} WHERE n_nationkey <> 3 UNION ALL VALUES (3, 'changed'), (100, 'new')")
_write("a27_batch_put", "?[id, title] <- $rows :put knowledge_entries {id => title}", f"{_N} WHERE n_nationkey >= 20 UNION ALL SELECT range, 'row ' || range FROM range(20)", {"rows": [{"id": k, "title": f"row {k}"} for k in range(20)]})
_write("a28_inferred", '?[id, title] <- [[7, "seven"]] :put {id => title}', f"{_N} WHERE n_nationkey <> 7 UNION ALL VALUES (7, 'seven')")
_write("a29_delete_keys", "?[id] <- [[1], [2], [2], [999]] :rm notes {id}", f"{_N} WHERE n_nationkey NOT IN (1, 2)")
_write("a30_delete_by_rule", '?[id] := *notes[id, t], regex_matches(t, "_1") :rm notes {id}', f"{_N} WHERE NOT contains(n_name, '_1')")
_write("a31_delete_where", ":delete notes where id > 10 and id != 12", f"{_N} WHERE NOT (n_nationkey > 10 AND n_nationkey <> 12)")
_raw(
    "a24_nearest",
    lambda s, d: Database({"embeddings": load(s, d, "embeddings")}).run("?[vec_id, distance] := ~embeddings:idx{vec_id | query: $q, k: 20, bind_distance: distance}", {"q": list(load(s, d, "embeddings").where("vec_id = 0").first()["embedding"])}).withColumn("distance", F.round("distance", 5)),
    "SELECT e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY distance, e.vec_id LIMIT 20",
)

# Scans and writing
_e("b20_all_elements", lambda E: E.select(_BRIEF), f"SELECT {_brief} FROM elements")
_add("b20_all_edges", lambda E, R: R.select(_REDGE), f"SELECT {_redge} FROM edges")
_of("c1_bulk_insert", "nation", lambda n: W.append(n, n.where("n_regionkey = 1")), "SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
_of("c2_update", "orders", lambda o: W.upsert(o.select("o_orderkey", "o_orderstatus"), o.where("o_totalprice > 300000").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"]), "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
_of("c4_import_latest", "orders", lambda o: W.upsert(o.select("o_custkey", "o_orderkey").where("o_custkey < 0"), o.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
_e("n11_remove_file", lambda E: W.delete_where(E, F.col("file_path") == "nation/3/customer.py").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE file_path <> 'nation/3/customer.py'")
_e("c5_ctags", W.ctags, "SELECT name || chr(9) || file_path || chr(9) || line_start || ';\"' || chr(9) || substr(element_type, 1, 1) AS value FROM elements WHERE line_start > 0")
_of("c7_groups", "orders", lambda o: W.compress_response(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])[1], "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
_of("c7_first_rows", "orders", lambda o: W.compress_response(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])[0], "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY 1 LIMIT 20")
_of("c7_toon", "nation", lambda n: W.toon(n.select("n_nationkey", "n_name"), "nation"), "SELECT 'nation{n_nationkey,n_name}:' AS value UNION ALL SELECT n_nationkey || ',' || n_name FROM nation")

# Extractors, over sources made from the parts
_P = "'p/' || p_partkey || '.js'"


def _source(name: str, text: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """files (path, text): one for each part; {k} in ``text`` is its key, {m} its key modulo 7."""

    def files(part: DataFrame) -> DataFrame:
        k = F.col("p_partkey").cast("string")
        m = (F.col("p_partkey") % 7).cast("string")
        return part.select(F.concat(F.lit("p/"), k, F.lit(".js")).alias("path"), F.replace(F.replace(F.lit(text), F.lit("{k}"), k), F.lit("{m}"), m).alias("text"))

    _of(name, "part", lambda part: make(files(part)), sql)


_source("b4_functions", "export async function load{k}(x) {\n}\nlet y = 1;\nfn other{m}() {}", lambda f: T.functions_and_calls(f)[0], f"SELECT {_P} || '::' || n AS qualified_name, 'function' AS element_type, n AS name, {_P} AS file_path FROM (SELECT p_partkey, unnest(['load' || p_partkey, 'other' || (p_partkey % 7)]) AS n FROM part)")
_source("b10_calls", "let a = helper{m}(1);\nif (a) { b.skipped(2); again{k}(3) }", lambda f: T.functions_and_calls(f)[1], f"SELECT {_P} AS source_qualified, '__unresolved__' || n AS target_qualified, 'calls' AS rel_type FROM (SELECT p_partkey, unnest(['helper' || (p_partkey % 7), 'again' || p_partkey]) AS n FROM part)")
_source("b6_ddl", "create table t{k} (id int, price decimal(10, 2), primary key (id));", T.ddl_elements, f"SELECT {_P} || '::t' || p_partkey || CASE WHEN c = '' THEN '' ELSE '::' || c END AS qualified_name, CASE WHEN c = '' THEN 'table' ELSE 'column' END AS element_type, CASE WHEN c = '' THEN 't' || p_partkey ELSE c END AS name, {_P} || CASE WHEN c = '' THEN '' ELSE '::t' || p_partkey END AS parent FROM (SELECT p_partkey, unnest(['', 'id', 'price']) AS c FROM part)")
_source("b7_events", "bus.emit('e{m}', x); el.addEventListener(\"c{k}\", f); bus.emit('e{m}')", lambda f: T.event_edges(f).select("source_qualified", "target_qualified", "rel_type"), f"SELECT {_P} AS source_qualified, 'event::' || CASE r WHEN 'emits' THEN 'e' || (p_partkey % 7) ELSE 'c' || p_partkey END AS target_qualified, r AS rel_type FROM (SELECT p_partkey, unnest(['emits', 'listens_on']) AS r FROM part)")
_source("b8_routes", "app.get('/r/{k}', f)\nrouter.delete(\"/d\", g)", T.routes, f"SELECT {_P} AS path, m AS method, CASE m WHEN 'GET' THEN '/r/' || p_partkey ELSE '/d' END AS route FROM (SELECT p_partkey, unnest(['GET', 'DELETE']) AS m FROM part)")
_source("b9_services", "addr = 'dns:///svc-{m}:80'", T.service_edges, f"SELECT {_P} AS source_qualified, 'svc-' || (p_partkey % 7) AS target_qualified, 'service_calls' AS rel_type, 'grpc' AS protocol FROM part")
_source("b12_rationale", "x = 1 # WHY: since {k}\n// plain\n-- HACK again", T.rationale, f"SELECT {_P} AS path, m AS marker, CASE m WHEN 'WHY' THEN 'since ' || p_partkey ELSE 'again' END AS note FROM (SELECT p_partkey, unnest(['WHY', 'HACK']) AS m FROM part)")
_source("b13_sections", "intro\n# Part {k}\nline\nline\n## Use\nend", lambda f: T.markdown_sections(f).select("path", "level", "heading", "line_start", "line_end"), f"SELECT {_P} AS path, l AS level, CASE l WHEN 1 THEN 'Part ' || p_partkey ELSE 'Use' END AS heading, CASE l WHEN 1 THEN 1 ELSE 4 END AS line_start, CASE l WHEN 1 THEN 3 ELSE 5 END AS line_end FROM (SELECT p_partkey, unnest([1, 2]) AS l FROM part)")
_source("b13_code_refs", "see `src/a{k}.rs` and `lib/b.go`, not `word`", T.code_references, f"SELECT {_P} AS path, c AS code_path FROM (SELECT p_partkey, unnest(['src/a' || p_partkey || '.rs', 'lib/b.go']) AS c FROM part)")
_source("b14_requirements", "FR-{k} shall, US-AB-{m} may; FR-{k}", T.requirements, f"SELECT {_P} AS path, CASE k WHEN 'user_story' THEN 'US-AB-' || (p_partkey % 7) ELSE 'FR-' || p_partkey END AS id, k AS kind FROM (SELECT p_partkey, unnest(['user_story', 'requirement']) AS k FROM part)")
_source("b16_mined", "We decided to keep src/m{k}.rs small", lambda f: T.mine_conversations(f.select(F.col("path").alias("conv_id"), F.lit(1).alias("turn"), "text")).select("conv_id", "kind", F.array_join("code_targets", ",").alias("targets")), f"SELECT {_P} AS conv_id, 'decision' AS kind, 'src/m' || p_partkey || '.rs' AS targets FROM part")
_source("j_slug", "The {k}. Part -- (of {m})", lambda f: f.select("path", T.slug(F.col("text")).alias("slug"), T.sanitize_id(F.col("text")).alias("id")), f"SELECT {_P} AS path, 'the-' || p_partkey || '-part-of-' || (p_partkey % 7) AS slug, 'The_' || p_partkey || '__Part_____of_' || (p_partkey % 7) || '_' AS id FROM part")
_source("j_attention", "{k}\n2\n3\n4\n{m}", lambda f: f.select("path", F.array_join(T.reorder_by_attention(F.split("text", "\n")), "|").alias("lines")), f"SELECT {_P} AS path, p_partkey || '|3|' || (p_partkey % 7) || '|4|2' AS lines FROM part")
_source("j_entropy_lines", "aaaaaaaa\nthe quick brown {k}\n# a\n", lambda f: T.drop_low_entropy_lines(f.select("path", "text")).select("path", "text"), f"SELECT {_P} AS path, 'the quick brown ' || p_partkey || chr(10) || '# a' AS text FROM part")
_source("j_diff_files", "diff --git a/f{k} b/f{k}\n--- a/f{k}\n+++ b/f{k}\n@@ -1 +1,2 @@\n+a\n+{m}\n-c\ndiff --git a/g b/g\nnew file mode 100644\n--- /dev/null\n+++ b/g\n@@ -0,0 +1 @@\n+x", lambda f: C.diff_files(f.withColumnRenamed("path", "id")), f"SELECT {_P} AS id, CASE n WHEN 1 THEN 'g' ELSE 'f' || p_partkey END AS path, CASE n WHEN 1 THEN 1 ELSE 2 END AS added, CASE n WHEN 1 THEN 0 ELSE 1 END AS removed FROM (SELECT p_partkey, unnest([1, 2]) AS n FROM part)")
_source("j_diff_totals", " src/f{k} | 5 +++--\n g | 1 +\n 2 files changed", lambda f: C.diff_totals(f.withColumnRenamed("path", "id")), f"SELECT {_P} AS id, 2 AS files, 4 AS added, 2 AS removed, 'src/f' || p_partkey || ' +3 -2; g +1 -0' AS named FROM part")
_source("j_test_totals", "test a{k} ... ok\ntest b ... FAILED\ntest c{m} ... ignored\ntest b ... FAILED\ntest result: FAILED", lambda f: C.test_totals(f.withColumnRenamed("path", "id")), f"SELECT {_P} AS id, 1 AS passed, 1 AS failed, 1 AS ignored, 'b' AS named FROM part")
_of("n2_read_mode", "part", lambda p: p.select("p_partkey", T.read_mode(F.element_at(F.array(*map(F.lit, ["a.rs", "b.md", "c.what"])), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey")).alias("mode")), "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'full' WHEN p_partkey > 500 THEN 'map' WHEN p_partkey > 200 THEN 'signatures' ELSE 'map' END AS mode FROM part")

# Search that finds something
_e("d6_search_any_text", lambda E: S.search_any_text(E, "ring").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring') OR contains(lower(file_path), 'ring') ORDER BY qualified_name LIMIT 200")
_e("d10_resolve_to_qualified", lambda E: K.resolve_to_qualified(E, "ASIA"), "SELECT qualified_name, 1 AS level FROM elements WHERE name = 'ASIA' ORDER BY qualified_name LIMIT 1")
_CONCEPT = "SELECT n_nationkey AS gid, n_name AS name, r_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey"


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").alias("gid"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("aliases"), F.col("r_name").alias("description"))


def _scored(q: str) -> str:
    return f"CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN 'n' || gid = '{q}' THEN 0.9 WHEN contains(lower(name), '{q}') THEN 0.8 WHEN contains('n' || gid, '{q}') THEN 0.7 WHEN contains(lower(description), '{q}') THEN 0.5 ELSE 0.0 END"


_raw("d11_ontology_score", lambda s, d: _concepts(s, d).select("gid", K.ontology_score(F.col("name"), F.col("aliases"), F.col("description"), "n1").alias("score")), f"SELECT gid, CAST({_scored('n1')} AS DOUBLE) AS score FROM ({_CONCEPT})")
_raw("d12_ontology_search", lambda s, d: K.ontology_search(_concepts(s, d), "asia", 100).select("gid", "name", "score"), f"SELECT gid, name, CAST({_scored('asia')} AS DOUBLE) AS score FROM ({_CONCEPT}) WHERE {_scored('asia')} > 0")
_of("d17_intent", "events", lambda e: e.select("event_type").distinct().select("event_type", K.classify_intent(F.concat_ws(" ", F.when(F.col("event_type") == "error", "what is affected by").otherwise("overview of"), "event_type")).alias("x")).select("event_type", "x.intent", "x.score"), "SELECT DISTINCT event_type, CASE event_type WHEN 'error' THEN 'impact' ELSE 'context' END AS intent, CASE event_type WHEN 'error' THEN 0.2 ELSE 0.25 END AS score FROM events")

# Joins
_CALLS = "'function/' || o_orderkey AS source_qualified, '__unresolved__order_' || (o_orderkey + o_orderkey % 3) AS target_qualified"


def _unresolved(o: DataFrame) -> DataFrame:
    hint = F.concat(F.lit('{"callee_file_hint":"customer/'), F.col("o_custkey").cast("string"), F.lit('.go"}'))
    return o.select(*(F.expr(x) for x in _CALLS.split(", ", 1)), F.lit("calls").alias("rel_type"), F.lit(0.5).alias("confidence"), hint.alias("metadata"), F.lit("local").alias("env"))


def _with_orders(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    from .catalog import CTE
    from .views import elements

    _raw(name, lambda spark, d: make(elements(spark, d), load(spark, d, "orders")), CTE + sql)


_with_orders("e1_resolve_calls", lambda E, o: J.resolve_calls(E, _unresolved(o)).select("source_qualified", "target_qualified", "resolution_method"), """SELECT 'function/' || o.o_orderkey AS source_qualified,
    coalesce(f.qualified_name, '__unresolved__order_' || (o.o_orderkey + o.o_orderkey % 3)) AS target_qualified,
    CASE WHEN f.file_path = 'customer/' || o.o_custkey || '.go' THEN 'name_file_hint' WHEN f.name IS NOT NULL THEN 'name' ELSE 'unresolved' END AS resolution_method
    FROM orders o LEFT JOIN elements f ON f.element_type = 'function' AND f.name = 'order_' || (o.o_orderkey + o.o_orderkey % 3)""")
_add("e2_typed", lambda E, R: J.upgrade_typed(R.where("rel_type = 'calls'").select("source_qualified", "target_qualified", "confidence"), R.where("rel_type = 'calls' and target_qualified like '%7'")), "SELECT source_qualified, target_qualified, CASE WHEN target_qualified LIKE '%7' THEN 1.0 ELSE confidence END AS confidence, CASE WHEN target_qualified LIKE '%7' THEN 'typed' END AS resolution_method FROM edges WHERE rel_type = 'calls'")
_of("e14_traceability", "orders", lambda o: J.traceability(o.select(F.col("o_custkey").alias("element_qualified"), F.lit("US-1").alias("user_story_id"), F.lit("FR-1").alias("feature_id")).distinct(), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("element_qualified"), F.col("o_orderpriority").alias("doc"))).withColumn("docs", F.array_join("docs", ",")), "SELECT o_custkey AS element_qualified, 'US-1' AS user_story_id, 'FR-1' AS feature_id, coalesce(string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, ',' ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), '') AS docs FROM orders GROUP BY 1")
_raw("e15_matrix", lambda s, d: J.traceability_matrix(load(s, d, "nation").select(F.col("n_nationkey").alias("feature_id")), load(s, d, "customer").select(F.col("c_nationkey").alias("feature_id")), load(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("feature_id")), load(s, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("feature_id"))), "SELECT n_nationkey AS feature_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS workflows, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS annotated, CASE n_regionkey WHEN 0 THEN 1 ELSE 0 END AS docs FROM nation")
_raw("e16_feature_flow", lambda s, d: J.feature_flow(load(s, d, "region").select(F.col("r_regionkey").alias("feature_id")), load(s, d, "nation").select(F.col("n_regionkey").alias("feature_id"), F.col("n_nationkey").alias("workflow_id")), load(s, d, "supplier").select(F.col("s_nationkey").alias("workflow_id"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("step"))).withColumn("steps", F.array_join("steps", ",")), "SELECT n_regionkey AS feature_id, n_nationkey AS workflow_id, (SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS steps FROM nation")
_add("e17_tests", lambda E, R: J.tests_of(R.withColumn("rel_type", F.when(F.col("rel_type") == "imports", "tested_by").otherwise(F.col("rel_type"))), "function/1").select("source_qualified", "target_qualified"), "SELECT source_qualified, target_qualified FROM edges WHERE source_qualified = 'function/1' AND rel_type = 'imports'")
_add("e18_nav", lambda E, R: J.nav_graph(E, R.withColumn("rel_type", F.when(F.col("rel_type") == "calls", "navigates_to").otherwise(F.col("rel_type")))).select("source_qualified", "target_qualified", "file_path"), "SELECT source_qualified, target_qualified, file_path FROM edges JOIN elements ON qualified_name = source_qualified WHERE rel_type = 'calls'")
_e("e18_routes", lambda E: J.find_route(E.withColumn("element_type", F.when(F.col("element_type") == "service", "route").otherwise(F.col("element_type"))), "00007").select("qualified_name"), "SELECT qualified_name FROM elements WHERE element_type = 'service' AND (contains(name, '00007') OR contains(metadata, '00007'))")
_e("e18_screen_args", lambda E: J.screen_args(E.withColumn("element_type", F.when(F.col("element_type") == "class", "nav_argument").otherwise(F.col("element_type"))), "NATION_1").select("qualified_name"), "SELECT qualified_name FROM elements WHERE element_type = 'class' AND parent_qualified IN (SELECT qualified_name FROM elements WHERE contains(name, 'NATION_1'))")

# Aggregates, traversal, windows
_raw("f4_inventory", lambda s, d: _inventory(s, d), "SELECT count(*) AS n_elements, 6 AS n_types, (SELECT count(*) FROM orders) AS functions, (SELECT count(*) * 64 * 4 FROM embeddings) AS vector_bytes, (SELECT count(*) * 64 * 12 FROM embeddings) AS index_bytes FROM (SELECT 1 FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM part UNION ALL SELECT 1 FROM orders)")


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    from .views import elements

    found = A.inventory(elements(spark, d), load(spark, d, "embeddings"), 64)
    return found.select("n_elements", F.size("by_type").alias("n_types"), F.col("by_type")["function"].alias("functions"), "vector_bytes", "index_bytes")


_e("f16_states", lambda E: A.histogram(E, "env"), "SELECT env, count(*) AS n FROM elements GROUP BY 1")
_add("f18_overview", lambda E, R: A.overview(E, R).select(F.array_join("languages", ",").alias("languages"), F.array_join("files", ",").alias("files")), "SELECT (SELECT string_agg(language, ',' ORDER BY n DESC, language) FROM (SELECT language, count(*) AS n FROM elements GROUP BY 1 ORDER BY n DESC, language LIMIT 5)) AS languages, (SELECT string_agg(file_path, ',' ORDER BY n DESC, file_path) FROM (SELECT file_path, count(*) AS n FROM elements GROUP BY 1 ORDER BY n DESC, file_path LIMIT 5)) AS files")
_add("g14_dependents", lambda E, R: G.incremental_dependents(R, R.where("rel_type = 'contains' and target_qualified like 'class/%7'").select(F.col("target_qualified").alias("file_path"))), "SELECT DISTINCT source_qualified FROM edges WHERE target_qualified IN (SELECT target_qualified FROM edges WHERE rel_type = 'contains' AND target_qualified LIKE 'class/%7')")
_of("h1_best_per_key", "orders", lambda o: K.best_per_key(o.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.desc("o_totalprice"), "o_orderkey"), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_of("h6_first_wins", "lineitem", lambda x: K.best_per_key(x.select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey", "l_linenumber"), "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
_e("n9_assign_clusters", lambda E: A.assign_clusters(E, E.where("element_type = 'class'").select("qualified_name", F.lit("k").alias("cluster_id"))).select("qualified_name", "cluster_id"), "SELECT qualified_name, CASE WHEN element_type = 'class' THEN 'k' ELSE cluster_id END AS cluster_id FROM elements")
_of("n4_eviction", "lineitem", lambda x: x.select("l_orderkey", "l_linenumber", F.round(A.eviction_score(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_extendedprice")), 9).alias("score")), "SELECT l_orderkey, l_linenumber, round(0.4 / (1 + sqrt(l_quantity)) + 0.3 * ln(l_linenumber + 1.0) + 0.3 * ln(l_extendedprice + 1.0), 9) AS score FROM lineitem")
_of("i7_composite", "embeddings", lambda v: V.composite_score(v, [1.0] * 4 + [0.0] * 60).select("vec_id", "score"), "SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + embedding[2] + embedding[3] + embedding[4]) / sqrt(4.0 * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings")
_of("i9_recall", "embeddings", lambda v: V.recall(v.where("label % 2 = 0").select(F.col("label").alias("query_id"), "vec_id"), v.select(F.col("label").alias("query_id"), "vec_id"), 10).withColumn("recall", F.round("recall", 9)), "SELECT round(avg(CASE WHEN label % 2 = 0 THEN n / 10.0 ELSE 0 END), 9) AS recall FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")

# Satellite tables
_of("m2_promote", "orders", lambda o: W.promote(o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "upcoming").otherwise("local").alias("env"), F.col("o_orderpriority").alias("branch")), "1-URGENT", "staging"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'staging' WHEN o_orderstatus = 'O' THEN 'upcoming' ELSE 'local' END AS env, o_orderpriority AS branch FROM orders")


def _incidents(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.when(k % 11 == 0, " ").otherwise(k.cast("string")).alias("id"), F.when(k % 13 == 0, F.repeat(F.lit("t"), F.lit(201))).otherwise("t").alias("title"), F.when(k % 17 == 0, None).otherwise("staging").alias("env"),
        F.when(k % 19 == 0, "P9").otherwise("P1").alias("severity"), k.alias("occurred_at"), F.when(k % 5 == 0, k - 1).otherwise(k + 1).alias("resolved_at"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("affected_services"), F.when(k % 3 == 0, "").otherwise("a").alias("author"),
    ).select("o_orderkey", W.incident_problem().alias("problem"))


_of("m4_incident_rules", "orders", _incidents, "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'id' WHEN o_orderkey % 13 = 0 THEN 'title_length' WHEN o_orderkey % 17 = 0 THEN 'env' WHEN o_orderkey % 19 = 0 THEN 'severity' WHEN o_orderkey <= 0 THEN 'occurred_at' WHEN o_orderkey % 5 = 0 THEN 'resolved_at' WHEN o_orderkey % 7 = 0 THEN 'affected_services' WHEN o_orderkey % 3 = 0 THEN 'author' END AS problem FROM orders")
_of("m6_may_read", "customer", lambda c: c.withColumn("members", F.array(F.struct(F.col("c_mktsegment").alias("user"), F.lit("owner").alias("role")))).where(W.may_read("BUILDING")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_of("m7_record_metric", "events", lambda e: W.append(e.select("event_id", "value"), e.where("event_type = 'error'").select("event_id", (F.col("value") * 2).alias("value"))), "SELECT event_id, value FROM events UNION ALL SELECT event_id, value * 2 FROM events WHERE event_type = 'error'")
_of("m9_recall", "customer", lambda c: W.recall_lessons(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.col("c_name").alias("text")), 500).select("id", "used"), "SELECT id, used FROM (SELECT c_custkey AS id, sum(length(c_name)) OVER (ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS used FROM customer) WHERE used <= 500")
_of("n3_diary", "events", lambda e: W.diary(e.select(F.col("event_id").alias("at"), F.col("props").alias("text"), F.array("event_type").alias("tags")), "error").select("at", "text"), "SELECT event_id AS at, props AS text FROM events WHERE event_type = 'error'")
