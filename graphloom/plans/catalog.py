"""All registered queries of the graph engine, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import questions as Q
from ..operators import ranking as K
from ..operators import scans as S
from ..operators import tables as W
from ..operators import traversal as G
from ..operators import vectors as V
from .datalog import Database
from .views import CTE, edges, elements, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_Q = ["qualified_name"]
AT = 852076800  # 1997-01-01, inside the shipping dates' years
START = "class/7"


def _add(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: make(elements(spark, d), edges(spark, d))
    if sql:
        ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else CTE + sql


def _raw(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def _e(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over elements alone, of a few columns."""
    _add(name, lambda E, R: make(E), sql)


_BRIEF = ["qualified_name", "element_type", "name", "file_path", "line_start", "line_end", "language", "parent_qualified", "env"]
_brief = ", ".join(_BRIEF)
_REDGE = ["source_qualified", "target_qualified", "rel_type", "confidence", "env"]
_redge = ", ".join(_REDGE)
_FROM = "CAST(json_extract_string(metadata, '$.valid_from') AS BIGINT)"
_TO = "CAST(json_extract_string(metadata, '$.valid_to') AS BIGINT)"

# Scans and search
_e("b18_find_element", lambda E: S.find_element(E, "./class/7").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE qualified_name IN ('class/7', './class/7')")
_e("b18_by_names", lambda E: S.among(E, "name", ["GERMANY", "FRANCE", "ASIA"]).select(_BRIEF), f"SELECT {_brief} FROM elements WHERE name IN ('GERMANY', 'FRANCE', 'ASIA')")
_e("b18_by_parent", lambda E: S.children(E, "directory/3", "class", "service").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE parent_qualified = 'directory/3' AND element_type IN ('class', 'service')")
_e("b18_by_file", lambda E: S.elements_by_file(E, "nation/3/customer.py").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE file_path = 'nation/3/customer.py'")
_add("b19_out_edges", lambda E, R: S.out_edges(R, "function/1", "function/2").select(_REDGE), f"SELECT {_redge} FROM edges WHERE source_qualified IN ('function/1', 'function/2')")
_add("b19_in_edges", lambda E, R: S.in_edges(R, "service/3").select(_REDGE), f"SELECT {_redge} FROM edges WHERE target_qualified = 'service/3'")
_add("b19_touching", lambda E, R: S.touching(R, START).select(_REDGE), f"SELECT {_redge} FROM edges WHERE source_qualified = '{START}' OR target_qualified = '{START}'")
_add("b19_by_type", lambda E, R: S.by_rel_type(R, "contains").select(_REDGE), f"SELECT {_redge} FROM edges WHERE rel_type = 'contains'")
_e("b21_page", lambda E: S.page(E.select(_BRIEF), _Q, 50, 100), f"SELECT {_brief} FROM elements ORDER BY qualified_name LIMIT 50 OFFSET 100")
_e("b22_in_env", lambda E: S.in_env(E, "staging").groupBy("element_type").agg(F.count("*").alias("n")), "SELECT element_type, count(*) AS n FROM elements WHERE env = 'staging' GROUP BY 1")
_e("b22_env_presence", lambda E: S.env_presence(E).groupBy("in_local", "in_staging", "in_production").agg(F.count("*").alias("n")),
   "SELECT in_local, in_staging, in_production, count(*) AS n FROM (SELECT qualified_name, max(CAST(env = 'local' AS INT)) AS in_local, max(CAST(env = 'staging' AS INT)) AS in_staging, max(CAST(env = 'production' AS INT)) AS in_production FROM elements GROUP BY 1) GROUP BY 1, 2, 3")
_e("d1_search_by_name", lambda E: S.search_by_name(E, "Customer#00000001").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE contains(lower(name), 'customer#00000001')")
_e("d2_search_by_name_typed", lambda E: S.search_by_name_typed(E, "1", "service", 20).select(_BRIEF), f"SELECT {_brief} FROM elements WHERE contains(lower(name), '1') AND element_type = 'service' ORDER BY qualified_name LIMIT 20")
_e("d3_exact_name", lambda E: S.find_exact_name(E, "ASIA").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE name = 'ASIA' ORDER BY qualified_name LIMIT 20")
_e("d4_search_by_type", lambda E: S.elements_by_type(E, "directory").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE element_type = 'directory'")
_e("d5_search_by_pattern", lambda E: S.search_by_pattern(E, "S/12").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE contains(lower(qualified_name), 's/12')")
_e("d6_search_any_text", lambda E: S.search_any_text(E, "ger").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE contains(lower(name), 'ger') OR contains(lower(qualified_name), 'ger') OR contains(lower(file_path), 'ger') ORDER BY qualified_name LIMIT 200")
_e("d7_under_path", lambda E: S.under_path(E, "nation/3").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE (file_path = 'nation/3' OR starts_with(file_path, 'nation/3/') OR ends_with(file_path, '/nation/3')) AND NOT starts_with(qualified_name, 'ontology://') ORDER BY qualified_name LIMIT 500")
_e("d8_oversized_functions", lambda E: S.oversized_functions(E, 190).select("qualified_name", "lines"), "SELECT qualified_name, line_end - line_start + 1 AS lines FROM elements WHERE element_type = 'function' AND line_end - line_start + 1 >= 190")
_e("d8_oversized_in_language", lambda E: S.oversized_functions(E, 150, "1-URGENT").select("qualified_name", "lines"), "SELECT qualified_name, line_end - line_start + 1 AS lines FROM elements WHERE element_type = 'function' AND language = '1-URGENT' AND line_end - line_start + 1 >= 150")

# Ranking
_rank = "CASE element_type " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(K.TYPE_RANK)) + f" ELSE {len(K.TYPE_RANK) + 1} END"
_e("d9_resolve_alias", lambda E: K.resolve_alias(E, "service").select("qualified_name", "score", "type_rank"),
   f"SELECT qualified_name, score, {_rank} AS type_rank FROM (SELECT *, CASE WHEN qualified_name = 'service' OR name = 'service' THEN 100 WHEN lower(name) = 'service' THEN 90 WHEN file_path = 'service' THEN 80 WHEN split_part(file_path, '/', -1) = 'service' THEN 70 WHEN regexp_replace(split_part(file_path, '/', -1), '\\.[^.]*$', '') = 'service' THEN 60 WHEN starts_with(lower(name), 'service') THEN 50 END AS score FROM elements) WHERE score IS NOT NULL ORDER BY score DESC, {_rank}, qualified_name LIMIT 20")
_e("d10_resolve_to_qualified", lambda E: K.resolve_to_qualified(E, "FRANCE"), f"SELECT qualified_name, level FROM (SELECT *, CASE WHEN qualified_name = 'FRANCE' THEN 0 WHEN name = 'FRANCE' THEN 1 WHEN contains(lower(name), 'france') THEN 2 WHEN ends_with(qualified_name, 'FRANCE') THEN 3 END AS level FROM elements) WHERE level IS NOT NULL ORDER BY level, {_rank}, qualified_name LIMIT 1")
_e("d14_discover", lambda E: K.discover(E, "the customer 7").select("qualified_name", "score"),
   "SELECT qualified_name, score FROM (SELECT qualified_name, CASE WHEN lower(name) = 'the customer 7' THEN 100 ELSE 0 END + CASE WHEN contains(lower(name), 'the customer 7') THEN 40 ELSE 0 END + CASE WHEN contains(lower(name), 'customer') THEN 10 ELSE 0 END + CASE WHEN contains(lower(qualified_name), 'customer') THEN 3 ELSE 0 END AS score FROM elements) WHERE score > 0 ORDER BY score DESC, qualified_name LIMIT 20")
_e("d15_search_code", lambda E: K.search_code(E, "order_12", "function", 10).select("qualified_name", "score"), "SELECT qualified_name, 40 AS score FROM elements WHERE element_type = 'function' AND contains(lower(name), 'order_12') ORDER BY qualified_name LIMIT 10")
_raw("d13_keywords", lambda s, d: load(s, d, "nation").select("n_nationkey", F.array_join(K.keywords(F.concat_ws(" ", F.lit("The nation of"), "n_name")), ",").alias("words")),
     "SELECT n_nationkey, 'nation,' || array_to_string(list_filter(string_split(trim(regexp_replace(lower(n_name), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: length(w) >= 2), ',') AS words FROM nation")
_raw("d16_search_knowledge", lambda s, d: K.search_knowledge(load(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "source"), "moron", 50, source="src1").select("id"),
     "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'moron') AND source = 'src1' ORDER BY id LIMIT 50")
_raw("d17_intent", lambda s, d: load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("n", K.classify_intent(F.concat_ws(" ", F.lit("find"), "event_type")).alias("x")).select("n", "x.intent", "x.score"),
     "SELECT count(*) AS n, 'search' AS intent, 0.2 AS score FROM events GROUP BY event_type")

# Joins
_add("e3_callers", lambda E, R: J.callers(E, R, "class/7").select(_BRIEF), f"SELECT {_brief} FROM elements WHERE qualified_name IN (SELECT source_qualified FROM edges WHERE rel_type = 'calls' AND contains(target_qualified, 'class/7')) ORDER BY qualified_name LIMIT 50")
_add("e4_dependencies", lambda E, R: J.dependencies(R, "function/1"), "SELECT target_qualified, confidence FROM edges WHERE source_qualified IN ('function/1', './function/1') AND rel_type = 'imports'")
_add("e4_dependents", lambda E, R: J.dependents(R, "service/1"), "SELECT source_qualified, rel_type, confidence FROM edges WHERE target_qualified = 'service/1'")
_TUNNELS = "edges r JOIN elements s ON s.qualified_name = r.source_qualified JOIN elements t ON t.qualified_name = r.target_qualified WHERE s.cluster_id <> t.cluster_id"
_add("e5_tunnels", lambda E, R: J.tunnels(E, R).groupBy("source_cluster", "target_cluster").agg(F.count("*").alias("n")), f"SELECT s.cluster_id AS source_cluster, t.cluster_id AS target_cluster, count(*) AS n FROM {_TUNNELS} GROUP BY 1, 2")
_DEG = "SELECT q AS qualified_name, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT source_qualified AS q, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_qualified, 0, 1 FROM edges) GROUP BY q"
_GODS = f"SELECT qualified_name, out_degree, in_degree, degree, name, element_type FROM ({_DEG}) JOIN elements USING (qualified_name) ORDER BY degree DESC, qualified_name LIMIT 20"
_add("e6_surprising_edges", lambda E, R: J.surprising_edges(E, R, A.god_nodes(E, R)).select("source_qualified", "target_qualified", "rel_type", "confidence"),
     f"SELECT source_qualified, target_qualified, rel_type, confidence FROM {_TUNNELS} AND (source_qualified IN (SELECT qualified_name FROM ({_GODS})) OR target_qualified IN (SELECT qualified_name FROM ({_GODS}))) ORDER BY confidence DESC, source_qualified, target_qualified, rel_type LIMIT 10")
_add("e7_focus", lambda E, R: J.induced(E, R, F.col("element_type").isin("module", "directory"))[1].select(_REDGE), f"SELECT {_redge} FROM edges WHERE source_qualified IN (SELECT qualified_name FROM elements WHERE element_type IN ('module', 'directory')) AND target_qualified IN (SELECT qualified_name FROM elements WHERE element_type IN ('module', 'directory'))")
_add("e8_consistency", lambda E, R: J.consistency(E, R, AT).groupBy("issue").agg(F.count("*").alias("n")),
     f"SELECT issue, count(*) AS n FROM (SELECT CASE WHEN {_TO} < {AT} THEN 'STALE' WHEN target_qualified NOT IN (SELECT qualified_name FROM elements) THEN 'TARGET_MISSING' WHEN source_qualified NOT IN (SELECT qualified_name FROM elements) THEN 'SOURCE_MISSING' END AS issue FROM edges) WHERE issue IS NOT NULL GROUP BY 1")
_raw("e9_dead_code", lambda s, d: J.dead_code(elements(s, d), load(s, d, "lineitem").select(F.format_string("function/%d", "l_orderkey").alias("source_qualified"), F.format_string("function/%d", F.col("l_partkey") * 3).alias("target_qualified"), F.lit("calls").alias("rel_type")), 50).select("qualified_name"),
     CTE + "SELECT qualified_name FROM elements WHERE element_type = 'function' AND line_end - line_start >= 99 AND qualified_name NOT IN (SELECT 'function/' || l_orderkey FROM lineitem) AND qualified_name NOT IN (SELECT 'function/' || (l_partkey * 3) FROM lineitem)")
_raw("e10_orphans", lambda s, d: J.orphans(load(s, d, "embeddings").select(F.concat(F.lit("struct/"), F.col("vec_id") * 5).alias("qualified_name")), elements(s, d)), CTE + "SELECT 'struct/' || (vec_id * 5) AS qualified_name FROM embeddings WHERE 'struct/' || (vec_id * 5) NOT IN (SELECT qualified_name FROM elements)")
_raw("e11_stale", lambda s, d: J.stale_items(load(s, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("qualified_name"), F.md5("text").alias("content_hash")),
     load(s, d, "documents").where("lang = 'en'").select(F.concat(F.lit("doc/"), "doc_id").alias("qualified_name"), F.when(F.col("source") == "src1", F.md5("text")).otherwise("").alias("content_hash"), F.lit("fresh").alias("state"))),
     "SELECT 'doc/' || doc_id AS qualified_name, md5(text) AS content_hash FROM documents WHERE NOT coalesce(lang = 'en' AND source = 'src1', false)")
_raw("e12_changed_files", lambda s, d: J.changed_files(load(s, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash")), load(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("path"), F.md5(F.lower("text")).alias("hash"))),
     "SELECT doc_id AS path, md5(text) AS hash FROM documents WHERE coalesce(lang <> 'en', true) OR md5(text) <> md5(lower(text))")
_e("e13_cross_repo", lambda E: J.cross_repo_similar(E, F.col("language"), F.concat_ws(":", "line_end", "env"), 100),
   "SELECT x.symbol, x.repo AS repo_a, x.q AS a, y.repo AS repo_b, y.q AS b FROM (SELECT line_end || ':' || env AS symbol, language AS repo, min(qualified_name) AS q FROM elements GROUP BY 1, 2) x JOIN (SELECT line_end || ':' || env AS symbol, language AS repo, min(qualified_name) AS q FROM elements GROUP BY 1, 2) y ON x.symbol = y.symbol AND x.repo < y.repo ORDER BY x.symbol, a, b LIMIT 100")
_add("e17_tests", lambda E, R: J.tests_of(R, "function/1").select(_REDGE), f"SELECT {_redge} FROM edges WHERE source_qualified = 'function/1' AND (rel_type IN ('tested_by', 'tests') OR contains(target_qualified, 'test') OR contains(target_qualified, 'spec'))")
_add("e17_related_docs", lambda E, R: J.related_docs(R, "service/3"), "SELECT DISTINCT source_qualified AS doc FROM edges WHERE target_qualified = 'service/3' AND rel_type = 'references'")
_add("e17_files_of_doc", lambda E, R: J.files_of_doc(R, "function/3"), "SELECT DISTINCT target_qualified FROM edges WHERE source_qualified = 'function/3' AND rel_type = 'references'")
_add("e19_valid_at", lambda E, R: J.valid_at(R, AT).groupBy("rel_type").agg(F.count("*").alias("n")), f"SELECT rel_type, count(*) AS n FROM edges WHERE ({_FROM} IS NULL OR {_FROM} <= {AT}) AND ({_TO} IS NULL OR {_TO} >= {AT}) GROUP BY 1")
_raw("e19_as_of", lambda s, d: J.as_of(load(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), load(s, d, "events").where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("viewed")), ["user_id"], "ts", "ts", "viewed").select("event_id", "viewed"),
     "SELECT p.event_id, v.viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS viewed FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts")
_add("e20_service_context", lambda E, R: J.service_context(S.elements_by_type(E, "service").select("qualified_name"), R, R.where("confidence < 0.6").select(F.col("target_qualified").alias("qualified_name"))).select("qualified_name", "calls_out", "calls_in", "incidents"),
     "SELECT e.qualified_name, CAST(0 AS BIGINT) AS calls_out, (SELECT count(*) FROM edges WHERE rel_type = 'service_calls' AND target_qualified = e.qualified_name) AS calls_in, (SELECT count(*) FROM edges WHERE confidence < 0.6 AND target_qualified = e.qualified_name) AS incidents FROM elements e WHERE element_type = 'service'")
_raw("e21_env_conflicts", lambda s, d: J.env_conflicts(load(s, d, "supplier").selectExpr("'n' || s_nationkey AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'staging' ELSE 'production' END AS env", "CAST(s_suppkey % 2 AS STRING) AS version")),
     """WITH w AS (SELECT 'n' || s_nationkey AS name, max(CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 2 AS VARCHAR) END) AS l, max(CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey % 2 AS VARCHAR) END) AS s, max(CASE WHEN s_suppkey % 3 = 2 THEN CAST(s_suppkey % 2 AS VARCHAR) END) AS p FROM supplier GROUP BY 1),
     u AS (SELECT name, 'local' AS env, l AS version, coalesce(l, s, p) AS base FROM w UNION ALL SELECT name, 'staging', s, coalesce(l, s, p) FROM w UNION ALL SELECT name, 'production', p, coalesce(l, s, p) FROM w)
     SELECT name, env, CASE WHEN version IS NULL THEN 'missing' ELSE 'version' END AS conflict, base, version FROM u WHERE version IS NULL OR version <> base""")
_raw("e22_set_quality", lambda s, d: J.set_quality(load(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item")), load(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item"))).select("n_returned", "n_expected", "n_hit"),
     "SELECT count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) AS n_returned, count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) AS n_expected, count(DISTINCT CASE WHEN toxic = 1 AND quality = 1 THEN doc_id END) AS n_hit FROM labels")

# Aggregates
_add("f1_counts", lambda E, R: A.counts(E, R), "SELECT * FROM (SELECT count(*) AS n_elements, count(DISTINCT file_path) AS n_files, count(DISTINCT element_type) AS n_types FROM elements), (SELECT count(*) AS n_edges, count(DISTINCT rel_type) AS n_rel_types FROM edges)")
_e("f2_element_types", lambda E: A.histogram(E, "element_type"), "SELECT element_type, count(*) AS n FROM elements GROUP BY 1")
_add("f2_rel_types", lambda E, R: A.histogram(R, "rel_type"), "SELECT rel_type, count(*) AS n FROM edges GROUP BY 1")
_e("f3_hotspots", lambda E: A.hotspots(E), "SELECT file_path, count(*) AS n_functions FROM elements WHERE element_type = 'function' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("f5_god_nodes", lambda E, R: A.god_nodes(E, R), _GODS)
_add("f5_hub_cut", lambda E, R: A.hub_cut(R, 99), f"SELECT * FROM ({_DEG}) ORDER BY degree DESC, qualified_name LIMIT (SELECT greatest(1, count(*) * 1 // 100) FROM ({_DEG}))")
_add("f6_explain_node", lambda E, R: A.node_explanation(R, START), f"SELECT CASE WHEN source_qualified = '{START}' THEN rel_type ELSE '<-' || rel_type END AS relation, count(*) AS n FROM edges WHERE source_qualified = '{START}' OR target_qualified = '{START}' GROUP BY 1 ORDER BY n DESC, relation LIMIT 8")
_METHOD = "coalesce(json_extract_string(metadata, '$.resolution_method'), 'name')"
_LABEL = f"CASE WHEN {_METHOD} IN ('typed', 'name_file_hint') THEN 'EXTRACTED' WHEN {_METHOD} = 'unresolved' OR confidence < 0.6 THEN 'AMBIGUOUS' ELSE 'INFERRED' END"
_add("f7_confidence", lambda E, R: A.confidence_distribution(R), f"SELECT label, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT {_LABEL} AS label, count(*) AS n FROM edges GROUP BY 1)")
_METRIC = "event_type AS tool_name, CAST(round(value) AS BIGINT) - 50 AS tokens_saved, value - 50 AS savings_percent, event_id % 5 AS correct, event_id % 7 AS total"
_raw("f9_metrics", lambda s, d: A.metrics_summary(load(s, d, "events").selectExpr(*(x.strip() for x in _METRIC.split(", ")))),
     f"""SELECT tool_name, count(*) AS n, coalesce(CAST(sum(CASE WHEN tokens_saved > 0 THEN tokens_saved END) AS BIGINT), 0) AS total_saved, round(avg(CASE WHEN savings_percent > 0 THEN savings_percent END), 6) AS avg_positive_percent,
     round(avg(savings_percent), 6) AS avg_percent, round(avg(CASE WHEN total > 0 THEN correct / total END), 6) AS avg_correct FROM (SELECT {_METRIC} FROM events) GROUP BY 1""")
_raw("f10_team_map", lambda s, d: A.team_map(load(s, d, "supplier").selectExpr("'team' || s_nationkey AS team", "s_name AS service_name", "CASE WHEN s_suppkey % 2 = 0 THEN 'on' || s_suppkey ELSE '' END AS oncall")).select("team", F.array_join("services", ",").alias("services"), "oncall"),
     "SELECT 'team' || s_nationkey AS team, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS services, arg_min(CASE WHEN s_suppkey % 2 = 0 THEN 'on' || s_suppkey END, CASE WHEN s_suppkey % 2 = 0 THEN s_name END) AS oncall FROM supplier GROUP BY 1")
_e("f11_pr_impact", lambda E: A.pr_impact(E, E.where("file_path like 'nation/%' and line_end > 80").select("file_path")),
   "SELECT count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_elements, CASE WHEN count(DISTINCT cluster_id) >= 5 THEN 'HIGH' WHEN count(DISTINCT cluster_id) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM elements WHERE file_path IN (SELECT file_path FROM elements WHERE file_path LIKE 'nation/%' AND line_end > 80)")
_add("f12_change_risk", lambda E, R: A.change_risk(E, R, E.where("file_path = 'nation/3/customer.py'").select("file_path")),
     """SELECT n_changed, n_affected, max_callers, CASE WHEN max_callers >= 20 OR n_affected >= 50 THEN 'critical' WHEN max_callers >= 10 OR n_affected >= 20 THEN 'high' WHEN max_callers >= 3 OR n_affected >= 5 THEN 'medium' ELSE 'low' END AS risk FROM
     (SELECT count(*) AS n_changed FROM elements WHERE file_path = 'nation/3/customer.py'), (SELECT count(DISTINCT source_qualified) AS n_affected FROM edges WHERE target_qualified IN (SELECT qualified_name FROM elements WHERE file_path = 'nation/3/customer.py')),
     (SELECT coalesce(max(k), 0) AS max_callers FROM (SELECT count(DISTINCT source_qualified) AS k FROM edges WHERE rel_type = 'calls' AND target_qualified IN (SELECT qualified_name FROM elements WHERE file_path = 'nation/3/customer.py') GROUP BY target_qualified))""")
_e("f13_cluster_stats", lambda E: A.cluster_stats(E).select("cluster_id", "members", F.array_join("files", ",").alias("files")),
   "SELECT cluster_id, CAST(sum(n) AS BIGINT) AS members, string_agg(file_path, ',' ORDER BY r) FILTER (WHERE r <= 5) AS files FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, file_path) AS r FROM (SELECT cluster_id, file_path, count(*) AS n FROM elements WHERE cluster_id IS NOT NULL GROUP BY 1, 2)) GROUP BY 1")
_add("f13_entry_points", lambda E, R: A.cluster_entry_points(E, R).select("cluster_id", "target_qualified", "n", "rank"),
     f"SELECT * FROM (SELECT cluster_id, target_qualified, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, target_qualified) AS rank FROM (SELECT t.cluster_id, r.target_qualified, count(*) AS n FROM {_TUNNELS} GROUP BY 1, 2)) WHERE rank <= 5")
_e("f14_top_directories", A.top_directories, "SELECT split_part(file_path, '/', 1) AS directory, count(*) AS n, count(DISTINCT file_path) AS n_files FROM elements GROUP BY 1")
_e("f14_folder_children", lambda E: A.folder_children(E, "nation"), "SELECT split_part(substr(file_path, 8), '/', 1) AS child, count(*) AS n FROM elements WHERE starts_with(file_path, 'nation/') GROUP BY 1")
_raw("f15_cost", lambda s, d: A.cost_estimate(load(s, d, "documents").select(F.col("doc_id").alias("path"), "text")).select("lines", "sloc", "bytes", "tokens"),
     "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS sloc, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(CAST(ceil(strlen(text) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM documents")
_e("f17_file_summary", lambda E: A.file_summary(E),
   "SELECT file_path, file_path || ' has ' || count(*) || ' elements: ' || string_agg(DISTINCT element_type || ' ' || name, ', ' ORDER BY element_type || ' ' || name) AS summary FROM elements GROUP BY 1")
_e("f19_rollup", A.rolled_up, "SELECT element_type, env, count(*) AS n, CAST(grouping(element_type, env) AS BIGINT) AS level FROM elements GROUP BY ROLLUP (element_type, env)")

# Traversal
_SYM = "sym AS (SELECT source_qualified AS a, target_qualified AS b, confidence AS c FROM edges UNION ALL SELECT target_qualified, source_qualified, confidence FROM edges)"
_add("g1_impact_radius", lambda E, R: G.impact_radius(E, R, START, 2, 0.8).select("node", "depth"),
     CTE + f""", {_SYM}, l1 AS (SELECT DISTINCT b FROM sym WHERE a = '{START}' AND c >= 0.8 AND b <> '{START}'), l2 AS (SELECT DISTINCT b FROM sym WHERE c >= 0.8 AND a IN (SELECT b FROM l1) AND b <> '{START}' AND b NOT IN (SELECT b FROM l1))
     SELECT b AS node, depth FROM (SELECT b, 1 AS depth FROM l1 UNION ALL SELECT b, 2 FROM l2) WHERE b IN (SELECT qualified_name FROM elements)""")
_add("g2_call_graph", lambda E, R: G.call_graph(R, "function/1", 3), "SELECT source_qualified, target_qualified, 1 AS depth FROM edges WHERE rel_type = 'calls' AND source_qualified = 'function/1'")
_add("g3_shortest_path", lambda E, R: G.shortest_path(R, "module/0", "module/1").select("hops"))
_add("g4_seeded", lambda E, R: G.seeded_traversal(E, R, E.where("qualified_name = 'module/1'").select(F.col("qualified_name").alias("node")), E.sparkSession.createDataFrame([("module", "contains", 2, 5), ("directory", "contains", 2, 4)], "element_type string, rel_type string, hops int, fan_out int")),
     CTE + """, m AS (SELECT target_qualified AS node FROM edges WHERE source_qualified = 'module/1' ORDER BY 1 LIMIT 5),
     d AS (SELECT target_qualified AS node, row_number() OVER (PARTITION BY source_qualified ORDER BY target_qualified) AS r FROM edges WHERE rel_type = 'contains' AND source_qualified IN (SELECT node FROM m))
     SELECT * FROM (SELECT 'module/1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM m UNION ALL SELECT node, 2 FROM d WHERE r <= 4) ORDER BY depth, node LIMIT 60""")
_add("g6_expansion", lambda E, R: G.ontology_expansion(R, "module/2", 2), "SELECT 'module/2' AS node, 0 AS depth UNION ALL SELECT target_qualified, 1 FROM edges WHERE source_qualified = 'module/2' UNION ALL SELECT DISTINCT target_qualified, 2 FROM edges WHERE source_qualified IN (SELECT target_qualified FROM edges WHERE source_qualified = 'module/2')")
_add("g7_question", lambda E, R: Q.question_subgraph(E, R, "What connects ASIA to FRANCE?").select("source_qualified", "target_qualified", "rel_type", "on_path"))
_add("g8_subgraph", lambda E, R: G.subgraph(R, "module/2", 1).select(_REDGE), f"SELECT {_redge} FROM edges WHERE source_qualified = 'module/2'")
_add("g9_communities", lambda E, R: G.communities(R).groupBy("community").agg(F.count("*").alias("members")))
_add("g10_processes", lambda E, R: G.processes(R, E))
_add("g11_timeline", lambda E, R: G.timeline(R).groupBy("event").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")),
     f"SELECT 'added' AS event, count({_FROM}) AS n, min({_FROM}) AS first, max({_FROM}) AS last FROM edges UNION ALL SELECT 'invalidated', count({_TO}), min({_TO}), max({_TO}) FROM edges")
_e("g13_budget", lambda E: G.budgeted(E, 500).select("qualified_name", "tokens", "running"),
   "SELECT * FROM (SELECT qualified_name, tokens, CAST(sum(tokens) OVER (PARTITION BY file_path ORDER BY tokens DESC, qualified_name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT *, CAST(ceil((line_end - line_start + 1) * 10 / 4) AS BIGINT) AS tokens FROM elements)) WHERE running <= 500")

# Vectors
_COS = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 6)"
_raw("i4_k_nearest", lambda s, d: V.k_nearest(load(s, d, "embeddings"), load(s, d, "embeddings").where("vec_id = 0").first()["embedding"], 50).select("vec_id", "cosine"), "SELECT e.vec_id, " + _COS.format(a="e.embedding", b="q.embedding") + " AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY cosine DESC, vec_id LIMIT 50")
_raw("i4_k_nearest_of_set", lambda s, d: V.k_nearest_of_set(load(s, d, "embeddings"), load(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", "vec_id", "rank"),
     "SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, " + _COS.format(a="e.embedding", b="q.embedding") + " AS cosine FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) QUALIFY rank <= 10")
_e("i5_filter_reason", lambda E: E.withColumn("reason", V.filter_reason("local", ["class", "service"], False)).groupBy("reason").agg(F.count("*").alias("n")),
   "SELECT CASE WHEN contains(file_path, '/worktrees/') THEN 'worktree' WHEN env <> 'local' THEN 'env' WHEN contains(lower(name), 'test') OR contains(lower(file_path), 'test') THEN 'test' WHEN element_type NOT IN ('class', 'service') THEN 'type' END AS reason, count(*) AS n FROM elements GROUP BY 1")

# Text
_raw("j_entropy", lambda s, d: load(s, d, "part").select("p_partkey", F.round(T.shannon_entropy(F.col("p_name")), 6).alias("entropy")),
     "SELECT p_partkey, round(-sum(n / strlen(p_name) * log2(n / strlen(p_name))), 6) + 0 AS entropy FROM (SELECT p_partkey, p_name, c, count(*) AS n FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY 1, 2, 3) GROUP BY 1, p_name")
_raw("j_tokens", lambda s, d: load(s, d, "conversations").groupBy("role").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens")), "SELECT role, CAST(sum(CAST(ceil(strlen(text) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
_e("b3_languages", lambda E: E.groupBy(T.language_of(F.col("file_path")).alias("lang")).agg(F.count("*").alias("n")), "SELECT CASE split_part(file_path, '.', -1) WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' ELSE 'yaml' END AS lang, count(*) AS n FROM elements GROUP BY 1")
_e("b11_structure", lambda E: T.physical_structure(E.select(F.col("file_path").alias("path")).distinct()),
   """SELECT DISTINCT array_to_string(p[1:i], '/') AS source_qualified, array_to_string(p[1:i + 1], '/') AS target_qualified, 'contains' AS rel_type FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT DISTINCT string_split(file_path, '/') AS p FROM elements))""")

# Writing semantics and exports
_e("a31_delete_where", lambda E: W.delete_where(E, F.col("parent_qualified").startswith("class/")).groupBy("element_type").agg(F.count("*").alias("n")), "SELECT element_type, count(*) AS n FROM elements WHERE NOT coalesce(starts_with(parent_qualified, 'class/'), false) GROUP BY 1")
_raw("s6_retention", lambda s, d: W.retention(load(s, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp")), 1706745600, 10)[0], "SELECT count(*) AS n_deleted FROM events WHERE epoch(date_trunc('second', ts)) < 1706745600 - 864000")
_add("c6_export_selection", lambda E, R: W.select_for_export(E, R, 50)[0].select("qualified_name", "degree"), f"SELECT qualified_name, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT qualified_name FROM elements) LEFT JOIN ({_DEG}) USING (qualified_name) ORDER BY degree DESC, qualified_name LIMIT 50")
_SAFE_NAME = "replace(replace(name, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39))"
_add("c5_cypher", W.cypher,
     f"""SELECT 'MERGE (:' || element_type || ' {{id: ' || chr(39) || qualified_name || chr(39) || ', name: ' || chr(39) || {_SAFE_NAME} || chr(39) || '}});' AS value FROM elements
     UNION ALL SELECT 'MATCH (a {{id: ' || chr(39) || source_qualified || chr(39) || '}}), (b {{id: ' || chr(39) || target_qualified || chr(39) || '}}) MERGE (a)-[:' || upper(rel_type) || ']->(b);' FROM edges""")
_add("c5_json", W.json_snapshot)
_add("f8_service_graph", lambda E, R: A.service_graph(R), "SELECT source_qualified, target_qualified, count(*) AS call_count, CAST(1 AS BIGINT) AS n_protocols FROM edges WHERE rel_type = 'service_calls' GROUP BY 1, 2")
_e("i2_text_blob", V.text_blob, "SELECT qualified_name, blob, sha256(blob) AS content_hash FROM (SELECT qualified_name, concat_ws(chr(10), element_type || ' ' || name, file_path, 'parent ' || parent_qualified, metadata) AS blob FROM elements)")
_e("a26_upsert", lambda E: W.upsert(E.select("qualified_name", "name"), E.select(F.expr("CASE WHEN line_end > 2 THEN qualified_name ELSE 'new/' || qualified_name END AS qualified_name"), F.upper("qualified_name").alias("name")), ["qualified_name"]),
   "SELECT qualified_name, CASE WHEN line_end > 2 THEN upper(qualified_name) ELSE name END AS name FROM elements UNION ALL SELECT 'new/' || qualified_name, upper(qualified_name) FROM elements WHERE line_end <= 2")
_add("c5_graphml", W.graphml,
     """SELECT '<node id="' || qualified_name || '"><data key="type">' || element_type || '</data></node>' AS value FROM elements UNION ALL SELECT '<edge source="' || source_qualified || '" target="' || target_qualified || '"><data key="rel">' || rel_type || '</data></edge>' FROM edges""")
_add("c5_obsidian", lambda E, R: W.obsidian(E, R).select("note", "place", "value"),
     """SELECT replace(qualified_name, '/', '_') AS note, 0 AS place, '# ' || name AS value FROM elements UNION ALL SELECT replace(qualified_name, '/', '_'), 1, 'type: ' || element_type || ', file: ' || file_path FROM elements
     UNION ALL SELECT DISTINCT replace(source_qualified, '/', '_'), 2, '- ' || rel_type || ' [[' || replace(target_qualified, '/', '_') || ']]' FROM edges""")
_e("c5_wiki", W.wiki, "SELECT file_path, '# ' || file_path || chr(10) || chr(10) || string_agg('- `' || name || '` ' || element_type || ', lines ' || line_start || ' to ' || line_end, chr(10) ORDER BY line_start, qualified_name) AS page FROM elements GROUP BY 1")
_add("m8_labels", lambda E, R: W.backfill_labels(R).groupBy("label").agg(F.count("*").alias("n")), f"SELECT {_LABEL} AS label, count(*) AS n FROM edges GROUP BY 1")

# The query language
def _datalog(name: str, script: str, sql: str, params: dict | None = None) -> None:
    def make(spark: SparkSession, d: str) -> DataFrame:
        out = Database({"code_elements": elements(spark, d), "relationships": edges(spark, d), "embeddings": load(spark, d, "embeddings")}).query(script, params)
        return out.toDF(*(c.replace("(", "_").replace(")", "") for c in out.columns))

    QUERIES[name], ORACLES[name] = make, CTE + sql


_datalog("a4_literal", '?[q, n] := *code_elements[q, "service", n]', "SELECT qualified_name AS q, name AS n FROM elements WHERE element_type = 'service'")
_datalog("a6_span", '?[q, span] := *code_elements[q, t, n, f, s, e], t = "class", span = e - s, span > 85', "SELECT qualified_name AS q, line_end - line_start AS span FROM elements WHERE element_type = 'class' AND line_end - line_start > 85")
_datalog("a8_or", '?[q] := *code_elements[q, t, n], (t = "module" or starts_with(n, "FR"))', "SELECT qualified_name AS q FROM elements WHERE element_type = 'module' OR starts_with(name, 'FR')")
_datalog("a10_null", "?[count(q)] := *code_elements{qualified_name: q, parent_qualified: p}, p = null", "SELECT count(*) AS count_q FROM elements WHERE parent_qualified IS NULL")
_datalog("a11_in", "?[q, t] := *code_elements[q, t, n], n in $names", "SELECT qualified_name AS q, element_type AS t FROM elements WHERE name IN ('ASIA', 'FRANCE')", {"names": ["ASIA", "FRANCE"]})
_datalog("a12_regex", '?[q] := *code_elements[q, t, n], regex_matches(n, "^(ASIA|E.*)$"), !regex_matches(q, "struct")', "SELECT qualified_name AS q FROM elements WHERE regexp_matches(name, '^(ASIA|E.*)$') AND NOT contains(qualified_name, 'struct')")
_datalog("a19_distinct", "files[f] := *code_elements{file_path: f}\n?[count(f)] := files[f]", "SELECT count(DISTINCT file_path) AS count_f FROM elements")
_datalog("a20_group", "?[t, count(q)] := *code_elements[q, t] :order -count(q)", "SELECT element_type AS t, count(*) AS count_q FROM elements GROUP BY 1")
_datalog("a22_limit", '?[q] := *code_elements[q, "function"] :order q :limit 7 :offset 3', "SELECT qualified_name AS q FROM elements WHERE element_type = 'function' ORDER BY q LIMIT 7 OFFSET 3")
_datalog("a23_anti", '?[q] := *code_elements[q, "struct"], not *relationships{target_qualified: q}', "SELECT qualified_name AS q FROM elements WHERE element_type = 'struct' AND qualified_name NOT IN (SELECT target_qualified FROM edges)")
_datalog("a36_join", '?[n, count(s)] := *relationships[s, q, "calls"], *code_elements[q, "class", n] :order -count(s), n :limit 20', "SELECT name AS n, count(*) AS count_s FROM edges JOIN elements ON target_qualified = qualified_name WHERE rel_type = 'calls' AND element_type = 'class' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
