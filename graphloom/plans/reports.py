"""Registered queries of the reports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as P
from .catalog import _DEG, _add, _e, _raw
from .views import CTE, load

_add("f3_architecture", P.architecture, """SELECT 'language' AS section, language AS name, count(*) AS n FROM elements WHERE language IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'type', element_type, count(*) FROM elements GROUP BY 2 UNION ALL SELECT 'cluster', cluster_id, count(*) FROM elements WHERE cluster_id IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'relation', rel_type, count(*) FROM edges GROUP BY 2
    UNION ALL (SELECT 'hotspot', file_path, count(*) AS c FROM elements WHERE element_type = 'function' GROUP BY 2 ORDER BY c DESC, file_path LIMIT 10)""")
_N1 = "SELECT * FROM elements WHERE file_path IN ('customer/1.go', 'nation/3/customer.py', 'region/1.md')"
_add("n1_review_context", lambda E, R: P.review_context(E, R, ["customer/1.go", "nation/3/customer.py", "region/1.md"]), CTE + f""", own AS ({_N1}),
    out AS (SELECT * FROM edges WHERE source_qualified IN (SELECT qualified_name FROM own))
    SELECT 'element' AS kind, qualified_name AS subject, element_type || ' ' || line_start || '-' || line_end AS detail FROM own UNION ALL SELECT 'edge', source_qualified, rel_type || ' ' || target_qualified FROM out
    UNION ALL SELECT 'prompt', 'review', 'Review 3 files with ' || (SELECT count(*) FROM own) || ' elements and ' || (SELECT count(*) FROM out) || ' outgoing edges.'""")
_raw("n6_change_set", lambda s, d: P.change_set(load(s, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("content_hash")), load(s, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.when(F.count("*") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("content_hash"))),
     "SELECT coalesce(c_custkey, o_custkey) AS path, CASE WHEN c_custkey IS NULL THEN 'added' WHEN o_custkey IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM customer FULL JOIN (SELECT o_custkey, CASE WHEN count(*) % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS h FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_mktsegment IS DISTINCT FROM h")
_CHECKS = {
    "named": "count(*) FILTER (qualified_name IS NULL) FROM elements", "line_order": "count(*) FILTER (line_end < line_start) FROM elements", "known_env": "count(*) FILTER (env NOT IN ('local', 'staging', 'production')) FROM elements",
    "unique_names": "count(qualified_name) - count(DISTINCT qualified_name) FROM elements", "confidence_range": "count(*) FILTER (NOT confidence BETWEEN 0 AND 1) FROM edges", "no_loops": "count(*) FILTER (source_qualified = target_qualified) FROM edges",
    "resolved_targets": "count(*) FROM edges WHERE target_qualified NOT IN (SELECT qualified_name FROM elements)",
}
_add("n8_self_test", P.self_test, CTE + " SELECT check_name, n_bad = 0 AS ok, n_bad FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS check_name, {v.replace(' FROM', ' AS n_bad FROM', 1)}" for k, v in _CHECKS.items()) + ")")
_SERVICES = "'n' || s_nationkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'staging' ELSE 'production' END AS env, CAST(s_suppkey % 2 AS VARCHAR(9)) AS version, CAST(s_suppkey % 5 AS VARCHAR(9)) AS config"
_raw("e21_env_drift", lambda s, d: P.env_drift(s.sql("SELECT " + _SERVICES + " FROM {t}", t=load(s, d, "supplier"))), f"""WITH s AS (SELECT name, env, min({{'v': version, 'c': config}}) AS x FROM (SELECT {_SERVICES} FROM supplier) GROUP BY 1, 2),
    e AS (SELECT unnest(['local', 'staging', 'production']) AS env, unnest([1, 2, 3]) AS place), w AS (SELECT name, e.env, place, x FROM (SELECT DISTINCT name FROM s) CROSS JOIN e LEFT JOIN s USING (name, env)),
    b AS (SELECT *, first_value(x IGNORE NULLS) OVER (PARTITION BY name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM w),
    k AS (SELECT name, env, CASE WHEN x IS NULL THEN 'missing' WHEN x.v <> base.v THEN 'version' WHEN x.c <> base.c THEN 'drift' END AS conflict FROM b)
    SELECT *, CASE WHEN conflict = 'version' OR conflict = 'missing' AND env = 'production' THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM k WHERE conflict IS NOT NULL""")
_add("d18_dependencies", lambda E, R: P.orchestrate(E, R, "what dependencies has it", "function/7"), "SELECT DISTINCT 'dependencies' AS intent, target_qualified AS item FROM edges WHERE source_qualified = 'function/7'")
_add("d18_search", lambda E, R: P.orchestrate(E, R, "find it", "ring"), "SELECT 'search' AS intent, qualified_name AS item FROM elements WHERE contains(lower(name), 'ring')")
_add("d18_context", lambda E, R: P.orchestrate(E, R, "hello", "class/7"), "SELECT DISTINCT 'context' AS intent, CASE WHEN source_qualified = 'class/7' THEN target_qualified ELSE source_qualified END AS item FROM edges WHERE 'class/7' IN (source_qualified, target_qualified)")
_HITS = "l_orderkey AS query_id, l_linenumber AS item, CAST(l_discount AS DOUBLE) AS distance, CAST(l_quantity AS DOUBLE) AS q"
_raw("i6_rerank", lambda s, d: P.rerank(s.sql("SELECT " + _HITS + " FROM {t}", t=load(s, d, "lineitem")), F.col("q")).drop("q"), f"SELECT query_id, item, distance, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, distance, item) AS rank FROM (SELECT {_HITS} FROM lineitem)")
_raw("i6_rerank_fallback", lambda s, d: P.rerank(s.sql("SELECT " + _HITS + " FROM {t}", t=load(s, d, "lineitem")).drop("q")), f"SELECT query_id, item, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item) AS rank FROM (SELECT {_HITS} FROM lineitem)")
_e("f17_modules", P.module_summary, "SELECT split_part(file_path, '/', 1) AS module, split_part(file_path, '/', 1) || ': ' || count(DISTINCT file_path) || ' files, ' || count(*) || ' elements (' || string_agg(DISTINCT element_type, ', ' ORDER BY element_type) || ')' AS summary FROM elements GROUP BY 1")
_e("f19_cube", P.cubed, "SELECT element_type, env, count(*) AS n, CAST(grouping(element_type, env) AS BIGINT) AS level FROM elements GROUP BY CUBE (element_type, env)")
_e("f19_sets", P.grouping_sets, "SELECT element_type, language, env, count(*) AS n FROM elements GROUP BY GROUPING SETS ((element_type, language), (env))")
_e("f19_quantiles", P.quantiles, "SELECT element_type, round(quantile_cont(line_end - line_start + 1, 0.5), 6) AS median, round(quantile_cont(line_end - line_start + 1, 0.9), 6) AS p90 FROM elements GROUP BY 1")
_raw("n2_line_ranges", lambda s, d: P.read_range(load(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line")), "2-3,6-"), "SELECT l_orderkey, l_linenumber AS line FROM lineitem WHERE l_linenumber IN (2, 3) OR l_linenumber >= 6")
_SUPPLY = "SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'p' || p_partkey, 'n' || p_partkey % 25 FROM part"


def _supply(s, d):
    tables = {n: load(s, d, n) for n in ("lineitem", "supplier", "part")}
    text = _SUPPLY
    for n in tables:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return s.sql(text, **tables).toDF("source_qualified", "target_qualified")


_raw("g15_triangles", lambda s, d: P.triangles(_supply(s, d)), f"WITH e AS ({_SUPPLY}), u AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM e) SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
_SWEEP = "r{k} AS (SELECT node, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(got, 0) AS rank FROM v LEFT JOIN (SELECT t AS node, sum(rank / fan) AS got FROM m JOIN r{j} ON s = node GROUP BY 1) USING (node))"
_raw("g15_page_rank", lambda s, d: P.page_rank(_supply(s, d), 10).withColumn("rank", F.round("rank", 9)), f"WITH e AS ({_SUPPLY}), m AS (SELECT s, t, count(*) OVER (PARTITION BY s) AS fan FROM e), v AS (SELECT s AS node FROM e UNION SELECT t FROM e), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v), "
     + ", ".join(_SWEEP.format(k=k, j=k - 1) for k in range(1, 11)) + " SELECT node, round(rank, 9) AS rank FROM r10")
_add("c5_html", P.html, """SELECT 0 AS place, '<!doctype html><title>Graph</title>' AS value UNION ALL SELECT 1, '<section id="' || qualified_name || '">' || element_type || ' ' || name || '</section>' FROM elements
    UNION ALL SELECT 2, '<a href="#' || target_qualified || '" data-from="' || source_qualified || '">' || rel_type || '</a>' FROM edges""")
_AT = f"SELECT qualified_name, name, CAST(500 + round(400 * cos(t)) AS BIGINT) AS x, CAST(500 + round(400 * sin(t)) AS BIGINT) AS y FROM (SELECT *, 2 * pi() * (row_number() OVER (ORDER BY degree DESC, qualified_name) - 1) / 100 AS t FROM (SELECT qualified_name, name, coalesce(degree, 0) AS degree FROM elements LEFT JOIN ({_DEG}) USING (qualified_name) ORDER BY degree DESC, qualified_name LIMIT 100))"
_add("c5_svg", P.svg, CTE + f""", places AS ({_AT}) SELECT '<circle cx="' || x || '" cy="' || y || '" r="6"><title>' || name || '</title></circle>' AS value FROM places
    UNION ALL SELECT '<line x1="' || a.x || '" y1="' || a.y || '" x2="' || b.x || '" y2="' || b.y || '"/>' FROM (SELECT DISTINCT source_qualified, target_qualified FROM edges) JOIN places a ON a.qualified_name = source_qualified JOIN places b ON b.qualified_name = target_qualified""")
