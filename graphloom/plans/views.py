"""The graph's tables over a star schema: one SQL text for Spark and for the oracle.

``elements`` are regions, nations, customers, suppliers, parts and orders;
``edges`` connect them. Both are declared once; only the epoch function
differs between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENV = "CASE {k} % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'staging' ELSE 'production' END"


def _element(table: str, kind: str, key: str, name: str, path: str, lines: str, language: str, parent: str, cluster: str) -> str:
    return f"""SELECT '{kind}/' || {key} AS qualified_name, '{kind}' AS element_type, {name} AS name, {path} AS file_path,
        CAST(1 AS BIGINT) AS line_start, CAST({lines} AS BIGINT) AS line_end, {language} AS language, {parent} AS parent_qualified,
        {cluster} AS cluster_id, '{{"key":' || {key} || '}}' AS metadata, {_ENV.format(k=key)} AS env, 'physical' AS ontology_layer FROM {table}"""


_NONE = "CAST(NULL AS VARCHAR(64))"
ELEMENTS = "\nUNION ALL ".join(
    [
        _element("region", "module", "r_regionkey", "r_name", "'region/' || r_regionkey || '.md'", "1 + r_regionkey", "'text'", _NONE, _NONE),
        _element("nation", "directory", "n_nationkey", "n_name", "'region/' || n_regionkey || '/' || n_nationkey || '.md'", "1 + n_nationkey", "'text'", "'module/' || n_regionkey", "'c' || n_regionkey"),
        _element("customer", "class", "c_custkey", "c_name", "'nation/' || c_nationkey || '/customer.py'", "1 + c_custkey % 90", "c_mktsegment", "'directory/' || c_nationkey", "'n' || c_nationkey"),
        _element("supplier", "service", "s_suppkey", "s_name", "'nation/' || s_nationkey || '/service.yaml'", "1 + s_suppkey % 40", "'yaml'", "'directory/' || s_nationkey", "'n' || s_nationkey"),
        _element("part", "struct", "p_partkey", "p_name", "'part/' || p_brand || '/test_part.rs'", "p_size", "p_brand", _NONE, "'p' || p_size"),
        _element("orders", "function", "o_orderkey", "'order_' || o_orderkey", "'customer/' || o_custkey || '.go'", "1 + o_orderkey % 200", "o_orderpriority", "'class/' || o_custkey", "'o' || (o_custkey % 25)"),
    ]
)


_ONE = "CAST(1.0 AS DOUBLE), '{}'"
#: Edges without a line: containment, and the calls of orders.
PLAIN_EDGES = f"""SELECT 'module/' || n_regionkey AS source_qualified, 'directory/' || n_nationkey AS target_qualified, 'contains' AS rel_type, CAST(1.0 AS DOUBLE) AS confidence, '{{}}' AS metadata, 'local' AS env FROM nation
        UNION ALL SELECT 'directory/' || c_nationkey, 'class/' || c_custkey, 'contains', {_ONE}, {_ENV.format(k='c_custkey')} FROM customer
        UNION ALL SELECT 'directory/' || s_nationkey, 'service/' || s_suppkey, 'contains', {_ONE}, {_ENV.format(k='s_suppkey')} FROM supplier
        UNION ALL SELECT 'function/' || o_orderkey, 'class/' || o_custkey, 'calls', CAST(0.9 AS DOUBLE), '{{}}', {_ENV.format(k='o_orderkey')} FROM orders"""
#: Target and type of the two edges of a line; what both have besides.
LINE_EDGES = [
    ("'struct/' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END)", "'imports'"),
    ("'service/' || l_suppkey", "CASE WHEN l_linenumber % 2 = 0 THEN 'service_calls' ELSE 'references' END"),
]
LINE_REST = f"""'{{"valid_from":' || t || CASE WHEN l_linenumber % 3 = 0 THEN ',"valid_to":' || (t + 2592000) ELSE '' END ||
        ',"resolution_method":"' || CASE l_linenumber % 4 WHEN 0 THEN 'typed' WHEN 1 THEN 'name' WHEN 2 THEN 'name_file_hint' ELSE 'unresolved' END || '"}}', {_ENV.format(k="l_orderkey")}"""


def _lines(epoch: str) -> str:
    return f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1.0 - 5.0 * l_discount AS conf, {epoch.format('l_shipdate')} AS t FROM lineitem"


def edges_sql(epoch: str) -> str:
    lines = [f"SELECT 'function/' || l_orderkey, {target}, {kind}, CAST(conf AS DOUBLE), {LINE_REST} FROM ({_lines(epoch)}) x" for target, kind in LINE_EDGES]
    return "\n        UNION ALL ".join([PLAIN_EDGES, *lines])


_DUCK_EPOCH = "CAST(epoch({}) AS BIGINT)"
_SPARK_EPOCH = "unix_timestamp(CAST({} AS TIMESTAMP))"
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The oracle's common table expressions; a query goes on with its SELECT.
CTE = f"WITH elements AS ({ELEMENTS}),\nedges AS ({edges_sql(_DUCK_EPOCH)})\n"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, names: list[str]) -> DataFrame:
    # argument substitution keeps the session's catalog clean
    tables = {n: load(spark, sf_dir, n) for n in names}
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **tables)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ELEMENTS, ["region", "nation", "customer", "supplier", "part", "orders"])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges; both of a line come from one scan."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ends = ", ".join(f"named_struct('t', {target}, 'r', {kind})" for target, kind in LINE_EDGES)
    lines = f"SELECT 'function/' || l_orderkey, e.t, e.r, CAST(conf AS DOUBLE), {LINE_REST} FROM ({_lines(_SPARK_EPOCH)}) LATERAL VIEW explode(array({ends})) v AS e"
    return _view(spark, sf_dir, PLAIN_EDGES + "\nUNION ALL " + lines, ["nation", "customer", "supplier", "orders", "lineitem"])
