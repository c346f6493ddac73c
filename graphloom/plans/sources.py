"""Registered queries of extraction, structured sources, stored tables, vector search, components and sketches.

The source files that the extractors read are written by Spark from the rows of
the star schema, some twenty rows to a file, so that their number grows with the
tables and the oracle can state what each file says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import changes, documents, scopes, services, structured, symbols
from ..operators import ann, graphs, pack
from ..operators import joins as J
from ..operators import questions as Q
from ..operators import ranking as K
from ..operators import tables as W
from ..operators import traversal as G
from ..operators import vectors as V
from ..operators.store import KeyedTable
from ..sources import ontology
from .catalog import ORACLES, _raw
from .views import CTE, edges, elements, load


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _texts(rows: DataFrame, path: Column, head: Column, line: Column, tail: Column, order: str) -> DataFrame:
    """files (path, text): the lines of a path's rows in order, between its head and its tail."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("s")))), lambda x: x["s"]), "")
    return rows.groupBy(path.alias("path")).agg(F.concat(F.first(head), body, F.first(tail)).alias("text"))


# Part k is a function of the file of its group of twenty, in the group's language

_BODIES = {
    0: ("py", "class Box:\n", "    def make_{k}(self, n):\n        # NOTE: gone_{k}(1) {{\n        text = \"def not_here(x): {{\"\n        def inner_{k}(x):\n            return helper_{k}(x)\n        return inner_{k}(n) + self.make_{f}(\n            n)\n\n", ""),
    1: ("js", "class Box {{\n", "  make_{k}(n) {{\n    // NOTE: gone_{k}(1) {{\n    const text = `function not_here(x) {{`;\n    function inner_{k}(x) {{\n      return helper_{k}(x); }}\n    return inner_{k}(n) + this.make_{f}(\n      n); }}\n\n", "}}\n"),
    2: ("java", "public class Box {{\n", "  public int make_{k}(int n) throws Exception {{\n    /* NOTE: gone_{k}(1) {{ */\n    String text = \"int not_here(int x) {{\"; char c = '{{';\n    if (n > 0) {{\n      return helper_{k}(n); }}\n    return inner_{k}(n) + this.make_{f}(\n      n); }}\n\n", "}}\n"),
    3: ("go", "type Box struct {{ n int }}\n", "func (b *Box) make_{k}(n int) int {{\n\t// NOTE: gone_{k}(1) {{\n\ttext := `func not_here(x int) {{`; c := '{{'\n\tif n > 0 {{\n\t\treturn helper_{k}(n) }}\n\treturn inner_{k}(n) + b.make_{f}(\n\t\tn) }}\n\n", ""),
}


def _filled(template: str) -> Column:
    """A template with {k} and {f} from the columns of that name, and doubled braces for single ones."""
    plain = template.replace("{{", "\x01").replace("}}", "\x02")
    out = F.replace(F.replace(F.lit(plain), F.lit("{k}"), F.col("k").cast("string")), F.lit("{f}"), F.col("f").cast("string"))
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def code_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 20").alias("g"))
    rows = rows.join(rows.groupBy("g").agg(F.min("k").alias("f")), "g")
    pick = lambda place: F.coalesce(*(F.when(F.col("g") % 4 == n, _filled(b[place])) for n, b in _BODIES.items()))
    suffix = F.element_at(F.array(*(F.lit(b[0]) for b in _BODIES.values())), (F.col("g") % 4).cast("int") + 1)
    return _texts(rows, F.concat(F.lit("src/f"), F.col("g").cast("string"), F.lit("."), suffix), pick(1), pick(2), pick(3), "k")


_CODE = """WITH p AS (SELECT p_partkey AS k, p_partkey // 20 AS g, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS r,
    count(*) OVER (PARTITION BY p_partkey // 20) AS m, min(p_partkey) OVER (PARTITION BY p_partkey // 20) AS f FROM part),
c AS (SELECT *, g % 4 AS l, 'src/f' || g || '.' || ['py', 'js', 'java', 'go'][g % 4 + 1] AS path FROM p),
b AS (SELECT *, path || '::Box' AS box, path || '::Box::make_' || k AS make, CASE WHEN l < 2 THEN path || '::Box::make_' || k || '::inner_' || k END AS nest FROM c)
"""
_raw(
    "b4_scopes",
    lambda s, d: scopes.elements(scopes.scan(code_files(s, d))),
    _CODE + """SELECT path AS file_path, 'method' AS element_type, 'make_' || k AS name, make AS qualified_name, box AS parent_qualified, CAST(2 + 8 * r AS INT) AS line_start, CAST(8 + 8 * r AS INT) AS line_end FROM b
UNION ALL SELECT path, 'function', 'inner_' || k, nest, make, CAST(5 + 8 * r AS INT), CAST(6 + 8 * r AS INT) FROM b WHERE nest IS NOT NULL
UNION ALL SELECT DISTINCT path, CASE l WHEN 3 THEN 'struct' ELSE 'class' END, 'Box', box, NULL, 1, CAST(CASE l WHEN 0 THEN 8 * m WHEN 3 THEN 1 ELSE 2 + 8 * m END AS INT) FROM b""",
)
_raw(
    "b10_scoped_calls",
    lambda s, d: scopes.resolved_calls(scopes.scan(code_files(s, d)), folder=shared_folder(s)),
    _CODE + """SELECT coalesce(nest, make) AS source_qualified, '__unresolved__helper_' || k AS target_qualified, 'calls' AS rel_type, 'unresolved' AS resolution_method, CAST(6 + 8 * r AS INT) AS line, 1::BIGINT AS n_sites FROM b
UNION ALL SELECT make, coalesce(nest, '__unresolved__inner_' || k), 'calls', CASE WHEN nest IS NULL THEN 'unresolved' ELSE 'name_file_hint' END, CAST(7 + 8 * r AS INT), 1 FROM b
UNION ALL SELECT make, box || '::make_' || f, 'calls', 'name_file_hint', CAST(7 + 8 * r AS INT), 1 FROM b""",
)

# Suppliers as Terraform resources, orders as Gradle and Maven dependencies, customers as Android components, parts as jobs


def terraform_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.expr("s_suppkey div 10").alias("g"))
    line = F.format_string('resource "box_store" "s%d" {\n  name = "x {" # { var.gone\n  size = var.size_%d\n  tags {\n    peer = "${box_store.s%d.id}"\n  }\n}\n', "k", F.col("n"), F.col("g") * 10)
    sizes = rows.select("g", "n").distinct().select((F.col("n") - 1000).cast("long").alias("k"), F.format_string('variable "size_%d" {\n  default = 1\n}\n', "n").alias("s"), "g")
    every = rows.select(F.col("k").cast("long").alias("k"), line.alias("s"), "g").unionByName(sizes)
    return _texts(every, F.format_string("infra/g%d/main.tf", "g"), F.lit(""), F.col("s"), F.lit(""), "k")


_raw(
    "b5_terraform",
    lambda s, d: structured.terraform(terraform_files(s, d))[1],
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey // 10 AS g, 'infra/g' || (s_suppkey // 10) || '/main.tf::' AS p FROM supplier)
SELECT p || 'box_store.s' || k AS source_qualified, p || 'var.size_' || n AS target_qualified, 'depends_on' AS rel_type FROM s
UNION SELECT p || 'box_store.s' || k, p || 'box_store.s' || (g * 10), 'depends_on' FROM s WHERE k <> g * 10 AND g * 10 IN (SELECT k FROM s)""",
)
_raw(
    "b5_terraform_blocks",
    lambda s, d: structured.terraform(terraform_files(s, d))[0].select("qualified_name", "element_type", "name"),
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'infra/g' || (s_suppkey // 10) || '/main.tf::' AS p FROM supplier)
SELECT p || 'box_store.s' || k AS qualified_name, 'terraform_resource' AS element_type, 'box_store.s' || k AS name FROM s
UNION SELECT p || 'var.size_' || n, 'terraform_variable', 'var.size_' || n FROM s""",
)


def gradle_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.expr("c_custkey div 20").alias("g"))
    line = F.when(F.col("k") % 3 == 0, F.format_string('    implementation("org.n%d:lib-%d:1.%d") // api("a:b:c")\n', "n", "k", "n")).when(F.col("k") % 3 == 1, F.format_string('    api project(":m%d")\n', "k")).otherwise(F.format_string('    testImplementation "org.t:t%d:2"\n', "k"))
    return _texts(rows, F.format_string("app%d/build.gradle", "g"), F.lit('plugins {\n    id("java")\n}\n/* dependencies { api("x:y:z") } */\ndependencies {\n'), line, F.lit("}\n"), "k")


_raw(
    "b5_gradle",
    lambda s, d: structured.gradle(gradle_files(s, d)),
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'app' || (c_custkey // 20) || '/build.gradle' AS p FROM customer)
SELECT p AS source_qualified, CASE k % 3 WHEN 0 THEN 'org.n' || n || ':lib-' || k || ':1.' || n WHEN 1 THEN ':m' || k ELSE 'org.t:t' || k || ':2' END AS target_qualified,
    CASE k % 3 WHEN 1 THEN 'depends_on_module' ELSE 'depends_on' END AS rel_type, CASE k % 3 WHEN 0 THEN 'implementation' WHEN 1 THEN 'api' ELSE 'testImplementation' END AS configuration FROM c
UNION SELECT p, 'java', 'applies_plugin', NULL FROM c""",
)


def maven_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"), F.expr("p_partkey div 20").alias("g"))
    version = F.when(F.col("k") % 2 == 0, F.col("v").cast("string")).otherwise(F.lit("${lib.version}"))
    scope = F.when(F.col("k") % 5 == 0, F.lit("<scope>test</scope>")).otherwise(F.lit(""))
    line = F.format_string("<dependency><groupId>org.b</groupId><artifactId>a%d</artifactId><version>%s</version>%s</dependency>\n", F.col("k"), version, scope)
    return _texts(rows, F.format_string("m%d/pom.xml", "g"), F.format_string("<project><properties><lib.version>9.%d</lib.version></properties><!-- <dependency/> --><dependencies>\n", F.col("g")), line, F.lit("</dependencies></project>"), "k")


_raw(
    "b5_maven",
    lambda s, d: structured.maven_dependencies(maven_files(s, d)),
    """SELECT 'm' || (p_partkey // 20) || '/pom.xml' AS source_qualified, 'org.b:a' || p_partkey AS target_qualified, 'depends_on' AS rel_type,
    CASE p_partkey % 2 WHEN 0 THEN CAST(p_size AS VARCHAR) ELSE '9.' || (p_partkey // 20) END AS version, CASE p_partkey % 5 WHEN 0 THEN 'test' ELSE 'compile' END AS scope FROM part""",
)


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 20").alias("g"))
    tag = F.when(F.col("k") % 4 == 0, "service").otherwise("activity")
    name = F.when(F.col("k") % 2 == 0, F.format_string(".Screen%d", "k")).otherwise(F.format_string("org.far.Screen%d", "k"))
    inner = F.when(F.col("k") % 20 == 1, F.lit('<intent-filter><action android:name="android.intent.action.MAIN"/></intent-filter>')).otherwise(F.lit(""))
    line = F.format_string('<%s android:name="%s" android:exported="%s">%s</%s>\n', tag, name, (F.col("k") % 3 == 0).cast("string"), inner, tag)
    head = F.format_string('<?xml version="1.0"?>\n<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="org.app%d"><uses-permission android:name="P.NET"/><application>\n', F.col("g"))
    return _texts(rows, F.format_string("g%d/AndroidManifest.xml", "g"), head, line, F.lit("</application></manifest>"), "k")


_MANIFEST = """WITH c AS (SELECT c_custkey AS k, 'g' || (c_custkey // 20) || '/AndroidManifest.xml' AS p,
    CASE c_custkey % 2 WHEN 0 THEN 'org.app' || (c_custkey // 20) || '.Screen' ELSE 'org.far.Screen' END || c_custkey AS name FROM customer)
"""
_raw(
    "b5_manifest",
    lambda s, d: structured.android_manifest(manifest_files(s, d))[0],
    _MANIFEST + "SELECT p || '::' || name AS qualified_name, CASE k % 4 WHEN 0 THEN 'android_service' ELSE 'android_activity' END AS element_type, name, p AS file_path, k % 3 = 0 AS exported FROM c",
)
_raw(
    "b5_manifest_edges",
    lambda s, d: structured.android_manifest(manifest_files(s, d))[1],
    _MANIFEST + """SELECT p AS source_qualified, p || '::' || name AS target_qualified, 'declares_component' AS rel_type FROM c
UNION SELECT p, 'permission::P.NET', 'requires_permission' FROM c UNION SELECT p, p || '::' || name, 'launches' FROM c WHERE k % 20 = 1""",
)


def workflow_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 20").alias("g"))
    needs = F.when(F.col("k") % 20 > 1, F.format_string("    needs: [job_%d, 'job_%d'] # all\n", F.col("g") * 20 + 1, F.col("k") - 1)).otherwise(F.lit(""))
    line = F.concat(F.format_string("  job_%d:\n    runs-on: linux\n", "k"), needs, F.format_string("    steps:\n    - uses: a/checkout@v%d\n    - name: say\n      run: |\n        jobs:\n          uses: none\n      with:\n        uses_not: x\n    - uses: \"b/setup@%d\"\n", F.col("k") % 3, F.col("k") % 2))
    return _texts(rows, F.format_string(".github/workflows/w%d.yml", "g"), F.lit("name: all # jobs:\non:\n  push:\n    branches: [main]\njobs:\n"), line, F.lit("\n"), "k")


_raw(
    "b5_workflows",
    lambda s, d: structured.workflows(workflow_files(s, d))[1],
    """WITH j AS (SELECT p_partkey AS k, p_partkey // 20 AS g, '.github/workflows/w' || (p_partkey // 20) || '.yml' AS p FROM part)
SELECT p AS source_qualified, p || '::job_' || k AS target_qualified, 'has_job' AS rel_type FROM j
UNION SELECT p || '::job_' || k, p || '::job_' || unnest([g * 20 + 1, k - 1]), 'needs' FROM j WHERE k % 20 > 1
UNION SELECT p || '::job_' || k, 'action::' || unnest(['a/checkout@v' || (k % 3), 'b/setup@' || (k % 2)]), 'uses_action' FROM j""",
)

# Nations as concepts, regions as workflows with a step for each nation


def ontology_files(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    nation = load(spark, d, "nation").where(only)
    concept = F.format_string("  - id: c%d\n    type_: domain_entity\n    name: '%s'\n    aliases:\n      - alias %d\n      - \"second: %d\"\n    description: About %d # not this\n    code_refs: [src/n%d.rs, \"src/n%d.rs::run\"]\n", "n_nationkey", "n_name", *["n_nationkey"] * 5)
    step = F.format_string("      - id: s%d\n        name: Step %d\n        code_refs:\n        - src/n%d.rs\n        failure_modes:\n        - late\n", *["n_nationkey"] * 3)
    concepts = _texts(nation, F.format_string("ontology/c%d.yaml", "n_regionkey"), F.lit("# concepts\nconcepts:\n"), concept, F.lit(""), "n_nationkey")
    workflows = _texts(nation, F.format_string("ontology/w%d.yaml", "n_regionkey"), F.format_string("workflows:\n  - id: w%d\n    name: Flow\n    env: staging\n    description: |\n      Two lines,\n      the second one.\n    steps:\n", "n_regionkey"), step, F.lit(""), "n_nationkey")
    return concepts.unionByName(workflows)


_ONTOLOGY = """WITH n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, 'ontology://concept/c' || n_nationkey AS c, 'ontology://workflow/w' || n_regionkey AS w,
    'ontology://workflow/w' || n_regionkey || '/s' || n_nationkey AS s, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation)
"""
_ELEMENTS = """SELECT c AS qualified_name, 'domain_entity' AS element_type, name, 'local' AS env, 'About ' || k AS description, 'alias ' || k || '|second: ' || k AS aliases FROM n
UNION ALL SELECT DISTINCT w, 'workflow', 'Flow', 'staging', 'Two lines,' || chr(10) || 'the second one.', '' FROM n
UNION ALL SELECT s, 'workflow_step', 'Step ' || k, 'staging', '', '' FROM n UNION ALL SELECT s || '/late', 'failure_mode', 'late', 'staging', '', '' FROM n"""


def _plain(elements: DataFrame) -> DataFrame:
    return elements.select("qualified_name", "element_type", "name", "env", "description", F.array_join("aliases", "|").alias("aliases"))


_raw("b17_ontology", lambda s, d: _plain(ontology.read_ontology(ontology_files(s, d))[0]), _ONTOLOGY + _ELEMENTS)
_raw(
    "b17_ontology_edges",
    lambda s, d: ontology.read_ontology(ontology_files(s, d))[1].drop("source_file"),
    _ONTOLOGY + """SELECT c AS source_qualified, unnest(['src/n' || k || '.rs', 'src/n' || k || '.rs::run']) AS target_qualified, 'implemented_by' AS rel_type FROM n
UNION ALL SELECT w, s, 'has_step' FROM n UNION ALL SELECT s, 'src/n' || k || '.rs', 'implemented_by' FROM n UNION ALL SELECT s, s || '/late', 'has_failure_mode' FROM n
UNION ALL SELECT w || '/s' || before, s, 'next_step' FROM n WHERE before IS NOT NULL""",
)


def _reloaded(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of one folder: the second lacks the nations whose key has the rest 4 by 5."""
    folder = shared_folder(spark)
    ontology.reload(ontology_files(spark, d), folder, 1)
    return _plain(ontology.reload(ontology_files(spark, d, "n_nationkey % 5 <> 4"), folder, 2)[0].read())


_raw("b17_reload", _reloaded, _ONTOLOGY.replace("FROM nation)", "FROM nation WHERE n_nationkey % 5 <> 4)") + _ELEMENTS)

# Stored tables


def _stored(spark: SparkSession, d: str) -> KeyedTable:
    """Customers keyed by id: all orders upserted by year in two commits (the later one first), those of one nation deleted."""
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    table = KeyedTable.create(spark, shared_folder(spark), "custkey long, version long, status string", ["custkey"], "version", buckets=8)
    late = F.col("version") % 7 > 3
    table.upsert(orders.where(late))
    table.upsert(orders.where(~late))
    table.delete(load(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("custkey")))
    return table


_raw(
    "c4_stored_upserts",
    lambda s, d: _stored(s, d).read(),
    "SELECT o_custkey AS custkey, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3 GROUP BY 1",
)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """M1: an annotation for each part, rewritten for some, taken back for others."""
    part = load(spark, d, "part")
    table = KeyedTable.satellite(spark, shared_folder(spark), "annotations", buckets=8)
    name = F.format_string("function/%d", "p_partkey").alias("element_qualified")
    table.upsert(part.select(name, F.col("p_name").alias("description"), F.lit(1).alias("updated_at")))
    table.upsert(part.where("p_size > 25").select(name, F.upper("p_name").alias("description"), F.lit(2).alias("updated_at")))
    table.upsert(part.where("p_size > 40").select(name, F.lit("too late").alias("description"), F.lit(0).alias("updated_at")))
    table.delete_where(F.col("description").startswith("s"))
    return table.read().select("element_qualified", "description", "updated_at")


_raw(
    "m1_annotations_stored",
    _annotated,
    """SELECT 'function/' || p_partkey AS element_qualified, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS description, CAST(CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS BIGINT) AS updated_at
FROM part WHERE NOT starts_with(CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END, 's')""",
)

# I4: vector search


def _hundredth(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_raw("i4_exact_in_blocks", lambda s, d: ann.exact_nearest(load(s, d, "embeddings"), _hundredth(s, d)).select("query_id", "vec_id", "rank"), ORACLES["i4_k_nearest_of_set"])


def _indexed(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    index = ann.build_index(vectors, shared_folder(spark))
    return ann.approximate_nearest(index, vectors, _hundredth(spark, d), k)


_raw("i4_approximate", _indexed)
_raw(
    "i4_recall",
    lambda s, d: V.recall(_indexed(s, d), ann.exact_nearest(load(s, d, "embeddings"), _hundredth(s, d)), 10).select(F.lit(10).alias("k"), (F.col("recall") >= 0.9).alias("reached")),
    "SELECT 10 AS k, true AS reached",
)

# Part k and part 2 k are linked, so a component is what one odd number leads to
_raw(
    "g15_components",
    lambda s, d: graphs.connected_components(load(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_qualified"), F.expr("p_partkey div 2").alias("target_qualified"), F.lit("half").alias("rel_type"), F.lit(1.0).alias("confidence"))),
    """WITH e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0), n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
r AS (SELECT node, node // (CAST(node AS BIGINT) & -CAST(node AS BIGINT)) AS odd FROM n) SELECT node, min(node) OVER (PARTITION BY odd) AS component FROM r""",
)

# Regions are workflows of nations (steps) that customers (functions) carry out; suppliers are playbooks that name files


def _below(spark: SparkSession, d: str) -> DataFrame:
    element = lambda rows, q, kind, path, meta: rows.select(q.alias("qualified_name"), F.lit(kind).alias("element_type"), q.alias("name"), path.alias("file_path"), meta.alias("metadata"))
    region, nation, customer, supplier = (load(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    r, n, n_r = (F.format_string(f"{t}/%d", c) for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("region", "n_regionkey")))
    c, c_n, s = (F.format_string(f"{t}/%d", k) for t, k in (("customer", "c_custkey"), ("nation", "c_nationkey"), ("supplier", "s_suppkey")))
    none, brackets = F.lit(""), F.lit("{}")
    ref = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("src/%d", "s_suppkey")).otherwise(F.format_string("src/%d/a.py::CUSTOMER/%d", "s_suppkey", F.col("s_suppkey") + 100))
    E = element(region, r, "workflow", none, brackets).unionByName(element(nation, n, "workflow_step", none, brackets)).unionByName(element(customer, c, "function", F.format_string("src/%d/a.py", F.col("c_custkey") % 100), brackets))
    E = E.unionByName(element(supplier, s, "playbook", none, F.to_json(F.struct(F.array(ref).alias("code_refs")))))
    edge = lambda rows, a, b, kind: rows.select(a.alias("source_qualified"), b.alias("target_qualified"), F.lit(kind).alias("rel_type"), F.lit(1.0).alias("confidence"))
    R = edge(nation, n_r, n, "has_step").unionByName(edge(customer, c, c_n, "implemented_by")).unionByName(edge(customer, c_n, c, "calls"))
    seeds = E.where("element_type IN ('workflow', 'playbook')").select(F.col("qualified_name").alias("seed"), "element_type")
    return graphs.functions_below(E, R, seeds, 1000).select("qualified_name", "hop", "seed", "via_edge")


_raw(
    "g5_functions_below",
    _below,
    """WITH f AS (SELECT 'customer/' || c_custkey AS q, 'region/' || n_regionkey AS seed, 2 AS hop, 'implemented_by' AS via, 15 AS fan FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'customer/' || c_custkey, 'supplier/' || s_suppkey, 1, 'code_ref', 8 FROM supplier JOIN customer ON c_custkey % 100 = s_suppkey AND (s_suppkey % 2 = 0 OR c_custkey = s_suppkey + 100)),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, q) AS place FROM f),
b AS (SELECT q, hop, seed, via, row_number() OVER (PARTITION BY q ORDER BY hop, seed) AS first FROM k WHERE place <= fan)
SELECT q AS qualified_name, hop, seed, via AS via_edge FROM b WHERE first = 1 ORDER BY hop, seed, q LIMIT 1000""",
)

# daily sketches merged by kind of event, beside the exact figures


def _sketched(spark: SparkSession, d: str) -> DataFrame:
    events = graphs.days_of(load(spark, d, "events"), "ts")
    merged = graphs.estimates(graphs.merge_sketches(graphs.sketches(events, ["day", "event_type"], "user_id", "value"), ["event_type"]), [0.5, 0.9])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("d"))
    below = events.join(merged.select("event_type", "q50", "q90"), "event_type").groupBy("event_type").agg(*(F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"share_{q}") for q in ("q50", "q90")))
    near = lambda a, b, e: (F.abs(a - b) <= e)
    both = merged.join(exact, "event_type").join(below, "event_type")
    return both.select("event_type", "n", near(F.col("n_distinct"), F.col("d"), 0.03 * F.col("d") + 1).alias("distinct_near"), near(F.col("share_q50"), F.lit(0.5), 0.02).alias("median_near"), near(F.col("share_q90"), F.lit(0.9), 0.02).alias("q90_near"))


_raw("f19_sketches", _sketched, "SELECT event_type, count(*) AS n, true AS distinct_near, true AS median_near, true AS q90_near FROM events GROUP BY 1")

# J: symbols for repeated identifiers of the documents, and the texts back


def _short(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.restored(symbols.with_symbols(load(spark, d, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.size("symbols").alias("n_symbols"), (F.col("full_text") == F.coalesce("text", F.lit(""))).alias("restored"))


_raw(
    "j_symbol_map",
    _short,
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}_]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, ceil(length(w) / 4) AS t FROM w WHERE length(w) >= 6 AND regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') GROUP BY 1, 2),
k AS (SELECT doc_id, count(*) AS n FROM c WHERE n * (t - 1) > t + 3 GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS INT) AS n_symbols, true AS restored FROM documents d LEFT JOIN k USING (doc_id)""".replace("\\\\", "\\"),
)
_raw("j_dense_lines", lambda s, d: symbols.with_dense_text(load(s, d, "documents")).select("doc_id", F.length("dense_text").alias("n_chars"), F.round("compressed_share", 4).alias("compressed_share")))

# Every document as a page of its source, with headings around its own text; B16: every message, some with a decision


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    head = F.format_string("# Doc %d\n", k)
    tail = F.format_string("\n## Notes\n```\n# no heading\n```\nSee `src/a%d.py` and `src/b.rs::run`.\n### Needs ##\n| FR-DOC-%d | P%d | with `src/c%d.go` |\nUS-DOC-TWO, FR-DOC-%d\n## End", k % 7, k % 5, k % 4, k % 3, k % 5)
    return load(spark, d, "documents").select(F.format_string("docs/%s/%d.md", "source", k).alias("path"), F.concat(head, F.regexp_replace(F.coalesce("text", F.lit("")), "[#`|~]", "."), tail).alias("text"))


_PAGES = """WITH d AS (SELECT doc_id AS k, 'docs/' || source || '/' || doc_id || '.md' AS p, doc_id || '.md' AS name,
    CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT) AS n FROM documents),
s AS (SELECT *, p || '::Doc ' || k || '#L1' AS top, p || '::Notes#L' || (n + 3) AS notes FROM d)
"""
_raw(
    "b13_document_nodes",
    lambda s, d: documents.document_graph(pages_of(s, d))[0],
    _PAGES + """SELECT p AS qualified_name, 'document' AS element_type, name, p AS file_path, 1 AS line_start, n + 11 AS line_end, NULL AS parent_qualified FROM s
UNION ALL SELECT top, 'doc_section', 'Doc ' || k, p, 1, n + 11, p FROM s
UNION ALL SELECT notes, 'doc_section', 'Notes', p, n + 3, n + 10, top FROM s
UNION ALL SELECT p || '::Needs#L' || (n + 8), 'doc_section', 'Needs', p, n + 8, n + 10, notes FROM s
UNION ALL SELECT p || '::End#L' || (n + 11), 'doc_section', 'End', p, n + 11, n + 11, top FROM s""",
)
_raw(
    "b13_document_edges",
    lambda s, d: documents.document_graph(pages_of(s, d))[1].groupBy("rel_type").agg(F.count("*").alias("n"), F.count_distinct("source_qualified").alias("sources"), F.count_distinct("target_qualified").alias("targets")),
    _PAGES + """, e AS (SELECT p AS a, top AS b, 'contains' AS t FROM s UNION ALL SELECT top, notes, 'contains' FROM s UNION ALL SELECT notes, p || '::Needs#L' || (n + 8), 'contains' FROM s
UNION ALL SELECT top, p || '::End#L' || (n + 11), 'contains' FROM s UNION ALL SELECT p, unnest(['src/a' || (k % 7) || '.py', 'src/b.rs::run', 'src/c' || (k % 3) || '.go']), 'references' FROM s
UNION ALL SELECT unnest(['src/a' || (k % 7) || '.py', 'src/b.rs::run', 'src/c' || (k % 3) || '.go']), p, 'documented_by' FROM s)
SELECT t AS rel_type, count(*) AS n, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM e GROUP BY 1""",
)
_raw(
    "b14_requirement_nodes",
    lambda s, d: documents.requirement_graph(pages_of(s, d))[0],
    _PAGES + """SELECT p || '::FR-DOC-' || (k % 5) AS qualified_name, 'requirement' AS element_type, 'FR-DOC-' || (k % 5) AS name, p AS file_path, n + 9 AS line_start, 'P' || (k % 4) AS priority FROM s
UNION ALL SELECT p || '::US-DOC-TWO', 'user_story', 'US-DOC-TWO', p, n + 10, '' FROM s""",
)
_raw(
    "b14_requirement_edges",
    lambda s, d: documents.requirement_graph(pages_of(s, d))[1],
    _PAGES + """SELECT p AS source_qualified, p || '::FR-DOC-' || (k % 5) AS target_qualified, 'contains' AS rel_type FROM s UNION ALL SELECT p, p || '::US-DOC-TWO', 'contains' FROM s
UNION ALL SELECT p || '::FR-DOC-' || (k % 5), 'src/c' || (k % 3) || '.go', 'implemented_by' FROM s""",
)


def messages(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.format_string(" We decided on src/m%d.py and lib/x.rs.", F.col("conv_id") % 9)).otherwise(F.lit(""))
    return load(spark, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), said))


_raw(
    "b16_decisions",
    lambda s, d: documents.conversation_graph(messages(s, d))[1],
    """SELECT 'conversations/' || conv_id || '::decision/' || turn AS source_qualified, unnest(['src/m' || (conv_id % 9) || '.py', 'lib/x.rs']) AS target_qualified, 'decided_about' AS rel_type FROM conversations WHERE turn % 3 = 0""",
)
_raw(
    "b16_nodes",
    lambda s, d: documents.conversation_graph(messages(s, d))[0].select("qualified_name", "element_type", "file_path", "participant", "verbatim"),
    """SELECT 'conversations/' || conv_id || '::decision/' || turn AS qualified_name, 'decision' AS element_type, 'conversations/' || conv_id AS file_path, role AS participant,
    coalesce(text, '') || ' We decided on src/m' || (conv_id % 9) || '.py and lib/x.rs.' AS verbatim FROM conversations WHERE turn % 3 = 0""",
)

# Graphs more than one level deep: part k calls parts k / 2 and k / 3; suppliers' services call one another


def _calls(spark: SparkSession, d: str) -> DataFrame:
    k = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(F.lit(2), F.lit(3))).alias("by")).where("k > 0")
    return k.select(F.format_string("function/%d", "k").alias("source_qualified"), F.format_string("function/%d", F.floor(F.col("k") / F.col("by"))).alias("target_qualified"), F.lit("calls").alias("rel_type"), F.lit(1.0).alias("confidence"), F.lit("local").alias("env")).distinct()


_CALLS = """WITH RECURSIVE e AS (SELECT DISTINCT 'function/' || p_partkey AS a, 'function/' || (p_partkey // q) AS b FROM part, (SELECT unnest([2, 3]) AS q) WHERE p_partkey > 0),
"""
_raw(
    "g2_calls_in_depth",
    lambda s, d: G.call_graph(_calls(s, d), "function/199", 4),
    _CALLS + """r AS (SELECT 'function/199' AS n, 0 AS l UNION SELECT b, l + 1 FROM r JOIN e ON a = n WHERE l < 4), m AS (SELECT n, min(l) AS l FROM r GROUP BY 1)
SELECT a AS source_qualified, b AS target_qualified, CAST(l + 1 AS INT) AS depth FROM e JOIN m ON a = n WHERE l < 4""",
)
_raw(
    "g8_subgraph_in_depth",
    lambda s, d: G.subgraph(_calls(s, d), "function/30", 3).select("source_qualified", "target_qualified"),
    _CALLS + """w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 'function/30' AS n, 0 AS l UNION SELECT b, l + 1 FROM r JOIN w ON a = n WHERE l < 3)
SELECT a AS source_qualified, b AS target_qualified FROM e WHERE a IN (SELECT n FROM r) AND b IN (SELECT n FROM r)""",
)


def _services(spark: SparkSession, d: str) -> DataFrame:
    supplier = load(spark, d, "supplier")
    R = supplier.select(F.format_string("service/%d", "s_nationkey").alias("source_qualified"), F.format_string("service/%d", F.col("s_suppkey") % 25).alias("target_qualified"), F.lit("service_calls").alias("rel_type"))
    services = load(spark, d, "nation").select(F.format_string("service/%d", "n_nationkey").alias("qualified_name"))
    incidents = supplier.where("s_acctbal < 0").select(F.format_string("service/%d", "s_nationkey").alias("qualified_name"))
    return J.service_context(services, R, incidents).select("qualified_name", "calls_out", "calls_in", "incidents")


_raw(
    "e20_calls_both_ways",
    _services,
    """SELECT 'service/' || n_nationkey AS qualified_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS calls_out, (SELECT count(*) FROM supplier WHERE s_suppkey % 25 = n_nationkey) AS calls_in,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS incidents FROM nation""",
)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    part, supplier = load(spark, d, "part"), load(spark, d, "supplier")
    knowledge = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("content"))
    notes = part.select(F.format_string("function/%d", "p_partkey").alias("element_qualified"), F.col("p_name").alias("description"))
    incidents = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("ring broken").alias("root_cause"), F.lit(None).cast("string").alias("resolution"))
    return K.search_notes(knowledge, notes, incidents, "Ring", 30)


_raw(
    "d16_all_notes",
    _notes,
    """SELECT * FROM (SELECT 'knowledge' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS title FROM part WHERE contains(lower(p_name || chr(10) || p_type), 'ring') ORDER BY id, title LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'annotation', 'function/' || p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') ORDER BY id, title LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'incident', CAST(s_suppkey AS VARCHAR) AS id, s_name AS title FROM supplier ORDER BY id, title LIMIT 30)""",
)
_raw(
    "c7_toon_quoted",
    lambda s, d: W.toon(load(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat_ws(", ", "p_name", "p_brand")).otherwise(F.concat("p_name", F.lit('"'))).alias("label")), "part"),
    """SELECT 'part{p_partkey,label}:' AS value UNION ALL
SELECT p_partkey || ',' || CASE WHEN p_size > 25 THEN '"' || p_name || ', ' || p_brand || '"' ELSE '"' || p_name || '\\"' || '"' END FROM part""",
)


def _tickets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(
        "o_orderkey", F.when(k % 11 == 0, " ").otherwise("cause").alias("root_cause"), F.when(k % 7 != 0, "done").alias("resolution"), F.when(k % 5 == 0, F.lit("12")).when(k % 5 == 1, F.lit("#12")).when(k % 5 == 2, F.lit("T-1")).when(k % 5 == 3, F.lit("")).alias("linked_ticket"),
        F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, F.lit(5)).cast("long").alias("resolved_at"),
    )
    return rows.select("o_orderkey", W.incident_texts_problem().alias("problem"))


_raw(
    "m4_incident_texts",
    _tickets,
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'root_cause' WHEN o_orderkey % 7 = 0 THEN 'resolution' WHEN o_orderkey % 5 IN (0, 3) THEN 'linked_ticket' WHEN o_orderkey % 3 = 0 THEN 'resolved_at' END AS problem FROM orders",
)


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """I8: parts are embedded where their state is missing, stale or of another text; then all states are fresh but those of parts that are gone."""
    part = load(spark, d, "part").select(F.format_string("function/%d", "p_partkey").alias("qualified_name"), F.concat_ws(" ", "p_name", "p_type").alias("blob"), F.col("p_size").alias("size")).withColumn("content_hash", F.sha2("blob", 256))
    states = KeyedTable.satellite(spark, shared_folder(spark), "embedding_state", buckets=8)
    old = F.when(F.col("size") % 3 == 0, "other").otherwise(F.col("content_hash"))
    states.upsert(part.where("size % 5 > 0").select("qualified_name", old.alias("content_hash"), F.when(F.col("size") % 4 == 0, "stale").otherwise("fresh").alias("state"), F.lit(1).alias("updated_at")))
    done = V.refresh(part.select("qualified_name", "content_hash", "blob"), states.read())
    states.upsert(done.select("qualified_name", "content_hash", "state", F.lit(2).alias("updated_at")))
    states.delete(states.read().join(part.where("size <> 1"), "qualified_name", "left_anti"))
    return states.read().groupBy("state", "updated_at").agg(F.count("*").alias("n"))


_raw(
    "i8_embedding_states",
    _embedded,
    "SELECT 'fresh' AS state, CAST(CASE WHEN p_size % 5 = 0 OR p_size % 4 = 0 OR p_size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS updated_at, count(*) AS n FROM part WHERE p_size <> 1 GROUP BY ALL",
)


# A repository for each nation, whose customers are changed files; J: outlines of the code files


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.format_string("?? new%d.py", k)).when(k % 7 == 1, F.format_string("M  a%d.py", k)).when(k % 7 == 2, F.format_string(" D b%d.py", k)).when(k % 7 == 3, F.format_string("R  old%d.py -> c%d.py", k, k)).when(k % 7 == 4, F.format_string("MM d%d.py", k)).when(k % 7 == 5, F.format_string('A  "e \\"%d\\".py"', k)).otherwise(F.format_string("!! f%d.py", k))
    rows = load(spark, d, "customer").select(F.format_string("repo%d", "c_nationkey").alias("folder"), line.alias("line"))
    return changes.status_changes(rows.groupBy("folder").agg(F.array_join(F.collect_list("line"), "\n").alias("status")))


_STATUS = """WITH c AS (SELECT c_custkey AS k, 'repo' || c_nationkey || '/' AS p FROM customer),
s AS (SELECT p || 'new' || k || '.py' AS path, NULL AS old_path, 'untracked' AS stage, 'added' AS change FROM c WHERE k % 7 = 0 UNION ALL SELECT p || 'a' || k || '.py', NULL, 'staged', 'modified' FROM c WHERE k % 7 = 1
UNION ALL SELECT p || 'b' || k || '.py', NULL, 'unstaged', 'deleted' FROM c WHERE k % 7 = 2 UNION ALL SELECT p || 'c' || k || '.py', p || 'old' || k || '.py', 'staged', 'renamed' FROM c WHERE k % 7 = 3
UNION ALL SELECT p || 'd' || k || '.py', NULL, unnest(['staged', 'unstaged']), 'modified' FROM c WHERE k % 7 = 4 UNION ALL SELECT p || 'e "' || k || '".py', NULL, 'staged', 'added' FROM c WHERE k % 7 = 5)
"""
_raw("n6_status_changes", _statuses, _STATUS + "SELECT * FROM s")
_raw(
    "n6_files_to_index",
    lambda s, d: changes.files_to_index(_statuses(s, d)),
    _STATUS + "SELECT path, CASE WHEN max(CASE change WHEN 'deleted' THEN 1 ELSE 0 END) = 1 THEN 'remove' ELSE 'index' END AS action FROM s GROUP BY 1 UNION ALL SELECT old_path, 'remove' FROM s WHERE old_path IS NOT NULL",
)
_raw(
    "j_signatures",
    lambda s, d: scopes.signatures(code_files(s, d)).select("path", F.explode(F.split("outline", "\n")).alias("line")),
    _CODE + """SELECT path, (2 + 8 * r) || ': ' || CASE l WHEN 3 THEN '  func (b *Box) make_' || k || '(n int) int' WHEN 2 THEN '  public int make_' || k || '(int n) throws Exception' WHEN 1 THEN '  make_' || k || '(n)' ELSE '  def make_' || k || '(self, n)' END AS line FROM b
UNION ALL SELECT path, (5 + 8 * r) || ':     ' || CASE l WHEN 1 THEN 'function' ELSE 'def' END || ' inner_' || k || '(x)' FROM b WHERE nest IS NOT NULL
UNION ALL SELECT DISTINCT path, '1: ' || ['class Box', 'class Box', 'public class Box', 'type Box struct { n int }'][l + 1] FROM b""",
)
_raw(
    "b12_rationale_nodes",
    lambda s, d: scopes.rationale_graph(scopes.scan(code_files(s, d)))[0],
    _CODE + "SELECT path || '::note#L' || (3 + 8 * r) AS qualified_name, 'rationale' AS element_type, 'NOTE' AS name, path AS file_path, CAST(3 + 8 * r AS INT) AS line_start, 'gone_' || k || '(1) {' AS detail FROM b",
)
_raw("b12_explained_by", lambda s, d: scopes.rationale_graph(scopes.scan(code_files(s, d)))[1], _CODE + "SELECT make AS source_qualified, path || '::note#L' || (3 + 8 * r) AS target_qualified, 'explained_by' AS rel_type FROM b")

# Parts as tables, customers as routes and callers, suppliers as services


def ddl_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 20").alias("g"))
    line = F.format_string("CREATE TABLE IF NOT EXISTS t%d (\n  id int PRIMARY KEY,\n  up int REFERENCES t%d(id),\n  FOREIGN KEY (id) REFERENCES gone(id)\n);\n", "k", F.col("g") * 20)
    return _texts(rows, F.format_string("db%d/schema.sql", "g"), F.lit("-- tables\n"), line, F.lit(""), "k")


_raw(
    "b6_table_edges",
    lambda s, d: services.table_edges(ddl_files(s, d)),
    """WITH t AS (SELECT p_partkey AS k, 'db' || (p_partkey // 20) || '/schema.sql' AS p, p_partkey // 20 * 20 AS f FROM part)
SELECT p AS source_qualified, p || '::t' || k AS target_qualified, 'contains' AS rel_type FROM t UNION ALL SELECT p || '::t' || k, p || '::t' || k || '::' || unnest(['id', 'up']), 'defines' FROM t
UNION ALL SELECT p || '::t' || k, p || '::t' || f, 'references' FROM t""",
)


def route_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.format_string("app.get('/c/%d', f)\nrouter.delete(\"/d/%d\", g)\nfetch(`https://h.x/c/%d?a=1#b`)\naxios.delete('/d/%d'); client.post('/c/%d')\n", k, F.col("c_nationkey"), k + 1, F.col("c_nationkey"), k)
    return load(spark, d, "customer").select(F.format_string("web/r%d.js", k).alias("path"), text.alias("text"))


_ROUTES = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'web/r' || c_custkey || '.js' AS p FROM customer)\n"
_raw(
    "b8_route_nodes",
    lambda s, d: services.route_graph(route_files(s, d))[0],
    _ROUTES + "SELECT 'route::' || name AS qualified_name, 'route' AS element_type, name, p AS file_path FROM (SELECT p, unnest(['GET /c/' || k, 'DELETE /d/' || n]) AS name FROM c)",
)
_raw(
    "b8_route_edges",
    lambda s, d: services.route_graph(route_files(s, d))[1],
    _ROUTES + """SELECT p AS source_qualified, 'route::' || unnest(['GET /c/' || k, 'DELETE /d/' || n]) AS target_qualified, 'defines_route' AS rel_type FROM c
UNION ALL SELECT p, 'route::GET /c/' || (k + 1), 'http_calls' FROM c WHERE k + 1 IN (SELECT k FROM c) UNION ALL SELECT p, 'route::DELETE /d/' || n, 'http_calls' FROM c""",
)


def service_files(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    config = F.format_string("server:\n  be_svc_%d_address: \"http://h:1\"\n  deep:\n  - be_pay_address: h:%d\n  other_address: x\n", n, k)
    code = F.format_string("conn := grpc.NewClient(\"dns:///Svc-%d:80\") // dns://own-%d\n", n, k)
    rows = load(spark, d, "supplier")
    return rows.select(F.format_string("own-%d/config.yaml", k).alias("path"), config.alias("text")).unionByName(rows.select(F.format_string("own-%d/main.go", k).alias("path"), code.alias("text")))


_raw(
    "b9_service_calls",
    lambda s, d: services.service_calls(service_files(s, d)),
    """SELECT 'own-' || s_suppkey AS source_qualified, unnest(['svc-' || s_nationkey, 'pay', 'svc-' || s_nationkey]) AS target_qualified, 'service_calls' AS rel_type, unnest(['http', 'grpc', 'grpc']) AS protocol FROM supplier""",
)

# Packs and pages


def _pack(spark: SparkSession, d: str) -> DataFrame:
    """A pack of a folder of any size, and the hash of its lines in another order."""
    lines, once = pack.context_pack(elements(spark, d), edges(spark, d), "nation/3", None, "r1")
    again = lines.repartition(7).agg(pack.content_hash(lines).alias("other"))
    return once.join(again, F.col("content_hash") == F.col("other"), "left").select("schema_version", "elements", "relationships", "source_revision", "path_scope", F.col("other").isNotNull().alias("same_hash"))


_raw(
    "c5_context_pack",
    _pack,
    CTE + """, i AS (SELECT * FROM elements WHERE file_path = 'nation/3' OR starts_with(file_path, 'nation/3/'))
SELECT 1 AS schema_version, (SELECT count(*) FROM i) AS elements, (SELECT count(*) FROM edges WHERE source_qualified IN (SELECT qualified_name FROM i) AND target_qualified IN (SELECT qualified_name FROM i)) AS relationships, 'r1' AS source_revision, 'nation/3' AS path_scope, true AS same_hash""",
)
_PAGE = CTE + """, p AS (SELECT qualified_name FROM elements WHERE (file_path = 'nation/3' OR starts_with(file_path, 'nation/3/')) AND element_type IN ('class', 'service') ORDER BY 1 LIMIT 20 OFFSET 10)
"""
_raw("n7_page", lambda s, d: pack.graph_page(elements(s, d), edges(s, d), "nation/3", 20, 10, ["class", "service"])[0].select("qualified_name"), _PAGE + "SELECT * FROM p")
_raw(
    "n7_page_edges",
    lambda s, d: pack.graph_page(elements(s, d), edges(s, d), "nation/3", 20, 10, ["class", "service"])[1].select("source_qualified", "target_qualified", "rel_type", "source_on_page", "target_on_page"),
    _PAGE + """SELECT source_qualified, target_qualified, rel_type, source_qualified IN (SELECT * FROM p) AS source_on_page, target_qualified IN (SELECT * FROM p) AS target_on_page
FROM edges WHERE source_qualified IN (SELECT * FROM p) OR target_qualified IN (SELECT * FROM p)""",
)

# Two nations of one region meet in their region
_raw(
    "g7_path_between",
    lambda s, d: Q.question_subgraph(elements(s, d), edges(s, d), "What leads from NATION_1 to NATION_6?").where("on_path").select("source_qualified", "target_qualified", "rel_type"),
    "SELECT 'module/' || n_regionkey AS source_qualified, 'directory/' || n_nationkey AS target_qualified, 'contains' AS rel_type FROM nation WHERE n_name IN ('NATION_1', 'NATION_6')",
)
