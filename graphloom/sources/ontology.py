"""Concepts and workflows from YAML files, and their reload into stored tables (row B17).

``read_ontology`` reads files of concepts and workflows in partitions and makes
elements and edges of their flattened rows by joins and grouping; nothing of
them is parsed on the driver. ``reload`` puts the result into two keyed tables:
what the files no longer say goes, in one commit of each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structured import yaml_rows
from ..operators.store import KeyedTable

ELEMENTS = "qualified_name string, element_type string, name string, env string, description string, aliases array<string>, source_file string, updated_at long"
EDGES = "source_qualified string, target_qualified string, rel_type string, source_file string, updated_at long"


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _field(rows: DataFrame, depth: int, name: str) -> Column:
    return F.max(F.when((F.size("keys") == depth) & (F.element_at("keys", depth) == name), F.col("value"))).alias(name)


def _listed(depth: int, name: str) -> Column:
    """The items of a list in their order."""
    item = (F.size("keys") == depth + 1) & (F.element_at("keys", depth) == name)
    found = F.array_sort(F.collect_list(F.when(item, F.struct(F.element_at("keys", depth + 1).cast("int").alias("place"), "value"))))
    return F.transform(found, lambda x: x["value"]).alias(name)


def _edges(rows: DataFrame, source: str, items: str, rel_type: str, prefix: Column | None = None) -> DataFrame:
    target = F.explode(items)
    found = rows.select(F.col(source).alias("source_qualified"), target.alias("item"), F.col("path").alias("source_file"))
    return found.select("source_qualified", ("item" if prefix is None else F.concat(prefix, F.lit("/"), "item").alias("item")), F.lit(rel_type).alias("rel_type"), "source_file").withColumnRenamed("item", "target_qualified")


def read_ontology(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, text) -> elements (with aliases) and edges of the concepts and workflows they state.

    An entry without id is passed over; one without env is of 'local'; of two entries of one id
    both are given, as of their files.
    """
    rows = yaml_rows(files).where(F.size("keys") >= 3).withColumn("place", F.element_at("keys", 2).cast("int"))
    top = F.element_at("keys", 1)
    concepts = (
        rows.where(top == "concepts").groupBy("path", "place")
        .agg(*(_field(rows, 3, c) for c in ("id", "type_", "name", "env", "description")), *(_listed(3, c) for c in ("aliases", "owned_by", "code_refs", "docs")))
        .where("id IS NOT NULL").withColumn("gid", F.concat(F.lit("ontology://concept/"), "id"))
    )
    own = rows.where(top == "workflows")
    workflows = (
        own.groupBy("path", "place").agg(*(_field(rows, 3, c) for c in ("id", "name", "env", "description")), *(_listed(3, c) for c in ("aliases", "entry_points")))
        .where("id IS NOT NULL").withColumn("gid", F.concat(F.lit("ontology://workflow/"), "id"))
    )
    stepped = own.where((F.size("keys") >= 5) & (F.element_at("keys", 3) == "steps")).withColumn("step", F.element_at("keys", 4).cast("int"))
    steps = (
        stepped.groupBy("path", "place", "step").agg(*(_field(rows, 5, c).alias(f"step_{c}") for c in ("id", "name")), *(_listed(5, c) for c in ("aliases", "code_refs", "failure_modes")))
        .where("step_id IS NOT NULL").join(workflows.select("path", "place", "gid", "env"), ["path", "place"]).withColumn("sid", F.concat_ws("/", "gid", "step_id"))
    )
    env = F.coalesce("env", F.lit("local")).alias("env")
    none = F.lit("").alias("description")
    elements = (
        concepts.select(F.col("gid").alias("qualified_name"), F.coalesce("type_", F.lit("concept")).alias("element_type"), "name", env, F.coalesce("description", F.lit("")).alias("description"), "aliases", F.col("path").alias("source_file"))
        .unionByName(workflows.select(F.col("gid").alias("qualified_name"), F.lit("workflow").alias("element_type"), "name", env, F.coalesce("description", F.lit("")).alias("description"), "aliases", F.col("path").alias("source_file")))
        .unionByName(steps.select(F.col("sid").alias("qualified_name"), F.lit("workflow_step").alias("element_type"), F.col("step_name").alias("name"), env, none, "aliases", F.col("path").alias("source_file")))
        .unionByName(steps.select("sid", F.explode("failure_modes").alias("name"), env, "path").select(F.concat_ws("/", "sid", "name").alias("qualified_name"), F.lit("failure_mode").alias("element_type"), "name", "env", none, F.array().cast("array<string>").alias("aliases"), F.col("path").alias("source_file")))
    )
    after = steps.select("path", "place", (F.col("step") + 1).alias("step"), F.col("sid").alias("before"))
    follows = steps.join(after, ["path", "place", "step"]).select(F.col("before").alias("source_qualified"), F.col("sid").alias("target_qualified"), F.lit("next_step").alias("rel_type"), F.col("path").alias("source_file"))
    edges = (
        _edges(concepts, "gid", "code_refs", "implemented_by").unionByName(_edges(concepts, "gid", "docs", "documented_by")).unionByName(_edges(concepts, "gid", "owned_by", "owned_by"))
        .unionByName(_edges(workflows, "gid", "entry_points", "entry_point_of")).unionByName(_edges(steps, "sid", "code_refs", "implemented_by"))
        .unionByName(_edges(steps, "sid", "failure_modes", "has_failure_mode", F.col("source_qualified"))).unionByName(follows)
        .unionByName(steps.select(F.col("gid").alias("source_qualified"), F.col("sid").alias("target_qualified"), F.lit("has_step").alias("rel_type"), F.col("path").alias("source_file")))
    )
    return elements, edges.distinct()


def reload(files: DataFrame, folder: str, at: int, buckets: int = 16) -> tuple[KeyedTable, KeyedTable]:
    """Make the tables of ``folder`` say what the files say now; ``at`` is the version of this load, larger than those before."""
    spark = files.sparkSession
    out = []
    for name, rows, schema, keys in zip(("elements", "edges"), read_ontology(files), (ELEMENTS, EDGES), (["qualified_name", "source_file"], ["source_qualified", "target_qualified", "rel_type", "source_file"]), strict=True):
        table = KeyedTable(spark, f"{folder.rstrip('/')}/{name}")
        if not table.files.names("manifests"):
            table = KeyedTable.create(spark, table.path, schema, keys, "updated_at", buckets)
        table.replace(rows.withColumn("updated_at", F.lit(at)))
        out.append(table)
    return out[0], out[1]
