"""Edges between services, routes and tables (rows B6, B8, B9).

Built-in expressions over whole files (path, text), and ``yaml_rows`` for
configuration. Defined results: a null text is empty; what a file says twice
gives one row; service names are in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structured import yaml_rows
from .text import ddl_elements

_QUOTED = r"\s*\(\s*['\"`]([^'\"`]+)['\"`]"


def _every(files: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """path and the named groups of each match."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))))
    return files.select("path", found.alias("hit")).select("path", *(F.regexp_extract("hit", pattern, k + 1).alias(g) for k, g in enumerate(groups)))


def route_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes as nodes, defines_route edges from the files that state them, and http_calls edges from files to the routes that they call by method and path."""
    stated = _every(files, r"(?i)\b(?:app|router|api|r|mux|e)\.(get|post|put|patch|delete)" + _QUOTED, "method", "route").withColumn("method", F.upper("method"))
    called = _every(files, r"(?i)\b(?:axios|http|client|requests)\.(get|post|put|patch|delete)" + _QUOTED, "method", "url").withColumn("method", F.upper("method"))
    fetched = _every(files, r"\bfetch" + _QUOTED, "url").select("path", F.lit("GET").alias("method"), "url")
    name = F.concat_ws(" ", "method", "route")
    nodes = stated.select(F.concat(F.lit("route::"), name).alias("qualified_name"), F.lit("route").alias("element_type"), name.alias("name"), F.col("path").alias("file_path")).distinct()
    defines = nodes.select(F.col("file_path").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), F.lit("defines_route").alias("rel_type"))
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    calls = called.unionByName(fetched).select("path", F.concat(F.lit("route::"), F.concat_ws(" ", "method", bare)).alias("target_qualified"))
    known = calls.join(nodes.select(F.col("qualified_name").alias("target_qualified")).distinct(), "target_qualified", "left_semi")
    return nodes, defines.unionByName(known.select(F.col("path").alias("source_qualified"), "target_qualified", F.lit("http_calls").alias("rel_type")).distinct())


def service_calls(files: DataFrame) -> DataFrame:
    """service_calls edges by gRPC addresses of any file, and by keys be_<service>_address of YAML files at any depth; a file's service is the folder that it lies in."""
    service = F.lower(F.element_at(F.split(F.concat(F.lit("./"), "path"), "/"), -2))
    grpc = _every(files, r"dns:///?([A-Za-z0-9_-]+)", "to").select("path", F.col("to"), F.lit("grpc").alias("protocol"))
    keys = yaml_rows(files.where(F.col("path").rlike(r"\.ya?ml$"))).select("path", F.regexp_extract(F.element_at("keys", -1), r"^be_(\w+)_address$", 1).alias("to"), "value").where("to <> ''")
    protocol = F.when(F.col("value").rlike("^https?://"), "http").otherwise("grpc")
    configured = keys.select("path", F.replace("to", F.lit("_"), F.lit("-")).alias("to"), protocol.alias("protocol"))
    both = grpc.unionByName(configured).select(service.alias("source_qualified"), F.lower("to").alias("target_qualified"), F.lit("service_calls").alias("rel_type"), "protocol").distinct()
    return both.where("source_qualified <> target_qualified")


def table_edges(files: DataFrame) -> DataFrame:
    """Contains edges of files and tables, defines edges of tables and columns, references edges of foreign keys between tables of the files of a folder."""
    elements = ddl_elements(files.withColumn("text", F.coalesce("text", F.lit(""))))
    contains = elements.where("element_type = 'table'").select(F.col("parent").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), F.lit("contains").alias("rel_type"))
    defines = elements.where("element_type = 'column'").select(F.col("parent").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), F.lit("defines").alias("rel_type"))
    create = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\(([^;]*)\)"
    bodies = _every(files, create, "table", "body").withColumn("table", F.replace("table", F.lit('"'), F.lit("")))
    to = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?i)\breferences\s+\"?([\w.]+)"), F.lit(1))))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    keys = bodies.select(folder.alias("folder"), F.concat_ws("::", "path", "table").alias("source_qualified"), to.alias("to"))
    tables = elements.where("element_type = 'table'").select(F.regexp_replace("parent", r"[^/]*$", "").alias("folder"), F.col("name").alias("to"), F.col("qualified_name").alias("target_qualified"))
    references = keys.join(tables, ["folder", "to"]).select("source_qualified", "target_qualified", F.lit("references").alias("rel_type"))
    return contains.unionByName(defines).unionByName(references).distinct()
