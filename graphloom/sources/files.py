"""File trees, chat exports and ontologies as DataFrames (rows B1, B2, B15, B17)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are skipped (bytes); directories that are never walked (fixed values).
SIZE_CAP = 2 << 20
IGNORED = [".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "vendor"]


def parse_uri(uri: str) -> tuple[str, str]:
    """B1: (kind, place)."""
    if uri.startswith("gs://"):
        return "gcs", uri
    if uri.endswith(".git") or re.match(r"(git@|ssh://|git://)", uri):
        return "git", uri
    return "local", uri.removeprefix("file://")


def walk(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """B2: path (below the root), text, bytes of every file that is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*" + re.escape(root.strip("/")) + "/", "")
    out = raw.where(F.col("length") <= SIZE_CAP).select(rel.alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"))
    for d in IGNORED:
        out = out.where(~(F.col("path").startswith(d + "/") | F.col("path").contains(f"/{d}/")))
    return out.where(F.lower(F.substring_index("path", ".", -1)).isin(extensions)) if extensions else out


def slack_messages(spark: SparkSession, path: str) -> DataFrame:
    """B15."""
    raw = spark.read.option("multiLine", "true").json(path)
    return raw.select(F.col("channel.name").alias("conversation"), F.explode("messages").alias("m")).select("conversation", F.col("m.user").alias("author"), F.col("m.ts").cast("double").cast("long").alias("at"), F.col("m.text").alias("text"))


def claude_messages(spark: SparkSession, path: str) -> DataFrame:
    """Content is a text or a list of parts."""
    schema = "conversations array<struct<id:string,title:string,created_at:string,messages:array<struct<id:string,role:string,text:string,content:string>>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    m = raw.select(F.explode("conversations").alias("c")).select(F.col("c.title").alias("conversation"), F.to_timestamp("c.created_at").cast("long").alias("at"), F.explode("c.messages").alias("m"))
    parts = F.array_join(F.transform(F.from_json("m.content", "array<struct<type:string,text:string>>"), lambda x: x["text"]), "\n")
    return m.select("conversation", F.col("m.role").alias("author"), "at", F.coalesce("m.text", parts, "m.content").alias("text"))


def chatgpt_messages(spark: SparkSession, path: str) -> DataFrame:
    """B15."""
    schema = "mapping map<string,struct<title:string,mapping:map<string,struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    c = raw.select(F.explode(F.map_values("mapping")).alias("c")).select(F.col("c.title").alias("conversation"), F.explode(F.map_values("c.mapping")).alias("n"))
    return c.where("n.message is not null").select("conversation", F.col("n.message.author.role").alias("author"), F.col("n.message.create_time").cast("long").alias("at"), F.array_join("n.message.content.parts", "\n").alias("text"))


def ontology(spark: SparkSession, concepts: list[dict], workflows: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Elements and edges of concepts and workflows, given as parsed documents."""
    e, r = [], []
    for c in concepts:
        gid = f"ontology://concept/{c['id']}"
        e.append((gid, "concept", c["name"], c.get("description", "")))
        r += [(gid, x, "implemented_by") for x in c.get("code_refs", [])] + [(gid, x, "documented_by") for x in c.get("docs", [])]
    for w in workflows:
        gid = f"ontology://workflow/{w['id']}"
        e.append((gid, "workflow", w["name"], w.get("description", "")))
        before = None
        for s in w.get("steps", []):
            step = f"{gid}/{s['id']}"
            e.append((step, "workflow_step", s["name"], ""))
            r.append((gid, step, "has_step"))
            r += [(before, step, "next_step")] if before else []
            r += [(step, x, "implemented_by") for x in s.get("code_refs", [])]
            for f in s.get("failure_modes", []):
                e.append((f"{step}/{f}", "failure_mode", f, ""))
                r.append((step, f"{step}/{f}", "can_fail_with"))
            before = step
    return (
        spark.createDataFrame(e, "qualified_name string, element_type string, name string, description string"),
        spark.createDataFrame(r, "source_qualified string, target_qualified string, rel_type string"),
    )
