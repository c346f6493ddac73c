"""Context packs and pages of the graph (rows C5, N7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traversal import _nodes, _step

SCHEMA_VERSION, KIND = 1, "graph.context.pack"


def _under(path: Column, folder: str | None) -> Column:
    return F.lit(True) if not folder else (path == folder) | path.startswith(f"{folder}/")


def content_hash(lines: DataFrame) -> Column:
    """A hash of lines (value) in any order, repeats counted: the digests' bitwise sums and their number, hashed."""
    digest = F.sha2("value", 256)
    parts = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")) for k in range(4)]
    total = F.sum(F.conv(F.substring(digest, 50, 15), 16, 10).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws(",", *parts, total, F.count("*")), 256)


def context_pack(E: DataFrame, R: DataFrame, folder: str | None = None, most: int | None = 5000, revision: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of a snapshot (its elements and the edges between them, as JSON) and a manifest of one row; too many elements are an error, nothing is cut off.

    The same rows give the same hash, whatever their order; None sets no bound. The names inside are written first, so that
    few of them are broadcast and only edges of the snapshot travel. Write the lines with write.text.
    """
    inside = E.where(_under(F.col("file_path"), folder))
    if most is not None and inside.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} elements")
    key = _nodes(_step(inside.select(F.col("qualified_name").alias("node")).distinct()))
    edges = R.join(key.withColumnRenamed("node", "source_qualified"), "source_qualified", "left_semi").join(key.withColumnRenamed("node", "target_qualified"), "target_qualified", "left_semi")
    line = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), *sorted(rows.columns))).alias("value"))
    lines = line(inside, "element").unionByName(line(edges, "relationship"))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, 1)), F.lit(0))
    manifest = lines.agg(count("element").alias("elements"), count("relationship").alias("relationships"), content_hash(lines).alias("content_hash"))
    return lines, manifest.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(KIND).alias("kind"), "elements", "relationships", "content_hash", F.lit(revision).cast("string").alias("source_revision"), F.lit(folder).cast("string").alias("path_scope"))


def graph_page(E: DataFrame, R: DataFrame, folder: str, limit: int = 200, offset: int = 0, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of the elements below a folder, in order of their names, and the edges that touch it, each with whether its other end lies on the page."""
    chosen = E.where(_under(F.col("file_path"), folder) & (F.col("element_type").isin(types) if types else F.lit(True)))
    page = chosen.orderBy("qualified_name").offset(offset).limit(limit)
    key = page.select("qualified_name").distinct()
    source = key.select(F.col("qualified_name").alias("source_qualified"), F.lit(True).alias("source_on_page"))
    target = key.select(F.col("qualified_name").alias("target_qualified"), F.lit(True).alias("target_on_page"))
    both = R.join(source, "source_qualified", "left").join(target, "target_qualified", "left").where("source_on_page OR target_on_page")
    return page, both.fillna(False, ["source_on_page", "target_on_page"])
