"""Keyed scans, text search and paging over elements and edges (rows B18-B22, D1-D8, N10, N11).

Literal matching throughout: needles are never patterns. Every limit has a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer key lists become a broadcast semi-join instead of a literal list.
LIST_LIMIT = 1000


def among(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is in ``values``."""
    if len(values) <= LIST_LIMIT:
        return df.where(F.col(column).isin(list(values)))
    keys = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} string")
    return df.join(keys, column, "left_semi")  # Spark broadcasts them if they are few


def find_element(E: DataFrame, qualified_name: str) -> DataFrame:
    """By key, with and without a leading ./"""
    bare = qualified_name.removeprefix("./")
    return among(E, "qualified_name", [bare, f"./{bare}"])


def elements_by_type(E: DataFrame, *types: str) -> DataFrame:
    return among(E, "element_type", types)


def elements_by_file(E: DataFrame, path: str) -> DataFrame:
    return E.where(F.col("file_path") == path)


def children(E: DataFrame, parent: str, *types: str) -> DataFrame:
    """By parent, of all the given types."""
    out = E.where(F.col("parent_qualified") == parent)
    return among(out, "element_type", types) if types else out


def out_edges(R: DataFrame, *sources: str) -> DataFrame:
    return among(R, "source_qualified", sources)


def in_edges(R: DataFrame, *targets: str) -> DataFrame:
    return among(R, "target_qualified", targets)


def touching(R: DataFrame, *names: str) -> DataFrame:
    """Edges of either direction, each once."""
    return R.where(F.col("source_qualified").isin(*names) | F.col("target_qualified").isin(*names))


def by_rel_type(R: DataFrame, *types: str) -> DataFrame:
    return among(R, "rel_type", types)


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0, cap: int = 5000) -> DataFrame:
    """B21."""
    return df.orderBy(*order).offset(offset).limit(min(limit, cap))


def in_env(df: DataFrame, env: str) -> DataFrame:
    """B22."""
    return df.where(F.col("env") == env)


def env_presence(E: DataFrame) -> DataFrame:
    """For each name, in which environments it exists."""
    flags = [F.max(F.when(F.col("env") == e, 1).otherwise(0)).cast("int").alias(f"in_{e}") for e in ("local", "staging", "production")]
    return E.groupBy("qualified_name").agg(*flags)


def search_by_name(E: DataFrame, needle: str) -> DataFrame:
    """D1."""
    return E.where(F.lower("name").contains(needle.lower()))


def search_by_name_typed(E: DataFrame, needle: str, element_type: str | None, limit: int) -> DataFrame:
    """D2."""
    out = search_by_name(E, needle)
    out = out.where(F.col("element_type") == element_type) if element_type else out
    return out.orderBy("qualified_name").limit(limit)


def find_exact_name(E: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """D3."""
    return E.where(F.col("name") == name).orderBy("qualified_name").limit(limit)


def search_by_pattern(E: DataFrame, needle: str) -> DataFrame:
    """D5."""
    return E.where(F.lower("qualified_name").contains(needle.lower()))


def search_any_text(E: DataFrame, needle: str, limit: int = 200) -> DataFrame:
    """Name, qualified name or path."""
    low = needle.lower()
    hit = F.lower("name").contains(low) | F.lower("qualified_name").contains(low) | F.lower("file_path").contains(low)
    return E.where(hit).orderBy("qualified_name").limit(limit)


def under_path(E: DataFrame, path: str, limit: int = 500) -> DataFrame:
    """The path itself, what lies below it, or files of that base name."""
    f = F.col("file_path")
    hit = (f == path) | f.startswith(path + "/") | f.endswith("/" + path)
    return E.where(hit & ~F.col("qualified_name").startswith("ontology://")).orderBy("qualified_name").limit(min(limit, 500))


def oversized_functions(E: DataFrame, least: int, language: str | None = None) -> DataFrame:
    """Functions of at least that many lines, the longest first."""
    lines = F.col("line_end") - F.col("line_start") + 1
    out = E.where((F.col("element_type") == "function") & (lines >= least))
    out = out.where(F.col("language") == language) if language else out
    return out.withColumn("lines", lines).orderBy(F.desc("lines"), "qualified_name")
