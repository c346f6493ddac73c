"""Scored matching and intent classification (rows D9-D19)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of element types in ties, words without meaning in a query, and intents with their words.
TYPE_RANK = ["function", "method", "class", "struct", "interface", "service", "file", "directory", "module"]
STOP = ["a", "an", "and", "are", "by", "do", "does", "for", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "where", "which", "with"]
INTENTS = {
    "impact": ["impact", "break", "affected", "change", "blast"],
    "dependencies": ["depends", "dependency", "dependencies", "imports", "uses"],
    "search": ["find", "search", "locate", "where", "show"],
    "doc": ["doc", "docs", "documentation", "explain", "describe"],
    "context": ["context", "overview", "understand", "summary"],
}
PLANS = {"impact": ["search", "impact", "tests"], "dependencies": ["search", "dependencies"], "search": ["search"], "doc": ["search", "related_docs"], "context": ["search", "context"]}


def type_rank(t: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_RANK)), t), F.lit(0)).cast("int") + F.when(F.array_contains(F.array(*map(F.lit, TYPE_RANK)), t), 0).otherwise(len(TYPE_RANK) + 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def resolve_alias(E: DataFrame, alias: str, limit: int = 20) -> DataFrame:
    """Six levels of match, the best first."""
    low = alias.lower()
    score = (
        F.when((F.col("qualified_name") == alias) | (F.col("name") == alias), 100)
        .when(F.lower("name") == low, 90)
        .when(F.col("file_path") == alias, 80)
        .when(basename(F.col("file_path")) == alias, 70)
        .when(stem(F.col("file_path")) == alias, 60)
        .when(F.lower("name").startswith(low) & F.lit(len(low) >= 3), 50)
    )
    out = E.withColumn("score", score).where(F.col("score").isNotNull()).withColumn("type_rank", type_rank(F.col("element_type")))
    return out.orderBy(F.desc("score"), "type_rank", "qualified_name").limit(limit)


def resolve_to_qualified(E: DataFrame, needle: str) -> DataFrame:
    """Exact id, else exact name by type rank, else part of a name, else the end of an id."""
    q, n = F.col("qualified_name"), F.col("name")
    level = F.when(q == needle, 0).when(n == needle, 1).when(F.lower(n).contains(needle.lower()), 2).when(q.endswith(needle), 3)
    hit = E.withColumn("level", level).where(F.col("level").isNotNull()).withColumn("type_rank", type_rank(F.col("element_type")))
    return hit.orderBy("level", "type_rank", "qualified_name").limit(1).select("qualified_name", "level")


def keywords(c: Column) -> Column:
    """Distinct lower-case words of two letters or more that are no stop words, in order."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP)))


def ontology_score(name: Column, aliases: Column, description: Column, query: str) -> Column:
    """D11."""
    low = query.lower()
    words = [w for w in re.split(r"\W+", low) if w]
    hay = F.lower(F.concat_ws(" ", name, F.array_join(aliases, " "), description))
    share = sum((F.when(hay.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words))
    many = F.when(share >= 0.5, share * 0.7).when(share > 0, share * 0.3).otherwise(0.0) if len(words) > 1 else F.lit(0.0)
    return (
        F.when(F.lower(name) == low, 1.0)
        .when(F.exists(aliases, lambda a: F.lower(a) == low), 0.9)
        .when(F.lower(name).contains(low), 0.8)
        .when(F.exists(aliases, lambda a: F.lower(a).contains(low)), 0.7)
        .when(F.lower(description).contains(low), 0.5)
        .otherwise(many)
    )


def ontology_search(concepts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Concepts (gid, name, aliases, description); the best score over the query and its words."""
    probes = [query, *(w for w in re.split(r"\W+", query.lower()) if len(w) > 1 and w not in STOP)]
    best = F.greatest(F.lit(0.0), *(ontology_score(F.col("name"), F.col("aliases"), F.col("description"), p) for p in probes))
    return concepts.withColumn("score", best).where("score > 0").orderBy(F.desc("score"), "gid").limit(limit)


def discover(E: DataFrame, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """100 for the exact name, 40 for a part, 10 and 3 for each of eight words in name and id."""
    words = [w for w in re.split(r"[^a-z0-9_]+", query.lower()) if len(w) > 1 and w not in STOP][:8]
    name, q, low = F.lower("name"), F.lower("qualified_name"), query.lower()
    score = F.when(name == low, 100).otherwise(0) + F.when(name.contains(low), 40).otherwise(0)
    for w in words:
        score = score + F.when(name.contains(w), 10).otherwise(0) + F.when(q.contains(w), 3).otherwise(0)
    return E.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "qualified_name").offset(offset).limit(limit)


def search_code(E: DataFrame, query: str, element_type: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """By name where that finds something, else by score."""
    typed = E.where(F.col("element_type") == element_type) if element_type else E
    by_name = typed.where(F.lower("name").contains(query.lower())).withColumn("score", F.lit(40))
    if by_name.isEmpty():
        return discover(typed, query, limit, offset)
    return by_name.orderBy("qualified_name").offset(offset).limit(limit)


def search_knowledge(K: DataFrame, needle: str, limit: int = 50, **equal: str) -> DataFrame:
    """Title or content holds the needle, and every named column has its value."""
    out = K.where(F.lower("title").contains(needle.lower()) | F.lower("content").contains(needle.lower()))
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out.orderBy("id").limit(limit)


def search_notes(K: DataFrame, A: DataFrame, I: DataFrame, needle: str, limit: int = 50) -> DataFrame:  # noqa: E741
    """Knowledge (id, title, content), annotations (element_qualified, description) and incidents (id, title, root_cause, resolution) that hold the needle: kind, id and title, the limit's first of each kind."""
    low = needle.lower()
    holds = lambda *columns: F.lower(F.concat_ws("\n", *columns)).contains(low)
    parts = (
        K.where(holds("title", "content")).select(F.lit("knowledge").alias("kind"), F.col("id").cast("string").alias("id"), "title"),
        A.where(holds("element_qualified", "description")).select(F.lit("annotation").alias("kind"), F.col("element_qualified").alias("id"), F.col("description").alias("title")),
        I.where(holds("title", "root_cause", "resolution")).select(F.lit("incident").alias("kind"), F.col("id").cast("string").alias("id"), "title"),
    )
    first = [p.orderBy("id", "title").limit(limit) for p in parts]
    return first[0].unionByName(first[1]).unionByName(first[2])


def classify_intent(text: Column) -> Column:
    """A struct (score, intent): the share of an intent's words in the text; context at .5 where none is higher."""
    words = keywords(text)
    scored = [F.struct(F.round(F.size(F.array_intersect(words, F.array(*map(F.lit, of)))) / len(of), 6).alias("score"), F.lit(k).alias("intent")) for k, of in INTENTS.items()]
    best = F.greatest(*scored)
    return F.when(best["score"] > 0, best).otherwise(F.struct(F.lit(0.5).alias("score"), F.lit("context").alias("intent")))


def plan(goal: str) -> list[tuple[int, str, list[int]]]:
    """The steps of a goal as (number, tool, the numbers it waits for)."""
    words = set(re.split(r"\W+", goal.lower()))
    intent = max(INTENTS, key=lambda k: (len(words & set(INTENTS[k])), k == "context"))
    return [(i, tool, [i - 1] if i else []) for i, tool in enumerate(PLANS[intent])]


def best_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """H1, H6: the first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
