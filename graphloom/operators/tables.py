"""Writing semantics, exports and response encoders (rows A25-A31, C1-C7, M1-M10, N3, S6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Bags keep duplicates."""
    return table.unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Rows replace those of the same key; of several new ones the latest version stays, of equal or no versions that with the largest hash.

    The best of a key is found before the shuffle, so a key that many rows share needs no task of its own.
    """
    hashed = F.xxhash64(*rows.columns)
    order = F.struct(F.col(version), hashed) if version else hashed
    names = [f"key_{k}" for k in range(len(keys))]
    best = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.max_by(F.struct(*rows.columns), order).alias("best"))
    rows = best.select("best.*")
    return table.join(rows, list(keys), "left_anti").select(*table.columns).unionByName(rows, allowMissingColumns=True)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """A29, A30."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def retention(M: DataFrame, now: int, days: int) -> tuple[DataFrame, DataFrame]:
    """How many rows would go, and the table without them."""
    old = F.col("timestamp") < now - 86_400 * days
    return M.where(old).agg(F.count("*").alias("n_deleted")), delete_where(M, old)


def promote(K: DataFrame, branch: str, target: str) -> DataFrame:
    """M2: upcoming rows of a branch move to the target environment."""
    return K.withColumn("env", F.when((F.col("env") == "upcoming") & (F.col("branch") == branch), target).otherwise(F.col("env")))


def incident_problem() -> Column:
    """M4: the first rule that an incident breaks, null if it is valid."""
    return (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "title")
        .when(F.length("title") > 200, "title_length")
        .when(~F.coalesce(F.col("env").isin("local", "staging", "production"), F.lit(False)), "env")
        .when(~F.coalesce(F.col("severity").isin("P0", "P1", "P2", "P3"), F.lit(False)), "severity")
        .when(F.col("occurred_at").isNull() | (F.col("occurred_at") <= 0), "occurred_at")
        .when(F.col("resolved_at") < F.col("occurred_at"), "resolved_at")
        .when(F.coalesce(F.size("affected_services"), F.lit(0)) < 1, "affected_services")
        .when(F.coalesce(F.trim("author"), F.lit("")) == "", "author")
    )


def incident_texts_problem() -> Column:
    """M4: the rules on the texts that an incident must or may have; null if none is broken."""
    ticket = F.trim("linked_ticket")
    return (
        F.when(F.coalesce(F.trim("root_cause"), F.lit("")) == "", "root_cause")
        .when(F.coalesce(F.trim("resolution"), F.lit("")) == "", "resolution")
        .when(F.col("linked_ticket").isNotNull() & ((ticket == "") | ~(ticket.contains("-") | ticket.startswith("#"))), "linked_ticket")
        .when(F.col("resolved_at") <= 0, "resolved_at")
    )


def may_read(member: str) -> Column:
    """M6: the permission predicate over members (array of struct user, role)."""
    return F.exists("members", lambda m: m["user"] == member)


def backfill_labels(R: DataFrame) -> DataFrame:
    """M8: a stored label wins over the derived one."""
    from .aggregates import confidence_label

    derived = confidence_label(F.col("confidence"), F.coalesce(F.get_json_object("metadata", "$.resolution_method"), F.lit("name")))
    return R.withColumn("label", F.coalesce(F.get_json_object("metadata", "$.confidence_label"), derived))


def diary(entries: DataFrame, tag: str | None = None) -> DataFrame:
    """Entries (at, text, tags), the newest first."""
    out = entries.where(F.array_contains("tags", tag)) if tag else entries
    return out.orderBy(F.desc("at"), "text")


def recall_lessons(L: DataFrame, budget: int) -> DataFrame:
    """M9: lessons by score, within a budget of characters; the ranking is bounded by the budget before the running sum."""
    top = L.orderBy(F.desc("score"), "id").limit(max(1, budget))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= budget)


def select_for_export(E: DataFrame, R: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, the best connected within the budget, and the edges between them."""
    from .aggregates import degrees

    nodes = E.groupBy("qualified_name").agg(F.min(F.struct("element_type", "name", "file_path")).alias("x")).select("qualified_name", "x.*")
    ranked = nodes.join(degrees(R).select("qualified_name", "degree"), "qualified_name", "left").fillna(0, ["degree"])
    kept = ranked.orderBy(F.desc("degree"), "qualified_name").limit(budget)
    key = kept.select("qualified_name")
    inside = R.join(key.withColumnRenamed("qualified_name", "source_qualified"), "source_qualified", "left_semi")
    return kept, inside.join(key.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_semi")


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml(E: DataFrame, R: DataFrame) -> DataFrame:
    """The lines of the nodes and edges; write them with write.text."""
    q = _xml(F.col("qualified_name"))
    nodes = E.select(F.format_string('<node id="%s"><data key="type">%s</data></node>', q, _xml(F.col("element_type"))).alias("value"))
    edges = R.select(F.format_string('<edge source="%s" target="%s"><data key="rel">%s</data></edge>', _xml(F.col("source_qualified")), _xml(F.col("target_qualified")), _xml(F.col("rel_type"))).alias("value"))
    return nodes.unionByName(edges)


def cypher(E: DataFrame, R: DataFrame) -> DataFrame:
    """C5."""
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    label = F.regexp_replace("element_type", "[^A-Za-z0-9_]", "_")
    nodes = E.select(F.format_string("MERGE (:%s {id: '%s', name: '%s'});", label, safe("qualified_name"), safe("name")).alias("value"))
    rel = F.upper(F.regexp_replace("rel_type", "[^A-Za-z0-9_]", "_"))
    edges = R.select(F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) MERGE (a)-[:%s]->(b);", safe("source_qualified"), safe("target_qualified"), rel).alias("value"))
    return nodes.unionByName(edges)


def json_snapshot(E: DataFrame, R: DataFrame) -> DataFrame:
    """One JSON line for each node and edge."""
    a = E.select(F.to_json(F.struct(F.lit("node").alias("kind"), *E.columns)).alias("value"))
    return a.unionByName(R.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *R.columns)).alias("value")))


def ctags(E: DataFrame) -> DataFrame:
    """C5."""
    return E.where(F.col("line_start") > 0).select(F.format_string('%s\t%s\t%d;"\t%s', "name", "file_path", "line_start", F.substring("element_type", 1, 1)).alias("value"))


def wiki(E: DataFrame) -> DataFrame:
    """A page of text for each file."""
    line = F.format_string("- `%s` %s, lines %d to %d", F.col("name"), F.col("element_type"), F.col("line_start"), F.col("line_end"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "qualified_name", line.alias("s")))), lambda x: x["s"]), "\n")
    return E.groupBy("file_path").agg(F.concat(F.lit("# "), F.first("file_path"), F.lit("\n\n"), listed).alias("page"))


def obsidian(E: DataFrame, R: DataFrame) -> DataFrame:
    """Note, place and value of each line of the notes, links last; a hub's note is lines, never one string."""
    note = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    head = F.array(
        F.struct(F.lit(0).alias("place"), F.concat(F.lit("# "), "name").alias("value")),
        F.struct(F.lit(1).alias("place"), F.format_string("type: %s, file: %s", "element_type", "file_path").alias("value")),
    )
    heads = E.select(note("qualified_name").alias("note"), F.explode(head).alias("x")).select("note", "x.place", "x.value")
    ends = R.select(note("source_qualified").alias("note"), F.when(F.col("rel_type").isNotNull() & F.col("target_qualified").isNotNull(), F.struct("rel_type", note("target_qualified").alias("to"))).alias("x"))
    links = ends.distinct().select("note", F.lit(2).alias("place"), F.concat(F.lit("- "), "x.rel_type", F.lit(" [["), "x.to", F.lit("]]")).alias("value"))  # what is the same in every line does not travel
    return heads.unionByName(links)


def compress_response(df: DataFrame, by: str, order: Sequence[str | Column], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first rows and the count of each group."""
    return df.orderBy(*order).limit(most), df.groupBy(by).agg(F.count("*").alias("n"))


def toon(df: DataFrame, name: str) -> DataFrame:
    """One header line with the fields, then a line of comma-separated values for each row.

    A value with a comma, a quote, a backslash, a line end or a blank at an end is quoted, as JSON quotes it; so is a text that reads null.
    """
    spark = df.sparkSession
    plain = lambda c: F.coalesce(F.when(F.col(c).cast("string").rlike('[,"\\\\\\x00-\\x1f]|^ | $|^$|^null$'), F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), r'^\{"v":([\s\S]*)\}$', 1)).otherwise(F.col(c).cast("string")), F.lit("null"))
    head = spark.createDataFrame([(f"{name}{{{','.join(df.columns)}}}:",)], "value string")
    return head.unionByName(df.select(F.concat_ws(",", *map(plain, df.columns)).alias("value")))
