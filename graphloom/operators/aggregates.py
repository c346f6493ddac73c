"""Counts, histograms, degrees, risk and metric summaries (rows F1-F19, N4, N9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str) -> DataFrame:
    """F2."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def counts(E: DataFrame, R: DataFrame) -> DataFrame:
    """F1."""
    e = E.agg(F.count("*").alias("n_elements"), F.countDistinct("file_path").alias("n_files"), F.countDistinct("element_type").alias("n_types"))
    r = R.agg(F.count("*").alias("n_edges"), F.countDistinct("rel_type").alias("n_rel_types"))
    return e.join(r, F.lit(True))  # two rows of totals


def hotspots(E: DataFrame, limit: int = 10) -> DataFrame:
    """files with the most functions."""
    return E.where(F.col("element_type") == "function").groupBy("file_path").agg(F.count("*").alias("n_functions")).orderBy(F.desc("n_functions"), "file_path").limit(limit)


def inventory(E: DataFrame, vectors: DataFrame, dim: int = 384) -> DataFrame:
    """counts by type as a map, and the bytes of the vectors with an index three times their size."""
    by = histogram(E, "element_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("element_type", "n")))).alias("by_type"), F.sum("n").alias("n_elements"))
    size = vectors.agg((F.count("*") * dim * 4).alias("vector_bytes")).withColumn("index_bytes", F.col("vector_bytes") * 3)
    return by.join(size, F.lit(True))


def degrees(R: DataFrame) -> DataFrame:
    """in, out and total degree; one shuffle over both ends, combined before it."""
    ends = R.select(F.explode(F.array(F.struct(F.col("source_qualified").alias("q"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_qualified").alias("q"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    out = ends.groupBy(F.col("x.q").alias("qualified_name")).agg(F.sum("x.o").cast("long").alias("out_degree"), F.sum("x.i").cast("long").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def god_nodes(E: DataFrame, R: DataFrame, limit: int = 20) -> DataFrame:
    """the most connected elements."""
    top = degrees(R).join(E.select("qualified_name", "name", "element_type"), "qualified_name")
    return top.orderBy(F.desc("degree"), "qualified_name").limit(min(limit, 200))


def hub_cut(R: DataFrame, percentile: int) -> DataFrame:
    """the top max(1, floor(n * (100 - p) / 100)) nodes by degree."""
    d = degrees(R)
    keep = max(1, d.count() * (100 - percentile) // 100)
    return d.orderBy(F.desc("degree"), "qualified_name").limit(keep)


def node_explanation(R: DataFrame, name: str, limit: int = 8) -> DataFrame:
    """neighbour counts by type, incoming ones marked with <-."""
    near = R.where((F.col("source_qualified") == name) | (F.col("target_qualified") == name))
    label = F.when(F.col("source_qualified") == name, F.col("rel_type")).otherwise(F.concat(F.lit("<-"), "rel_type"))
    return near.groupBy(label.alias("relation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(limit)


def confidence_label(confidence: Column, method: Column) -> Column:
    """Provenance of an edge."""
    return F.when(method.isin("typed", "name_file_hint"), "EXTRACTED").when((method == "unresolved") | (confidence < 0.6), "AMBIGUOUS").otherwise("INFERRED")


def confidence_distribution(R: DataFrame) -> DataFrame:
    """the three labels with counts and percentages, also those without rows."""
    label = confidence_label(F.col("confidence"), F.coalesce(F.get_json_object("metadata", "$.resolution_method"), F.lit("name")))
    n = R.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    names = R.sparkSession.createDataFrame([("EXTRACTED",), ("INFERRED",), ("AMBIGUOUS",)], "label string")
    out = names.join(n, "label", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # three rows
    return out.withColumn("percent", F.round(F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0), 6))


def service_graph(R: DataFrame) -> DataFrame:
    """F8: calls between services with their number and distinct protocols."""
    calls = R.where(F.col("rel_type") == "service_calls")
    protocol = F.coalesce(F.get_json_object("metadata", "$.protocol"), F.lit("unknown"))
    return calls.groupBy("source_qualified", "target_qualified").agg(F.count("*").alias("call_count"), F.countDistinct(protocol).alias("n_protocols"))


def node_weight(current: Column, degree: Column) -> Column:
    return F.when(current, F.lit(10.0)).otherwise(1.0 + F.least(0.5 * degree, F.lit(5.0)))


def metrics_summary(M: DataFrame, by: str | None = "tool_name") -> DataFrame:
    """M has tool_name, tokens_saved, savings_percent, correct, total. Savings count where positive."""
    saved = F.when(F.col("tokens_saved") > 0, F.col("tokens_saved"))
    out = [
        F.count("*").alias("n"), F.coalesce(F.sum(saved), F.lit(0)).alias("total_saved"),
        F.round(F.avg(F.when(F.col("savings_percent") > 0, F.col("savings_percent"))), 6).alias("avg_positive_percent"),
        F.round(F.avg("savings_percent"), 6).alias("avg_percent"),
        F.round(F.avg(F.when(F.col("total") > 0, F.col("correct") / F.col("total"))), 6).alias("avg_correct"),
    ]
    return M.groupBy(by).agg(*out) if by else M.agg(*out)


def team_map(S: DataFrame) -> DataFrame:
    """team, its services in order and the first non-empty on-call."""
    oncall = F.min_by(F.when(F.col("oncall") != "", F.col("oncall")), F.when(F.col("oncall") != "", F.col("service_name")))
    return S.groupBy("team").agg(F.sort_array(F.collect_set("service_name")).alias("services"), oncall.alias("oncall"))


def pr_impact(E: DataFrame, files: DataFrame) -> DataFrame:
    """clusters touched by the changed files and the risk."""
    hit = E.join(files.select("file_path").distinct(), "file_path").agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_elements"))
    return hit.withColumn("risk", F.when(F.col("n_clusters") >= 5, "HIGH").when(F.col("n_clusters") >= 2, "MEDIUM").otherwise("LOW"))


def change_risk(E: DataFrame, R: DataFrame, files: DataFrame) -> DataFrame:
    """changed symbols, those that depend on them, and the most direct callers of one."""
    changed = E.join(files.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name")
    back = R.join(changed.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_semi")
    affected = back.agg(F.countDistinct("source_qualified").alias("n_affected"))
    direct = back.where(F.col("rel_type") == "calls").groupBy("target_qualified").agg(F.countDistinct("source_qualified").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("max_callers"))
    out = changed.agg(F.count("*").alias("n_changed")).join(affected, F.lit(True)).join(direct, F.lit(True))
    risk = F.when((F.col("max_callers") >= 20) | (F.col("n_affected") >= 50), "critical").when((F.col("max_callers") >= 10) | (F.col("n_affected") >= 20), "high").when((F.col("max_callers") >= 3) | (F.col("n_affected") >= 5), "medium")
    return out.withColumn("risk", risk.otherwise("low"))


def cluster_stats(E: DataFrame) -> DataFrame:
    """size of each cluster and its five files with the most members."""
    files = E.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id", "file_path").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "file_path"))
    top = files.withColumn("r", rank).where("r <= 5").groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "file_path"))), lambda x: x["file_path"]).alias("files"))
    return files.groupBy("cluster_id").agg(F.sum("n").alias("members")).join(top, "cluster_id")


def cluster_entry_points(E: DataFrame, R: DataFrame, limit: int = 5) -> DataFrame:
    """members with an edge from outside their cluster, at most five of each cluster."""
    s = E.select(F.col("qualified_name").alias("source_qualified"), F.col("cluster_id").alias("from_cluster"))
    t = E.select(F.col("qualified_name").alias("target_qualified"), "cluster_id")
    inward = R.join(s, "source_qualified").join(t, "target_qualified").where("from_cluster <> cluster_id")
    n = inward.groupBy("cluster_id", "target_qualified").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "target_qualified"))
    return n.withColumn("rank", rank).where(F.col("rank") <= limit)


def assign_clusters(E: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (qualified_name, cluster_id) replace the elements' clusters."""
    new = labels.select("qualified_name", F.col("cluster_id").alias("new"))
    return E.join(new, "qualified_name", "left").withColumn("cluster_id", F.coalesce("new", "cluster_id")).drop("new")


def top_directories(E: DataFrame) -> DataFrame:
    """F14."""
    return E.groupBy(F.substring_index("file_path", "/", 1).alias("directory")).agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files"))


def folder_children(E: DataFrame, folder: str) -> DataFrame:
    """the next path component below a folder."""
    rest = F.substring(F.col("file_path"), F.lit(len(folder) + 2), F.length("file_path"))
    return E.where(F.col("file_path").startswith(folder + "/")).groupBy(F.substring_index(rest, "/", 1).alias("child")).agg(F.count("*").alias("n"))


def doc_tree(D: DataFrame) -> DataFrame:
    """D has category and doc; documents by category."""
    return D.groupBy("category").agg(F.sort_array(F.collect_set("doc")).alias("docs"))


def cost_estimate(files: DataFrame) -> DataFrame:
    """lines, non-blank lines, bytes and tokens of files (path, text)."""
    lines = F.split("text", "\n")
    code = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    return files.agg(F.sum(F.size(lines)).alias("lines"), F.sum(code).alias("sloc"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.ceil(F.octet_length("text") / 4)).cast("long").alias("tokens"))


def file_summary(E: DataFrame) -> DataFrame:
    """one sentence about each file, of its elements in order."""
    listed = F.concat_ws(", ", F.sort_array(F.collect_set(F.concat_ws(" ", "element_type", "name"))))
    return E.groupBy("file_path").agg(F.count("*").alias("n"), listed.alias("what")).select("file_path", F.format_string("%s has %d elements: %s", "file_path", "n", "what").alias("summary"))


def overview(E: DataFrame, R: DataFrame) -> DataFrame:
    """totals with the leading languages and directories, over all rows."""
    def top(column: str, name: str) -> DataFrame:
        rows = E.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(5)
        return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v")))), lambda x: x["v"]).alias(name))

    out = counts(E, R).join(top("language", "languages"), F.lit(True))
    return out.join(top("file_path", "files"), F.lit(True))


def eviction_score(age: Column, reads: Column, tokens: Column) -> Column:
    """N4."""
    return 0.4 / (1 + F.sqrt(age)) + 0.3 * F.log(reads + 1.0) + 0.3 * F.log(tokens + 1.0)


def rolled_up(E: DataFrame) -> DataFrame:
    """counts by type and environment with subtotals."""
    return E.rollup("element_type", "env").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
