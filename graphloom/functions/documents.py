"""Nodes and edges of documents, requirements and conversations (rows B13, B14, B16).

Everything is built-in expressions over whole texts. Lines of a document are
handled in its own row by array functions, so that no window gathers them.

Defined results: a null text counts as empty; headings inside fenced code are
text; of equal headings in one document each is a section, told apart by its
line; rows with a null path (or conversation) are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import code_targets, conversation_kind, message_topic

#: A code path in backticks, maybe with a symbol.
CODE = r"`([A-Za-z0-9_/.-]+\.[A-Za-z]+(?:::[A-Za-z0-9_]+)?)`"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def headings(docs: DataFrame) -> DataFrame:
    """docs (path, text) -> path, n_lines and an array of the headings: line (from 1), level, title, and the last line of the section."""
    lines = _lines(F.col("text"))
    marked = F.transform(lines, lambda s, k: F.struct((k + 1).alias("line"), F.length(F.regexp_extract(s, r"^(#{1,6})[ \t]+\S", 1)).alias("level"), F.trim(F.regexp_replace(s, r"^#{1,6}[ \t]+|[ \t]+#+[ \t]*$", "")).alias("title"), s.rlike("^[ \t]*(```|~~~)").alias("fence")))
    of = docs.where("path IS NOT NULL").select("path", F.size(lines).alias("n_lines"), F.filter(marked, lambda x: (x["level"] > 0) | x["fence"]).alias("marks"))
    # a heading after an odd number of fences is code
    state = F.aggregate(
        "marks",
        F.struct(F.lit(False).alias("code"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("found")),
        lambda s, x: F.struct(
            F.when(x["fence"], ~s["code"]).otherwise(s["code"]).alias("code"),
            F.when((x["level"] > 0) & ~s["code"] & ~x["fence"], F.concat(s["found"], F.array(F.struct(x["line"].alias("line"), x["level"].alias("level"), x["title"].alias("title"))))).otherwise(s["found"]).alias("found"),
        ),
    )
    return of.select("path", "n_lines", state["found"].alias("found"))


def document_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (path, text) -> documents and sections as nodes, and edges: what contains a section, and the code that a document names (both ways).

    A section reaches to the line before the next heading of its level or above; what
    contains it is the nearest heading before it of a smaller level, or the document.
    """
    found = headings(docs)
    name = F.element_at(F.split("path", "/"), -1)
    one = F.lit(1)
    documents = found.select(F.col("path").alias("qualified_name"), F.lit("document").alias("element_type"), name.alias("name"), F.col("path").alias("file_path"), one.alias("line_start"), F.col("n_lines").alias("line_end"), F.lit(None).cast("string").alias("parent_qualified"))
    each = found.select("path", "n_lines", "found", F.explode("found").alias("h"))
    later = F.filter("found", lambda y: (y["line"] > F.col("h.line")) & (y["level"] <= F.col("h.level")))
    above = F.filter("found", lambda y: (y["line"] < F.col("h.line")) & (y["level"] < F.col("h.level")))
    label = lambda h: F.concat(F.col("path"), F.lit("::"), h["title"], F.lit("#L"), h["line"].cast("string"))
    around = F.get(above, F.size(above) - 1)
    sections = each.select(
        label(F.col("h")).alias("qualified_name"), F.lit("doc_section").alias("element_type"), F.col("h.title").alias("name"), F.col("path").alias("file_path"), F.col("h.line").alias("line_start"),
        F.when(F.size(later) > 0, F.get(later, F.lit(0))["line"] - 1).otherwise(F.col("n_lines")).alias("line_end"),
        F.when(F.size(above) > 0, label(around)).otherwise(F.col("path")).alias("parent_qualified"),
    )
    nodes = documents.unionByName(sections)
    contains = sections.select(F.col("parent_qualified").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), F.lit("contains").alias("rel_type"))
    named = docs.where("path IS NOT NULL").select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CODE), F.lit(1)))).alias("code"))
    refers = named.select(F.col("path").alias("source_qualified"), F.col("code").alias("target_qualified"), F.lit("references").alias("rel_type"))
    back = named.select(F.col("code").alias("source_qualified"), F.col("path").alias("target_qualified"), F.lit("documented_by").alias("rel_type"))
    return nodes, contains.unionByName(refers).unionByName(back)


#: Ids of requirements and stories: at least two segments after FR or US (fixed pattern).
REQUIREMENT = r"\b((?:FR|US)-[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+)\b"


def requirement_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (path, text) -> requirements and user stories as nodes, and edges: the document that states one, the code named on its lines.

    Of an id that several lines of a document name, the first is its place; its priority is the first P0 to P3 on that line.
    """
    line = docs.where("path IS NOT NULL").select("path", F.posexplode(_lines(F.col("text"))).alias("k", "s")).where(F.col("s").rlike(REQUIREMENT))
    each = line.select("path", (F.col("k") + 1).alias("line"), "s", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(REQUIREMENT), F.lit(1)))).alias("id"))
    first = each.groupBy("path", "id").agg(F.min(F.struct("line", F.regexp_extract("s", r"\b(P[0-3])\b", 1).alias("priority"))).alias("x"))
    kind = F.when(F.col("id").startswith("US"), "user_story").otherwise("requirement")
    nodes = first.select(F.concat_ws("::", "path", "id").alias("qualified_name"), kind.alias("element_type"), F.col("id").alias("name"), F.col("path").alias("file_path"), F.col("x.line").alias("line_start"), F.col("x.priority").alias("priority"))
    states = nodes.select(F.col("file_path").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), F.lit("contains").alias("rel_type"))
    code = each.select(F.concat_ws("::", "path", "id").alias("source_qualified"), F.explode(F.regexp_extract_all("s", F.lit(CODE), F.lit(1))).alias("target_qualified")).distinct().withColumn("rel_type", F.lit("implemented_by"))
    return nodes, states.unionByName(code)


def conversation_graph(M: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M (conv_id, turn, role, text) -> messages that decide, prefer, reach or complain as nodes, with topic and speaker, and decided_about edges of decisions to the code that they name."""
    said = M.where("conv_id IS NOT NULL").withColumn("kind", conversation_kind(F.coalesce("text", F.lit("")))).where("kind <> 'general'")
    rows = said.withColumn("topic", message_topic("text")).withColumn("code_targets", code_targets("text"))
    name = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("::"), F.col("kind"), F.lit("/"), F.col("turn").cast("string"))
    nodes = rows.select(name.alias("qualified_name"), F.col("kind").alias("element_type"), F.col("topic").alias("name"), F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")).alias("file_path"), F.col("role").alias("participant"), F.col("text").alias("verbatim"))
    edges = rows.where("kind = 'decision'").select(name.alias("source_qualified"), F.explode("code_targets").alias("target_qualified")).withColumn("rel_type", F.lit("decided_about"))
    return nodes, edges
