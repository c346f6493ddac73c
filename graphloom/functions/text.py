"""Scalar text functions and regex extractors (rows J, B3, B6-B9, B11-B16, N2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "js": "javascript", "java": "java", "kt": "kotlin", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "c": "c", "cpp": "cpp", "rb": "ruby", "swift": "swift", "tf": "terraform", "xml": "xml", "json": "json", "sh": "shell"}
LANGUAGES |= dict(
    h="c", cc="cpp", cxx="cpp", hpp="cpp", hh="cpp", hxx="cpp", bash="shell", zsh="shell", fish="fish", rake="ruby", gemspec="ruby", php="php", phtml="php", pl="perl", pm="perl", r="r", ex="elixir", exs="elixir", erl="erlang", hrl="erlang",
    scala="scala", sc="scala", jsx="javascript", mjs="javascript", cjs="javascript", tsx="typescript", vue="vue", svelte="svelte", kts="kotlin", dart="dart", m="objective-c", mm="objective-c", cs="csharp", fs="fsharp", vb="visualbasic", lua="lua",
    hs="haskell", ml="ocaml", mli="ocaml", clj="clojure", cljs="clojure", groovy="groovy", gradle="groovy", jl="julia", nim="nim", zig="zig", sol="solidity", proto="protobuf", graphql="graphql", html="html", htm="html", css="css", scss="scss", less="less",
    toml="toml", ini="ini", hcl="terraform", tfvars="terraform", cmake="cmake", ps1="powershell", tex="latex", rst="restructuredtext", cu="cuda", asm="assembly", s="assembly", v="verilog", sv="verilog", vhd="vhdl", f90="fortran", pas="pascal", lisp="lisp", el="lisp", scm="scheme", rkt="racket", d="d",
)


def language_of(path: Column) -> Column:
    """B3."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[F.lower(F.substring_index(path, ".", -1))], F.lit("unknown"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def shannon_entropy(text: Column) -> Column:
    """Bits for each byte: counts of characters over the number of bytes."""
    n = F.octet_length(text)
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def sanitize_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def read_mode(path: Column, lines: Column) -> Column:
    """How a file is read."""
    return F.when(language_of(path).isin("unknown", "markdown", "json"), "full").when(lines > 500, "map").when(lines > 200, "signatures").otherwise("map")


def reorder_by_attention(lines: Column) -> Column:
    """Lines in the order first, third ... fourth, second: the outer places hold the first ones."""
    odd = F.filter(lines, lambda x, i: i % 2 == 0)
    even = F.filter(lines, lambda x, i: i % 2 == 1)
    return F.concat(odd, F.reverse(even))


def _each(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))).alias("hit"))


def ddl_elements(files: DataFrame) -> DataFrame:
    """Tables and columns that CREATE TABLE statements define; keys and constraints are no columns."""
    body = F.explode(F.regexp_extract_all("text", F.lit(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.\"]+\s*\([^;]*\)"), F.lit(0)))
    t = files.select("path", body.alias("ddl")).withColumn("table", F.regexp_replace(F.regexp_extract("ddl", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)", 1), '"', ""))
    inner = F.regexp_extract("ddl", r"(?s)\((.*)\)", 1)
    columns = F.transform(F.split(F.regexp_replace(inner, r"\([^()]*\)", ""), ","), lambda c: F.regexp_extract(c, r'^\s*"?(\w+)"?', 1))
    keys = ["primary", "foreign", "unique", "constraint", "check", "index", "key", "exclude"]
    c = t.select("path", "table", F.explode(F.filter(columns, lambda x: (x != "") & ~F.lower(x).isin(*keys))).alias("name"))
    tables = t.select(F.concat_ws("::", "path", "table").alias("qualified_name"), F.lit("table").alias("element_type"), F.col("table").alias("name"), F.col("path").alias("parent"))
    return tables.unionByName(c.select(F.concat_ws("::", "path", "table", "name").alias("qualified_name"), F.lit("column").alias("element_type"), "name", F.concat_ws("::", "path", "table").alias("parent"))).distinct()


def event_edges(files: DataFrame) -> DataFrame:
    """B7."""
    quoted = r"\s*\(\s*['\"`]([^'\"`]+)['\"`]"
    out = _each(files, r"\.(?:emit|dispatchEvent)" + quoted).withColumn("rel_type", F.lit("emits"))
    back = _each(files, r"\.(?:on|addEventListener)" + quoted).withColumn("rel_type", F.lit("listens_on"))
    return out.unionByName(back).select(F.col("path").alias("source_qualified"), F.concat(F.lit("event::"), "hit").alias("target_qualified"), "rel_type", F.lit(0.85).alias("confidence"))


def routes(files: DataFrame) -> DataFrame:
    """Method and path of each route."""
    hit = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)(?:app|router|api|r)\.(?:get|post|put|patch|delete)\s*\(\s*['\"][^'\"]+['\"]"), F.lit(0))))
    return files.select("path", hit.alias("h")).select("path", F.upper(F.regexp_extract("h", r"\.(\w+)\s*\(", 1)).alias("method"), F.regexp_extract("h", r"['\"]([^'\"]+)", 1).alias("route"))


def service_edges(files: DataFrame) -> DataFrame:
    """B9."""
    return _each(files, r"dns:///?([A-Za-z0-9_-]+)").select(F.col("path").alias("source_qualified"), F.col("hit").alias("target_qualified"), F.lit("service_calls").alias("rel_type"), F.lit("grpc").alias("protocol"))


def functions_and_calls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions that files define and calls to names, by regular expressions."""
    defs = _each(files, r"(?m)^\s*(?:pub\s+|export\s+|async\s+|static\s+)*(?:def|fn|func|function)\s+(\w+)")
    elements = defs.select(F.concat_ws("::", "path", "hit").alias("qualified_name"), F.lit("function").alias("element_type"), F.col("hit").alias("name"), F.col("path").alias("file_path"))
    calls = _each(files, r"(?<![\w.])(\w{2,})\s*\(").where(~F.col("hit").isin("if", "for", "while", "switch", "return", "def", "fn", "func", "function", "catch", "print", "len", "match"))
    calls = calls.select(F.col("path").alias("source_qualified"), F.concat(F.lit("__unresolved__"), "hit").alias("target_qualified"), F.lit("calls").alias("rel_type"))
    return elements, calls


def physical_structure(files: DataFrame) -> DataFrame:
    """Contains edges of every directory prefix and the file."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.element_at(prefixes, k).alias("source_qualified"), F.element_at(prefixes, k + 1).alias("target_qualified")))
    return files.where(F.size(parts) > 1).select(F.explode(pairs).alias("x")).select("x.*", F.lit("contains").alias("rel_type")).distinct()


def rationale(files: DataFrame) -> DataFrame:
    """B12."""
    hit = F.explode(F.regexp_extract_all("text", F.lit(r"(?:#|//|--)\s*((?:WHY|NOTE|HACK|FIXME|XXX)\b[^\n]*)"), F.lit(1)))
    return files.select("path", hit.alias("note")).select("path", F.regexp_extract("note", r"^(\w+)", 1).alias("marker"), F.trim(F.regexp_replace("note", r"^\w+:?\s*", "")).alias("note"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """Docs (path, text): each heading with its level, place and the number of lines below it."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    heads = lines.withColumn("level", F.length(F.regexp_extract("s", r"^(#{1,6})\s", 1)))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    part = heads.withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w)).where("section > 0")
    return part.groupBy("path", "section").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.max(F.when(F.col("level") > 0, F.col("level"))).alias("level"), F.max(F.when(F.col("level") > 0, F.regexp_replace("s", r"^#+\s+", ""))).alias("heading"))


def code_references(docs: DataFrame) -> DataFrame:
    """Code paths in backticks."""
    return _each(docs, r"`([\w./-]+\.[a-z]{1,4})`").withColumnRenamed("hit", "code_path")


def requirements(docs: DataFrame) -> DataFrame:
    """Requirement and story ids."""
    return _each(docs, r"\b((?:FR|US|NFR)-[A-Z0-9-]*\d+)").select("path", F.col("hit").alias("id"), F.when(F.col("hit").startswith("US"), "user_story").otherwise("requirement").alias("kind"))


def conversation_kind(text: Column) -> Column:
    """The kind of a message; general ones carry nothing."""
    low = F.lower(text)
    any_of = lambda *words: low.rlike("|".join(words))
    return (
        F.when(any_of("we decided", "decision", "let's go with", "agreed to"), "decision")
        .when(any_of("i prefer", "preference", "always use", "never use"), "preference")
        .when(any_of("shipped", "released", "milestone", "launched"), "milestone")
        .when(any_of("bug", "broken", "fails", "error", "problem"), "problem")
        .otherwise("general")
    )


def mine_conversations(M: DataFrame) -> DataFrame:
    """M has conv_id, turn, text; messages that say something, with topic and code targets."""
    kept = M.withColumn("kind", conversation_kind(F.col("text"))).where("kind <> 'general'")
    return kept.select("conv_id", "turn", "kind", message_topic("text").alias("topic"), code_targets("text").alias("code_targets"))


def message_topic(text: str) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 3), 1, 4), "-")


def code_targets(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w/-]+\.(?:py|rs|go|ts|js|java))"), F.lit(1)))


def drop_low_entropy_lines(docs: DataFrame, least: float = 2.0) -> DataFrame:
    """Lines whose entropy reaches ``least`` or that carry structure, in order."""
    ok = lambda s: (shannon_entropy(s) >= least) | s.rlike(r"^\s*(def|fn|class|struct|import|#|//)")
    return docs.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), ok), "\n"))
