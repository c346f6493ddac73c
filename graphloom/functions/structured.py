"""Elements and edges of structured sources: XML, nested blocks (Terraform, Gradle) and YAML (rows B5, B17).

Every reader gives flat rows of a file, and DataFrame expressions make elements
and edges of them:

* ``xml_nodes``: each XML element with its parent and attributes
* ``block_rows``: each block and statement of ``head { ... }`` files with the blocks around it
* ``yaml_rows``: each scalar of a YAML file with the keys and places that lead to it

A file is one row; files are read in Arrow batches. Defined results: a null text
is empty, and a malformed file gives the rows up to the fault.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}


def _per_file(files: DataFrame, read: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """path and the rows that ``read`` gives of each text of files (path, text)."""
    names, kinds = zip(*(c.split() for c in columns.split("; ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = read(text or "")
                for a in range(0, len(rows), 10_000):
                    part = list(zip(*rows[a : a + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part[0]), pa.string()), *(pa.array(c, _KINDS[k]) for c, k in zip(part, kinds, strict=True))], ["path", *names])

    return files.select("path", "text").mapInArrow(run, "path string, " + columns.replace(";", ","))


# XML


def xml_elements(text: str) -> list[tuple]:
    """(place, parent, depth, tag, attributes, own text) of each element in order; place and parent count from 1, the root's parent is 0."""
    rows: list[list] = []
    open_: list[int] = []
    parser = expat.ParserCreate()
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def start(tag: str, attributes: dict) -> None:
        rows.append([len(rows) + 1, open_[-1] if open_ else 0, len(open_), tag, list(attributes.items()), ""])
        open_.append(len(rows))

    def data(s: str) -> None:
        if open_:
            rows[open_[-1] - 1][5] += s

    def entity(*_) -> None:
        raise ValueError("entities are not read")  # nor expanded: a few of them can stand for gigabytes

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, lambda tag: open_.pop(), data, entity
    try:
        parser.Parse(text.encode(), True)
    except (expat.ExpatError, ValueError):
        pass  # the rows up to the fault
    return [(*r[:5], r[5].strip()) for r in rows]


def xml_nodes(files: DataFrame) -> DataFrame:
    return _per_file(files, xml_elements, "place int; parent int; depth int; tag string; attributes map<string,string>; value string")


#: Components of a manifest, and the edges to what they name (fixed values).
COMPONENTS = ["activity", "service", "receiver", "provider"]
LAUNCHER = "android.intent.action.MAIN"


def android_manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of Android manifests as elements, with their names made whole by the package, and edges: the app's components, permissions, and which is launched."""
    nodes = xml_nodes(files)
    name = F.col("attributes")["android:name"]
    package = nodes.where("depth = 0 AND tag = 'manifest'").select("path", F.col("attributes")["package"].alias("package"))
    full = F.when(F.substring("name", 1, 1) == ".", F.concat("package", "name")).when(F.instr("name", ".") == 0, F.concat_ws(".", "package", "name")).otherwise(F.col("name"))
    own = nodes.where(F.col("tag").isin(COMPONENTS) & name.isNotNull()).select("path", "place", "tag", name.alias("name"), (F.col("attributes")["android:exported"] == "true").alias("exported")).join(package, "path").withColumn("name", full)
    elements = own.select(F.concat_ws("::", "path", "name").alias("qualified_name"), F.concat(F.lit("android_"), "tag").alias("element_type"), "name", F.col("path").alias("file_path"), F.coalesce("exported", F.lit(False)).alias("exported"))
    has = own.select(F.col("path").alias("source_qualified"), F.concat_ws("::", "path", "name").alias("target_qualified"), F.lit("declares_component").alias("rel_type"))
    asks = nodes.where((F.col("tag") == "uses-permission") & name.isNotNull()).select(F.col("path").alias("source_qualified"), F.concat(F.lit("permission::"), name).alias("target_qualified"), F.lit("requires_permission").alias("rel_type"))
    # the component around the filter around the action
    action = nodes.where((F.col("tag") == "action") & (name == LAUNCHER)).select("path", F.col("parent").alias("filter"))
    around = nodes.where("tag = 'intent-filter'").select("path", F.col("place").alias("filter"), F.col("parent").alias("place"))
    first = action.join(around, ["path", "filter"]).join(own.select("path", "place", "name"), ["path", "place"]).select(F.col("path").alias("source_qualified"), F.concat_ws("::", "path", "name").alias("target_qualified"), F.lit("launches").alias("rel_type"))
    return elements, has.unionByName(asks).unionByName(first).distinct()


def layouts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views of Android layouts that have an id, and edges to the custom views and layouts that they use."""
    nodes = xml_nodes(files)
    view_id = F.regexp_extract(F.col("attributes")["android:id"], r"^@\+?id/(.+)$", 1)
    views = nodes.where(F.length(view_id) > 0).select(F.concat_ws("::", "path", view_id).alias("qualified_name"), F.lit("view").alias("element_type"), view_id.alias("name"), F.col("path").alias("file_path"), F.col("tag").alias("view_class"))
    custom = nodes.where(F.instr("tag", ".") > 0).select(F.col("path").alias("source_qualified"), F.col("tag").alias("target_qualified"), F.lit("uses_view").alias("rel_type"))
    included = nodes.where("tag = 'include'").select(F.col("path").alias("source_qualified"), F.regexp_extract(F.col("attributes")["layout"], r"^@layout/(.+)$", 1).alias("target_qualified"), F.lit("includes_layout").alias("rel_type")).where("target_qualified <> ''")
    return views, custom.unionByName(included).distinct()


def maven_dependencies(files: DataFrame) -> DataFrame:
    """Edges of Maven projects to what they depend on: group:artifact, its version and scope; ${...} is replaced from the project's properties."""
    nodes = xml_nodes(files)
    tops = nodes.where("tag = 'properties' AND depth = 1").select("path", F.col("place").alias("parent"))
    properties = nodes.join(tops, ["path", "parent"]).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("tag", "value")))).alias("p"))
    declared = nodes.where("tag = 'dependency'").select("path", F.col("place").alias("parent"))
    fields = nodes.join(declared, ["path", "parent"]).groupBy("path", "parent").agg(*(F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in ("groupId", "artifactId", "version", "scope")))
    known = fields.join(properties, "path", "left")
    key = F.regexp_extract("version", r"^\$\{(.+)\}$", 1)
    version = F.when(F.length(key) > 0, F.coalesce(F.col("p")[key], F.col("version"))).otherwise(F.col("version"))
    return known.select(F.col("path").alias("source_qualified"), F.concat_ws(":", "groupId", "artifactId").alias("target_qualified"), F.lit("depends_on").alias("rel_type"), version.alias("version"), F.coalesce("scope", F.lit("compile")).alias("scope")).distinct()


# Nested blocks

_BLOCK_TOKENS = re.compile(r"(?P<skip>(?:#|//)[^\n]*|/\*.*?(?:\*/|\Z)|<<-?\s*(?P<end>\w+)\n.*?^\s*(?P=end)\b)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<word>[\w.:@-]+)|(?P<mark>[{}()\[\],=])|(?P<line>\n)", re.DOTALL | re.MULTILINE)


def blocks_of(text: str) -> list[tuple]:
    """(kind, head, labels, around, statement, line) of each block and statement.

    A block is ``head label... {``; a statement is what stands on its own in a
    block, its words and strings joined by one space. ``around`` are the heads and labels
    of the blocks around, the outermost first.
    """
    rows: list[tuple] = []
    open_: list[str] = []
    words: list[str] = []
    depth, line, first = 0, 1, 1

    def flush() -> None:
        if words:
            plain = [w for w in words if w not in "(),[]"]
            rows.append(("statement", plain[0] if plain else "", [w for w in plain[1:] if w != "="], list(open_), " ".join(words), first))
        words.clear()

    for m in _BLOCK_TOKENS.finditer(text):
        kind, value = ("skip" if m["skip"] is not None else m.lastgroup), m.group()
        if kind == "line":
            line += 1
            if depth == 0:
                flush()
        elif kind == "skip":
            line += value.count("\n")
        elif value == "{" and depth == 0:
            plain = [w for w in words if w not in "=()"]
            rows.append(("block", plain[0] if plain else "", plain[1:], list(open_), "", first if words else line))
            open_.append(" ".join(plain))
            words.clear()
        elif value == "}" and depth == 0:
            flush()
            if open_:
                open_.pop()
        else:
            depth = max(0, depth + (value in "([{") - (value in ")]}")) if kind == "mark" else depth
            if not words:
                first = line
            words.append(value[1:-1] if kind == "string" else value)
            line += value.count("\n")
    flush()
    return rows


def block_rows(files: DataFrame) -> DataFrame:
    return _per_file(files, blocks_of, "kind string; head string; labels array<string>; around array<string>; statement string; line int")


#: Kinds of Terraform blocks that are elements, and the words that references to some of them begin with (fixed values).
TERRAFORM = ["resource", "data", "module", "variable", "output", "provider", "locals"]


def terraform(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of Terraform files as elements, and edges from each to the ones that its statements refer to."""
    rows = block_rows(files)
    label = F.array_join("labels", ".")
    address = F.when(F.col("head") == "resource", label).when(F.col("head") == "variable", F.concat(F.lit("var."), label)).otherwise(F.concat_ws(".", "head", label))
    own = rows.where((F.col("kind") == "block") & (F.size("around") == 0) & F.col("head").isin(TERRAFORM)).select("path", address.alias("name"), F.concat(F.lit("terraform_"), "head").alias("element_type"), "line", F.concat_ws(" ", "head", F.array_join("labels", " ")).alias("top"))
    elements = own.select(F.concat_ws("::", "path", "name").alias("qualified_name"), "element_type", "name", F.col("path").alias("file_path"), F.col("line").alias("line_start"))
    said = rows.where((F.col("kind") == "statement") & (F.size("around") > 0)).select("path", F.element_at("around", 1).alias("top"), F.explode(F.regexp_extract_all("statement", F.lit(r"(?<![\w.-])((?:var|module|data\.\w+|[a-z]\w*_\w+)\.[A-Za-z_][\w-]*)"), F.lit(1))).alias("to"))
    named = own.select("path", "top", F.col("name").alias("from"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    targets = own.select(folder.alias("folder"), F.col("name").alias("to"), F.concat_ws("::", "path", "name").alias("target_qualified"))
    edges = said.join(named, ["path", "top"]).withColumn("folder", folder).join(targets, ["folder", "to"])
    return elements, edges.where("from <> to").select(F.concat_ws("::", "path", "from").alias("source_qualified"), "target_qualified", F.lit("depends_on").alias("rel_type")).distinct()


#: Configurations of Gradle dependencies (fixed values).
CONFIGURATIONS = ["implementation", "api", "compileOnly", "runtimeOnly", "testImplementation", "androidTestImplementation", "kapt", "ksp", "annotationProcessor"]


def gradle(files: DataFrame) -> DataFrame:
    """Edges of Gradle files, Groovy or Kotlin: dependencies on artifacts and projects, plugins applied, modules included."""
    rows = block_rows(files).where("kind = 'statement'")
    inside = F.element_at("around", -1)
    depends = rows.where((F.size("around") > 0) & (inside == "dependencies") & F.col("head").isin(CONFIGURATIONS))
    project = F.regexp_extract("statement", r"project\W+(:[\w:.-]+)", 1)
    artifact = F.regexp_extract("statement", r"^\w+[\s(]+([\w.-]+:[\w.-]+(?::[\w.$-]+)?)", 1)
    to_project = depends.where(F.length(project) > 0).select("path", project.alias("to"), F.lit("depends_on_module").alias("rel_type"), F.col("head").alias("configuration"))
    to_artifact = depends.where((F.length(project) == 0) & (F.length(artifact) > 0)).select("path", artifact.alias("to"), F.lit("depends_on").alias("rel_type"), F.col("head").alias("configuration"))
    plugins = rows.where((F.size("around") > 0) & (inside == "plugins") & (F.col("head") == "id")).select("path", F.element_at("labels", 1).alias("to"), F.lit("applies_plugin").alias("rel_type"), F.lit(None).cast("string").alias("configuration"))
    modules = rows.where((F.size("around") == 0) & (F.col("head") == "include")).select("path", F.explode("labels").alias("to"), F.lit("includes_module").alias("rel_type"), F.lit(None).cast("string").alias("configuration"))
    every = to_project.unionByName(to_artifact).unionByName(plugins).unionByName(modules)
    return every.select(F.col("path").alias("source_qualified"), F.col("to").alias("target_qualified"), "rel_type", "configuration").distinct()


# YAML


def _scalar(text: str) -> str:
    """A plain or quoted scalar without its comment."""
    text = text.strip()
    if text[:1] == '"':
        m = re.match(r'"((?:\\.|[^"\\])*)"', text)
        return re.sub(r"\\(.)", lambda c: {"n": "\n", "t": "\t"}.get(c[1], c[1]), m[1]) if m else text
    if text[:1] == "'":
        m = re.match(r"'((?:''|[^'])*)'", text)
        return m[1].replace("''", "'") if m else text
    return re.sub(r"\s+#.*$|^#.*$", "", text).strip()


def _flow(text: str) -> list[str]:
    """The items of ``[a, b]``."""
    inner = re.match(r"\[(.*)\]", text.strip(), re.DOTALL)
    return [_scalar(x) for x in re.findall(r"\s*(\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^,]+)", inner[1])] if inner and inner[1].strip() else []


_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#'"\[{&*!|>-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")


def yaml_scalars(text: str) -> list[tuple]:
    """(keys, value, line) of each scalar, in order: mappings by key, lists by place from 0, block scalars, [..] lists, anchors, aliases and merges."""
    lines = text.replace("\t", "        ").split("\n")
    rows: list[tuple] = []
    stack: list[tuple[int, str]] = []  # indent, key
    places: dict[tuple, int] = {}
    anchors: dict[str, tuple] = {}
    k = 0

    def put(value: str, line: int) -> None:
        rows.append(([key for _, key in stack], value, line))

    def copy(alias: str, line: int) -> None:
        own = tuple(key for _, key in stack if key != "<<")
        begin, end = anchors.get(alias, ((), 0))
        had = {tuple(r[0]) for r in rows}
        for keys, value, _ in [r for r in rows[:end] if tuple(r[0][: len(begin)]) == begin]:
            new = [*own, *keys[len(begin) :]]
            if tuple(new) not in had:
                rows.append((new, value, line))

    def value_of(rest: str, indent: int, line: int) -> None:
        nonlocal k
        if m := re.match(r"&(\S+)\s*", rest):
            anchors[m[1]] = (tuple(key for _, key in stack), 1 << 60)
            rest = rest[m.end() :]
        if m := re.match(r"\*([^\s#]+)", rest):
            copy(m[1], line)
        elif m := re.match(r"([|>])[+-]?\d*\s*(?:#.*)?$", rest):
            held = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > indent):
                held.append(lines[k])
                k += 1
            inner = min((len(x) - len(x.lstrip()) for x in held if x.strip()), default=0)
            put(("\n" if m[1] == "|" else " ").join(x[inner:].rstrip() for x in held).strip(), line)
        elif rest.startswith("["):
            while rest.count("[") > rest.count("]") and k < len(lines):
                rest += " " + lines[k].strip()
                k += 1
            for place, item in enumerate(_flow(rest)):
                stack.append((1 << 30, str(place)))
                put(item, line)
                stack.pop()
        elif _scalar(rest) or rest[:1] in "\"'" and rest:
            put(_scalar(rest), line)

    while k < len(lines):
        raw, line = lines[k], k + 1
        k += 1
        indent, rest = len(raw) - len(raw.lstrip()), raw.strip()
        if not rest or rest.startswith("#") or rest in ("---", "..."):
            continue
        begins_item = rest == "-" or rest.startswith("- ")
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not (begins_item and not stack[-1][1].isdigit())):
            stack.pop()
        while begins_item:
            around = tuple(key for _, key in stack)
            place = places[around] = places.get(around, -1) + 1
            stack.append((indent, str(place)))
            inner = rest[1:].lstrip()
            indent += len(rest) - len(inner)
            rest, begins_item = inner, inner == "-" or inner.startswith("- ")
        if m := _KEY.match(rest):
            stack.append((indent, _scalar(m[1])))
            value_of(rest[m.end() :].strip(), indent, line)
        elif rest:
            value_of(rest, indent, line)
    return rows


def yaml_rows(files: DataFrame) -> DataFrame:
    return _per_file(files, yaml_scalars, "keys array<string>; value string; line int")


def _key(k: int) -> Column:
    return F.element_at("keys", k)


def workflows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs of workflow files as elements, and edges: the file's jobs, the jobs they need, the actions their steps use."""
    rows = yaml_rows(files).where((F.size("keys") >= 3) & (_key(1) == "jobs"))
    job = F.concat_ws("::", "path", _key(2))
    elements = rows.select(job.alias("qualified_name"), F.lit("ci_job").alias("element_type"), _key(2).alias("name"), F.col("path").alias("file_path")).distinct()
    has = elements.select(F.col("file_path").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), F.lit("has_job").alias("rel_type"))
    needs = rows.where(_key(3) == "needs").select(job.alias("source_qualified"), F.concat_ws("::", "path", "value").alias("target_qualified"), F.lit("needs").alias("rel_type"))
    uses = rows.where((_key(3) == "steps") & (_key(-1) == "uses") | (_key(3) == "uses")).select(job.alias("source_qualified"), F.concat(F.lit("action::"), "value").alias("target_qualified"), F.lit("uses_action").alias("rel_type"))
    return elements, has.unionByName(needs).unionByName(uses).distinct()
