"""Elements, calls and notes of source files with their scopes (rows B4, B10, B12).

One pass over a file's tokens keeps a stack of open scopes. Comments and strings
are passed over. In languages with braces, the tokens since the last statement
say, when a brace opens, whether it opens a class, a function or a plain block;
in those with indents a scope ends before the first logical line that is
indented no further than its head. A call belongs to the innermost function
around it, or to the file; so does a note (a comment with one of a few marks) to
the innermost scope.

Whole files are read in Arrow batches: a file is one row, and nothing is
gathered across files here; ``resolved_calls`` joins callees with definitions in
Spark.

Defined results: a null text counts as empty; a file of another language gives
no rows; brackets that never close end with the file; of equal qualified names
in one file each has its row.
"""

from __future__ import annotations

import builtins
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words before a parenthesis that are no callee, whatever the language.
CONTROL = frozenset("if elif else for foreach while switch when match case catch except try with return yield throw raise new await typeof sizeof assert synchronized lock using guard do in is as not and or del print lambda def class func fn fun function super this self async".split())
#: Callees of every program, not worth an edge: the names that Python itself defines.
NOISE = frozenset(dir(builtins))
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _CHAR, _BACK = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"'(?:\\[^\n]{1,8}?|[^'\\\n])'", r"`(?:\\.|[^`\\])*`?"
_TRIPLE = r'""".*?(?:"""|\Z)'


@dataclass(frozen=True)
class Rules:
    """What tells the scopes of one language."""

    skip: str  # comments and strings
    functions: frozenset[str] = frozenset()  # words before a function's name
    classes: frozenset[str] = frozenset()  # words before a class's name
    bare: frozenset[str] = frozenset()  # scopes in which name(...) { is a function: file, class
    lines: bool = False  # a line end ends a statement
    nests: bool = False  # block comments nest


def _rules(skip: list[str], functions: str = "", classes: str = "", bare: str = "", lines: bool = False, nests: bool = False) -> Rules:
    return Rules("|".join(skip), frozenset(functions.split()), frozenset(classes.split()), frozenset(bare.split()), lines, nests)


_C = [_LINE, _BLOCK, r"^[ \t]*#(?:\\\n|[^\n])*", _DOUBLE, _CHAR]
RULES = {
    "python": _rules([r"#[^\n]*", _TRIPLE, r"'''.*?(?:'''|\Z)", _DOUBLE, _SINGLE], "def", "class"),
    "javascript": _rules([_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK], "function", "class interface enum namespace", "class", lines=True),
    "java": _rules([_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR], "", "class interface enum record", "class"),
    "csharp": _rules([_LINE, _BLOCK, r'@"(?:""|[^"])*"?', *_C[2:]], "", "class interface enum struct record namespace", "class"),
    "c": _rules(_C, "", "struct union enum", "file"),
    "cpp": _rules([r'R"\((?:.*?)\)"', *_C], "", "class struct union enum namespace", "file class"),
    "go": _rules([_LINE, _BLOCK, _DOUBLE, _CHAR, r"`[^`]*`?"], "func", "", lines=True),
    "rust": _rules([_LINE, _BLOCK, r"#!?\[[^\]\n]*\]", r'r(?P<fence>#*)".*?(?:"(?P=fence)|\Z)', r'"(?:\\.|[^"\\])*"?', _CHAR], "fn", "struct enum trait union impl mod", nests=True),
    "kotlin": _rules([_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR], "fun", "class interface object", lines=True, nests=True),
    "swift": _rules([_LINE, _BLOCK, _TRIPLE, _DOUBLE], "func", "class struct enum protocol extension actor", lines=True, nests=True),
    "scala": _rules([_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR], "def", "class trait object", lines=True, nests=True),
    "php": _rules([_LINE, _BLOCK, r"#(?!\[)[^\n]*", _DOUBLE, _SINGLE], "function", "class interface trait enum"),
    "dart": _rules([_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE], "", "class mixin enum extension", "file class"),
}
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mjs": "javascript", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "hpp": "cpp", "go": "go", "rs": "rust", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "php": "php", "dart": "dart",
}
#: Scopes that only hold others and are no elements.
_HOLDERS = frozenset({"impl", "namespace", "mod", "extension"})
#: Marks of comments that say why (fixed values), and what follows on their line.
NOTE = re.compile(r"\b(WHY|NOTE|HACK|FIXME|XXX)\b:?[ \t]*([^\n]*)")
_WORD = r"(?P<number>\d\w*)|(?P<name>[^\W\d]\w*)|(?P<mark>=>|->|::|[{}()\[\];=<>:.,@!*&?])|(?P<line>\n)"
_patterns: dict[str, re.Pattern] = {}


@dataclass
class Token:
    kind: str  # name, mark, line, note, or value (a number or string, of which only the place counts)
    value: str
    line: int
    column: int


def tokens(text: str, language: str) -> Iterator[Token]:
    """Names, marks and line ends outside comments and strings."""
    rules = RULES[language]
    pattern = _patterns.setdefault(language, re.compile(f"(?P<skip>{rules.skip})|{_WORD}", re.DOTALL | re.MULTILINE))
    comment = re.compile(r"/\*|\*/")
    at, line, begin = 0, 1, 0
    while m := pattern.search(text, at):
        at, kind = m.end(), m.lastgroup if m.lastgroup in ("name", "mark", "line", "number") else "skip"
        if kind == "number":
            yield Token("value", "0", line, m.start() - begin)
            continue
        if kind == "skip":
            if rules.nests and m.group().startswith("/*"):
                depth, at = 1, m.start() + 2
                while depth and (c := comment.search(text, at)):
                    depth, at = depth + (1 if c.group() == "/*" else -1), c.end()
                at = len(text) if depth else at
            column = m.start() - begin
            n = text.count("\n", m.start(), at)
            if n:
                line, begin = line + n, text.rfind("\n", m.start(), at) + 1
            if m.group().lstrip()[:1] not in ("/", "#"):
                yield Token("value", "0", line, column)
            else:
                for note in NOTE.finditer(text, m.start(), at):
                    yield Token("note", f"{note[1]} {note[2].removesuffix('*/').strip()}", line - text.count("\n", note.start(), at), column)
            continue
        yield Token(kind, m.group(), line, m.start() - begin)
        if kind == "line":
            line, begin = line + 1, at


@dataclass
class Scope:
    kind: str  # file, class or function
    element: str  # function, method, class, struct ...; empty for holders
    name: str
    qualified: str
    line: int
    parent: str | None = None
    end: int = 0
    indent: int = -1
    calls: list[tuple[str, int]] = field(default_factory=list)
    notes: list[tuple[str, int]] = field(default_factory=list)


class Walk:
    """The scopes of one file; subclasses read its tokens."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.open = [Scope("file", "file", path, path, 1)]
        self.closed: list[Scope] = []

    def enter(self, kind: str, element: str, name: str, line: int, holder: str | None = None) -> Scope:
        """``holder`` names the type that a function outside of its body belongs to."""
        around = self.open[-1]
        inside = f"{self.path}::{holder}" if holder else around.qualified
        if kind == "function":
            element = "method" if holder or around.kind == "class" else "function"
        scope = Scope(kind, "" if element in _HOLDERS else element, name, f"{inside}::{name}", line, None if inside == self.path else inside)
        self.open.append(scope)
        return scope

    def leave(self, line: int) -> None:
        scope = self.open.pop()
        scope.end = max(line, scope.line)
        self.closed.append(scope)

    def call(self, name: str, line: int) -> None:
        owner = next((s for s in reversed(self.open) if s.kind != "class"), self.open[0])
        owner.calls.append((name, line))

    def finish(self, line: int) -> list[Scope]:
        while self.open:
            self.leave(line)
        return sorted((s for s in self.closed), key=lambda s: (s.line, -s.end))


def indented(path: str, text: str) -> list[Scope]:
    """Scopes by indents."""
    walk, rules = Walk(path), RULES["python"]
    depth, fresh, last, before, head = 0, True, 1, None, None
    for t in tokens(text.expandtabs(8), "python"):
        if t.kind == "note":
            next(s for s in reversed(walk.open) if s.indent < t.column).notes.append((t.value, t.line))
            continue
        if t.kind == "line":
            fresh = fresh or depth == 0
            continue
        if fresh:  # the first token of a logical line
            while walk.open[-1].indent >= t.column and len(walk.open) > 1:
                walk.leave(last)
            fresh, before, head, first = False, None, None, t.column
        last = t.line
        if t.kind == "name" and before is not None and before.value in rules.functions | rules.classes and depth == 0:
            head = walk.enter("function" if before.value in rules.functions else "class", "class", t.value, t.line)
            head.indent = first
        elif t.value in "([{" and t.kind == "mark":
            if t.value == "(" and before is not None and before.kind == "name" and before.value not in CONTROL and not (head and before.value == head.name and before.line == head.line):
                walk.call(before.value, before.line)
            depth += 1
        elif t.value in ")]}" and t.kind == "mark":
            depth = max(0, depth - 1)
        before = t
    return walk.finish(last)


@dataclass
class Frame:
    """What stands open around a brace: the tokens since the last statement (a group of parentheses is one), and the calls among them."""

    header: list[tuple[str, int, str]] = field(default_factory=list)  # value, line, last name of a group
    calls: list[tuple[str, int, int]] = field(default_factory=list)  # name, line, place in the header or -1
    depth: int = 0
    opened: bool = False


def _without_generics(header: list[tuple[str, int, str]]) -> list[tuple[int, str, int, str]]:
    """(place, value, line, group) less what stands in angle brackets, if those are balanced."""
    kept, depth = [], 0
    for place, (value, line, group) in enumerate(header):
        depth += value == "<"
        if depth == 0 and value != ">":
            kept.append((place, value, line, group))
        depth -= value == ">" and depth > 0
    return kept if depth == 0 else [(k, *x) for k, x in enumerate(header) if x[0] not in "<>"]


def _opening(header: list[tuple[str, int, str]], rules: Rules, around: str) -> tuple[str, str, str, int, str | None, int] | None:
    """(scope, element, name, line, holder, place of the name) of what a header declares, None if nothing."""
    h = _without_generics(header)
    value = lambda k: h[k][1] if 0 <= k < len(h) else ""
    is_name = lambda k: bool(value(k)) and (value(k)[0].isalpha() or value(k)[0] == "_")
    for k in reversed(range(len(h))):
        word = value(k)
        if word in rules.functions:
            if is_name(k + 1) and value(k + 1) not in CONTROL:
                return "function", "function", value(k + 1), h[k + 1][2], None, h[k + 1][0]
            if value(k + 1) == "(" and is_name(k + 2) and "func" in rules.functions and value(k + 3) == "(":
                return "function", "function", value(k + 2), h[k + 2][2], h[k + 1][3] or None, h[k + 2][0]
            if value(k - 1) in ("=", ":") and is_name(k - 2):
                return "function", "function", value(k - 2), h[k - 2][2], None, h[k - 2][0]
            return None
        if word in rules.classes and is_name(k + 1) and value(k - 1) not in (".", "::"):
            at = k + 1
            if word == "impl":  # of a trait for a type, or of a type
                at = next((j + 1 for j in range(k, len(h)) if value(j) == "for" and is_name(j + 1)), at)
                while value(at + 1) == "::" and is_name(at + 2):
                    at += 2
            if value(at + 1) != "(" or around != "function" or "(" not in (value(j) for j in range(k)):
                return "class", word, value(at), h[at][2], None, h[at][0]
        if word == "type" and "func" in rules.functions and is_name(k + 1) and value(k + 2) in ("struct", "interface"):
            return "class", value(k + 2), value(k + 1), h[k + 1][2], None, h[k + 1][0]
    if h and value(len(h) - 1) == "=>" and "function" in rules.functions:
        at = next((j for j in range(len(h)) if value(j) == "="), 0)
        name = next((j for j in reversed(range(at)) if is_name(j) and value(j - 1) in ("const", "let", "var", "") or is_name(j) and value(j - 1) == "static"), None)
        return None if name is None else ("function", "function", value(name), h[name][2], None, h[name][0])
    if around in rules.bare:
        for k in range(len(h) - 1):
            if is_name(k) and value(k + 1) == "(" and value(k) not in CONTROL and value(k - 1) not in (".", "new", "=", "@", "return", "=>"):
                holder = value(k - 2) if value(k - 1) == "::" and is_name(k - 2) else None
                return "function", "function", value(k), h[k][2], holder, h[k][0]
            if value(k) == "=":
                return None
    return None


def braced(path: str, text: str, language: str) -> list[Scope]:
    """Scopes by braces."""
    walk, rules, frames = Walk(path), RULES[language], [Frame()]
    stream = list(tokens(text, language))
    follows = [""] * len(stream)  # the next token that is no line end
    for k in reversed(range(len(stream) - 1)):
        follows[k] = stream[k + 1].value if stream[k + 1].kind not in ("line", "note") else follows[k + 1]

    def statement(line: int) -> None:
        """A statement ends without a brace: maybe a function without a body, or with an expression for one."""
        f = frames[-1]
        found = _opening(f.header, rules, walk.open[-1].kind) if rules.functions or rules.bare else None
        declared = found is not None and found[0] == "function" and (f.header[found[5] - 1][0] in rules.functions if found[5] else False)
        if declared or (found is not None and found[0] == "function" and found[4] and "func" in rules.functions):
            walk.enter("function", "function", found[2], found[3], found[4])
            own = [c for c in f.calls if c[2] != found[5]]
            for name, at, _ in own:
                walk.call(name, at)
            walk.leave(line)
        elif found is not None and found[0] == "class" and found[1] not in _HOLDERS and language in ("rust", "kotlin", "scala"):
            walk.enter("class", found[1], found[2], found[3])
            walk.leave(line)
        else:
            bodiless = walk.open[-1].kind in rules.bare and found is not None and found[0] == "function"
            for name, at, place in f.calls:
                if not (bodiless and place == found[5]):
                    walk.call(name, at)
        f.header, f.calls = [], []

    before, last = None, 1
    for k, t in enumerate(stream):
        f = frames[-1]
        if t.kind == "note":
            walk.open[-1].notes.append((t.value, t.line))
            continue
        if t.kind == "line":
            tail = f.header[-1][0] if f.header else ""
            if rules.lines and f.depth == 0 and f.header and tail not in ("=", ",", "=>", "->", ":", ".", "<", "&", "?") and tail not in rules.functions | rules.classes and follows[k] not in ("{", ".", "=", "=>", "->", ":", "?", "where", "throws", "else"):
                statement(last)
            continue
        last = t.line
        if t.kind == "name":
            if f.depth == 0:
                f.header.append((t.value, t.line, ""))
            elif f.depth == 1 and f.header:
                f.header[-1] = (f.header[-1][0], f.header[-1][1], t.value)
        elif t.value in "([":
            if t.value == "(" and before is not None and before.kind == "name" and before.value not in CONTROL:
                f.calls.append((before.value, before.line, len(f.header) - 1 if f.depth == 0 else -1))
            if f.depth == 0 and t.value == "(":
                f.header.append(("(", t.line, ""))
            f.depth += 1
        elif t.value in ")]":
            f.depth = max(0, f.depth - 1)
        elif t.value == "{":
            found = _opening(f.header, rules, walk.open[-1].kind) if f.depth == 0 else None
            if f.depth == 0:
                for name, at, place in f.calls:
                    if found is None or place != found[5]:
                        walk.call(name, at)
                f.header, f.calls = [], []
            if found:
                walk.enter(found[0], found[1], found[2], found[3], found[4])
            frames.append(Frame(opened=found is not None))
        elif t.value == "}":
            statement(t.line)
            if len(frames) > 1:
                if frames.pop().opened:
                    walk.leave(t.line)
        elif t.value == ";":
            if f.depth == 0:
                statement(t.line)
        elif f.depth == 0:
            f.header.append((t.value, t.line, ""))
        before = t
    while len(frames) > 1:
        statement(last)
        frames.pop()
    statement(last)
    return walk.finish(last)


def scopes(path: str, text: str | None) -> list[Scope]:
    """All scopes of a file, itself among them; none if its language is unknown."""
    language = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if language is None:
        return []
    return indented(path, text or "") if language == "python" else braced(path, text or "", language)


SCHEMA = "file_path string, kind string, element_type string, name string, qualified_name string, parent_qualified string, line_start int, line_end int, detail string"


def scan(files: DataFrame) -> DataFrame:
    """files (path, text) -> a row for each element (kind 'element') and call (kind 'call': qualified_name is the caller, name the callee) and note (kind 'note': its scope, its mark, and the detail that it says)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for s in scopes(path or "", text):
                    if s.kind != "file" and s.element:
                        rows.append((path, "element", s.element, s.name, s.qualified, s.parent, s.line, s.end, None))
                    rows += [(path, "call", None, name, s.qualified, None, line, line, None) for name, line in s.calls]
                    rows += [(path, "note", None, said.split(" ", 1)[0], s.qualified, None, line, line, said.split(" ", 1)[1]) for said, line in s.notes]
                if rows:
                    kinds = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def signatures(files: DataFrame) -> DataFrame:
    """J: files (path, text) -> path and outline: the lines on which elements begin, each with its number and indented by its depth; files without elements have an empty one."""

    def outline(path: str | None, text: str | None) -> str:
        lines, out = (text or "").split("\n"), []
        for s in scopes(path or "", text):
            if s.kind != "file" and s.element:
                depth = s.qualified.count("::") - 1
                out.append(f"{s.line}: {'  ' * depth}{lines[s.line - 1].strip().rstrip('{:').rstrip()}")
        return "\n".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [outline(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "outline"])

    return files.select("path", "text").mapInArrow(run, "path string, outline string")


def elements(found: DataFrame) -> DataFrame:
    """The elements among what ``scan`` found."""
    return found.where("kind = 'element'").drop("kind", "detail")


def rationale_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes among what ``scan`` found as nodes, and explained_by edges from their scopes."""
    notes = found.where("kind = 'note'").withColumn("node", F.concat(F.col("file_path"), F.lit("::note#L"), F.col("line_start").cast("string"))).dropDuplicates(["node"])
    nodes = notes.select(F.col("node").alias("qualified_name"), F.lit("rationale").alias("element_type"), "name", "file_path", "line_start", "detail")
    return nodes, notes.select(F.col("qualified_name").alias("source_qualified"), F.col("node").alias("target_qualified"), F.lit("explained_by").alias("rel_type"))


#: Rows of what ``scan`` found in one part of the joins of ``resolved_calls``, about.
PART_ROWS = 200_000


def calls(found: DataFrame, noise: frozenset[str] = NOISE) -> DataFrame:
    """The calls edges, each once, to names that are not resolved yet; names of one letter and ``noise`` go."""
    return _sites(_quiet(found, noise)).withColumn("target_qualified", F.concat(F.lit("__unresolved__"), "name"))


def _quiet(found: DataFrame, noise: frozenset[str]) -> DataFrame:
    rows = found.where("kind = 'call'").where(F.length("name") > 1)
    return rows.where(~F.col("name").isin(sorted(noise))) if noise else rows


def _sites(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("qualified_name").alias("source_qualified"), "name", "file_path").agg(F.min("line_start").alias("line"), F.count("*").alias("n_sites"))


def resolved_calls(found: DataFrame, noise: frozenset[str] = NOISE, folder: str | None = None) -> DataFrame:
    """Callees looked up by name: in the caller's file (the first definition), or else where only one file defines it.

    With a new ``folder`` that driver and executors share, what was found is
    written there first: files are scanned once, and by the count of rows each
    task of the joins gets about ``PART_ROWS``, however many there are.
    """
    deal = lambda rows, *keys: rows
    if folder:
        found.where("kind IN ('call', 'element')").write.parquet(folder)
        found = found.sparkSession.read.schema(found.schema).parquet(folder)
        parts = -(-found.count() // PART_ROWS) or 1
        deal = lambda rows, *keys: rows.repartition(parts, *keys)
    edges = _sites(deal(_quiet(found, noise).select("qualified_name", "name", "file_path", "line_start"), "name", "file_path"))
    defined = elements(found).where(F.col("element_type").isin("function", "method")).select("name", "file_path", "qualified_name", "line_start")
    w = Window.partitionBy("name", "file_path").orderBy("line_start", "qualified_name")
    here = deal(defined, "name", "file_path").withColumn("k", F.row_number().over(w)).where("k = 1").select("name", "file_path", F.col("qualified_name").alias("near"))
    alone = deal(defined.select("name", "qualified_name"), "name").groupBy("name").agg(F.min("qualified_name").alias("far"), F.count("*").alias("n")).where("n = 1").drop("n")
    both = deal(edges.join(here, ["name", "file_path"], "left").drop("file_path"), "name").join(alone, "name", "left")
    method = F.when(F.col("near").isNotNull(), "name_file_hint").when(F.col("far").isNotNull(), "name").otherwise("unresolved")
    target = F.coalesce("near", "far", F.concat(F.lit("__unresolved__"), "name"))
    return both.select("source_qualified", target.alias("target_qualified"), F.lit("calls").alias("rel_type"), method.alias("resolution_method"), "line", "n_sites")
