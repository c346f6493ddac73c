"""A small Datalog dialect compiled to DataFrame operations (rows A1-A36).

``?[head] := *relation[a, b, _], filters :order -x :limit n`` and its
variants: literals and attribute names in atoms, several atoms joined on the
names they share, negated atoms, count and count DISTINCT, k-nearest
neighbours, and the writing forms, which return the table's new content. The
text is parsed by recursive descent; Catalyst plans the rest.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITES = (":put", ":rm", ":delete", ":create", ":replace", ":update")
NOTHING = ("::index", "::hnsw", ":create", ":replace", "PRAGMA", "VACUUM", "query_cache")
#: Columns that identify a row of keyed relations; a relation without them is a bag.
KEYS = {"knowledge_entries": ["id"], "incidents": ["id"], "service_metadata": ["service_name", "env"], "embedding_state": ["qualified_name"], "index_hashes": ["path"]}

_TOKEN = re.compile(r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\d+\.\d+|\d+|\$\w+|[A-Za-z_]\w*|:=|<-|<=|>=|!=|==|=>|::?\w+|[\[\]{}(),*<>=!~+\-/|:.?])")


class DatalogError(ValueError):
    pass


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DatalogError(f"cannot read {text[at:at + 20]!r}")
        out.append(m[1])
        at = m.end()
    return out


@dataclass
class Atom:
    relation: str
    terms: list[tuple[str | None, object]]  # (attribute or None, variable name or ("lit", value) or "_")
    negated: bool = False


@dataclass
class Rule:
    name: str
    head: list[object]
    atoms: list[Atom] = field(default_factory=list)
    filters: list[object] = field(default_factory=list)


def mutable(script: str) -> bool:
    """A2."""
    return any(t in WRITES for t in re.findall(r"(?<!:):[a-z]+", re.sub(r"\"[^\"]*\"|'[^']*'", "", script)))


class Parser:
    def __init__(self, text: str, params: dict) -> None:
        self.t, self.k, self.params = tokens(text), 0, params

    def peek(self, ahead: int = 0) -> str | None:
        return self.t[self.k + ahead] if self.k + ahead < len(self.t) else None

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if got is None or want is not None and got != want:
            raise DatalogError(f"expected {want or 'more'}, found {got}")
        self.k += 1
        return got

    def literal(self) -> object:
        x = self.take()
        if x[0] in "\"'":
            return json.loads(x) if x[0] == '"' else x[1:-1]
        if x[0] == "$":
            return self.params.get(x[1:])
        if x == "-":
            return -self.literal()
        if re.fullmatch(r"\d+", x):
            return int(x)
        if re.fullmatch(r"\d+\.\d+", x):
            return float(x)
        if x == "[":
            out = []
            while self.peek() != "]":
                out.append(self.literal())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return out
        if x in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[x]
        raise DatalogError(f"no literal: {x}")

    def is_literal(self) -> bool:
        x = self.peek()
        return x is not None and (x[0] in "\"'$-[" or x[0].isdigit() or x in ("true", "false", "null"))

    def rule(self) -> Rule:
        name = self.take()
        self.take("[")
        head = []
        while self.peek() != "]":
            head.append(self.head_entry())
            if self.peek() == ",":
                self.take()
        self.take("]")
        out = Rule(name, head)
        if self.peek() == ":=":
            self.take()
            while True:
                self.clause(out)
                if self.peek() in (",", "and"):
                    self.take()
                    continue
                break
        return out

    def head_entry(self) -> object:
        if self.peek() == "count" and self.peek(1) == "(":
            self.k += 2
            distinct = self.peek() == "DISTINCT" and bool(self.take())
            name = self.take()
            self.take(")")
            return ("count", name, distinct)
        return self.take()

    def clause(self, rule: Rule) -> None:
        if self.peek() == "not" and self.peek(1) == "*":
            self.take()
            rule.atoms.append(self.atom(True))
        elif self.peek() == "*":
            rule.atoms.append(self.atom(False))
        elif self.peek(1) == "[" and self.peek() != "?" and re.match(r"[A-Za-z_]", self.peek() or ""):
            rule.atoms.append(self.atom(False))
        else:
            rule.filters.append(self.disjunction())

    def atom(self, negated: bool) -> Atom:
        if self.peek() == "*":
            self.take()
        name, close = self.take(), {"[": "]", "{": "}"}[self.take()]
        terms: list[tuple[str | None, object]] = []
        while self.peek() != close:
            if self.is_literal():
                terms.append((None, ("lit", self.literal())))
            else:
                x = self.take()
                if self.peek() == ":":
                    self.take()
                    terms.append((x, ("lit", self.literal()) if self.is_literal() else self.take()))
                else:
                    terms.append((x if close == "}" else None, x))
            if self.peek() == ",":
                self.take()
        self.take(close)
        return Atom(name, terms, negated)

    def disjunction(self) -> object:
        parts = [self.conjunction()]
        while self.peek() == "or":
            self.take()
            parts.append(self.conjunction())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def conjunction(self) -> object:
        parts = [self.comparison()]
        while self.peek() == "and":
            self.take()
            parts.append(self.comparison())
        return ("and", parts) if len(parts) > 1 else parts[0]

    def comparison(self) -> object:
        if self.peek() == "!":
            self.take()
            return ("not", self.comparison())
        if self.peek() == "(":
            at = self.k
            self.take()
            try:
                inner = self.disjunction()
                self.take(")")
                if self.peek() not in ("=", "==", "!=", "<", "<=", ">", ">=", "+", "-"):
                    return inner
            except DatalogError:
                pass
            self.k = at
        left = self.expression()
        op = self.peek()
        if op == "in":
            self.take()
            values = self.literal()
            values = values[0] if values and isinstance(values[0], list) else values
            return ("in", left, values or [])
        if op in ("=", "==", "!=", "<", "<=", ">", ">="):
            self.take()
            return ("cmp", "=" if op == "==" else op, left, self.expression())
        return left

    def expression(self) -> object:
        left = self.term()
        while self.peek() in ("+", "-", "*", "/"):
            op = self.take()
            left = ("math", op, left, self.term())
        return left

    def term(self) -> object:
        if self.peek() == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        if self.is_literal():
            return ("lit", self.literal())
        name = self.take()
        if self.peek() == "(":
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return ("call", name, args)
        return ("var", name)

    def modifiers(self) -> dict:
        out: dict = {"order": []}
        while self.peek() is not None:
            m = self.take()
            if m in (":limit", ":offset"):
                out[m[1:]] = int(self.literal())
            elif m in (":order", ":sort"):
                while True:
                    down = self.peek() == "-" and bool(self.take())
                    entry = self.head_entry()
                    if self.peek() in ("desc", "asc"):
                        down = self.take() == "desc"
                    out["order"].append((entry, down))
                    if self.peek() != ",":
                        break
                    self.take()
            elif m == ":group":
                self.take("[")
                out["group"] = []
                while self.peek() != "]":
                    out["group"].append(self.take())
                    if self.peek() == ",":
                        self.take()
                self.take("]")
            else:
                raise DatalogError(f"unknown modifier {m}")
        return out


class Database:
    """Named DataFrames with their columns in catalog order."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = dict(tables)

    def query(self, script: str, params: dict | None = None) -> DataFrame:
        """Read-only (A2)."""
        if mutable(script):
            raise DatalogError("this interface only reads")
        return self.run(script, params)

    def run(self, script: str, params: dict | None = None) -> DataFrame:
        """A1: dispatch on the script's beginning; a writing script returns the new table and keeps it."""
        s, params = script.strip(), params or {}
        spark = next(iter(self.tables.values())).sparkSession
        if s == "::relations":
            return spark.createDataFrame([(n, len(d.columns)) for n, d in sorted(self.tables.items())], "name string, arity int")
        if s.startswith((":schema", "::columns")):
            d = self.tables[s.split()[1]]
            return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(d.dtypes)], "position int, column string, type string")
        if s.startswith(NOTHING):
            return spark.createDataFrame([("OK",)], "status string")
        if s.startswith(":delete"):
            m = re.match(r":delete\s+(\w+)\s+where\s+(.*)", s, re.S)
            p = Parser(m[2], params)
            d = self.tables[m[1]]
            self.tables[m[1]] = d.where(~F.coalesce(self._column(p.disjunction(), {c: F.col(c) for c in d.columns}, {}), F.lit(False)))
            return self.tables[m[1]]
        write = re.search(r":(put|rm)\s*(\w*)\s*\{([^}]*)\}\s*$", s)
        if write:
            return self._write(s[: write.start()].strip(), write[1], write[2], write[3], params)
        if s.startswith("~") or re.search(r":=\s*~", s):
            return self._nearest(s, params)
        if not s.startswith("?[") and ":=" not in s:
            return self.sugar(s)
        return self._read(s, params)

    def sugar(self, text: str) -> DataFrame:
        """table[field~'x']:limit n, or a bare word looked for in the elements' names."""
        m = re.fullmatch(r"\s*(\w+)\[(\w+)\s*~\s*'([^']*)'\](?::limit\s+(\d+))?\s*", text)
        if m:
            out = self.tables[m[1]].where(F.col(m[2]).rlike(m[3]))
            return out.orderBy(*out.columns[:1]).limit(int(m[4])) if m[4] else out
        if re.fullmatch(r"[\w.:/-]+", text.strip()):
            return self.tables["code_elements"].where(F.col("name").rlike(re.escape(text.strip())))
        raise DatalogError(f"cannot read {text!r}")

    def _read(self, s: str, params: dict) -> DataFrame:
        p = Parser(s, params)
        rules = []
        if p.peek() == "?":
            rules.append(p.rule())
        else:
            while p.peek() is not None and not p.peek().startswith(":"):
                rules.append(p.rule())
        made: dict[str, DataFrame] = {}
        for r in rules:
            last = r is rules[-1]
            out = self._rule(r, made, p.modifiers() if last else {"order": []})
            made[r.name] = out.distinct() if not last else out
        return made[rules[-1].name]

    def _scan(self, a: Atom, made: dict[str, DataFrame]) -> DataFrame:
        d = made[a.relation] if a.relation in made else self.tables.get(a.relation)
        if d is None:
            raise DatalogError(f"unknown relation {a.relation}")
        names, picked = d.columns, []
        for i, (attribute, term) in enumerate(a.terms):
            column = F.col(attribute if attribute in names else names[i])
            if isinstance(term, tuple):
                d = d.where(column.isNull() if term[1] is None else column == F.lit(term[1]))
            elif term != "_":
                picked.append(column.alias(term))
        return d.select(*picked)

    def _rule(self, r: Rule, made: dict[str, DataFrame], mods: dict) -> DataFrame:
        d: DataFrame | None = None
        for a in (x for x in r.atoms if not x.negated):
            s = self._scan(a, made)
            on = [c for c in s.columns if d is not None and c in d.columns]
            if d is not None and not on:
                raise DatalogError("atoms share no name")
            d = s if d is None else d.join(s, on)
        for a in (x for x in r.atoms if x.negated):
            s = self._scan(a, made)
            on = [c for c in s.columns if d is not None and c in d.columns]
            if not on:
                raise DatalogError("a negated atom shares no name with the others")
            d = d.join(s, on, "left_anti")
        known = {c: F.col(c) for c in d.columns}
        spans: dict[str, Column] = {}
        for f in r.filters:
            if f[0] == "cmp" and f[1] == "=" and f[2][0] == "var" and f[2][1] not in known:
                known[f[2][1]] = spans[f[2][1]] = self._column(f[3], known, {})
            else:
                d = d.where(self._column(f, known, {}))
        for n, c in spans.items():
            d = d.withColumn(n, c)
        tallies = [h for h in r.head if isinstance(h, tuple)]
        name = lambda h: f"count({h[1]})" if isinstance(h, tuple) else h
        if tallies:
            keys = [h for h in r.head if not isinstance(h, tuple)] or mods.get("group", [])
            each = [(F.countDistinct(h[1]) if h[2] else F.count("*") if len(h[1]) == 1 or h[1] == "_" else F.count(h[1])).alias(name(h)) for h in tallies]
            d = d.groupBy(*keys).agg(*each) if keys else d.agg(*each)
        order = [(F.desc if down else F.asc)(f"`{name(e)}`") for e, down in mods["order"]]
        if not order and spans and any(h in spans for h in r.head if isinstance(h, str)):
            order = [F.desc(next(h for h in r.head if isinstance(h, str) and h in spans))]
        if "limit" in mods or "offset" in mods:  # which rows stay depends on the whole row at last
            order += [F.asc(f"`{name(h)}`") for h in r.head]
        d = d.orderBy(*order) if order else d
        d = d.offset(mods["offset"]) if "offset" in mods else d
        d = d.limit(mods["limit"]) if "limit" in mods else d
        return d.select(*(F.col(f"`{name(h)}`") for h in r.head))

    def _column(self, e: object, known: dict[str, Column], _: dict) -> Column:
        kind = e[0]
        go = lambda x: self._column(x, known, _)
        if kind == "var":
            if e[1] not in known:
                raise DatalogError(f"unbound name {e[1]}")
            return known[e[1]]
        if kind == "lit":
            return F.lit(e[1])
        if kind in ("or", "and"):
            return functools.reduce(operator.or_ if kind == "or" else operator.and_, map(go, e[1]))
        if kind == "not":
            return ~go(e[1])
        if kind == "in":
            return go(e[1]).cast("string").isin([str(v) for v in e[2]])
        if kind == "math":
            return {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}[e[1]](go(e[2]), go(e[3]))
        if kind == "cmp":
            if e[3] == ("lit", None):
                return go(e[2]).isNull() if e[1] == "=" else go(e[2]).isNotNull()
            ops = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
            return ops[e[1]](go(e[2]), go(e[3]))
        name, args = e[1], e[2]
        if name == "regex_matches":
            return F.regexp_like(go(args[0]), go(args[1]))
        if name in ("str_includes", "str_contains"):
            return F.contains(go(args[0]), go(args[1]))
        if name == "starts_with":
            return F.startswith(go(args[0]), go(args[1]))
        if name in ("lowercase", "lower"):
            return F.lower(go(args[0]))
        if name in ("uppercase", "upper"):
            return F.upper(go(args[0]))
        raise DatalogError(f"unknown function {name}")

    def _nearest(self, s: str, params: dict) -> DataFrame:
        """A24."""
        from ..operators.vectors import l2

        m = re.search(r"~(\w+):\w+\s*\{([^|]*)\|(.*)\}", s, re.S)
        q = re.search(r"query:\s*(?:vec\()?\s*(\[[^\]]*\]|\$\w+)", m[3])[1]
        vector = params[q[1:]] if q[0] == "$" else json.loads(q)
        k = int((re.search(r"\bk:\s*(\d+)", m[3]) or [0, 50])[1])
        name = (re.search(r"bind_distance:\s*(\w+)", m[3]) or [0, "distance"])[1]
        d = self.tables[m[1]]
        key, vec = d.columns[0], next(c for c, t in d.dtypes if t.startswith("array"))
        return d.select(F.col(key), l2(F.col(vec), F.array(*(F.lit(float(x)) for x in vector))).alias(name)).orderBy(name, key).limit(k)

    def _write(self, body: str, verb: str, relation: str, columns: str, params: dict) -> DataFrame:
        """Rows given as lists, a parameter, objects or a rule are appended, upserted by key, or removed."""
        keys, _, values = columns.partition("=>")
        names = [c.strip() for c in (keys + "," + values).split(",") if c.strip()]
        if not relation:
            relation = next((n for n, d in self.tables.items() if set(names) <= set(d.columns)), "")
        d = self.tables[relation]
        m = re.match(r"\?\[([^\]]*)\]\s*<-\s*(.*)", body, re.S)
        if m:
            head = [c.strip() for c in m[1].split(",")]
            rows = Parser(m[2], params).literal()
            rows = [[r.get(c) for c in head] for r in rows] if rows and isinstance(rows[0], dict) else rows
            kinds = dict(d.dtypes)
            new = d.sparkSession.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` {kinds[c]}" for c in head))
        else:
            new = self._read(body, params).toDF(*names)
        if verb == "rm":
            self.tables[relation] = d.join(new.select(*names).distinct(), names, "left_anti").select(*d.columns)
            return self.tables[relation]
        key = [c.strip() for c in keys.split(",") if c.strip()] if values else KEYS.get(relation)
        if key and m:  # of rows given with one key the last stays
            last = {tuple(r[head.index(c)] for c in key): tuple(r) for r in rows}
            new = d.sparkSession.createDataFrame(list(last.values()), new.schema)
        elif key:
            new = new.groupBy(*key).agg(F.max(F.struct(*(c for c in new.columns if c not in key))).alias("x")).select(*key, "x.*")
        new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in d.dtypes))
        old = d.join(new.select(*key), key, "left_anti").select(*d.columns) if key else d
        self.tables[relation] = old.unionByName(new)
        return self.tables[relation]
