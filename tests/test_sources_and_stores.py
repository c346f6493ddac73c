"""Scoped extraction, structured sources, ignore files, stored tables, vector search and components, on odd cases and against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import changes, documents, scopes, services, structured, symbols
from graphloom.operators import ann, graphs, layout, pack, traversal, vectors
from graphloom.operators.store import KeyedTable, reindex
from graphloom.sources import ontology, walk

NESTED = {
    "a.py": (
        '"""def no(): {"""\nimport os\n\n@wrap(1)\nclass A(Base):\n    x = start()\n    def f(self, y=default(2)):  # def g(:\n        if y:\n            def g():\n                return h(\n                    "}")\n        return (g() +\n    k())\n\n    async def m(self): return self.f()\n\ndef last(): pass\nlast()\n',
        [("A", "class", None, 5, 15), ("A::f", "method", "A", 7, 13), ("A::f::g", "function", "A::f", 9, 11), ("A::m", "method", "A", 15, 15), ("last", "function", None, 17, 17)],
        {("", "wrap"), ("", "start"), ("A::f", "default"), ("A::f::g", "h"), ("A::f", "g"), ("A::f", "k"), ("A::m", "f"), ("", "last")},
    ),
    "b.java": (
        "package p; // class No {\nimport q.*;\n@Named(\"x{\")\npublic class A<T extends B<T>> implements C {\n  /* void no() { */\n  int x = start();\n  abstract void none(int a);\n  @Over public <U> List<U> f(int y) throws E, F {\n    for (int i = 0; i < n(y); i++) { g(i); }\n    run(() -> { h('{'); });\n    return new D(z());\n  }\n  static class In { In(int q) { super(q); w(); } }\n}\ninterface J { void m(); }\n",
        [("A", "class", None, 4, 14), ("A::f", "method", "A", 8, 12), ("A::In", "class", "A", 13, 13), ("A::In::In", "method", "A::In", 13, 13), ("J", "interface", None, 15, 15)],
        {("", "start"), ("A::f", "n"), ("A::f", "g"), ("A::f", "run"), ("A::f", "h"), ("A::f", "D"), ("A::f", "z"), ("A::In::In", "w")},
    ),
    "c.go": (
        "package c\n\nimport \"fmt\"\n\ntype S struct {\n\tn int\n}\n\nfunc (s *S) M(a int) (int, error) {\n\t/* func no() { */ x := `}\n func no2() {`\n\tf := func(b int) int { return g(b) }\n\tif y := s.k(a); y > 0 {\n\t\treturn f(y), nil\n\t}\n\treturn h(a), fmt.Errorf(\"{\")\n}\n\nfunc G[T any](v T) T { return v }\n",
        [("S", "struct", None, 5, 7), ("S::M", "method", "S", 9, 17), ("G", "function", None, 19, 19)],
        {("S::M", "g"), ("S::M", "k"), ("S::M", "f"), ("S::M", "h"), ("S::M", "Errorf")},
    ),
    "d.ts": (
        "// function no() {\nexport class A extends B {\n  private x = 1\n  m(a: string): void {\n    const t = `${'}'} function no() {`\n    this.n(a)\n    if (a) { p(a) }\n  }\n  async n(a) { await q(a); }\n}\nexport const f = async (x) => {\n  return g(x)\n}\nfunction h(cb) {\n  return cb(function () { k() }, () => { l() })\n}\n",
        [("A", "class", None, 2, 10), ("A::m", "method", "A", 4, 8), ("A::n", "method", "A", 9, 9), ("f", "function", None, 11, 13), ("h", "function", None, 14, 16)],
        {("A::m", "n"), ("A::m", "p"), ("A::n", "q"), ("f", "g"), ("h", "cb"), ("h", "k"), ("h", "l")},
    ),
    "e.rs": (
        "/* a /* fn no() { */ fn no2() { */\nuse x::y;\n#[derive(Debug)]\npub struct S<'a> { n: &'a str }\nimpl<'a> Tr for S<'a> {\n    fn f(&self, c: char) -> u8 {\n        let q = r#\"fn no3() { \"\"#;\n        match c { '{' => g(1), _ => self.h(2) }\n    }\n}\ntrait Tr { fn f(&self, c: char) -> u8; }\npub async fn top() where A: B { k(); fn inner() { l() } inner() }\n",
        [("S", "struct", None, 4, 4), ("S::f", "method", "S", 6, 9), ("Tr", "trait", None, 11, 11), ("Tr::f", "method", "Tr", 11, 11), ("top", "function", None, 12, 12), ("top::inner", "function", "top", 12, 12)],
        {("S::f", "g"), ("S::f", "h"), ("top", "k"), ("top::inner", "l"), ("top", "inner")},
    ),
    "f.kt": (
        "package f\nclass A(val x: Int) : B() {\n    fun one(y: Int) = two(y)\n    fun two(y: Int): Int {\n        list.each { three(it) }\n        return 1\n    }\n}\nobject O { fun go() { four() } }\nfun top() = five()\n",
        [("A", "class", None, 2, 8), ("A::one", "method", "A", 3, 3), ("A::two", "method", "A", 4, 7), ("O", "object", None, 9, 9), ("O::go", "method", "O", 9, 9), ("top", "function", None, 10, 10)],
        {("A::one", "two"), ("A::two", "three"), ("O::go", "four"), ("top", "five")},
    ),
    "g.cpp": (
        "#include <a.h>\n#define NO(x) { x\nnamespace n {\nclass A : public B {\n public:\n  A(int x) : b_(x), c_(y(x)) { z(); }\n  int m() const override { return k(1); }\n  void decl(int);\n};\n}\nint n::A::out(int q) {\n  if (q) { while (w(q)) { v(); } }\n  return 0;\n}\n",
        [("n::A", "class", "n", 4, 9), ("n::A::A", "method", "n::A", 6, 6), ("n::A::m", "method", "n::A", 7, 7), ("A::out", "method", "A", 11, 14)],
        {("n::A::A", "z"), ("n::A::m", "k"), ("A::out", "w"), ("A::out", "v")},
    ),
}


@pytest.mark.parametrize("path", sorted(NESTED))
def test_scopes_of_nested_and_commented_sources(path):
    text, wanted, called = NESTED[path]
    found = scopes.scopes(path, text)
    full = lambda q: f"{path}::{q}" if q else path
    got = [(s.qualified, s.element, s.parent, s.line, s.end) for s in found if s.kind != "file" and s.element]
    assert sorted(got) == sorted((full(q), e, full(p) if p else None, a, b) for q, e, p, a, b in wanted)
    calls = {(s.qualified, name) for s in found for name, _ in s.calls}
    assert {(full(q), n) for q, n in called} <= calls
    if path not in ("g.cpp", "b.java", "f.kt"):  # there initialisers, annotations and base classes look like calls too
        assert calls == {(full(q), n) for q, n in called}


def test_scopes_survive_any_text(spark):
    rng = random.Random(4)
    parts = ["{", "}", "(", ")", "def f", "class A", "fn g", "func", "function h(", "=>", "'", '"', "`", "/*", "*/", "//", "\n", "  ", ";", "impl", "x(", "é", "#", "r#\"", "type T struct"]
    for ext in sorted(scopes.EXTENSIONS):
        for _ in range(40):
            text = "".join(rng.choices(parts, k=rng.randrange(60)))
            for s in scopes.scopes(f"x.{ext}", text):
                assert 1 <= s.line <= s.end <= text.count("\n") + 1
    files = spark.createDataFrame([("a.py", None), ("b.txt", "def f(): g()"), (None, "x"), ("c.py", "")], "path string, text string")
    assert scopes.scan(files).collect() == []
    long = "class A:\n" + "".join(f"    def f{k}(self): g{k}()\n" for k in range(30_000))
    assert len(scopes.scopes("a.py", long)) == 30_002
    deep = "fn a() {" * 3000
    assert len(scopes.scopes("a.rs", deep)) == 3001


def test_resolved_calls_prefer_the_callers_file(spark):
    files = spark.createDataFrame([("a.py", "def f(): gg(); hh(); only(); none(); x()\ndef gg(): pass"), ("b.py", "def gg(): pass\ndef hh(): pass\ndef only(): pass"), ("c.py", "def hh(): len(1)")], "path string, text string")
    found = {(r["source_qualified"], r["target_qualified"]): r["resolution_method"] for r in scopes.resolved_calls(scopes.scan(files)).collect()}
    assert found == {("a.py::f", "a.py::gg"): "name_file_hint", ("a.py::f", "__unresolved__hh"): "unresolved", ("a.py::f", "b.py::only"): "name", ("a.py::f", "__unresolved__none"): "unresolved"}


def test_yaml_scalars():
    text = "a: 1 # one\nb:\n  - x\n  - y: 2\n    z: 'it''s'\n  -\n    w: \"q\\\"\"\nbase: &base\n  k: 1\n  m: [p, \"q, r\", s]\nuse:\n  <<: *base\n  k: 3\ntext: |\n  one\n    two\n\n  three\nfold: >-\n  a\n  b\nlist:\n- - 1\n  - 2\nurl: http://x:80/y\nempty:\n"
    found = {".".join(k): v for k, v, _ in structured.yaml_scalars(text)}
    assert found == {
        "a": "1", "b.0": "x", "b.1.y": "2", "b.1.z": "it's", "b.2.w": 'q"', "base.k": "1", "base.m.0": "p", "base.m.1": "q, r", "base.m.2": "s", "use.k": "3", "use.m.0": "p", "use.m.1": "q, r", "use.m.2": "s",
        "text": "one\n  two\n\nthree", "fold": "a b", "list.0.0": "1", "list.0.1": "2", "url": "http://x:80/y",
    }


def test_xml_up_to_a_fault():
    assert [(r[3], r[1], r[5]) for r in structured.xml_elements("<a><b x='1'>t<c/></b><d></a>")] == [("a", 0, ""), ("b", 1, "t"), ("c", 2, ""), ("d", 1, "")]
    bomb = '<!DOCTYPE a [<!ENTITY b "bbbb"><!ENTITY c "&b;&b;">]><a>&c;</a>'
    assert structured.xml_elements(bomb) == [] and structured.xml_elements("") == []


def test_layouts_and_nested_blocks(spark):
    files = spark.createDataFrame([("l.xml", '<root xmlns:android="u"><org.My android:id="@+id/one"/><include layout="@layout/two"/><T android:id="@id/three"/></root>')], "path string, text string")
    views, edges = structured.layouts(files)
    assert {(r["name"], r["view_class"]) for r in views.collect()} == {("one", "org.My"), ("three", "T")}
    assert {tuple(r) for r in edges.collect()} == {("l.xml", "org.My", "uses_view"), ("l.xml", "two", "includes_layout")}
    rows = structured.blocks_of('a "b" "c" {\n x = <<EOT\n y { z\nEOT\n d { e = [1,\n 2] } # }\n}\nf(g)\n')
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("block", "a", ["b", "c"], []), ("statement", "x", [], ["a b c"]), ("block", "d", [], ["a b c"]), ("statement", "e", ["1", "2"], ["a b c", "d"]), ("statement", "f", ["g"], [])]


def test_walk_heeds_ignore_files(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\n!keep.log\n/top.py\nsecret/\n**/deep/*.tmp\n# no\nbuild*/\n\\#odd.py\n", "top.py": "", "sub/top.py": "", "a.log": "", "keep.log": "", "secret/x.py": "", "#odd.py": "",
        "sub/.gitignore": "!*.log\nkeep.log\ninner/only.py\n", "sub/b.log": "", "sub/keep.log": "", "sub/inner/only.py": "", "sub/inner/other.py": "", "x/deep/f.tmp": "", "x/deep/f.py": "", "deep/g.tmp": "",
        "node_modules/m.py": "", "build2/n.py": "", "sub/secret": "", "big.py": "x" * 3000, "[a].py": "", "q.md": "",
    }
    for name, text in tree.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    found = walk.walk(spark, str(tmp_path), max_bytes=2000)
    assert {r["path"] for r in found.collect()} == {".gitignore", "keep.log", "sub/top.py", "sub/.gitignore", "sub/b.log", "sub/inner/other.py", "x/deep/f.py", "sub/secret", "[a].py", "q.md"}
    assert {r["path"] for r in walk.walk(spark, f"file://{tmp_path}", extensions=["md", "LOG"]).collect()} == {"keep.log", "sub/b.log", "q.md"}
    texts = {r["path"]: r["text"] for r in walk.read_texts(found, str(tmp_path)).collect()}
    assert texts == {k: tree[k] for k in texts} and len(texts) == 10


def test_stored_table_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable.create(spark, f"file://{tmp_path}/t", "k long, v string, at long", ["k"], "at", buckets=8)
    assert t.read().collect() == [] and not t.upsert(t.read())
    rows = lambda *r: spark.createDataFrame(r, "k long, v string, at long")
    t.upsert(spark.range(200).selectExpr("id AS k", "'a' AS v", "1L AS at"))
    before = t.manifest()
    t.upsert(rows((5, "b", 2), (5, "c", 3), (5, "d", 3), (6, "old", 0), (None, "n", 1)))
    after = t.manifest()
    assert 1 <= sum(before.held.get(b) != after.held[b] for b in after.held) <= 3
    found = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(found) == 201 and found[5] in "cd" and found[6] == "a" and found[None] == "n"
    assert [r["v"] for r in t.get(k=5).collect()] == [found[5]] and [r["v"] for r in t.get(k=None).collect()] == ["n"]
    t.delete(rows((7, "", 0), (None, "", 0), (999, "", 0)))
    assert t.read().count() == 199 and t.get(k=None).collect() == []
    t.delete_where(F.col("k") < 100)
    assert t.read().count() == 100 and t.read(before.number).count() == 200
    with pytest.raises(Exception):  # another writer was first
        KeyedTable._publish(t, before)
    gone = t.vacuum()
    assert gone and t.read().count() == 100 and len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 1
    t.replace(rows((1, "x", 1), (1, "y", 2)))
    assert [tuple(r) for r in t.read().collect()] == [(1, "y", 2)]
    with pytest.raises(ValueError):
        t.upsert(rows((1, "x", 1)).withColumnRenamed("v", "w"))


def test_stored_table_as_a_streaming_sink(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", "k long, v string, at long", ["k"], "at", buckets=4)
    schema = "k long, v string, at long, kind string"
    batch = lambda *r: spark.createDataFrame(r, schema)
    put = t.sink("feed", "kind")
    put(batch((1, "a", 1, "put"), (2, "b", 1, "put")), 7)  # a stream may begin at any number
    number = t.manifest().number
    put(batch((1, "zzz", 99, "put")), 7)  # delivered again
    put(batch((1, "zzz", 99, "put")), 3)
    assert t.manifest().number == number
    put(batch((1, "c", 2, "put"), (1, None, 3, "delete"), (2, None, 2, "delete"), (2, "d", 3, "put")), 8)
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {(2, "d")}
    src = tmp_path / "in"
    batch((3, "e", 1, "put"), (3, "f", 2, "put")).coalesce(1).write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(t.sink("files", "kind")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert stream.awaitTermination(120)
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {(2, "d"), (3, "f")} and t.manifest().streams["feed"] == 8


def test_reindex_of_changed_files(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/e", "qualified_name string, file_path string, at long", ["qualified_name"], "at", buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "qualified_name string, file_path string, at long")
    t.upsert(rows(("a::f", "a", 1), ("a::g", "a", 1), ("b::f", "b", 1)))
    reindex(t, rows(("a::f", "a", 2), ("a::h", "a", 2)), rows(("", "a", 0)))
    assert {(r[0], r[2]) for r in t.read().collect()} == {("a::f", 2), ("a::h", 2), ("b::f", 1)}


def test_vector_search_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(np.float32)
    x[100:1100] = x[100]  # a third of all are one vector
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, []), (None, x[0].tolist())], "vec_id long, embedding array<float>").repartition(6)
    asked = rows.where("vec_id % 100 = 0 AND vec_id < 3000").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = ann.exact_nearest(rows, asked, 10)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in exact.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(0, 3000, 100))
    for q, found in got.items():
        score = np.round(unit[q] @ unit.T, 6)
        want = np.lexsort((np.arange(3000), -score))[:10]
        assert np.allclose(score[[v for _, v in sorted(found)]], score[want], atol=2e-6)
    index = ann.build_index(rows, str(tmp_path))
    coded = spark.read.parquet(index.path)
    assert coded.selectExpr("sum(length(ids) / 8)").first()[0] == 3000  # every row is in the index
    found = ann.approximate_nearest(index, rows, asked, 10)
    assert vectors.recall(found, exact, 10).first()[0] >= 0.9


def test_call_resolution_in_parts_by_the_count_of_rows(spark, tmp_path, monkeypatch):
    body = "def first_{k}(n):\n    return twin(n) + only_{f}(n) + first_{k}(n) + away_{k}(n)\n\n\ndef twin(n):\n    return n\n\n\ndef only_{k}(n):\n    return n\n"
    files = spark.createDataFrame([(f"src/m{k}.py", body.format(k=k, f=(k + 1) % 40)) for k in range(40)], "path string, text string").repartition(3)
    want = sorted(map(tuple, scopes.resolved_calls(scopes.scan(files)).collect()))
    monkeypatch.setattr(scopes, "PART_ROWS", 20)
    found = scopes.resolved_calls(scopes.scan(files), folder=str(tmp_path / "found"))
    assert sorted(map(tuple, found.collect())) == want and len(want) == 160
    n = spark.read.parquet(str(tmp_path / "found")).count()
    assert n == 280 and found.rdd.getNumPartitions() == 14
    none = scopes.resolved_calls(scopes.scan(files.where("false")), folder=str(tmp_path / "none"))
    assert none.columns == found.columns and none.count() == 0


def test_index_of_vectors_without_clusters(spark, tmp_path):
    x = np.random.default_rng(12).normal(size=(2500, 32)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ann.build_index(rows, str(tmp_path))
    found = ann.approximate_nearest(index, rows, asked, 10)
    assert vectors.recall(found, ann.exact_nearest(rows, asked, 10), 10).first()[0] >= 0.9
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= ann.BATCH_BYTES
    held, ann.HELD_BYTES = ann.HELD_BYTES, 8 * 50 * 7
    try:  # seven rows at a time
        near, far = ann._nearest(x[:100].astype(float), x[100:150].astype(float), 3)
    finally:
        ann.HELD_BYTES = held
    whole = (x[100:150].astype(float) ** 2).sum(axis=1)[None] - 2 * x[:100].astype(float) @ x[100:150].astype(float).T
    assert (near == np.argsort(whole, axis=1, kind="stable")[:, :3]).all() and np.allclose(far, whole.min(axis=1))


def test_components_against_union_find(spark):
    rng = random.Random(3)
    n = 400
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(230)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)] + [(800, 800)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for big in (0, 1 << 61):
        R = spark.createDataFrame([(big + a, big + b, "x", 1.0) for a, b in pairs], "source_qualified long, target_qualified long, rel_type string, confidence double")
        found = {r["node"] - big: r["component"] - big for r in graphs.connected_components(R).collect()}
        assert found == {k: find(k) for a, b in pairs if a != b for k in (a, b)}
    assert graphs.connected_components(R.where("false")).collect() == []


def test_symbols_are_reversible(spark):
    rng = random.Random(9)
    words = ["identifier_one", "AnotherName", "A", "B", "été_long_mot", "short", "x1234567", "naïveWord", "AA", "9digits9", "_private_thing", "a.b", "{", "\n"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", ".", "\n"]) for _ in range(rng.choice([0, 5, 80, 400]))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = symbols.restored(symbols.with_symbols(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["full_text"] == (texts[r["doc_id"]] or "")
        assert all(len(w) >= 6 and w.isascii() for w in r["symbols"].values())
    assert sum(len(r["short_text"]) for r in rows) < 0.9 * sum(len(t or "") for t in texts)
    assert symbols.symbol_map("A words_words words_words words_words words_words") == {"B": "words_words"}
    with pytest.raises(ValueError):
        symbols.with_symbols(docs.withColumn("symbols", F.lit(1)))


def test_dense_lines_by_their_own_distribution(spark):
    flat, rich = "a" * 40, "The quick brown fox jumps over 13 lazy dogs"
    text = "\n".join(["fn x() {", flat, "", "", *(rich[k:] + rich[:k] + str(k) for k in range(9)), "}"])
    kept = symbols.dense_lines(text).split("\n")
    assert flat not in kept and len(kept) > 6 and kept[0] == "fn x() {" and kept[-1] == "}" and kept.count("") == 1
    rng = random.Random(1)
    noise = "\n".join("".join(chr(rng.randrange(33, 127)) for _ in range(60)) for _ in range(50))
    assert symbols.compressed_share(noise) > 0.6 and len(symbols.dense_lines(noise).split("\n")) == 45
    for t in (text, noise, "", "one"):
        lines = [x for x in t.split("\n") if x.strip()]
        scored = sorted(symbols.line_entropy(x) for x in lines)
        share = next(p for most, p in symbols.PRUNED if symbols.compressed_share(t) < most)
        place = share * (len(scored) - 1)
        least = scored[int(place)] + (place - int(place)) * (scored[min(int(place) + 1, len(scored) - 1)] - scored[int(place)]) if scored else 0
        dropped = [x for x in lines if symbols.line_entropy(x) < least - 1e-12 and x not in ("fn x() {", "}")]
        assert [x for x in symbols.dense_lines(t).split("\n") if x.strip()] == [x for x in lines if x not in dropped]
    docs = spark.createDataFrame([(1, text, 5), (2, None, 6)], "doc_id long, text string, n long")
    assert {r["doc_id"]: (r["n"], r["dense_text"]) for r in symbols.with_dense_text(docs).collect()} == {1: (5, "\n".join(kept)), 2: (6, "")}


def exact_forces(at, k):
    apart = at[:, None] - at[None]
    square = (apart**2).sum(axis=2)
    np.fill_diagonal(square, 1)
    return (k * k * apart / square[:, :, None]).sum(axis=1)


@pytest.mark.parametrize("dims", [2, 3])
def test_layout_against_exact_forces(spark, dims):
    rng = random.Random(dims)
    n = 200
    pairs = [(k, rng.randrange(k)) for k in range(1, n)] + [(0, k) for k in range(1, 40)]  # a tree and a hub
    R = spark.createDataFrame([(f"n{a}", f"n{b}", "x", 1.0) for a, b in pairs] + [("alone", "alone", "x", 1.0)], "source_qualified string, target_qualified string, rel_type string, confidence double")
    names = [f"x{d}" for d in range(dims)]
    k = (1 / (n + 1)) ** (1 / dims)

    def energy(rows):
        at = {r["node"]: np.array([r[x] for x in names]) for r in rows}
        every = np.array(list(at.values()))
        distance = np.sqrt(((every[:, None] - every[None]) ** 2).sum(axis=2))[np.triu_indices(len(every), 1)]
        ends = {tuple(sorted((f"n{a}", f"n{b}"))) for a, b in pairs}
        return sum(np.linalg.norm(at[a] - at[b]) ** 3 / (3 * k) for a, b in ends) - k * k * np.log(distance).sum()

    first = layout.force_layout(R, dims, rounds=0)
    rows = first.collect()
    assert len(rows) == n + 1
    found = {r["node"]: np.array([r[f"f{d}"] for d in range(dims)]) for r in layout.repulsion(first, dims, k, 4).collect()}
    want = exact_forces(np.array([[r[x] for x in names] for r in rows]), k)
    got = np.array([found[r["node"]] for r in rows])
    assert (got * want).sum() / np.sqrt((got**2).sum() * (want**2).sum()) > 0.9
    assert energy(layout.force_layout(R, dims, rounds=5).collect()) < energy(rows)
    assert layout.force_layout(R.where("false"), dims).collect() == []


def test_embedder_against_plain_sums(spark):
    import xxhash

    texts = ["One two one", "", None, "ünï çode two", "two " * 500]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, blob string")
    for r in vectors.embedded(rows, "blob", 16).collect():
        v = np.zeros(16)
        for w in (texts[r["k"]] or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            v[h % 16] += 1 if h >> 63 else -1
        assert np.allclose(r["embedding"], v / max(np.linalg.norm(v), 1e-12), atol=1e-6)


def test_notes_belong_to_their_scope():
    text = "# NOTE: top\nclass A:\n    # WHY not\n    def f(self):\n        x = 1  # HACK: here\n        '# FIXME no'\n        # FIXME: last\n    # XXX after f\n# NOTE end\n"
    found = {(s.qualified, said, line) for s in scopes.scopes("a.py", text) for said, line in s.notes}
    assert found == {("a.py", "NOTE top", 1), ("a.py::A", "WHY not", 3), ("a.py::A::f", "HACK here", 5), ("a.py::A::f", "FIXME last", 7), ("a.py::A", "XXX after f", 8), ("a.py", "NOTE end", 9)}
    text = "/* NOTE: one\n   FIXME two */\nfn f() { // HACK three\n  g(\"// XXX no\");\n}\n"
    found = {(s.qualified, said, line) for s in scopes.scopes("b.rs", text) for said, line in s.notes}
    assert found == {("b.rs", "NOTE one", 1), ("b.rs", "FIXME two", 2), ("b.rs::f", "HACK three", 3)}


def test_extractors_take_null_and_empty_texts(spark):
    schema = "path string, text string, lang string"
    for rows in ([], [("a/b.py", None, "x"), ("c.yaml", "", "y"), ("d.xml", "<a", "z"), ("e.sql", "create table", "q")]):
        files = spark.createDataFrame(rows, schema)
        frames = [scopes.scan(files), scopes.resolved_calls(scopes.scan(files)), *scopes.rationale_graph(scopes.scan(files)), *structured.android_manifest(files), *structured.layouts(files), structured.maven_dependencies(files)]
        frames += [*structured.terraform(files), structured.gradle(files), *structured.workflows(files), *ontology.read_ontology(files), *services.route_graph(files), services.service_calls(files), services.table_edges(files)]
        assert [f.count() for f in frames] == [0] * len(frames)
        nodes, edges = documents.document_graph(files)
        assert nodes.count() == len(rows) and edges.count() == 0
        assert documents.requirement_graph(files)[0].count() == 0
        assert scopes.signatures(files).where("outline = ''").count() == len(rows)
    said = spark.createDataFrame([(None, 1, "user", "we decided on a.py"), (1, 2, "user", None), (1, 3, "user", "we decided on x/y.py and more")], "conv_id long, turn long, role string, text string")
    nodes, edges = documents.conversation_graph(said)
    assert nodes.count() == 1 and [r["target_qualified"] for r in edges.collect()] == ["x/y.py"]


def test_headings_in_fenced_code_and_equal_titles(spark):
    text = "intro\n# A\n```\n# not\n~~~\n# B\n## A\nx\n# A #\n"
    nodes, edges = documents.document_graph(spark.createDataFrame([("d/x.md", text)], "path string, text string"))
    found = {(r["name"], r["line_start"], r["line_end"], r["parent_qualified"]) for r in nodes.where("element_type = 'doc_section'").collect()}
    assert found == {("A", 2, 5, "d/x.md"), ("B", 6, 8, "d/x.md"), ("A", 7, 8, "d/x.md::B#L6"), ("A", 9, 10, "d/x.md")}
    assert edges.count() == 4


def test_statuses_of_nested_repositories(spark):
    listing = "M  a.py\n M b.py\nMM c.py\nR  old.py -> new.py\n?? \"od d\\\".py\"\n!! skip.py\nUU both.py\nnot a line\n D gone.py\n"
    rows = changes.status_changes(spark.createDataFrame([("sub/repo", listing), (None, "A  top.py"), ("x", None)], "folder string, status string"))
    found = {tuple(r) for r in rows.collect()}
    under = "sub/repo/"
    assert found == {
        (under + "a.py", None, "staged", "modified"), (under + "b.py", None, "unstaged", "modified"), (under + "c.py", None, "staged", "modified"), (under + "c.py", None, "unstaged", "modified"), (under + "new.py", under + "old.py", "staged", "renamed"),
        (under + 'od d".py', None, "untracked", "added"), (under + "both.py", None, "staged", "modified"), (under + "both.py", None, "unstaged", "modified"), (under + "gone.py", None, "unstaged", "deleted"), ("top.py", None, "staged", "added"),
    }
    assert {r["path"] for r in changes.files_to_index(rows).where("action = 'remove'").collect()} == {under + "gone.py", under + "old.py"}


def test_packs_refuse_to_cut_and_searches_agree(spark):
    E = spark.createDataFrame([(f"n{k}", "function", f"a/{k % 2}.py") for k in range(10)], "qualified_name string, element_type string, file_path string")
    R = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "calls", 1.0 - k / 20) for k in range(9)], "source_qualified string, target_qualified string, rel_type string, confidence double")
    with pytest.raises(ValueError):
        pack.context_pack(E, R, None, 9)
    lines, manifest = pack.context_pack(E, R, "a", 10)
    assert lines.count() == 19 and manifest.first()["elements"] == 10
    other = pack.context_pack(E.where("qualified_name <> 'n0'"), R, "a", 10)[1].first()
    assert other["relationships"] == 8 and other["content_hash"] != manifest.first()["content_hash"]
    start = spark.createDataFrame([("n4",)], "node string")
    moves = traversal.symmetric(R).select("node", "other", "confidence")
    assert {tuple(r) for r in traversal.reach_by_scans(R, start, 3).collect()} == {tuple(r) for r in traversal.reach(moves, start, 3).collect()}


def test_embedding_states_as_a_stream(spark, tmp_path):
    from graphloom.streaming.embedding_states import embedding_states

    schema = "qualified_name string, event string, content_hash string, at long"
    table = KeyedTable.satellite(spark, f"{tmp_path}/tables", "embedding_state", buckets=4)
    batches = [
        [("a", "seen", "h1", 1), ("b", "seen", "h1", 1), ("b", "embedded", "h1", 2), (None, "seen", "x", 1), ("c", "seen", "h", 1), ("c", "removed", None, 1)],
        [("a", "embedded", "h1", 3), ("b", "seen", "h2", 4), ("d", "other", "h", 1)],
        [("a", "removed", None, 5), ("b", "embedded", "h2", 5), ("b", "seen", "h2", 6)],
    ]
    want = [{"a": "stale", "b": "fresh"}, {"a": "fresh", "b": "stale"}, {"a": "orphan", "b": "fresh"}]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = embedding_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(table.sink("events")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert stream.awaitTermination(120)
        assert {r["qualified_name"]: r["state"] for r in table.read().collect()} == want[k]
