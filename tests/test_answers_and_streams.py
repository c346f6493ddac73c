"""Question subgraphs, output summaries and the streaming operators."""

import datetime

import pytest
from graphloom.functions import compress
from graphloom.operators import questions
from graphloom.operators import joins as J
from graphloom.operators import tables as W
from graphloom.operators.store import KeyedTable
from graphloom.streaming import feeds
from pyspark.sql import functions as F


def rows_of(spark, text, f):
    return [tuple(r)[1:] for r in f(spark.createDataFrame([(1, text)], "id int, t string").withColumnRenamed("t", "text")).orderBy("id").collect()]


def test_diffs_by_file(spark):
    diff = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n+new\n+two\n-old\n--- gone\n+++ more\n"
    new = "diff --git a/n b/n\nnew file mode 100644\nindex 0..1\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+x\n"
    gone = "diff --git a/d b/d\ndeleted file mode 100644\n--- a/d\n+++ /dev/null\n@@ -1 +0,0 @@\n-x"
    assert sorted(rows_of(spark, new + gone, compress.diff_files)) == [("d", 0, 1), ("n", 1, 0)]
    assert rows_of(spark, diff, compress.diff_files)[0] == ("x", 2, 1)
    assert rows_of(spark, " src/a.rs | 3 ++-\n b | 40 ++++\n 2 files changed\n", compress.diff_totals) == [(2, 42, 1, "b +40 -0; src/a.rs +2 -1")]
    assert rows_of(spark, None, compress.diff_totals) == [(0, 0, 0, "")]


def test_test_runs(spark):
    assert rows_of(spark, "test a ... ok\ntest b ... ignored\n", compress.test_totals) == [(1, 0, 1, "")]
    run = "test a ... ok\ntest b::c ... FAILED\n\nfailures:\n    b::c\n\ntest result: FAILED. 1 passed; 1 failed"
    assert rows_of(spark, run, compress.test_totals) == [(1, 1, 0, "b::c")]
    assert rows_of(spark, None, compress.test_totals) == [(0, 0, 0, "")]


def test_question_subgraph(spark):
    E = spark.createDataFrame([(n, "function", n.split("::")[1]) for n in ("f::login", "f::check", "f::store", "f::other")], "qualified_name string, element_type string, name string")
    R = spark.createDataFrame([("f::login", "f::check", "calls", 1.0), ("f::check", "f::store", "calls", 0.5), ("f::other", "f::login", "calls", 0.9)], "source_qualified string, target_qualified string, rel_type string, confidence double")
    assert questions.terms_of("What connects login to the store?") == ["login", "store"]
    assert questions.terms_of("is there a path between alpha and beta?") == ["alpha", "beta"]
    assert questions.terms_of("between alpha and beta") == ["alpha", "beta"]
    assert questions.terms_of("alpha -> beta") == questions.terms_of("from alpha to beta") == ["alpha", "beta"]
    got = questions.question_subgraph(E, R, "What connects login to the store?").collect()
    assert [(r["source_qualified"], r["on_path"]) for r in got] == [("f::login", True), ("f::check", True), ("f::other", False)]
    assert questions.question_subgraph(E, R, "nowhere").count() == 0
    with pytest.raises(ValueError):
        questions.question_subgraph(E, R, "what is the")


def test_obsidian_notes(spark):
    E = spark.createDataFrame([("a/b::f", "function", "f", "a/b")], "qualified_name string, element_type string, name string, file_path string")
    R = spark.createDataFrame([("a/b::f", "g", "calls")], "source_qualified string, target_qualified string, rel_type string")
    got = W.obsidian(E, R).orderBy("note", "place", "value").collect()
    assert [r["value"] for r in got] == ["# f", "type: function, file: a/b", "- calls [[g]]"] and {r["note"] for r in got} == {"a_b__f"}


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_windows_over_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=m), "view", 1.0) for i, m in enumerate((0, 5, 12, 12))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    E = feeds.events(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz, event_type string, value double")
    assert sorted(r["n"] for r in drain(feeds.tumbling(E, "10 minutes", "1 minute"), "tumbled", "complete").collect()) == [2, 2]
    assert drain(feeds.distinct_within(E, ["ts"], "1 hour"), "once", "append").count() == 3


def test_upsert_sink_is_idempotent(spark, tmp_path):
    merge = feeds.upsert_sink(f"{tmp_path}/t", ["k"])
    merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    for _ in range(2):
        merge(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert sorted((r["k"], r["v"]) for r in KeyedTable(spark, f"{tmp_path}/t").read().collect()) == [(1, "a"), (2, "c")]
    merge = feeds.upsert_sink(f"{tmp_path}/late", ["k"], "at", 4)
    merge(spark.createDataFrame([(1, 5), (1, 7), (1, 6)], "k int, at long"), 40)  # a stream may begin at any batch
    merge(spark.createDataFrame([(1, 3), (2, 1)], "k int, at long"), 41)
    assert sorted(map(tuple, KeyedTable(spark, f"{tmp_path}/late").read().collect())) == [(1, 7), (2, 1)]


def test_as_of_over_days_and_clashing_names(spark):
    import random

    rng = random.Random(5)
    day = 86_400
    right = [(rng.choice("ab"), rng.randrange(6) * day + rng.choice([0, 5, 900]), rng.choice([None, 1, 2, 3])) for _ in range(60)] + [(None, 3, 9), ("a", None, 7)]
    left = [(k, rng.choice("abc"), rng.randrange(-1, 8) * day + rng.choice([0, 4, 5, 6, 901]), 70 + k) for k in range(80)] + [(900, None, 5, 0), (901, "a", None, 1)]
    L = spark.createDataFrame(left, "id int, __t string, at long, __v int")
    R = spark.createDataFrame(right, "__t string, when long, found int")
    got = {r["id"]: (r["found"], r["__v"]) for r in J.as_of(L, R, ["__t"], "at", "when", "found").collect()}
    for k, key, at, v in left:
        best = max(((t, f) for q, t, f in right if q == key and t is not None and f is not None and at is not None and t <= at), default=(0, None))
        assert got[k] == (best[1], v)
    assert len(got) == len(left)


def test_toon_quotes_what_would_break_a_row(spark):
    rows = spark.createDataFrame([("plain", 1), ("a,b", 2), ('say "x"', None), ("two\nlines", 3), (" blank", 4), ("null", 5), (None, 6), ("", 7)], "s string, n int")
    assert {r["value"] for r in W.toon(rows, "t").collect()} == {"t{s,n}:", "plain,1", '"a,b",2', '"say \\"x\\"",null', '"two\\nlines",3', '" blank",4', '"null",5', "null,6", '"",7'}


def test_upsert_without_a_version_keeps_one_row_of_a_key(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    out = sorted(map(tuple, W.upsert(t, n, ["k"]).collect()))
    assert [k for k, _ in out] == [1, 2, 3] and out[1][1] in "cd"
