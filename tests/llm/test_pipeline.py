"""The pipeline's stages on a whole small corpus, each against brute force on its own input."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm.exact_dedup")
import corpus_pipeline  # noqa: E402
from graphloom.llm import packing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def shingles(t):
    w = lower(t).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_kept(texts):
    """The smallest id of each component of texts with a similarity of 0.8 or more."""
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_against_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts, out = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in out.collect()}
        out = corpus_pipeline.shared.written(stage(spark, out, SF), f"test-{name}")
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert len(texts) == len(rows)
        if name == "toxicity":
            found = toxicity.detect(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(before) - set(texts) == {r["doc_id"] for r in found.where("predicted = 1").collect()}
            assert len(texts) > 0.8 * len(before)
        elif name == "exact_dedup":
            last = {}
            for k in sorted(before):
                last[lower(before[k]["text"])] = k
            assert set(texts) == set(last.values())
        elif name == "ngram_jaccard_join":
            assert set(texts) == near_kept({k: r["text"] for k, r in before.items()})
        elif name == "pii":
            assert set(texts) == set(before) and any(texts[k] != before[k]["text"] for k in texts)
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        else:
            lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
            lib.no_truncation(), lib.no_padding()
            tokens, used = {}, {}
            for r in rows:
                tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
                used.setdefault(r["bin_id"], []).append(r)
            assert tokens == {k: len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
            for of in used.values():
                of.sort(key=lambda r: r["bin_offset"])
                assert of[-1]["bin_offset"] + of[-1]["n_tokens"] <= packing.CAPACITY
                assert all(a["bin_offset"] + a["n_tokens"] <= b["bin_offset"] for a, b in zip(of, of[1:]))
                sources = [before[r["doc_id"]]["source"] for r in of]
                assert len(set(sources)) == len(sources)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("n_tokens")).first()[0] == sum(tokens.values()) and whole.count() == len(rows)


def test_toxic_rows_go_with_or_without_an_id(spark, tmp_path):
    rows = [(k, ("you are a vile stupid zorgle. " if k % 2 else "a calm day by the sea. ") + f"word{k} more text here", "en", "s", 1) for k in range(400)]
    vile = "you are a vile stupid zorgle. so it is"
    rows += [(None, vile, "en", "s", 1), (None, "a calm day by the sea", "en", "s", 1), ((1 << 61) + 1, "quiet hours by the sea", "en", "s", 1), ((1 << 61) + 1, vile, "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert not [t for _, t in left if t and "zorgle" in t]
    assert sorted(str(k) for k, t in left if not t or "word" not in t) == sorted(["None", "None", str((1 << 61) + 1)])


def test_no_stage_before_the_surrogates_writes_texts(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"document {k} is of its own words " + " ".join(f"v{k}x{j}" for j in range(20)), "en", "s", 1) for k in range(60)]
    rows += [(100, long, "en", "s", 1), (101, long.upper(), "en", "s", 1), (102, long + " x", "en", "s", 1), (None, long + " x y", "en", "s", 1), (None, "No id", "de", "s", 1), (None, "no id", "en", "s", 1), (103, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, write = [], corpus_pipeline.shared.written
    monkeypatch.setattr(corpus_pipeline.shared, "written", lambda df, name: seen.append((name, df.columns)) or write(df, name))
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert seen and not [name for name, columns in seen if "text" in columns]
    assert out.columns == docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in left if k is not None) == [*range(60), 101, 103] and left.count(None) == 2
