"""Token files, filter audit and whitening against brute force, with nulls, ties, repeats and clashing columns."""

import itertools
import json
import random
import uuid
import zlib

import numpy as np
import pytest

token_files = pytest.importorskip("graphloom.llm.token_files")
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from graphloom.llm import bpe, filter_audit, shared, whitening  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, shard int, payload string, part string, mask int, label string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 1, "p", "x", 3, "y") for k, t, lang in rows], SCHEMA)


ODD = ["  two  spaces\n\n\tand tabs ", "it's they'll 'tis ''s", "naïve Straße 東京 😀😀", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "1234 5,678.90", "   z", "\n"]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_bits_come_back(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003).astype(np.uint32)
    data = token_files.pack_bits(ids, width)
    assert len(data) == -(-1003 * width // 8)
    assert (token_files.unpack_bits(data, width, 1003) == ids).all()
    assert (token_files.unwrap(token_files.wrap(ids, width), width) == ids).all()


def test_word_encoder_gives_the_librarys_ids():
    with open(TOKENIZER, encoding="utf-8") as f:
        spec = f.read()
    assert token_files.splits_like_bytes(json.loads(spec))
    library = Tokenizer.from_str(spec)
    rng = random.Random(5)
    texts = ["", *ODD, *("".join(rng.choices("ab 'sré\n\t12.,  ß東", k=rng.randrange(200))) for _ in range(300)), ""]
    encoder = token_files.WordEncoder(spec, bpe.char_classes())
    for k in range(3):  # the second time from what is kept, the third after some has gone
        if k == 2:
            encoder._forget()
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    encoder.recent[1][:] = 0  # as if all words had one hash
    assert [x.tolist() for x in encoder.encode(texts[:9])] == [library.encode(t, add_special_tokens=False).ids for t in texts[:9]]
    assert token_files.WordEncoder(spec, None).encode(["two words"])[0].tolist() == library.encode("two words").ids


def test_token_files_hold_documents_in_order(spark):
    rng = random.Random(6)
    words = "one two three fünf sechs 7 , . don't".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 50, 900]))), "en") for k in rng.sample(range(-50, 1 << 40), 120)]
    rows += [((1 << 61) + k, t, "de") for k, t in enumerate(ODD)]
    rows += [(None, None, None), (None, "no id", "en"), (7, None, "en"), (7, "same", "en"), (7, "same", "en"), *((9, f"many rows of one id {k}", "en") for k in range(90))]
    library = Tokenizer.from_file(TOKENIZER)
    docs = documents(spark, rows).repartition(5)
    path = f"{shared.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(docs, path, TOKENIZER)
    found = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    want = sorted((k is not None, k or 0, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in found) == want
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert order == sorted(order)
    begin = 0
    for r in found:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (begin, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        begin += r["n_tokens"]
    assert [tuple(r) for r in token_files.read_tokens(spark, path, "n_tokens long, doc_id long").select("doc_id", "n_tokens").collect()] == [(r["doc_id"], r["n_tokens"]) for r in found]


def test_an_id_of_many_rows_gets_several_shards(spark):
    docs = documents(spark, [(9, f"row {k}", "en") for k in range(300)] + [(k, "x", "en") for k in range(100, 160)])
    rows, _ = token_files.encoded(docs, TOKENIZER, bounds=token_files.shard_bounds(docs))
    shards = {r["shard"] for r in rows.where("doc_id = 9").select("shard").distinct().collect()}
    assert len(shards) > 1 and max(shards) <= rows.where("doc_id > 9").agg({"shard": "min"}).first()[0]


def test_any_range_of_a_file_is_read_by_itself(spark, tmp_path):
    ids = np.random.default_rng(1).integers(0, 1 << 13, 3 * token_files.BLOCK_IDS + 77)
    cuts = [0, 5, 5, 70_000, len(ids)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4]), pa.array([token_files.wrap(ids[a:b], 13) for a, b in zip(cuts, cuts[1:])])], ["doc_id", "payload"])
    schema = "doc_id long, payload binary"
    spark.dataSource.register(token_files.PackedTokenIds)
    frame = spark.createDataFrame([tuple(r.values()) for r in batch.to_pylist()], schema).coalesce(1)
    frame.write.format(token_files.FORMAT).option("width", "13").mode("append").save(str(tmp_path / "one"))
    name = json.loads((tmp_path / "one" / token_files.MANIFEST).read_text())["shards"][0][0]
    assert (tmp_path / "one" / name).stat().st_size < 13 / 8 * len(ids) + 1000
    file = token_files.TokenFile(*token_files.open_store(str(tmp_path / "one" / name)))
    for a, b in [(0, 5), (5, 5), (65_535, 65_537), (100, 200_000), (0, len(ids)), (len(ids) - 1, len(ids))]:
        assert (file.ids(a, b) == ids[a:b]).all()
    assert file.nulls.tolist() == [False, False, True, False] and file.ends.tolist() == cuts[1:]


def test_token_files_of_an_empty_table(spark):
    assert token_files.digests(documents(spark, []), TOKENIZER).collect() == []


def audit_by_hand(rows, labels):
    def fails(k, text):
        t = text or ""
        w = [x for x in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        e = k is not None and any(j is not None and j < k and (u or "") == t for j, u, _ in rows)
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": e}

    marks = [(lang or "", fails(k, t), any(a == k is not None and q == 1 for a, q, _ in labels), any(a == k is not None and x == 1 for a, _, x in labels)) for k, t, lang in rows]
    out = {}
    for part in {m[0] for m in marks}:
        own = [m for m in marks if m[0] == part]
        by_filter = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, c in enumerate(order, 1):
                here = [m for m in left if m[1][c]]
                left = [m for m in left if not m[1][c]]
                by_filter[c] += len(here)
                failing = [m for m in own if m[1][c]]
                out[part, order, step] = [len(left), len(here), len(failing) - len(here), sum(sum(m[1].values()) == 1 for m in failing), sum(m[2] for m in here), sum(m[3] for m in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(by_filter[order[step - 1]])
    return out


def test_filter_audit_against_every_order_walked(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)] + ["LOUD", "Shout", "$5", "a|b", "é"]
    texts = [None, "", " \n ", *(" ".join(rng.choices(words[: rng.choice([40, 150, 155])], k=rng.choice([5, 99, 100, 130]))) for _ in range(40)), " ".join(words[:120]), "LOUD " * 120]
    rows = [((1 << 60) + k, rng.choice(texts), rng.choice(["de", "en", None])) for k in range(150)]
    rows += [(None, texts[5], "en"), (None, texts[5], "fr"), (3, texts[6], "en"), (3, texts[6], "en"), (4, texts[6], "en"), (4, texts[7], "en")]
    labels = [((1 << 60) + k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [((1 << 60) + 2, 1, 0), (None, 1, 1), (3, 1, 1)]
    got = filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in got} == audit_by_hand(rows, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})


def test_filter_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).collect() == []


def whitened_by_hand(rows, components=16):
    usable = [(k, [float(c) for c in v]) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in usable]
    dims = max(set(sizes), key=lambda s: (sizes.count(s), s))
    x = [(k, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for k, v in usable if len(v) == dims]
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], float) / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    keep = [k for k in np.argsort(e)[::-1] if e[k] > e.max() * dims * 2.3e-16][:components]
    out = []
    for k, row in x:
        d = [n * a - b for a, b in zip(row, s)]
        p = np.array(d, float) / n @ w[:, keep] / np.sqrt(e[keep])
        out.append((k, sum(q * q for q in d), p.tolist()))
    return n, e[keep] / np.trace(v), out


@pytest.mark.parametrize("tile", [3, 32])
def test_whitening_against_the_whole_matrix(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 9)) * np.arange(1, 10)
    rows = [(int(k), base[k % 60].astype(np.float32).tolist()) for k in range(200)] + [((1 << 60) + k, base[0].astype(np.float32).tolist()) for k in range(100)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None] + [0.0] * 7), (1003, [float("nan")] * 9), (1004, [float("inf")] + [0.0] * 8), (1005, [1.0] * 5), (None, [2.0] * 9), (5, [0.5] * 9), (5, [0.5] * 9)]
    frame = spark.createDataFrame([(k, v, 1, 2.0) for k, v in rows], "vec_id long, embedding array<float>, n int, whitened double").repartition(3)
    got = whitening.whiten(frame, tile=tile).collect()
    n, explained, want = whitened_by_hand(rows)
    assert {r["n"] for r in got} == {n} and len(got) == 9 * len(want)
    assert max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    key = lambda k, d: (k is None, k or 0, d)
    sign = {}
    mine = {}
    for r in got:
        mine.setdefault(key(r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    for k, d, p in want:
        for c, value in enumerate(p, 1):
            other = mine[key(k, d)][c]
            if abs(value) > 1e-6:
                assert sign.setdefault(c, np.sign(value * other)) == np.sign(value * other)
            assert abs(abs(value) - abs(other)) < 1e-7 * max(1, abs(value))


def test_whitening_of_few_and_of_huge_entries(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1e300, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 2.0])], schema)).collect()
    assert {r["component"] for r in got} == {1} and all(r["deviation"] is None for r in got)


def test_deviations_are_exact_up_to_a_long():
    middle = whitening.Centre(1, (0, 0))
    most = 3_037_000_499  # its square is the largest below 2**63
    z = np.array([[most, 0], [most, 1 << 20], [most + 1, 0], [1 << 44, 1 << 44]])
    assert middle.deviations(z) == [most * most, most * most + (1 << 40) if most * most + (1 << 40) < 1 << 63 else None, None, None]
    assert whitening.Centre(1 << 40, (0, 0)).deviations(np.array([[0, 0], [1 << 40, 0]])) == [0, None]
