"""Operator 7, language identification: word-first backoff.

A known word adds its log frequency in each language. An unseen word backs
off: its score is the mean log frequency of its character n-grams of the
longest order of which at least one is known, from ``ORDERS[0]`` down to 1,
with a fixed penalty for each step down. The language with the largest sum
wins (ties: the first by name); the score is its posterior with the number of
words tempered by a square root, so that long texts do not all read 1.0.

The model is learned from text and non-null lang of documents with
crc32(doc_id) mod 4 other than 2, at most ``MAX_DOCS`` for each language, of at
most ``MAX_CHARS`` characters, the smallest by a hash of the id; all words and
n-grams of that sample are in the model. lang, source and doc_id are never
inputs of a prediction.

Defined results: a text that is null or has no letter (Unicode category L)
gives ``und`` with score 0; so does every text if nothing could be learned. A
text of which not even one character is known ties in all languages and gets
the first by name. Ids pass through untouched, null ones too (never held out);
long texts are read whole; repeated rows and extra columns are harmless.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bounds of the sample that trains the model: documents of each language, and characters of one (longer ones are not trained on).
MAX_DOCS, MAX_CHARS = 600, 30_000
ORDERS = (5, 4, 3, 2, 1)
STEP = math.log(0.4)
UNKNOWN = "und"
#: Letters and what else counts as alphanumeric but no digit, such as fractions; ``letters`` parts those.
_WORD = re.compile(r"[^\W\d_]+")


def letters(word: str) -> list[str]:
    """The stretches of letters (Unicode category L) of a word."""
    return "".join(c if c.isalpha() else " " for c in word).split()


def words_of(text: str) -> list[str]:
    return [part for w in _WORD.findall(text.lower()) for part in ([w] if w.isalpha() else letters(w))]


@dataclass(frozen=True)
class Model:
    """Rows of ``table`` are log frequencies by language; words and grams give the row of a key."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own, or its n-grams' mean after backing off."""
        owner, rows = [], []
        steps, counts = np.zeros(len(words)), np.ones(len(words))
        grams = self.grams
        for i, word in enumerate(words):
            known = self.words.get(word)
            if known is not None:
                owner.append(i)
                rows.append(known)
                continue
            marked = f"^{word}$"
            size = len(marked) + 1
            for step, n in enumerate(ORDERS, 1):
                hits = [g for k in range(size - n) if (g := grams.get(marked[k : k + n])) is not None]
                if hits:
                    owner += [i] * len(hits)
                    rows += hits
                    steps[i], counts[i] = step, len(hits)
                    break
        at, of = np.array(owner, np.int64), np.array(rows, np.int64)
        sums = [np.bincount(at, self.table[of, k], len(words)) for k in range(len(self.langs))]
        return np.stack(sums, axis=1) / counts[:, None] + (steps * STEP)[:, None]


def _table(counts: list[Counter]) -> dict[str, np.ndarray]:
    """Log frequencies with half a count added to each language."""
    keys = sorted({k for c in counts for k in c})
    totals = np.array([sum(c.values()) for c in counts], float) + 0.5 * len(keys)
    return {k: np.log((np.array([c[k] for c in counts], float) + 0.5) / totals) for k in keys}


def train(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    words = {n: Counter() for n in names}
    grams = {n: Counter() for n in names}
    for text, lang in zip(texts, langs, strict=True):
        words[lang].update(words_of(text))
    for n in names:
        for w, c in words[n].items():
            marked = f"^{w}$"
            for order in ORDERS:
                for k in range(len(marked) - order + 1):
                    grams[n][marked[k : k + order]] += c
    of_words = _table([words[n] for n in names])
    of_grams = _table([grams[n] for n in names])
    rows = [*of_words.values(), *of_grams.values()]
    return Model(
        names,
        {w: k for k, w in enumerate(of_words)},
        {g: k for k, g in enumerate(of_grams, len(of_words))},
        np.array(rows, np.float32).reshape(len(rows), len(names)),
    )


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """At most MAX_DOCS documents of each language, the smallest by a hash of the id, picked by id before any text moves.

    A hash bound for each language, from its count, leaves little more than the
    sample, so neither a task nor the driver gets all ids of a language.
    """
    key = F.col("doc_id").cast("string")
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") <= MAX_CHARS) & (F.crc32(key.cast("binary")) % 4 != 2)).select("lang", "doc_id", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return [], []
    mark, parts = F.xxhash64("doc_id"), 1 << 40
    bounds = {k: parts if n <= 2 * MAX_DOCS else int(parts * 1.3 * MAX_DOCS / n) for k, n in counts.items()}
    of_lang = docs.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound long")
    near = usable.join(F.broadcast(of_lang), "lang").where(F.pmod(mark, F.lit(parts)) < F.col("bound"))
    ids = near.select("lang", "doc_id", F.pmod(mark, F.lit(parts)).alias("mark")).distinct().collect()  # about 1.3 * MAX_DOCS for each language, 2 * MAX_DOCS at most
    chosen: dict[str, int] = Counter()
    keep = []
    for r in sorted(ids, key=lambda r: (r["mark"], r["doc_id"])):
        chosen[r["lang"]] += 1
        if chosen[r["lang"]] <= MAX_DOCS:
            keep.append((r["lang"], r["doc_id"]))
    picked = docs.sparkSession.createDataFrame(keep, "lang string, doc_id long")
    rows = usable.join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row, from the text alone."""
    shared.small_batches(docs.sparkSession, size=8 << 20)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        size = len(m.langs)
        cache: dict[str, int] = {}
        table = np.zeros((0, size), np.float32)
        for batch in batches:
            if len(cache) > 400_000:
                cache, table = {}, np.zeros((0, size), np.float32)
            codes, fresh, owner = [np.zeros(0, np.int64)], [], []
            for text in batch.column("text"):
                ids = []
                for word in _WORD.findall((text.as_py() or "").lower()):
                    k = cache.get(word)
                    if k is not None:
                        ids.append(k)
                        continue
                    for w in [word] if word.isalpha() else letters(word):
                        k = cache.get(w)
                        if k is None:
                            k = cache[w] = len(cache)
                            fresh.append(w)
                        ids.append(k)
                codes.append(np.array(ids, np.int64))
                owner.append(len(ids))
            if fresh and size:
                table = np.vstack([table, m.word_scores(fresh).astype(np.float32)])
            n = np.array(owner, np.int64)
            preds, scores = np.full(len(n), UNKNOWN, object), np.zeros(len(n))
            if size and n.sum():
                at = np.repeat(np.arange(len(n)), n)
                sums = np.stack([np.bincount(at, table[np.concatenate(codes), k], len(n)) for k in range(size)], axis=1)
                best = sums.argmax(axis=1)
                z = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                share = 1 / np.exp(z).sum(axis=1)
                preds = np.where(n > 0, np.array(m.langs, object)[best], UNKNOWN)
                scores = np.where(n > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learn, then predict every document's language."""
    model = train(*training_sample(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
