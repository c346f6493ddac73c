"""Operator 3, toxicity: multiple-instance learning over sentences.

A document is a bag of sentences of which the label says only that at least
one is toxic. With s the sentences, P(doc) = 1 - (1 - leak) * prod(1 - p_s),
p_s = max(0, sigmoid(w.x_s - b) - sigmoid(-b)): a sentence without evidence
scores exactly 0, so long clean documents stay clean; the leak takes the
label noise. The weights maximise the bag likelihood, so the sentence scores,
learned from document labels alone, locate the offending sentences.

Features are words and word prefixes whose association with the label is
significant on the training sample; neither labels, lang, source nor doc_id
enter a score. Training reads at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled
documents of at most ``MAX_CHARS`` characters, the smallest by a hash of the id.

Defined results: a null or empty text has no sentence and scores the leak;
ties of the worst sentence go to the first; with no labels or no feature the
score is the leak; ids pass through untouched, null ones too (never held out);
long texts are scored whole; repeated rows and extra columns are harmless.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bounds of the training sample: documents of either label, and characters of one (longer ones are not trained on).
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2000, 30_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
BIAS = 3.0
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    for m in _SENTENCE.finditer(text):
        if not m.group().isspace():
            yield m.start(), m.end()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    leak: float

    @cached_property
    def stems(self) -> list[str]:
        """The fewest strings one of which every word with a weight begins with."""
        out: list[str] = []
        for f in sorted(k.rstrip("~") for k in self.weights):
            if not out or not f.startswith(out[-1]):
                out.append(f)
        return out

    def word_weight(self, word: str, cache: dict[str, float]) -> float:
        w = cache.get(word)
        if w is None:
            if len(cache) > 500_000:
                cache.clear()
            w = cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentence_scores(self, text: str, cache: dict[str, float]) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence that has evidence."""
        hits: dict[int, float] = {}
        low = text.lower()
        if len(low) != len(text):  # keep positions
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not any(stem in low for stem in self.stems):  # most texts: no word of theirs has a weight
            return []
        bounds: list[tuple[int, int]] | None = None
        starts: list[int] = []
        for m in _WORD.finditer(low):
            w = self.word_weight(m.group(), cache)
            if w:
                if bounds is None:
                    bounds = list(sentences(text))
                    starts = [b[0] for b in bounds]
                k = int(np.searchsorted(starts, m.start(), "right")) - 1
                hits[k] = hits.get(k, 0.0) + w
        return [(*bounds[k], score) for k, z in sorted(hits.items()) if bounds is not None and (score := instance(z)) > 0]

    def score(self, text: str | None, cache: dict[str, float]) -> tuple[float, tuple[int, int, float] | None]:
        if not text:
            return self.leak, None
        found = self.sentence_scores(text, cache)
        clean = math.prod(1 - p for *_, p in found)
        worst = max(found, key=lambda x: (x[2], -x[0]), default=None)
        return 1 - (1 - self.leak) * clean, worst


def instance(z: float) -> float:
    return max(0.0, 1 / (1 + math.exp(BIAS - z)) - 1 / (1 + math.exp(BIAS))) if z < 60 else 1 - 1 / (1 + math.exp(BIAS))


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features(w)}


def select_features(texts: list[str], labels: np.ndarray, least: int = 3) -> list[str]:
    """Features with a positive association significant after correction for their number.

    Only features of ``least`` toxic texts can be; the others are not counted
    in the clean ones, which bounds what is held.
    """
    toxic: Counter = Counter()
    for text, y in zip(texts, labels, strict=True):
        if y:
            toxic.update(text_features(text))
    toxic = Counter({k: v for k, v in toxic.items() if v >= least})
    clean: Counter = Counter()
    for text, y in zip(texts, labels, strict=True):
        if not y:
            clean.update(f for f in text_features(text) if f in toxic)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return []
    bar = 2 * math.log(max(len(toxic), 1) / 0.05)  # chi-square tail bound of one degree of freedom
    out = []
    for k, a in toxic.items():
        b = clean[k]
        if a * n0 <= b * n1:
            continue
        g = 0.0
        for got, of, total in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)):
            if got:
                g += 2 * got * math.log(got * (n1 + n0) / (of * total))
        if g > bar:
            out.append(k)
    return sorted(out)


def train(texts: list[str], labels: list[int], weights: list[float] | None = None, steps: int = 300) -> Model:
    """Fit the bag likelihood by full-batch Adam; ``weights`` undo the class sampling."""
    y = np.asarray(labels, float)
    share = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    names = select_features(texts, y.astype(int))
    base = float((share * y).sum() / max(share.sum(), 1e-9))
    if not names:
        return Model({}, min(0.25, base))
    at = {f: i for i, f in enumerate(names)}
    bag_of, rows, cols = [], [], []
    for b, text in enumerate(texts):
        for start, end in sentences(text):
            if hit := [at[f] for f in text_features(text[start:end]) if f in at]:
                rows += [len(bag_of)] * len(hit)
                cols += hit
                bag_of.append(b)
    bag_ix, row_ix, col_ix = (np.array(x, np.int64) for x in (bag_of, rows, cols))
    theta = np.concatenate([np.full(len(names), 1.0), [-4.0]])
    m = v = np.zeros_like(theta)
    floor = 1 / (1 + math.exp(BIAS))
    for t in range(1, steps + 1):
        z = np.bincount(row_ix, theta[:-1][col_ix], len(bag_ix)) - BIAS
        s = 1 / (1 + np.exp(-z))
        p = np.clip(s - floor, 0, 1 - 1e-6)
        leak = 0.2 / (1 + math.exp(-theta[-1]))
        log_clean = np.bincount(bag_ix, np.log1p(-p), len(y)) + math.log(1 - leak)
        clean = np.exp(log_clean)
        doc = np.clip(1 - clean, 1e-9, 1)
        d_log = share * np.where(y > 0, clean / doc, -1.0)  # of the loss, by log_clean
        d_z = d_log[bag_ix] * np.where(s > floor, -s * (1 - s) / (1 - p), 0)
        grad = np.append(np.bincount(col_ix, d_z[row_ix], len(names)), -d_log.sum() * leak * (1 - leak / 0.2) / (1 - leak))
        grad[:-1] += 0.02 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model({f: round(float(w), 6) for f, w in zip(names, theta[:-1], strict=True) if w > 0.05}, float(min(0.2 / (1 + math.exp(-theta[-1])), 0.9 * THRESHOLD)))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], list[float]]:
    """A bounded sample of labelled rows with crc32(doc_id) mod 4 other than 2, and what each row stands for."""
    key = F.col("doc_id").cast("string")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (F.crc32(key.cast("binary")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS)
    known = known.join(usable.select("doc_id"), "doc_id", "left_semi")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [known.where(F.col("toxic") == y).orderBy(*order).limit(most) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    ids = parts[0].unionByName(parts[1])  # at most MAX_TOXIC + MAX_CLEAN rows of two numbers
    rows = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    got = Counter(r["toxic"] for r in rows)
    return [r["text"] for r in rows], [r["toxic"] for r in rows], [totals[r["toxic"]] / got[r["toxic"]] / max(1, sum(totals.values())) * len(rows) for r in rows]


SCHEMA = "doc_id long, score double, worst_start long, worst_end long, worst_score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in [0, 1], and the character range and score of the worst sentence (null: none)."""
    shared.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            found = [held.value.score(text.as_py(), cache) for text in batch.column("text")]
            worst = [w or (None, None, None) for _, w in found]
            columns = [pa.array([min(max(p, 0.0), 1.0) for p, _ in found], pa.float64())]
            columns += [pa.array([w[k] for w in worst], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), SCHEMA)


def kept_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs``, of the rows that score below the threshold: whole rows pass the scorer, so none needs a key and none is joined."""
    shared.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            yield batch.filter(pa.array([min(max(held.value.score(text.as_py(), cache)[0], 0.0), 1.0) < THRESHOLD for text in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(shared.lean(run), docs.schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels, then score every document."""
    model = train(*training_sample(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return score(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
        "worst_start", "worst_end", "worst_score",
    )
