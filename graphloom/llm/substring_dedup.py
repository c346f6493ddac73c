"""Operator 10, removal of long repeated passages, found by recompression.

A window is 13 consecutive words of one document. Each word covered by a
window that also starts in a document with a smaller doc_id is removed.

Recompression. Symbols are words at first. A round names each maximal run of
one symbol (by the symbol and the length), then splits the symbols into two
classes by name and replaces each adjacent pair (first class, second class) by
one named symbol. A run's symbols stay in the sequence beside its name, since a
window may end within the run; they have one class and never merge with each
other. A name is a hash of what it stands for, so equal stretches get equal
names in every task; a table of all pairs would be as large as the corpus. Each
symbol keeps the range of words that settle it: a pair needs its two parts to
be symbols of the round, a run its two neighbours, and a symbol that stays
alone needs the neighbour it could have merged with. Every window that holds this
range has the symbol, whatever lies around the window. The name that is passed
on covers the words of that range as well.

1. A window's symbol is the one of the highest round among those its words
   settle (a word if there is none), so equal windows have the same one. Spark
   groups the symbols by name; a name of one document only rules its windows
   out.
2. The windows around symbols with a name in common are themselves named (96
   bits, two hashes that share no lane), and Spark finds the first document of
   each. Names of up to ``HOT`` occurrences need one shuffle; the windows of
   more frequent ones are combined before it and looked up in a join, which
   Spark can split, so that no task gets all rows of one passage.
3. Windows with an earlier document become word ranges of their document, which
   alone are brought to the texts.

Copies of whole documents are settled beforehand by the SHA-256 of their words.

Defined results: null and empty texts have no words; a document below 13 words
loses nothing; rows repeated with one doc_id are one document (should their
texts differ, places found in one are removed from each); a null doc_id takes
no part; long texts are read whole, in blocks; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import Words

WIDTH = 13
ROUNDS = 3
#: Occurrences of a name up to which its windows are compared in one group.
HOT = 4096
_FAR = np.int64(1) << np.int64(40)
_U = np.uint64


def symbols(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Round, first and past-the-last settling word, and name of the words and of every symbol that a round makes.

    ``first``: where each text begins. Ranges that reach beyond a text are of no
    window: they are given a width above any.
    """
    n = len(hashes)
    head = np.zeros(n + 1, bool)
    head[first] = True
    name, start = hashes, np.arange(n)
    lo, hi = start.copy(), start + 1
    found = [(np.zeros(n, np.uint64), lo, hi, name)]
    for k in range(1, ROUNDS + 1):
        new = head[start]  # whether a text begins here
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & ~new[1:]
        if same.any():
            at = np.flatnonzero(~same)
            size = np.diff(np.append(at, len(name)))
            run = size > 1
            a, b = at[run], (at + size)[run]
            left = np.where(new[a], -_FAR, lo[np.maximum(a - 1, 0)])
            right = np.where(np.append(new, True)[b], _FAR, np.append(hi, 0)[b])
            run_lo, run_hi = np.minimum(lo[a], left), np.maximum(hi[b - 1], right)
            run_name = shared.mix(name[a] * _U(shared._BASE) + size[run].astype(np.uint64) + _U(1000 * k))
            found.append((np.full(len(a), k, np.uint64), run_lo, run_hi, run_name))
        second = (shared.mix(name ^ _U(0xA0761D6478BD642F * k & (1 << 64) - 1)) >> _U(63)).astype(bool)
        gone = np.zeros(len(name), bool)  # merged with the symbol before
        gone[1:] = second[1:] & ~second[:-1] & ~new[1:]
        j = np.flatnonzero(gone) - 1
        pair_lo, pair_hi = np.minimum(lo[j], lo[j + 1]), np.maximum(hi[j], hi[j + 1])
        pair_name = shared.mix(name[j] * _U(shared._BASE) + name[j + 1] + _U(k))
        found.append((np.full(len(j), k, np.uint64), pair_lo, pair_hi, pair_name))
        # alone: one of the second class by the symbol before it, one of the first by the symbol after
        before, after = np.full(len(name), -_FAR), np.full(len(name), _FAR)
        before[1:] = np.where(new[1:], -_FAR, lo[:-1])
        after[:-1] = np.where(new[1:], _FAR, hi[1:])
        lo, hi = np.where(second, np.minimum(lo, before), lo), np.where(second, hi, np.maximum(hi, after))
        name = name.copy()
        name[j], lo[j], hi[j] = pair_name, pair_lo, pair_hi
        stay = ~gone
        name, start, lo, hi = name[stay], start[stay], lo[stay], hi[stay]
    level, lo, hi, name = (np.concatenate(x) for x in zip(*found, strict=True))
    fit = hi - lo <= WIDTH
    return level[fit], lo[fit], hi[fit], name[fit]


def spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row with one symbol: its name, their text, the first of them and their number."""
    n = len(w.hashes)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none.astype(np.uint64), none, none, none
    level, lo, hi, name = symbols(w.hashes, w.first[:-1])
    sums = np.zeros(n + 1, np.uint64)  # of word hashes, each times its place's power of an odd number
    power = np.full(n + 1, shared._BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    np.cumsum(w.hashes * power[n - 1 :: -1], out=sums[1:])
    within = (sums[hi] - sums[lo]) * power[lo]  # times base**(n - 1): alike for all
    inverse = pow(pow(shared._BASE, n, 1 << 64), -1, 1 << 64)  # so that the number of words in the block has no part in it
    name = shared.mix(name ^ shared.mix(within * _U(inverse) + (hi - lo).astype(np.uint64)))
    rank = (level << _U(62)) | (name >> _U(2))
    width = hi - lo
    by = np.argsort(width, kind="stable")
    cut = np.searchsorted(width[by], np.arange(WIDTH + 2))
    best = np.zeros(n, np.uint64)  # of the stretch of ``size`` words from each word on
    for size in range(1, WIDTH + 1):
        if size > 1:
            best[:-1] = np.maximum(best[:-1], best[1:])
        of = by[cut[size] : cut[size + 1]]
        np.maximum.at(best, lo[of], rank[of])
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(text[: n - WIDTH + 1] == text[WIDTH - 1 :])
    if not len(at):
        return none.astype(np.uint64), none, none, none
    best, text = best[at], text[at]
    begin = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1])))
    return best[begin], text[begin], at[begin] - w.first[text[begin]], np.diff(np.append(begin, len(at)))


def _slices(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in shared.text_slices(texts):
            yield batch.slice(a, b - a), Words(texts.slice(a, b - a), False, lanes)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the SHA-256 of all words joined, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n_words", "digest"])

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), "doc_id long, n_words long, digest binary")


def symbol_rows(docs: DataFrame) -> DataFrame:
    """name, doc_id, start, n: each row's symbols and the windows they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _slices(batches, 2):
            name, text, start, n = spans(w)
            ids = batch.column("doc_id").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(name)), ids, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["name", "doc_id", "start", "n"])

    return docs.mapInArrow(shared.lean(run), "name long, doc_id long, start int, n int")


def window_rows(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, start, n of the windows in the column ``spans`` (start, n); equal ones in a row are one with their number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _slices(batches, 4):
            lists = batch.column("spans")
            flat = lists.flatten()
            per = lists.value_lengths().to_numpy(zero_copy_only=False)
            start, many = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            text = np.repeat(np.repeat(np.arange(len(per)), per), many)
            at = np.repeat(start - np.append(0, np.cumsum(many))[:-1], many) + np.arange(len(text)) + w.first[text]
            inside = at + WIDTH <= w.first[text + 1]
            text, at = text[inside], at[inside]
            by = np.lexsort((at, text))
            text, at = text[by], at[by]
            h1, h2 = shared.windows(w.hashes, WIDTH, 2), shared.windows(w.second, WIDTH, 3)
            h1, h2 = h1[at], (h2[at] >> _U(32)).astype(np.uint32)
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))[: len(at)]
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(at)))
            ids = batch.column("doc_id").take(pa.array(text[begin]))
            place = (at[begin] - w.first[text[begin]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h1[begin])), pa.array(h2[begin].view(np.int32)), ids, pa.array(place), pa.array(n.astype(np.int32))], ["h1", "h2", "doc_id", "start", "n"])

    return docs.select("doc_id", "text", "spans").mapInArrow(shared.lean(run), "h1 long, h2 int, doc_id long, start int, n int")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and the ranges (first word, past the last) of its windows that also start in a document with a smaller doc_id."""
    rows = shared.written(symbol_rows(docs), "substring-symbols")
    names = rows.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("k"))
    names = shared.written(names.where("a < b").select("name", (F.col("k") > HOT).alias("hot")), "substring-names")
    both = rows.join(names, "name").groupBy("doc_id").agg(*(F.collect_list(F.when(F.col("hot") == hot, F.struct("start", "n"))).alias(c) for c, hot in (("cold", False), ("hot", True))))
    lists = shared.written(both, "substring-spans")
    shared.discard(rows)
    shared.release(docs.sparkSession)
    with_text = lambda c: docs.join(lists.where(F.size(c) > 0).select("doc_id", F.col(c).alias("spans")), "doc_id")

    first = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    later = window_rows(with_text("cold")).withColumn("first", first).where("doc_id > first").select("doc_id", "start", "n")
    parts = [shared.written(later, "substring-later")]
    shared.release(docs.sparkSession)
    if not names.where("hot").isEmpty():
        hot = shared.written(window_rows(with_text("hot")), "substring-hot")
        heads = hot.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        parts.append(shared.written(hot.join(heads, ["h1", "h2"]).where("doc_id > first").select("doc_id", "start", "n"), "substring-later"))
        shared.discard(hot)
    later = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # windows that touch or overlap become one range
    of_doc = Window.partitionBy("doc_id").orderBy("start")
    end = F.col("start") + F.col("n") + WIDTH - 1
    reach = F.max(end).over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("end", end).withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(of_doc)).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; ``with_text`` adds the kept words joined by a space."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    base = docs.select("doc_id", "text")
    facts = shared.written(sequences(base), "substring-sequences")
    known = facts.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("k"))
    copies = shared.written(known.join(firsts.where("k > 1"), "digest").where("doc_id > first").select("doc_id").distinct(), "substring-copies")
    near = F.broadcast(copies) if copies.count() * 16 <= shared.BROADCAST_BYTES else copies
    rest = base.where("doc_id is not null").join(near, "doc_id", "left_anti")
    ranges = shared.written(repeated_ranges(rest), "substring-ranges")
    size = ranges.agg(F.coalesce(F.sum(16 * F.size("ranges") + 64), F.lit(0))).first()[0]
    small = F.broadcast(ranges) if size <= shared.BROADCAST_BYTES else ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept_texts = [], [], []
            for text, pairs in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                kept, at = [], 0
                for a, b in sorted((r["start"], r["end"]) for r in pairs.as_py()):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                removed.append(len(words) - len(kept))
                kept = b" ".join(kept)
                digests.append(hashlib.sha256(kept).digest())
                kept_texts.append(kept.decode("utf-8", "replace"))
            arrays = [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())]
            names = ["doc_id", "n_removed", "left"]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_removed long, left binary" + ", kept string" * with_text
    changed = shared.written(rest.join(small, "doc_id").mapInArrow(shared.lean(run), schema).dropDuplicates(["doc_id"]), "substring-changed")
    out = facts.join(near.withColumn("copy", F.lit(True)), "doc_id", "left").join(changed, "doc_id", "left")
    whole = F.col("copy") & (F.col("n_words") >= WIDTH)
    empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    columns = [
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(whole, empty).otherwise(F.coalesce("left", "digest")))).alias("kept_sha256"),
    ]
    if with_text:
        whole_text = docs.select("doc_id", F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), "^$", "").alias("own")).dropDuplicates(["doc_id"])
        out = out.join(whole_text, "doc_id", "left")
        columns.append(F.when(whole, F.lit("")).otherwise(F.coalesce("kept", "own")).alias("kept"))
    return out.select(*columns)
