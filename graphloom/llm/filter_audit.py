"""Operator 12, how filters interact: what each removes at each place of every order.

Every document gets a mask of the filters that it fails. A table worked out
beforehand says, for each of the 32 masks and 120 orders, at which step a
document of that mask goes. ``mapInArrow`` counts the documents of a task by
part, mask and label with ``np.bincount``, looks the masks up in the table and
sums the removals by part, order, step and label with ``np.bincount`` again; the
tasks' partial arrays are then summed by Spark.

The four rules on texts are built-in expressions of one scan, which leaves a
digest of the text and the mask. The fifth, a text that a smaller doc_id has
too, compares a row with the least doc_id of its digest: minima are combined
before they are shuffled, and rows look them up by digest and doc_id, so that a
text that many rows hold needs no task of its own.

Defined results: a null text counts as empty and fails A only (and E, if a
smaller doc_id is empty too); a null lang is the part ''; a row without doc_id
never fails E, makes no other row fail it and has no label; rows that repeat a
doc_id with one text do not fail E for each other; a doc_id with several labels
has quality 1, or toxic 1, if one of them has; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MASKS = 1 << STEPS
#: The filter (0 to 4) at each step of each order.
FILTER_AT = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def first_failures() -> np.ndarray:
    """For each mask and order the step (0 to 4) at which such a document goes, 5 if it stays."""
    fails = (np.arange(MASKS)[:, None, None] >> FILTER_AT[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


FIRST = first_failures()


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_mask() -> Column:
    """Bits of the filters A to D that a text fails, from its words w, n_upper, n_chars and marked."""
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    tests = [n < 100, 100 * distinct < 80 * n, 100 * F.col("n_upper") > 10 * F.col("n_chars"), F.col("marked")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of A to D, by one scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marked = F.length(F.translate(text, "#$%&*|", "")) < F.length(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        words_of(text).alias("w"), upper.alias("n_upper"), F.length(text).alias("n_chars"), marked.alias("marked"),
    )
    return rows.select("doc_id", "part", "digest", text_mask().alias("mask"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits) and label (bit 0 quality, bit 1 toxic) of each document."""
    rows = shared.written(measured(docs), "audit-rows")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + 2 * F.max(F.when(F.col("toxic") == 1, 1).otherwise(0))).alias("label")
    )
    both = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return both.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("label", F.lit(0)).alias("label"))


def removals(cells: np.ndarray) -> dict[str, np.ndarray]:
    """What documents counted by mask and label (32 x 4) give for each order and step (120 x 5)."""
    mask, order = np.divmod(np.arange(MASKS * len(ORDERS)), len(ORDERS))
    at = order * (STEPS + 1) + FIRST[mask, order]
    gone = [np.bincount(at, cells[mask, k], len(ORDERS) * (STEPS + 1)).reshape(len(ORDERS), STEPS + 1).astype(np.int64)[:, :STEPS] for k in range(4)]
    of_mask = cells.sum(axis=1)
    bits = np.arange(STEPS)
    fails = np.array([of_mask[(np.arange(MASKS) >> b) & 1 == 1].sum() for b in bits])
    alone = of_mask[1 << bits]
    removed = sum(gone)
    by_filter = np.bincount(FILTER_AT.ravel(), removed.ravel(), STEPS).astype(np.int64)
    return {
        "kept": of_mask.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[FILTER_AT] - removed, "unique_fails": alone[FILTER_AT],
        "good_lost": gone[1] + gone[3], "toxic_lost": gone[2] + gone[3], "shapley": by_filter[FILTER_AT],
    }


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one task: rows of each part it has met, order and step."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        mask, label = (np.asarray(batch.column(c)).astype(np.int64) for c in ("mask", "label"))
        names = part.dictionary.to_pylist()
        flat = (np.asarray(part.indices).astype(np.int64) * MASKS + mask) * 4 + label
        cells = np.bincount(flat, minlength=len(names) * MASKS * 4).reshape(len(names), MASKS, 4)
        for k, name in enumerate(names):
            found[name] = found[name] + cells[k] if name in found else cells[k]
    for name, cells in found.items():
        counts = removals(cells)
        n = len(ORDERS) * STEPS
        keys = [pa.array([name] * n, pa.string()), pa.array(np.repeat(ORDERS, STEPS), pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32())]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(counts[c].ravel(), pa.int64()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with its counts of documents."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    partial = audited(docs, labels).mapInArrow(partial_counts, schema)
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))
