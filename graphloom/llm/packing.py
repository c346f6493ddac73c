"""Operator 2, conflict-constrained best-fit packing of documents into sequences.

Every document has a length in tokens, a source and a duplicate cluster. Two
documents of one source or of one cluster never share a bin. Documents are
dealt by hash to shards of about ``SHARD_ROWS`` rows; only their short keys
move. In a shard the longest come first. The open bins are kept in order of
their residual room, each with a bitmap of the sources and one of the clusters
it holds. A document looks up the tightest bin with room and goes on to the
next larger residual until a bin is compatible, so it gets the tightest
compatible bin; if there is none it opens one. A document longer than a bin
fills whole bins alone and only its rest is packed.

Lengths are counts of tokens by operator 5's encoder; the tokenizer's file is a
parameter.

Defined results: null and empty texts have length 0 and still get a bin; a
null source or cluster conflicts with nothing; ties of residual go to the
older bin, ties of length to the smaller doc_id; each repeated row is packed
on its own; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared
from .exact_dedup import normalised

CAPACITY = 2048
SHARD_ROWS = 4096
#: The public tokenizer that counts where no other file is given.
TOKENIZER = "byte_bpe_50k.json"


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """For each (length, source, cluster), in the given order: its pieces as (piece, bin, offset, tokens)."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    out: list[list[tuple[int, int, int, int]]] = []
    for length, source, cluster in items:
        pieces = []
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        whole, rest = divmod(length, capacity)
        if length and not rest:
            whole, rest = whole - 1, capacity
        for k in range(whole):
            pieces.append((k, len(sources), 0, capacity))
            sources.append(s)
            clusters.append(c)
        at = bisect.bisect_left(order, (rest, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & s or clusters[b] & c):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        pieces.append((whole, b, capacity - residual, rest))
        bisect.insort(order, (residual - rest, b))
        out.append(pieces)
    return out


SCHEMA = "doc_id long, piece int, bin_id long, bin_offset long, n_tokens long"


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack ``items`` (doc_id, length, source, cluster): one row for each piece of a document."""
    shards = max(1, math.ceil(items.count() / shard_rows))
    # source and cluster of rows without an id keep those rows from meeting in one shard
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "length"), F.lit(shards))

    def run(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_pylist() for c in ("length", "doc_id", "cluster", "source")]
        last = lambda v: (v is None, v or 0)
        items = sorted(zip(*columns, strict=True), key=lambda x: (-x[0], last(x[1]), last(x[2])))
        often = Counter(columns[2])
        keys = [(n, source, cluster if often[cluster] > 1 else None) for n, _, cluster, source in items]
        base = rows.column("shard")[0].as_py() << 32
        found = [(x[1], k, base + b, o, n) for x, own in zip(items, best_fit(keys, capacity), strict=True) for k, b, o, n in own]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "piece", "bin_id", "bin_offset", "n_tokens"])

    return items.select("doc_id", "length", "source", "cluster", shard.alias("shard")).groupBy("shard").applyInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, tokenizer: str | None = None) -> DataFrame:
    """Pack documents by their tokens; the duplicate cluster of a text is its normalised form's hash."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    cluster = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.xxhash64(normalised(F.col("text"))))
    keyed = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), cluster.alias("cluster"))
    items = bpe.with_token_counts(keyed, tokenizer).withColumnRenamed("n_tokens", "length")
    return pack(shared.written(items, "packing-items"), capacity, shard_rows)
