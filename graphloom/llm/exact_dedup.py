"""Operator 4, exact deduplication by an extendible-hash index on shared files.

Native: DataFrame functions only. Texts are equal when identical after
lower-casing A-Z; a null text counts as empty.

1. Every row gives a 64-bit hash and the SHA-256 of its normalised text;
   these short keys are written once to the shared folder.
2. The directory: starting from one bucket, a bucket with more distinct
   hashes than it holds splits on its next hash bit and the directory
   doubles when the bucket's depth reached its own, as in extendible hashing.
   A bucket holds ``CAPACITY`` hashes, or on large tables as many as leave
   about ``SLOTS`` buckets, so that the directory stays small enough to
   broadcast and none of its buckets is left overfull at any size.
3. Owner tasks: rows whose hash occurs once need no comparison. Of the others
   the texts are fetched and grouped by hash and bytes, copies combining
   before they are shuffled; different texts with one hash form a chain.
   The entries are range-partitioned by bucket and hash, so that each owner
   writes one range of buckets of the index.
4. Each row looks its entry up by hash and digest.

Defined results: the row with the largest doc_id stays (a null doc_id only if
all are null); rows repeated with one doc_id get the same answer; extra columns
are ignored. ``kept_documents`` settles ties of doc_id by row, so that exactly
one row of each group stays.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Distinct hashes in a bucket before it splits, and the buckets from which on the capacity grows instead.
CAPACITY = 8192
SLOTS = 1 << 14


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def directory(counts: dict[int, int], bits: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bucket, local depth) of each slot of the doubled directory, from the counts by leading ``bits``.

    The slot of a hash is its leading bits; its length is the directory's depth.
    """
    slots, depth = [(0, 0)], 0
    sums = [dict(counts)]
    for k in range(bits, 0, -1):
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    sums.reverse()  # sums[d][prefix]: the count by the leading d bits
    while depth <= bits:
        fuller = [d for s, (_, d) in enumerate(slots) if sums[d].get(s >> (depth - d), 0) > capacity and d < bits]
        if not fuller:
            break
        if min(fuller) == depth:
            slots = [x for x in slots for _ in (0, 1)]
            depth += 1
        out, split = [], set()
        for s, (b, d) in enumerate(slots):
            if d < depth and sums[d].get(s >> (depth - d), 0) > capacity and d < bits:
                split.add((b, d))
                b, d = (b << 1) | ((s >> (depth - d - 1)) & 1), d + 1
            out.append((b, d))
        slots = out
    numbers = {x: k for k, x in enumerate(dict.fromkeys((s >> (depth - d), d) for s, (_, d) in enumerate(slots)))}
    return [(numbers[s >> (depth - d), d], d) for s, (_, d) in enumerate(slots)]


def _slot(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _with_bucket(rows: DataFrame, slots: list[tuple[int, int]]) -> DataFrame:
    """Add the bucket of h: the directory, about 16 * SLOTS numbers at most, is broadcast."""
    bits = (len(slots) - 1).bit_length()
    if not bits:
        return rows.withColumn("bucket", F.lit(0))
    buckets = F.split(F.lit(",".join(str(b) for b, _ in slots)), ",")
    table = rows.sparkSession.range(1).select(F.posexplode(buckets).alias("slot", "b")).select("slot", F.col("b").cast("int").alias("bucket"))
    return rows.withColumn("slot", _slot(F.col("h"), bits)).join(F.broadcast(table), "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY, hash_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, index): keys has doc_id, h and digest of each row; index has bucket, h, chain, digest, keep_id, group_size."""
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    h = F.xxhash64(norm) if hash_of is None else hash_of
    base = docs.select("doc_id", "text")
    keys = shared.written(base.select("doc_id", h.alias("h"), F.unhex(F.sha2(norm, 256)).alias("digest")), "dedup-keys")
    heads = keys.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.max(F.hex("digest")).alias("hex"))
    heads = shared.written(heads, "dedup-heads")
    total = heads.count()
    capacity = max(capacity, total // SLOTS)
    bits = (total // capacity).bit_length() + 3 if total > capacity else 0
    histogram = {}
    if bits:
        rows = heads.groupBy(_slot(F.col("h"), bits).alias("slot")).agg(F.count("*").alias("n"))
        histogram = {r["slot"]: r["n"] for r in rows.collect()}  # at most 16 * SLOTS rows
    slots = directory(histogram, bits, capacity)
    singles = heads.where("n = 1").select("h", F.unhex("hex").alias("digest"), "keep_id", F.col("n").alias("group_size"))
    repeated = shared.written(heads.where("n > 1").select("h"), "dedup-repeated")
    few = repeated.count() * 16 <= shared.BROADCAST_BYTES
    wanted = F.broadcast(repeated) if few else repeated
    texts = base.withColumn("h", h).join(wanted, "h", "left_semi").select("h", norm.alias("norm"), "doc_id")
    compared = texts.groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    compared = compared.select("h", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("h").orderBy("digest")) - 1
    compared = compared.withColumn("chain", chain)
    entries = singles.withColumn("chain", F.lit(0)).unionByName(compared)
    entries = _with_bucket(entries, slots).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain")
    return keys, shared.written(entries.select("bucket", "h", "chain", "digest", "keep_id", "group_size"), "dedup-index")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY, hash_of: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    keys, index = build_index(docs, capacity, hash_of)
    found = keys.join(index.select("h", "digest", "keep_id", "group_size"), ["h", "digest"])
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, of one row of each group: one with the largest doc_id, or any if none has an id.

    No text is written: a row looks its group up by hash and digest, and rows
    of no group go nowhere. Only rows that tie, of one group and one doc_id,
    are grouped with all their columns.
    """
    keys, index = build_index(docs)
    groups = index.where("group_size > 1").select(F.col("h").alias("__h"), F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"))
    first = keys.join(groups, (F.col("h") == F.col("__h")) & (F.col("digest") == F.col("__digest"))).where(F.col("doc_id").eqNullSafe(F.col("__keep")))
    ties = first.groupBy("__h", "__digest", "__keep").agg(F.count("*").alias("k"))
    groups = shared.written(ties.select("__h", "__digest", "__keep", (F.col("k") > 1).alias("__tie")), "dedup-groups")
    shared.discard(keys, index)
    norm = normalised(F.col("text"))
    own = docs.withColumns({"__h": F.xxhash64(norm), "__digest": F.unhex(F.sha2(norm, 256))})
    few = groups.count() * 64 <= shared.BROADCAST_BYTES
    found = own.join(F.broadcast(groups) if few else groups, ["__h", "__digest"], "left")
    same = F.col("doc_id").eqNullSafe(F.col("__keep"))
    stay = found.where(F.col("__tie").isNull() | (same & ~F.col("__tie"))).select(*docs.columns)
    if groups.where("__tie").isEmpty():
        return stay
    one = found.where(same & F.col("__tie")).groupBy("__h", "__digest").agg(F.first(F.struct(*docs.columns)).alias("x"))
    return stay.unionByName(one.select("x.*"))
