"""Vector search for query sets: exact in blocks, and approximate by an index on files (rows I4, I9).

Vectors travel as blocks, some thousand in one row as a matrix of floats, so
that tasks multiply matrices and no row is handled by itself. Neither side's
vectors reach the driver.

The index has coarse centroids, the lists of vectors nearest to each, and of
every vector a product code of its difference from the centroid. Centroids and
code books are trained on a sample of at most ``TRAIN_ROWS`` vectors; every
vector is in the index. A search sends each query to the lists of its nearest
centroids, scores their codes by table look-ups (how many lists is measured by brute force
on the sample: vectors without clusters need many), keeps ``adaptive_k`` candidates
and scores those by their own vectors. Candidates of one list are looked up in
blocks, so a list that holds a third of all vectors is shared by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import adaptive_k

#: Vectors and queries in one block, at most.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 256
#: Vectors that train the index, at most: a bound, whatever the size of the table.
TRAIN_ROWS = 20_000
ROUNDS = 12
#: Rows of the sample that tell how many lists a search takes, and the share of their nearest that these lists must hold.
CALIBRATING, COVERED = 256, 0.97
#: Entries of a code book, so that a code is one byte.
BOOK = 256
BLOCK = "n int, ids binary, matrix binary"
#: Bytes of one Arrow batch (a row of two blocks has about 2 MB), and of distances that a task holds at once, whatever the number of rows and lists.
BATCH_BYTES, HELD_BYTES = 8 << 20, 8 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, scaled to length 1 (zero vectors stay)."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _row(*values: tuple[object, pa.DataType]) -> list[pa.Array]:
    return [pa.array([v], kind) for v, kind in values]


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: by Spark's own bound some thirty blocks would lie in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def usable(V: DataFrame, key: str) -> DataFrame:
    """(id, embedding) of the rows that have part in a search: those with a key and a vector of numbers."""
    return V.select(F.col(key).cast("long").alias("id"), "embedding").where("id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))")


def blocks(V: DataFrame, key: str, size: int) -> DataFrame:
    """(key, embedding) as blocks (n, ids, matrix) of at most ``size`` unit vectors; rows without a vector of numbers or without a key have no part in a search; all vectors must have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                x = _matrix(part.column(1))
                yield pa.RecordBatch.from_arrays(_row((len(x), pa.int32()), (np.asarray(part.column(0)).astype("<i8").tobytes(), pa.binary()), (x.astype("<f8").tobytes(), pa.binary())), ["n", "ids", "matrix"])

    return usable(V, key).mapInArrow(run, BLOCK)


def _ids(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<i8")


def _floats(value: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<f8").reshape(rows, -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``score`` the places of its k largest, the smaller id first among equal ones; ``ids`` ascend."""
    if score.shape[1] > 4 * k:  # all that reach the k-th largest, then in order
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        some = np.flatnonzero((score >= least[:, None]).any(axis=0))
        return some[np.argsort(-score[:, some], axis=1, kind="stable")[:, :k]]
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps k of each task before it shuffles them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def exact_nearest(V: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, cosine: the k vectors (vec_id, embedding) nearest to each query (query_id, embedding), by all rows.

    A stated query set against all rows in blocks: blocks of vectors are dealt
    out to groups, and each block of queries meets every group.
    """
    small_batches(V.sparkSession)
    groups = int(V.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks(V, "vec_id", VECTOR_BLOCK).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = blocks(queries, "query_id", QUERY_BLOCK).select(F.col("n").alias("m"), F.col("ids").alias("asked"), F.col("matrix").alias("wanted"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            for j in range(batch.num_rows):
                ids, q_ids = _ids(c["ids"][j]), _ids(c["asked"][j])
                order = np.argsort(ids, kind="stable")
                score = np.round(_floats(c["wanted"][j], len(q_ids)) @ _floats(c["matrix"][j], len(ids))[order].T, 6)
                at = _best(score, ids[order], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, at.shape[1])), pa.array(ids[order][at].ravel()), pa.array(np.take_along_axis(score, at, 1).ravel())], ["query_id", "vec_id", "cosine"])

    return _top(rows.join(asked, "g").select("ids", "matrix", "asked", "wanted").mapInArrow(run, "query_id long, vec_id long, cosine double"), k)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the n nearest centres, the first among equal ones before the others, and the least distance (less the row's own square)."""
    own, step = (centres * centres).sum(axis=1)[None], max(1, HELD_BYTES // (8 * len(centres)))
    places, least = [np.zeros((0, min(n, len(centres))), np.int64)], [np.zeros(0)]
    for a in range(0, len(x), step):
        far = own - 2 * x[a : a + step] @ centres.T
        places.append(far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n])
        least.append(far.min(axis=1))
    return np.concatenate(places), np.concatenate(least)


def k_means(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Centres of at most k groups of the rows of x; an empty group takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near, far = _nearest(x, centres)
        near = near[:, 0]
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        for j, row in zip(np.flatnonzero(count == 0), np.argsort(-far), strict=False):
            centres[j] = x[row]
    return centres


@dataclass(frozen=True)
class Books:
    """What searches need to know of an index: centroids (lists x dims) and code books (parts x BOOK x dims of a part)."""

    centroids: np.ndarray
    books: np.ndarray

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        return _nearest(x, self.centroids, n)[0]

    def codes(self, rest: np.ndarray) -> np.ndarray:
        """One byte for each part of each row."""
        parts = rest.reshape(len(rest), len(self.books), -1)
        return np.stack([((b**2).sum(axis=1)[None] - 2 * parts[:, j] @ b.T).argmin(axis=1) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)


@dataclass(frozen=True)
class Index:
    """Where the coded lists lie, and the books; ``rows`` vectors in all."""

    path: str
    books: Books
    rows: int
    probes: int  # lists that a search takes, if not stated


def probes_needed(x: np.ndarray, centroids: np.ndarray, k: int = 10, seed: int = 1) -> int:
    """How many lists hold ``COVERED`` of the k nearest, by brute force for some rows of the sample x: in the whole table the nearest are nearer, in lists no farther away."""
    some = np.random.default_rng(seed).choice(len(x), min(CALIBRATING, len(x)), replace=False)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf  # a query need not be a row
    near = _best(score, np.arange(len(x)), min(k, max(1, len(x) - 1)))
    places = np.argsort(_nearest(x[some], centroids, len(centroids))[0], axis=1)
    far = np.take_along_axis(places, _nearest(x, centroids)[0][:, 0][near], 1)
    return min(len(centroids), max(8, int(np.quantile(far, COVERED)) + 1))


def train(V: DataFrame, lists: int, parts: int, seed: int = 1) -> tuple[Books, int]:
    """(books, lists that a search needs), by a sample of at most ``TRAIN_ROWS`` vectors, taken by hash of the id, so that a repeat takes the same."""
    rows = V.select(F.col("vec_id").cast("long").alias("id"), "embedding").where("id IS NOT NULL AND size(embedding) > 0")
    n = rows.count()
    share = 1.0 if n <= TRAIN_ROWS else 0.95 * TRAIN_ROWS / n
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).limit(TRAIN_ROWS)
    held = [np.frombuffer(bytes(r["matrix"]), "<f8").reshape(r["n"], -1) for r in blocks(picked.withColumnRenamed("id", "vec_id"), "vec_id", VECTOR_BLOCK).collect()]
    x = np.concatenate(held)
    x = x[np.lexsort(x.T)]  # whatever the order in which tasks end
    centroids = k_means(x, lists, seed)
    rest = x - centroids[_nearest(x, centroids)[0][:, 0]]
    cut = rest.reshape(len(rest), parts, -1)
    books = np.stack([np.resize(k_means(cut[:, j], BOOK, seed + j), (BOOK, cut.shape[2])) for j in range(parts)])
    return Books(centroids, books), probes_needed(x, centroids, seed=seed)


def build_index(V: DataFrame, folder: str, lists: int | None = None, parts: int = 16) -> Index:
    """Write the index of every vector of ``V`` (vec_id, embedding of a length that ``parts`` divides) to a new folder.

    There are about as many lists as the root of the number of rows, if not
    stated. A row of the index is a part of one list: up to ``VECTOR_BLOCK`` ids
    and their codes.
    """
    spark = V.sparkSession
    small_batches(spark)
    rows = V.where("vec_id IS NOT NULL AND size(embedding) > 0").count()
    if not rows:
        raise ValueError("an index needs vectors")
    lists = lists or int(min(65_536, max(1, round(rows**0.5))))
    books, probes = train(V, lists, parts)
    held = spark.sparkContext.broadcast(books)  # lists x dims and 256 x dims numbers, bounded by the two parameters

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, VECTOR_BLOCK):
                ids, x = np.asarray(batch.column("id")[a : a + VECTOR_BLOCK]), _matrix(batch.column("embedding")[a : a + VECTOR_BLOCK])
                lists = b.nearest_lists(x, 1)[:, 0]
                codes = b.codes(x - b.centroids[lists])
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(ids), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "vec_id", "code"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sorted by list
            lists = np.asarray(batch.column("list"))
            edges = np.flatnonzero(np.diff(lists, prepend=-1, append=-1))
            for first, end in zip(edges, edges[1:], strict=False):
                for a in range(first, end, VECTOR_BLOCK):
                    b = min(end, a + VECTOR_BLOCK)
                    ids, codes = np.asarray(batch.column("vec_id"))[a:b], b"".join(batch.column("code").slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_arrays(_row((int(lists[a]), pa.int32()), (ids.astype("<i8").tobytes(), pa.binary()), (codes, pa.binary())), ["list", "ids", "codes"])

    coded = usable(V, "vec_id").mapInArrow(code, "list int, vec_id long, code binary")
    path = f"{folder.rstrip('/')}/ann-{uuid.uuid4().hex}"
    dealt = coded.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")  # a large list lies in many files
    dealt.mapInArrow(gather, "list int, ids binary, codes binary").write.parquet(path)
    return Index(path, books, rows, probes)


def approximate_nearest(index: Index, V: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, cosine: about the k nearest of each query (query_id, embedding), found by ``index`` of ``V``.

    ``probes`` lists are searched for each query (if not stated, as many as the
    index found needed); the ``candidates`` best codes (twice ``adaptive_k`` of
    the index's size, if not stated) are scored by their vectors. Of one list a
    query takes its share of them fourfold, and four times k at least.
    """
    spark: SparkSession = V.sparkSession
    small_batches(spark)
    candidates = candidates or max(k, 2 * adaptive_k(index.rows))
    probes = probes or index.probes
    each = min(candidates, max(4 * k, -(-4 * candidates // probes)))
    held = spark.sparkContext.broadcast(index.books)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                ids, x = np.asarray(batch.column("id")[a : a + QUERY_BLOCK]).astype("<i8"), _matrix(batch.column("embedding")[a : a + QUERY_BLOCK])
                to = b.nearest_lists(x, probes)
                for one in np.unique(to):
                    own = np.flatnonzero((to == one).any(axis=1))
                    yield pa.RecordBatch.from_arrays(_row((int(one), pa.int32()), (ids[own].tobytes(), pa.binary()), (x[own].tobytes(), pa.binary())), ["list", "asked", "wanted"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            for j in range(batch.num_rows):
                ids, q_ids = _ids(batch.column("ids")[j]), _ids(batch.column("asked")[j])
                x = _floats(batch.column("wanted")[j], len(q_ids))
                codes = np.frombuffer(batch.column("codes")[j].as_buffer(), np.uint8).reshape(len(ids), -1)
                base = x @ b.centroids[batch.column("list")[j].as_py()]
                about = np.repeat(base[:, None], len(ids), axis=1)
                for p, part in enumerate(x.reshape(len(x), len(b.books), -1).transpose(1, 0, 2)):
                    about += (part @ b.books[p].T)[:, codes[:, p]]
                at = _best(about, ids, min(each, len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, at.shape[1])), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(about, at, 1).ravel())], ["query_id", "vec_id", "cosine"])

    asked = usable(queries, "query_id").mapInArrow(deal, "list int, asked binary, wanted binary")
    coded = spark.read.schema("list int, ids binary, codes binary").parquet(index.path)
    found = coded.join(asked, "list").mapInArrow(score, "query_id long, vec_id long, cosine double")
    kept = _top(found, candidates).select("query_id", "vec_id")
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("wanted"))
    pairs = kept.join(V.select("vec_id", "embedding"), "vec_id").join(wanted, "query_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.round((_matrix(batch.column("embedding")) * _matrix(batch.column("wanted"))).sum(axis=1), 6)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(cosine)], ["query_id", "vec_id", "cosine"])

    return _top(pairs.select("query_id", "vec_id", "embedding", "wanted").mapInArrow(compare, "query_id long, vec_id long, cosine double"), k)
