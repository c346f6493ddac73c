"""What several of the operators need: shared folders, word hashing, batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised code.
CHUNK_BYTES = 1 << 20
#: Largest estimated size of a side that is broadcast; beyond it the plans shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    if next(_steps) % RELEASE_EVERY == 0:
        release(spark)
    return out


#: Where the frames that ``written`` gave lie, and a count of them.
_paths: dict[int, tuple[weakref.ref, str]] = {}
_steps = itertools.count(1)
#: Written tables after which the plans and shuffle files of the steps before are let go.
RELEASE_EVERY = 6


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have been written: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete written tables whose every use has itself been written."""
    for frame in frames:
        held, path = _paths.pop(id(frame), (lambda: None, None))
        if path and held() is frame:
            jvm = frame.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The column that ``with_row_key`` adds.
ROW_KEY = "__row"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number of its own for each row, since doc_id may be null or repeat."""
    return written(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed-rows")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker gives freed memory back to the system, since workers stay for later stages."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return whole


def text_slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    begin, n = 0, len(lengths)
    while begin < n:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield begin, end
        begin = end


#: Words are hashed by polynomials modulo this prime, at one random base for each lane; fixed, so that every task hashes alike.
_PRIME = (1 << 31) - 1
_BASES = [int(x) for x in np.random.default_rng(20240229).integers(1 << 20, _PRIME - 1, 4)]
#: Bytes that are hashed at once; a longer word goes alone.
_BLOCK = 1 << 19
#: An odd factor of hashes of sequences.
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**k modulo the prime for k below n (or more), kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 1)
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:  # the second half is the first times base**done
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(step) % np.uint64(_PRIME)
            done, step = done + more, step * step % _PRIME
        _powers[base] = have = have.astype(np.uint32)
    return have


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: their hashes, and where each text begins.

    ``lanes`` of 31 bits each: 2 give ``hashes``, 4 also ``second``, whose lanes
    are its own. The texts are taken in blocks cut at white space, so memory is
    in proportion to the words, whatever the length of a text.
    """

    def __init__(self, texts: pa.Array, lower: bool, lanes: int = 2) -> None:
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
        raw = pa.concat_arrays([raw]) if raw.offset else raw
        buffers = raw.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, len(raw) + 1)
        self.data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        n, begin = len(self.data), 0
        parts, starts = [np.zeros((lanes // 2, 0), np.uint64)], [np.zeros(0, np.int64)]
        while begin < n:
            end = min(n, begin + _BLOCK)
            while end < n:  # on to a white space or the end of a text
                gap = np.flatnonzero(_SPACE[self.data[end : end + 4096]])
                edge = self.offsets[np.searchsorted(self.offsets, end)]
                end = min(int(edge), end + (int(gap[0]) if len(gap) else 4096))
                if len(gap) or end == edge:
                    break
            found, h = self._block(begin, end, lower, lanes)
            starts.append(found + begin)
            parts.append(h)
            begin = end
        self.starts = np.concatenate(starts)
        both = np.concatenate(parts, axis=1)
        self.hashes, self.second = both[0], both[-1]
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, and one past the last

    def _block(self, begin: int, end: int, lower: bool, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        data = self.data[begin:end]
        n = len(data)
        inside = ~_SPACE[data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        k = np.searchsorted(self.offsets, [begin, end])
        cut = self.offsets[k[0] : k[1]] - begin
        head[cut] = inside[cut]  # a text ends the word before it
        starts = np.flatnonzero(head)
        last = np.ones(n, bool)
        last[:-1] = head[1:] | ~inside[1:]
        ends = np.flatnonzero(last & inside) + 1
        value = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        size = (ends - starts).astype(np.uint64)
        lane = [self._lane(value, starts, ends, base) for base in _BASES[:lanes]]
        odd = np.uint64(_BASE)
        return starts, np.stack([mix((lane[j] | lane[j + 1] << np.uint64(31)) + size * odd) for j in range(0, lanes, 2)]) if n else np.zeros((lanes // 2, 0), np.uint64)

    @staticmethod
    def _lane(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
        """Of each word the sum of (byte + 1) * base**place, modulo the prime."""
        prime, n = np.uint64(_PRIME), len(value)
        up = powers(base, n)
        total = np.zeros(n + 1, np.uint64)
        for a in range(0, n, _BLOCK):  # a block's sum stays below 2**59
            b = min(n, a + _BLOCK)
            np.cumsum(value[a:b] * up[a:b], out=total[a + 1 : b + 1])
            total[a + 1 : b + 1] += total[a] % prime
        gone = total[starts] % prime
        return (total[ends] % prime + prime - gone) % prime * powers(pow(base, -1, _PRIME), n)[starts] % prime

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n] + np.uint64(seed)
    for k in range(1, width):
        h = h * np.uint64(_BASE) + hashes[k : k + n]
        h ^= h >> np.uint64(29)
    return mix(h)
