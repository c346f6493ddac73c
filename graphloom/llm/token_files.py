"""Operator 11, token ids in binary files of fixed bit width.

``write_tokens`` encodes documents with the tokenizers library, appends an end
id to each and writes all ids, in ascending doc_id order, to shard files.
``read_tokens`` reads documents of those files back, and ``TokenFile`` any range
of ids. Both sides are one Spark data source, ``packed_token_ids``.

A shard file holds a header, blocks of ``BLOCK_IDS`` ids, and a footer. Every id
takes the fewest bits that hold the vocabulary's largest id, and each block
begins at a whole byte, whose place the footer lists. So any block is found and
unpacked by itself, by numpy. The footer also holds each document's id and the
place of its last id. All numbers are little-endian::

    header   magic (8 bytes), width u32, ids of a block u32
    blocks   packed ids, the lowest bit first
    footer   block places u64 (one more than blocks), doc ids i64, 1 for a null doc id u8, document ends u64
    trailer  documents u64, ids u64, blocks u64, bytes of the footer u64, magic

Bounds of doc_id that deal the documents out evenly come from one sketch of the
column; ids are shuffled once, as compressed bytes, to the shard that their
document belongs to and sorted there. A doc_id that many rows share gets several
shards. A task writes its shard as a stream, under a name of its own, and only
the manifest, written once all tasks have ended, makes files part of the
dataset: what lost or repeated tasks leave is never read. What the driver holds
is a bound and a line of the manifest for each shard.

Each distinct word is encoded by the library once for each worker (as long as it
is kept): the words are
found by the splitting rule of byte-level tokenizers, of which the library finds
the same, and a word's characters are compared before its ids are taken. For
tokenizer files with other rules, and for texts that hold an added token, whole
texts go through the library.

Defined results: a null text counts as empty and gives the end id alone; null
doc ids come first; rows of one doc_id follow each other in the order of a
checksum of their ids, and repeated rows are each written; extra columns are
ignored; an empty table gives a dataset without shards. Files lie where pyarrow
can write (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import bpe, shared

MAGIC = b"GLTOKID1"
HEADER = struct.Struct("<8sII")
TRAILER = struct.Struct("<QQQQ8s")
BLOCK_IDS = 1 << 16
#: Bytes of text for each shard where that asks for more shards than the session's shuffle partitions.
SHARD_TEXT_BYTES = 1 << 30
#: Ids that a reading task takes, if its documents are shorter than that.
READ_IDS = 1 << 22
END_ID = 0
#: Words whose ids a worker keeps.
KEPT_WORDS = 800_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 19
FORMAT = "packed_token_ids"
MANIFEST = "manifest.json"
COLUMNS = "doc_id long, start long, n_tokens long, ids array<int>, ids_crc32 long"


def bit_width(size: int) -> int:
    """The fewest bits that hold every id below ``size``."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, the lowest bit first, filled up to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack_bits`` gave."""
    raw = np.frombuffer(data, np.uint8)
    if width in (8, 16, 32):
        return raw[: n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    # the four bytes from an id's first one hold up to 25 bits of it, the byte after them the rest
    first = np.arange(n, dtype=np.int64) * width
    byte, shift = first >> 3, (first & 7).astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(5, np.uint8)])
    value = np.zeros(n, np.uint64)
    for k in range(5):
        value |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and the folder's name there."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:]
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class TokenFile:
    """Random access to one shard file."""

    def __init__(self, store: pyarrow.fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.block_ids = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        docs, self.n_ids, blocks, footer, end = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        raw = self.file.read_at(footer, size - TRAILER.size - footer)
        cut = np.cumsum([8 * (blocks + 1), 8 * docs, docs, 8 * docs])
        self.places = np.frombuffer(raw[: cut[0]], "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(raw[cut[0] : cut[1]], "<i8")
        self.nulls = np.frombuffer(raw[cut[1] : cut[2]], np.uint8).astype(bool)
        self.ends = np.frombuffer(raw[cut[2] : cut[3]], "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids at places [begin, end) of this file; only the blocks that hold them are read."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        a, b = begin // self.block_ids, -(-end // self.block_ids)
        raw = np.frombuffer(self.file.read_at(int(self.places[b] - self.places[a]), int(self.places[a])), np.uint8)
        out = []
        for k in range(a, b):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack_bits(raw[self.places[k] - self.places[a] : self.places[k + 1] - self.places[a]], self.width, n))
        return np.concatenate(out)[begin - a * self.block_ids : end - a * self.block_ids]

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents [a, b) begin, and end: places of this file."""
        return np.concatenate([[0], self.ends])[a:b], self.ends[a:b]


@dataclass
class Shard(WriterCommitMessage):
    order: int
    name: str
    docs: int
    ids: int


class Writer(DataSourceArrowWriter):
    """Each task streams its sorted documents (doc_id, payload) to one shard file."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        from pyspark import TaskContext

        order = TaskContext.get().partitionId()
        iterator = (batch for batch in iterator if batch.num_rows)
        first = next(iterator, None)
        if first is None:
            return Shard(order, "", 0, 0)
        store, folder = open_store(self.path)
        name = f"shard-{order:06d}-{uuid.uuid4().hex}.ids"
        doc_ids, nulls, counts, places, n_ids = [], [], [], [HEADER.size], 0
        rest = np.zeros(0, np.uint32)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(HEADER.pack(MAGIC, self.width, BLOCK_IDS))

            def put(ids: np.ndarray) -> None:
                data = pack_bits(ids, self.width)
                out.write(data)
                places.append(places[-1] + len(data))

            for batch in itertools.chain([first], iterator):
                ids = batch.column("doc_id")
                doc_ids.append(np.asarray(ids.fill_null(0)).astype(np.int64))
                nulls.append(np.asarray(ids.is_null()).astype(np.uint8))
                held, size = [rest], len(rest)
                for data in batch.column("payload"):
                    found = unwrap(data.as_py(), self.width)
                    counts.append(len(found))
                    held.append(found)
                    size += len(found)
                    if size >= 16 * BLOCK_IDS:
                        held, size = [self._whole(np.concatenate(held), put)], 0
                        size = len(held[0])
                rest = self._whole(np.concatenate(held), put)
            if len(rest):
                put(rest)
            ends = np.cumsum(np.array(counts, np.int64))
            n_ids = int(ends[-1]) if len(ends) else 0
            parts = [np.array(places, "<u8"), np.concatenate([np.zeros(0, np.int64), *doc_ids]).astype("<i8"), np.concatenate([np.zeros(0, np.uint8), *nulls]), ends.astype("<u8")]
            footer = b"".join(x.tobytes() for x in parts)
            out.write(footer)
            out.write(TRAILER.pack(len(counts), n_ids, len(places) - 1, len(footer), MAGIC))
        return Shard(order, name, len(counts), n_ids)

    @staticmethod
    def _whole(ids: np.ndarray, put) -> np.ndarray:
        """Write the whole blocks of ``ids``; what is left of them."""
        end = len(ids) - len(ids) % BLOCK_IDS
        for k in range(0, end, BLOCK_IDS):
            put(ids[k : k + BLOCK_IDS])
        return ids[end:].copy()

    def commit(self, messages: list[Shard | None]) -> None:
        store, folder = open_store(self.path)
        shards = sorted((m.order, m.name, m.docs, m.ids) for m in messages if m is not None and m.docs)
        text = json.dumps({"width": self.width, "block_ids": BLOCK_IDS, "shards": [list(s[1:]) for s in shards]})
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(text.encode())

    def abort(self, messages: list[Shard | None]) -> None:
        store, folder = open_store(self.path)
        for m in messages:
            if m is not None and m.docs:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class Slice(InputPartition):
    name: str
    base: int  # ids of all shards before
    first: int
    last: int


class Reader(DataSourceReader):
    """A task reads some documents of one shard; of the columns, those of the schema asked for."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def partitions(self) -> list[Slice]:
        store, folder = open_store(self.path)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
            shards = json.loads(f.read())["shards"]
        out, base = [], 0
        for name, docs, ids in shards:
            edges = np.linspace(0, docs, min(docs, max(1, math.ceil(ids / READ_IDS))) + 1).astype(int).tolist()
            out += [Slice(name, base, a, b) for a, b in zip(edges, edges[1:], strict=False)]
            base += ids
        return out or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = open_store(self.path)
        file = TokenFile(store, f"{folder}/{partition.name}")
        begin, end = file.documents(partition.first, partition.last)
        wants_ids = {"ids", "ids_crc32"} & set(self.names)
        at = 0
        while at < len(begin):
            upto = max(at + 1, int(np.searchsorted(end, begin[at] + READ_IDS // 4, "right")))
            a, b = begin[at:upto], end[at:upto]
            columns = {
                "doc_id": pa.array(file.doc_ids[partition.first + at : partition.first + upto], pa.int64(), mask=file.nulls[partition.first + at : partition.first + upto]),
                "start": pa.array(a + partition.base),
                "n_tokens": pa.array(b - a),
            }
            if wants_ids:
                ids = file.ids(int(a[0]), int(b[-1]))
                raw, base = memoryview(ids.astype("<u4").tobytes()), int(a[0])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - base, pa.int32()), pa.array(ids.astype(np.int32)))
                columns["ids_crc32"] = pa.array([zlib.crc32(raw[4 * (x - base) : 4 * (y - base)]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)
            at = upto


class PackedTokenIds(DataSource):
    """Options: path, and for writing width, the bits of an id."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options["width"]))


def wrap(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as whole bytes, compressed, for the shuffle; the first four bytes say how long they were."""
    size = -(-width // 8)
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]).tobytes()
    return struct.pack("<I", len(ids)) + pa.compress(raw, "zstd", asbytes=True)


def unwrap(data: bytes, width: int) -> np.ndarray:
    size, n = -(-width // 8), struct.unpack_from("<I", data)[0]
    raw = np.frombuffer(pa.decompress(memoryview(data)[4:], n * size, "zstd", asbytes=True), np.uint8).reshape(-1, size)
    out = np.zeros((n, 4), np.uint8)
    out[:, :size] = raw
    return out.view("<u4").ravel()


class Grown:
    """An array that grows at its end; what it holds is moved only when its room doubles."""

    def __init__(self, kind: type) -> None:
        self.room, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.room[: self.n]


def pick(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """values[starts[p]:starts[p] + sizes[p]] of each p in picks, one after the other."""
    n = sizes[picks]
    ends = np.cumsum(n, dtype=np.int32)
    if not len(n):
        return values[:0]
    at = np.repeat(starts[picks] - (ends - n), n)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


class WordEncoder:
    """Encodes texts with the library, each distinct word once as long as it is kept.

    Words are recognised by a 64-bit hash, looked up in a sorted array, and their
    characters are compared with the kept ones before their ids are taken.
    """

    def __init__(self, spec: str, classes: np.ndarray | None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.classes = classes
        self.added = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.reset()

    def reset(self) -> None:
        """``known`` and ``recent``: sorted hashes and the words' numbers; the recent ones are few and join the others from time to time."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.known, self.recent = none, none
        self.points, self.point_starts, self.point_sizes = Grown(np.uint32), Grown(np.int32), Grown(np.int32)
        self.ids, self.starts, self.sizes = Grown(np.int32), Grown(np.int32), Grown(np.int32)
        self.uses = Grown(np.int32)

    def _forget(self) -> None:
        """Keep the words that were met more than once, at most half of what may be kept, those most often met."""
        uses = self.uses.view()
        kept = np.flatnonzero(uses > 1)
        if len(kept) > KEPT_WORDS // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: KEPT_WORDS // 2]])
        hashes, numbers = self._both()
        before = self.points, self.point_starts, self.point_sizes, self.ids, self.starts, self.sizes
        points, point_starts, point_sizes, ids, starts, sizes = (x.view() for x in before)
        self.reset()
        self._learn(pick(points, point_starts, point_sizes, kept), point_sizes[kept], pick(ids, starts, sizes, kept), sizes[kept])
        number = np.full(len(uses), -1, np.int32)
        number[kept] = np.arange(len(kept))
        held = number[numbers] >= 0
        self.known = hashes[held], number[numbers[held]]

    def _both(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known[0], self.recent[0])
        return np.insert(self.known[0], at, self.recent[0]), np.insert(self.known[1], at, self.recent[1])

    def _learn(self, points: np.ndarray, point_sizes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.point_starts.add(self.points.n + np.cumsum(point_sizes) - point_sizes)
        self.starts.add(self.ids.n + np.cumsum(sizes) - sizes)
        for store, values in ((self.points, points), (self.point_sizes, point_sizes), (self.ids, ids), (self.sizes, sizes), (self.uses, np.zeros(len(sizes), np.int32))):
            store.add(values)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.classes is None:
            return [self._whole(t) for t in texts]
        if self.uses.n > KEPT_WORDS:
            self._forget()
        plain = [not any(s in t for s in self.added) for t in texts]
        found = iter(self._words([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(found) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.int32)] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = bpe.split_words(points, cuts[:-1][cuts[:-1] < len(points)], self.classes)
        edges = np.append(starts, len(points))
        codes = self._codes(joined, points, edges)
        if not np.array_equal(pick(self.points.view(), self.point_starts.view(), self.point_sizes.view(), codes), points):  # two words with one hash
            return [self._whole(t) for t in texts]
        sizes = self.sizes.view()
        ids = pick(self.ids.view(), self.starts.view(), sizes, codes)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.searchsorted(starts, cuts)]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _codes(self, joined: str, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The number of each word; words met for the first time are encoded by the library."""
        place = np.arange(len(points), dtype=np.int32) - np.repeat(edges[:-1].astype(np.int32), np.diff(edges))
        factor = shared.mix(np.arange(1, int(place.max()) + 2, dtype=np.uint64)) | np.uint64(1)
        sums = np.add.reduceat(_mixed_points()[points] * factor[place], edges[:-1])
        distinct, where, back, times = np.unique(shared.mix(sums), return_index=True, return_inverse=True, return_counts=True)
        codes = np.full(len(distinct), -1, np.int32)
        for hashes, numbers in (self.known, self.recent):
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
                held = hashes[at] == distinct
                codes[held] = numbers[at[held]]
        fresh = np.flatnonzero(codes < 0)
        if len(fresh):
            codes[fresh] = self.uses.n + np.arange(len(fresh))
            first = where[fresh]
            words = [joined[a:b] for a, b in zip(edges[first].tolist(), edges[first + 1].tolist(), strict=True)]
            ids, sizes = zip(*(self._each(words[k : k + 1000]) for k in range(0, len(words), 1000)), strict=True)
            point_sizes = np.diff(edges)[first].astype(np.int32)
            self._learn(pick(points, edges[:-1].astype(np.int32), np.diff(edges).astype(np.int32), first), point_sizes, np.concatenate(ids), np.concatenate(sizes))
            at = np.searchsorted(self.recent[0], distinct[fresh])
            self.recent = np.insert(self.recent[0], at, distinct[fresh]), np.insert(self.recent[1], at, codes[fresh])
            if len(self.recent[0]) > 1 << 15:
                self.known, self.recent = self._both(), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.uses.view()[codes] += times.astype(np.int32)
        return codes[back]


@functools.cache
def _mixed_points() -> np.ndarray:
    """A well mixed number for each code point."""
    return shared.mix(np.arange(1, 0x110001, dtype=np.uint64))


_encoders: dict[str, WordEncoder] = {}


def worker_encoder(spec: str, classes: np.ndarray | None) -> WordEncoder:
    """The encoder of this worker, which later tasks find with the words it has met."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = WordEncoder(spec, classes)
    return _encoders[spec]


def splits_like_bytes(spec: dict) -> bool:
    """Whether the tokenizer parts texts by the byte-level pattern and nothing else, so that words can be encoded alone."""
    split = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    return spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)


def shard_bounds(docs: DataFrame) -> np.ndarray:
    """Keys that deal the rows out evenly, in order: one fewer than shards. A key that many rows share is there several times."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    total = docs.agg(F.sum(F.octet_length("text").cast("decimal(38,0)"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(total) / SHARD_TEXT_BYTES))
    if shards == 1:
        return np.zeros(0, np.int64)
    shares = [k / shards for k in range(1, shards)]
    bounds = docs.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 20 * shards)))).first()[0]
    return np.array(bounds or [], np.int64)


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, bounds: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """doc_id, shard, tie and the compressed ids (payload) of each document, and the bits of an id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    width = bit_width(max([end_id or 0, *Tokenizer.from_str(spec).get_vocab(with_added_tokens=True).values()]) + 1)
    bounds = np.zeros(0, np.int64) if bounds is None else bounds
    shared.small_batches(spark, size=4 << 20)
    held = spark.sparkContext.broadcast((spec, bpe.char_classes() if splits_like_bytes(json.loads(spec)) else None))  # the tokenizer's file and a byte for each code point: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(*held.value)
        tail = np.array([] if end_id is None else [end_id], np.int32)
        for batch in batches:
            for a, b in shared.text_slices(batch.column("text"), SLICE_BYTES):
                ids = batch.column("doc_id").slice(a, b - a).cast(pa.int64())
                found = encoder.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                payload = [wrap(np.concatenate([x, tail]), width) for x in found]
                tie = np.array([zlib.crc32(x) for x in payload], np.int64)
                key = np.asarray(ids.fill_null(-(1 << 63)))
                low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                yield pa.RecordBatch.from_arrays([ids, pa.array((low + tie % (high - low + 1)).astype(np.int32)), pa.array(tie), pa.array(payload, pa.binary())], ["doc_id", "shard", "tie", "payload"])

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), "doc_id long, shard int, tie long, payload binary"), width


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> None:
    """Write a dataset of all documents' ids to the new folder ``path``."""
    bounds = shard_bounds(docs)
    rows, width = encoded(docs, tokenizer, end_id, bounds)
    docs.sparkSession.dataSource.register(PackedTokenIds)
    dealt = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    dealt.select("doc_id", "payload").write.format(FORMAT).option("width", str(width)).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, columns: str = COLUMNS) -> DataFrame:
    """The documents of a dataset; ``columns`` names those that are read, of ``COLUMNS``."""
    spark.dataSource.register(PackedTokenIds)
    return spark.read.format(FORMAT).schema(columns).load(path)


def digests(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Write all documents to a dataset in the shared folder and read doc_id, start, n_tokens and ids_crc32 from it."""
    spark = docs.sparkSession
    path = f"{shared.shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long")
