"""Operator 5, byte-level BPE encoding and decoding in batched numpy rounds.

The texts of a slice are split into words by the tokenizer's pattern; each
distinct word is encoded once. The symbols of all those words lie in one flat
array. A round looks every adjacent pair up by binary search over the sorted
pair keys, finds the lowest rank of each word, merges that pair's occurrences
from the left without overlap, and compacts the array; words without a known
pair drop out. Decoding gathers the symbols' bytes from one flat table.

The tokenizer's file is a parameter; added special tokens in a text become
their own ids, as in the library's default.

Defined results: a null text counts as empty and gives no ids; repeated rows
each get a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from . import shared

#: The published split pattern of this tokenizer family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task keeps from slice to slice.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Tables:
    """Everything encoding and decoding need, as flat arrays."""

    byte_ids: np.ndarray  # the id of each single byte
    pair_keys: np.ndarray  # sorted left * size + right
    pair_ranks: np.ndarray
    rank_ids: np.ndarray  # the merged symbol of each rank
    size: int
    token_bytes: np.ndarray
    token_starts: np.ndarray
    special: dict[str, int]
    classes: np.ndarray  # of each code point


def load(path: str) -> Tables:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab: dict[str, int] = spec["model"]["vocab"]
    letters = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    byte_ids = np.zeros(256, np.int64)
    for ch, b in letters.items():
        byte_ids[b] = vocab[ch]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    raw = [b""] * size
    for token, k in vocab.items():
        raw[k] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, k in special.items():
        raw[k] = token.encode()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return Tables(byte_ids, keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64), size, np.frombuffer(b"".join(raw), np.uint8), starts, special, char_classes())


def pair_ranks(left: np.ndarray, right: np.ndarray, t: Tables) -> np.ndarray:
    """The rank of each pair, by binary search; pairs that never merge get the number of ranks."""
    keys = left * t.size + right
    at = np.searchsorted(t.pair_keys, keys)
    at[at == len(t.pair_keys)] = 0
    return np.where(t.pair_keys[at] == keys, t.pair_ranks[at], len(t.pair_ranks))


def merge_words(data: np.ndarray, lengths: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Of words given by their bytes: the ids of all in one array, and where each word's begin (one more than words).

    rank[i] belongs to the pair (i, i + 1); only pairs next to a merge are looked up again.
    """
    top = len(t.pair_ranks)
    symbols = t.byte_ids[data]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    done_owner, done_symbols = [], []
    rank = np.full(len(symbols), top)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner] = pair_ranks(symbols[inner], symbols[inner + 1], t)
    while len(symbols):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, first)
        span = np.diff(np.append(first, len(symbols)))
        each = np.repeat(least, span)
        live = each < top
        if not live.all():
            done_owner.append(owner[~live])
            done_symbols.append(symbols[~live])
            symbols, owner, rank, each = symbols[live], owner[live], rank[live], each[live]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == each)
        if (np.diff(at) == 1).any():  # of a run of adjacent hits (a a a) every second one merges, from the left
            begin = np.append(True, np.diff(at) != 1)
            at = at[(at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0]
        symbols[at] = t.rank_ids[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        at -= np.arange(len(at))  # their places once compacted
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        mark = np.zeros(len(symbols), bool)
        mark[at] = True
        mark[at[at > 0] - 1] = True
        near = np.flatnonzero(mark)
        rank[near] = top
        near = near[near < len(symbols) - 1]
        near = near[owner[near] == owner[near + 1]]
        rank[near] = pair_ranks(symbols[near], symbols[near + 1], t)
    owner = np.concatenate([*done_owner, np.zeros(0, np.int64)])
    symbols = np.concatenate([*done_symbols, np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(lengths))
    return symbols[order], np.concatenate([[0], np.cumsum(counts)])


def char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 space, for each code point, as the pattern's classes have them."""
    out = np.zeros(0x110000, np.uint8)
    for k, name in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out[np.frombuffer("".join(regex.findall(name, every)).encode("utf-32-le"), np.uint32)] = k
    return out


def split_words(points: np.ndarray, cuts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in ``points``; each of ``cuts`` begins a text.

    A match is a run of one class with at most one U+0020 before it, a
    contraction, or white space less the last character before a run.
    """
    n = len(points)
    kind = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    edge[n] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    begin = change[:n].copy()
    space = kind == 3
    # a run after white space of its own text takes a U+0020 along; other white space before a run stands alone
    run = np.flatnonzero(begin & ~space)
    after = run[(run > 0) & ~edge[run]]
    after = after[space[after - 1]]
    blank = after[points[after - 1] == 32]
    begin[after - 1] = True
    begin[blank] = False
    # contractions: a lone apostrophe that no blank precedes, with the letters after it
    lone = np.flatnonzero((points == 39) & change[:n] & begin)
    lone = lone[(lone + 1 < n)]
    lone = lone[change[lone + 1] & ~edge[lone + 1] & (kind[np.minimum(lone + 1, n - 1)] == 1)]
    if len(lone):
        one, two = points[lone + 1], np.where((lone + 2 < n), points[np.minimum(lone + 2, n - 1)], 0)
        two = np.where(edge[np.minimum(lone + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken = np.where(short, 1, np.where(long, 2, 0))
        lone, taken = lone[taken > 0], taken[taken > 0]
        begin[lone + 1] = False
        rest = lone + 1 + taken
        rest = rest[rest < n]
        begin[rest] |= kind[rest] == 1
    return np.flatnonzero(begin)


def gather(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """values[starts[p]:starts[p + 1]] of each p in picks, one after the other."""
    n = starts[picks + 1] - starts[picks]
    if not len(n):
        return values[:0]
    shift = np.repeat(starts[picks] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return values[shift + np.arange(int(n.sum()))]


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


class Codec:
    """Encodes slices of texts; keeps the ids of words it has met, up to a bound.

    Words are recognised by a 64-bit hash; ``encode`` decodes what it made and
    falls back to plain words for a text that did not come back the same.
    """

    def __init__(self, tables: Tables) -> None:
        self.t = tables
        self.classes = tables.classes
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.reset()

    def reset(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _pieces(self, texts: list[str]) -> tuple[list[str], list[list[int]]]:
        """Texts without special tokens, and for each text its pieces (>= 0) and special ids (< 0) in order."""
        pieces, plan = [], []
        for text in texts:
            own = []
            for j, part in enumerate(self.special.split(text) if self.special and any(s in text for s in self.t.special) else [text]):
                if j % 2:
                    own.append(-1 - self.t.special[part])
                elif part:
                    own.append(len(pieces))
                    pieces.append(part)
            plan.append(own)
        return pieces, plan

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """The ids of each text and what they decode to."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        pieces, plan = self._pieces(texts)
        encoded = self._encode(pieces)
        out = []
        for text, own in zip(texts, plan, strict=True):
            parts = [encoded[k] if k >= 0 else np.array([-1 - k]) for k in own]
            ids = parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
            decoded = self.decode(ids)
            if decoded != text:  # two words with one hash
                parts = [self._plain(pieces[k]) if k >= 0 else np.array([-1 - k]) for k in own]
                ids = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
                decoded = self.decode(ids)
            out.append((ids, decoded))
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has; what all of them decode to is compared with the texts, as in ``encode``."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        pieces, plan = self._pieces(texts)
        codes, first = self._codes(pieces)
        if self.decode(gather(self.ids, self.starts, codes)) != "".join(pieces):  # two words with one hash
            return np.array([len(ids) for ids, _ in self.encode(texts)], np.int64)
        ends = np.concatenate([[0], np.cumsum(np.diff(self.starts)[codes])])[first]
        each = np.diff(ends)
        return np.array([sum(int(each[k]) if k >= 0 else 1 for k in own) for own in plan], np.int64)

    def _plain(self, text: str) -> np.ndarray:
        words = [w.encode("utf-8", "replace") for w in regex.findall(PATTERN, text)]
        return merge_words(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64), self.t)[0]

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        codes, first = self._codes(pieces)
        return [gather(self.ids, self.starts, codes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def _codes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the pieces in turn, and where each piece's words begin (one more than pieces)."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), np.uint32)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        starts = split_words(points, cuts[:-1], self.classes)
        ends = np.append(starts[1:], len(points))
        down = np.full(len(points), _INVERSE, np.uint64)
        down[0] = 1
        np.multiply.accumulate(down, out=down)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(shared.mix(points.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
        up = np.full(len(points), _ODD, np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        hashes = shared.mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        index, codes, fresh = self.index, np.empty(len(distinct), np.int64), []
        for k, h in enumerate(distinct.tolist()):
            c = index.get(h)
            if c is None:
                c = index[h] = len(index)
                fresh.append(k)
            codes[k] = c
        if fresh:
            at = where[np.array(fresh)]
            text = gather(points, np.append(starts, len(points)), at).tobytes().decode("utf-32-le").encode("utf-8", "replace")
            data = np.frombuffer(text, np.uint8)
            heads = np.flatnonzero((data & 0xC0) != 0x80)  # of the characters
            chars = np.concatenate([[0], np.cumsum(ends[at] - starts[at])])
            bounds = np.append(heads, len(data))[chars]
            ids, begin = merge_words(data, np.diff(bounds), self.t)
            self.starts = np.concatenate([self.starts, begin[1:] + self.starts[-1]])
            self.ids = np.concatenate([self.ids, ids])
        return codes[back], np.searchsorted(starts, cuts)

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.t.token_bytes, self.t.token_starts, ids).tobytes().decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; ``with_ids`` adds the ids and the decoded text."""
    spark = docs.sparkSession
    shared.small_batches(spark, size=4 << 20)
    held = spark.sparkContext.broadcast(load(path))  # 50 thousand tokens and merges: about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            for a, b in shared.text_slices(batch.column("text")):
                found = codec.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                columns = [
                    batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                    pa.array([len(ids) for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in found], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([ids.astype(np.int32) for ids, _ in found], pa.list_(pa.int32())), pa.array([text for _, text in found], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))


def with_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs``, which has text and no column n_tokens, with n_tokens in the place of text."""
    spark = docs.sparkSession
    shared.small_batches(spark, size=4 << 20)
    held = spark.sparkContext.broadcast(load(path))
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.concatenate([np.zeros(0, np.int64), *(codec.count(texts[a:b]) for a, b in shared.text_slices(batch.column("text")))])
            columns = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*(f.name for f in others), "n_tokens"])

    return docs.mapInArrow(shared.lean(run), StructType([*others, StructField("n_tokens", LongType())]))
