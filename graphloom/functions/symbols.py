"""Compressors that look at a whole text first: a reversible symbol map, and lines by their own distribution (row J).

Both read whole texts in Arrow batches; a text needs nothing of another.

Defined results: a null text counts as empty and stays so; extra columns are
kept as they are; columns that a function adds must not be there yet.
"""

from __future__ import annotations

import itertools
import math
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: Shortest identifier that gets a symbol, and the tokens that an entry of the map takes besides its names (fixed values).
LEAST_LENGTH, ENTRY_TOKENS = 6, 2
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+")
_IDENTIFIER = regex.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def anchors() -> Iterator[str]:
    """A, B, ... Z, AA, AB, ..."""
    for n in itertools.count(1):
        for letters in itertools.product(string.ascii_uppercase, repeat=n):
            yield "".join(letters)


def _tokens(word: str) -> int:
    return math.ceil(len(word) / 4)


def symbol_map(text: str) -> dict[str, str]:
    """symbol -> identifier: those whose uses save more tokens than their entry takes, the largest savings first; symbols are no words of the text."""
    words = Counter(_WORD.findall(text))
    saved = {w: n * (_tokens(w) - 1) for w, n in words.items() if len(w) >= LEAST_LENGTH and _IDENTIFIER.fullmatch(w)}
    worth = sorted((w for w, s in saved.items() if s > _tokens(w) + 1 + ENTRY_TOKENS), key=lambda w: (-len(w) * words[w], w))
    free = (a for a in anchors() if a not in words)
    return {next(free): w for w in worth}


def replace_words(text: str, by: dict[str, str]) -> str:
    return _WORD.sub(lambda m: by.get(m[0], m[0]), text) if by else text


def _mapped(docs: DataFrame, added: str, make: Callable[[str], tuple]) -> DataFrame:
    """``docs`` with the columns ``added`` that ``make`` gives of each text."""
    extra = StructType.fromDDL(added)
    clash = set(extra.names) & set(docs.columns)
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                found = zip(*(make(t or "") for t in part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(found, extra, strict=True))], [*part.schema.names, *extra.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra.fields]))


def with_symbols(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with short_text, in which repeated identifiers are symbols, and symbols, what each stands for."""

    def make(text: str) -> tuple:
        by = symbol_map(text)
        return replace_words(text, {w: s for s, w in by.items()}), list(by.items())

    return _mapped(docs, "short_text string, symbols map<string,string>", make)


def restored(short: DataFrame) -> DataFrame:
    """What ``with_symbols`` gave, with full_text, the text before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replace_words(t or "", dict(by or [])) for t, by in zip(batch.column("short_text").to_pylist(), batch.column("symbols").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "full_text"])

    return short.mapInArrow(run, StructType([*short.schema.fields, StructField("full_text", StringType())]))


#: What share of a text's lines, those of the least entropy, may go, by how far zlib shrinks it: below 0.3 of its size, below 0.6, other texts.
PRUNED = [(0.3, 0.4), (0.6, 0.2), (math.inf, 0.1)]


def line_entropy(line: str) -> float:
    """Bits for each character over the most that a line of that length could have; 0 to 1."""
    n = len(line)
    if n < 2:
        return 0.0
    counts = np.array(list(Counter(line).values()))
    return float(-(counts / n * np.log2(counts / n)).sum() / math.log2(n))


def compressed_share(text: str) -> float:
    """The size that zlib makes of a text, over its own; 1 for an empty one."""
    raw = text.encode("utf-8", "replace")
    return len(zlib.compress(raw)) / len(raw) if raw else 1.0


def dense_lines(text: str) -> str:
    """A text less its lines of low entropy: those below the quantile of its own lines that its compressibility allows; lines of structure stay, runs of blank lines become one."""
    lines = text.split("\n")
    scored = [line_entropy(line) for line in lines if line.strip()]
    share = compressed_share(text)
    least = float(np.quantile(scored, next(p for most, p in PRUNED if share < most))) if scored else 0.0
    kept: list[str] = []
    for line in lines:
        plain = line.strip()
        if not plain:
            if not kept or kept[-1].strip():
                kept.append(line)
        elif plain == "}" or plain.endswith("{") or plain.startswith(("fn ", "class ", "pub ", "def ")) or line_entropy(line) >= least:
            kept.append(line)
    return "\n".join(kept)


def with_dense_text(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with dense_text and compressed_share."""
    return _mapped(docs, "dense_text string, compressed_share double", lambda t: (dense_lines(t), compressed_share(t)))
