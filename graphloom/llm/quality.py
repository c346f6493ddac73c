"""Operator 1, quality rules: a short-circuit cascade ordered by rejection per cost.

Each rule reads lazily computed measures of a text. On a bounded sample the
cascade measures what every rule costs and how many texts it rejects alone,
then runs the rules by rejections per second: a text rejected by a cheap,
selective rule never reaches a costly one. The verdict (all rules hold) does
not depend on the order, so the sample changes the speed only.

Defined results: a null or empty text has no words, so it fails the base
rules; ids pass through untouched, null ones too; repeated rows each get their
own row; a long text is measured whole, with a few numbers for each of its
words; extra columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Texts whose rules are timed; a bound on a sample that only orders the rules.
SAMPLE_ROWS = 256
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_LETTER = re.compile(r"[^\W\d_]")


class Measures:
    """Measures of one text, each computed on first use."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # splits bytes at \x20 and \x09-\x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(t.count(c) for c in " \t\n\v\f\r")

    @cached_property
    def n_symbols(self) -> int:
        counts = np.bincount(np.frombuffer(self.data, np.uint8), minlength=128)
        return int(counts[_SYMBOLS].sum())

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def codes(self) -> np.ndarray:
        ids: dict[bytes, int] = {}
        return np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        c = self.codes
        if len(c) < 4:
            return 0
        k = int(c.max()) + 1
        _, pair = np.unique(c[:-1] * k + c[1:], return_inverse=True)  # exact: under 2**63 for any text below 3e9 words
        window = pair[:-1].astype(np.int64) * k + c[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(len(c), bool)
        for s in range(3):
            covered[s : s + len(window)] |= twice
        return int(covered.sum())

    @cached_property
    def n_distinct_words(self) -> int:
        return int(self.codes.max()) + 1 if self.n_words else 0

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.text.split() if _LETTER.search(w))

    @cached_property
    def n_shouted(self) -> int:
        """Words of two or more characters in capitals that have a letter."""
        return sum(1 for w in self.text.split() if len(w) > 1 and w.isupper())


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true of a text that fails the rule."""

    name: str
    rejects: Callable[[Measures], bool]


def _rules() -> list[Rule]:
    return [
        Rule("word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words),
        Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
        Rule("duplicate_lines", lambda m: 100 * m.n_dup_lines > 35 * max(1, len(m.lines))),
        Rule("distinct_words", lambda m: 100 * m.n_distinct_words < 10 * min(m.n_words, 500)),
        Rule("letter_words", lambda m: 100 * m.n_letter_words < 70 * m.n_words),
        Rule("shouting", lambda m: 100 * m.n_shouted > 60 * m.n_words),
    ]


RULES = _rules()


def costs(texts: Iterable[str | None], rules: list[Rule] = RULES) -> list[tuple[str, float, int]]:
    """(rule, seconds, rejected texts) of each rule run alone on ``texts``."""
    took = {r.name: [0.0, 0] for r in rules}
    for text in texts:
        for rule in rules:
            began = time.perf_counter()
            rejected = rule.rejects(Measures(text))
            took[rule.name][0] += time.perf_counter() - began
            took[rule.name][1] += rejected
    return [(name, seconds, n) for name, (seconds, n) in took.items()]


def order_of(measured: Iterable[tuple[str, float, int]]) -> list[str]:
    """The rules by texts rejected per second; ties and no rejections: the cheaper first."""
    return [x[-1] for x in sorted((-n / max(seconds, 1e-9), seconds, name) for name, seconds, n in measured)]


def plan_order(docs: DataFrame, rows: int = SAMPLE_ROWS, tasks: int = 4) -> list[str]:
    """The order of the rules by what they cost and reject on the first texts of a few partitions.

    Each task stops reading after its part of ``rows``, and no more tasks run
    than give ``tasks`` answers; only times and counts reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, seconds, n = zip(*costs(x.as_py() for x in batch.column("text").slice(0, rows // tasks)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(seconds), pa.array(n, pa.int64())], ["name", "seconds", "n"])
                return

    found = docs.select("text").mapInArrow(shared.lean(run), "name string, seconds double, n long").limit(tasks * len(RULES)).collect()
    sums = {r.name: [0.0, 0] for r in RULES}
    for r in found:
        sums[r["name"]][0] += r["seconds"]
        sums[r["name"]][1] += r["n"]
    return order_of((name, seconds, n) for name, (seconds, n) in sums.items())


def first_failure(m: Measures, order: list[Rule]) -> str | None:
    return next((r.name for r in order if r.rejects(m)), None)


def apply_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the first rule that rejected (null: none, or base)."""
    shared.small_batches(docs.sparkSession)
    names = order or plan_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in RULES}
        rules = [by_name[n] for n in names]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                m = Measures(text.as_py())
                failed = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
                why = None if failed else first_failure(m, rules)
                rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, not failed and why is None, why))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), SCHEMA)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
)
