"""What the near-copy join holds at once, where one shingle's list or one task's texts are large."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

J = pytest.importorskip("graphloom.llm.jaccard_join")


class Plan:
    """Takes the place of a DataFrame: keeps the function that workers would run."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = select = repartition

    def mapInArrow(self, run, _):
        self.run = run
        return self

    groupBy = agg = where = repartition


def given(call, batches, names):
    plan = Plan()
    try:
        call(plan)
    except (TypeError, AssertionError):  # expressions of Spark's after the function
        pass
    return list(plan.run(pa.RecordBatch.from_arrays([pa.array(x) for x in b], names) for b in batches))


POSTINGS = ["token", "star", "part", "posting"]


def posting(size, place, kind):
    return (size << 31) + (place << 2) + kind


def in_batches(rows, size=1000):
    c = np.array(sorted(rows, key=lambda r: r[0]), np.int64)
    return [[np.ascontiguousarray(c[i : i + size, k]) for k in range(4)] for i in range(0, len(c), size)]


def test_a_long_list_gives_few_pairs_at_a_time(spark):
    rows = [(5, star, star, posting(100, 0, J.SOLO)) for star in range(1200)] + [(9, star, star, posting(100, 0, J.SOLO)) for star in (3, 7)]
    out = given(J.candidates, in_batches(rows), POSTINGS)
    assert sum(b.num_rows for b in out) == 1200 * 1199 // 2 + 1
    assert max(b.num_rows for b in out) <= 100_000


def test_a_list_gives_each_pair_of_stars_once(spark):
    rng = random.Random(4)
    sizes = {(token, star): [rng.randrange(60, 140) for _ in range(rng.choice([1, 2, 40]))] for token in (2, 3, 4) for star in range(30)}
    rows = [(token, star, star // 2, posting(n, 0, J.ONE)) for (token, star), all_n in sizes.items() for n in all_n]
    rng.shuffle(rows)
    found = Counter()
    for b in given(J.candidates, in_batches(rows, 50), POSTINGS):
        found.update(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    near = lambda x, y: 80 * min(x) <= 100 * max(y) and 80 * min(y) <= 100 * max(x)
    assert found == Counter((a, b) for token in (2, 3, 4) for a in range(30) for b in range(a + 1, 30) if a // 2 != b // 2 and near(sizes[token, a], sizes[token, b]))


def test_frequent_shingles_are_counted_in_place(spark):
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(30))
    small = [["one two three four five", "one two three four five x", "a"], [f"{common} u{k} v{k} w{k} x{k} y{k}" for k in range(3)], ["a b c d e", "z a b c d e"]]
    for texts in small:
        want = Counter()
        for s in {s[0]: s for s in reversed(list(J.sets_of(pa.array(texts))))}.values():  # of texts with one least hash the first counts
            want.update(s.view(np.int64).tolist())
        rows = [r for b in given(J.facts, [[list(range(len(texts))), texts]], ["doc_id", "text"]) for r in b.to_pylist()]
        assert {r["a"]: r["b"] for r in rows if r["kind"] == 1} == {s: n for s, n in want.items() if n >= J.OFTEN}
    texts = [" ".join(f"{rng.randrange(10**6):x}" for _ in range(20_000)) for _ in range(100)]
    tracemalloc.start()
    given(J.facts, ([[i], [t]] for i, t in enumerate(texts)), ["doc_id", "text"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * 20_000 * len(texts), peak
