"""Operator 9, exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles (64-bit hashes) of the
text with A-Z lower-cased. Two documents link when 100 * intersection is at
least 80 * union. The result is each document's component.

1. Equal sets are one class; only its smallest doc_id goes on.
2. Stars: documents that agree in a band of minima propose the one with the
   fewest rare shingles as centre. A document is compared with the centre that
   most of its bands name, and with the others only if that is no link. A
   document whose centre is itself no member joins that star with a known
   distance. The links found give the first components.
3. Index: shingles are ordered rare first (counted over all documents in every
   task, the frequent ones by count), and the prefix of each set that every
   partner must meet is posted with its component. Entries of one star collapse
   to one posting (least and largest size, least position), combined before the
   shuffle. Each list is walked in order of size: blocks out of the size range,
   postings whose positions cannot reach the needed overlap and postings of one
   component are skipped.
4. Answers of similar sets: Jaccard distance is a metric. For a candidate pair
   of stars only the centres are compared at first; their members' answers
   follow from it: if the centres link, the stars are one component, and if
   their distance exceeds 0.2 by more than the members' distances to the
   centres, no members link. Where that leaves it open, the documents of the
   lesser star are compared with the other's centre c, and the answer of a
   member m for such an x is derived from c's: |m & x| is at most |c & x| and
   what m and x share beyond c. So only the shingles beyond c are joined, and
   pairs are compared that reach the needed overlap by that bound.
   Comparisons go in rounds, one pair of two components before the others, and
   after each round pairs whose ends are by then in one component are dropped.
5. Components of the verified links.

No link between different components is lost: every pair of linked documents
shares a prefix shingle, so its stars are candidates, and a pair of stars is
dropped only by these bounds or when already in one component.

Defined results: null and empty texts have an empty set and link with nothing;
texts of 1 to 4 words are one shingle; a null doc_id links with nothing; rows
repeated with one doc_id are one document; long texts are read whole, in
blocks; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components
from .shared import Words

WIDTH = 5
#: Threshold as a fraction: 100 * inter >= PERCENT * union.
PERCENT = 80
#: Bands of minima that propose centres, and minima in a band.
BANDS, ROWS = 8, 3
#: Most frequent shingles whose order follows their counts; an order only, no result depends on it.
FREQUENT = 500_000
#: A shingle counts as frequent in a task from this many of its documents on, those with one least hash counted once.
OFTEN = 3
_ODD = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for a, b in shared.text_slices(texts):
        w = Words(texts.slice(a, b - a), lower=True)
        grams = shared.windows(w.hashes, WIDTH, 5)
        for k in range(b - a):
            lo, hi = w.first[k], w.first[k + 1]
            if hi - lo >= WIDTH:
                yield np.unique(grams[lo : hi - WIDTH + 1])
            elif hi > lo:
                yield shared.windows(w.hashes[lo:hi], int(hi - lo), 100 + int(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of linked sets of n and m shingles."""
    return -(-(PERCENT * (n + m)) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def facts(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, size and the hash of each set (a, b, c, d); kind 1: shingle and its count in some task (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            found = np.concatenate(held)
            held.clear()  # with the sort in place, no more than one copy of the shingles is held
            found.sort()
            tokens = np.unique(found[: len(found) - OFTEN + 1][found[OFTEN - 1 :] == found[: len(found) - OFTEN + 1]]) if len(found) >= OFTEN else found[:0]
            return tokens, np.searchsorted(found, tokens, "right") - np.searchsorted(found, tokens)

        def table(kind: int, *columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], ["kind", "a", "b", "c", "d"])

        for batch in batches:
            n, c, d = [], [], []
            for s in sets_of(batch.column("text")):
                n.append(len(s))
                c.append(np.bitwise_xor.reduce(shared.mix(s)) if len(s) else 0)
                d.append(np.add.reduce(shared.mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0)
                # near copies mostly have one least hash: they count once, so that the frequent are what different texts share
                if len(s) and int(s[0]) not in seen:
                    seen.add(int(s[0]))
                    held.append(s)
                    size += len(s)
                if size > 3_000_000:
                    tokens, times = counted()
                    none = pa.nulls(len(tokens), pa.int64())
                    yield table(1, pa.array(_signed(tokens)), pa.array(times.astype(np.int64)), none, none)
                    held, seen, size = [], set(), 0
            yield table(0, batch.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(_signed(np.array(c, np.uint64))), pa.array(_signed(np.array(d, np.uint64))))
        if held:
            tokens, times = counted()
            none = pa.nulls(len(tokens), pa.int64())
            yield table(1, pa.array(_signed(tokens)), pa.array(times.astype(np.int64)), none, none)

    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), "kind int, a long, b long, c long, d long")


class Order:
    """Rare shingles first, by hash; the frequent ones last, by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def weights(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, self.weights(s)))[: prefix_length(len(s))]]


def band_rows(docs: DataFrame, order: object) -> DataFrame:
    """band, rare (thousandths of the set that are not frequent), doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            bands, rare, owner = [], [], []
            for doc_id, s in zip(ids, sets_of(batch.column("text")), strict=True):
                if len(s):
                    least = np.array([(s * odd).min() for odd in _ODD]).reshape(BANDS, ROWS)
                    h = shared.windows(least.T.copy().reshape(-1), 1, 9).reshape(ROWS, BANDS)
                    h = shared.mix(h[0] + shared.mix(h[1] + shared.mix(h[2])) + np.arange(BANDS, dtype=np.uint64))
                    bands.append(h)
                    rare += [int(1000 * (order.value.weights(s) == 0).sum() // len(s))] * BANDS
                    owner += [doc_id] * BANDS
            found = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(rare, pa.int32()), pa.array(owner, pa.int64())], ["band", "rare", "doc_id"])

    return docs.mapInArrow(shared.lean(run), "band long, rare int, doc_id long")


#: What a posting stands for: a document in no star with others, one of such a star, several of one.
SOLO, ONE, SEVERAL = 0, 1, 2


def posting_rows(docs: DataFrame, order: object) -> DataFrame:
    """token, star, its component and the posting (size, place and kind in one number) of every prefix shingle.

    docs: star, part, solo, text. Of a star's documents in one batch each shingle gives
    one posting, or one of the smallest and one of the largest size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars = batch.column("star").to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            solo = batch.column("solo").to_numpy(zero_copy_only=False)
            tokens, owner, part, what = [], [], [], []
            for star, of, alone, s in zip(stars, parts, solo, sets_of(batch.column("text")), strict=True):
                if len(s):
                    p = order.value.prefix(s)
                    tokens.append(p)
                    owner.append(np.full(len(p), star, np.int64))
                    part.append(np.full(len(p), of, np.int64))
                    what.append((len(s) << 31) + (np.arange(len(p), dtype=np.int64) << 2) + (SOLO if alone else ONE))
            if not tokens:
                continue
            token, star, part, posting = _signed(np.concatenate(tokens)), np.concatenate(owner), np.concatenate(part), np.concatenate(what)
            starry = np.flatnonzero(posting & 3)
            if len(starry):
                by = starry[np.lexsort((posting[starry], star[starry], token[starry]))]
                new = np.append(True, (token[by][1:] != token[by][:-1]) | (star[by][1:] != star[by][:-1]))
                end = np.append(new[1:], True)
                keep = np.ones(len(token), bool)
                keep[by[~(new | end)]] = False
                posting[by[~(new & end)]] |= SEVERAL
                token, star, part, posting = token[keep], star[keep], part[keep], posting[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(star), pa.array(part), pa.array(posting)], ["token", "star", "part", "posting"])

    return docs.mapInArrow(shared.lean(run), "token long, star long, part long, posting long")


#: Postings of a list that are compared at once, and rows of lists that are walked together and of pairs that are given on together, about.
BLOCK, ROWS_AT_ONCE = 256, 1 << 15


def one_of_each(token: np.ndarray, star: np.ndarray, part: np.ndarray, posting: np.ndarray) -> tuple[np.ndarray, ...]:
    """token, star, part, least and largest size, place and kind of lists in which each star has one row, whatever batches its documents came in."""
    high, place, kind = posting >> 31, (posting >> 2) & ((1 << 29) - 1), posting & 3
    low, keep = high.copy(), np.ones(len(token), bool)
    starry = np.flatnonzero(kind)
    if len(starry):
        by = starry[np.lexsort((posting[starry], star[starry], token[starry]))]
        new = np.append(True, (token[by][1:] != token[by][:-1]) | (star[by][1:] != star[by][:-1]))
        end = np.append(new[1:], True)
        low[by[end]] = high[by[new]]
        kind[by[end & ~new]] = SEVERAL
        keep[by[~end]] = False
    return tuple(x[keep] for x in (token, star, part, low, high, place, kind))


def list_pairs(star: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, kind: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of rows of one list, of different components, that can still hold a link, a block of BLOCK x BLOCK at most at a time.

    The list is sorted by size; blocks whose sizes are out of range are
    skipped, and positions bound what two sets can share. Where a row stands
    for several documents their least and largest size bound the range.
    """
    by = np.argsort(high, kind="stable")
    star, part, low, high, place, kind = star[by], part[by], low[by], high[by], place[by], kind[by]
    n = len(star)
    for begin in range(0, n if (part != part[0]).any() else 0, BLOCK):
        rows = np.arange(begin, min(begin + BLOCK, n))
        for other in range(begin, n, BLOCK):
            cols = np.arange(other, min(other + BLOCK, n))
            if PERCENT * int(low[cols].min()) > 100 * int(high[rows].max()):
                continue  # the whole block is too large
            r, c = np.meshgrid(rows, cols, indexing="ij")
            ok = (c > r) & (part[r] != part[c]) & (PERCENT * low[c] <= 100 * high[r]) & (PERCENT * low[r] <= 100 * high[c])
            r, c = r[ok], c[ok]
            ok = (kind[r] > ONE) | (kind[c] > ONE) | _reachable(high[r], high[c], place[r], place[c])
            r, c = r[ok], c[ok]
            yield _pair_rows(star[r], star[c], part[r], part[c], high[r], high[c], place[r], place[c], (kind[r] | kind[c]) == SOLO)


def _reachable(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that share the shingle at places i and j can link: before it they share min(i, j) at most."""
    return np.minimum(i, j) + 1 + np.minimum(n - 1 - i, m - 1 - j) >= needed(n, m)


def _pair_rows(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, solo: np.ndarray) -> np.ndarray:
    """Rows of a < b, their components, sizes and places, and whether both are solo."""
    turn = x > y
    pick = lambda one, other: np.where(turn, other, one)
    return np.stack([pick(x, y), pick(y, x), pick(p, q), pick(q, p), pick(n, m), pick(m, n), pick(i, j), pick(j, i), solo.astype(np.int64)], axis=1)


def candidates(postings: DataFrame) -> DataFrame:
    """Distinct pairs of stars (a < b) of different components (p, q) that meet in a list and are not skipped, with the times they met.

    A pair of single documents has met in all shingles that both prefixes hold;
    with their number and the last places known, the bound is taken once more.
    """
    lists = postings.repartition("token").sortWithinPartitions("token")
    names = ["a", "b", "p", "q", "n_a", "n_b", "i", "j", "solo"]

    def walk(c: list[np.ndarray]) -> Iterator[np.ndarray]:
        token, *rows = one_of_each(*c)
        star, part, low, high, place, kind = rows
        cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        ends = np.append(cut[1:], len(token))
        i = cut[ends - cut == 2]  # the usual list, of two: all at once
        j = i + 1
        ok = (part[i] != part[j]) & (PERCENT * low[i] <= 100 * high[j]) & (PERCENT * low[j] <= 100 * high[i])
        ok &= (kind[i] > ONE) | (kind[j] > ONE) | _reachable(high[i], high[j], place[i], place[j])
        i, j = i[ok], j[ok]
        yield _pair_rows(star[i], star[j], part[i], part[j], high[i], high[j], place[i], place[j], (kind[i] | kind[j]) == SOLO)
        for s, e in zip(cut[ends - cut > 2], ends[ends - cut > 2], strict=True):
            yield from list_pairs(*(x[s:e] for x in rows))

    def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, n, enough = [], 0, ROWS_AT_ONCE
        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            n += batch.num_rows
            if n >= enough:
                c = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.searchsorted(c[0], c[0][-1]))  # the last list may go on in the next batch
                held, n = [[x[last:].copy() for x in c]], n - last
                enough = max(ROWS_AT_ONCE, 2 * n)
                if last:
                    yield [x[:last] for x in c]
        if n:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def table() -> pa.RecordBatch:
            rows = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(9)], names)

        for c in whole_lists(batches):
            for pairs in walk(c):
                held.append(pairs)
                n += len(pairs)
                if n >= ROWS_AT_ONCE:  # however many pairs a list has, few are held
                    yield table()
                    held, n = [], 0
        if n:
            yield table()

    met = lists.select("token", "star", "part", "posting").mapInArrow(shared.lean(run), ", ".join(f"{n} long" for n in names))
    met = met.groupBy("a", "b").agg(*(F.max(n).alias(n) for n in names[2:8]), F.min("solo").alias("solo"), F.count("*").alias("met"))
    bound = F.col("met") + F.least(F.col("n_a") - 1 - F.col("i"), F.col("n_b") - 1 - F.col("j"))
    least = F.ceil((F.col("n_a") + F.col("n_b")) * PERCENT / (100 + PERCENT) - 1e-6)
    return met.where((F.col("solo") == 0) | (bound >= least)).select("a", "b", "p", "q", "met")


def verify(docs: DataFrame, pairs: DataFrame, beyond: bool = False) -> DataFrame:
    """a, b, inter, total (size of the union) of each pair; ``beyond`` adds the size n of b's set and what of it is not in a's.

    pairs: a written table of distinct (a, b); docs: one row of each doc_id.
    """
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = shared.written(wanted, "jaccard-wanted")
    few = wanted.count() * 16 <= shared.BROADCAST_BYTES
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    left = pairs.select("a", "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            # rows come sorted by b: a text that repeats is hashed once
            again = [k == 0 or b[k] != b[k - 1] for k in range(len(b))]
            fresh = iter(sets_of(batch.column("text_b").filter(pa.array(again))))
            inter, total, size, rest, y = [], [], [], [], None
            for x, new in zip(sets_of(batch.column("text_a")), again, strict=True):
                y = next(fresh) if new else y
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                n = int((y[at] == x).sum())
                inter.append(n)
                total.append(len(x) + len(y) - n)
                if beyond:
                    size.append(len(y))
                    rest.append(_signed(y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y]))
            columns = [pa.array(c, pa.int64()) for c in (a, b, inter, total, *([size] if beyond else []))]
            if beyond:
                columns.append(pa.array(rest, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "inter", "total", *(["n", "rest"] if beyond else [])])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(shared.lean(run), "a long, b long, inter long, total long" + ", n long, rest array<bigint>" * beyond)


_LINKED = f"100 * inter >= {PERCENT} * total"


def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the components p and q of their ends, of those that lie in two; parts: node, component."""
    for c, name in (("a", "p"), ("b", "q")):
        pairs = pairs.drop(name).join(parts.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    return pairs.where("p <> q")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) with what the links (a, b) join: only the components they meet in are walked."""
    new = shared.written(across(links, parts).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "jaccard-joined")
    if new.isEmpty():
        return parts
    up = components(new).select(F.col("node").alias("component"), F.col("component").alias("least"))
    ends = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct().join(parts, "node", "left_anti")
    nodes = parts.unionByName(ends.select("node", F.col("node").alias("component")))
    return shared.written(nodes.join(up, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "jaccard-known")


def settle(docs: DataFrame, pairs: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components with the pairs' links, comparisons of the pairs): first one pair of any two components, then those still apart.

    pairs: a written table of a, b, p, q, met.
    """
    best = F.max_by(F.struct("a", "b"), F.struct("met", -F.col("a"), -F.col("b"))).alias("x")
    lead = pairs.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(best).select("x.a", "x.b")
    lead = shared.written(lead, "jaccard-lead")
    first = shared.written(verify(docs, lead), "jaccard-compared")
    parts = merged(parts, first.where(_LINKED).select("a", "b"))
    more = shared.written(across(pairs.join(lead, ["a", "b"], "left_anti"), parts).select("a", "b"), "jaccard-apart")
    if more.isEmpty():
        return parts, first
    second = shared.written(verify(docs, more), "jaccard-compared")
    return merged(parts, second.where(_LINKED).select("a", "b")), first.unionByName(second)


def by_members(docs: DataFrame, members: DataFrame, compared: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with the links of stars' members; compared: pairs of centres (a, b, inter, total) that don't link.

    members: doc_id, star, away (its distance to the centre). Documents x of the
    lesser star are compared with the centre of the other, and its members are
    met by the shingles that they and x have beyond that centre.
    """
    limit = 1 - PERCENT / 100 + 1e-9
    far = (1 - F.col("inter") / F.col("total")).alias("distance")
    reach = members.groupBy("star").agg(F.max("away").alias("radius"), F.count("*").alias("k"))
    still = compared.select("a", "b", far)
    for c in ("a", "b"):
        still = still.join(reach.select(F.col("star").alias(c), F.col("radius").alias(f"r_{c}"), F.col("k").alias(f"k_{c}")), c, "left")
    radius = lambda c: F.coalesce(f"r_{c}", F.lit(0.0))
    still = still.where((F.col("r_a").isNotNull() | F.col("r_b").isNotNull()) & (F.col("distance") <= limit + radius("a") + radius("b")))
    turn = F.coalesce("k_b", F.lit(0)) > F.coalesce("k_a", F.lit(0))
    pick = lambda x, y, name: F.when(turn, F.col(x)).otherwise(F.col(y)).alias(name)
    still = across(still, parts).select(pick("b", "a", "star"), pick("a", "b", "other"), pick("r_b", "r_a", "radius"), "distance")
    still = shared.written(still, "jaccard-still")
    if still.isEmpty():
        return parts

    own = members.select(F.col("star").alias("other"), "doc_id", "away")
    probes = still.join(own, "other").where(F.col("distance") <= limit + F.col("radius") + F.col("away")).select("star", "doc_id")
    probes = still.select("star", F.col("other").alias("doc_id")).unionByName(probes).distinct()
    probes = shared.written(probes.select(F.col("star").alias("a"), F.col("doc_id").alias("b")), "jaccard-probes")
    seen = shared.written(verify(docs, probes, beyond=True), "jaccard-probed")
    parts = merged(parts, seen.where(_LINKED).select("a", "b"))
    radii = reach.select(F.col("star").alias("a"), "radius")
    left = across(seen.where(f"not ({_LINKED})"), parts).join(radii, "a").where(1 - F.col("inter") / F.col("total") <= limit + F.col("radius"))
    left = shared.written(left.select("a", F.col("b").alias("x"), "inter", F.col("n").alias("n_x"), "rest"), "jaccard-left")

    stars = left.select(F.col("a").alias("star")).distinct()
    mine = shared.written(members.join(stars, "star", "left_semi").select(F.col("star").alias("a"), F.col("doc_id").alias("b")), "jaccard-mine")
    mine = shared.written(verify(docs, mine, beyond=True).select("a", F.col("b").alias("m"), F.col("n").alias("n_m"), "rest"), "jaccard-members-beyond")
    of_x, of_m = (t.select("a", c, F.explode("rest").alias("shingle")) for t, c in ((left, "x"), (mine, "m")))
    met = of_x.join(of_m, ["a", "shingle"]).groupBy("a", "x", "m").agg(F.count("*").alias("met"))
    least = F.ceil((F.col("n_x") + F.col("n_m")) * PERCENT / (100 + PERCENT) - 1e-6)
    met = met.join(left.drop("rest"), ["a", "x"]).join(mine.drop("rest"), ["a", "m"]).where(F.col("met") >= least - F.col("inter")).select("x", "m", "met")
    # a smaller member may need no more than what its centre shares with x
    most = F.floor(F.col("inter") * (100 + PERCENT) / PERCENT + 1e-6) - F.col("n_x")
    low = F.ceil(F.col("n_x") * PERCENT / 100 - 1e-6)
    small = left.where(most >= low).withColumn("n_m", F.explode(F.sequence(low, most))).select("a", "x", "n_m").join(mine.drop("rest"), ["a", "n_m"]).select("x", "m", F.lit(0).cast("long").alias("met"))
    found = met.unionByName(small).where("x <> m").groupBy(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).agg(F.max("met").alias("met"))
    found = shared.written(across(found, parts).select("a", "b", "p", "q", "met"), "jaccard-open")
    return settle(docs, found, parts)[0]


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    shared.small_batches(spark, rows=1000, size=8 << 20)
    base = docs.select("doc_id", "text")
    found = shared.written(facts(base), "jaccard-facts")
    sizes = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "c", "d")
    often = found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT).toArrow()
    order = spark.sparkContext.broadcast(Order(often["a"].to_numpy().view(np.uint64), often["n"].to_numpy()))

    # classes of equal sets
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("n", "c", "d").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = shared.written(classes, "jaccard-classes")
    doubles = sizes.join(classes.where("rows > 1"), ["n", "c", "d"]).where("doc_id > rep").select("doc_id").distinct()
    doubles = shared.written(doubles, "jaccard-doubles")
    near = F.broadcast(doubles) if doubles.count() * 16 <= shared.BROADCAST_BYTES else doubles
    rest = base.where("doc_id is not null").join(near, "doc_id", "left_anti")
    if not sizes.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        rest = rest.dropDuplicates(["doc_id"])

    # stars
    bands = shared.written(band_rows(rest, order), "jaccard-bands")
    best = bands.groupBy("band").agg(F.min(F.struct("rare", "doc_id")).alias("top"), F.count("*").alias("k")).where("k > 1")
    drawn = bands.join(best, "band").where("doc_id <> top.doc_id").groupBy("doc_id", F.col("top.doc_id").alias("hub")).agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), "hub")) == 1
    drawn = shared.written(drawn.select("doc_id", "hub", first.alias("first")), "jaccard-drawn")
    shared.discard(bands)
    ends = (F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
    ways = []
    for turn in (True, False):
        todo = drawn.where(F.col("first") == turn)
        if ways:
            todo = todo.join(ways[0].select("doc_id"), "doc_id", "left_anti")
        todo = shared.written(todo.select("doc_id", "hub"), "jaccard-todo")
        compared = verify(rest, shared.written(todo.select(*ends).distinct(), "jaccard-star-pairs")).where(_LINKED)
        ways.append(shared.written(todo.select("doc_id", "hub", *ends).join(compared, ["a", "b"]), "jaccard-ways"))
    ways = ways[0].unionByName(ways[1])
    links = ways.select("a", "b").distinct()
    known = shared.written(components(links), "jaccard-known")
    shared.release(spark)
    centred = ways.join(ways.select(F.col("doc_id").alias("hub")).distinct(), "hub", "left_anti")  # the hub is itself no member
    pick = F.max_by(F.struct("hub", "inter", "total"), F.struct(F.col("inter") / F.col("total"), -F.col("hub")))
    members = shared.written(centred.groupBy("doc_id").agg(pick.alias("x")).select("doc_id", F.col("x.hub").alias("star"), (1 - F.col("x.inter") / F.col("x.total")).alias("away")), "jaccard-members")
    hubs = members.select(F.col("star").alias("doc_id"), F.lit(True).alias("hub")).distinct()
    marks = known.select(F.col("node").alias("doc_id"), F.col("component").alias("part")).join(members.select("doc_id", "star"), "doc_id", "left").join(hubs, "doc_id", "left")
    marks = shared.written(marks, "jaccard-marks")
    starred = rest.join(F.broadcast(marks) if marks.count() * 40 <= shared.BROADCAST_BYTES else marks, "doc_id", "left")
    starred = starred.select("text", F.coalesce("star", "doc_id").alias("star"), F.coalesce("part", "doc_id").alias("part"), (F.col("star").isNull() & F.col("hub").isNull()).alias("solo"))

    # candidate pairs of stars, by their centres
    met = shared.written(candidates(posting_rows(starred, order)), "jaccard-candidates")
    shared.release(spark)
    known, compared = settle(rest, met, known)
    shared.release(spark)

    parts = by_members(rest, members, compared.where(f"not ({_LINKED})"), known)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("n", "c", "d", F.coalesce("component", "rep").alias("component"))
    out = sizes.join(of_class, ["n", "c", "d"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, of one row of each component: one with its smallest doc_id.

    A row without an id or without words links with nothing and stays, but of
    rows repeated with one id and no words one. Where no doc_id repeats, no
    text is written: the rows that go are named by their ids. Otherwise rows
    are joined by a key of their own, so that different texts under one doc_id
    are told apart, and are written with it.
    """
    with_id = docs.where("doc_id is not null")
    if with_id.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        gone = join(with_id).where("n_shingles > 0 and doc_id <> component_id").select("doc_id")  # the least doc_id names its component
        gone = shared.written(gone, "jaccard-gone")
        return docs.join(F.broadcast(gone) if gone.count() * 16 <= shared.BROADCAST_BYTES else gone, "doc_id", "left_anti").select(*docs.columns)
    docs = shared.with_row_key(docs)
    with_id = docs.where("doc_id is not null")
    rows = with_id.select(F.col(shared.ROW_KEY).alias("doc_id"), "text")
    parts = join(rows).withColumnsRenamed({"doc_id": shared.ROW_KEY, "component_id": "part"})
    ids = with_id.select(shared.ROW_KEY, "doc_id")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))  # such rows are no component: they are told apart by id
    least = F.min(F.struct("doc_id", shared.ROW_KEY)).alias("least")
    of = parts.join(ids, shared.ROW_KEY).groupBy(own.alias("own"), F.when(own.isNull(), F.col("part")).alias("part")).agg(least)
    stay = of.select(F.col(f"least.{shared.ROW_KEY}").alias(shared.ROW_KEY)).unionByName(docs.where("doc_id is null").select(shared.ROW_KEY))
    return docs.join(stay, shared.ROW_KEY, "left_semi").drop(shared.ROW_KEY)
