"""Benchmark decontamination: item-sized windows, SimHash, a multi-index, weighted shingles.

A window of as many words as an item gets a 64-bit SimHash of its shingles. Fingerprints are
cut into 8 blocks of 8 bits: two that differ in 23 bits or fewer differ in 2 or fewer in some
block, so looking each block up with up to 2 errors finds every item within that radius.
Candidates are confirmed by the exact similarity of the weighted shingle sets. A shingle that
comes again has as many votes, so the radius says little where an item or a window repeats
shingles: such pairs are compared by their shingles alone, whatever their fingerprints.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.llm.common import Grams, gram_hashes, slices, type_of, word_hashes
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import fits_broadcast

_SIGNS = re.compile(r"\W+")
BLOCKS, BLOCK_ERRORS = 8, 2
_BITS = np.arange(64, dtype=np.uint64)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    """At a similarity of 0.75 two windows of equal size share 6/7 of their shingles; their
    fingerprints differ in 11 bits on average, with a deviation of 3, so the radius is 4 above."""

    shingle: int = 5
    percent: int = 75
    radius: int = 23
    item_bytes: int = 16 << 20  # items that one pass over the documents looks for


def normal(word: str) -> str:
    """The letters and digits of a word in lower case."""
    return word.lower() if word.isalnum() else _SIGNS.sub("", word.lower())


def normal_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, normal=normal)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of `n` shingles from each start: a bit is set where most shingles have it."""
    bits = ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    set_ = (sums[starts + n] - sums[starts]) > 0
    return (set_.astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def repeats(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Whether any of the `n` shingles from each start comes twice among them."""
    order = np.argsort(shingles, kind="stable")
    same = shingles[order][1:] == shingles[order][:-1]
    before = np.full(len(shingles), -1)
    before[order[1:][same]] = order[:-1][same]
    return np.maximum.accumulate(before)[starts + n - 1] >= starts


def _bytes(prints: np.ndarray) -> np.ndarray:
    return prints.astype("<u8").view(np.uint8).reshape(-1, 8)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each of a differs from each of b."""
    return _ONES[_bytes(a)[:, None, :] ^ _bytes(b)[None, :, :]].sum(axis=2, dtype=np.int32)


class Items:
    """Items of one length in words, indexed by the blocks of their fingerprints."""

    def __init__(self, length: int, shingle: int, numbers: list[int], sets: list[np.ndarray]):
        self.length, self.k, self.numbers = length, min(shingle, length), numbers
        self.n = length - self.k + 1
        self.counts = [Counter(s.tolist()) for s in sets]
        self.vocabulary = np.unique(np.concatenate(sets))
        self.prints = np.concatenate([fingerprints(s, np.zeros(1, np.int64), len(s)) for s in sets])
        self.repeating = np.array([len(c) < self.n for c in self.counts])
        # the items by shingle, and those alone that repeat any
        self.held = self._by_shingle(sets, np.ones(len(sets), bool))
        self.held_again = self._by_shingle(sets, self.repeating)
        values = np.arange(256, dtype=np.uint8)
        # near[b, v]: the items whose block b differs from v in few bits
        self.near = np.stack([_ONES[values[:, None] ^ _bytes(self.prints)[None, :, b]] <= BLOCK_ERRORS for b in range(BLOCKS)])

    @staticmethod
    def _by_shingle(sets: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, item, times) of some items, by shingle."""
        found = [(*np.unique(s, return_counts=True), i) for i, s in enumerate(sets) if wanted[i]]
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        shingle, times = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        item = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
        order = np.argsort(shingle, kind="stable")
        return shingle[order], item[order], times[order]

    def common(self, window: np.ndarray, again: bool) -> tuple[np.ndarray, np.ndarray]:
        """The items that share shingles with a window, with how many; `again`: only items that
        repeat shingles."""
        shingle, item, times = self.held_again if again else self.held
        own, n = np.unique(window, return_counts=True)
        low = np.searchsorted(shingle, own)
        sizes = np.searchsorted(shingle, own, side="right") - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = np.bincount(item[at], np.minimum(np.repeat(n, sizes), times[at]), minlength=len(self.counts))
        found = np.flatnonzero(total)
        return found, total[found].astype(np.int64)

    def within(self, prints: np.ndarray, radius: int) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of every pair within the radius."""
        if radius >= BLOCKS * (BLOCK_ERRORS + 1):
            raise ValueError("the index does not reach so far")
        step = max(1, (4 << 20) // (8 * len(self.prints)))
        for start in range(0, len(prints), step):
            some = prints[start : start + step]
            blocks = _bytes(some)
            found = self.near[0][blocks[:, 0]]
            for b in range(1, BLOCKS):
                found = found | self.near[b][blocks[:, b]]
            window, item = np.nonzero(found)
            apart = _ONES[blocks[window] ^ _bytes(self.prints)[item]].sum(axis=1, dtype=np.int32)
            near = apart <= radius
            yield from zip((window[near] + start).tolist(), item[near].tolist(), apart[near].tolist(), strict=True)


class Vocabulary:
    """A set of hashes, asked for many at a time; a bitmap answers for most of those not in it."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self._slot(self.sorted)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes are in the set."""
        some = np.flatnonzero(self.bitmap[self._slot(hashes)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
        return some[self.sorted[at] == hashes[some]]


class Finder:
    """Finds a set of items in texts."""

    def __init__(self, texts: list[str | None], s: Settings):
        self.s = s
        hashes, begins = normal_hashes(pa.array(texts, pa.string()))
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
            if a < b:
                by_length.setdefault(b - a, []).append((number, gram_hashes(hashes[a:b], min(s.shingle, b - a))))
        self.groups = [Items(n, s.shingle, *map(list, zip(*x, strict=True))) for n, x in sorted(by_length.items())]
        self.vocabulary = {
            k: Vocabulary(np.concatenate([g.vocabulary for g in self.groups if g.k == k])) for k in {g.k for g in self.groups}
        }

    def find_all(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
        """(row, items found) of the texts that share a shingle with any item."""
        hashes, begins = normal_hashes(texts)
        if not len(hashes):
            return
        grams = Grams(hashes)
        # shingles that reach into the next text are asked for too, and do no harm
        near = [np.searchsorted(begins, v.places(grams.of(k)), side="right") - 1 for k, v in self.vocabulary.items()]
        for row in np.unique(np.concatenate([*near, np.empty(0, np.int64)])).astype(int).tolist():
            found = self.find(hashes[begins[row] : begins[row + 1]])
            if found:
                yield row, found

    def candidates(self, group: Items, hits: np.ndarray) -> tuple[np.ndarray, int]:
        """Starts of the windows that have enough shingles of any item, and their shingle count.

        With similarity p a window shares 2p / (1 + p) of an item's shingles or more. A text
        shorter than the item is one window.
        """
        p = self.s.percent / 100
        if len(hits) < group.n:
            enough = len(hits) and len(hits) >= p * group.n and np.count_nonzero(hits) >= p * group.n
            return (np.zeros(1, np.int64) if enough else np.empty(0, np.int64)), len(hits)
        total = np.concatenate([[0], np.cumsum(hits)])
        shared = total[group.n :] - total[: -group.n]
        return np.flatnonzero(shared >= 2 * p / (1 + p) * group.n - 1e-9), group.n

    def find(self, hashes: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, distance) of the best window of each item found
        in a text, given the hashes of its words."""
        grams = {k: gram_hashes(hashes, k) for k in self.vocabulary}
        hits = {}
        for k, v in self.vocabulary.items():
            hits[k] = np.zeros(len(grams[k]), bool)
            hits[k][v.places(grams[k])] = True
        best: dict[int, tuple] = {}
        for group in self.groups:
            if not hits[group.k].any():
                continue
            starts, n = self.candidates(group, hits[group.k])
            if not len(starts):
                continue
            # only the stretch that holds candidates is summed up
            low = int(starts[0])
            stretch = grams[group.k][low : int(starts[-1]) + n]
            prints = fingerprints(stretch, starts - low, n)
            again = repeats(stretch, starts - low, n)

            def keep(window: int, item: int, common: int, apart: int, group=group, starts=starts, n=n) -> None:
                union = n + group.n - common
                if 100 * common >= self.s.percent * union:
                    number = group.numbers[item]
                    found = (-common / union, int(starts[window]), n + group.k - 1, apart)
                    best[number] = min(best.get(number, found), found)

            for window, item, apart in group.within(prints, self.s.radius):
                if not again[window] and not group.repeating[item]:
                    start = int(starts[window])
                    own, its = Counter(grams[group.k][start : start + n].tolist()), group.counts[item]
                    keep(window, item, sum(min(c, its[x]) for x, c in own.items() if x in its), apart)
            for window in (range(len(starts)) if group.repeating.any() else np.flatnonzero(again).tolist()):
                start = int(starts[window])
                items, common = group.common(grams[group.k][start : start + n], not again[window])
                apart = distances(prints[window : window + 1], group.prints[items])[0]
                for x in zip(items.tolist(), common.tolist(), apart.tolist(), strict=True):
                    keep(window, *x)
        return [(number, -f[0], f[1], f[2], f[3]) for number, f in sorted(best.items())]


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings(),
) -> DataFrame:
    """(id, item, similarity, first_word, n_words, distance): every item found in every document,
    with its best window.

    Words are divided by ASCII white space; their letters and digits count, in lower case. Similarity is that of the weighted sets of
    five-word shingles, a shingle's weight being how often it comes; an item of fewer words is
    one shingle. Null and empty texts hold nothing. An item that comes twice is one, a document
    row that comes twice gives its rows twice.

    The items' size is measured; those that exceed `item_bytes` are looked for in further
    passes over the documents, a hash of the item choosing its pass. A pass is narrow: no shuffle.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    wanted = cut(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct())
    size = wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = max(1, -(-size // settings.item_bytes))
    schema = (
        f"`{id_col}` {type_of(docs, id_col)}, item_no int, similarity double, first_word long, n_words long, distance int"
    )
    found = []
    for part in range(passes):
        rows = sorted(wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == part).collect(), key=lambda r: (r["text"], str(r["item"])))
        texts = spark.sparkContext.broadcast([r["text"] for r in rows])

        def look(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in slices(batches, 1):
                finder = finder or Finder(texts.value, settings)
                at, out = [], []
                for i, got in finder.find_all(batch.column(1)):
                    at += [i] * len(got)
                    out += got
                if out:
                    item, similarity, first, n, apart = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at)), pa.array(item, pa.int32()), pa.array(similarity, pa.float64()),
                            pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(apart, pa.int32()),
                        ],
                        names=[id_col, "item_no", "similarity", "first_word", "n_words", "distance"],
                    )

        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item_no int, `{item_col}` {type_of(items, item_col)}")
        found.append(own.mapInArrow(look, schema).join(F.broadcast(names), "item_no").drop("item_no"))
    return reduce(DataFrame.unionByName, found).select(id_col, item_col, "similarity", "first_word", "n_words", "distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item. A row with a null id is kept."""
    found = cut(contaminated(docs, items, id_col, text_col).select(id_col).where(F.col(id_col).isNotNull()).distinct())
    return docs.join(F.broadcast(found) if fits_broadcast(found) else found, id_col, "left_anti")
