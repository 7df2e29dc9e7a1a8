"""Near-duplicate groups: MinHash bands find candidates, odd sketches sift them, sets confirm.

Documents with equal shingle sets form a class and go on as one. Links between classes are
found bucket by bucket: every member of a band's bucket is compared with the smallest member,
the groups found so far are joined, and only members of different groups stay open. When those
are not too many they are compared with each other, by sketch, and only those that may be alike are
listed; until then each round takes twice as many of the smallest. No bucket is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.llm.common import gram_hashes, mix64, slices, word_hashes
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import fits_broadcast


@dataclass(frozen=True)
class Settings:
    """Shingle length, similarity (in percent) and the shape of the signatures.

    At the least similarity a pair shares no band with probability (1 - 0.75^4)^32 = 5e-6, and is
    sifted out with about the same. Sets of several thousand shingles fill the sketch, and their
    pairs are sifted by size only.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bins: int = 1 << 15  # of the one-permutation samples that are folded into the sketch
    sketch_words: int = 16  # 64 bits each; more would exceed what the JVM compiles in one method
    deviations: float = 4.5  # of the sketches' distance, beyond which a pair is sifted out
    open_pairs: float = 256.0  # pairs per class that may be compared at once

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def largest_distance(self, na: Column, nb: Column) -> Column:
        """Bits in which the sketches of sets of na and nb shingles at the least similarity J
        differ, at most.

        The union then has u = (na + nb) / (1 + J) shingles in U of the k bins, and J U samples
        agree; the D others are folded into n bits, each odd with probability (1 - exp(-2D / n)) / 2.
        Samples vary by the shingles that meet in a bin, parities by the samples that meet in a bit.
        """
        k, n, j = float(self.bins), float(64 * self.sketch_words), self.percent / 100
        full = lambda x: k * (1 - F.exp(-x / k))
        u = (na + nb) / (1 + j)
        differ = F.greatest(full(na) + full(nb) - 2 * j * full(u), F.lit(0.0))
        odd = n * (1 - F.exp(-2 * differ / n)) / 2
        fade = F.exp(-4 * differ / n)
        drawn = 4 * F.least(u - full(u) + 0.25, j * (1 - j) * full(u)) * fade
        folded = F.greatest(n * (1 - fade) / 4 - differ * fade, F.lit(0.0)) + 0.25
        return odd + self.deviations * F.sqrt(drawn + folded)


def shingle_sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles, A-Z in lower case;
    of the whole sequence if it has fewer words; nothing without words."""
    hashes, begins = word_hashes(texts, lower=True)
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        n = end - start
        yield np.unique(gram_hashes(hashes[start:end], min(k, n))) if n else np.empty(0, np.uint64)


def _multipliers(n: int) -> np.ndarray:
    return (mix64(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One minimum per multiplier over the upper halves of the hashes, spread by the multiplier."""
    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(upper), 256):
        np.minimum(low, (upper[start : start + 256, None] * multipliers).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band and its samples."""
    rows = low.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i] + np.uint64(1))
    return key


def odd_sketch(shingles: np.ndarray, bins: int, n_words: int) -> np.ndarray:
    """Parity bitmap of one-permutation MinHash samples: the least of the sorted hashes in each
    bin flips one bit."""
    place = shingles >> np.uint64(64 - (bins - 1).bit_length())
    least = shingles[np.r_[True, place[1:] != place[:-1]]]
    bit = mix64(least) % np.uint64(64 * n_words)
    parity = np.bincount(bit.astype(np.int64), minlength=64 * n_words) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, n_shingles, set_hash, bands, sketch) of every row; set_hash is null for an empty set."""
    schema = "id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        multipliers = _multipliers(s.samples)
        for batch in slices(batches, 1):
            counts, hashes = [], []
            keys = np.zeros((batch.num_rows, s.bands), np.uint64)
            sketches = np.zeros((batch.num_rows, s.sketch_words), np.uint64)
            for i, shingles in enumerate(shingle_sets_of(batch.column(1), s.shingle)):
                counts.append(len(shingles))
                hashes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                if len(shingles):
                    low = minhashes(shingles, multipliers)
                    keys[i], sketches[i] = band_keys(low, s.bands), odd_sketch(shingles, s.bins, s.sketch_words)
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64))
                )
                for x in (keys, sketches)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), *lists],
                names=["id", "n_shingles", "set_hash", "bands", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(set_hash, shingles) of the documents in `wanted` (id), from their whole texts.

    The ids are broadcast where their counted size allows it; beyond that the texts are shuffled.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 1, 2 << 20):
            found = list(shingle_sets_of(batch.column(1), s.shingle))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["set_hash", "shingles"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    return texts.join(side, "id", "left_semi").mapInArrow(sets, "set_hash binary, shingles array<long>")


def _differing_bits(a: str, b: str, n_words: int) -> Column:
    total = F.lit(0)
    for i in range(n_words):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the edges (a, b), for ids with an edge.

    Large-star and small-star steps in turn: a step replaces edges, never lists pairs of a
    component, and ends in a number of rounds that grows with the logarithm of its size. The
    smallest neighbours are written down before they are joined with the edges of a node, so
    that adaptive execution can split a node with very many.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _are_stars(edges):
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = cut(
            around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        )
        # a node keeps only its smallest neighbour, and hands it to the others
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = cut(moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cut(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots))


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour, which has none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("centre"))
    )
    odd = ends.groupBy("id").agg(F.sum("child").alias("n"), F.max("centre").alias("centre")).where("n > 1 OR n = 1 AND centre = 1")
    return odd.isEmpty()


class NearDuplicates:
    """Classes of equal shingle sets, links between them, and the groups they form."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()):
        self.docs, self.id_col, self.text_col, self.s = docs, id_col, text_col, settings
        self.rows = cut(signatures(docs, id_col, text_col, settings))
        first = self.rows.where("set_hash IS NOT NULL AND id IS NOT NULL").groupBy("set_hash").agg(
            F.min(F.struct("id", "n_shingles", "bands", "sketch")).alias("m")
        )
        # one row per set, named by its smallest id; an id with several texts names several
        self.classes = cut(first.select(F.col("m.id").alias("node"), "set_hash", "m.n_shingles", "m.bands", "m.sketch"))
        self.links = self._links()

    def _members(self) -> DataFrame:
        """(key, node, low) for the buckets of two or more classes; low is the smallest of them."""
        spread = self.classes.select("node", F.explode("bands").alias("key"))
        several = cut(
            spread.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
        )
        return cut(spread.join(several, "key"))

    def _alike(self) -> Column:
        """Sizes (na, nb) and odd sketches (sa, sb) allow the similarity."""
        low, high = F.least("na", "nb"), F.greatest("na", "nb")
        return (100 * low >= self.s.percent * high) & (
            _differing_bits("sa", "sb", self.s.sketch_words) <= self.s.largest_distance(F.col("na"), F.col("nb"))
        )

    def _side(self, x: str) -> DataFrame:
        return self.classes.select(
            F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"),
            F.col("set_hash").alias(f"h{x}"),
        )

    def _sifted(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose odd sketches and sizes allow the similarity."""
        return pairs.join(self._side("a"), "a").join(self._side("b"), "b").where(self._alike()).drop("sa", "sb")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets have the similarity."""
        pairs = cut(self._sifted(pairs))
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        wanted = cut(ends.distinct())
        if wanted.isEmpty():
            return pairs.select("a", "b")
        sets = cut(shingle_sets(self.docs, wanted, self.id_col, self.text_col, self.s))
        side = lambda x: sets.select(F.col("set_hash").alias(f"h{x}"), F.col("shingles").alias(f"set{x}"))
        common = F.size(F.array_intersect("seta", "setb"))
        joined = pairs.join(side("a"), "ha").join(side("b"), "hb")
        # 100 * i >= p * (na + nb - i)
        return joined.where((100 + self.s.percent) * common >= self.s.percent * (F.col("na") + F.col("nb"))).select("a", "b")

    def _links(self) -> DataFrame:
        """Confirmed pairs (a, b) of classes, enough to connect every group."""
        members = self._members()
        most = self.s.open_pairs * max(1, self.classes.count())
        # at first all members of a bucket meet its smallest
        pairs = members.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
        checked = cut(pairs.distinct())
        links = cut(self._confirmed(checked))
        component, rest, pivots = connected(links), members.where("node > low").select("key", "node"), 2
        while True:
            labelled = cut(
                rest.join(component.withColumnRenamed("id", "node"), "node", "left")
                .select("key", "node", F.coalesce("component", "node").alias("component"))
            )
            n = F.col("n").cast("double")
            buckets = cut(
                labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
                .groupBy("key").agg(
                    ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("open"), F.max_by("component", "n").alias("main"),
                    F.count("*").alias("groups"),
                ).where("groups > 1")
            )
            open_pairs = buckets.agg(F.sum("open")).first()[0] or 0
            if not open_pairs:
                return links
            labelled = cut(labelled.join(buckets.select("key", "main"), "key"))
            if open_pairs <= most:
                fresh = cut(self._open(labelled).distinct().join(checked, ["a", "b"], "left_anti"))
                return links.unionByName(self._confirmed(fresh))
            place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            chosen = cut(labelled.withColumn("_place", place).where(F.col("_place") <= pivots))
            pivot = chosen.select("key", F.col("node").alias("pivot"), F.col("component").alias("own"))
            met = labelled.join(pivot, "key").where("node > pivot AND component <> own")
            pairs = met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
            fresh = cut(pairs.join(checked, ["a", "b"], "left_anti"))
            confirmed = cut(self._confirmed(fresh))
            checked = checked.unionByName(fresh)
            if not confirmed.isEmpty():
                links = links.unionByName(confirmed)
                component = connected(links)
            done = cut(chosen.groupBy("key").agg(F.max("node").alias("pivot")))
            rest = labelled.join(done, "key").where("node > pivot").select("key", "node")
            pivots *= 2

    def _open(self, labelled: DataFrame) -> DataFrame:
        """Pairs of members of different groups that sketches and sizes allow: those outside a
        bucket's largest group with all members of other groups. A pair that shares several
        buckets comes from the first one."""
        rows = cut(labelled.join(self.classes.select("node", "sketch", "n_shingles", "bands"), "node"))
        side = lambda x, d: d.select(
            "key", F.col("main").alias(f"m{x}"), F.col("node").alias(x), F.col("component").alias(f"c{x}"),
            F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("bands").alias(f"b{x}"),
        )
        x, y = side("a", rows.where("component <> main")), side("b", rows)
        once = (F.col("cb") == F.col("mb")) | (F.col("a") < F.col("b"))
        here = F.array_intersect("ba", "bb")[0] == x["key"]
        met = x.join(y, (x["key"] == y["key"]) & (F.col("ca") != F.col("cb")) & once & self._alike() & here)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def components(self) -> DataFrame:
        """(id, n_shingles, component) of every row.

        The component is the smallest id that can be reached. An empty set is linked with
        nothing, rows with equal ids count as one document, a row with a null id has the
        component of its set, null if it has none.
        """
        # rows of one id with different sets link their classes
        stands = self.classes.select("set_hash", F.col("node").alias("first"))
        held = self.rows.select("id", "n_shingles", "set_hash").join(stands, "set_hash", "left")
        held = cut(held.withColumn("first", F.coalesce("first", "id")))
        own = held.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
        several = held.groupBy("id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low <> high")
        own = own.join(several.select(F.col("id").alias("a")), "a", "left_semi")
        component = connected(self.links.unionByName(own))
        return held.join(component.withColumnRenamed("id", "first"), "first", "left").select(
            "id", "n_shingles", F.coalesce("component", "first").alias("component")
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id, kept): kept is true for the smallest id of each group."""
    found = NearDuplicates(docs, id_col, text_col, settings).components()
    return found.select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, of which each group has only the smallest id left.

    Of rows with equal ids one stays, that with the smallest text. Rows with a null id stay.
    """
    found = cut(near_duplicates(docs, id_col, text_col, settings).where(F.col(id_col).isNotNull()).select(id_col, "kept"))
    gone = cut(found.where("NOT kept").select(id_col).distinct())
    left = docs.join(F.broadcast(gone) if fits_broadcast(gone) else gone, id_col, "left_anti").select(docs.columns)
    again = cut(found.where("kept").groupBy(id_col).count().where("count > 1").select(id_col))
    if again.isEmpty():
        return left
    several = left.join(again, id_col, "left_semi").select(docs.columns)
    others = [F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce(F.col(text_col), F.lit(""))).alias("_row")]
    one = several.groupBy(id_col).agg(*others).select([F.col("_row")[c].alias(c) for c in docs.columns])
    return left.join(again, id_col, "left_anti").select(docs.columns).unionByName(one)
