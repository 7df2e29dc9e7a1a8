"""Documents whose sets of word n-grams are alike, found by a partition of the universe.

For every band of set sizes the universe of shingles is hashed into so many segments that two
sets of the band within the similarity have to agree on one of them: they differ in fewer shingles
than there are segments. Each set indexes its first segments whole. Segments that would match too
many sets, first of all empty ones, are left out, and the loss is made up by one-deletion
neighbourhoods of the first segments, as many as the loss asks for. Whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadshelf.llm.common import arrow_schema, mix64, slices
from threadshelf.llm.neardup import connected, shingle_sets, shingle_sets_of
from threadshelf.llm.neardup import Settings as Shingling
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import fits_broadcast

KEY_BITS = 40  # of a key within its bucket; longer keys would only save a few candidates
PARITY_WORDS = 8
U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Shingle length, similarity in percent, and the costs that steer the allocation.

    A bucket is hot if more than `open_pairs` pairs a member are left to compare in it. At most
    `hot_keys` keys, those with the most open pairs, are skipped and made up for, so that a task
    can hold them; what is beyond is compared as it stands.
    """

    shingle: int = 5
    percent: int = 80
    open_pairs: float = 8.0
    hot_keys: int = 2_000_000
    bucket_keys: int = 4_000_000  # index entries one task holds at a time

    def differing(self, total):
        """Bound on the shingles two sets with `total` shingles together may differ in."""
        return (100 - self.percent) * total // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def smallest_partner(self, size: int) -> int:
        return -(-self.percent * size // 100)


class Bands:
    """Bands of sizes; partners of a size lie in its own band or the one beside it."""

    def __init__(self, s: Settings):
        self.s, self.tops = s, [0]
        self.known: dict[int, list[tuple[int, int, int, int]]] = {}

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.s.largest_partner(self.tops[-1] + 1)))
        return int(np.searchsorted(self.tops, size))

    def segments(self, band: int) -> int:
        """Segments of a band: one more than a set of it and a larger partner may differ in."""
        top = self.tops[band]
        return self.s.differing(top + self.s.largest_partner(top)) + 1

    def indexed(self, size: int) -> int:
        """Segments a set indexes in its own band."""
        return self.s.differing(size + self.s.largest_partner(size)) + 1

    def schemes(self, size: int) -> list[tuple[int, int, int, int]]:
        """(band, segments, how many of them to index, how many every partner indexes at least):
        in the own band, and as larger partner in the one below."""
        if size not in self.known:
            self.known[size] = self._schemes(size)
        return self.known[size]

    def _schemes(self, size: int) -> list[tuple[int, int, int, int]]:
        band = self.of(size)
        top, below = self.tops[band], self.tops[band - 1]
        least = self.s.smallest_partner(size)
        all_index = self.indexed(max(below + 1, least))
        if self.s.largest_partner(size) > top:
            all_index = min(all_index, self.s.differing(2 * top + 1) + 1)
        found = [(band, self.segments(band), self.indexed(size), all_index)]
        if below and least <= below:
            all_index = self.indexed(max(self.tops[band - 2] + 1, least))
            found.append((band - 1, self.segments(band - 1), self.s.differing(size + below) + 1, all_index))
        return found


def _hot(keys: np.ndarray, hot: np.ndarray, shift: int) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(keys), bool)
    short = keys >> U(shift)
    place = np.minimum(np.searchsorted(hot, short), len(hot) - 1)
    return hot[place] == short


def keys_of_sets(
    sets: list[np.ndarray], bands: Bands, hot: np.ndarray | None = None, shift: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the set) of the index entries of some sets. With `hot` (sorted keys without
    their last `shift` bits) the entries that make up for hot ones, of the sets that have any.

    Let a pair differ in at most n - 1 shingles and both index n segments. If the z >= 1 segments
    it agrees on are all skipped, at most z - 1 of the others differ in more than one shingle. So
    among the first w >= 2z + x segments one differs in a single shingle, x being those whose
    common part is skipped; its larger half without that shingle is the smaller half. A set knows
    bounds of z and x by itself: its own skipped segments, and its segments with a skipped
    neighbour. Where this takes more segments than every partner has, the set indexes the shingles
    of its prefix as well; the other of a pair that is lost then does too.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    schemes = [bands.schemes(len(x)) if len(x) else [] for x in sets]
    for which in range(2):
        some = [i for i, x in enumerate(schemes) if len(x) > which]
        if some:
            shape = np.array([schemes[i][which] for i in some], np.int64)
            found += _keys(some, [sets[i] for i in some], shape, bands.s, hot, shift)
    if not found:
        return np.empty(0, U), np.empty(0, np.int64)
    keys, places = (np.concatenate(x) for x in zip(*found, strict=True))
    return keys, places


def set_keys(shingles: np.ndarray, bands: Bands, hot: np.ndarray | None = None, shift: int = 0) -> np.ndarray:
    return keys_of_sets([shingles], bands, hot, shift)[0]


def _keys(
    places: list[int], sets: list[np.ndarray], shape: np.ndarray, s: Settings, hot: np.ndarray | None, shift: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """The entries of sets in one scheme each, as lists of (keys, places); `shape` has the scheme's
    band, its segments, how many of them are indexed, and how many every partner indexes."""
    place = np.array(places, np.int64)
    band, m, n, common = shape.T
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shingle = np.concatenate(sets)
    segment = (mix64(shingle + U(0xE7037ED1A0B428DB)) % m.astype(U)[owner]).astype(np.int64)
    inside = segment < n[owner]
    owner, segment = owner[inside], segment[inside]
    value = mix64(shingle[inside] ^ U(0xA0761D6478BD642F))
    base = np.concatenate([[0], np.cumsum(n)])
    slot, slots = base[owner] + segment, int(base[-1])
    size = np.bincount(slot, minlength=slots)
    # sums modulo 2^64 by halves, which doubles hold exactly
    low = np.bincount(slot, (value & U(0xFFFFFFFF)).astype(np.float64), slots).astype(U)
    total = (np.bincount(slot, (value >> U(32)).astype(np.float64), slots).astype(U) << U(32)) + low
    of = np.repeat(np.arange(len(sets)), n)
    number = np.arange(slots) - base[of]
    name = mix64(number.astype(U) + ((band[of] + 1).astype(U) << U(32)))
    whole = mix64(total + mix64(name + size.astype(U)))
    skipped, poor = size == 0, size <= 1
    first, prefix = _allocation(skipped, poor, base, common)

    def without(some: np.ndarray) -> np.ndarray:
        """Keys of segments without one of their shingles."""
        at = slot[some]
        return mix64(total[at] - value[some] + mix64(name[at] + size[at].astype(U) - U(1)))

    tokens = lambda i: mix64(
        sets[i][: len(sets[i]) - s.smallest_partner(len(sets[i])) + 1] + U((int(band[i]) + 1) << 32 | 1)
    )
    near = np.flatnonzero((segment < first[owner]) & (size[slot] > 1))
    if hot is None:
        found = [(whole[~skipped], place[of[~skipped]]), (without(near), place[owner[near]])]
    else:
        less = without(np.arange(len(slot)))
        hot_whole, hot_less = _hot(whole, hot, shift) & ~skipped, _hot(less, hot, shift) & (size[slot] > 1)
        touched = np.bincount(of[hot_whole], minlength=len(sets)) + np.bincount(owner[near][hot_less[near]], minlength=len(sets)) > 0
        touched[[i for i in np.flatnonzero(prefix & ~touched) if _hot(tokens(i), hot, shift).any()]] = True
        gone, bad = skipped | hot_whole, poor | hot_whole
        bad[slot[hot_less]] = True
        first, prefix = _allocation(gone, bad, base, common)
        prefix &= touched
        kept = ~gone & (number < first[of]) & touched[of]
        near = np.flatnonzero((segment < first[owner]) & (size[slot] > 1) & ~hot_less & touched[owner])
        found = [(whole[kept], place[of[kept]]), (less[near], place[owner[near]])]
    for i in np.flatnonzero(prefix):
        found.append((own := tokens(i), np.full(len(own), place[i])))
    return found


def _allocation(skipped: np.ndarray, poor: np.ndarray, base: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set (the first segments to index with their neighbourhoods, whether the set or some
    partner has too few)."""
    start, n = base[:-1], np.diff(base)
    lost = np.concatenate([[0], np.cumsum(skipped)])
    gained = np.concatenate([[0], np.cumsum(~poor)])
    wanted = gained[start] + 2 * (lost[base[1:]] - lost[start])
    enough = np.maximum(np.searchsorted(gained, wanted) - start, 0)
    return np.minimum(enough, n), enough > np.minimum(common, n)


def parity(shingles: np.ndarray, n_words: int = PARITY_WORDS) -> np.ndarray:
    """Parity bitmap of a set; those of two sets never differ in more bits than the sets do."""
    bit = (mix64(shingles ^ U(0x8EBC6AF09C88C6E3)) % U(64 * n_words)).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * n_words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def fine_parity(shingles: np.ndarray) -> np.ndarray | None:
    """The parity bitmap of a set that fills the usual one up: with a bit a shingle at least, by
    doubling, so that folding it gives the shorter ones; None for the others."""
    n_words = PARITY_WORDS
    while 64 * n_words < len(shingles):
        n_words *= 2
    return parity(shingles, n_words) if n_words > PARITY_WORDS else None


def _folded(bitmap: Column, n_words: Column) -> Column:
    """A parity bitmap of a multiple of `n_words` words as the one of `n_words` words."""
    parts = F.sequence(F.lit(1), F.size(bitmap), n_words)
    none = F.array_repeat(F.lit(0).cast("long"), n_words)
    return F.aggregate(parts, none, lambda sum_, at: F.zip_with(sum_, F.slice(bitmap, at, n_words), lambda x, y: x.bitwiseXOR(y)))


def describe(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, n_shingles, set_hash, node, parity, fine) of every row; from set_hash on they are null for
    an empty set, and the fine parity for one that the other does for."""
    schema = "id long, n_shingles long, set_hash binary, node long, parity array<long>, fine array<long>"
    kind = arrow_schema(schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 1):
            counts, hashes, nodes, bits, finer = [], [], [], [], []
            for shingles in shingle_sets_of(batch.column(1), s.shingle):
                digest = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
                counts.append(len(shingles))
                hashes.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                fine = fine_parity(shingles)
                short = parity(shingles) if fine is None else np.bitwise_xor.reduce(fine.reshape(-1, PARITY_WORDS), axis=0)
                bits.append(short.view(np.int64) if digest else None)
                finer.append(None if fine is None else fine.view(np.int64))
            columns = [batch.column(0), *[pa.array(x, t) for x, t in zip((counts, hashes, nodes, bits, finer), kind.types[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(sign, schema)


BLOCK = "bucket long, keys binary, nodes binary, counts binary, marks binary, rest binary"


def _blocks(keys: np.ndarray, nodes: np.ndarray, doc: np.ndarray, bits: int, kind: pa.Schema) -> pa.RecordBatch | None:
    """Entries of some documents, packed by bucket.

    Of a key that several of them have only the smallest goes to the key's bucket, marked; the
    others, with that one, are spread. So a bucket gets a key once from every block at most.
    """
    keys = keys >> U(64 - KEY_BITS - bits)
    # documents with equal sets count once
    order = np.lexsort((nodes[doc], keys))
    keys, doc = keys[order], doc[order]
    own = nodes[doc]
    new = np.r_[True, keys[1:] != keys[:-1]]
    fresh = new | np.r_[True, own[1:] != own[:-1]]
    keys, doc, own, new = keys[fresh], doc[fresh], own[fresh], new[fresh]
    start = np.flatnonzero(new)
    several = np.diff(np.r_[start, len(keys)]) > 1
    low = own[np.repeat(start, np.diff(np.r_[start, len(keys)]))]
    rows = []
    bucket = (keys[start] >> U(KEY_BITS)).astype(np.int64)
    marked = np.zeros(len(keys), bool)
    marked[start] = several
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(start)], strict=True):
        # a node stands once before all of its keys, with their number in a byte where that is enough
        at = start[a:b][np.argsort(doc[start[a:b]], kind="stable")]
        held, counts = np.unique(doc[at], return_counts=True)
        short = keys[at] & U((1 << KEY_BITS) - 1)
        rows.append((
            int(bucket[a]), (short >> U(8)).astype(np.uint32).tobytes() + short.astype(np.uint8).tobytes(), nodes[held].tobytes(),
            counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes(), np.packbits(marked[at]).tobytes(), None,
        ))
    others = np.flatnonzero(~new)
    if len(others):
        rest = np.stack([keys[others], own[others], low[others]])
        rows.append((int(rest[0, 0] ^ rest[1, 0]) % (1 << bits) + (1 << bits), None, None, None, None, rest.tobytes()))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def index(docs: DataFrame, text_col: str, s: Settings, bits: int, hot: np.ndarray | None = None) -> DataFrame:
    """Index entries of all documents (BLOCK), in 2^bits buckets."""
    kind = arrow_schema(BLOCK)
    spark = docs.sparkSession
    sent = None if hot is None else spark.sparkContext.broadcast(hot)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bands = Bands(s)
        given = None if sent is None else sent.value
        for batch in slices(batches, 0):
            sets = list(shingle_sets_of(batch.column(0), s.shingle))
            keys, doc = keys_of_sets(sets, bands, given, 64 - KEY_BITS - bits)
            if len(keys):
                digest = lambda x: int.from_bytes(xxhash.xxh3_128_digest(x.tobytes())[:8], "little")
                block = _blocks(keys, np.array([digest(x) for x in sets], U), doc, bits, kind)
                if block is not None:
                    yield block

    return docs.select(F.col(text_col).cast("string")).mapInArrow(enter, BLOCK)


SMALL = 16  # members of a bucket that has at most 7.5 pairs a member


def members(blocks: DataFrame) -> DataFrame:
    """(key, node, low) of the keys with several nodes, low being the smallest in its part.

    Each bucket is unpacked by itself. Of small buckets with the same nodes one is kept, under a
    key that follows from its nodes.
    """
    schema = "key long, node long, low long"

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["rest"] is not None:
                    yield _longs(np.frombuffer(row["rest"], U).reshape(3, -1))
                    continue
                if row["bucket"] != bucket:
                    if held:
                        yield _longs(_grouped(bucket, held))
                    bucket, held = row["bucket"], []
                held.append(_unpacked(row))
        if held:
            yield _longs(_grouped(bucket, held))

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(group, schema)


def _longs(columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["key", "node", "low"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(row["keys"]) // 5
    upper = np.frombuffer(row["keys"], np.uint32, n).astype(U)
    lower = np.frombuffer(row["keys"], np.uint8, n, 4 * n).astype(U)
    nodes = np.frombuffer(row["nodes"], U)
    counts = np.frombuffer(row["counts"], np.uint8 if len(row["counts"]) == len(nodes) else np.uint32)
    marks = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=n).astype(bool)
    return upper << U(8) | lower, np.repeat(nodes, counts), marks


def _grouped(bucket: int, held: list) -> np.ndarray:
    keys, nodes, marks = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((nodes, keys))
    keys, nodes, marks = keys[order], nodes[order], marks[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    start = np.flatnonzero(new)
    marked = np.logical_or.reduceat(marks, start)
    fresh = new | np.r_[True, nodes[1:] != nodes[:-1]]
    group = np.cumsum(new) - 1
    keys, nodes, group = keys[fresh], nodes[fresh], group[fresh]
    sizes = np.bincount(group)
    # a marked key has more nodes elsewhere
    wanted = ((sizes > 1) | marked)[group]
    keys, nodes, group = keys[wanted], nodes[wanted], group[wanted]
    if not len(keys):
        return np.empty((3, 0), U)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[first, len(keys)])
    lows = np.repeat(nodes[first], n)
    full = U(bucket << KEY_BITS) | keys
    small = (n <= SMALL) & ~marked[group[first]]
    together = mix64(np.add.reduceat(mix64(nodes), first)) | U(1 << 63)
    kept = np.ones(len(first), bool)
    some = np.flatnonzero(small)
    kept[some] = False
    kept[some[np.unique(together[some], return_index=True)[1]]] = True
    full = np.where(np.repeat(small, n), np.repeat(together, n), full)
    rows = np.repeat(kept, n)
    return np.stack([full[rows], nodes[rows], lows[rows]])


def _semi(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, key, "left_semi")


class NGramJoin:
    """Links between documents with alike sets of n-grams, enough to connect every group."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()):
        self.docs, self.id_col, self.text_col, self.s = docs, id_col, text_col, settings
        self.spark: SparkSession = docs.sparkSession
        self.rows = cut(describe(docs, id_col, text_col, settings))
        known = self.rows.where("set_hash IS NOT NULL AND id IS NOT NULL")
        first = known.groupBy("set_hash").agg(F.min(F.struct("id", "n_shingles", "node", "parity")).alias("m"))
        self.classes = cut(first.select("m.id", "set_hash", "m.n_shingles", "m.node", "m.parity"))
        self.sets: list[DataFrame] = []  # of the documents compared so far
        self.links = self._links()

    def _bits(self) -> int:
        """So many buckets that each has about `bucket_keys` entries."""
        entries = (self.classes.agg(F.sum("n_shingles")).first()[0] or 0) * 0.6
        return int(max(1, entries / self.s.bucket_keys) - 1).bit_length()

    def _differing(self, a: str, b: str) -> Column:
        total = F.lit(0)
        for i in range(PARITY_WORDS):
            total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
        return total

    def _most(self) -> Column:
        """Bound on the shingles two sets of the similarity, of sizes (na, nb), may differ in."""
        p, total = self.s.percent, F.col("na") + F.col("nb")
        return total - 2 * F.ceil(p * total / (100 + p))

    def _alike(self) -> Column:
        """Sizes (na, nb) and parities (pa, pb) allow the similarity."""
        sizes = 100 * F.least("na", "nb") >= self.s.percent * F.greatest("na", "nb")
        return sizes & (self._differing("pa", "pb") <= self._most())

    def _finer(self, pairs: DataFrame) -> DataFrame:
        """Those of the sifted pairs that the fine parities allow as well.

        Sets with more shingles than their parity has bits pass by it whatever they hold.
        """
        large = F.greatest("na", "nb") > 64 * PARITY_WORDS
        some = pairs.where(large)
        needed = cut(some.select(F.col("ha").alias("set_hash")).unionByName(some.select(F.col("hb").alias("set_hash"))).distinct())
        if needed.isEmpty():
            return pairs
        known = self.rows.where("set_hash IS NOT NULL").select("set_hash", F.coalesce("fine", "parity").alias("fine"))
        fine = _semi(known, needed, "set_hash").dropDuplicates(["set_hash"])
        side = lambda x: fine.select(F.col("set_hash").alias(f"h{x}"), F.col("fine").alias(f"f{x}"))
        n_words = F.least(F.size("fa"), F.size("fb"))
        differing = F.zip_with(
            _folded(F.col("fa"), n_words), _folded(F.col("fb"), n_words), lambda x, y: F.bit_count(x.bitwiseXOR(y))
        )
        met = some.join(side("a"), "ha").join(side("b"), "hb")
        met = met.where(F.aggregate(differing, F.lit(0), lambda n, more: n + more) <= self._most())
        return cut(pairs.where(~large).unionByName(met.select(*pairs.columns)))

    def _side(self, x: str, by: str) -> DataFrame:
        return self.classes.select(
            F.col(by).alias(f"_{x}"), F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}"),
            F.col("set_hash").alias(f"h{x}"),
        )

    def _sifted(self, pairs: DataFrame) -> DataFrame:
        """Pairs (_a, _b) of nodes as (a, b, na, nb, ha, hb), a < b, where sizes and parities allow it."""
        joined = pairs.join(self._side("a", "node"), "_a").join(self._side("b", "node"), "_b")
        joined = joined.where(self._alike() & (F.col("a") != F.col("b")))
        turned = F.col("a") > F.col("b")
        swapped = [
            F.when(turned, F.col(n + other)).otherwise(F.col(n + own)).alias(n + own) for n in "nh" for own, other in ("ab", "ba")
        ]
        return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *swapped).distinct()

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the sifted pairs whose whole sets have the similarity."""
        pairs = self._finer(pairs)
        side = lambda x: pairs.select(F.col(x).alias("id"), F.col(f"h{x}").alias("set_hash"))
        needed = cut(side("a").unionByName(side("b")).distinct())
        wanted = needed
        for known in self.sets:
            wanted = wanted.join(known.select("set_hash"), "set_hash", "left_anti")
        wanted = cut(wanted) if self.sets else needed
        if not wanted.isEmpty():
            # the sets of a document that has several are all there; each set once
            shingling = Shingling(shingle=self.s.shingle)
            found = shingle_sets(self.docs, wanted.select("id").distinct(), self.id_col, self.text_col, shingling)
            self.sets.append(cut(self._once(_semi(found, wanted.select("set_hash").distinct(), "set_hash"))))
        if not self.sets:
            return pairs.select("a", "b")
        sets = _semi(reduce(DataFrame.unionByName, self.sets), needed.select("set_hash").distinct(), "set_hash")
        side = lambda x: sets.select(F.col("set_hash").alias(f"h{x}"), F.col("shingles").alias(f"set{x}"))
        joined = pairs.join(side("a"), "ha").join(side("b"), "hb")
        common = F.size(F.array_intersect("seta", "setb"))
        # 100 * i >= p * (na + nb - i)
        return joined.where((100 + self.s.percent) * common >= self.s.percent * (F.col("na") + F.col("nb"))).select("a", "b")

    def _once(self, found: DataFrame) -> DataFrame:
        """One row a set: only rows that repeat an id can give a set twice."""
        again = self.rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
        return found if again.isEmpty() else found.dropDuplicates(["set_hash"])

    @staticmethod
    def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) whose ends are not connected yet, with the components of the ends."""
        small = F.broadcast(component) if fits_broadcast(component) else component
        side = lambda x: small.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return joined.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")

    def _joined(self, component: DataFrame, links: DataFrame) -> DataFrame:
        """The components after further links: only what these connect is looked at."""
        apart = cut(self._apart(links, component))
        if apart.isEmpty():
            return component
        over = connected(apart.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        ends = apart.select(F.col("ca").alias("id")).unionByName(apart.select(F.col("cb").alias("id"))).distinct()
        single = ends.join(component, "id", "left_anti").select("id", F.col("id").alias("component"))
        merged = component.unionByName(single).join(over.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left")
        return cut(merged.select("id", F.coalesce("_to", "component").alias("component")))

    def _stars(self, found: DataFrame) -> DataFrame:
        """Every node with the smallest of its buckets, sifted."""
        return self._sifted(found.where("node <> low").select(F.col("low").alias("_a"), F.col("node").alias("_b")).distinct())

    def _open(self, found: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members of buckets that hold several components as (key, id, component), buckets)."""
        names = self.classes.select("node", "id").join(component, "id", "left")
        names = cut(names.select("node", "id", F.coalesce("component", "id").alias("component")))
        named = found.select("key", "node").join(F.broadcast(names) if fits_broadcast(names) else names, "node")
        open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        open_keys = cut(open_keys.select("key"))
        rows = cut(named.join(F.broadcast(open_keys) if fits_broadcast(open_keys) else open_keys, "key").select("key", "id", "component").distinct())
        n = F.col("n").cast("double")
        buckets = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
            ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("open"), F.sum("n").alias("members")
        )
        return rows, cut(buckets)

    def _met(self, rows: DataFrame) -> DataFrame:
        """Sifted pairs of members (key, id, component) of different components of a bucket."""
        sized = cut(rows.join(self.classes.select("id", "n_shingles", "parity", "set_hash"), "id"))
        side = lambda x: sized.select(
            "key", F.col("id").alias(x), F.col("component").alias(f"c{x}"), F.col("n_shingles").alias(f"n{x}"),
            F.col("parity").alias(f"p{x}"), F.col("set_hash").alias(f"h{x}"),
        )
        met = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & self._alike())
        return met.select("a", "b", "na", "nb", "ha", "hb").distinct()

    def _links(self) -> DataFrame:
        """Confirmed pairs (a, b) of classes; `component` are the groups they form."""
        bits = self._bits()
        found = cut(members(index(self.docs, self.text_col, self.s, bits)))
        checked = cut(self._stars(found))
        links = cut(self._confirmed(checked))
        self.component = connected(links)
        rows, buckets = self._open(found, self.component)
        hot = cut(buckets.where(F.col("open") > self.s.open_pairs * F.col("members")).orderBy(F.desc("open"), "key").limit(self.s.hot_keys).select("key"))
        few = self._met(rows.join(F.broadcast(hot), "key", "left_anti"))
        links = self._with(links, cut(few.join(checked.select("a", "b"), ["a", "b"], "left_anti")))
        if hot.isEmpty():
            return links
        # at most `hot_keys` of them
        skipped = np.sort(hot.toArrow().column("key").to_numpy().view(U))
        # only members of hot buckets have such keys; where they are many all texts are read again
        touched = cut(rows.join(F.broadcast(hot), "key", "left_semi").select(F.col("id").alias(self.id_col)).distinct())
        docs = self.docs.select(F.col(self.id_col).cast("long").alias(self.id_col), self.text_col)
        if fits_broadcast(touched):
            docs = docs.join(F.broadcast(touched), self.id_col, "left_semi")
        more = cut(members(index(docs, self.text_col, self.s, bits, skipped)))
        stars = self._apart(self._stars(more), self.component).drop("ca", "cb")
        links = self._with(links, cut(stars.join(checked.select("a", "b"), ["a", "b"], "left_anti")))
        rows, _ = self._open(more, self.component)
        return self._with(links, cut(self._met(rows)))

    def _with(self, links: DataFrame, pairs: DataFrame) -> DataFrame:
        """The links with those of the pairs that are confirmed."""
        if pairs.isEmpty():
            return links
        fresh = cut(self._confirmed(pairs))
        self.component = self._joined(self.component, fresh)
        return links.unionByName(fresh)

    def components(self) -> DataFrame:
        """(id, n_shingles, component) of every row.

        The component is the smallest id that can be reached. An empty set is linked with
        nothing, rows with equal ids count as one document, a row with a null id has the
        component of its set, null if it has none.
        """
        stands = self.classes.select("set_hash", F.col("id").alias("first"))
        held = self.rows.select("id", "n_shingles", "set_hash").join(stands, "set_hash", "left")
        held = cut(held.withColumn("first", F.coalesce("first", "id")))
        # rows of one id with different sets link their classes
        several = held.groupBy("id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low <> high")
        own = held.where("id <> first").join(several.select("id"), "id", "left_semi")
        component = self._joined(self.component, cut(own.select(F.col("id").alias("a"), F.col("first").alias("b"))))
        return held.join(component.withColumnRenamed("id", "first"), "first", "left").select(
            "id", "n_shingles", F.coalesce("component", "first").alias("component")
        )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    found = NGramJoin(docs, id_col, text_col, settings).components()
    return found.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
