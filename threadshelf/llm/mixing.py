"""Mixing sources to target weights: fixed-length blocks, drawn shards, joined by block index.

The words of a source, one document after the other, are packed into blocks. Every output
shard draws how many of its slots each source gets; the slots of a source are numbered over
all shards, and a pseudorandom permutation per source and epoch turns a slot's number into a
block index. Documents and shards are numbered by sums inside buckets of bounded size plus the
sums of the buckets before, so no source is numbered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.llm.common import mix64, words
from threadshelf.plans.lineage import cut

# Weights by source, in order, repeating.
WEIGHTS = (5, 2, 1)
SEED = 20240


# Slots that one task expands, about.
EXPANDED_SLOTS = 100_000
MOST_PARTS = 20_000


@dataclass(frozen=True)
class Mix:
    """Sizes of a mix. `share` is the mix's size against all words, `most` a source's largest repeat."""

    block_words: int = 256
    shard_slots: int = 4096
    bucket_words: int = 4_000_000  # words numbered in one task
    bucket_shards: int = 4096
    share: float = 1.5
    most: int = 2
    seed: int = SEED


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, most: int = 2) -> dict[str | None, float]:
    """Target words per source: `share` of all words by weight, none above `most` times its size.

    Sources are weighed in order of code points, null last. What a source cannot take is
    shared again by weight among those below their limit.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, found, active = share * sum(sizes.values()), {}, list(order)
    while active:
        total = sum(weight[s] for s in active)
        full = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not full:
            found |= {s: left * weight[s] / total for s in active}
            break
        found |= {s: float(most * sizes[s]) for s in full}
        left -= sum(found[s] for s in full)
        active = [s for s in active if s not in found]
    return found


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds, walked until inside the range."""
    if n <= 1:
        return index.copy()
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            scrambled = mix64(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64))
            left, right = right, left ^ (scrambled & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, key: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of the key: buckets in order, `order` inside."""
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    bases = cut(sums.select(key, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")))
    return (
        rows.withColumn("_own", F.sum(value).over(inside) - F.col(value))
        .join(bases, [key, bucket])
        .withColumn(name, F.col("_own") + F.col("_base"))
        .drop("_own", "_base")
    )


class Mixture:
    """The mix of a table of documents. `spans` and `documents()` are computed by Spark on demand.

    Only totals by source come to the driver (one row each). A null text has no words. Rows are
    told apart by their place in the source, so repeated and null ids are allowed.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()):
        self.mix, self.spark = mix, docs.sparkSession
        self.sized = cut(
            docs.select(
                F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                F.size(words(F.col(text_col).cast("string"))).cast("long").alias("size"),
            )
        )
        totals = {r["source"]: r["size"] for r in self.sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
        self.targets = targets(totals, share=mix.share, most=mix.most)
        self.order = list(self.targets)
        self.order.sort(key=lambda s: (s is None, s or ""))
        self.sizes = np.array([totals[s] for s in self.order], np.int64)
        # every source gives its target to the word
        self.words = np.array([round(self.targets[s]) for s in self.order], np.int64)
        b = mix.block_words
        full, tail = self.sizes // b, self.sizes % b
        self.blocks = full + (tail > 0)
        safe = np.maximum(self.sizes, 1)
        self.slots = (self.words // safe) * self.blocks + -(-(self.words % safe) // b)
        self.sources = self.spark.createDataFrame(
            [
                (i, s, int(self.sizes[i]), float(self.targets[s]), int(-(-self.sizes[i] // mix.bucket_words) or 1))
                for i, s in enumerate(self.order)
            ],
            "source_no int, source string, source_size long, target double, buckets long",
        )
        self._placed: DataFrame | None = None

    def placed(self) -> DataFrame:
        """(source_no, start, id, size): where each document's words begin in its source."""
        if self._placed is None:
            known = self.sized.join(self.sources, self.sized["source"].eqNullSafe(self.sources["source"]))
            order = F.xxhash64("id", "size")
            rows = known.select(
                "source_no", "id", "size", order.alias("_order"), F.pmod(order, "buckets").alias("_bucket")
            )
            self._placed = cut(
                numbered(rows, "source_no", "_bucket", ["_order", "id", "size"], "size", "start").drop("_order", "_bucket")
            )
        return self._placed

    def pieces(self) -> DataFrame:
        """The documents' words by block: (source_no, block, at, n, start, id, size)."""
        b = self.mix.block_words
        end = F.col("start") + F.col("size")
        spread = self.placed().where("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
        )
        first = F.greatest(F.col("start"), F.col("block") * b)
        last = F.least(end, (F.col("block") + 1) * b)
        return spread.select(
            "source_no", "block", (first - F.col("block") * b).alias("at"), (last - first).alias("n"), "start", "id", "size"
        )

    def drawn(self) -> DataFrame:
        """(shard, source_no, slot, first, count): the slots every shard draws from each source;
        `slot` is the first of them in the shard, `first` the first in the source."""
        mix, total = self.mix, int(self.slots.sum())
        shares = self.slots / max(total, 1)

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard in frame["id"]:
                    n = min(mix.shard_slots, total - shard * mix.shard_slots)
                    counts = np.random.default_rng([mix.seed, shard]).multinomial(n, shares)
                    some = np.flatnonzero(counts)
                    slot = (np.cumsum(counts) - counts)[some]
                    yield pd.DataFrame({"shard": shard, "source_no": some.astype(np.int32), "slot": slot, "count": counts[some]})

        shards = self.spark.range(-(-total // mix.shard_slots)).mapInPandas(draw, "shard long, source_no int, slot long, count long")
        rows = cut(shards.withColumn("_bucket", F.floor(F.col("shard") / mix.bucket_shards)))
        return numbered(rows, "source_no", "_bucket", ["shard"], "count", "first").drop("_bucket")

    def slot_blocks(self) -> DataFrame:
        """(shard, slot, source_no, block, take): the block of every slot and the words it takes.

        Draws differ from the exact number of slots by chance. Slots of a source beyond its
        number go, in order, to the sources that were drawn too rarely.
        """
        mix, order = self.mix, self.drawn()
        got = np.zeros(len(self.order), np.int64)
        for row in order.groupBy("source_no").agg(F.sum("count").alias("n")).collect():
            got[row["source_no"]] = row["n"]
        slots, blocks, sizes, taken = self.slots, self.blocks, self.sizes, self.words
        over, under = np.maximum(got - slots, 0), np.maximum(slots - got, 0)
        over_base, under_end = np.cumsum(over) - over, np.cumsum(under)

        def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = mix.block_words
            for frame in frames:
                for row in frame.itertuples():
                    index = np.arange(row.first, row.first + row.count, dtype=np.int64)
                    source = np.full(len(index), row.source_no, np.int64)
                    spare = index >= slots[row.source_no]
                    if spare.any():
                        place = over_base[row.source_no] + index[spare] - slots[row.source_no]
                        to = np.searchsorted(under_end, place, side="right")
                        source[spare] = to
                        index[spare] = got[to] + place - (under_end - under)[to]
                    epoch, k = index // blocks[source], index % blocks[source]
                    whole = sizes[source] // b
                    block = k.copy()
                    for s, e in set(zip(source.tolist(), epoch.tolist(), strict=True)):
                        some = (source == s) & (epoch == e) & (k < whole)
                        block[some] = permuted(k[some], int(sizes[s] // b), mix.seed + 1_000_003 * s + e)
                    left = taken[source] - epoch * sizes[source] - k * b
                    length = np.where(block < whole, b, sizes[source] % b)
                    yield pd.DataFrame(
                        {
                            "shard": row.shard, "slot": row.slot + np.arange(len(index)), "source_no": source.astype(np.int32),
                            "block": block, "take": np.clip(left, 0, length),
                        }
                    )

        # the rows are few and small, the slots they stand for are not: dealt by slots
        parts = max(1, min(int(self.slots.sum()) // EXPANDED_SLOTS, MOST_PARTS))
        return order.repartition(parts, "shard").mapInPandas(expand, "shard long, slot long, source_no int, block long, take long")

    def _joined(self, how: str) -> DataFrame:
        pieces, slots = self.pieces(), self.slot_blocks()
        n = F.least(F.col("n"), F.greatest(F.coalesce(F.col("take"), F.lit(0)) - F.col("at"), F.lit(0)))
        return pieces.join(slots, ["source_no", "block"], how).withColumn("words", n)

    def spans(self) -> DataFrame:
        """(shard, slot, source, block, at, id, first_word, words): what every slot of the mix
        holds; `at` orders the spans of one slot."""
        first = F.col("block") * self.mix.block_words + F.col("at") - F.col("start")
        named = self._joined("inner").where("words > 0").join(self.sources.select("source_no", "source"), "source_no")
        return named.select("shard", "slot", "source", "block", "at", "id", first.alias("first_word"), "words")

    def documents(self) -> DataFrame:
        """(id, source, size, source_size, target, taken) of every document row."""
        taken = self._joined("left").groupBy("source_no", "start", "id", "size").agg(F.sum("words").alias("taken"))
        empty = self.placed().where("size = 0").select("source_no", "start", "id", "size", F.lit(0).cast("long").alias("taken"))
        return (
            taken.unionByName(empty)
            .join(self.sources.drop("buckets"), "source_no")
            .select("id", "source", "size", "source_size", "target", "taken")
        )


def span_texts(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans with their words, one space between; ids must be unique here."""
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("_words"))

    def piece() -> Column:
        return F.array_join(F.slice("_words", F.col("first_word").cast("int") + 1, F.col("words").cast("int")), " ")

    return spans.join(texts, "id").withColumn("text", piece()).drop("_words")
