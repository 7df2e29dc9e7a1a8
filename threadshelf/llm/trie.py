"""Prefix trie of conversations, built as a burst trie.

Sequences of turns start in one container under the root. A container that holds too many is
burst by the next turn: its prefix becomes a head, and the sequences go to the containers of
their next prefix. What remains under each head is small, is sorted, and is swept once into
nodes with a stack as deep as the sequences are long. Heads get the sums of their containers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.llm.common import arrow_schema
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import fits_broadcast

ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()
# Rows handed on at a time.
BATCH = 5_000


@dataclass(frozen=True)
class Settings:
    """Sequences a container may hold: `least`, or the share of all that gives about
    `containers` of them. At every depth there are fewer heads than `containers`, so a round that
    looks `window` turns ahead sends at most `containers * window` prefixes to the tasks."""

    least: int = 10_000
    containers: int = 4_096
    window: int = 16
    widest: int = 256

    def capacity(self, sequences: int) -> int:
        return max(self.least, -(-sequences // self.containers))


def turn_lists(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns as (key, bytes), in order.

    `rows` has (conv_id, turn, role, text). Null roles and texts are empty; rows without a
    conv_id are left out. Turns go by number, nulls first, then by role and the MD5 of the text.
    The key is the MD5 of role and text; the texts themselves stay behind.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            role.alias("role"),
            F.md5(text.cast("binary")).alias("text"),
            F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("turn"),
    )
    lists = narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"], t["bytes"])).alias("turns"))


def spliced(lists: DataFrame, base: Column, take: Column, most: int) -> DataFrame:
    """Conversations whose first `take` turns (at most `most`) are those of conversation `base`,
    as far as it has them; their own go on after as many. An absent base has none."""
    given = cut(lists)
    starts = given.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_start"))
    asked = given.withColumns({"_of": base, "_take": take})
    start = F.coalesce("_start", F.array().cast(lists.schema["turns"].dataType))
    return asked.join(starts, F.col("_of") == F.col("_base"), "left").select(
        "conv_id",
        F.concat(F.slice(start, F.lit(1), F.col("_take")), F.slice("turns", F.col("_take") + 1, F.size("turns"))).alias("turns"),
    )


def chained(lists: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes, whole): `keys` name the prefixes of 1, 2, ... turns."""
    schema = "conv_id long, keys array<binary>, sizes array<long>, whole binary"
    kind = arrow_schema(schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, whole = [], [], []
            for turns in batch.column("turns").to_pylist():
                own, last = [], ROOT
                for turn in turns:
                    last = hashlib.md5(last + turn["key"]).digest()
                    own.append(last)
                keys.append(own)
                sizes.append([turn["bytes"] for turn in turns])
                whole.append(last)
            columns = [batch.column("conv_id"), *map(pa.array, (keys, sizes, whole), kind.types[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return lists.select("conv_id", "turns").mapInArrow(chain, schema)


def equal_sequences(chains: DataFrame) -> DataFrame:
    """(whole, n, conv, ends_sha256) of the conversations with the same turns.

    The digest of their ids takes them in order, one after the other as they stream by.
    """
    schema = "whole binary, n long, conv long, ends_sha256 string"
    kind = arrow_schema(schema)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n, conv, sha = None, 0, None, None
        done: list[tuple] = []
        for batch in batches:
            for key, one in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != whole:
                    if whole is not None:
                        done.append((whole, n, conv, sha.hexdigest()))
                    whole, n, conv, sha = key, 0, one, hashlib.sha256()
                sha.update(("," if n else "").encode() + str(one).encode())
                n += 1
            if len(done) > BATCH:
                yield _rows(done, kind)
                done = []
        if whole is not None:
            yield _rows([*done, (whole, n, conv, sha.hexdigest())], kind)

    ordered = chains.select("whole", "conv_id").repartition("whole").sortWithinPartitions("whole", "conv_id")
    return ordered.mapInArrow(group, schema)


def _rows(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


HEAD = "key binary, parent binary, depth int, n long, conv long, bytes long"


class BurstTrie:
    """Heads and containers of the different sequences of `chained` conversations."""

    def __init__(self, chains: DataFrame, settings: Settings = Settings()):
        self.s = settings
        self.spark = chains.sparkSession
        chains = cut(chains)
        self.equal = cut(equal_sequences(chains))
        several = self.equal.select(F.col("conv").alias("conv_id"), "n", "ends_sha256")
        self.sequences = cut(chains.join(several, "conv_id").withColumnRenamed("conv_id", "conv"))
        self.heads, self.contained = self._burst()

    def _burst(self) -> tuple[DataFrame, DataFrame]:
        """Heads (HEAD), and the sequences with the `depth` of their last head."""
        total = self.sequences.agg(F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("conv").alias("conv")).first()
        if not total["seqs"]:
            return self.spark.createDataFrame([], HEAD), self.sequences.withColumn("depth", F.lit(0))
        root = self.spark.createDataFrame([(ROOT, None, 0, total["n"], total["conv"], 0)], HEAD)
        heads, settled = [root], []
        capacity, window = self.s.capacity(total["seqs"]), self.s.window
        open_ = self.sequences.withColumn("depth", F.lit(0))
        if total["seqs"] <= capacity:
            return root, open_
        while True:
            found = cut(self._oversized(open_, capacity, window))
            heads.append(found)
            # fewer than containers * window rows
            keys = frozenset(row["key"] for row in found.select("key").toLocalIterator())
            moved = cut(self._moved(open_, keys, window))
            settled.append(moved.where("NOT open").drop("open"))
            open_ = moved.where("open").drop("open")
            if open_.isEmpty():
                break
            window = min(2 * window, self.s.widest)
        for more in heads[1:]:
            root = root.unionByName(more)
        contained = settled[0]
        for more in settled[1:]:
            contained = contained.unionByName(more)
        return cut(root), contained

    def _oversized(self, open_: DataFrame, capacity: int, window: int) -> DataFrame:
        """The prefixes, up to `window` turns below their head, with too many sequences."""
        ahead = open_.select("n", "conv", "depth", "keys", "sizes", F.posexplode(F.slice("keys", F.col("depth") + 1, F.lit(window))).alias("i", "key"))
        place = F.col("depth") + F.col("i")
        level = ahead.select(
            "key", F.when(place > 0, F.get("keys", place - 1)).otherwise(F.lit(ROOT)).alias("parent"),
            (place + 1).alias("depth"), "n", "conv", F.get("sizes", place).alias("bytes"),
        )
        counts = level.groupBy("key", "parent", "depth", "bytes").agg(F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("conv").alias("conv"))
        return counts.where(F.col("seqs") > capacity).select("key", "parent", "depth", "n", "conv", "bytes")

    def _moved(self, open_: DataFrame, keys: frozenset, window: int) -> DataFrame:
        """The sequences under their lowest head so far; open if that lies at the window's end."""
        sent = self.spark.sparkContext.broadcast(keys)
        order = [f.name for f in open_.schema]

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads = sent.value
            for batch in batches:
                depths, open_rows = [], []
                for prefixes, depth in zip(batch.column("keys").to_pylist(), batch.column("depth").to_pylist(), strict=True):
                    end = min(len(prefixes), depth + window)
                    at = depth
                    while at < end and prefixes[at] in heads:
                        at += 1
                    depths.append(at)
                    open_rows.append(at == depth + window and at < len(prefixes))
                place = batch.schema.get_field_index("depth")
                yield batch.set_column(place, "depth", pa.array(depths, pa.int32())).append_column("open", pa.array(open_rows))

        schema = ", ".join(f"{name} {open_.schema[name].dataType.simpleString()}" for name in order)
        return open_.mapInArrow(move, f"{schema}, open boolean")

    def _swept(self) -> DataFrame:
        """The nodes below the heads, from one pass over the sorted sequences of each container."""
        schema = (
            "key binary, parent binary, head binary, depth int, n long, conv long, children long, leaves long, saved long, ends_sha256 string"
        )
        kind = arrow_schema(schema)

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head, top = None, 0
            # open nodes: key, bytes, n, conv, children, leaves, saved, digest
            stack: list[list] = []
            done: list[tuple] = []

            def close(keep: int) -> None:
                while len(stack) > keep:
                    key, size, n, conv, children, leaves, saved, ends = stack.pop()
                    leaves, saved = leaves or 1, saved + (n - 1) * size
                    above = stack[-1] if stack else None
                    if above:
                        above[2] += n
                        above[3] = conv if above[3] is None else min(above[3], conv)
                        above[4] += 1
                        above[5] += leaves
                        above[6] += saved
                    depth = top + len(stack) + 1
                    done.append((key, above[0] if above else head, head, depth, n, conv, children, leaves, saved, ends))

            wanted = ("head", "depth", "keys", "sizes", "n", "conv", "ends_sha256")
            for batch in batches:
                for own, depth, keys, sizes, n, conv, ends in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                    if own != head:
                        close(0)
                        head, top = own, depth
                    same = 0
                    while same < len(stack) and top + same < len(keys) and stack[same][0] == keys[top + same]:
                        same += 1
                    close(same)
                    for place in range(top + same, len(keys)):
                        stack.append([keys[place], sizes[place], 0, None, 0, 0, 0, NOTHING])
                    last = stack[-1]
                    last[2], last[3], last[7] = last[2] + n, conv if last[3] is None else min(last[3], conv), ends
                    if len(done) > BATCH:
                        yield _rows(done, kind)
                        done.clear()
            close(0)
            if done:
                yield _rows(done, kind)

        rows = self.contained.where(F.size("keys") > F.col("depth"))
        head = F.when(F.col("depth") > 0, F.get("keys", F.col("depth") - 1)).otherwise(F.lit(ROOT))
        rows = rows.select(head.alias("head"), "depth", "keys", "sizes", "n", "conv", "ends_sha256")
        return rows.repartition("head").sortWithinPartitions("head", "keys").mapInArrow(sweep, schema)

    def _head_nodes(self, swept: DataFrame) -> DataFrame:
        """The heads with the sums of the containers and heads below them.

        Each head adds what is its own to all heads above it: as many rows as heads times depth.
        """
        below = swept.where(F.col("parent") == F.col("head")).groupBy(F.col("head").alias("key")).agg(
            F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        under = self.heads.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
        own = self.heads.join(below, "key", "left").join(under, "key", "left").fillna(0, ["children", "leaves", "saved", "more"])
        own = own.withColumn("children", F.col("children") + F.col("more"))
        own = cut(own.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("bytes")))
        # the smallest member is a sequence that runs through the head
        paths = own.select("conv", "depth", "leaves", "saved")
        through = self.sequences.select("conv", "keys").join(F.broadcast(paths) if fits_broadcast(paths) else paths, "conv")
        above = F.concat(F.array(F.lit(ROOT)), F.slice("keys", F.lit(1), F.col("depth")))
        sums = through.select("leaves", "saved", F.explode(above).alias("key")).groupBy("key").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        ends = self.equal.select(F.col("whole").alias("key"), "ends_sha256")
        found = own.drop("leaves", "saved").join(sums, "key").join(ends, "key", "left")
        leaves = F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves")
        return found.select(
            "key", "parent", "depth", "n", "conv", "children", leaves, "saved", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
        )

    def nodes(self) -> DataFrame:
        """One row a node: (key, parent, depth, n, conv, parent_conv, children, leaves, saved, ends_sha256).

        `key` names the turns from the root on, `n` counts conversations and `conv` is the smallest
        of them, `leaves` and `saved` are sums over the subtree, `ends_sha256` is of the ids of the
        conversations that end there. No conversations make no nodes.
        """
        swept = cut(self._swept())
        heads = self._head_nodes(swept)
        nodes = cut(heads.unionByName(swept.drop("head")))
        names = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
        return nodes.join(names, "parent", "left")


def prefix_trie(lists: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns), as `BurstTrie.nodes`."""
    return BurstTrie(chained(lists), settings).nodes()


def rebuilt(rows: DataFrame) -> DataFrame:
    """Conversations c that begin with the first h turns of conversation c - c % 5, h being the
    CRC-32 of c modulo 9."""
    take = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return spliced(turn_lists(rows), F.col("conv_id") - F.col("conv_id") % 5, take, 8)
