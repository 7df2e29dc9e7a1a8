"""Substring dedup by seed and extend: long word sequences that an earlier document has too.

Seeds are winnowed anchors: in every window of `length` words the word group with the least
hash is an anchor, so two documents that share a window share its anchor. Documents meet on
their anchors. A match is extended both ways at once by the hash of all words that a window
around the anchor can reach: where that is equal to a smaller document's, every window around
the anchor is. Only where an anchor stands in different surroundings, its windows are compared
one by one. Matching windows that touch make the maximal repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.llm.common import Grams, arrow_schema, mix64, slices, type_of, word_hashes
from threadshelf.plans.lineage import cut

LENGTH = 13
# Words of an anchor. A window has LENGTH - GROUP + 1 groups, about 2 in 10 of all become anchors.
GROUP = 5
# Bytes of text whose anchors are compared before the shuffle.
BLOCK_BYTES = 4 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEEDS = "anchor long, around long, doc long, pos int, full boolean"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def least_positions(groups: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` groups, the place of its first least group."""
    place = np.arange(len(groups))
    value, reach = groups, 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(value) - step
        later = value[step:] < value[:n]
        place = np.where(later, place[step:], place[:n])
        value = np.where(later, value[step:], value[:n])
        reach += step
    return place


class Anchored:
    """Anchors of one document: `of` gives each window's anchor, `around` the anchors' surroundings."""

    def __init__(self, hashes: np.ndarray, length: int, group: int):
        self.length = length
        if len(hashes) < length:
            self.of = self.places = np.empty(0, np.int64)
            self.anchors = self.around = np.empty(0, np.uint64)
            return
        side = length - group
        # beyond the ends stand values of their own, so that an end only equals an end
        edge = mix64(np.array([length, length + 1], np.uint64))
        self.side, self.n = side, len(hashes)
        self.grams = Grams(np.concatenate([np.repeat(edge[:1], side), hashes, np.repeat(edge[1:], side)]))
        groups = self.grams.of(group)[side : side + len(hashes) - group + 1]
        self.of = least_positions(groups, length - group + 1)
        self.places = self.of[np.r_[True, self.of[1:] != self.of[:-1]]]
        self.anchors = groups[self.places]
        self.around = self.grams.of(2 * side + group, self.places)

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows at the given starts."""
        return self.grams.of(self.length, starts + self.side) if len(starts) else np.empty(0, np.uint64)

    def with_anchor(self, places: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is at one of the places."""
        wanted = np.zeros(len(self.of) + self.length, bool)
        wanted[places] = True
        return np.flatnonzero(wanted[self.of])


def anchored(texts: pa.Array, length: int, group: int) -> Iterator[Anchored]:
    hashes, begins = word_hashes(texts)
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        yield Anchored(hashes[start:end], length, group)


def lists(column: pa.ListArray) -> tuple[list[int], dict[str, np.ndarray]]:
    """A column of lists of structs: where each row's list begins, and the fields of all."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    kind = column.type.value_type
    fields = {kind.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(kind.num_fields)}
    return np.concatenate([[0], np.cumsum(sizes)]).tolist(), fields


def seeds(docs: DataFrame, length: int, group: int, block_bytes: int) -> DataFrame:
    """Anchors of all documents; those that a smaller document of the same block has in the same
    surroundings are full matches already, and need to meet no other."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, block_bytes):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = list(anchored(batch.column(1), length, group))
            counts = [len(f.places) for f in found]
            if not sum(counts):
                continue
            anchor = np.concatenate([f.anchors for f in found])
            around = np.concatenate([f.around for f in found])
            pos = np.concatenate([f.places for f in found]).astype(np.int32)
            doc = np.repeat(ids.astype(np.int64), counts)
            del found
            order = np.lexsort((doc, around, anchor))
            new = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (around[order][1:] != around[order][:-1])]
            first = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            full = np.empty(len(order), bool)
            full[order] = doc[order] > first
            # what is decided goes anywhere
            anchor[full] = mix64(anchor[full] ^ mix64(doc[full].view(np.uint64) + pos[full].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(full)],
                names=["anchor", "around", "doc", "pos", "full"],
            )

    return docs.mapInArrow(find, SEEDS)


def marks(found: DataFrame) -> DataFrame:
    """(doc, pos, around, full): anchors with a full match, and anchors to be looked at closely.

    Of equal surroundings only the smallest document's anchor is looked at.
    """
    same = Window.partitionBy("anchor", "around")
    any_ = Window.partitionBy("anchor")
    met = (
        found.repartition("anchor")
        .withColumn("first", F.min("doc").over(same))
        .withColumn("low", F.min("around").over(any_))
        .withColumn("high", F.max("around").over(any_))
    )
    full = F.col("full") | (F.col("doc") > F.col("first"))
    return cut(met.where(full | (F.col("low") != F.col("high"))).select("doc", "pos", "around", full.alias("full")))


def _valid(own: Anchored, pos: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Places of the marks that fit this text. Rows may share an id."""
    if not len(pos) or not len(own.places):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(own.places, pos), len(own.places) - 1)
    fits = (own.places[at] == pos) & (own.around[at] == around.view(np.uint64))
    return pos[fits].astype(np.int64)


def without_words(text: str | None, gone: list[bool]) -> str:
    """The text without some of its words and the white space behind them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(raw)]
    ends = [*starts[1:], len(raw)]
    kept = b"".join(raw[a:b] for a, b, x in zip(starts, ends, gone, strict=True) if not x)
    return (raw[: starts[0]] + kept).decode("utf-8", "surrogatepass")


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP,
    block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None, layout: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every row, and the columns named in `carry`.

    A window of `length` words is removed where its word sequence also starts in a document with
    a smaller id. `spans` are the removed maximal repeats as (first, words); `kept` is the rest,
    one space between words, empty for a null text; with `layout` it is the text as it was, only
    without the removed words. All windows are judged on the input, and
    repeats inside one document stay. Rows with equal ids are compared with smaller ids only; a
    row with a null id is kept whole and compared with nothing. Window hashes have 64 bits.

    Texts cross the network once: both joins below use the same exchange.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    whole = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), carried.alias("carried")
    )
    texts = whole.where("doc IS NOT NULL")
    listed = marks(seeds(texts, length, group, block_bytes)).groupBy("doc").agg(
        F.collect_list(F.struct("pos", "around", "full")).alias("marks")
    )
    marked = texts.join(listed, "doc", "left")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            begins, mark = lists(batch.column(3))
            near = ~mark["full"].astype(bool)
            some = np.add.reduceat(np.r_[near, False], begins[:-1]) if len(near) else np.zeros(batch.num_rows)
            some = np.flatnonzero((np.diff(begins) > 0) & (some > 0))
            rows = batch.take(pa.array(some))
            out: list[tuple[np.ndarray, ...]] = []
            docs = rows.column(0).to_numpy(zero_copy_only=False)
            for i, doc, own in zip(some.tolist(), docs, anchored(rows.column(1), length, group), strict=True):
                a, b = begins[i], begins[i + 1]
                which = near[a:b]
                starts = own.with_anchor(_valid(own, mark["pos"][a:b][which], mark["around"][a:b][which]))
                out.append((own.windows(starts), np.full(len(starts), doc), starts))
            if out:
                window, doc, start = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32))],
                    names=["win", "doc", "start"],
                )

    windows = marked.mapInArrow(close, "win long, doc long, start int")
    repeated = windows.withColumn("first", F.min("doc").over(Window.partitionBy("win"))).where("doc > first")
    starts = repeated.groupBy("doc").agg(F.collect_list(F.struct("start", "win")).alias("starts"))
    schema = (
        f"doc long, n_words long, n_removed long, spans array<struct<first: int, words: int>>, kept string, carried {type_of(whole, 'carried')}"
    )
    target = arrow_schema(schema)

    def unchanged(doc, text: str | None, n: int) -> tuple:
        kept = (text or "") if layout else b" ".join(split_words(text)).decode("utf-8", "surrogatepass")
        return doc, n, 0, [], kept

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            begins, mark = lists(batch.column(3))
            found, start = lists(batch.column(4))
            hashes, words = word_hashes(batch.column(1))
            words = words.tolist()
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n = words[i + 1] - words[i]
                if begins[i] == begins[i + 1]:
                    rows.append(unchanged(doc, text, n))
                    continue
                gone = np.zeros(n + 1, np.int64)
                own = Anchored(hashes[words[i] : words[i + 1]], length, group)
                a, b = begins[i], begins[i + 1]
                full = mark["full"][a:b].astype(bool)
                first = own.with_anchor(_valid(own, mark["pos"][a:b][full], mark["around"][a:b][full]))
                a, b = found[i], found[i + 1]
                if a < b:
                    at, is_ = start["start"][a:b].astype(np.int64), start["win"][a:b].view(np.uint64)
                    inside = at < len(own.of)
                    at, is_ = at[inside], is_[inside]
                    first = np.union1d(first, at[own.windows(at) == is_])
                if not len(first):
                    rows.append(unchanged(doc, text, n))
                    continue
                np.add.at(gone, first, 1)
                np.add.at(gone, first + length, -1)
                gaps = np.cumsum(gone)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.r_[0, gaps, 0]))
                spans = [{"first": int(a), "words": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                if layout:
                    kept = without_words(text, gaps.tolist())
                else:
                    left = [w for w, x in zip(split_words(text), gaps.tolist(), strict=True) if not x]
                    kept = b" ".join(left).decode("utf-8", "surrogatepass")
                rows.append((doc, n, int(gaps.sum()), spans, kept))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], names=target.names)

    known_ids = marked.join(starts, "doc", "left")
    no_ids = whole.where("doc IS NULL").select(
        "doc", "text", "carried", F.lit(None).cast(listed.schema["marks"].dataType).alias("marks"),
        F.lit(None).cast(starts.schema["starts"].dataType).alias("starts"),
    )
    done = known_ids.mapInArrow(remove, schema).unionByName(no_ids.mapInArrow(remove, schema))
    return done.select(
        F.col("doc").cast(type_of(docs, id_col)).alias(id_col), "n_words", "n_removed", "spans", "kept",
        *[F.col("carried")[c].alias(c) for c in carry or []],
    )
