"""Exact and approximate nearest vectors by cosine similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.functions.vectors import SCORE_DIGITS, cosine_to_unit
from threadshelf.plans.lineage import cut, cut_counted

# Query vectors sent to every task at a time; more are looked for in further scans.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Queries and vectors of one scoring step, and pairs scored in DOUBLE at a time.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096
PAIR_BLOCK = 65_536
# Vectors a task compares with every query; the more, the fewer rows are left to rank.
TASK_VECTORS = 16_384
# Vectors looked up first for a query without k hits, as a multiple of k.
SEEDS = 8
# Fixed value: bytes of one of Spark's bitmaps.
BITMAP_BYTES = 4096


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _matrix(column) -> np.ndarray:
    """A list column as unit rows; the lists have the same length, as `checked` sees to."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(column)
    return unit_rows(flat.reshape(rows, -1)) if rows else np.zeros((0, 0))


def checked(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The vectors that have an id and an embedding; one of another length fails by its id."""
    size = F.size("embedding")
    said = F.concat(
        F.lit("vector "), F.col("id").cast("string"), F.lit(" has "), size.cast("string"),
        F.lit(f" dimensions, the queries have {dimensions}"),
    )
    kind = vectors.schema["embedding"].dataType
    fitting = F.when(size == dimensions, F.col("embedding")).otherwise(F.raise_error(said).cast(kind))
    known = vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull())
    return known.withColumn("embedding", fitting)


@dataclass
class Best:
    """Running k best rows of each query: higher score first, then lower id, then document.

    Scores are compared rounded and handed on as they are, so that a reader rounds once.
    """

    k: int
    q: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    docs: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1"))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        q = np.concatenate([self.q, q])
        ids = np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        docs = np.concatenate([self.docs, docs])
        order = np.lexsort((docs, ids, -np.round(scores, SCORE_DIGITS), q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = order[place < self.k]
        self.q, self.ids = q[place < self.k], ids[kept]
        self.scores, self.docs = scores[kept], docs[kept]


# Gives, for a matrix of queries, the (query, bucket) pairs to score.
Probes = Callable[[np.ndarray], np.ndarray]


def _score(
    best: Best, start: int, queries: np.ndarray, batch: pa.RecordBatch, vectors: np.ndarray,
    allowed: np.ndarray | None,
) -> None:
    """Offer a batch of vectors to a block of queries; `allowed` masks (query, bucket) pairs."""
    scores = queries @ vectors.T
    if allowed is not None:
        scores[~allowed[:, batch.column("bucket").to_numpy()]] = -np.inf
    wanted = np.isfinite(scores)
    if scores.shape[1] > best.k:
        last = scores.shape[1] - best.k
        compared = np.round(scores, SCORE_DIGITS)
        wanted &= compared >= np.partition(compared, last, axis=1)[:, [last]]
    q, v = np.nonzero(wanted)
    docs = np.full(len(v), "", "U1")
    if "doc_id" in batch.schema.names and len(v):
        docs = np.array(batch.column("doc_id").take(pa.array(v)).to_pylist(), dtype=str)
    best.add(q + start, batch.column("id").to_numpy()[v], scores[q, v], docs)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Number the hits of each query from 1 and keep the first k."""
    ties = ["id", "doc_id"] if "doc_id" in hits.columns else ["id"]
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", SCORE_DIGITS)), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
    """Exact k nearest vectors (id, embedding) of every query (qid, embedding).

    Gives (qid, rank, id, score), and doc_id where the vectors have one; vectors without an id
    are passed over. Vectors are scored where they lie, by matrix product; each task passes on
    its k best per query. Queries beyond the size sent to every task take further scans. With
    `eligible` (id) only these are scored: bitmaps of their ids go to the scan, in parts of that
    size too, and no vector is moved.
    """
    return _nearest(queries, vectors, k, None, eligible)


def _nearest(
    queries: DataFrame, vectors: DataFrame, k: int, probes: Probes | None = None, eligible: DataFrame | None = None
) -> DataFrame:
    """Every part of the queries against every part of the eligible ids, one scan after the other:
    what a scan found is written down before the next part is sent."""
    _check_k(k)
    queries = _known_queries(queries)
    dimensions = _dimensions(queries)
    if dimensions is None:
        return _no_hits(queries, vectors)
    vectors = checked(vectors, dimensions)
    parts = _parts(queries, dimensions)
    allowed = [None] if eligible is None else _id_parts(eligible)
    if len(parts) * len(allowed) == 1:
        return ranked(_scan(parts[0], vectors, k, probes, allowed[0])[0], k)
    found = []
    for part in parts:
        for ids in allowed:
            hits, sent = _scan(part, vectors, k, probes, ids)
            found.append(cut(ranked(hits, k).drop("rank")))
            sent.destroy()
    return ranked(reduce(DataFrame.unionByName, found), k) if found else _no_hits(queries, vectors)


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def _known_queries(queries: DataFrame) -> DataFrame:
    """The queries, encoded once however often they are read."""
    return cut(queries.where(F.col("embedding").isNotNull()).select("qid", "embedding"))


def _dimensions(queries: DataFrame) -> int | None:
    size = F.size("embedding")
    least, most = queries.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"queries have between {least} and {most} dimensions")
    return most


def _parts(queries: DataFrame, dimensions: int, more: int = 0) -> list[DataFrame]:
    """The queries, of `more` bytes beside the vector, in parts of a size that can be sent to every task."""
    n = max(1, -(-queries.count() * (dimensions * 8 + more) // MAX_BROADCAST_BYTES))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def _id_parts(eligible: DataFrame) -> list[DataFrame]:
    """Bitmaps (bucket, bits) of the ids, in parts of a size that can be sent to every task."""
    ids = eligible.select(F.col("id").cast("long").alias("id")).where(F.col("id").isNotNull())
    bitmaps = cut(
        ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    )
    n = max(1, -(-bitmaps.count() * BITMAP_BYTES // MAX_BROADCAST_BYTES))
    return [bitmaps.where(F.pmod(F.xxhash64("bucket"), F.lit(n)) == i) for i in range(n)]


@dataclass
class IdSet:
    """Ids as the bitmaps of `_id_parts`."""

    buckets: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, bitmaps: DataFrame) -> IdSet:
        table = bitmaps.orderBy("bucket").toArrow()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8)
        return cls(table.column("bucket").to_numpy(), bits.reshape(-1, BITMAP_BYTES))

    def has(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(len(ids), bool)
        span = 8 * BITMAP_BYTES
        above = ids > 0
        # Java's division and remainder of negative numbers go towards zero
        bucket = np.where(above, 1 + (ids - 1) // span, -(-ids // span))
        place = np.where(above, (ids - 1) % span, -ids % span)
        row = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        return (self.buckets[row] == bucket) & (self.bits[row, place >> 3] >> (place & 7) & 1 == 1)


def _hit_columns(vectors: DataFrame) -> list[str]:
    return ["id", "embedding", *[c for c in ("doc_id", "bucket") if c in vectors.columns]]


def _schema(vectors: DataFrame) -> str:
    return "qid long, id long, score double" + (", doc_id string" if "doc_id" in vectors.columns else "")


def _no_hits(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], _schema(vectors) + ", rank int")


def _query_matrix(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = queries.orderBy("qid").toArrow()
    return table.column("qid").to_numpy(), _matrix(table.column("embedding"))


def _scan(
    queries: DataFrame, vectors: DataFrame, k: int, probes: Probes | None = None, eligible: DataFrame | None = None
) -> tuple[DataFrame, Broadcast]:
    """Score the vectors against a query matrix of checked size that all tasks hold."""
    vectors = vectors.select(*_hit_columns(vectors))
    qids, matrix = _query_matrix(queries)
    ids = None if eligible is None else IdSet.of(eligible)
    if probes and len(matrix):
        # buckets that no query probes are not read
        reached = np.zeros(0, np.int64)
        for start in range(0, len(matrix), QUERY_BLOCK):
            some = probes(matrix[start : start + QUERY_BLOCK]).any(axis=0)
            reached = np.union1d(reached, np.flatnonzero(some))
        vectors = vectors.where(F.col("bucket").isin(reached.tolist()))
    sent = queries.sparkSession.sparkContext.broadcast((qids, matrix, ids))
    named = "doc_id" in vectors.columns

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, ids = sent.value
        starts = range(0, len(matrix), QUERY_BLOCK)
        blocks = [matrix[start : start + QUERY_BLOCK] for start in starts]
        masks = [probes(block) if probes else None for block in blocks]
        best = Best.none(k)
        for batch in batches:
            if ids is not None:
                batch = batch.filter(pa.array(ids.has(batch.column("id").to_numpy())))
            if batch.num_rows:
                rows = _matrix(batch.column("embedding"))
                for start, block, mask in zip(starts, blocks, masks):
                    _score(best, start, block, batch, rows, mask)
        yield _hits(best, qids, named)

    return vectors.mapInArrow(scan, _schema(vectors)), sent


def _hits(best: Best, qids: np.ndarray, named: bool) -> pa.RecordBatch:
    columns = [pa.array(qids[best.q], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.scores)]
    names = ["qid", "id", "score"]
    if named:
        columns, names = [*columns, pa.array(best.docs.tolist(), pa.string())], [*names, "doc_id"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def nearest_to_one(query: list[float], vectors: DataFrame, k: int) -> DataFrame:
    """Exact k nearest vectors of one query, as a plain expression and a top-k sort."""
    _check_k(k)
    direction = unit_rows(np.asarray([query], np.float64))[0]
    literal = F.array(*[F.lit(float(x)) for x in direction])
    scored = vectors.where(F.col("embedding").isNotNull()).select(
        "id", cosine_to_unit(F.col("embedding"), literal).alias("score")
    )
    return scored.orderBy(F.desc(F.round("score", SCORE_DIGITS)), "id").limit(k)


# --- approximate search -------------------------------------------------------------


@dataclass(frozen=True)
class Hyperplanes:
    """Hyperplanes with random signs; a vector's bucket is the pattern of sides it lies on."""

    dimensions: int
    bits: int = 8
    seed: int | str = 7

    def matrix(self) -> np.ndarray:
        def sign(dimension: int, bit: int) -> float:
            digest = hashlib.md5(f"{self.seed}:{dimension}:{bit}".encode()).hexdigest()
            return 1.0 if digest[0] < "8" else -1.0

        return np.array(
            [[sign(d, bit) for bit in range(self.bits)] for d in range(self.dimensions)]
        )

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.matrix() > 0) @ (1 << np.arange(self.bits))

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The buckets of each query, that which costs least to reach first.

        The cost of a bucket is the sum of squared distances to the planes that have to
        be crossed.
        """
        margins = queries @ self.matrix()
        codes = np.arange(1 << self.bits)
        sides = (codes[:, None] >> np.arange(self.bits)) & 1
        own = margins > 0
        costs = np.zeros((len(queries), len(codes)))
        for bit in range(self.bits):
            crossed = own[:, [bit]] != (sides[:, bit] == 1)[None, :]
            costs = costs + crossed * margins[:, [bit]] ** 2
        return np.argsort(costs, axis=1, kind="stable")

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """(query, bucket) mask of the n buckets that cost each query least to reach."""
        mask = np.zeros((len(queries), 1 << self.bits), bool)
        np.put_along_axis(mask, self.order(queries)[:, :n], True, axis=1)
        return mask


def with_buckets(vectors: DataFrame, planes: Hyperplanes) -> DataFrame:
    """Add the `bucket` column. Written with partitionBy("bucket"), a search then reads
    only the buckets it probes."""
    columns = [f for f in vectors.schema if f.name != "bucket"]
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = planes.buckets(_matrix(batch.column("embedding")))
            yield batch.append_column("bucket", pa.array(found.astype(np.int32)))

    known = vectors.where(F.col("embedding").isNotNull()).select(*[f.name for f in columns])
    return known.mapInArrow(assign, f"{layout}, bucket int")


def nearest_approximate(
    queries: DataFrame, indexed: DataFrame, k: int, planes: Hyperplanes, probes: int
) -> DataFrame:
    """k nearest vectors among those in the probed buckets; every one of them is scored.

    `indexed` has (id, embedding, bucket). With all buckets probed the result is exact.
    """
    def reached(matrix: np.ndarray) -> np.ndarray:
        return planes.probes(matrix, probes)

    return _nearest(queries, indexed, k, reached)


def enough_probes(
    queries: DataFrame, indexed: DataFrame, k: int, planes: Hyperplanes, recall: float = 0.9
) -> int:
    """The fewest probes at which `nearest_approximate` finds that share of the k nearest.

    Measured with exact searches: pass a sample of the queries to come. Every vector of a probed
    bucket is scored, so a neighbour is found just when its bucket is probed.
    """
    queries = _known_queries(queries)
    keys = [c for c in ("id", "doc_id") if c in indexed.columns]
    hits = nearest(queries, indexed, k).join(indexed.select(*keys, "bucket"), keys)
    found = hits.select("qid", F.col("bucket").cast("long")).toArrow()
    if not found.num_rows:
        return 1 << planes.bits
    qids, matrix = _query_matrix(queries)
    places = np.argsort(planes.order(matrix), axis=1)
    rows = np.searchsorted(qids, found.column("qid").to_numpy())
    reached = np.sort(places[rows, found.column("bucket").to_numpy()])
    return int(reached[max(1, int(np.ceil(recall * len(reached) - 1e-9))) - 1]) + 1


# --- several signature tables ---------------------------------------------------------


@dataclass(frozen=True)
class SignatureTables:
    """Several sets of hyperplanes; a vector has a bucket in the table of each.

    A neighbour is a candidate if one table has it in a probed bucket, so buckets can be small:
    the more tables and probes, the higher the recall.
    """

    dimensions: int
    tables: int = 16
    bits: int = 8
    seed: int = 7

    def planes(self) -> list[Hyperplanes]:
        return [Hyperplanes(self.dimensions, self.bits, f"{self.seed}:{i}") for i in range(self.tables)]


def signatures(vectors: DataFrame, tables: SignatureTables) -> DataFrame:
    """(table_no, bucket, id): one row for every vector (id, embedding) and table."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = tables.planes()
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column("embedding"))
                buckets = np.stack([p.buckets(matrix) for p in planes], axis=1).astype(np.int32)
                starts = np.arange(0, buckets.size + 1, len(planes), dtype=np.int32)
                lists = pa.ListArray.from_arrays(starts, buckets.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "buckets"])

    known = checked(vectors, tables.dimensions).select("id", "embedding")
    signed = known.mapInArrow(sign, "id long, buckets array<int>")
    return signed.select("id", F.posexplode("buckets").alias("table_no", "bucket")).select("table_no", "bucket", "id")


def probed(queries: DataFrame, tables: SignatureTables, probes: int) -> DataFrame:
    """(table_no, bucket, qid): the buckets that cost each query (qid, embedding) least to reach."""

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = tables.planes()
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column("embedding"))
                buckets = np.stack([p.order(matrix)[:, :probes] for p in planes], axis=1).astype(np.int32)
                n = buckets.shape[1] * buckets.shape[2]
                rows = np.broadcast_to(np.arange(len(planes), dtype=np.int32)[None, :, None], buckets.shape)
                qids = np.repeat(batch.column("qid").to_numpy(), n)
                columns = [pa.array(rows.ravel()), pa.array(buckets.ravel()), pa.array(qids, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["table_no", "bucket", "qid"])

    return queries.select("qid", "embedding").mapInArrow(order, "table_no int, bucket int, qid long")


def nearest_by_tables(
    queries: DataFrame, vectors: DataFrame, signed: DataFrame, k: int, tables: SignatureTables, probes: int
) -> DataFrame:
    """k nearest among the vectors that share a probed bucket of some table with the query.

    `signed` are the `signatures` of the vectors, kept from before; they are joined to the vectors
    by id. The queries and the buckets they probe are sent to all tasks, part by part, and the
    vectors scored where they lie: no pair of a query and a vector is written or moved but the k
    best of a task.
    """
    _check_k(k)
    queries = _known_queries(queries)
    dimensions = _dimensions(queries)
    if dimensions is None:
        return _no_hits(queries, vectors)
    code = F.col("table_no") * F.lit(1 << tables.bits) + F.col("bucket")
    codes = signed.groupBy("id").agg(F.collect_set(code).alias("codes"))
    stored = checked(vectors, dimensions).select("id", "embedding")
    coded, size = cut_counted(stored.join(codes, "id"), n=F.count("*"))
    coded = coded.repartition(max(1, -(-size["n"] // TASK_VECTORS)))
    reaching = cut(_reaching(queries, tables, probes))
    found = []
    parts = _parts(reaching, dimensions, _reach_bytes(tables))
    for part in parts:
        hits, sent = _scan_coded(part, coded, k, tables)
        if len(parts) == 1:
            return ranked(hits, k)
        found.append(cut(ranked(hits, k).drop("rank")))
        sent.destroy()
    return ranked(reduce(DataFrame.unionByName, found), k)


def _reach_bytes(tables: SignatureTables) -> int:
    return -(-(tables.tables << tables.bits) // 8)


def _reaching(queries: DataFrame, tables: SignatureTables, probes: int) -> DataFrame:
    """Queries with `reach`: a bit for every bucket of every table, set if the query probes it."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = tables.planes()
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column("embedding"))
                reach = np.packbits(np.hstack([p.probes(matrix, probes) for p in planes]), axis=1)
                yield batch.append_column("reach", pa.array([row.tobytes() for row in reach], pa.binary()))

    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(mark, f"{layout}, reach binary")


def _scan_coded(queries: DataFrame, coded: DataFrame, k: int, tables: SignatureTables) -> tuple[DataFrame, Broadcast]:
    """The k best of the vectors (id, embedding, codes) that each of the queries reaches, by task."""
    table = queries.orderBy("qid").toArrow()
    marks = np.frombuffer(b"".join(table.column("reach").to_pylist()), np.uint8)
    marks = marks.reshape(table.num_rows, _reach_bytes(tables))
    # a qid that comes again asks once, and reaches what any of its rows does
    qids, first = np.unique(table.column("qid").to_numpy(), return_index=True)
    marks = np.bitwise_or.reduceat(marks, first) if len(first) else marks
    matrix = _matrix(table.column("embedding").take(pa.array(first)))
    sent = queries.sparkSession.sparkContext.broadcast((qids, matrix, marks))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, marks = sent.value
        starts = range(0, len(qids), QUERY_BLOCK)
        blocks = [_Block(k, matrix[i : i + QUERY_BLOCK], marks[i : i + QUERY_BLOCK]) for i in starts]
        for some in _gathered(batches, VECTOR_BLOCK):
            rows = _matrix(some.column("embedding"))
            ids, codes = some.column("id").to_numpy(), _padded(some.column("codes"))
            for block in blocks:
                block.offer(ids, rows, codes)
        for start, block in zip(starts, blocks):
            yield _hits(block.best, qids[start : start + QUERY_BLOCK], False)

    return coded.mapInArrow(scan, "qid long, id long, score double"), sent


def _gathered(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= n:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Lists that are not empty as rows of one length, the last item repeated."""
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy()
    starts = np.cumsum(lengths) - lengths
    places = starts[:, None] + np.minimum(np.arange(lengths.max()), lengths[:, None] - 1)
    return column.flatten().to_numpy()[places]


class _Block:
    """Queries that are scored together, their buckets as bits, and their best rows so far.

    Products of FLOAT matrices tell which pairs may be among the best. Only those are looked up in
    the buckets and scored in DOUBLE, so that blocks of any shape give the same scores.
    """

    def __init__(self, k: int, queries: np.ndarray, marks: np.ndarray):
        self.queries, self.marks = queries, marks
        self.short = queries.astype(np.float32)
        # rounding of unit vectors to FLOAT, of their products, and of scores to SCORE_DIGITS
        self.slack = (queries.shape[1] + 4) * 2.0**-22
        self.best = Best.none(k)
        self.floor = np.full(len(queries), -np.inf, np.float32)

    def offer(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
        scores = self.short @ rows.astype(np.float32).T
        tried = np.zeros(scores.shape, bool)
        some = SEEDS * self.best.k
        unset = np.flatnonzero(np.isneginf(self.floor))
        if len(unset) and some < scores.shape[1]:
            # the highest scores come first, as they set a floor to the others
            last = scores.shape[1] - some
            tried[unset] = scores[unset] >= np.partition(scores[unset], last, axis=1)[:, [last]]
            self._take(*np.nonzero(tried), ids, rows, codes)
        # a score that is no number passes
        wanted = ~(scores < self.floor[:, None])
        self._take(*np.nonzero(wanted & ~tried), ids, rows, codes)

    def _take(self, q: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
        reached = np.zeros(len(q), bool)
        for code in codes.T:
            spot = code[v]
            reached |= (self.marks[q, spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)
        q, v = q[reached], v[reached]
        if not len(q):
            return
        steps = range(0, len(q), PAIR_BLOCK)
        scores = [np.einsum("ij,ij->i", self.queries[q[i : i + PAIR_BLOCK]], rows[v[i : i + PAIR_BLOCK]]) for i in steps]
        self.best.add(q, ids[v], np.concatenate(scores), np.full(len(q), "", "U1"))
        counts = np.bincount(self.best.q, minlength=len(self.floor))
        full = counts == self.best.k
        self.floor[full] = self.best.scores[np.cumsum(counts)[full] - 1] - self.slack
