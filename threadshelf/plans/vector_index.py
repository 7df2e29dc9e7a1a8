"""The bucketed vectors of a store, which change in the same commit as its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.operators.search import chunk_vectors
from threadshelf.operators.vectors import Hyperplanes, nearest_approximate, with_buckets
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import fits_broadcast
from threadshelf.sources.tables import Commit, Store

# 64 buckets; the share of them that a search probes decides its recall.
BITS = 6
PROBES = 56


def planes(dimensions: int) -> Hyperplanes:
    return Hyperplanes(dimensions, BITS)


def entries(chunks: DataFrame) -> DataFrame:
    """Index rows (id, doc_id, embedding, bucket) of chunks; the length of the first vector counts."""
    known = chunks.where(F.col("embedding").isNotNull())
    first = known.select(F.size("embedding").alias("n")).first()
    vectors = chunk_vectors(known, ["doc_id"])
    if first is None:
        return vectors.withColumn("bucket", F.lit(0)).limit(0)
    return with_buckets(vectors, planes(first["n"]))


def extend(commit: Commit, chunks: DataFrame) -> None:
    """Index chunks that are added."""
    commit.append("vectors", entries(chunks))


def upsert(commit: Commit, chunks: DataFrame) -> None:
    """Index chunks that are new or take the place of others."""
    gone = cut(chunks.select("doc_id").distinct())
    commit.replace("vectors", _without(commit, gone).unionByName(entries(chunks)))


def drop(commit: Commit, doc_ids: DataFrame) -> None:
    """Take chunks (doc_id) out of the index."""
    commit.replace("vectors", _without(commit, cut(doc_ids.select("doc_id").distinct())))


def rebuild(commit: Commit, chunks: DataFrame) -> None:
    commit.replace("vectors", entries(chunks))


def _without(commit: Commit, gone: DataFrame) -> DataFrame:
    kept = commit.before.read("vectors")
    return kept.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "doc_id", "left_anti").select(kept.columns)


def search_index(queries: DataFrame, store: Store, k: int, probes: int = PROBES) -> DataFrame:
    """Approximate k nearest chunks of the store; reads the probed buckets only."""
    indexed = store.read("vectors")
    first = queries.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).first()
    dimensions = first["n"] if first else 1
    return nearest_approximate(queries, indexed, k, planes(dimensions), probes)
