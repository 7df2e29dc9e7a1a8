"""Searches over the chunk vectors, joined back to the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.functions import text
from threadshelf.functions.vectors import similarity_label
from threadshelf.operators.catalog import links_of, sources_of_books
from threadshelf.operators.chunks import Encoder, embed, word_encoder
from threadshelf.operators.vectors import nearest, ranked
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import fits_broadcast
from threadshelf.plans.skew import numbered_lists

# Results fetched per result shown, before deleted or viewed books drop out.
FETCH_FACTOR = 3
FETCH_FACTOR_NEW_ONLY = 5
DEFAULT_LIMIT = 5
DEFAULT_LIBRARY_LIMIT = 10


def encode_queries(
    queries: DataFrame, load_encoder: Callable[[], Encoder] = word_encoder, weights: DataFrame | None = None
) -> DataFrame:
    """Query texts (qid, text) to query vectors (qid, embedding); with the weights the chunks have."""
    return embed(queries, load_encoder, keep=["qid"], weights=weights)


def chunk_vectors(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Vectors to search, as (id, kept columns, embedding), id being the book."""
    return chunks.where(F.col("embedding").isNotNull()).select(_book(chunks).alias("id"), *(keep or []), "embedding")


def _book(chunks: DataFrame) -> Column:
    if "document_id" in chunks.columns:
        return book_reference(F.col("book_id"), F.col("document_id"))
    return F.col("book_id")


def book_reference(book_id: Column, document_id: Column) -> Column:
    """The book a hit points to; older chunks carry it under another name, and 0 is none."""
    return F.coalesce(F.nullif(book_id, F.lit(0)), F.nullif(document_id, F.lit(0)))


def hits_to_catalogue(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Hits (qid, rank, id, score) with their book's columns; hits on missing books drop out.

    The few hits go to the books, not the books to the hits.
    """
    named = books.withColumn("status", text.default_status(F.col("status")))
    few = cut(hits.where(F.col("id").isNotNull()))
    found = named.join(F.broadcast(few) if fits_broadcast(few) else few, "id")
    columns = [*hits.columns, *[c for c in named.columns if c != "id"]]
    return found.select(*columns).withColumnRenamed("id", "book_id")


def _showable(new_only: bool) -> Column:
    status = text.default_status(F.col("status"))
    return status == "new" if new_only else status != "deleted"


def search(
    queries: DataFrame,
    chunks: DataFrame,
    books: DataFrame,
    limit: int = DEFAULT_LIMIT,
    new_only: bool = False,
    mode: str = "postfilter",
) -> DataFrame:
    """Best books per query: (qid, rank, score, book columns).

    `postfilter` fetches a multiple of the limit and then drops deleted (or viewed) books,
    so it may give fewer than `limit`. `prefilter` scores only books that can be shown and
    gives `limit` results whenever there are so many.
    """
    if mode == "prefilter":
        eligible = books.where(_showable(new_only)).select("id")
        return hits_to_catalogue(nearest(queries, chunk_vectors(chunks), limit, eligible), books)
    if mode != "postfilter":
        raise ValueError("mode is postfilter or prefilter")
    factor = FETCH_FACTOR_NEW_ONLY if new_only else FETCH_FACTOR
    hits = nearest(queries, chunk_vectors(chunks), limit * factor)
    shown = hits_to_catalogue(hits, books).where(_showable(new_only)).drop("rank")
    return ranked(shown.withColumnRenamed("book_id", "id"), limit).withColumnRenamed("id", "book_id")


def search_raw(queries: DataFrame, chunks: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """All fetched chunks with what the chunk itself says about them.

    A hit is a chunk: its document, its text, the book it points to, title, author and source.
    """
    known = chunks.where(F.col("embedding").isNotNull())
    vectors = known.select(_book(chunks).alias("id"), "embedding", "doc_id")
    hits = cut(nearest(queries, vectors, limit * FETCH_FACTOR))
    said = known.select(
        "doc_id",
        "text",
        *[
            F.coalesce(F.col("metadata")[name], F.lit("Unknown")).alias(name)
            for name in ("title", "author", "source_title")
        ],
    )
    found = said.join(F.broadcast(hits) if fits_broadcast(hits) else hits, "doc_id")
    return found.withColumnRenamed("id", "book_id")


def search_library(
    queries: DataFrame, chunks: DataFrame, books: DataFrame, limit: int = DEFAULT_LIBRARY_LIMIT
) -> DataFrame:
    """The nearest `limit` chunks whose book exists, whatever its status: one row per hit.

    `hit_sources` lists the sources of their books.
    """
    return hits_to_catalogue(nearest(queries, chunk_vectors(chunks), limit), books)


def hit_sources(found: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources of the books that were found, in link order: (book_id, position, title, link)."""
    named = sources.select("id", "title", "url", "external_id")
    shown = F.struct("title", text.thread_link(F.col("url"), F.col("external_id")).alias("link"))
    rows = sources_of_books(links_of(links, found), named)
    listed = numbered_lists(rows, "book_id", "link_id", shown, "source")
    return listed.select("book_id", "position", "source.*")


def search_report(found: DataFrame) -> DataFrame:
    """Results as shown to a reader, best match last, one row each; `hit_sources` has the threads."""
    described = F.coalesce(
        text.present(F.col("summary")), text.present(F.col("description")), F.lit("")
    )
    purchase = F.coalesce(
        text.present(F.col("amazon_url")),
        text.product_search_url(F.col("title"), F.col("author")),
    )
    return found.select(
        "qid",
        "rank",
        "book_id",
        "title",
        text.display_author(F.col("author")).alias("author"),
        text.present(text.first_sentence(described)).alias("blurb"),
        purchase.alias("purchase_link"),
        similarity_label(F.col("score")).alias("score"),
        "status",
    ).orderBy("qid", F.desc("rank"))


def list_lines(books: DataFrame) -> DataFrame:
    """Rows of a listing: id, title, author and status with their defaults."""
    return books.select(
        "id",
        "title",
        text.display_author(F.col("author")).alias("author"),
        text.default_status(F.col("status")).alias("status"),
    )
