"""Books added by ISBN, a batch of requests at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.functions import metadata
from threadshelf.operators import changes, resolve
from threadshelf.operators.catalog import searchable
from threadshelf.operators.chunks import Encoder, build_chunks, count_words, document_frequencies, word_encoder
from threadshelf.plans import vector_index
from threadshelf.plans.ids import number_rows
from threadshelf.plans.ingest import RECORD
from threadshelf.plans.lineage import cut, handed_on, job
from threadshelf.plans.settle import Rule, settle
from threadshelf.plans.skew import lookup_join
from threadshelf.schemas import SOURCES
from threadshelf.sources.tables import Store


def resolve_requests(
    requests: DataFrame,
    books: DataFrame,
    volumes: DataFrame,
    last_id: int = 0,
    live_links: DataFrame | None = None,
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Requests (position, isbn) against candidates (isbn, pos, id, volumeInfo).

    `position` is the number of a request, and different for different ISBNs.
    Gives the outcome of each request (position, isbn, book_id, match_kind) and the new
    books. A request is answered by a known book, or by the book of an earlier request,
    with the same external id, the requested ISBN, or the same title and author.
    """
    now = F.current_timestamp() if now is None else now
    asked = cut(requests.groupBy("isbn").agg(F.min("position").alias("position")))
    landed = lookup_join(volumes, asked.select("isbn"), ["isbn"], "left_semi")
    record = resolve.metadata_record(
        resolve.best_candidates(landed.withColumnRenamed("isbn", "requested_isbn"), ["requested_isbn"]),
        live_links,
    )
    found = asked.withColumnRenamed("isbn", "requested_isbn").join(record, "requested_isbn")
    named = found.withColumns(
        {
            "title": F.coalesce("title", F.lit("Unknown")),
            "author": F.coalesce(metadata.joined_authors(F.col("authors")), F.lit("Unknown")),
        }
    ).drop("authors")
    matched = cut(resolve.match_isbn_request(named, books))
    fresh = cut(matched.where(F.col("book_id").isNull()).drop("book_id", "match_kind"))
    roots = cut(_answered_by_earlier(fresh))
    kept = fresh.join(
        roots.where(F.col("position") == F.col("root")).select("position"), "position", "left_semi"
    )
    numbered = number_rows(kept.select("position", "title", "author", *RECORD), ["position"], last_id)
    made = roots.join(
        numbered.select(F.col("position").alias("root"), F.col("id").alias("new_id")), "root"
    ).select("position", "new_id", (F.col("position") == F.col("root")).alias("first"))
    settled = (
        matched.select("position", "requested_isbn", "book_id", "match_kind")
        .join(made, "position", "left")
        .select(
            F.col("requested_isbn").alias("isbn"),
            F.coalesce("book_id", "new_id").alias("book_id"),
            F.when(F.col("first") | F.col("book_id").isNotNull(), F.col("match_kind"))
            .otherwise("earlier_request")
            .alias("match_kind"),
            F.col("position").alias("first_position"),
        )
    )
    repeated = F.col("position") != F.col("first_position")
    outcome = (
        F.when(F.col("first_position").isNull(), "not_found")
        .when(repeated & (F.col("match_kind") == "new"), "earlier_request")
        .otherwise(F.col("match_kind"))
    )
    answers = lookup_join(requests.select("position", "isbn"), settled, ["isbn"]).select(
        "position", "isbn", "book_id", outcome.alias("match_kind")
    )
    return answers, changes.shaped_books(numbered, now)


def _answered_by_earlier(fresh: DataFrame) -> DataFrame:
    """(position, root): positions of new requests and of the request that makes their book.

    Like a known book, a new one answers by external id, requested ISBN, or title and author.
    """
    name = F.struct(*resolve.KEY)
    rules = [
        Rule(F.col("google_books_id"), F.col("google_books_id")),
        Rule(F.col("requested_isbn"), F.col("isbn")),
        Rule(name, name),
    ]
    return settle(resolve.with_keys(fresh), "position", rules)


@job
def ingest_isbns(
    requests: DataFrame,
    store: Store,
    volumes: DataFrame,
    load_encoder: Callable[[], Encoder] = word_encoder,
    live_links: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Add the requested books to the store, with a chunk each but no source; gives the outcomes."""
    spark = requests.sparkSession
    no_sources = spark.createDataFrame([], SOURCES)
    no_links = spark.createDataFrame([], "id long, book_id long, source_id long")
    with store.commit() as commit:
        before = commit.before
        answers, books = resolve_requests(
            requests, before.read("books"), volumes, before.last_id("books"), live_links, now
        )
        answers = handed_on(answers)
        added = commit.append("books", books)
        made = build_chunks(searchable(added), no_links, no_sources, load_encoder, before.read("weights"))
        fresh_chunks = commit.append("chunks", made)
        vector_index.extend(commit, fresh_chunks)
        if load_encoder is word_encoder:
            commit.append("frequencies", document_frequencies(count_words(fresh_chunks, ["doc_id"])))
    return answers
