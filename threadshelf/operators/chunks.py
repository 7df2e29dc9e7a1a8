"""One text chunk per book, and its vector."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadshelf.functions import text
from threadshelf.functions.vectors import normalised
from threadshelf.operators.catalog import (
    first_source_title,
    links_of,
    searchable,
    sources_of_books,
    with_status,
)
from threadshelf.operators.vectors import unit_rows
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import spread

PART_BREAK = "\n\n"

Encoder = Callable[[list[str]], np.ndarray]


def _recommendations(titles: Column) -> Column:
    return F.flatten(
        F.transform(
            titles,
            lambda t: F.array(
                F.concat(F.lit("Recommended for: "), t), F.concat(F.lit("Category: "), t)
            ),
        )
    )


def _body(title: Column, author: Column, description: Column, summary: Column) -> list[Column]:
    return [
        F.concat(title, F.lit(" by "), author),
        text.present(summary),
        text.present(description),
    ]


def chunk_text(
    title: Column, author: Column, description: Column, summary: Column, titles: Column
) -> Column:
    """Source lines, title and author, summary, description and tags; empty parts are left out."""
    titles = F.coalesce(titles, F.array().cast("array<string>"))
    tags = F.when(F.size(titles) > 0, F.concat(F.lit("Tags: "), F.array_join(titles, ", ")))
    return F.concat_ws(
        PART_BREAK, _recommendations(titles), *_body(title, author, description, summary), tags
    )


def chunk_texts(books: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """The one chunk of each book: (book_id, text, title, author, source_title).

    The text names every source of the book, so the titles of a book meet in its row.
    """
    named = books.select(
        F.col("id").alias("book_id"),
        "title",
        text.display_author(F.col("author")).alias("author"),
        "description",
        "summary",
    )
    rows = sources_of_books(links_of(links, named), sources.select("id", "title"))
    ordered = F.array_sort(F.collect_list(F.struct("link_id", "title")))
    titles = rows.groupBy("book_id").agg(F.transform(ordered, lambda x: x["title"]).alias("titles"))
    return named.join(titles, "book_id", "left").select(
        "book_id",
        chunk_text(*map(F.col, COLUMNS), F.col("titles")).alias("text"),
        "title",
        "author",
        first_source_title(F.col("titles")).alias("source_title"),
    )


COLUMNS = ("title", "author", "description", "summary")
# Fixed values of the offline encoder: letters and digits of words, and the number of places.
WORD_PATTERN = r"[a-z0-9ß-öø-ÿ]+"
WORD_DIMENSIONS = 256


def word_counts(texts: Column) -> Column:
    """The offline encoder as an expression: counts of words by the first byte of their MD5."""
    words = F.regexp_extract_all(F.lower(F.coalesce(texts, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int"))
    # sorted, equal places stand together; each count is the distance of two bounds
    ordered = F.array_sort(F.concat(places, F.sequence(F.lit(0), F.lit(WORD_DIMENSIONS - 1))))

    def counted(sorted_places: Column) -> Column:
        ends = F.filter(
            F.transform(
                sorted_places,
                lambda x, i: F.when(
                    F.coalesce(F.get(sorted_places, i + 1), F.lit(WORD_DIMENSIONS)) != x, i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda x, k: (
            x - F.coalesce(F.get(e, k - 1), F.lit(-1)) - 1).cast("double")))[0]

    return F.transform(F.array(ordered), counted)[0]


def count_words(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `counts` of the words of `text`.

    Every text is counted once: the counts come out of a generator, into which the optimizer
    moves no filter and copies no expression of their readers.
    """
    keep = keep or texts.columns
    return texts.select(*keep, F.explode(F.array(word_counts(F.col("text")))).alias("counts"))


# The place that holds the number of texts.
ALL_TEXTS = -1


def document_frequencies(counted: DataFrame) -> DataFrame:
    """(place, documents): in how many texts each place occurs, and how many texts there are."""
    found = F.filter(
        F.transform("counts", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull()
    )
    places = counted.select(F.explode(F.concat(F.array(F.lit(ALL_TEXTS)), found)).alias("place"))
    return places.groupBy("place").agg(F.count("*").alias("documents"))


def inverse_frequencies(frequencies: DataFrame) -> DataFrame:
    """(place, weight) of all places, from counts (place, documents) that may come in several rows.

    A place in d of n texts weighs ln((n + 1) / (d + 1)).
    """
    total = frequencies.groupBy("place").agg(F.sum("documents").alias("documents"))
    spark = frequencies.sparkSession
    n = F.coalesce(F.max(F.when(F.col("place") == ALL_TEXTS, F.col("documents"))), F.lit(0))
    texts = total.agg(n.alias("texts"))
    places = spark.range(WORD_DIMENSIONS).select(F.col("id").cast("int").alias("place"))
    # one row of texts, and at most as many rows as there are places
    known = places.join(F.broadcast(total), "place", "left").join(F.broadcast(texts), F.lit(True))
    weight = F.log((F.col("texts") + 1) / (F.coalesce("documents", F.lit(0)) + 1))
    return known.select("place", weight.alias("weight"))


def weigh(counted: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Counts to `embedding`, the unit vector of the weighted counts; no weights weigh 1 each."""
    keep = [c for c in counted.columns if c != "counts"]
    factors = _factors(weights)
    weighted = F.col("counts")
    if factors:
        # one number a place
        literal = F.array(*map(F.lit, factors))
        weighted = F.transform("counts", lambda n, i: n * F.get(literal, i))
    made = counted.select(*keep, weighted.alias("_weighted"))
    return made.select(*keep, normalised(F.col("_weighted")).alias("embedding"))


def _factors(weights: DataFrame | None) -> list[float]:
    if weights is None:
        return []
    rows = {row["place"]: row["weight"] for row in weights.limit(WORD_DIMENSIONS).collect()}
    return [rows.get(place, 1.0) for place in range(WORD_DIMENSIONS)] if rows else []


def word_encoder() -> Encoder:
    """The offline default as a model: counts of words hashed to a fixed number of dimensions."""
    raise TypeError("the offline encoder is an expression; `embed` computes it without a model")


def embed(
    texts: DataFrame,
    load_encoder: Callable[[], Encoder] = word_encoder,
    keep: list[str] | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Add `embedding`, the unit vector of `text`, to the kept columns (all by default).

    The offline encoder is an expression, and takes the weights (place, weight) of its places.
    Any other encodes in Arrow batches, every text once, and is loaded once per task.
    """
    keep = keep or texts.columns
    if load_encoder is word_encoder:
        return weigh(count_words(texts, keep), weights)
    schema = texts.select(*keep).schema

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder()
        for batch in batches:
            values = [value or "" for value in batch.column("_text").to_pylist()]
            if not values:
                continue
            vectors = unit_rows(np.asarray(encoder(values), np.float64))
            starts = np.arange(len(values) + 1, dtype=np.int32) * vectors.shape[1]
            flat = vectors.astype(np.float32).ravel()
            yield batch.select(keep).append_column(
                "embedding", pa.ListArray.from_arrays(starts, flat)
            )

    given = texts.select(*keep, F.col("text").alias("_text"))
    fields = [*schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    return given.mapInArrow(encode, T.StructType(fields))


def encode_chunks(
    made: DataFrame, load_encoder: Callable[[], Encoder], weights: DataFrame | None = None
) -> DataFrame:
    """Chunk texts as rows of the chunk table.

    They are written down first: the encoder then has one task per part of a file, however
    few partitions the joins before it were put together to.
    """
    metadata = F.struct("title", "author", "source_title")
    return embed(spread(cut(made)), load_encoder, weights=weights).select(
        text.chunk_key(F.col("book_id")).alias("doc_id"),
        "book_id",
        "text",
        "embedding",
        metadata.alias("metadata"),
    )


def build_chunks(
    books: DataFrame,
    links: DataFrame,
    sources: DataFrame,
    load_encoder: Callable[[], Encoder] = word_encoder,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Chunk rows for the given books."""
    return encode_chunks(chunk_texts(books, links, sources), load_encoder, weights)


def _same_text(made: DataFrame, chunks: DataFrame) -> DataFrame:
    """Books whose stored text equals the rebuilt one."""
    rebuilt = made.select("book_id", F.sha2("text", 256).alias("_hash"))
    stored = chunks.select("book_id", F.sha2("text", 256).alias("_hash"))
    return rebuilt.join(stored, ["book_id", "_hash"], "left_semi").select("book_id")


def reindex(
    books: DataFrame,
    links: DataFrame,
    sources: DataFrame,
    chunks: DataFrame,
    load_encoder: Callable[[], Encoder] = word_encoder,
    only_changed: bool = False,
    prune: bool = False,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Next chunk table: text and vector of every listed book with a description rebuilt.

    `only_changed` encodes only chunks whose text differs from the stored one; `prune`
    drops chunks of books that are no longer eligible.
    """
    eligible = searchable(with_status(books))
    made = chunk_texts(eligible, links, sources)
    written = eligible.select(F.col("id").alias("book_id"))
    if prune:
        chunks = chunks.join(written, "book_id", "left_semi")
    if only_changed:
        made = cut(made)
        same = cut(_same_text(made, chunks))
        made = made.join(same, "book_id", "left_anti")
        written = written.join(same, "book_id", "left_anti")
    rebuilt = encode_chunks(made, load_encoder, weights).select(*chunks.columns)
    return chunks.join(written, "book_id", "left_anti").unionByName(rebuilt)
