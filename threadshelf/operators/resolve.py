"""Matching mentions to books and to bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.functions import metadata, text
from threadshelf.plans.lineage import cut
from threadshelf.plans.skew import lookup_join


KEY = ["title_key", "author_key"]


def title_key(column: str = "title") -> Column:
    return text.ascii_fold(F.col(column))


def author_key(column: str = "author") -> Column:
    """Empty and missing authors are the same: no author given."""
    return text.or_empty(text.ascii_fold(F.col(column)))


def with_keys(mentions: DataFrame) -> DataFrame:
    return mentions.withColumns({"title_key": title_key(), "author_key": author_key()})


def match_titles(keys: DataFrame, books: DataFrame, name: str = "book_id") -> DataFrame:
    """Add the lowest id of the books with the same title and author.

    Where `author_key` is empty the title alone decides: every book is also entered under
    its title with an empty author, so that one equi-join answers both. Only books with a key
    that is asked for are grouped.
    """
    entries = books.select(
        "id",
        title_key().alias("title_key"),
        F.explode(F.array_distinct(F.array(author_key(), F.lit("")))).alias("author_key"),
    )
    asked = lookup_join(entries, keys.select(*KEY).distinct(), KEY, "left_semi")
    lowest = asked.groupBy(*KEY).agg(F.min("id").alias(name))
    return lookup_join(keys, lowest, KEY)


def resolve_mentions(mentions: DataFrame, books: DataFrame) -> DataFrame:
    """Mentions (title, author, ...) with the `book_id` they mean, or NULL."""
    return match_titles(with_keys(mentions), books).drop(*KEY)


def match_column(rows: DataFrame, books: DataFrame, column: str, name: str) -> DataFrame:
    """Add the lowest id of the books that carry the same value in a column."""
    wanted = rows.select(column).where(F.col(column).isNotNull()).distinct()
    asked = lookup_join(books.select(column, "id"), wanted, [column], "left_semi")
    lowest = asked.groupBy(column).agg(F.min("id").alias(name))
    return lookup_join(rows, lowest, [column])


def match_external(rows: DataFrame, books: DataFrame, order_by: list[str]) -> DataFrame:
    """Enriched rows by external catalogue id: the known `book_id`, or the batch's first row.

    `is_first` marks, among rows without a known book, the one that becomes the new book
    of its external id; `first_order` is that row's order, for all rows of the group.
    """
    matched = match_column(rows, books, "google_books_id", "book_id")
    order = F.struct(*order_by)
    firsts = (
        rows.where(F.col("google_books_id").isNotNull())
        .groupBy("google_books_id")
        .agg(F.min(order).alias("first_order"))
    )
    grouped = lookup_join(matched, firsts, ["google_books_id"])
    is_first = F.col("book_id").isNull() & (
        F.col("google_books_id").isNull() | (F.col("first_order") == order)
    )
    return grouped.withColumn("is_first", is_first)


def match_isbn_request(requests: DataFrame, books: DataFrame) -> DataFrame:
    """Requests (requested_isbn, google_books_id, title, author, ...) with the book they mean.

    The external catalogue id comes first, then the requested ISBN, then title and
    author; `match_kind` tells which one decided.
    """
    columns = requests.columns
    matched = match_column(requests, books, "google_books_id", "_by_external")
    by_isbn = books.withColumnRenamed("isbn", "requested_isbn")
    matched = match_column(matched, by_isbn, "requested_isbn", "_by_isbn")
    matched = match_titles(with_keys(matched), books, "_by_title")
    return matched.select(
        *columns,
        F.coalesce("_by_external", "_by_isbn", "_by_title").alias("book_id"),
        F.when(F.col("_by_external").isNotNull(), "external_id")
        .when(F.col("_by_isbn").isNotNull(), "isbn")
        .when(F.col("_by_title").isNotNull(), "title_author")
        .otherwise("new")
        .alias("match_kind"),
    )


def best_candidates(candidates: DataFrame, query: list[str]) -> DataFrame:
    """Of each query's candidates the English one with the longest description.

    The earlier of equals wins, also when none has a description; a missing language
    counts as English.
    """
    info = F.col("volumeInfo")
    english = candidates.where(F.coalesce(info["language"], F.lit("en")) == "en")
    length = F.char_length(text.or_empty(info["description"]))
    return english.groupBy(*query).agg(
        F.max_by(F.struct("id", "volumeInfo"), F.struct(length, -F.col("pos"))).alias("volume")
    )


def metadata_record(best: DataFrame, live_links: DataFrame | None = None) -> DataFrame:
    """The fields kept of the chosen candidate.

    `live_links` (isbn) lists the product pages known to exist; without it every purchase
    link is a search.
    """
    others = [c for c in best.columns if c != "volume"]
    info = F.col("volume.volumeInfo")
    isbn10 = metadata.identifier(info["industryIdentifiers"], "ISBN_10")
    record = best.withColumn("_isbn10", isbn10)
    if live_links is None:
        record = record.withColumn("_live", F.lit(None).cast("boolean"))
    else:
        alive = live_links.select(F.col("isbn").alias("_isbn10")).distinct()
        record = lookup_join(record, alive.withColumn("_live", F.lit(True)), ["_isbn10"])
    return record.select(
        *others,
        F.col("volume.id").alias("google_books_id"),
        info["title"].alias("title"),
        info["authors"].alias("authors"),
        info["description"].alias("description"),
        metadata.preferred_isbn(info["industryIdentifiers"]).alias("isbn"),
        info["imageLinks"]["thumbnail"].alias("cover_url"),
        metadata.purchase_url(
            info["title"], info["authors"], F.col("_isbn10"), F.col("_live")
        ).alias("amazon_url"),
    )


def enrich(keys: DataFrame, volumes: DataFrame) -> DataFrame:
    """Add `volume`, the best candidate of each (title_key, author_key), or NULL.

    The keys are distinct. `volumes` has the candidates of landed queries under
    (title_key, author_key); a query by title alone has an empty author_key. The query with
    the author is tried first, the one by title alone where that gave nothing.
    """
    asked = keys.select("title_key").distinct()
    landed = lookup_join(volumes, asked, ["title_key"], "left_semi")
    best = cut(best_candidates(landed, KEY))
    tried = keys.join(best, KEY, "left")
    by_title = best.where(F.col("author_key") == "").select("title_key", "volume")
    retried = lookup_join(
        tried.where(F.col("volume").isNull() & (F.col("author_key") != "")).drop("volume"),
        by_title,
        ["title_key"],
        wide=True,
    )
    settled = tried.where(F.col("volume").isNotNull() | (F.col("author_key") == ""))
    return settled.unionByName(retried)
