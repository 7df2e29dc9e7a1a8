"""Queries over books, sources and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.functions import text
from threadshelf.plans.lineage import cut, cut_counted
from threadshelf.plans.sizes import MAX_BROADCAST_ROWS, dealt
from threadshelf.plans.skew import lookup_join, numbered_lists

NAMES_SHOWN = 10


def by_id(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is asked for."""
    return lookup_join(table, ids.select("id").distinct(), ["id"], "left_semi")


def by_key(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """For each key asked for, the row that carries it; the lowest id wins."""
    wanted = keys.select(column).where(F.col(column).isNotNull()).distinct()
    carrying = lookup_join(table, wanted, [column], "left_semi")
    return (
        carrying.groupBy(column)
        .agg(F.min_by(F.struct(*carrying.columns), "id").alias("row"))
        .select("row.*")
    )


def head(listing: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return listing
    if limit < 0:
        raise ValueError("a limit cannot be negative")
    return listing.limit(limit)


def newest_first(table: DataFrame, limit: int | None = None) -> DataFrame:
    return head(table.orderBy(F.desc("created_at"), "id"), limit)


def with_status(books: DataFrame, status: str | None = None) -> DataFrame:
    """Books of a status; without one, all that are not deleted and have a status."""
    if status:
        return books.where(F.col("status") == status)
    return books.where(F.col("status") != "deleted")


def list_books(books: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    return newest_first(with_status(books, status), limit)


def matching_text(books: DataFrame, query: str) -> DataFrame:
    """Books whose title or author contains the text, whatever its case."""
    wanted = F.lower(F.lit(query))

    def contains(column: str) -> Column:
        return F.contains(F.lower(text.or_empty(F.col(column))), wanted)

    return books.where(contains("title") | contains("author"))


def total_and_page(listing: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows up to a limit, with the total before the limit and the number left out."""
    total = listing.agg(F.count("*")).scalar()
    return newest_first(listing, limit).withColumns(
        {"total": total, "remaining": F.greatest(total - F.lit(limit), F.lit(0))}
    )


def list_sources(
    sources: DataFrame, source_type: str | None = None, limit: int | None = None
) -> DataFrame:
    sources = sources.withColumn("source_type", text.default_source_type(F.col("source_type")))
    if source_type:
        sources = sources.where(F.col("source_type") == source_type)
    return newest_first(sources, limit)


def searchable(books: DataFrame) -> DataFrame:
    """Books that have a description."""
    return books.where(text.or_empty(F.col("description")) != "")


def sources_of_books(links: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per link whose source exists: book_id, link_id, and the source's columns."""
    named = sources.withColumnRenamed("id", "source_id")
    return links.select(F.col("id").alias("link_id"), "book_id", "source_id").join(
        named, "source_id"
    )


def books_of_sources(links: DataFrame, books: DataFrame) -> DataFrame:
    """One row per link whose book exists: source_id, link_id, and the book's columns."""
    named = books.withColumnRenamed("id", "book_id")
    return links.select(F.col("id").alias("link_id"), "book_id", "source_id").join(
        named, "book_id"
    )


def source_counts(links: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Distinct sources per book, orphan links included; with books given, 0 for the unlinked."""
    counts = links.groupBy("book_id").agg(F.countDistinct("source_id").alias("n_sources"))
    if books is None:
        return counts
    every = books.select(F.col("id").alias("book_id"))
    return every.join(counts, "book_id", "left").fillna(0, ["n_sources"])


def books_per_source(links: DataFrame, books: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source with the number of links to books that still exist."""
    known = books.select(F.col("id").alias("book_id"))
    counts = (
        links.select("book_id", "source_id")
        .join(known, "book_id", "left_semi")
        .groupBy("source_id")
        .agg(F.count("*").alias("n_books"))
    )
    return (
        sources.withColumnRenamed("id", "source_id")
        .join(counts, "source_id", "left")
        .fillna(0, ["n_books"])
        .withColumn("short_title", text.ellipsis(F.col("title"), 50, 47))
    )


def source_titles(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Titles of each book's sources in link order, as rows (book_id, position, title)."""
    rows = sources_of_books(links, sources.select("id", "title"))
    return numbered_lists(rows, "book_id", "link_id", F.col("title"), "title")


def first_source_title(titles: Column) -> Column:
    return F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit(""))


def links_of(links: DataFrame, books: DataFrame) -> DataFrame:
    """Links of the given books (book_id)."""
    return lookup_join(links, books.select("book_id").distinct(), ["book_id"], "left_semi")


def book_detail(books: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Books as shown, one row each, with the number of their sources; `book_sources` lists those."""
    named = books.withColumnRenamed("id", "book_id")
    rows = sources_of_books(links_of(links, named), sources.select("id"))
    counts = rows.groupBy("book_id").agg(F.count("*").alias("n_sources"))
    return named.join(counts, "book_id", "left").select(
        "book_id",
        "title",
        text.display_author(F.col("author")).alias("author"),
        text.default_status(F.col("status")).alias("status"),
        *[
            text.present(F.col(c)).alias(c)
            for c in ("isbn", "summary", "description", "amazon_url", "cover_url")
        ],
        F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"),
        F.col("created_at").alias("added"),
        F.when(F.col("updated_at") != F.col("created_at"), F.col("updated_at")).alias("updated"),
    )


def book_sources(books: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources of the books shown, in link order: (book_id, position, title, link)."""
    named = sources.select("id", "title", "url", "external_id")
    rows = sources_of_books(links_of(links, books.select(F.col("id").alias("book_id"))), named)
    shown = F.struct(
        text.ellipsis(F.col("title"), 60, 60).alias("title"),
        text.thread_link(F.col("url"), F.col("external_id")).alias("link"),
    )
    listed = numbered_lists(rows, "book_id", "link_id", shown, "source")
    return listed.select("book_id", "position", "source.*")


def removal_preview(source_ids: DataFrame, links: DataFrame, books: DataFrame) -> DataFrame:
    """What removing each source would delete and keep, with the first names to go."""
    wanted = source_ids.select(F.col("id").alias("source_id")).distinct()
    theirs, size = cut_counted(
        lookup_join(links, wanted, ["source_id"], "left_semi").select("source_id", "book_id"), n=F.count("*")
    )
    named = books.select(F.col("id").alias("book_id"), "title", "author")
    if size["n"] > MAX_BROADCAST_ROWS:
        # too many books to send to the links: all three by book, in parts of bounded size
        rows = max(size["n"], links.count())
        theirs, named = dealt(theirs, "book_id", rows), dealt(named, "book_id", rows)
        judged_links = dealt(links.select("book_id", "source_id"), "book_id", rows)
    else:
        judged_links = links_of(links, theirs)
    # a book without a second source; sources that are NULL are none
    alone = F.coalesce(F.min("source_id") == F.max("source_id"), F.lit(True))
    name = F.concat("title", F.lit(" by "), text.display_author(F.col("author")))
    judged = cut(
        theirs.join(named, "book_id")
        .join(judged_links.groupBy("book_id").agg(alone.alias("goes")), "book_id")
        .select("source_id", "book_id", name.alias("name"), "goes")
    )
    goes = F.col("goes")
    totals = judged.groupBy("source_id").agg(
        F.count_if(goes).alias("to_delete"), F.count_if(~goes).alias("to_keep")
    )
    by_book = Window.partitionBy("source_id").orderBy("book_id")
    names = (
        judged.where(goes)
        .withColumn("place", F.row_number().over(by_book))
        .where(F.col("place") <= NAMES_SHOWN)
        .groupBy("source_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("named"))
        .select("source_id", F.transform("named", lambda x: x["name"]).alias("names"))
    )
    return (
        wanted.join(totals, "source_id", "left")
        .fillna(0, ["to_delete", "to_keep"])
        .join(names, "source_id", "left")
    )
