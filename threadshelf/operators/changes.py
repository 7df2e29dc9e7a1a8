"""Changes to the catalogue tables: each takes the current tables and gives the next ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.functions import text
from threadshelf.plans.ids import number_rows
from threadshelf.plans.lineage import cut
from threadshelf.plans.skew import lookup_join
from threadshelf.schemas import BOOKS, LINKS, SOURCES, STATUSES


def _shaped(df: DataFrame, schema, defaults: dict[str, Column]) -> DataFrame:
    """The columns of a table: given ones, else the default, else NULL."""
    columns = []
    for field in schema:
        if field.name in df.columns:
            column = F.col(field.name)
        else:
            column = defaults.get(field.name, F.lit(None))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def new_books(batch: DataFrame, order_by: list[str], last_id: int, now: Column) -> DataFrame:
    """Rows to append to the books table: ids above `last_id`, status new, stamped `now`."""
    return shaped_books(number_rows(batch, order_by, last_id), now)


def shaped_books(numbered: DataFrame, now: Column) -> DataFrame:
    """Numbered rows in the layout of the books table, with its defaults."""
    return _shaped(
        numbered, BOOKS, {"status": F.lit("new"), "created_at": now, "updated_at": now}
    )


def new_sources(
    batch: DataFrame, sources: DataFrame, order_by: list[str], last_id: int, now: Column
) -> DataFrame:
    """Rows to append to the sources table: the first of each external id not yet known."""
    first = (
        batch.groupBy("external_id")
        .agg(F.min_by(F.struct(*batch.columns), F.struct(*order_by)).alias("row"))
        .select("row.*")
    )
    unseen = unseen_sources(first, sources)
    numbered = number_rows(unseen, [*order_by, "external_id"], last_id)
    return _shaped(numbered, SOURCES, {"source_type": F.lit("reddit"), "created_at": now})


def unseen_sources(batch: DataFrame, sources: DataFrame, force: bool = False) -> DataFrame:
    """Rows whose external id is not indexed yet; with `force`, all of them."""
    if force:
        return batch
    return batch.join(sources.select("external_id"), "external_id", "left_anti")


def new_links(pairs: DataFrame, links: DataFrame, last_id: int) -> DataFrame:
    """Rows to append to the links table: pairs of book and source not linked yet."""
    extra = [c for c in ("context_id", "score") if c in pairs.columns]
    first = pairs.groupBy("book_id", "source_id").agg(*[F.min(c).alias(c) for c in extra]) if (
        extra
    ) else pairs.select("book_id", "source_id").distinct()
    absent = first.join(
        links.select("book_id", "source_id"), ["book_id", "source_id"], "left_anti"
    )
    numbered = number_rows(absent, ["source_id", "book_id"], last_id)
    return _shaped(numbered, LINKS, {"score": F.lit(0)})


def upsert_chunks(chunks: DataFrame, batch: DataFrame, order_by: str | None = None) -> DataFrame:
    """Next chunk table: rows of the batch replace those with the same doc_id.

    With `order_by`, only the last write of each doc_id in the batch counts.
    """
    if order_by:
        last = batch.groupBy("doc_id").agg(F.max(order_by).alias(order_by))
        batch = batch.join(last, ["doc_id", order_by], "left_semi")
    written = batch.select("doc_id").distinct()
    kept = chunks.join(written, "doc_id", "left_anti")
    return kept.unionByName(batch.select(*chunks.columns))


def migrate_books(legacy: DataFrame, books: DataFrame) -> DataFrame:
    """Books with the rows of the legacy table added whose id is free and title is set."""
    renamed = legacy.withColumnsRenamed(
        {"external_id": "google_books_id", "external_url": "amazon_url"}
    )
    fitting = renamed.where(F.col("title").isNotNull() & F.col("id").isNotNull())
    added = fitting.join(books.select("id"), "id", "left_anti")
    return books.unionByName(added.select(*books.columns))


def migrate_links(legacy: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the legacy rows added that break no key; NULL contexts never clash."""
    triple = ["book_id", "source_id", "context_id"]
    renamed = legacy.withColumnRenamed("document_id", "book_id")
    complete = renamed.where(F.col("book_id").isNotNull() & F.col("source_id").isNotNull())
    free = complete.join(links.select("id"), "id", "left_anti").join(
        links.select(*triple), triple, "left_anti"
    )
    loose = free.where(F.col("context_id").isNull())
    keyed = (
        free.where(F.col("context_id").isNotNull())
        .groupBy(*triple)
        .agg(F.min_by(F.struct(*links.columns), "id").alias("row"))
        .select("row.*")
    )
    return links.unionByName(loose.select(*links.columns)).unionByName(keyed)


def classify_status_changes(changes: DataFrame, books: DataFrame) -> DataFrame:
    """Requests (book_id, status, ...) with their outcome against the table as it stands."""
    current = books.select(F.col("id").alias("book_id"), F.col("status").alias("old_status"))
    known = current.withColumn("_known", F.lit(True))
    outcome = (
        F.when(~text.or_empty(F.col("status")).isin(STATUSES), "invalid")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("old_status") == F.col("status"), "unchanged")
        .otherwise("updated")
    )
    return changes.join(known, "book_id", "left").withColumn("outcome", outcome).drop("_known")


def apply_status_changes(
    books: DataFrame, changes: DataFrame, order_by: list[str], now: Column
) -> DataFrame:
    """Books after the latest valid change to each; only rows that change are stamped."""
    latest = (
        changes.where(F.col("status").isin(STATUSES))
        .groupBy(F.col("book_id").alias("id"))
        .agg(F.max_by("status", F.struct(*order_by)).alias("_new"))
    )
    changed = F.col("_new").isNotNull() & ~F.col("status").eqNullSafe(F.col("_new"))
    return (
        books.join(latest, "id", "left")
        .withColumns(
            {
                "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
                "status": F.coalesce("_new", "status"),
            }
        )
        .select(*books.columns)
    )


def bulk_changes(status: str) -> Column:
    """True for the books a bulk change touches; deleted ones and those without status stay."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return F.coalesce((F.col("status") != "deleted") & (F.col("status") != status), F.lit(False))


def bulk_status(books: DataFrame, status: str, now: Column) -> DataFrame:
    changed = bulk_changes(status)
    return books.withColumns(
        {
            "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
            "status": F.when(changed, F.lit(status)).otherwise(F.col("status")),
        }
    )


def affected(table: DataFrame, condition: Column) -> DataFrame:
    """Number of rows a change touches."""
    return table.agg(F.count_if(condition).alias("affected"))


def mark_viewed(books: DataFrame, shown: DataFrame, now: Column) -> DataFrame:
    """Books after a result list was shown: new ones on it become viewed."""
    ids = shown.select(F.col("book_id").alias("id")).distinct().withColumn("_shown", F.lit(True))
    changed = F.col("_shown").isNotNull() & (text.default_status(F.col("status")) == "new")
    return (
        books.join(ids, "id", "left")
        .withColumns(
            {
                "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
                "status": F.when(changed, F.lit("viewed")).otherwise(F.col("status")),
            }
        )
        .select(*books.columns)
    )


def delete_books(
    books: DataFrame, chunks: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Books and chunks without the given books; their links stay behind."""
    gone = ids.select("id").distinct()
    docs = gone.select(text.chunk_key(F.col("id")).alias("doc_id"))
    return books.join(gone, "id", "left_anti"), chunks.join(docs, "doc_id", "left_anti")


def delete_links(links: DataFrame, source_ids: DataFrame) -> DataFrame:
    gone = source_ids.select(F.col("id").alias("source_id")).distinct()
    return lookup_join(links, gone, ["source_id"], "left_anti")


def delete_sources(sources: DataFrame, source_ids: DataFrame) -> DataFrame:
    return sources.join(source_ids.select("id").distinct(), "id", "left_anti")


@dataclass
class Catalogue:
    books: DataFrame
    sources: DataFrame
    links: DataFrame
    chunks: DataFrame


def remove_sources(catalogue: Catalogue, source_ids: DataFrame) -> Catalogue:
    """The catalogue without some sources, their links, and the books only they mention."""
    removed = cut(catalogue.sources.select("id").join(source_ids.select("id"), "id", "left_semi"))
    pairs = catalogue.links.select("book_id", "source_id")
    flags = removed.select(F.col("id").alias("source_id"))
    touched = cut(lookup_join(pairs, flags, ["source_id"], "left_semi").select("book_id").distinct())
    # only books of the removed sources can lose their last one
    theirs = lookup_join(pairs, touched, ["book_id"], "left_semi")
    staying = lookup_join(theirs, flags, ["source_id"], "left_anti").select("book_id").distinct()
    only_there = cut(
        touched.join(staying, "book_id", "left_anti").select(F.col("book_id").alias("id"))
    )
    books, chunks = delete_books(catalogue.books, catalogue.chunks, only_there)
    return Catalogue(
        books=books,
        sources=delete_sources(catalogue.sources, removed),
        links=delete_links(catalogue.links, removed),
        chunks=chunks,
    )
