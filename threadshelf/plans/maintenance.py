"""Everyday changes to the tables of a store, each in one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.operators import changes
from threadshelf.operators import chunks as chunk_tables
from threadshelf.operators.catalog import searchable, with_status
from threadshelf.operators.chunks import Encoder, word_encoder
from threadshelf.plans import vector_index
from threadshelf.plans.lineage import cut, delete, handed_on, job
from threadshelf.sources.tables import LOG, Commit, Snapshot, Store


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


@job
def change_statuses(
    store: Store, requests: DataFrame, order_by: list[str], now: Column | None = None
) -> DataFrame:
    """Apply requests (book_id, status, ...); gives each with its outcome."""
    with store.commit() as commit:
        books = commit.before.read("books")
        outcomes = handed_on(changes.classify_status_changes(requests, books))
        commit.replace("books", changes.apply_status_changes(books, requests, order_by, _now(now)))
    return outcomes


@job
def change_all_statuses(store: Store, status: str, now: Column | None = None) -> int:
    """Give every book that is not deleted a status; tells how many changed."""
    with store.commit() as commit:
        books = commit.before.read("books")
        changed = changes.affected(books, changes.bulk_changes(status)).first()["affected"]
        commit.replace("books", changes.bulk_status(books, status, _now(now)))
    return changed


@job
def mark_viewed(store: Store, shown: DataFrame, now: Column | None = None) -> None:
    """New books on a result list (book_id) become viewed."""
    with store.commit() as commit:
        commit.replace("books", changes.mark_viewed(commit.before.read("books"), cut(shown), _now(now)))


@job
def upsert_chunks(store: Store, chunks: DataFrame) -> None:
    """Store chunks, in place of those with the same document."""
    with store.commit() as commit:
        before = commit.before.read("chunks")
        after = commit.replace("chunks", changes.upsert_chunks(before, chunks))
        fresh = after.join(cut(chunks.select("doc_id").distinct()), "doc_id", "left_semi")
        vector_index.upsert(commit, fresh)
        gone = before.join(fresh.select("doc_id"), "doc_id", "left_semi")
        _recount(commit, gone, fresh)


@job
def delete_books(store: Store, ids: DataFrame) -> None:
    """Delete books (id) and their chunks; links stay behind."""
    with store.commit() as commit:
        before = commit.before
        books, chunks = changes.delete_books(before.read("books"), before.read("chunks"), cut(ids))
        commit.replace("books", books)
        _drop_chunks(commit, commit.replace("chunks", chunks))


def _drop_chunks(commit: Commit, left: DataFrame) -> None:
    """The index and the frequencies without the chunks that are no longer there."""
    gone = cut(commit.before.read("chunks").join(left.select("doc_id"), "doc_id", "left_anti"))
    vector_index.drop(commit, gone)
    _recount(commit, gone, gone.limit(0))


def _recount(commit: Commit, gone: DataFrame, come: DataFrame) -> None:
    """Change the document frequencies by the chunks that went and came.

    Weights stay as they are until the next full `reindex`, as vectors made with other weights
    cannot be compared.
    """
    less = chunk_tables.document_frequencies(chunk_tables.count_words(gone, ["doc_id"]))
    more = chunk_tables.document_frequencies(chunk_tables.count_words(come, ["doc_id"]))
    commit.append("frequencies", more.unionByName(less.withColumn("documents", -F.col("documents"))))


def _catalogue(before: Snapshot) -> changes.Catalogue:
    return changes.Catalogue(*[before.read(name) for name in ("books", "sources", "links", "chunks")])


@job
def remove_sources(store: Store, ids: DataFrame) -> None:
    """Remove sources (id), their links, and the books only they mention."""
    with store.commit() as commit:
        left = changes.remove_sources(_catalogue(commit.before), cut(ids))
        for name in ("books", "sources", "links"):
            commit.replace(name, getattr(left, name))
        _drop_chunks(commit, commit.replace("chunks", left.chunks))


@job
def reindex(
    store: Store,
    load_encoder: Callable[[], Encoder] = word_encoder,
    only_changed: bool = False,
    prune: bool = False,
) -> None:
    """Build the chunks of all listed books with a description anew, and their index.

    A full run of the offline encoder also takes new weights from the texts it encodes.
    """
    with store.commit() as commit:
        now = _catalogue(commit.before)
        weights = commit.before.read("weights")
        if load_encoder is word_encoder and not only_changed:
            eligible = searchable(with_status(now.books))
            texts = chunk_tables.chunk_texts(eligible, now.links, now.sources)
            if not prune:
                # chunks that stay count too, with the vectors they have
                others = now.chunks.join(eligible.select(F.col("id").alias("book_id")), "book_id", "left_anti")
                texts = texts.select("book_id", "text").unionByName(others.select("book_id", "text"))
            counted = chunk_tables.count_words(texts, ["book_id"])
            frequencies = commit.replace("frequencies", chunk_tables.document_frequencies(counted))
            weights = commit.replace("weights", chunk_tables.inverse_frequencies(frequencies))
        rebuilt = chunk_tables.reindex(
            now.books, now.links, now.sources, now.chunks, load_encoder, only_changed, prune, weights
        )
        vector_index.rebuild(commit, commit.replace("chunks", rebuilt))


@job
def migrate(store: Store, legacy_books: DataFrame, legacy_links: DataFrame) -> None:
    """Take over books and links of the older tables."""
    with store.commit() as commit:
        before = commit.before
        commit.replace("books", changes.migrate_books(legacy_books, before.read("books")))
        commit.replace("links", changes.migrate_links(legacy_links, before.read("links")))


def tidy(store: Store, most_versions: int = 16, keep: int = 3) -> None:
    """Put tables of many appends into one version each, and delete what no longer counts.

    The last `keep` log entries and all they name stay, for readers that began before.
    """
    many = [name for name, versions in store.snapshot().versions.items() if len(versions) > most_versions]
    if many:
        with store.commit() as commit:
            for name in many:
                commit.replace(name, commit.before.read(name))
    spark = store.spark
    logs = _versions(store, "log")
    if len(logs) <= keep:
        return
    kept = sorted(logs)[-keep:]
    # one row per table and log entry
    rows = spark.read.schema(LOG).parquet(*[f"{store.path}/log/v={v}" for v in kept]).collect()
    named = {(r["name"], v) for r in rows for v in r["versions"] or []}
    for name in store.tables:
        for version in _versions(store, name):
            if version < kept[0] and (name, version) not in named:
                delete(spark, f"{store.path}/{name}/v={version}")
    for version in set(logs) - set(kept):
        delete(spark, f"{store.path}/log/v={version}")


def _versions(store: Store, name: str) -> list[int]:
    pattern = store.spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/{name}/v=*")
    found = pattern.getFileSystem(store.spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return [int(str(x.getPath().getName()).removeprefix("v=")) for x in found or []]
