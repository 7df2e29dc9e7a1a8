"""Changes to a store, against the same changes to plain tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from threadshelf.operators import chunks as chunk_tables
from threadshelf.operators.search import encode_queries
from threadshelf.plans import maintenance, vector_index
from threadshelf.schemas import BOOKS, CHUNKS, LINKS, SOURCES
from threadshelf.sources.tables import Store

T0 = datetime.datetime(2024, 1, 1)
NOW = datetime.datetime(2025, 1, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@pytest.fixture
def store(spark, tmp_path):
    def book(i, status):
        return (i, f"t{i}", None, f"about {i}", None, None, None, None, None, status, None, T0, T0)

    made = Store(spark, str(tmp_path))
    with made.commit() as commit:
        commit.append("books", spark.createDataFrame([book(1, "new"), book(2, "viewed"), book(3, "deleted")], BOOKS))
        sources = [(10, None, "a", "A", None, None, T0), (11, None, "b", "B", None, None, T0)]
        commit.append("sources", spark.createDataFrame(sources, SOURCES))
        links = [(1, 1, 10, None, 0), (2, 2, 10, None, 0), (3, 2, 11, None, 0)]
        commit.append("links", spark.createDataFrame(links, LINKS))
        chunks = [(f"doc_{i}", i, "old", [1.0], None) for i in (1, 2)]
        commit.append("chunks", spark.createDataFrame(chunks, CHUNKS))
    return made


def statuses(store):
    return {r.id: (r.status, r.updated_at) for r in store.read("books").collect()}


def test_statuses(store, table):
    asked = table("book_id long, status string, n int", (1, "reading", 1), (9, "new", 2), (2, "odd", 3))
    outcomes = maintenance.change_statuses(store, asked, ["n"], now())
    assert {r.book_id: r.outcome for r in outcomes.collect()} == {1: "updated", 9: "not_found", 2: "invalid"}
    assert statuses(store) == {1: ("reading", NOW), 2: ("viewed", T0), 3: ("deleted", T0)}
    assert maintenance.change_all_statuses(store, "finished", now()) == 2
    assert {i: s for i, (s, _) in statuses(store).items()} == {1: "finished", 2: "finished", 3: "deleted"}


def test_viewed_books(store, table):
    maintenance.mark_viewed(store, table("book_id long", (1,), (2,), (3,)), now())
    assert statuses(store) == {1: ("viewed", NOW), 2: ("viewed", T0), 3: ("deleted", T0)}


def test_deleted_books_and_removed_sources(store, table):
    maintenance.remove_sources(store, table("id long", (10,), (77,)))
    assert set(statuses(store)) == {2, 3}
    assert [r.id for r in store.read("links").collect()] == [3]
    assert [r.doc_id for r in store.read("chunks").collect()] == ["doc_2"]
    assert [r.id for r in store.read("sources").collect()] == [11]
    maintenance.delete_books(store, table("id long", (2,)))
    assert set(statuses(store)) == {3} and store.read("chunks").isEmpty()
    assert store.read("links").count() == 1


def test_reindex(store):
    maintenance.reindex(store)
    rows = {r.doc_id: r.text for r in store.read("chunks").collect()}
    assert set(rows) == {"doc_1", "doc_2"}
    assert rows["doc_1"] == "Recommended for: A\n\nCategory: A\n\nt1 by Unknown\n\nabout 1\n\nTags: A"


def test_migration(store, spark):
    legacy = spark.createDataFrame(
        [(1, "taken", None, None, None, None, None, None, None, "new", None, T0, T0),
         (8, "older", None, None, None, "g", None, None, "u", "new", None, T0, T0)], BOOKS
    ).withColumnsRenamed({"google_books_id": "external_id", "amazon_url": "external_url"})
    links = spark.createDataFrame([(9, 8, 11, None, 0), (1, 8, 10, None, 0)], LINKS)
    maintenance.migrate(store, legacy, links.withColumnRenamed("book_id", "document_id"))
    assert set(statuses(store)) == {1, 2, 3, 8}
    assert {r.id for r in store.read("links").collect()} == {1, 2, 3, 9}


def test_only_the_newest_log_file_counts(store, spark):
    before = store.snapshot()
    with store.commit() as commit:
        commit.append("books", before.read("books").limit(0))
    after = store.snapshot()
    assert after.version == before.version + 1 and after.last_id("books") == 3
    assert after.versions["links"] == before.versions["links"] and len(after.versions["books"]) == 2
    assert before.read("books").count() == 3


def found(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


def indexed(store):
    return sorted((r.doc_id, r.bucket, tuple(r.embedding)) for r in store.read("vectors").collect())


def rebuilt(store):
    return sorted((r.doc_id, r.bucket, tuple(r.embedding)) for r in vector_index.entries(store.read("chunks")).collect())


def test_the_index_follows_the_chunks(store, spark, table, capsys):
    maintenance.reindex(store)
    assert indexed(store) == rebuilt(store) and len(indexed(store)) == 2
    said = [(f"doc_{i}", i, f"word{i % 7} word{i % 5} and more of {i}") for i in range(2, 40)]
    texts = spark.createDataFrame(said, "doc_id string, book_id long, text string")
    fresh = chunk_tables.embed(texts, weights=store.read("weights")).withColumn("metadata", F.lit(None))
    maintenance.upsert_chunks(store, fresh.select("doc_id", "book_id", "text", "embedding", "metadata"))
    assert indexed(store) == rebuilt(store) and len(indexed(store)) == 39
    maintenance.delete_books(store, table("id long", (1,), (2,)))
    assert indexed(store) == rebuilt(store) and len(indexed(store)) == 37
    queries = encode_queries(table("qid long, text string", (1, "word3"), (2, "more of 9")), weights=store.read("weights"))
    exact = vector_index.search_index(queries, store, 5, probes=64)
    assert {r[0] for r in found(exact)} == {1, 2}
    few = vector_index.search_index(queries.where("qid = 1"), store, 5, probes=3)
    few.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    maintenance.reindex(store, prune=True)
    assert indexed(store) == rebuilt(store)


def test_frequencies_follow_the_chunks(store, table):
    def now_counted():
        counted = chunk_tables.count_words(store.read("chunks"), ["doc_id"])
        return {r.place: r.documents for r in chunk_tables.document_frequencies(counted).collect()}

    def kept():
        rows = store.read("frequencies").groupBy("place").agg(F.sum("documents").alias("n")).where("n <> 0").collect()
        return {r.place: r.n for r in rows}

    maintenance.reindex(store)
    assert kept() == now_counted()
    weights = {r.place: r.weight for r in store.read("weights").collect()}
    maintenance.delete_books(store, table("id long", (1,)))
    assert kept() == now_counted()
    # vectors made before have these weights, until all are made anew
    assert {r.place: r.weight for r in store.read("weights").collect()} == weights
    maintenance.reindex(store)
    assert {r.place: r.weight for r in store.read("weights").collect()} != weights


def test_many_versions_become_one_and_old_ones_go(store, spark, tmp_path):
    for i in range(6):
        with store.commit() as commit:
            commit.append("links", spark.createDataFrame([(10 + i, 5, i, None, 0)], LINKS))
    before = sorted(r.id for r in store.read("links").collect())
    maintenance.tidy(store, most_versions=4, keep=2)
    assert len(store.snapshot().versions["links"]) == 1
    assert sorted(r.id for r in store.read("links").collect()) == before
    maintenance.mark_viewed(store, spark.createDataFrame([(1,)], "book_id long"), now())
    maintenance.tidy(store, most_versions=4, keep=1)
    left = [p.name for p in (tmp_path / "links").iterdir()]
    assert left == [f"v={store.snapshot().versions['links'][0]}"]
    assert sorted(r.id for r in store.read("links").collect()) == before
    assert store.snapshot().last_id("links") == 15 and statuses(store)[1][0] == "viewed"


def test_a_second_writer_fails(store, spark):
    row = spark.createDataFrame([(99, 1, 1, None, 0)], LINKS)
    with pytest.raises(RuntimeError, match="another writer"):
        with store.commit() as late:
            with store.commit() as first:
                first.append("books", store.read("books").limit(0))
            late.append("links", row)
    assert 99 not in {r.id for r in store.read("links").collect()}


def test_nothing_of_a_job_stays_but_its_result(store, table, spark):
    import glob

    from threadshelf.plans.lineage import work_path

    asked = table("book_id long, status string, n int", (1, "reading", 1))
    base = work_path(spark, "x").rsplit("/", 1)[0]
    before = set(glob.glob(f"{base}/*"))
    outcomes = maintenance.change_statuses(store, asked, ["n"], now())
    left = {p.rsplit("/", 1)[-1].split("-")[0] for p in set(glob.glob(f"{base}/*")) - before}
    assert left == {"result"} and outcomes.count() == 1


def test_lookups_of_few_keys_skip_row_groups(spark, tmp_path):
    """Bloom filters of the written files: ten keys read few of the rows."""
    other = Store(spark, str(tmp_path / "large"))
    rows = spark.range(200_000).select(
        *[(F.md5(F.col("id").cast("string")) if f.name == "google_books_id" else F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in BOOKS]
    )
    with other.commit() as commit:
        commit.append("books", rows.repartition(40, "google_books_id"))
    keys = [r[0] for r in spark.range(0, 200_000, 20_000).select(F.md5(F.col("id").cast("string"))).collect()]
    hit = other.read("books").where(F.col("google_books_id").isin(keys))
    assert hit.count() == 10
    executed = hit._jdf.queryExecution().executedPlan()
    hit._jdf.collectToPython()
    scans = executed.collectLeaves()
    read = scans.apply(0).metrics().apply("numOutputRows").value()
    assert read < 200_000 / 2
