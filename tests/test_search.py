"""Vector searches against brute force."""

import hashlib
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threadshelf.functions.vectors import normalised
from threadshelf.operators import chunks, search, vectors
from threadshelf.plans import lineage
from threadshelf.plans.lineage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 16


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((400, DIMENSIONS)).astype(np.float32)
    matrix[100:140] = matrix[0]  # copies
    matrix[7] = 0
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id long, embedding array<float>"
    )
    return matrix.astype(np.float64), df.repartition(5)


def brute(matrix, query, k, allowed=None):
    lengths = np.linalg.norm(matrix, axis=1)
    dots = matrix @ (query / np.linalg.norm(query))
    scores = np.round(np.divide(dots, lengths, out=np.zeros(len(dots)), where=lengths > 0), 9)
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    return [i for i in order if allowed is None or i in allowed][:k]


def found(df):
    result = {}
    for row in df.orderBy("qid", "rank").collect():
        result.setdefault(row.qid, []).append(row.id)
    return result


@pytest.mark.parametrize("k", [1, 10, 60, 500])
def test_nearest_is_exact_and_ties_go_by_id(data, k):
    matrix, df = data
    queries = df.where("id in (0, 1, 2, 399)").withColumnRenamed("id", "qid")
    hits = found(vectors.nearest(queries, df, k))
    assert hits == {q: brute(matrix, matrix[q], k) for q in (0, 1, 2, 399)}


def test_queries_in_parts_equal_queries_at_once(data, monkeypatch):
    _, df = data
    queries = df.withColumnRenamed("id", "qid")
    whole = found(vectors.nearest(queries, df, 5))
    monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", 20_000)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 90)
    assert found(vectors.nearest(queries, df, 5)) == whole


def test_one_query_as_expression(data):
    matrix, df = data
    rows = vectors.nearest_to_one(list(matrix[5]), df, 12).collect()
    assert [r.id for r in rows] == brute(matrix, matrix[5], 12)


def test_missing_vectors_and_queries(data, table):
    _, df = data
    empty = table("qid long, embedding array<float>", (1, None))
    assert vectors.nearest(empty, df, 3).isEmpty()
    assert vectors.nearest(df.withColumnRenamed("id", "qid").limit(1), df.limit(0), 3).isEmpty()
    with pytest.raises(ValueError):
        vectors.nearest(empty, df, 0)


def test_vectors_without_id_and_of_other_lengths(table):
    query = table("qid long, embedding array<float>", (1, [1.0, 0.0]))
    stored = table("id long, embedding array<float>", (None, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None))
    assert found(vectors.nearest(query, stored, 5)) == {1: [2]}
    ragged = table("id long, embedding array<float>", (4, [1.0]), (5, [0.0, 1.0, 0.0]))
    with pytest.raises(Exception, match="vector [45] has [13] dimensions, the queries have 2"):
        vectors.nearest(query, ragged, 5).collect()
    uneven = table("qid long, embedding array<float>", (1, [1.0, 0.0]), (2, [1.0]))
    with pytest.raises(ValueError):
        vectors.nearest(uneven, stored, 5)


def test_approximate_search(data, monkeypatch):
    matrix, df = data
    planes = vectors.Hyperplanes(DIMENSIONS, bits=4)
    indexed = vectors.with_buckets(df, planes)
    queries = df.where("id < 50 and id <> 7").withColumnRenamed("id", "qid")
    exact = found(vectors.nearest(queries, df, 10))
    assert found(vectors.nearest_approximate(queries, indexed, 10, planes, 16)) == exact
    some = found(vectors.nearest_approximate(queries, indexed, 10, planes, 6))
    recall = np.mean([len(set(some[q]) & set(exact[q])) / 10 for q in exact])
    assert recall > 0.6
    monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", 2_000)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    assert found(vectors.nearest_approximate(queries, indexed, 10, planes, 6)) == some


def test_enough_probes_reach_the_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    planes = vectors.Hyperplanes(64, bits=6)
    indexed = cut(vectors.with_buckets(df, planes))
    queries = df.where("id % 50 = 0").withColumnRenamed("id", "qid")
    exact = found(vectors.nearest(queries, indexed, 10))

    def recall(probes):
        some = found(vectors.nearest_approximate(queries, indexed, 10, planes, probes))
        return np.mean([len(set(some.get(q, [])) & set(exact[q])) / 10 for q in exact])

    enough = vectors.enough_probes(queries, indexed, 10, planes)
    assert 24 < enough < 64
    assert recall(enough) >= 0.9 > recall(enough - 1)
    assert vectors.enough_probes(queries, indexed, 10, planes, recall=1.0) <= 64
    assert vectors.enough_probes(queries.limit(0), indexed, 10, planes) == 64


def test_an_index_by_bucket_is_read_in_part(spark, data, tmp_path, capsys):
    matrix, df = data
    planes = vectors.Hyperplanes(DIMENSIONS, bits=4)
    vectors.with_buckets(df, planes).write.partitionBy("bucket").parquet(str(tmp_path / "index"))
    indexed = spark.read.parquet(str(tmp_path / "index"))
    query = df.where("id = 1").withColumnRenamed("id", "qid")
    near = vectors.nearest_approximate(query, indexed, 5, planes, 3)
    assert found(near)[1][0] == 1
    near.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_normalised(table):
    rows = table("v array<float>", ([3.0, 4.0],), ([0.0, 0.0],)).select(normalised(F.col("v"))).collect()
    assert [r[0] for r in rows] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


@pytest.fixture
def library(table):
    """Vectors at growing angles from the query: book 1 is nearest."""
    places = [(i, [float(np.cos(i / 10)), float(np.sin(i / 10))]) for i in range(1, 21)]
    stored = table(
        "doc_id string, book_id long, document_id long, text string, embedding array<float>, "
        "metadata struct<title:string,author:string,source_title:string>",
        *[(f"doc_{i}", 0 if i == 4 else i, 4 if i == 4 else None, f"text {i}", v, (f"t{i}", None, None)) for i, v in places],
    )
    status = {1: "deleted", 2: None, 3: "viewed", 5: "", 6: "reading"}
    books = table(
        "id long, title string, author string, summary string, description string, amazon_url string, status string",
        *[(i, f"T{i}", "", None, f"First {i}. Second.", None, status.get(i, "new")) for i in range(1, 21) if i != 7],
    )
    query = table("qid long, embedding array<float>", (1, [1.0, 0.0]))
    return query, stored, books


def books_of(df):
    return [r.book_id for r in df.orderBy("rank").collect()]


def test_search_modes(library):
    query, stored, books = library
    plain = search.search(query, stored, books, 3)
    assert books_of(plain) == [2, 3, 4]
    assert [r.rank for r in plain.orderBy("rank").collect()] == [1, 2, 3]
    assert books_of(search.search(query, stored, books, 3, new_only=True)) == [2, 4, 5]
    assert books_of(search.search(query, stored, books, 4, mode="prefilter")) == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        search.search(query, stored, books, mode="other")


def test_postfilter_may_give_fewer_than_the_limit(library):
    query, stored, books = library
    gone = books.withColumn("status", F.when(F.col("id") < 10, "deleted").otherwise(F.col("status")))
    assert books_of(search.search(query, stored, gone, 3)) == []
    assert books_of(search.search(query, stored, gone, 3, mode="prefilter")) == [10, 11, 12]


def test_raw_and_library_search(library, table):
    query, stored, books = library
    # a second chunk of book 2, and one that points to no book
    more = stored.where("book_id IN (2, 9)").withColumns(
        {"doc_id": F.concat("doc_id", F.lit("_b")), "book_id": F.when(F.col("book_id") == 2, 2)}
    )
    raw = search.search_raw(query, stored.unionByName(more), 2).orderBy("rank").collect()
    assert [(r.book_id, r.doc_id) for r in raw] == [
        (1, "doc_1"), (2, "doc_2"), (2, "doc_2_b"), (3, "doc_3"), (4, "doc_4"), (5, "doc_5")
    ]
    assert (raw[0].title, raw[0].author, raw[0].text) == ("t1", "Unknown", "text 1")
    links = table("id long, book_id long, source_id long", (2, 1, 11), (1, 1, 10), (3, 2, 99))
    sources = table("id long, title string, url string, external_id string", (10, "A", "", "x"), (11, "B", "u", "y"))
    library_hits = search.search_library(query, stored, books, 8)
    hits = library_hits.orderBy("rank").collect()
    assert [(r.book_id, r.rank) for r in hits] == [(i, i) for i in (1, 2, 3, 4, 5, 6, 8)]
    listed = search.hit_sources(library_hits, links, sources).orderBy("position").collect()
    assert [(r.book_id, r.position, r.title) for r in listed] == [(1, 1, "A"), (1, 2, "B")]
    report = search.search_report(search.search(query, stored, books, 3)).collect()
    assert [r["rank"] for r in report] == [3, 2, 1]
    assert (report[2].blurb, report[2].author, report[2].status) == ("First 2.", "Unknown", "new")
    assert report[2].purchase_link == "https://www.amazon.com/s?k=T2"
    assert report[2].score == "0.980"


def test_chunk_text(table):
    row = table(
        "t string, a string, d string, s string, l array<string>",
        ("The Hobbit", "J.R.R. Tolkien", "", None, []),
        ("The Hobbit", "Tolkien", "Text.", "Sum", ["One", "Two"]),
        ("The Hobbit", "Tolkien", "Text.", "", None),
    )
    made = row.select(chunks.chunk_text(*[F.col(c) for c in "tadsl"])).collect()
    assert [m[0] for m in made] == [
        "The Hobbit by J.R.R. Tolkien",
        "Recommended for: One\n\nCategory: One\n\nRecommended for: Two\n\nCategory: Two\n\n"
        "The Hobbit by Tolkien\n\nSum\n\nText.\n\nTags: One, Two",
        "The Hobbit by Tolkien\n\nText.",
    ]


@pytest.fixture
def shelf(table):
    books = table(
        "id long, title string, author string, description string, summary string, status string",
        (1, "one", "A", "about dragons", None, "new"), (2, "two", None, "about ships", "ships", "viewed"),
        (3, "three", "C", "", None, "new"), (4, "four", "D", "gone", None, "deleted"), (5, "five", "E", "x", None, None),
    )
    links = table("id long, book_id long, source_id long", *[(i, 1, i) for i in range(1, 12)], (20, 2, 3))
    sources = table("id long, title string", *[(i, f"thread {i}") for i in range(1, 12)])
    return books, links, sources


def test_a_book_has_one_chunk_however_many_sources(shelf):
    books, links, sources = shelf
    rows = {r.book_id: r for r in chunks.chunk_texts(books, links, sources).collect()}
    assert len(rows) == 5 and rows[1].source_title == "thread 1"
    assert rows[1].text.endswith("Tags: " + ", ".join(f"thread {i}" for i in range(1, 12)))


def counting_encoder(texts):
    counts = np.zeros((len(texts), 8))
    for row, value in enumerate(texts):
        for word in value.split():
            counts[row, len(word) % 8] += 1
    return counts


def test_offline_encoder_counts_words(table):
    texts = table("id long, text string", (1, "a b a"), (2, ""), (3, None))
    rows = {r.id: r.embedding for r in chunks.embed(texts, keep=["id"]).collect()}
    places = {w: int(hashlib.md5(w.encode()).hexdigest()[:2], 16) for w in "ab"}
    want = np.zeros(256)
    want[places["a"]] += 2
    want[places["b"]] += 1
    assert rows[1] == pytest.approx(list(want / np.linalg.norm(want)))
    assert rows[2] == rows[3] == [0.0] * 256


def test_reindex(shelf, table):
    books, links, sources = shelf
    calls = []

    def load():
        def encode(texts):
            calls.append(len(texts))
            return counting_encoder(texts)

        return encode

    empty = table(
        "doc_id string, book_id long, text string, embedding array<float>, "
        "metadata struct<title:string,author:string,source_title:string>",
        ("doc_4", 4, "old", [1.0], None), ("doc_1", 1, "old", [1.0], None),
    )
    rebuilt = chunks.reindex(books, links, sources, empty, load)
    rows = {r.doc_id: r for r in rebuilt.collect()}
    assert sorted(rows) == ["doc_1", "doc_2", "doc_4"]
    assert rows["doc_4"].text == "old" and rows["doc_1"].text != "old"
    assert tuple(rows["doc_2"].metadata) == ("two", "Unknown", "thread 3")
    assert np.linalg.norm(rows["doc_1"].embedding) == pytest.approx(1, abs=1e-6)
    again = chunks.reindex(books, links, sources, rebuilt, load, only_changed=True, prune=True)
    assert {r.doc_id: r.text for r in again.collect()} == {d: rows[d].text for d in ("doc_1", "doc_2")}


def test_text_search_finds_the_text(table):
    texts = table("id long, text string", (1, "a tale of dragons and fire"), (2, "ships and the sea"), (3, ""))
    vectors_ = chunks.embed(texts, keep=["id"])
    queries = search.encode_queries(table("qid long, text string", (1, "sea ships"), (2, "Dragons, fire!")))
    hits = vectors.nearest(queries, vectors_, 1).collect()
    assert {(r.qid, r.id) for r in hits} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_signature_tables_reach_the_recall(spark, folder):
    """Every 50th vector against all: at least 0.9 of the ten nearest, from about half of the vectors."""
    from threadshelf.checks import vectors as bound

    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = df.where("id % 50 = 0").withColumnRenamed("id", "qid")
    signed = cut(vectors.signatures(df, bound.TABLES))
    exact = found(vectors.nearest(queries, df, 10))
    some = found(vectors.nearest_by_tables(queries, df, signed, 10, bound.TABLES, bound.PROBES))
    assert np.mean([len(set(some[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9
    met = vectors.probed(queries.select("qid", "embedding"), bound.TABLES, bound.PROBES).join(signed, ["table_no", "bucket"])
    share = met.select("qid", "id").distinct().count() / (queries.count() * df.count())
    assert share < 0.6


def test_all_buckets_of_all_tables_are_exact(data, table, monkeypatch):
    matrix, df = data
    tables = vectors.SignatureTables(DIMENSIONS, tables=3, bits=3)
    queries = df.where("id < 20").withColumnRenamed("id", "qid")
    exact = found(vectors.nearest(queries, df, 10))
    signed = cut(vectors.signatures(df, tables))
    assert signed.count() == 3 * 400
    assert found(vectors.nearest_by_tables(queries, df, signed, 10, tables, 8)) == exact
    monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", 900)
    assert found(vectors.nearest_by_tables(queries, df, signed, 10, tables, 8)) == exact
    assert vectors.nearest_by_tables(queries.limit(0), df, signed, 10, tables, 8).isEmpty()
    none = table("qid long, embedding array<float>", (1, None))
    assert vectors.nearest_by_tables(none, df, signed, 10, tables, 8).isEmpty()


def test_table_search_writes_no_pairs(data, monkeypatch):
    """Rows written grow with vectors and queries, not with the pairs that meet."""
    _, df = data
    tables = vectors.SignatureTables(DIMENSIONS, tables=3, bits=3)
    queries = df.where("id < 20").withColumnRenamed("id", "qid")
    signed = cut(vectors.signatures(df, tables))
    rows, written = [], lineage._written

    def counted(some, *given):
        rows.append(some.count())
        return written(some, *given)

    monkeypatch.setattr(lineage, "_written", counted)
    assert len(found(vectors.nearest_by_tables(queries, df, signed, 10, tables, 8))) == 20
    assert sum(rows) <= 2 * 20 + 400


@pytest.mark.parametrize("probes", [1, 3])
def test_table_search_scores_every_row_of_a_reached_id(data, spark, probes, monkeypatch):
    """Ids that come twice, with other vectors, are reached by either; blocks and tasks do not matter."""
    matrix, df = data
    tables = vectors.SignatureTables(DIMENSIONS, tables=2, bits=4)
    twice = df.unionByName(df.where("id >= 300").withColumn("id", F.col("id") - 100)).unionByName(
        spark.createDataFrame([(None, [1.0] * DIMENSIONS), (900, None)], "id long, embedding array<float>")
    )
    ids = np.concatenate([np.arange(400), np.arange(200, 300)])
    rows = np.concatenate([matrix, matrix[300:]])
    queries = df.where("id < 30").withColumnRenamed("id", "qid")
    want = {}
    unit = vectors.unit_rows(rows)
    for q in range(30):
        met = set()
        for planes in tables.planes():
            mask = planes.probes(unit[[q]], probes)[0]
            met |= set(ids[mask[planes.buckets(unit)]].tolist())
        scores = np.round(unit @ unit[q], 9)
        order = sorted((i for i in range(500) if ids[i] in met), key=lambda i: (-scores[i], ids[i]))
        want[q] = ids[order][:10].tolist()
    signed = cut(vectors.signatures(twice, tables))
    asked = queries.unionByName(queries.where("qid < 5"))
    assert found(vectors.nearest_by_tables(asked, twice, signed, 10, tables, probes)) == want
    for name, size in (("QUERY_BLOCK", 7), ("VECTOR_BLOCK", 150), ("PAIR_BLOCK", 11), ("TASK_VECTORS", 260)):
        monkeypatch.setattr(vectors, name, size)
    assert found(vectors.nearest_by_tables(asked, twice, signed, 10, tables, probes)) == want


def test_only_eligible_ids_are_scored(spark, data, monkeypatch):
    matrix, df = data
    queries = df.where("id in (1, 5)").withColumnRenamed("id", "qid")
    allowed = {i for i in range(400) if i % 3}
    eligible = spark.createDataFrame([(i,) for i in allowed] + [(None,), (5,), (10**12,)], "id long")
    want = {q: brute(matrix, matrix[q], 12, allowed) for q in (1, 5)}
    hits = vectors.nearest(queries, df, 12, eligible)
    assert found(hits) == want
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and all("embedding" not in line for line in plan.splitlines() if "Exchange" in line)
    monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", 2 * vectors.BITMAP_BYTES)
    far = spark.range(5).selectExpr("id * 40000 AS id").unionByName(eligible)
    assert found(vectors.nearest(queries, df, 12, far)) == {q: brute(matrix, matrix[q], 12, allowed | {0}) for q in (1, 5)}
    assert vectors.nearest(queries, df, 3, eligible.limit(0)).isEmpty()


def test_bitmaps_of_ids_of_any_sign(spark):
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, -32767, -40000, 2**40, -(2**40), 65536, 65537]
    held = vectors.IdSet.of(vectors._id_parts(spark.createDataFrame([(i,) for i in ids], "id long"))[0])
    near = np.array(sorted({i + d for i in ids for d in (-1, 0, 1)} - set(ids)), np.int64)
    assert held.has(np.array(ids, np.int64)).all() and not held.has(near).any()


def test_scores_are_rounded_once(data):
    matrix, df = data
    row = vectors.nearest(df.where("id = 1").withColumnRenamed("id", "qid"), df.where("id = 2"), 1).first()
    a, b = matrix[1] / np.linalg.norm(matrix[1]), matrix[2] / np.linalg.norm(matrix[2])
    assert abs(row.score - a @ b) < 1e-12 and row.score != round(row.score, 9)


def test_texts_are_encoded_once_whatever_the_readers_ask(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    embedded = chunks.embed(texts, keep=["id"])
    read = embedded.where("size(embedding) = 256 AND embedding IS NOT NULL").select("id", F.posexplode("embedding")).where("col > 0")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_weights_follow_document_frequencies(table):
    texts = table("id long, text string", (1, "a b a"), (2, "a c"), (3, "a"), (4, None))
    counted = chunks.count_words(texts, ["id"])
    frequencies = {r.place: r.documents for r in chunks.document_frequencies(counted).collect()}
    places = {w: int(hashlib.md5(w.encode()).hexdigest()[:2], 16) for w in "abc"}
    assert frequencies == {-1: 4, places["a"]: 3, places["b"]: 1, places["c"]: 1}
    weights = chunks.inverse_frequencies(chunks.document_frequencies(counted))
    by_place = {r.place: r.weight for r in weights.collect()}
    assert len(by_place) == 256
    assert by_place[places["a"]] == pytest.approx(np.log(5 / 4)) and by_place[places["b"]] == pytest.approx(np.log(5 / 2))
    rows = {r.id: r.embedding for r in chunks.weigh(counted, weights).collect()}
    want = np.zeros(256)
    want[places["a"]], want[places["b"]] = 2 * np.log(5 / 4), np.log(5 / 2)
    assert rows[1] == pytest.approx(list(want / np.linalg.norm(want)))
    # batches of frequencies add up
    part = [chunks.document_frequencies(chunks.count_words(texts.where(c), ["id"])) for c in ("id < 3", "id > 2")]
    assert {r.place: r.weight for r in chunks.inverse_frequencies(part[0].unionByName(part[1])).collect()} == by_place
    empty = chunks.inverse_frequencies(part[0].limit(0))
    assert {r.weight for r in empty.collect()} == {0.0}
    none = chunks.weigh(counted, weights.limit(0)).where("id = 1").first().embedding
    assert none == pytest.approx(chunks.embed(texts, keep=["id"]).where("id = 1").first().embedding)
