"""Vector searches. The queries are the mean vectors of the labels, or the benchmark texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables, query
from threadshelf.checks import bindings as b
from threadshelf.checks.changes import NOW, now
from threadshelf.checks.mentions import WEIGHTS, WORD_COUNTS, stored_chunks
from threadshelf.operators import changes, chunks, search, vectors
from threadshelf.plans import maintenance, vector_index
from threadshelf.plans.lineage import cut, work_path
from threadshelf.plans.sizes import spread
from threadshelf.sources.tables import Store


def label_means(t: Tables) -> DataFrame:
    """One query per label: the mean of its vectors."""
    mean = (
        t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    listed = F.array_sort(F.collect_list(F.struct("i", "x")))
    return mean.groupBy(F.col("label").cast("long").alias("qid")).agg(
        F.transform(listed, lambda e: e["x"]).alias("embedding")
    )


SCORED = """means AS (
    SELECT label AS qid, list(x ORDER BY i) AS v
    FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x
          FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i
                FROM embeddings) GROUP BY label, i)
    GROUP BY label),
scored AS (
    SELECT qid, vec_id AS book_id,
           list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score
    FROM embeddings, means),
hits AS (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, book_id) AS rank
    FROM scored)"""


def _rounded() -> Column:
    return F.round("score", 6).alias("score")


@query(
    "WITH " + SCORED + """
    SELECT qid, rank, book_id, round(score, 6) AS score FROM hits WHERE rank <= 10"""
)
def knn_topk(t: Tables) -> DataFrame:
    found = vectors.nearest(label_means(t), search.chunk_vectors(stored_chunks(t)), 10)
    return found.select("qid", "rank", F.col("id").alias("book_id"), _rounded())


# Tables of signatures, buckets by the first bits of MD5 values, and the buckets probed for each query.
TABLES = vectors.SignatureTables(dimensions=64, tables=16, bits=8)
PROBES = 12

# (table, vector, bucket) and (table, query, bucket) of the vectors in v and the queries in q
SIGNED = """sides AS (
        SELECT n, d, bit, CASE WHEN left(md5('{seed}' || d || ':' || bit), 1) < '8' THEN 1 ELSE -1 END AS sign
        FROM range({tables}) AS t(n), range(64) AS a(d), range({bits}) AS b(bit)),
    vector_bits AS (
        SELECT n, id, bit, sum(x * sign) > 0 AS up
        FROM (SELECT id, unnest(e) AS x, unnest(range(64)) AS d FROM v) JOIN sides USING (d) GROUP BY n, id, bit),
    buckets AS (SELECT n, id, sum(CASE WHEN up THEN 1 << bit ELSE 0 END) AS bucket FROM vector_bits GROUP BY n, id),
    margins AS (
        SELECT n, qid, bit, sum(x * sign) AS margin
        FROM (SELECT qid, unnest(e) AS x, unnest(range(64)) AS d FROM q) JOIN sides USING (d) GROUP BY n, qid, bit),
    costs AS (
        SELECT n, qid, bucket,
               sum(CASE WHEN (margin > 0) = ((bucket >> bit) & 1 = 1) THEN 0 ELSE margin * margin END) AS cost
        FROM margins, range(1 << {bits}) AS r(bucket) GROUP BY n, qid, bucket),
    probed AS (
        SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY n, qid ORDER BY cost, bucket) <= {probes}),
    met AS (SELECT DISTINCT qid, id FROM probed JOIN buckets USING (n, bucket)),
    near AS (
        SELECT qid, id, list_cosine_similarity(v.e, q.e) AS score FROM met JOIN v USING (id) JOIN q USING (qid))
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank, id AS book_id,
           round(score, 6) AS score
    FROM near QUALIFY rank <= 10"""

# unit vectors, as buckets are found from them
UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"


def every_fiftieth(t: Tables) -> DataFrame:
    """Queries: every vector whose id is divisible by 50."""
    return t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding")


@query(
    f"""WITH v AS (SELECT vec_id AS id, {UNIT} AS e FROM embeddings),
    q AS (SELECT id AS qid, e FROM v WHERE id % 50 = 0),
    """
    + SIGNED.format(seed="7:' || n || ':", tables=16, bits=8, probes=PROBES)
)
def knn_lsh(t: Tables) -> DataFrame:
    """Every 50th vector against all, through 16 tables of signatures."""
    stored = search.chunk_vectors(stored_chunks(t))
    signed = cut(vectors.signatures(stored, TABLES))
    found = vectors.nearest_by_tables(every_fiftieth(t), stored, signed, 10, TABLES, PROBES)
    return found.select("qid", "rank", F.col("id").alias("book_id"), _rounded())


@query(
    f"""WITH v AS (SELECT vec_id AS id, {UNIT} AS e FROM embeddings WHERE vec_id % 11 <> 0),
    q AS (SELECT vec_id AS qid, {UNIT} AS e FROM embeddings WHERE vec_id % 50 = 0),
    """
    + SIGNED.format(seed="7:", tables=1, bits=vector_index.BITS, probes=vector_index.PROBES)
)
def knn_index(t: Tables) -> DataFrame:
    """The index of a store after an append, an upsert and a deletion; reads the probed buckets."""
    store = Store(t.spark, work_path(t.spark, "store"))
    stored = stored_chunks(t)
    third = F.col("book_id") % 3 == 0
    with store.commit() as commit:
        vector_index.extend(commit, commit.append("chunks", stored.where(~third)))
    maintenance.upsert_chunks(store, stored.where(third | (F.col("book_id") % 7 == 0)))
    maintenance.delete_books(store, stored.where(F.col("book_id") % 11 == 0).select(F.col("book_id").alias("id")))
    found = vector_index.search_index(every_fiftieth(t), store, 10)
    return found.select("qid", "rank", F.col("id").alias("book_id"), _rounded())


@query(
    b.ctes(b.DOCUMENT_BOOKS, SCORED)
    + """SELECT qid, rank, book_id, title, coalesce(nullif(status, ''), 'new') AS status,
                round(score, 6) AS score
         FROM hits JOIN document_books d ON d.id = book_id WHERE rank <= 10"""
)
def hits_to_catalogue(t: Tables) -> DataFrame:
    hits = vectors.nearest(label_means(t), search.chunk_vectors(stored_chunks(t)), 10)
    found = search.hits_to_catalogue(hits, b.document_books(t))
    return found.select("qid", "rank", "book_id", "title", "status", _rounded())


def _search_sql(fetched: int | None, wanted: str) -> str:
    source = f"hits WHERE rank <= {fetched}" if fetched else "hits"
    return (
        b.ctes(b.DOCUMENT_BOOKS, SCORED)
        + f""", shown AS (
                SELECT qid, book_id, score, title, coalesce(status, 'new') AS status
                FROM (SELECT * FROM {source}) h JOIN document_books d ON d.id = h.book_id
                WHERE coalesce(status, 'new') {wanted}),
              ranked AS (
                SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, book_id) AS rank
                FROM shown)
              SELECT qid, rank, book_id, title, status, round(score, 6) AS score
              FROM ranked WHERE rank <= 5"""
    )


def _search(t: Tables, **options) -> DataFrame:
    return search.search(label_means(t), stored_chunks(t), b.document_books(t), **options)


@query(_search_sql(15, "<> 'deleted'"))
def search_postfilter(t: Tables) -> DataFrame:
    return _search(t).select("qid", "rank", "book_id", "title", "status", _rounded())


@query(_search_sql(25, "= 'new'"))
def search_new_only(t: Tables) -> DataFrame:
    return _search(t, new_only=True).select("qid", "rank", "book_id", "title", "status", _rounded())


@query(_search_sql(None, "<> 'deleted'"))
def search_prefilter(t: Tables) -> DataFrame:
    found = _search(t, mode="prefilter")
    return found.select("qid", "rank", "book_id", "title", "status", _rounded())


@query(
    "WITH " + SCORED + """
    , chunk AS (
        SELECT 'doc_' || vec_id AS doc_id, vec_id, vec_id AS book_id FROM embeddings WHERE vec_id % 7 <> 3
        UNION ALL SELECT 'doc_' || vec_id || '_b', vec_id, vec_id FROM embeddings WHERE vec_id % 5 = 0),
    raw AS (
        SELECT qid, c.doc_id, c.book_id, score,
               row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, c.book_id, c.doc_id) AS rank
        FROM scored s JOIN chunk c ON c.vec_id = s.book_id)
    SELECT qid, rank, doc_id, raw.book_id, 'Title ' || raw.book_id AS title, 'Unknown' AS author,
           'Label ' || label AS source_title, printf('%.3f', score) AS similarity
    FROM raw JOIN embeddings ON vec_id = raw.book_id WHERE rank <= 15"""
)
def search_raw(t: Tables) -> DataFrame:
    """Some chunks carry their book under the older name, some point to none, some books have two."""
    vec, chunk = F.col("book_id"), stored_chunks(t)
    older = F.when(vec % 2 == 0, vec)
    named = chunk.withColumns(
        {
            "document_id": F.when(vec % 7 == 3, None).otherwise(older),
            "book_id": F.when(vec % 7 == 3, None).when(vec % 2 == 0, 0).otherwise(vec),
        }
    )
    second = chunk.where(vec % 5 == 0).withColumns(
        {"document_id": F.lit(None).cast("long"), "doc_id": F.concat("doc_id", F.lit("_b"))}
    )
    found = search.search_raw(label_means(t), named.unionByName(second))
    similarity = search.similarity_label(F.col("score")).alias("similarity")
    return found.select("qid", "rank", "doc_id", "book_id", "title", "author", "source_title", similarity)


LIBRARY = b.ctes(b.DOCUMENT_BOOKS, b.PART_LINKS, b.SUPPLIER_SOURCES, SCORED)


FOUND = """found AS (
    SELECT qid, rank, book_id, d.title, round(score, 6) AS score
    FROM hits JOIN document_books d ON d.id = book_id WHERE rank <= 10)"""


def _library(t: Tables) -> DataFrame:
    return search.search_library(label_means(t), stored_chunks(t), b.document_books(t))


@query(LIBRARY + ", " + FOUND + " SELECT * FROM found")
def search_library(t: Tables) -> DataFrame:
    return _library(t).select("qid", "rank", "book_id", "title", _rounded())


@query(
    LIBRARY + ", " + FOUND
    + """ SELECT l.book_id, row_number() OVER (PARTITION BY l.book_id ORDER BY l.id, s.title) AS position,
                 s.title, coalesce(nullif(s.url, ''), 'https://reddit.com/comments/' || s.external_id)
                     AS link
          FROM part_links l JOIN supplier_sources s ON s.id = l.source_id
          WHERE l.book_id IN (SELECT book_id FROM found)"""
)
def search_library_sources(t: Tables) -> DataFrame:
    return search.hit_sources(_library(t), b.part_links(t), b.supplier_sources(t))


@query(
    LIBRARY
    + """, shown AS (
             SELECT qid, book_id, score, d.* FROM (SELECT * FROM hits WHERE rank <= 15) h
             JOIN document_books d ON d.id = h.book_id WHERE coalesce(status, 'new') <> 'deleted'),
         ranked AS (
             SELECT *, coalesce(nullif(summary, ''), nullif(description, ''), '') AS told,
                    row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, book_id) AS rank
             FROM shown)
         SELECT qid, rank, book_id, title, coalesce(author, 'Unknown') AS author,
                nullif(CASE WHEN contains(told, '. ') THEN string_split(told, '. ')[1] || '.'
                            ELSE told END, '') AS blurb,
                'https://www.amazon.com/s?k='
                    || replace(trim(title || ' ' || coalesce(author, '')), ' ', '%20')
                    AS purchase_link,
                printf('%.3f', score) AS score, coalesce(status, 'new') AS status
         FROM ranked WHERE rank <= 5"""
)
def search_report(t: Tables) -> DataFrame:
    return search.search_report(_search(t))


@query(
    b.ctes(b.DOCUMENT_BOOKS, SCORED)
    + f""", shown AS (
              SELECT qid, book_id, score,
                     row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, book_id) AS place
              FROM (SELECT * FROM hits WHERE rank <= 15) h
              JOIN document_books d ON d.id = h.book_id
              WHERE coalesce(status, 'new') <> 'deleted'),
          seen AS (SELECT DISTINCT book_id FROM shown WHERE place <= 5)
          SELECT id, CASE WHEN id IN (SELECT book_id FROM seen) AND coalesce(status, 'new') = 'new'
                          THEN 'viewed' ELSE status END AS status,
                 CASE WHEN id IN (SELECT book_id FROM seen) AND coalesce(status, 'new') = 'new'
                      THEN {NOW} END AS updated_at
          FROM document_books"""
)
def mark_viewed(t: Tables) -> DataFrame:
    books = b.document_books(t).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return changes.mark_viewed(books, _search(t), now()).select("id", "status", "updated_at")


@query(
    "WITH q0 AS (" + WORD_COUNTS.format(key="item_id", table="benchmark") + "), d0 AS ("
    + WORD_COUNTS.format(key="doc_id", table="documents") + "), weights AS " + WEIGHTS.format(counts="d0") + """,
    -- a place that is in no document
    q AS (SELECT key, i, n * coalesce(w, ln((SELECT count(*) FROM documents) + 1)) AS n FROM q0 LEFT JOIN weights USING (i)),
    d AS (SELECT key, i, n * w AS n FROM d0 JOIN weights USING (i)),
    qf AS (SELECT key, i, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS n FROM q),
    df AS (SELECT key, i, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS n FROM d),
    qn AS (SELECT key, sqrt(sum(n * n)) AS length FROM qf GROUP BY key),
    dn AS (SELECT key, sqrt(sum(n * n)) AS length FROM df GROUP BY key),
    dots AS (SELECT q.key AS qid, d.key AS id, sum(q.n * d.n) AS dot
             FROM qf q JOIN df d ON d.i = q.i GROUP BY q.key, d.key),
    every AS (SELECT item_id AS qid, doc_id AS id FROM benchmark, documents),
    scored AS (
        SELECT e.qid, e.id, coalesce(dot / (qn.length * dn.length), 0) AS score
        FROM every e LEFT JOIN dots USING (qid, id)
        LEFT JOIN qn ON qn.key = e.qid LEFT JOIN dn ON dn.key = e.id)
    SELECT qid, rank, id, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
    WHERE rank <= 10"""
)
def search_text_tf(t: Tables) -> DataFrame:
    """Benchmark texts as queries over all documents, weighted by the documents' frequencies.

    Stored vectors are FLOAT in both engines.
    """
    texts = t.benchmark.select(F.col("item_id").alias("qid"), "text")
    documents = spread(t.documents).select(F.col("doc_id").alias("id"), "text")
    counted = cut(chunks.count_words(documents, keep=["id"]))
    weights = cut(chunks.inverse_frequencies(chunks.document_frequencies(counted)))
    queries = search.encode_queries(texts, weights=weights)
    found = vectors.nearest(queries, chunks.weigh(counted, weights), 10)
    return found.select("qid", "rank", "id", _rounded())
