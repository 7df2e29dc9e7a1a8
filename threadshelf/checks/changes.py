"""Change operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables, query
from threadshelf.checks import bindings as b
from threadshelf.functions.metadata import encoded_metadata
from threadshelf.operators import changes

NOW = "TIMESTAMP '2025-01-01 00:00:00'"


def now():
    return F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")


@query(
    f"""SELECT (SELECT max(c_custkey) FROM customer)
               + row_number() OVER (ORDER BY p_name, p_partkey) AS id,
               p_name AS title, p_brand AS author, 'new' AS status,
               '{{"size":' || p_size || ',"type":' || CASE WHEN p_type = 'PROMO' THEN 'null'
                   ELSE '"' || p_type || '"' END || '}}' AS metadata, {NOW} AS created_at
        FROM part"""
)
def append_books(t: Tables) -> DataFrame:
    batch = t.part.select(
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        encoded_metadata(
            size=F.col("p_size"), type=F.when(F.col("p_type") != "PROMO", F.col("p_type"))
        ).alias("metadata"),
        "p_partkey",
    )
    used = t.customer.agg(F.max("c_custkey")).first()[0]
    added = changes.new_books(batch, ["title", "p_partkey"], used, now())
    return added.select("id", "title", "author", "status", "metadata", "created_at")


PAGE_SOURCES = """pages_in AS (
    SELECT page_id, url, regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1) AS external_id FROM pages),
known AS (
    SELECT external_id, min(page_id) AS id FROM pages_in WHERE starts_with(url, 'https')
    GROUP BY external_id)"""


def page_sources(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All pages as a batch of sources, and those served by https as the known ones."""
    batch = t.pages.select(
        "page_id", F.col("url").alias("title"), "url",
        F.regexp_extract("url", "/([a-z]{2}/[0-9]+)", 1).alias("external_id"),
    )
    secure = batch.where(F.startswith("url", F.lit("https")))
    return batch, secure.groupBy("external_id").agg(F.min("page_id").alias("id"))


@query(
    b.ctes(PAGE_SOURCES)
    + """, fresh AS (
             SELECT external_id, min(page_id) AS page_id, arg_min(url, page_id) AS title
             FROM pages_in WHERE external_id NOT IN (SELECT external_id FROM known)
             GROUP BY external_id)
         SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY page_id) AS id,
                external_id, title, 'reddit' AS source_type FROM fresh"""
)
def upsert_sources(t: Tables) -> DataFrame:
    batch, known = page_sources(t)
    used = known.agg(F.max("id")).first()[0]
    added = changes.new_sources(batch, known, ["page_id"], used, now())
    return added.select("id", "external_id", "title", "source_type")


@query(
    b.ctes(PAGE_SOURCES)
    + """SELECT page_id, external_id FROM pages_in
         WHERE external_id NOT IN (SELECT external_id FROM known)"""
)
def new_sources_only(t: Tables) -> DataFrame:
    batch, known = page_sources(t)
    return changes.unseen_sources(batch, known).select("page_id", "external_id")


@query(
    """WITH pairs AS (SELECT DISTINCT l_partkey AS book_id, l_suppkey AS source_id FROM lineitem),
       known AS (SELECT DISTINCT l_partkey AS book_id, l_suppkey AS source_id FROM lineitem
                 WHERE l_returnflag = 'R')
       SELECT row_number() OVER (ORDER BY source_id, book_id) AS id, book_id, source_id, 0 AS score
       FROM (SELECT * FROM pairs EXCEPT SELECT * FROM known)"""
)
def link_if_absent(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(
        F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("source_id"), "l_returnflag"
    )
    known = pairs.where(F.col("l_returnflag") == "R").drop("l_returnflag").distinct()
    added = changes.new_links(pairs.drop("l_returnflag"), known, 0)
    return added.select("id", "book_id", "source_id", "score")


@query(
    """SELECT 'doc_' || vec_id AS doc_id, vec_id AS book_id,
              CASE WHEN label < 3 THEN 'second write' ELSE 'stored' END AS text
       FROM embeddings"""
)
def upsert_chunks(t: Tables) -> DataFrame:
    stored = t.embeddings.select(
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("doc_id"),
        F.col("vec_id").alias("book_id"),
        F.lit("stored").alias("text"),
        "label",
    )
    write = stored.where(F.col("label") < 3)
    batch = write.withColumns({"text": F.lit("first write"), "turn": F.lit(1)}).unionByName(
        write.withColumns({"text": F.lit("second write"), "turn": F.lit(2)})
    )
    return changes.upsert_chunks(stored.drop("label"), batch, "turn")


@query(
    """SELECT doc_id AS id, source AS title, 'g' || n_chars AS google_books_id, 'known' AS origin
       FROM documents WHERE lang = 'de'
       UNION ALL
       SELECT doc_id, lang || ' ' || source, 'g' || n_chars, 'legacy'
       FROM documents WHERE lang IN ('en', 'fr')"""
)
def migrate_legacy(t: Tables) -> DataFrame:
    known = t.documents.where(F.col("lang") == "de")
    external = F.concat(F.lit("g"), F.col("n_chars").cast("string"))
    books = known.select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"),
        external.alias("google_books_id"), F.lit("known").alias("origin"),
    )
    title = F.when(F.col("lang") != "es", F.concat("lang", F.lit(" "), "source"))
    legacy = t.documents.select(
        F.col("doc_id").alias("id"), title.alias("title"), external.alias("external_id"),
        F.lit("legacy").alias("origin"),
    )
    return changes.migrate_books(legacy, books)


LEGACY_LINKS = """legacy AS (
    SELECT event_id AS id, user_id AS document_id, CAST(floor(value) AS BIGINT) AS source_id,
           CASE event_type WHEN 'click' THEN NULL ELSE event_type END AS context_id
    FROM events),
known AS (SELECT * FROM legacy WHERE context_id = 'view')"""


@query(
    b.ctes(LEGACY_LINKS)
    + """, free AS (
             SELECT * FROM legacy l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = l.id)
             AND NOT EXISTS (SELECT 1 FROM known k WHERE k.document_id = l.document_id
                             AND k.source_id = l.source_id AND k.context_id = l.context_id))
         SELECT id, document_id AS book_id, source_id, context_id FROM known
         UNION ALL SELECT id, document_id, source_id, context_id FROM free WHERE context_id IS NULL
         UNION ALL SELECT min(id), document_id, source_id, context_id FROM free
         WHERE context_id IS NOT NULL GROUP BY document_id, source_id, context_id"""
)
def migrate_legacy_links(t: Tables) -> DataFrame:
    legacy = t.events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("document_id"),
        F.floor("value").cast("long").alias("source_id"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("context_id"),
    )
    known = legacy.where(F.col("context_id") == "view").withColumnRenamed("document_id", "book_id")
    return changes.migrate_links(legacy, known)


# Event types read as status requests; an error asks for a status that does not exist.
REQUESTS = """requests AS (
    SELECT event_id, ts, user_id AS book_id,
           CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'viewed'
               WHEN 'click' THEN 'interested' WHEN 'purchase' THEN 'finished'
               ELSE 'broken' END AS status
    FROM events),
shelf AS (
    SELECT s_suppkey AS id,
           CASE WHEN s_acctbal > 6000 THEN 'new' WHEN s_acctbal > 2000 THEN 'finished' END AS status,
           TIMESTAMP '2024-01-01' AS updated_at
    FROM supplier)"""


def requests(t: Tables) -> DataFrame:
    status = F.coalesce(
        *[
            F.when(F.col("event_type") == kind, status)
            for kind, status in (
                ("signup", "new"), ("view", "viewed"), ("click", "interested"), ("purchase", "finished")
            )
        ],
        F.lit("broken"),
    )
    return t.events.select("event_id", "ts", F.col("user_id").alias("book_id"), status.alias("status"))


def shelf(t: Tables) -> DataFrame:
    balance = F.col("s_acctbal")
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.when(balance > 6000, "new").when(balance > 2000, "finished").alias("status"),
        F.expr("TIMESTAMP_NTZ '2024-01-01'").alias("updated_at"),
    )


@query(
    b.ctes(REQUESTS)
    + """SELECT r.event_id, r.book_id, r.status, s.status AS old_status,
                CASE WHEN r.status = 'broken' THEN 'invalid' WHEN s.id IS NULL THEN 'not_found'
                     WHEN s.status = r.status THEN 'unchanged' ELSE 'updated' END AS outcome
         FROM requests r LEFT JOIN shelf s ON s.id = r.book_id"""
)
def classify_status_changes(t: Tables) -> DataFrame:
    judged = changes.classify_status_changes(requests(t), shelf(t))
    return judged.select("event_id", "book_id", "status", "old_status", "outcome")


@query(
    b.ctes(REQUESTS)
    + f""", latest AS (
             SELECT book_id, arg_max(status, (ts, event_id)) AS status FROM requests
             WHERE status <> 'broken' GROUP BY book_id)
         SELECT s.id, coalesce(l.status, s.status) AS status,
                CASE WHEN l.status IS NOT NULL AND l.status IS DISTINCT FROM s.status THEN {NOW}
                     ELSE s.updated_at END AS updated_at
         FROM shelf s LEFT JOIN latest l ON l.book_id = s.id"""
)
def apply_status_changes(t: Tables) -> DataFrame:
    return changes.apply_status_changes(shelf(t), requests(t), ["ts", "event_id"], now())


@query(
    b.ctes(b.ORDER_BOOKS)
    + f"""SELECT id, CASE WHEN status NOT IN ('deleted', 'reading') THEN 'reading' ELSE status END
                     AS status,
                 CASE WHEN status NOT IN ('deleted', 'reading') THEN {NOW} ELSE updated_at END
                     AS updated_at
          FROM order_books"""
)
def bulk_status(t: Tables) -> DataFrame:
    return changes.bulk_status(b.order_books(t), "reading", now()).select("id", "status", "updated_at")


@query(
    b.ctes(b.ORDER_BOOKS)
    + "SELECT count(*) AS affected FROM order_books WHERE status NOT IN ('deleted', 'reading')"
)
def bulk_status_count(t: Tables) -> DataFrame:
    return changes.affected(b.order_books(t), changes.bulk_changes("reading"))


@query(
    """SELECT 'book' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_type <> 'PROMO'
       UNION ALL
       SELECT 'chunk', 'doc_' || vec_id FROM embeddings
       WHERE vec_id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')"""
)
def delete_books(t: Tables) -> DataFrame:
    gone = t.part.where(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("id"))
    chunks = t.embeddings.select(
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("doc_id")
    )
    books, chunks = changes.delete_books(b.part_books(t), chunks, gone)
    return books.select(F.lit("book").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(
        chunks.select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"))
    )


REMOVED = """removed AS (
    SELECT s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey
    JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('AFRICA', 'ASIA'))"""


def removed(t: Tables) -> DataFrame:
    away = t.region.where(F.col("r_name").isin("AFRICA", "ASIA"))
    nations = t.nation.join(away, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return t.supplier.join(
        nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select(F.col("s_suppkey").alias("id"))


@query(
    b.ctes(b.ORDER_LINKS, b.ORDER_BOOKS, b.SUPPLIER_SOURCES, REMOVED)
    + """, doomed AS (
             SELECT book_id AS id FROM order_links GROUP BY book_id
             HAVING bool_and(source_id IN (SELECT id FROM removed)))
         SELECT 'book' AS kind, CAST(id AS VARCHAR) AS id FROM order_books
         WHERE id NOT IN (SELECT id FROM doomed)
         UNION ALL SELECT 'source', CAST(id AS VARCHAR) FROM supplier_sources
         WHERE id NOT IN (SELECT id FROM removed)
         UNION ALL SELECT 'link', book_id || '-' || source_id FROM order_links
         WHERE source_id NOT IN (SELECT id FROM removed)
         UNION ALL SELECT 'chunk', 'doc_' || vec_id FROM embeddings
         WHERE vec_id NOT IN (SELECT id FROM doomed)"""
)
def remove_source_cascade(t: Tables) -> DataFrame:
    chunks = t.embeddings.select(
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("doc_id")
    )
    whole = changes.Catalogue(b.order_books(t), b.supplier_sources(t), b.order_links(t), chunks)
    left = changes.remove_sources(whole, removed(t))

    def tagged(table: DataFrame, kind: str, column) -> DataFrame:
        return table.select(F.lit(kind).alias("kind"), column.cast("string").alias("id"))

    link = F.concat_ws("-", F.col("book_id").cast("string"), F.col("source_id").cast("string"))
    return (
        tagged(left.books, "book", F.col("id"))
        .unionByName(tagged(left.sources, "source", F.col("id")))
        .unionByName(tagged(left.links, "link", link))
        .unionByName(tagged(left.chunks, "chunk", F.col("doc_id")))
    )


@query(
    b.ctes(b.PART_LINKS, REMOVED)
    + """SELECT book_id, source_id, id FROM part_links
         WHERE source_id NOT IN (SELECT id FROM removed)"""
)
def delete_links(t: Tables) -> DataFrame:
    return changes.delete_links(b.part_links(t), removed(t)).select("book_id", "source_id", "id")


@query(
    b.ctes(b.PART_LINKS, REMOVED)
    + """SELECT count(*) AS affected FROM part_links
         WHERE source_id IN (SELECT id FROM removed)"""
)
def delete_links_count(t: Tables) -> DataFrame:
    links = b.part_links(t)
    gone = removed(t).select(F.col("id").alias("source_id"))
    return changes.affected(links.join(gone, "source_id", "left_semi"), F.lit(True))
