"""Catalogue queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables, query
from threadshelf.checks import bindings as b
from threadshelf.functions import text
from threadshelf.operators import catalog, search
from threadshelf.plans.colocate import bucketed
from threadshelf.plans.lineage import cut


@query(
    """SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part
       WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def lookup_by_id(t: Tables) -> DataFrame:
    returned = t.lineitem.where(F.col("l_returnflag") == "R")
    return catalog.by_id(b.part_books(t), returned.select(F.col("l_partkey").alias("id")))


@query(
    """SELECT title, min(id) AS id, arg_min(author, id) AS author
       FROM (SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part)
       WHERE title IN (SELECT p_name FROM part WHERE p_type = 'PROMO') GROUP BY title"""
)
def lookup_by_key(t: Tables) -> DataFrame:
    wanted = t.part.where(F.col("p_type") == "PROMO").select(F.col("p_name").alias("title"))
    return catalog.by_key(b.part_books(t), wanted, "title").select("title", "id", "author")


@query(
    b.ctes(b.ORDER_BOOKS)
    + "SELECT id, status, created_at FROM order_books WHERE status <> 'deleted'"
)
def list_by_status(t: Tables) -> DataFrame:
    return catalog.list_books(b.order_books(t)).select("id", "status", "created_at")


@query(
    b.ctes(b.PART_BOOKS)
    + """SELECT q AS query, id, title, author FROM part_books, (VALUES ('RING'), ('#2')) AS v(q)
         WHERE contains(lower(title), lower(q)) OR contains(lower(author), lower(q))"""
)
def filter_title_author(t: Tables) -> DataFrame:
    books = b.part_books(t)

    def matching(query: str) -> DataFrame:
        return catalog.matching_text(books, query).withColumn("query", F.lit(query))

    return matching("RING").unionByName(matching("#2"))


@query(
    """SELECT o_orderkey AS id, 'reddit' AS source_type, o_orderdate AS created_at
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"""
)
def list_sources(t: Tables) -> DataFrame:
    """Sources of some priorities have no type, and are threads by default."""
    missing = F.when(F.col("o_orderpriority") == "1-URGENT", None).when(
        F.col("o_orderpriority") == "5-LOW", ""
    )
    sources = t.orders.select(
        F.col("o_orderkey").alias("id"),
        missing.otherwise(F.col("o_orderpriority")).alias("source_type"),
        F.col("o_orderdate").alias("created_at"),
    )
    return catalog.list_sources(sources, "reddit")


@query(
    b.ctes(b.ORDER_BOOKS)
    + """SELECT id, title, created_at, (SELECT count(*) FROM order_books) AS total,
                greatest((SELECT count(*) FROM order_books) - 50, 0) AS remaining
         FROM order_books ORDER BY created_at DESC, id LIMIT 50"""
)
def total_and_page(t: Tables) -> DataFrame:
    page = catalog.total_and_page(b.order_books(t), limit=50)
    return page.select("id", "title", "created_at", "total", "remaining")


@query(
    b.ctes(b.DOCUMENT_BOOKS)
    + "SELECT id, description FROM document_books WHERE coalesce(description, '') <> ''"
)
def searchable_books(t: Tables) -> DataFrame:
    return catalog.searchable(b.document_books(t)).select("id", "description")


@query(
    b.ctes(b.DOCUMENT_BOOKS)
    + """SELECT id, title, coalesce(author, 'Unknown') AS author,
                coalesce(nullif(status, ''), 'new') AS status FROM document_books"""
)
def list_lines(t: Tables) -> DataFrame:
    return search.list_lines(b.document_books(t))


@query(
    b.ctes(b.PART_LINKS, b.SUPPLIER_SOURCES)
    + """SELECT l.book_id, l.id AS link_id, s.id AS source_id, s.title
         FROM part_links l JOIN supplier_sources s ON s.id = l.source_id"""
)
def sources_of_books(t: Tables) -> DataFrame:
    rows = catalog.sources_of_books(b.part_links(t), b.supplier_sources(t))
    return rows.select("book_id", "link_id", "source_id", "title")


# some linked books are gone: orders with status P
KEPT_ORDERS = "order_books WHERE coalesce(status, '') <> 'deleted'"


def kept_orders(t: Tables) -> DataFrame:
    return b.order_books(t).where(text.or_empty(F.col("status")) != "deleted")


@query(
    b.ctes(b.ORDER_LINKS, b.ORDER_BOOKS)
    + f"""SELECT l.source_id, l.id AS link_id, k.id AS book_id, k.title
          FROM order_links l JOIN (SELECT * FROM {KEPT_ORDERS}) k ON k.id = l.book_id"""
)
def books_of_sources(t: Tables) -> DataFrame:
    rows = catalog.books_of_sources(b.order_links(t), kept_orders(t))
    return rows.select("source_id", "link_id", "book_id", "title")


@query(
    """SELECT o_orderkey AS book_id, count(DISTINCT l_suppkey) AS n_sources
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def source_count(t: Tables) -> DataFrame:
    return catalog.source_counts(b.order_links(t), b.order_books(t))


@query(
    """SELECT o_orderkey AS book_id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'deleted' END AS status,
              count(DISTINCT l_suppkey) AS n_sources
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus"""
)
def co_located_counts(t: Tables) -> DataFrame:
    """Links and books laid out by book: counted and joined without an exchange."""
    links, books = bucketed(b.order_links(t), "book_id", 16), bucketed(b.order_books(t), "id", 16)
    counts = catalog.source_counts(links, books)
    return counts.join(books.select(F.col("id").alias("book_id"), "status"), "book_id")


@query(
    b.ctes(b.ORDER_LINKS, b.ORDER_BOOKS, b.SUPPLIER_SOURCES)
    + f"""SELECT s.id AS source_id, s.external_id, s.url, count(k.id) AS n_books,
                 CASE WHEN length(s.title) > 50 THEN left(s.title, 47) || '...' ELSE s.title END
                     AS short_title
          FROM supplier_sources s LEFT JOIN order_links l ON l.source_id = s.id
          LEFT JOIN (SELECT id FROM {KEPT_ORDERS}) k ON k.id = l.book_id
          GROUP BY s.id, s.external_id, s.url, s.title"""
)
def books_per_source(t: Tables) -> DataFrame:
    counted = catalog.books_per_source(b.order_links(t), kept_orders(t), b.supplier_sources(t))
    return counted.select("source_id", "external_id", "url", "n_books", "short_title")


@query(
    b.ctes(b.PART_LINKS, b.SUPPLIER_SOURCES)
    + """SELECT l.book_id, row_number() OVER (PARTITION BY l.book_id ORDER BY l.id, s.title) AS position,
                s.title
         FROM part_links l JOIN supplier_sources s ON s.id = l.source_id"""
)
def source_titles(t: Tables) -> DataFrame:
    return catalog.source_titles(b.part_links(t), b.supplier_sources(t))


DETAIL_BOOKS = """detail_books AS (
    SELECT p_partkey AS id, p_name AS title, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS author,
           CASE p_type WHEN 'PROMO' THEN 'reading' WHEN 'ECONOMY' THEN '' END AS status,
           CAST(p_size AS VARCHAR) AS isbn, '' AS summary, p_type AS description,
           TIMESTAMP '2024-01-01' AS created_at,
           CASE WHEN p_size > 25 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END
               AS updated_at
    FROM part)"""


def detail_books(t: Tables) -> DataFrame:
    added = F.expr("TIMESTAMP_NTZ '2024-01-01'")
    changed = F.expr("TIMESTAMP_NTZ '2024-02-01'")
    status = F.when(F.col("p_type") == "PROMO", "reading").when(F.col("p_type") == "ECONOMY", "")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("author"),
        status.alias("status"),
        F.col("p_size").cast("string").alias("isbn"),
        F.lit("").alias("summary"),
        F.col("p_type").alias("description"),
        F.lit(None).cast("string").alias("amazon_url"),
        F.lit(None).cast("string").alias("cover_url"),
        added.alias("created_at"),
        F.when(F.col("p_size") > 25, changed).otherwise(added).alias("updated_at"),
    )


@query(
    b.ctes(b.PART_LINKS, b.SUPPLIER_SOURCES, DETAIL_BOOKS)
    + """SELECT d.id AS book_id, d.title, coalesce(d.author, 'Unknown') AS author,
                coalesce(nullif(d.status, ''), 'new') AS status, d.isbn,
                nullif(d.summary, '') AS summary, d.description, count(s.id) AS n_sources,
                d.created_at AS added,
                CASE WHEN d.updated_at <> d.created_at THEN d.updated_at END AS updated
         FROM detail_books d LEFT JOIN part_links l ON l.book_id = d.id
         LEFT JOIN supplier_sources s ON s.id = l.source_id
         GROUP BY ALL"""
)
def book_detail(t: Tables) -> DataFrame:
    detail = catalog.book_detail(detail_books(t), b.part_links(t), b.supplier_sources(t))
    return detail.drop("amazon_url", "cover_url")


@query(
    b.ctes(b.PART_LINKS, b.SUPPLIER_SOURCES)
    + """SELECT l.book_id, row_number() OVER (PARTITION BY l.book_id ORDER BY l.id, s.title) AS position,
                s.title, coalesce(nullif(s.url, ''), 'https://reddit.com/comments/' || s.external_id)
                    AS link
         FROM part_links l JOIN supplier_sources s ON s.id = l.source_id
         WHERE l.book_id IN (SELECT p_partkey FROM part)"""
)
def book_detail_sources(t: Tables) -> DataFrame:
    return catalog.book_sources(detail_books(t), b.part_links(t), b.supplier_sources(t))


@query(
    b.ctes(b.ORDER_LINKS, b.ORDER_BOOKS)
    + """, counts AS (
             SELECT book_id, count(DISTINCT source_id) AS n FROM order_links GROUP BY book_id),
         judged AS (
             SELECT l.source_id, o.id, o.title || ' by Unknown' AS name, c.n <= 1 AS goes
             FROM order_links l JOIN order_books o ON o.id = l.book_id
             JOIN counts c ON c.book_id = l.book_id),
         named AS (
             SELECT source_id, id, name,
                    row_number() OVER (PARTITION BY source_id ORDER BY id) AS place
             FROM judged WHERE goes)
         SELECT s_suppkey AS source_id,
                (SELECT count(*) FROM judged j WHERE j.source_id = s_suppkey AND goes) AS to_delete,
                (SELECT count(*) FROM judged j WHERE j.source_id = s_suppkey AND NOT goes) AS to_keep,
                (SELECT string_agg(name, '; ' ORDER BY id) FROM named n
                 WHERE n.source_id = s_suppkey AND place <= 10) AS names
         FROM supplier"""
)
def removal_preview(t: Tables) -> DataFrame:
    preview = catalog.removal_preview(
        b.supplier_sources(t).select("id"), cut(b.order_links(t)), b.order_books(t)
    )
    return preview.withColumn("names", F.array_join("names", "; "))
