"""Catalogue tables read off the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables
from threadshelf.plans.sizes import dealt_scan


def part_books(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author")
    )


PART_BOOKS = "part_books AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part)"


def supplier_sources(t: Tables) -> DataFrame:
    even_url = F.concat(F.lit("https://example.com/"), F.col("s_suppkey").cast("string"))
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("external_id"),
        F.concat("s_name", F.lit(" of nation "), F.col("s_nationkey").cast("string")).alias("title"),
        F.when(F.col("s_acctbal") > 5000, even_url).otherwise("").alias("url"),
    )


SUPPLIER_SOURCES = """supplier_sources AS (
    SELECT s_suppkey AS id, s_name AS external_id,
           s_name || ' of nation ' || s_nationkey AS title,
           CASE WHEN s_acctbal > 5000 THEN 'https://example.com/' || s_suppkey ELSE '' END AS url
    FROM supplier)"""


def _pairs(lines: DataFrame, book: str) -> DataFrame:
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.groupBy(F.col(book).alias("book_id"), F.col("l_suppkey").alias("source_id")).agg(
        F.min(line).alias("id")
    )


def part_links(t: Tables) -> DataFrame:
    """Parts as books, suppliers as sources; one link per pair, numbered by its first line."""
    return _pairs(t.lineitem, "l_partkey")


PART_LINKS = """part_links AS (
    SELECT l_partkey AS book_id, l_suppkey AS source_id, min(l_orderkey * 8 + l_linenumber) AS id
    FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def order_links(t: Tables) -> DataFrame:
    """Orders as books; many have lines of a single supplier. The lines of an order are few."""
    return _pairs(dealt_scan(t.lineitem, "l_orderkey"), "l_orderkey")


ORDER_LINKS = """order_links AS (
    SELECT l_orderkey AS book_id, l_suppkey AS source_id, min(l_orderkey * 8 + l_linenumber) AS id
    FROM lineitem GROUP BY l_orderkey, l_suppkey)"""


def order_books(t: Tables) -> DataFrame:
    """Orders as books, with status and time; status F stands for none, P for deleted."""
    status = F.when(F.col("o_orderstatus") == "O", "new").when(
        F.col("o_orderstatus") == "P", "deleted"
    )
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.lit("").alias("author"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


ORDER_BOOKS = """order_books AS (
    SELECT o_orderkey AS id, o_orderpriority AS title, '' AS author,
           CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'deleted' END AS status,
           o_orderdate AS created_at, o_orderdate AS updated_at
    FROM orders)"""


def document_books(t: Tables) -> DataFrame:
    """Documents as books with text; the language stands for author and status."""
    status = (
        F.when(F.col("lang") == "en", "new")
        .when(F.col("lang") == "de", "viewed")
        .when(F.col("lang") == "es", "deleted")
    )
    # some sources have summaries, one language has no descriptions
    summary = F.when(F.col("source") < "src3", F.col("text"))
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit(" no. "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("author"),
        F.when(F.col("lang") != "es", F.col("text")).alias("description"),
        summary.alias("summary"),
        F.lit("").alias("amazon_url"),
        status.alias("status"),
    )


DOCUMENT_BOOKS = """document_books AS (
    SELECT doc_id AS id, source || ' no. ' || doc_id AS title,
           CASE WHEN lang <> 'fr' THEN lang END AS author,
           CASE WHEN lang <> 'es' THEN text END AS description,
           CASE WHEN source < 'src3' THEN text END AS summary, '' AS amazon_url,
           CASE lang WHEN 'en' THEN 'new' WHEN 'de' THEN 'viewed' WHEN 'es' THEN 'deleted' END
               AS status
    FROM documents)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
