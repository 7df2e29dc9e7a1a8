"""Matching mentions to books and bibliographic records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables, query
from threadshelf.checks import bindings as b
from threadshelf.checks.changes import now
from threadshelf.functions import text
from threadshelf.operators import resolve
from threadshelf.plans.ingest import resolve_batch as resolve_mention_batch
from threadshelf.plans.isbn import resolve_requests
from threadshelf.plans.sizes import spread


@query(
    b.ctes(b.PART_BOOKS)
    + """, said AS (
             SELECT p_partkey AS mention, upper(p_name) AS title,
                    CASE p_type WHEN 'PROMO' THEN '' WHEN 'ECONOMY' THEN NULL
                                ELSE upper(p_brand) END AS author
             FROM part),
         told AS (SELECT lower(title) AS t, lower(author) AS a, min(id) AS id FROM part_books
                  GROUP BY ALL),
         alone AS (SELECT lower(title) AS t, min(id) AS id FROM part_books GROUP BY ALL)
         SELECT mention, title, author,
                CASE WHEN coalesce(author, '') <> '' THEN told.id ELSE alone.id END AS book_id
         FROM said LEFT JOIN told ON told.t = lower(title) AND told.a = lower(author)
         LEFT JOIN alone ON alone.t = lower(title)"""
)
def resolve_mentions(t: Tables) -> DataFrame:
    author = F.when(F.col("p_type") == "PROMO", "").when(
        F.col("p_type") != "ECONOMY", F.upper("p_brand")
    )
    said = t.part.select(
        F.col("p_partkey").alias("mention"), F.upper("p_name").alias("title"), author.alias("author")
    )
    return resolve.resolve_mentions(said, b.part_books(t))


@query(
    """WITH known AS (SELECT c_custkey AS id, 'c' || c_custkey AS google_books_id FROM customer
                      WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
       said AS (SELECT o_orderkey, 'c' || o_custkey AS google_books_id,
                       min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_order
                FROM orders)
       SELECT o_orderkey, google_books_id, id AS book_id,
              id IS NULL AND o_orderkey = first_order AS is_first, first_order
       FROM said LEFT JOIN known USING (google_books_id)"""
)
def resolve_by_external_id(t: Tables) -> DataFrame:
    def external(column: str):
        return F.concat(F.lit("c"), F.col(column).cast("string")).alias("google_books_id")

    known = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").alias("id"), external("c_custkey")
    )
    said = t.orders.select("o_orderkey", external("o_custkey"))
    found = resolve.match_external(said, known, ["o_orderkey"])
    return found.withColumn("first_order", F.col("first_order.o_orderkey"))


@query(
    """WITH books AS (
           SELECT s_suppkey AS id,
                  CASE WHEN s_acctbal > 5000 THEN 'n' || s_nationkey END AS google_books_id,
                  'a' || CAST(floor(s_acctbal / 100) AS BIGINT) AS isbn,
                  'Nation ' || s_nationkey AS title
           FROM supplier),
       requests AS (
           SELECT c_custkey, 'a' || CAST(floor(c_acctbal / 100) AS BIGINT) AS isbn,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN 'n' || c_nationkey END AS google_books_id,
                  'NATION ' || c_nationkey AS title,
                  CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'some author' ELSE 'Other' END AS author
           FROM customer),
       matched AS (
           SELECT c_custkey,
                  (SELECT min(id) FROM books k WHERE k.google_books_id = r.google_books_id) AS e,
                  (SELECT min(id) FROM books k WHERE k.isbn = r.isbn) AS i,
                  (SELECT min(id) FROM books k
                   WHERE lower(k.title) = lower(r.title) AND r.author = 'some author') AS t
           FROM requests r)
       SELECT c_custkey, coalesce(e, i, t) AS book_id,
              CASE WHEN e IS NOT NULL THEN 'external_id' WHEN i IS NOT NULL THEN 'isbn'
                   WHEN t IS NOT NULL THEN 'title_author' ELSE 'new' END AS match_kind
       FROM matched"""
)
def isbn_precedence(t: Tables) -> DataFrame:
    def hundreds(column: str):
        return F.concat(F.lit("a"), F.floor(F.col(column) / 100).cast("string"))

    def nation(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    books = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") > 5000, nation("n", "s_nationkey")).alias("google_books_id"),
        hundreds("s_acctbal").alias("isbn"),
        nation("Nation ", "s_nationkey").alias("title"),
        F.lit("Some Author").alias("author"),
    )
    segment = F.col("c_mktsegment")
    requests = t.customer.select(
        "c_custkey",
        hundreds("c_acctbal").alias("requested_isbn"),
        F.when(segment == "BUILDING", nation("n", "c_nationkey")).alias("google_books_id"),
        nation("NATION ", "c_nationkey").alias("title"),
        F.when(segment != "MACHINERY", "some author").otherwise("Other").alias("author"),
    )
    matched = resolve.match_isbn_request(requests, books)
    return matched.select("c_custkey", "book_id", "match_kind")


@query(
    """WITH known AS (SELECT 'g' || n_nationkey AS g, n_nationkey AS id FROM nation),
       landed AS (
           SELECT 'i' || p_size AS isbn, arg_max(p_name, (length(p_brand), -p_partkey)) AS title,
                  'g' || CAST(arg_max(floor(p_retailprice), (length(p_brand), -p_partkey)) - 900
                              AS BIGINT) AS g
           FROM part GROUP BY p_size),
       asked AS (SELECT 'i' || CAST(floor(l_quantity) AS BIGINT) AS isbn FROM lineitem)
       SELECT a.isbn, count(*) AS requests, min(k.id) AS known_id,
              bool_and(l.isbn IS NULL) AS not_found
       FROM asked a LEFT JOIN landed l ON l.isbn = a.isbn LEFT JOIN known k ON k.g = l.g
       GROUP BY a.isbn"""
)
def add_by_isbn(t: Tables) -> DataFrame:
    """Every line asks for a size as an ISBN; nations are the known books."""

    def numbered(prefix: str, column) -> Column:
        return F.concat(F.lit(prefix), column.cast("string"))

    known = t.nation.select(
        F.col("n_nationkey").cast("long").alias("id"),
        numbered("nation ", F.col("n_nationkey")).alias("title"),
        F.lit("Nobody").alias("author"),
        numbered("g", F.col("n_nationkey")).alias("google_books_id"),
        F.lit(None).cast("string").alias("isbn"),
    )
    info = F.struct(
        F.col("p_name").alias("title"),
        F.array(F.col("p_name")).alias("authors"),
        F.col("p_brand").alias("description"),
        F.lit("en").alias("language"),
        F.lit(None).cast("array<struct<type:string,identifier:string>>").alias("industryIdentifiers"),
        F.lit(None).cast("struct<thumbnail:string>").alias("imageLinks"),
    )
    landed = t.part.select(
        numbered("i", F.col("p_size")).alias("isbn"),
        F.col("p_partkey").alias("pos"),
        numbered("g", F.floor("p_retailprice") - 900).alias("id"),
        info.alias("volumeInfo"),
    )
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    position = (line * 1_000_000 + F.col("l_partkey")) * 64 + F.floor("l_quantity")
    asked = spread(t.lineitem).select(
        position.alias("position"),
        numbered("i", F.floor("l_quantity")).alias("isbn"),
    )
    answers, _ = resolve_requests(asked, known, landed, 1000, now=now())
    return answers.groupBy("isbn").agg(
        F.count("*").alias("requests"),
        F.min(F.when(F.col("book_id") <= 1000, F.col("book_id"))).alias("known_id"),
        F.bool_and(F.col("match_kind") == "not_found").alias("not_found"),
    )


def candidates(t: Tables) -> DataFrame:
    """Documents as candidates of one query per source; French ones name no language."""

    def tagged(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    longer = F.when(F.col("n_chars") > 1000, "ISBN_13").otherwise("OTHER")
    return t.documents.select(
        "source",
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("id"),
        F.struct(
            F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
            F.array("source", "lang").alias("authors"),
            F.when(F.col("source") != "src3", F.col("text")).alias("description"),
            F.when(F.col("lang") != "fr", F.col("lang")).alias("language"),
            F.array(
                F.struct(F.lit("ISBN_10").alias("type"), tagged("X", "n_chars").alias("identifier")),
                F.struct(longer.alias("type"), tagged("978", "n_chars").alias("identifier")),
            ).alias("industryIdentifiers"),
            F.struct(tagged("https://img/", "doc_id").alias("thumbnail")).alias("imageLinks"),
        ).alias("volumeInfo"),
    )


BEST = """english AS (
    SELECT *, CASE WHEN source <> 'src3' THEN length(text) ELSE 0 END AS length FROM documents
    WHERE lang IN ('en', 'fr')),
best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length DESC, doc_id)
                       AS place FROM english) WHERE place = 1)"""


@query("WITH " + BEST + " SELECT source, doc_id AS pos, length FROM best")
def best_candidate(t: Tables) -> DataFrame:
    best = resolve.best_candidates(candidates(t), ["source"])
    length = F.char_length(text.or_empty(F.col("volume.volumeInfo.description")))
    return best.select("source", F.col("volume.id").cast("long").alias("pos"), length.alias("length"))


@query(
    "WITH " + BEST + """
    SELECT source, CAST(doc_id AS VARCHAR) AS google_books_id, 'T' || doc_id AS title,
           source || ', ' || lang AS authors, CASE WHEN source <> 'src3' THEN text END AS description,
           CASE WHEN n_chars > 1000 THEN '978' || n_chars ELSE 'X' || n_chars END AS isbn,
           'https://img/' || doc_id AS cover_url,
           CASE WHEN n_chars IN (SELECT n_chars FROM documents WHERE lang = 'en')
                THEN 'https://www.amazon.com/dp/X' || n_chars
                ELSE 'https://www.amazon.com/s?k=T' || doc_id || '%20' || source END AS amazon_url
    FROM best"""
)
def metadata_record(t: Tables) -> DataFrame:
    """Product pages exist for the lengths of English documents."""
    english = t.documents.where(F.col("lang") == "en")
    live = english.select(F.concat(F.lit("X"), F.col("n_chars").cast("string")).alias("isbn"))
    best = resolve.best_candidates(candidates(t), ["source"])
    record = resolve.metadata_record(best, live)
    return record.withColumn("authors", F.array_join("authors", ", "))


def part_volumes(t: Tables) -> DataFrame:
    """Landed candidates for parts: by title and brand for large ones, by title for promotions.

    All volumes of a title share one external id."""
    size = F.col("p_size")
    described = F.concat("p_type", F.lit(" "), "p_brand", F.lit(" "), F.col("p_partkey").cast("string"))
    info = F.struct(
        F.initcap("p_name").alias("title"),
        F.array(F.concat(F.lit("Maker of "), "p_name")).alias("authors"),
        described.alias("description"),
        F.when((size > 47) | (size < 10), "de").when(size < 30, "en").alias("language"),
        F.lit(None).cast("array<struct<type:string,identifier:string>>").alias("industryIdentifiers"),
        F.lit(None).cast("struct<thumbnail:string>").alias("imageLinks"),
    )
    volume = [
        text.ascii_fold(F.col("p_name")).alias("title_key"),
        F.col("p_partkey").alias("pos"),
        F.concat(F.lit("g:"), "p_name").alias("id"),
        info.alias("volumeInfo"),
    ]
    told = t.part.where(F.col("p_size") > 40).select(
        text.ascii_fold(F.col("p_brand")).alias("author_key"), *volume
    )
    untold = t.part.where(F.col("p_type") == "PROMO").select(F.lit("").alias("author_key"), *volume)
    return told.unionByName(untold)


VOLUMES = """volumes AS (
    SELECT lower(p_name) AS t, lower(p_brand) AS a, p_partkey AS pos, p_size,
           p_type || ' ' || p_brand || ' ' || p_partkey AS description FROM part WHERE p_size > 40
    UNION ALL
    SELECT lower(p_name), '', p_partkey, p_size, p_type || ' ' || p_brand || ' ' || p_partkey
    FROM part WHERE p_type = 'PROMO'),
best AS (
    SELECT t, a, arg_max(description, (length(description), -pos)) AS description
    FROM volumes WHERE p_size BETWEEN 10 AND 47 GROUP BY t, a)"""


@query(
    "WITH " + VOLUMES + """, keys AS (
        SELECT DISTINCT lower(p_name) AS t,
               CASE WHEN p_type = 'ECONOMY' THEN '' ELSE lower(p_brand) END AS a FROM part)
    SELECT k.t AS title_key, k.a AS author_key, coalesce(told.description, alone.description)
               AS description
    FROM keys k LEFT JOIN best told ON told.t = k.t AND told.a = k.a
    LEFT JOIN best alone ON alone.t = k.t AND alone.a = ''"""
)
def enrich_with_fallback(t: Tables) -> DataFrame:
    author = F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.lower("p_brand"))
    keys = t.part.select(F.lower("p_name").alias("title_key"), author.alias("author_key")).distinct()
    found = resolve.enrich(keys, part_volumes(t))
    description = F.col("volume.volumeInfo.description").alias("description")
    return found.select("title_key", "author_key", description)


def _batch(t: Tables):
    """Every line is a mention of its part, made in the thread of its supplier; parts of
    type ECONOMY are known books."""
    known = t.part.where(F.col("p_type") == "ECONOMY").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.lit(None).cast("string").alias("google_books_id"),
    )
    found = spread(t.lineitem).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("external_id"),
        F.array(F.col("l_orderkey").cast("int"), F.col("l_linenumber")).alias("path"),
        F.col("l_partkey").cast("int").alias("mention_pos"),
        F.concat(F.lit(" "), F.upper("p_name")).alias("title"),
        F.col("p_brand").alias("author"),
    )
    used = t.part.agg(F.max("p_partkey")).first()[0]
    return resolve_mention_batch(found, known, part_volumes(t), used, now=now(), over_quota=refused_lookups(t))


def refused_lookups(t: Tables) -> DataFrame:
    """Some parts' lookups by title and brand were over quota, others' by title alone."""
    last = F.col("p_partkey") % 10
    refused = t.part.where(last.isin(5, 7))
    author = F.when(last == 5, text.ascii_fold(F.col("p_brand"))).otherwise("")
    return refused.select(text.ascii_fold(F.col("p_name")).alias("title_key"), author.alias("author_key"))


# A mention is known by title and brand, or becomes the book of its title's external id, or,
# without a record, the book of its own title and brand; or it waits for a lookup.
RESOLVED = "WITH " + VOLUMES + """, said AS (
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS external_id, l_orderkey, l_linenumber,
           l_partkey, lower(p_name) AS t, lower(p_brand) AS a
    FROM lineitem JOIN part ON p_partkey = l_partkey),
known AS (SELECT lower(p_name) AS t, lower(p_brand) AS a, min(p_partkey) AS id FROM part
          WHERE p_type = 'ECONOMY' GROUP BY ALL),
keys AS (
    SELECT s.t, s.a, k.id, coalesce(told.description, alone.description) AS description,
           min((external_id, l_orderkey, l_linenumber, l_partkey)) AS first_order
    FROM said s LEFT JOIN known k ON k.t = s.t AND k.a = s.a
    LEFT JOIN best told ON told.t = s.t AND told.a = s.a
    LEFT JOIN best alone ON alone.t = s.t AND alone.a = ''
    GROUP BY s.t, s.a, k.id, told.description, alone.description),
waiting AS (
    SELECT k.t, k.a FROM keys k WHERE id IS NULL AND (
        EXISTS (SELECT 1 FROM part WHERE p_partkey % 10 = 5 AND lower(p_name) = k.t AND lower(p_brand) = k.a)
        OR description IS NULL AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 10 = 7 AND lower(p_name) = k.t))),
fresh AS (
    SELECT *, CASE WHEN description IS NULL THEN t || '|' || a ELSE t END AS made FROM keys
    WHERE id IS NULL AND (t, a) NOT IN (SELECT (t, a) FROM waiting)),
books AS (
    SELECT made, min(first_order) AS first_order, arg_min(description, first_order) AS description,
           (SELECT max(p_partkey) FROM part)
               + row_number() OVER (ORDER BY min(first_order)) AS id
    FROM fresh GROUP BY made),
settled AS (
    SELECT s.*, coalesce(k.id, n.id) AS book_id,
           CASE WHEN coalesce(k.id, n.id) IS NULL THEN 'held'
                WHEN n.first_order = (external_id, l_orderkey, l_linenumber, l_partkey)
                THEN CASE WHEN n.description IS NULL THEN 'no_description' ELSE 'added' END
                ELSE 'existing' END AS outcome
    FROM said s JOIN keys k ON k.t = s.t AND k.a = s.a
    LEFT JOIN fresh f ON f.t = s.t AND f.a = s.a
    LEFT JOIN books n ON n.made = f.made)"""


@query(
    RESOLVED + """
    SELECT external_id, l_orderkey, l_linenumber, l_partkey, book_id, outcome FROM settled"""
)
def resolve_batch(t: Tables) -> DataFrame:
    return _batch(t).mentions.select(
        "external_id",
        F.col("path")[0].alias("l_orderkey"),
        F.col("path")[1].alias("l_linenumber"),
        F.col("mention_pos").alias("l_partkey"),
        "book_id",
        "outcome",
    )


@query(RESOLVED + " SELECT outcome, count(*) AS n FROM settled GROUP BY outcome")
def ingest_counters(t: Tables) -> DataFrame:
    return _batch(t).counters()
