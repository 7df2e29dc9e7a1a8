"""Thread ingest: documents are turned into thread JSON, which is then read back."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables, query
from threadshelf.plans.ingest import Models
from threadshelf.plans.lineage import cut, work_path
from threadshelf.plans.sizes import spread
from threadshelf.sources import threads, volumes
from threadshelf.sources.tables import Store
from threadshelf.streaming import ingest as streams
from threadshelf.schemas import VOLUME_INFO


def json_text(value: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def listing_json(documents: DataFrame) -> DataFrame:
    """Documents as raw threads (origin, value).

    Lines are comments, the sentences of a line its replies. A line with a bar is no
    comment, and its replies go with it. German documents come as normalised objects,
    Spanish ones are cut short and cannot be read.
    """
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))

    def numbered(name: Column, i: Column) -> Column:
        return F.concat(name, F.lit("_"), i.cast("string"))

    def fields(name: Column, body: Column) -> list[Column]:
        return [name.alias("id"), body.alias("body"), F.char_length(body).alias("score")]

    def children(nodes: Column) -> Column:
        return F.struct(F.struct(nodes.alias("children")).alias("data"))

    def comment(line: Column, i: Column) -> Column:
        name = numbered(doc, i)
        sentences = F.split(line, r"\. ")
        replies = F.transform(
            sentences,
            lambda sentence, j: F.struct(
                F.lit("t1").alias("kind"), F.struct(*fields(numbered(name, j), sentence)).alias("data")
            ),
        )
        below = F.when(F.size(sentences) > 1, children(replies))
        return F.struct(
            F.when(F.contains(line, F.lit("|")), "more").otherwise("t1").alias("kind"),
            F.struct(*fields(name, line), below.alias("replies")).alias("data"),
        )

    def flat(line: Column, i: Column) -> Column:
        return F.struct(*fields(numbered(doc, i), line), F.lit(0).alias("depth"))

    lines = F.split("text", "\n")
    permalink = F.concat(F.lit("/r/"), "lang", F.lit("/comments/"), doc, F.lit("/"))
    header = [
        doc.alias("id"),
        F.concat("source", F.lit(" "), doc).alias("title"),
        F.when(F.col("lang") == "fr", F.lit("  ")).alias("selftext"),
        F.col("lang").alias("subreddit"),
    ]
    post = F.struct(F.struct(*header, permalink.alias("permalink")).alias("data"))
    listing = F.concat(
        F.lit("["),
        F.to_json(children(F.array(post))),
        F.lit(","),
        F.to_json(children(F.transform(lines, comment))),
        F.lit("]"),
    )
    url = F.concat(F.lit("https://example.com"), permalink)
    flat_comments = F.transform(lines, flat)
    plain = F.to_json(F.struct(*header, url.alias("url"), flat_comments.alias("comments")))
    value = (
        F.when(F.col("lang") == "de", plain)
        .when(F.col("lang") == "es", F.left(listing, F.char_length(listing) - 2))
        .otherwise(listing)
    )
    return spread(documents).select(doc.alias("origin"), value.alias("value"))


HEADERS_SQL = """headers AS (
    SELECT 'd' || doc_id AS external_id, source || ' d' || doc_id AS title,
           CASE WHEN lang = 'fr' THEN '  ' ELSE '' END AS selftext, lang AS subreddit,
           CASE WHEN lang = 'de' THEN 'https://example.com' ELSE 'https://reddit.com' END
               || '/r/' || lang || '/comments/d' || doc_id || '/' AS url
    FROM documents WHERE lang <> 'es')"""

COMMENTS_SQL = """lines AS (
    SELECT 'd' || doc_id AS external_id, lang,
           unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents WHERE lang <> 'es'),
replies AS (
    SELECT external_id, i, unnest(string_split(line, '. ')) AS sentence,
           unnest(range(len(string_split(line, '. ')))) AS j
    FROM lines WHERE lang <> 'de' AND contains(line, '. ') AND NOT contains(line, '|')),
comments AS (
    SELECT external_id, CAST(i AS VARCHAR) AS path, 0 AS depth,
           external_id || '_' || i AS comment_id, line AS body, length(line) AS score
    FROM lines WHERE lang = 'de' OR NOT contains(line, '|')
    UNION ALL
    SELECT external_id, i || '.' || j, 1, external_id || '_' || i || '_' || j, sentence,
           length(sentence)
    FROM replies)"""


def dotted(path: str = "path") -> Column:
    return F.array_join(F.col(path).cast("array<string>"), ".")


@query(
    """SELECT 'd' || doc_id AS origin,
              CASE lang WHEN 'es' THEN 'unreadable' WHEN 'de' THEN 'object' ELSE 'listing' END
                  AS layout,
              lang = 'es' AS quarantined
       FROM documents"""
)
def scan_threads(t: Tables) -> DataFrame:
    return threads.parse(listing_json(t.documents)).select(
        "origin", "layout", F.col("value").isNotNull().alias("quarantined")
    )


@query("WITH " + HEADERS_SQL + " SELECT external_id, title, selftext, subreddit, url FROM headers")
def thread_headers(t: Tables) -> DataFrame:
    return threads.split(threads.parse(listing_json(t.documents))).headers.drop("origin")


@query("WITH " + COMMENTS_SQL + " SELECT * FROM comments")
def flatten_comments(t: Tables) -> DataFrame:
    comments = threads.split(threads.parse(listing_json(t.documents))).comments
    shown = comments.withColumns({"path": dotted(), "external_id": F.col("origin")})
    return shown.select("external_id", "path", "depth", "comment_id", "body", "score")


@query(
    "WITH " + COMMENTS_SQL + """
    SELECT c.external_id, c.comment_id, count(r.comment_id) + 1 AS n, max(coalesce(r.score, c.score)) AS best_score
    FROM comments c LEFT JOIN comments r
      ON r.external_id = c.external_id AND r.depth = 1 AND starts_with(r.path, c.path || '.')
    WHERE c.depth = 0 GROUP BY ALL"""
)
def comment_branches(t: Tables) -> DataFrame:
    """Every branch of a thread by its interval of numbers: how many comments, and the best score of a reply."""
    comments = cut(threads.split(threads.parse(listing_json(t.documents)), paths=False).comments)
    tops = comments.where("depth = 0").select("origin", "number")
    inside = threads.replies_to(comments, tops)
    heads = comments.where("depth = 0").select("origin", F.col("number").alias("branch"), F.col("comment_id").alias("head"))
    own = F.col("number") == F.col("branch")
    sums = inside.groupBy("origin", "branch").agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.when(~own, F.col("score"))), F.max("score")).alias("best_score"),
    )
    return heads.join(sums, ["origin", "branch"]).select(F.col("origin").alias("external_id"), F.col("head").alias("comment_id"), "n", "best_score")


@query(
    "WITH " + COMMENTS_SQL + """
    SELECT d.external_id, count(c.path) AS n_comments
    FROM (SELECT DISTINCT external_id FROM lines) d
    LEFT JOIN comments c ON c.external_id = d.external_id GROUP BY d.external_id"""
)
def comment_count(t: Tables) -> DataFrame:
    return threads.comment_counts(threads.parse(listing_json(t.documents))).drop("origin")


# system turns stand for comments that were taken away
@query(
    """SELECT conv_id, -1 AS place, ' ' || text AS text FROM conversations WHERE turn = 0
       UNION ALL
       SELECT conv_id, turn, trim(text, chr(9) || chr(10) || chr(32) || chr(160))
       FROM conversations WHERE turn > 0 AND role <> 'system'"""
)
def comment_texts(t: Tables) -> DataFrame:
    first = F.col("turn") == 0
    headers = t.conversations.where(first).select(
        "conv_id", F.concat(F.lit(" "), "text").alias("selftext")
    )
    body = F.when(F.col("role") == "system", F.lit("\t[deleted] ")).otherwise(
        F.concat(F.lit(" \t"), "text", F.lit("\xa0\n"))
    )
    comments = t.conversations.where(~first).select(
        "conv_id", F.array(F.col("turn").cast("int")).alias("path"), body.alias("body")
    )
    texts = threads.comment_texts(headers, comments, key="conv_id")
    return texts.select("conv_id", F.col("path")[0].alias("place"), "text")


@query(
    """WITH copies AS (
           SELECT page_id, CASE WHEN page_id % 3 = 0
                      THEN 'https://example.com/t/' || regexp_extract(url, '/([0-9]+)', 1) || '.json?a=1'
                      ELSE regexp_extract(url, '/([0-9]+)', 1) END AS thread,
                  CASE WHEN url LIKE 'https://m.%' THEN 0 WHEN url LIKE 'https%' THEN 1 ELSE 2 END
                      AS priority,
                  contains(url, '?') AS broken
           FROM pages)
       SELECT thread, min(page_id) AS origin,
              CASE priority WHEN 0 THEN 'file' WHEN 1 THEN 'cache' ELSE 'fetch' END AS kind
       FROM copies c
       WHERE NOT (broken AND priority = 1)
         AND priority = (SELECT min(priority) FROM copies d
                         WHERE d.thread = c.thread AND NOT (d.broken AND d.priority = 1))
       GROUP BY thread, priority"""
)
def latest_raw_copy(t: Tables) -> DataFrame:
    """Pages as copies of threads: the number in the address is the thread, or, for a third of
    them, the address names no thread and stands for itself."""
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    kind = (
        F.when(F.startswith("url", F.lit("https://m.")), "file")
        .when(F.startswith("url", F.lit("https")), "cache")
        .otherwise("fetch")
    )
    whole = F.concat(F.lit('{"id":"x","title":'), json_text(F.col("html")), F.lit("}"))
    broken = F.contains("url", F.lit("?"))
    copies = t.pages.select(
        F.when(
            F.col("page_id") % 3 == 0, F.concat(F.lit("https://example.com/t/"), number, F.lit("/?a=1"))
        )
        .otherwise(F.concat(F.lit("https://example.com/comments/"), number, F.lit("/x")))
        .alias("source"),
        F.col("page_id").alias("origin"),
        kind.alias("kind"),
        F.when(broken, F.concat(F.lit("<"), whole)).otherwise(whole).alias("value"),
    )
    return threads.latest_raw_copy(copies).select("thread", "origin", "kind")


def responses(t: Tables) -> DataFrame:
    """Documents as answers of the bibliographic service: German ones are over quota,
    Spanish ones another error, French ones have no result."""
    item = F.struct(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"),
        F.struct(
            F.col("source").alias("title"),
            F.array(F.lit("A. Author"), F.col("source")).alias("authors"),
            F.col("text").alias("description"),
            F.lit("en").alias("language"),
        ).alias("volumeInfo"),
    )
    other = F.struct(
        F.lit("other").alias("id"), F.struct(F.lit("Other").alias("title")).alias("volumeInfo")
    )
    found = F.concat(
        F.lit('{"totalItems":2,"items":['), F.to_json(item), F.lit(","), F.to_json(other), F.lit("]}")
    )
    response = (
        F.when(F.col("lang") == "de", '{"error":{"message":"Daily Quota exceeded"}}')
        .when(F.col("lang") == "es", '{"error":{"message":"backend failure"}}')
        .when(F.col("lang") == "fr", '{"totalItems":0}')
        .otherwise(found)
    )
    return t.documents.select("doc_id", response.alias("response"))


@query(
    """SELECT doc_id, 'candidate' AS kind, 0 AS pos, 'v' || doc_id AS id, source AS title,
              text AS description, 'A. Author, ' || source AS authors
       FROM documents WHERE lang = 'en'
       UNION ALL SELECT doc_id, 'candidate', 1, 'other', 'Other', NULL, NULL
       FROM documents WHERE lang = 'en'
       UNION ALL SELECT doc_id, 'quota', NULL, NULL, 'Daily Quota exceeded', NULL, NULL
       FROM documents WHERE lang = 'de'
       UNION ALL SELECT doc_id, 'error', NULL, NULL, 'backend failure', NULL, NULL
       FROM documents WHERE lang = 'es'"""
)
def scan_volumes(t: Tables) -> DataFrame:
    split = volumes.read_volumes(responses(t))
    candidates = split.candidates.select(
        "doc_id",
        F.lit("candidate").alias("kind"),
        "pos",
        "id",
        F.col("volumeInfo.title").alias("title"),
        F.col("volumeInfo.description").alias("description"),
        F.array_join("volumeInfo.authors", ", ").alias("authors"),
    )

    def failed(errors: DataFrame, kind: str) -> DataFrame:
        return errors.select("doc_id", F.lit(kind).alias("kind"), F.col("message").alias("title"))

    errors = failed(split.quota_errors, "quota").unionByName(failed(split.other_errors, "error"))
    return candidates.unionByName(errors, allowMissingColumns=True)


def _first_words():
    """A stand-in for a model: the first word of a text is the title of a book."""

    def model(texts):
        found = [value.split() for value in texts]
        return [json.dumps([{"title": w[0], "author": ""}] if w else []) for w in found]

    return model


@query(
    "WITH " + HEADERS_SQL + ", " + COMMENTS_SQL + """,
    said AS (
        SELECT external_id, translate(regexp_extract(trim(body), '^[^ ]+'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS title
        FROM comments WHERE trim(body) <> '')
    SELECT h.external_id, h.title, h.url,
           (SELECT count(*) FROM comments c WHERE c.external_id = h.external_id) AS n_comments,
           (SELECT count(DISTINCT s.title) FROM said s WHERE s.external_id = h.external_id) AS n_books,
           (SELECT count(DISTINCT s.title) FROM said s) AS all_books,
           (SELECT count(*) FROM documents WHERE lang = 'es') AS n_unreadable
    FROM headers h"""
)
def incremental_ingest(t: Tables) -> DataFrame:
    """Threads land in two lots, the second with copies of the first; a stream indexes each once."""
    spark = t.spark
    base = work_path(spark, "incremental-ingest")
    landing, checkpoint = f"{base}/landing", f"{base}/checkpoint"
    store = Store(spark, f"{base}/store")
    info = VOLUME_INFO.simpleString()
    no_volumes = spark.createDataFrame(
        [], f"title_key string, author_key string, pos int, id string, volumeInfo {info}"
    )
    for lot in (t.documents.where(F.col("lang") == "en"), t.documents):
        listing_json(lot).select("value").write.mode("append").option("compression", "gzip").text(landing)
        streams.ingest_stream(
            spark, landing, checkpoint, store, no_volumes, Models(_first_words), whole_files=False
        ).awaitTermination()
    counts = store.read("comments").groupBy("external_id").agg(F.count("*").alias("n_comments"))
    books = store.read("links").groupBy(F.col("source_id").alias("id")).agg(
        F.countDistinct("book_id").alias("n_books")
    )
    return (
        store.read("sources")
        .join(counts, "external_id", "left")
        .join(books, "id", "left")
        .fillna(0, ["n_comments", "n_books"])
        .withColumns(
            {
                "all_books": store.read("books").agg(F.count("*")).scalar(),
                "n_unreadable": store.read("set_aside").agg(F.count("*")).scalar(),
            }
        )
        .select("external_id", "title", "url", "n_comments", "n_books", "all_books", "n_unreadable")
    )
