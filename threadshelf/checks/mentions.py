"""Mentions, summaries, chunk texts and their vectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.checks import Tables, query
from threadshelf.checks import bindings as b
from threadshelf.operators import chunks, mentions
from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import spread

# the white space of the texts, for SQL
BLANKS = "chr(9) || chr(10) || chr(13) || chr(32) || chr(160)"


@query(
    f"""WITH said AS (
            SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN ' N/A ' WHEN 'PROMO' THEN 'Null'
                       WHEN 'STANDARD' THEN '  ' WHEN 'MEDIUM' THEN NULL
                       ELSE ' ' || p_name || chr(9) END AS title
            FROM part)
        SELECT p_partkey, title FROM said
        WHERE lower(trim(coalesce(title, ''), {BLANKS})) NOT IN ('', 'null', 'unknown', 'n/a', 'none')"""
)
def valid_mentions(t: Tables) -> DataFrame:
    title = (
        F.when(F.col("p_type") == "ECONOMY", " N/A ")
        .when(F.col("p_type") == "PROMO", "Null")
        .when(F.col("p_type") == "STANDARD", "  ")
        .when(F.col("p_type") == "MEDIUM", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t")))
    )
    return mentions.valid_mentions(t.part.select("p_partkey", title.alias("title")))


@query(
    f"""WITH said AS (
            SELECT c.conv_id, c.turn, string_split(c.text, '. ')[1] AS title, o.text AS source_text
            FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = 0),
        worded AS (
            SELECT *, list_filter(regexp_split_to_array(
                       lower(trim(title, {BLANKS})), '[\\s ]+'), lambda w: length(w) > 3) AS words
            FROM said)
        SELECT conv_id, turn, title FROM worded
        WHERE source_text = '' OR len(words) = 0
           OR len(list_filter(words, lambda w: contains(lower(source_text), w))) > 0"""
)
def grounded_mentions(t: Tables) -> DataFrame:
    """The first sentence of every turn, checked against the opening turn."""
    opening = t.conversations.where(F.col("turn") == 0).select(
        "conv_id", F.col("text").alias("source_text")
    )
    said = t.conversations.select(
        "conv_id", "turn", F.substring_index("text", ". ", 1).alias("title")
    )
    return mentions.grounded_mentions(said.join(opening, "conv_id")).drop("source_text")


@query(
    r"""WITH said AS (
            SELECT conv_id, turn, role, text || ' "é" \ ' ||
                CASE role WHEN 'user' THEN '[1]' ELSE '{1}' END || chr(9) AS words FROM conversations)
        SELECT conv_id, turn, 0 AS mention_pos, words AS title, role AS author
        FROM said WHERE role IN ('user', 'assistant')
        UNION ALL
        SELECT conv_id, turn, 2, 'Second Title', NULL FROM said WHERE role = 'user'"""
)
def parse_extractions(t: Tables) -> DataFrame:
    """Turns as model answers: an array among other words, a single object, or broken JSON.

    Brackets in a title make the answer with a single object unreadable, so those are in arrays.
    """
    brackets = F.when(F.col("role") == "user", "[1]").otherwise("{1}")
    words = F.concat("text", F.lit(' "é" \\ '), brackets, F.lit("\t"))
    entry = F.to_json(F.struct(words.alias("title"), F.col("role").alias("author")))
    response = (
        F.when(
            F.col("role") == "user",
            F.concat(
                F.lit("Here you are:\n["), entry,
                F.lit(', "x", {"title":"Second Title","author":5}, null]\nDone.'),
            ),
        )
        .when(F.col("role") == "assistant", F.concat(F.lit("It is "), entry, F.lit(" only")))
        .otherwise(F.concat(F.lit("["), entry, F.lit(",]"), entry))
    )
    answers = t.conversations.select("conv_id", "turn", response.alias("response"))
    return mentions.parse_extractions(answers)


@query(
    f"""WITH said AS (
            SELECT doc_id, text AS description,
                   CASE lang WHEN 'en' THEN '"Here is a SUMMARY: ' || text || '"'
                             WHEN 'de' THEN ' summary:' || chr(10) || text
                             WHEN 'fr' THEN '''' || text || '''' END AS response
            FROM documents),
        bare AS (
            SELECT *, trim(trim(response, {BLANKS}), '"''') AS answer FROM said),
        tidy AS (
            SELECT *, CASE WHEN starts_with(lower(answer), 'here is a summary')
                           THEN ltrim(substr(answer, 18), ': ' || chr(10))
                           WHEN starts_with(lower(answer), 'summary:')
                           THEN ltrim(substr(answer, 9), ': ' || chr(10))
                           ELSE answer END AS kept
            FROM bare)
        SELECT doc_id, CASE WHEN length(description) < 50 THEN description
                            WHEN length(kept) > 200 THEN left(kept, 197) || '...'
                            ELSE kept END AS summary
        FROM tidy"""
)
def clean_summaries(t: Tables) -> DataFrame:
    response = (
        F.when(F.col("lang") == "en", F.concat(F.lit('"Here is a SUMMARY: '), "text", F.lit('"')))
        .when(F.col("lang") == "de", F.concat(F.lit(" summary:\n"), "text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("'"), "text", F.lit("'")))
    )
    answers = t.documents.select(
        "doc_id", F.col("text").alias("description"), response.alias("response")
    )
    return mentions.clean_summaries(answers).select("doc_id", "summary")


def _count_words():
    """A stand-in for a model: counts words, and refuses texts with a bar."""

    def model(texts):
        if any("|" in value for value in texts):
            raise ValueError("bar")
        return [str(len(value.split(" "))) for value in texts]

    return model


@query(
    """SELECT doc_id, CASE WHEN NOT contains(text, '|') THEN
                  CAST(len(string_split(text, ' ')) AS VARCHAR) END AS response,
              CASE WHEN contains(text, '|') THEN 'ValueError: bar' END AS error
       FROM documents"""
)
def infer_batch(t: Tables) -> DataFrame:
    return mentions.infer(t.documents.select("doc_id", "text"), "text", _count_words).drop("text")


CHUNK_TEXT = """titles AS (
    SELECT l.book_id, list(s.title ORDER BY l.id, s.title) AS titles
    FROM part_links l JOIN supplier_sources s ON s.id = l.source_id GROUP BY l.book_id),
chunk AS (
    SELECT d.id AS book_id, d.status, d.description,
           concat_ws(chr(10) || chr(10),
               nullif(array_to_string(list_transform(t.titles, lambda x:
                   'Recommended for: ' || x || chr(10) || chr(10) || 'Category: ' || x),
                   chr(10) || chr(10)), ''),
               d.title || ' by ' || coalesce(d.author, 'Unknown'),
               nullif(d.summary, ''), nullif(d.description, ''),
               CASE WHEN len(t.titles) > 0 THEN 'Tags: ' || array_to_string(t.titles, ', ') END)
               AS text,
           coalesce(t.titles[1], '') AS source_title
    FROM document_books d LEFT JOIN titles t ON t.book_id = d.id)"""


@query(
    b.ctes(b.DOCUMENT_BOOKS, b.PART_LINKS, b.SUPPLIER_SOURCES, CHUNK_TEXT)
    + "SELECT book_id, text, source_title FROM chunk"
)
def chunk_text(t: Tables) -> DataFrame:
    made = chunks.chunk_texts(b.document_books(t), b.part_links(t), b.supplier_sources(t))
    return made.drop("title", "author")


def stored_chunks(t: Tables) -> DataFrame:
    """A chunk table from before: one row per vector."""
    doc = F.concat(F.lit("doc_"), F.col("vec_id").cast("string"))
    unknown = F.lit(None).cast("string")
    return t.embeddings.select(
        doc.alias("doc_id"),
        F.col("vec_id").alias("book_id"),
        F.lit("stored").alias("text"),
        "embedding",
        F.struct(
            F.concat(F.lit("Title "), F.col("vec_id").cast("string")).alias("title"),
            unknown.alias("author"),
            F.concat(F.lit("Label "), F.col("label").cast("string")).alias("source_title"),
        ).alias("metadata"),
    )


@query(
    b.ctes(b.DOCUMENT_BOOKS, b.PART_LINKS, b.SUPPLIER_SOURCES, CHUNK_TEXT)
    + """, rebuilt AS (
             SELECT book_id, text, source_title FROM chunk
             WHERE status <> 'deleted' AND coalesce(description, '') <> '')
         SELECT 'doc_' || book_id AS doc_id, text, source_title FROM rebuilt
         UNION ALL
         SELECT 'doc_' || vec_id, 'stored', 'Label ' || label FROM embeddings
         WHERE vec_id NOT IN (SELECT book_id FROM rebuilt)"""
)
def reindex_chunks(t: Tables) -> DataFrame:
    rebuilt = chunks.reindex(
        b.document_books(t), b.part_links(t), b.supplier_sources(t), stored_chunks(t)
    )
    return rebuilt.select("doc_id", "text", F.col("metadata.source_title").alias("source_title"))


# word counts hashed to 256 places, as the offline encoder makes them
WORD_COUNTS = """SELECT {key} AS key, CAST('0x' || left(md5(word), 2) AS INTEGER) AS i,
                        CAST(count(*) AS DOUBLE) AS n
                 FROM (SELECT {key}, unnest(regexp_extract_all(lower(text),
                                            '[a-z0-9ß-öø-ÿ]+')) AS word FROM {table})
                 GROUP BY ALL"""


# weights of the places, from the documents
WEIGHTS = """(SELECT i, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS w FROM {counts} GROUP BY i)"""


@query(
    "WITH counts AS (" + WORD_COUNTS.format(key="doc_id", table="documents") + """),
    weighted AS (SELECT key, i, n * w AS n FROM counts JOIN """ + WEIGHTS.format(counts="counts") + """ USING (i)),
    unit AS (
        SELECT key AS doc_id, i AS dimension,
               CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS weight
        FROM weighted)
    SELECT doc_id, dimension, round(weight, 5) AS weight FROM unit WHERE weight > 0"""
)
def embed_batch(t: Tables) -> DataFrame:
    """Documents as weighted word counts; the weights come from the same counts."""
    counted = cut(chunks.count_words(spread(t.documents).select("doc_id", "text"), keep=["doc_id"]))
    weights = chunks.inverse_frequencies(chunks.document_frequencies(counted))
    return (
        chunks.weigh(counted, weights)
        .select("doc_id", F.posexplode("embedding").alias("dimension", "weight"))
        .where(F.col("weight") > 0)
        .withColumn("weight", F.round(F.col("weight").cast("double"), 5))
    )
