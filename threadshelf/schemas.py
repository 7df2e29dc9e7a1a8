"""Table layouts of the catalogue."""

from pyspark.sql import types as T

BOOKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("author", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("google_books_id", T.StringType()),
        T.StructField("isbn", T.StringType()),
        T.StructField("cover_url", T.StringType()),
        T.StructField("amazon_url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

SOURCES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("source_type", T.StringType()),
        T.StructField("external_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("book_id", T.LongType(), False),
        T.StructField("source_id", T.LongType(), False),
        T.StructField("context_id", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("book_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("title", T.StringType()),
                    T.StructField("author", T.StringType()),
                    T.StructField("source_title", T.StringType()),
                ]
            ),
        ),
    ]
)

VOLUME_INFO = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField(
            "industryIdentifiers",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("identifier", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("imageLinks", T.StructType([T.StructField("thumbnail", T.StringType())])),
    ]
)

VOLUME_RESPONSE = T.StructType(
    [
        T.StructField("totalItems", T.LongType()),
        T.StructField("error", T.StructType([T.StructField("message", T.StringType())])),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("volumeInfo", VOLUME_INFO),
                    ]
                )
            ),
        ),
    ]
)

# Fixed value: the statuses a book may take.
STATUSES = ["new", "viewed", "interested", "reading", "finished", "dropped", "deleted"]
