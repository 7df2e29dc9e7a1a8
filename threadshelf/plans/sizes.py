"""Size checks that decide between a broadcast and a shuffled plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadshelf.plans.lineage import cut_counted

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _width(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    width = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            width = width + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
    return width


def fits_broadcast(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if a table is small enough, by rows and by bytes, to be sent to every executor;
    stops counting just past the rows."""
    size = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(_width(df)).alias("bytes")).first()
    return size["n"] <= rows and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES


def cut_and_fits(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The table, written down, and whether it `fits_broadcast`, measured as it is written."""
    written, size = cut_counted(df, n=F.count("*"), bytes=F.sum(_width(df)))
    return written, size["n"] <= rows and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES


# A task of costly work on texts has about so many bytes of files; tables beyond the limit come in
# enough parts as they are scanned.
SPREAD_BYTES = 512 * 1024
SPREAD_LIMIT = 4 * 1024**3


def _file_bytes(scan: DataFrame) -> int:
    return int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(scan: DataFrame) -> DataFrame:
    """A small table scan dealt out to many tasks by the bytes of its files, for costly work.

    Depends on the files only, not on how many cores have registered so far.
    """
    size = _file_bytes(scan)
    if size >= SPREAD_LIMIT:
        return scan
    return scan.repartition(max(1, min(-(-size // SPREAD_BYTES), 512)))


# A task of `dealt` rows holds about so many, or so many bytes of files, however large the table is.
DEALT_ROWS = 500_000
DEALT_BYTES = 8 * 1024 * 1024


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A table of so many rows, dealt out by key in parts that do not grow with it.

    Tables dealt by keys of the same type with the same `rows` join and group where they lie. Rows of
    one key stay together, so this is for keys of bounded weight, such as the links of a book.
    """
    return df.repartition(max(1, -(-rows // DEALT_ROWS)), key)


def dealt_scan(scan: DataFrame, key: str) -> DataFrame:
    """The same for a table scan, by the bytes of its files."""
    return scan.repartition(max(1, -(-_file_bytes(scan) // DEALT_BYTES)), key)
