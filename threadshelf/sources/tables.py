"""The catalogue's tables as Parquet versions that become visible together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadshelf import schemas

COMMENTS = T.StructType(
    [
        T.StructField("external_id", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("comment_id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)

# Threads that could not be indexed, or not wholly: what the reason is, and the text of
# unreadable ones.
SET_ASIDE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# Vectors of the chunks by bucket, for approximate search; and in how many chunk texts each place
# of the offline encoder occurs, with the weights its vectors were made with.
VECTORS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("bucket", T.IntegerType()),
    ]
)
FREQUENCIES = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("documents", T.LongType())])
WEIGHTS = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("weight", T.DoubleType())])

# Tables laid out in a folder per value.
FOLDERS = {"vectors": "bucket"}
# Parquet keeps Bloom filters of these columns, so that a lookup of few keys skips most row groups.
LOOKUPS = {"books": ["google_books_id", "isbn"], "sources": ["external_id"]}

TABLES = {
    "books": schemas.BOOKS,
    "sources": schemas.SOURCES,
    "links": schemas.LINKS,
    "chunks": schemas.CHUNKS,
    "comments": COMMENTS,
    "set_aside": SET_ASIDE,
    "vectors": VECTORS,
    "frequencies": FREQUENCIES,
    "weights": WEIGHTS,
}

LOG = "name string, versions array<long>, last_id long"
# Log entries of streams: the number of their last batch instead of an id.
BATCH_OF = "batch of "


class Store:
    """The tables of one catalogue under one folder.

    A change writes new files beside the current ones, in a folder per table and version. The
    log has one file per commit, which names the versions every table consists of from then
    on: all tables of a commit change at once, files of a commit that did not finish are never
    read, and only the newest file of the log is. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType] = TABLES):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def snapshot(self) -> Snapshot:
        """The tables as of now; later commits do not show in it."""
        log = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        files = log.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/v=*/part-*"))
        names = [str(x.getPath().getParent().getName()) for x in found or []]
        if not names:
            return Snapshot(self, -1, {}, {})
        version = max(int(name.removeprefix("v=")) for name in names)
        # one row per table
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log/v={version}").collect()
        return Snapshot(
            self, version, {r.name: list(r.versions) for r in rows}, {r.name: r.last_id for r in rows}
        )

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def commit(self) -> Commit:
        """Use as a context manager; what it writes shows when the block ends without error."""
        return Commit(self)

    def compact(self, name: str) -> None:
        """Put the content of many appends into one version."""
        with self.commit() as commit:
            commit.replace(name, commit.before.read(name))

    def _files(self, name: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.tables[name])
        paths = [f"{self.path}/{name}/v={version}" for version in versions]
        return self.spark.read.schema(self.tables[name]).parquet(*paths)


@dataclass
class Snapshot:
    store: Store
    version: int
    versions: dict[str, list[int]]
    last_ids: dict[str, int]

    def read(self, name: str) -> DataFrame:
        return self.store._files(name, self.versions.get(name, []))

    def last_batch(self, stream: str) -> int:
        """Number of the last batch of a stream that was committed; -1 before the first."""
        return self.last_ids.get(BATCH_OF + stream, -1)

    def last_id(self, name: str) -> int:
        """Highest id ever given out; ids of deleted rows stay used up."""
        return self.last_ids.get(name, 0)


class Commit:
    """Changes to some tables, each written once; `before` is the state they start from."""

    def __init__(self, store: Store):
        self.store, self.before = store, store.snapshot()
        self.entries: dict[str, tuple[str, list[int], int]] = {}
        self.marks: dict[str, tuple[str, list[int], int]] = {}

    def mark(self, stream: str, batch: int) -> None:
        """Say that this commit holds all of a batch of a stream."""
        name = BATCH_OF + stream
        self.marks[name] = (name, [], batch)

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, _error, _trace) -> None:
        if kind is None and (self.entries or self.marks):
            spark = self.store.spark
            if self.store.snapshot().version > self.before.version:
                raise RuntimeError("another writer has committed in the meantime")
            state = {
                name: (name, versions, self.before.last_ids[name])
                for name, versions in self.before.versions.items()
            }
            rows = spark.createDataFrame(list((state | self.entries | self.marks).values()), LOG).coalesce(1)
            rows.write.mode("overwrite").parquet(f"{self.store.path}/log/v={self.before.version + 1}")

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows; gives the rows as written."""
        return self._write(name, rows, False)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Make the rows the table's whole content; gives them as written."""
        return self._write(name, rows, True)

    def _write(self, name: str, rows: DataFrame, replaces: bool) -> DataFrame:
        if name in self.entries:
            raise ValueError(f"{name} is already written in this commit")
        version = self.before.version + 1
        schema = self.store.tables[name]
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
        shaped = rows.select(*columns)
        if name in FOLDERS:
            shaped = shaped.repartition(FOLDERS[name])
        # the highest id is taken as the rows are written
        numbered, seen = "id" in schema.names and name not in FOLDERS, Observation()
        if numbered:
            shaped = shaped.observe(seen, F.max("id").alias("id"))
        # most of what is stored are texts
        writer = shaped.write.mode("overwrite").option("compression", "zstd")
        for column in LOOKUPS.get(name, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if name in FOLDERS:
            writer = writer.partitionBy(FOLDERS[name])
        writer.parquet(f"{self.store.path}/{name}/v={version}")
        written = self.store._files(name, [version])
        last_id = (seen.get["id"] or 0) if numbered else 0
        older = [] if replaces else self.before.versions.get(name, [])
        self.entries[name] = (name, [*older, version], max(last_id, self.before.last_id(name)))
        return written
