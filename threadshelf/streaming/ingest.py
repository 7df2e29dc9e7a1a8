"""Repeated ingest of a landing folder as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from threadshelf.plans.ingest import Models, ingest
from threadshelf.plans.lineage import scratch
from threadshelf.plans.maintenance import tidy
from threadshelf.sources.tables import Store
from threadshelf.sources.threads import with_origin
from threadshelf.sources.volumes import Volumes


def thread_stream(spark: SparkSession, landing: str, whole_files: bool = True) -> DataFrame:
    """New files of raw threads as (origin, value): one thread per file or per line."""
    lines = spark.readStream.format("text").option("wholetext", whole_files).load(landing)
    return with_origin(lines)


def start(
    stream: DataFrame,
    checkpoint: str,
    process: Callable[[DataFrame, int], object],
    last_batch: Callable[[], int] | None = None,
) -> StreamingQuery:
    """Process all files that are new since the last run, then stop.

    A micro-batch that is run again after it was committed is known by its number and passed
    over before any of it is read.
    """
    return (
        stream.writeStream.foreachBatch(numbered(process, last_batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def numbered(
    process: Callable[[DataFrame, int], object], last_batch: Callable[[], int] | None = None
) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, batch_id: int) -> None:
        if last_batch and batch_id <= last_batch():
            return
        # nothing of a batch stays but what it commits
        with scratch(batch.sparkSession):
            process(batch, batch_id)

    return each


def ingest_stream(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    store: Store,
    volumes: DataFrame | Volumes,
    models: Models,
    whole_files: bool = True,
    force: bool = False,
) -> StreamingQuery:
    """Index the threads that landed since the last run; those already indexed are skipped.

    The stream is known by its checkpoint. Tables of many small batches are put together.
    """
    stream = thread_stream(spark, landing, whole_files)

    def process(batch: DataFrame, batch_id: int) -> None:
        ingest(batch, store, volumes, models, force=force, batch=(checkpoint, batch_id))
        tidy(store)

    return start(stream, checkpoint, process, lambda: store.snapshot().last_batch(checkpoint))
