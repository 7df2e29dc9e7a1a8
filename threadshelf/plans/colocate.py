"""Tables laid out by a key, so that joins and groups by that key need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from threadshelf.plans.lineage import work_path


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The table as files of `buckets` buckets of the key, sorted by it.

    Two tables with as many buckets of the same key join, and group, where they lie. Give about
    as many buckets as the larger table has 128 MB. A bucket is one task: rows of one key are not
    split, as `lookup_join` splits them, so this is for keys of bounded weight, such as the links
    of a book. The files belong to the running job, like every intermediate result.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    rows.option("path", work_path(spark, "bucketed")).saveAsTable(name)
    table = spark.table(name)
    # the plan knows files and buckets from here on; the catalogue need not
    spark.sql(f"DROP TABLE {name}")
    return table
