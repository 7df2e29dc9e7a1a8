"""A training corpus from the documents: five stages, each written as Parquet before the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadshelf.llm import decontaminate, mixing, neardup, quality, substring
from threadshelf.plans.lineage import cut
from threadshelf.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed."""
    configure(spark)
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    configure(spark)
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that lose all words go."""
    configure(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # other columns may have the names of the operator's own
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{c}") for c in others]).alias("_others"))
    found = substring.dedup_substrings(packed, carry=["_others"], layout=True).where("n_removed = 0 OR n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select([new[c] if c in new else F.col("_others")[f"_{c}"] for c in docs.columns]).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    configure(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    configure(spark)
    mixed = mixing.Mixture(docs).documents()
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

# Fingerprints, passes over anchors and drawn blocks have no SQL. Tests compare run() with its stages and with
# planted cases; the chain as a whole has no brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
