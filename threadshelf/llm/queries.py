"""The operators over their whole tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadshelf.checks import Tables
from threadshelf.llm import chat, decontaminate, extract, mixing, neardup, ngram_join, quality, repair, sql, substring, tokens, trie, urls, warc
from threadshelf.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    name = function.__name__
    QUERIES[name] = lambda spark, folder: function(Tables(configure(spark), folder))
    if hasattr(sql, name.upper()):
        SQL[name] = getattr(sql, name.upper())
    return function


@register
def op1_near_duplicates(t: Tables) -> DataFrame:
    return neardup.near_duplicates(t.documents)


@register
def op2_html_extraction(t: Tables) -> DataFrame:
    model = extract.fit_frame(extract.labelled_pages(t.spark))
    return extract.extract_text(t.pages, model)


@register
def op3_warc_round_trip(t: Tables) -> DataFrame:
    return warc.round_trip(t.pages)


@register
def op4_decontamination(t: Tables) -> DataFrame:
    return decontaminate.contaminated(t.documents, t.benchmark)


@register
def op5_token_counts(t: Tables) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@register
def op6_url_filter(t: Tables) -> DataFrame:
    """Every page is a capture and, on another day, an entry for its host or the domain above.

    The tables have no lists and no times; both follow from the page's number.
    """
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    page = F.col("page_id")
    captures = t.pages.select("page_id", "url", day(page * 7919 % 730).alias("fetched_at"))
    name = urls.host(F.col("url"))
    above = F.regexp_replace(name, r"^[^.]+\.(.+\.)", "$1")
    log = t.pages.select(
        F.when(page % 4 == 0, above).otherwise(name).alias("domain"),
        F.element_at(F.array(*map(F.lit, urls.ACTIONS)), (F.floor(page / 7) % 3).cast("int") + 1).alias("action"),
        day(page * 104729 % 730).alias("listed_on"),
    )
    return urls.filter_captures(captures, log)


@register
def op7_substring_dedup(t: Tables) -> DataFrame:
    found = substring.dedup_substrings(t.documents)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register
def op8_mixture(t: Tables) -> DataFrame:
    mixed = mixing.Mixture(t.documents).documents()
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register
def op9_quality_rules(t: Tables) -> DataFrame:
    return quality.judge_documents(t.documents).drop("loss", "clean_text")


@register
def op10_chat_format(t: Tables) -> DataFrame:
    spark = t.spark
    same = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(same).alias("text"),
    )
    rows = t.conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = chat.format_paths(chat.chains(rows))
    turns = formatted.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "said", chat.loss_text(F.col("pieces"))
    )
    told = F.transform("read", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n")))
    return turns.select(
        F.col("tree").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@register
def op11_structure_repair(t: Tables) -> DataFrame:
    return repair.repair_damaged(t.conversations)


@register
def op12_ngram_join(t: Tables) -> DataFrame:
    return ngram_join.ngram_join(t.documents)


@register
def op13_prefix_trie(t: Tables) -> DataFrame:
    nodes = trie.prefix_trie(trie.rebuilt(t.conversations))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
