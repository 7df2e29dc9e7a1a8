"""Model answers to validated mentions and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.functions import text
from threadshelf.plans.lineage import cut
from threadshelf.plans.skew import lookup_join

Model = Callable[[list[str]], list[str]]


def infer(texts: DataFrame, column: str, load_model: Callable[[], Model]) -> DataFrame:
    """Run a model over a text column; adds `response` and `error`.

    Each distinct text is sent once. `load_model` is called once per task; the model
    takes and returns lists. A failing batch is retried text by text, so one bad text
    costs one row.
    """
    keyed = texts.withColumn("_key", _key(column))
    answers = _answered(_distinct(keyed, column), load_model).drop("_text")
    # `lookup_join` writes the answers down, so that no later use runs the model again
    return lookup_join(keyed, answers, ["_key"], wide=True).drop("_key")


def extract(texts: DataFrame, load_model: Callable[[], Model]) -> DataFrame:
    """Valid, grounded mentions (mention_pos, title, author) in the column `text`, with the others.

    What a text mentions is the same wherever it stands, so answers are read and judged once for
    each distinct text, and no text is moved to the rows it stands in.
    """
    keyed = texts.withColumn("_key", _key("text"))
    answers = _answered(_distinct(keyed, "text"), load_model)
    parsed = parse_extractions(answers.select("_key", F.col("_text").alias("source_text"), "response"))
    said = cut(grounded_mentions(valid_mentions(parsed)).drop("source_text"))
    return keyed.drop("text").join(said, "_key").drop("_key")


def _key(column: str) -> Column:
    """128 bits of SHA-256 as bytes, as keys in hex are longer than many a text."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def _distinct(keyed: DataFrame, column: str) -> DataFrame:
    distinct = keyed.groupBy("_key").agg(F.any_value(column).alias("_text"))
    return distinct.where(F.col("_key").isNotNull())


def _answered(distinct: DataFrame, load_model: Callable[[], Model]) -> DataFrame:
    """Distinct texts (_key, _text) with `response` and `error`, from the exchange that found them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            try:
                answers = [(answer, None) for answer in model(list(batch["_text"]))]
            except Exception:
                answers = [_one(model, value) for value in batch["_text"]]
            yield batch.assign(response=[a for a, _ in answers], error=[e for _, e in answers])

    return distinct.mapInPandas(run, "_key binary, _text string, response string, error string")


def _one(model: Model, value: str) -> tuple[str | None, str | None]:
    try:
        return model([value])[0], None
    except Exception as error:
        return None, f"{type(error).__name__}: {error}"


def parse_extractions(responses: DataFrame) -> DataFrame:
    """Explode the `response` column into `mention_pos`, `title` and `author`.

    The outermost [...] of the answer is read, or the outermost {...} where there is no
    bracket pair. Unreadable JSON and entries that are no objects give no rows.
    """
    answer = text.strip(F.col("response"))
    listed = text.present(F.regexp_extract(answer, r"(?s)(\[.*\])", 1))
    single = text.present(F.regexp_extract(answer, r"(?s)(\{.*\})", 1))
    entries = F.coalesce(
        F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>"),
        F.when(listed.isNull(), F.array(F.try_parse_json(single))),
    )
    kept = [c for c in responses.columns if c != "response"]
    exploded = responses.select(*kept, F.posexplode(entries).alias("mention_pos", "entry"))
    objects = exploded.where(F.try_variant_get("entry", "$", "map<string,variant>").isNotNull())

    def text_member(name: str):
        member = F.try_variant_get("entry", f"$.{name}", "variant")
        value = F.try_variant_get("entry", f"$.{name}", "string")
        return F.when(F.schema_of_variant(member) == "STRING", value)

    return objects.select(
        *kept, "mention_pos", text_member("title").alias("title"), text_member("author").alias("author")
    )


def valid_mentions(mentions: DataFrame) -> DataFrame:
    """Drop mentions whose title is missing, blank or a placeholder."""
    return mentions.where(text.real_title(F.col("title")))


def grounded_mentions(mentions: DataFrame, source_text: str = "source_text") -> DataFrame:
    """Keep mentions whose title shares a long word with the text they were read from."""
    title = text.strip(text.or_empty(F.col("title")))
    return mentions.where(text.grounded(title, F.col(source_text)))


def clean_summaries(answers: DataFrame) -> DataFrame:
    """Add `summary`, the tidied form of `response`, the model's answer to `description`."""
    return answers.withColumn(
        "summary", text.clean_summary(F.col("description"), F.col("response"))
    )
