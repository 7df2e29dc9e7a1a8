"""Landed responses of the bibliographic service."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.schemas import VOLUME_RESPONSE


@dataclass
class Volumes:
    candidates: DataFrame
    quota_errors: DataFrame
    other_errors: DataFrame


def read_volumes(responses: DataFrame) -> Volumes:
    """Split (query columns..., response) into candidate volumes and error rows.

    A response without results has no candidates; `pos` is the place in the result list.
    """
    query = [c for c in responses.columns if c != "response"]
    parsed = responses.select(
        *query, F.from_json("response", VOLUME_RESPONSE).alias("r"), "response"
    )
    failed = F.col("r.error").isNotNull()
    message = F.coalesce("r.error.message", F.lit("unknown error"))
    over_quota = F.contains(F.lower(message), F.lit("quota"))
    errors = parsed.where(failed).select(*query, message.alias("message"), over_quota.alias("quota"))
    found = parsed.where(~failed & (F.coalesce("r.totalItems", F.lit(0)) > 0))
    candidates = found.select(*query, F.posexplode("r.items").alias("pos", "item")).select(
        *query, "pos", F.col("item.id").alias("id"), "item.volumeInfo"
    )
    return Volumes(
        candidates,
        errors.where("quota").drop("quota"),
        errors.where(~F.col("quota")).drop("quota"),
    )
