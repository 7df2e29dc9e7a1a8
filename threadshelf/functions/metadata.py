"""Expressions over one bibliographic volume record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadshelf.functions import text


def identifier(identifiers: Column, kind: str) -> Column:
    matching = F.filter(identifiers, lambda x: x["type"] == kind)
    return F.try_element_at(matching, F.lit(1))["identifier"]


def preferred_isbn(identifiers: Column) -> Column:
    return F.coalesce(identifier(identifiers, "ISBN_13"), identifier(identifiers, "ISBN_10"))


def joined_authors(authors: Column) -> Column:
    """'A, B', or NULL when there are none."""
    return text.present(F.array_join(authors, ", "))


def purchase_url(title: Column, authors: Column, isbn10: Column, isbn10_is_live: Column) -> Column:
    """Product page when its ISBN-10 is known to resolve, else a search by title and first author."""
    direct = F.concat(F.lit(text.PRODUCT_URL), isbn10)
    search = F.when(
        text.or_empty(title) != "",
        text.product_search_url(title, F.try_element_at(authors, F.lit(1))),
    )
    return F.when(isbn10_is_live, direct).otherwise(search)


def encoded_metadata(**fields: Column) -> Column:
    """JSON object that keeps NULL members; no members at all is NULL."""
    if not fields:
        return F.lit(None).cast("string")
    packed = F.struct(*[column.alias(name) for name, column in fields.items()])
    return F.to_json(packed, {"ignoreNullFields": "false"})
