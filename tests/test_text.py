"""String expressions, against Python's own string methods where they exist."""

import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadshelf.functions import metadata, text

SAMPLES = ["", "  a b \n", " x ", "\x1cq\x85", "É à", "a. b. c", "no stop", "* ~ / + é '", "100% &=?"]


@pytest.mark.parametrize("value", SAMPLES)
def test_strip_is_unicode_strip(eval_one, value):
    assert eval_one(text.strip(F.lit(value))) == value.strip()


@pytest.mark.parametrize("value", SAMPLES)
def test_percent_encoding_is_path_quoting(eval_one, value):
    assert eval_one(text.percent_encode(F.lit(value))) == urllib.parse.quote(value)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), min_size=20, max_size=20))
def test_strip_and_quote_on_any_text(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", text.strip(F.col("v")).alias("s"), text.percent_encode(F.col("v")).alias("q"))
    for row in rows.collect():
        assert row.s == row.v.strip()
        assert row.q == urllib.parse.quote(row.v)


def test_ascii_fold_keeps_accented_capitals(eval_one):
    assert eval_one(text.ascii_fold(F.lit("ÉAz"))) == "Éaz"


@pytest.mark.parametrize(
    "value, expected",
    [("One. Two. Three", "One."), ("One.Two", "One.Two"), ("", ""), ("a. ", "a.")],
)
def test_first_sentence(eval_one, value, expected):
    assert eval_one(text.first_sentence(F.lit(value))) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        ("https://site/r/books/comments/ab12/title", "ab12"),
        ("/data/xyz9.json", "xyz9"),
        ("xyz9.json", "xyz9"),
        ("/data/not-alnum.json", None),
        ("plain", None),
    ],
)
def test_external_id(eval_one, source, expected):
    assert eval_one(text.external_id(F.lit(source))) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://s/c/a", "https://s/c/a.json"),
        ("https://s/c/a//", "https://s/c/a.json"),
        ("https://s/c/a.json", "https://s/c/a.json"),
        ("https://s/c/a/?x=1&y=?", "https://s/c/a.json?x=1&y=?"),
        ("https://s/c/a.json?x=1", "https://s/c/a.json?x=1"),
    ],
)
def test_json_url(eval_one, url, expected):
    assert eval_one(text.json_url(F.lit(url))) == expected


@pytest.mark.parametrize("n, expected", [(50, 50), (51, 50)])
def test_ellipsis_of_titles(eval_one, n, expected):
    assert len(eval_one(text.ellipsis(F.lit("x" * n), 50, 47))) == expected


def test_thread_link_falls_back_to_the_id(eval_one):
    assert eval_one(text.thread_link(F.lit(""), F.lit("ab"))) == "https://reddit.com/comments/ab"
    assert eval_one(text.thread_link(F.lit("u"), F.lit("ab"))) == "u"


IDENTIFIERS = "array<struct<type:string,identifier:string>>"


@pytest.mark.parametrize(
    "listed, expected",
    [
        ([("ISBN_10", "1234567890"), ("ISBN_13", "9781234567890")], "9781234567890"),
        ([("ISBN_10", "1234567890")], "1234567890"),
        ([], None),
        (None, None),
    ],
)
def test_preferred_isbn(table, listed, expected):
    df = table(f"ids {IDENTIFIERS}", (listed,))
    assert df.select(metadata.preferred_isbn(F.col("ids"))).first()[0] == expected


@pytest.mark.parametrize(
    "title, authors, live, expected",
    [
        ("The Hobbit", ["J. T", "X"], None, "https://www.amazon.com/s?k=The%20Hobbit%20J.%20T"),
        ("Anonymous", [], None, "https://www.amazon.com/s?k=Anonymous"),
        ("", [], None, None),
        ("The Hobbit", ["J. T"], True, "https://www.amazon.com/dp/123"),
    ],
)
def test_purchase_url(table, title, authors, live, expected):
    df = table("t string, a array<string>, l boolean", (title, authors, live))
    made = metadata.purchase_url(F.col("t"), F.col("a"), F.lit("123"), F.col("l"))
    assert df.select(made).first()[0] == expected


def test_metadata_keeps_missing_members(eval_one):
    made = metadata.encoded_metadata(subreddit=F.lit(None).cast("string"))
    assert eval_one(made) == '{"subreddit":null}'
    assert eval_one(metadata.encoded_metadata()) is None
