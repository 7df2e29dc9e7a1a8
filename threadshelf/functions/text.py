"""String expressions. Every function takes and returns Columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: texts that stand for a body its author or a moderator took away.
REMOVED_BODIES = ["[deleted]", "[removed]"]
# Fixed value: titles a model writes when it found none.
PLACEHOLDER_TITLES = ["null", "unknown", "n/a", "none"]
# Fixed value: lead-ins a model puts before a summary, tried in this order.
SUMMARY_PREAMBLES = [
    "Here is a summary",
    "Here's a summary",
    "Summary:",
    "Here is the summary",
    "Here's the summary",
]

PRODUCT_URL = "https://www.amazon.com/dp/"
PRODUCT_SEARCH_URL = "https://www.amazon.com/s?k="
THREAD_SITE = "https://reddit.com"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def present(text: Column) -> Column:
    """NULL for the empty string, so that coalesce skips it."""
    return F.nullif(text, F.lit(""))


def ascii_fold(text: Column) -> Column:
    """Lower-case A to Z only; accented letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.split(text, f"[{WHITESPACE}]+")


def grounded(title: Column, source_text: Column) -> Column:
    """True unless the title has long words and none of them occurs in the source text."""
    long_words = F.filter(words(F.lower(title)), lambda w: F.char_length(w) > 3)
    haystack = F.lower(source_text)
    return (
        (or_empty(source_text) == "")
        | (F.size(long_words) == 0)
        | F.exists(long_words, lambda w: F.contains(haystack, w))
    )


def real_title(title: Column) -> Column:
    trimmed = strip(or_empty(title))
    return (trimmed != "") & ~F.lower(trimmed).isin(PLACEHOLDER_TITLES)


def first_sentence(text: Column) -> Column:
    stop = F.lit(". ")
    return F.when(
        F.contains(text, stop), F.concat(F.substring_index(text, ". ", 1), F.lit("."))
    ).otherwise(text)


def ellipsis(text: Column, longest: int, kept: int) -> Column:
    return F.when(
        F.char_length(text) > longest, F.concat(F.left(text, F.lit(kept)), F.lit("..."))
    ).otherwise(text)


def percent_encode(text: Column) -> Column:
    """URL path quoting: '/' stays, space becomes %20."""
    encoded = F.url_encode(text)
    # Where form encoding and path quoting differ.
    for form, path in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return encoded


def product_search_url(title: Column, author: Column) -> Column:
    query = strip(F.concat(or_empty(title), F.lit(" "), or_empty(author)))
    return F.concat(F.lit(PRODUCT_SEARCH_URL), percent_encode(query))


def thread_link(url: Column, external_id: Column) -> Column:
    return F.coalesce(
        present(url), F.concat(F.lit(THREAD_SITE + "/comments/"), or_empty(external_id))
    )


def external_id(source: Column) -> Column:
    """Thread id named by a URL, else by an alphanumeric .json file name."""
    from_url = F.regexp_extract(source, "/comments/([a-zA-Z0-9]+)", 1)
    from_file = F.regexp_extract(source, r"(?:^|/)([a-zA-Z0-9]+)\.json$", 1)
    return F.coalesce(present(from_url), present(from_file))


def json_url(url: Column) -> Column:
    """Address of the JSON form of a thread page; a query string is kept."""
    mark = F.locate("?", url)
    page = F.when(mark > 0, F.substring_index(url, "?", 1)).otherwise(url)
    query = F.when(mark > 0, F.substr(url, mark)).otherwise(F.lit(""))
    made = F.concat(F.rtrim(page, F.lit("/")), F.lit(".json"), query)
    return F.when(F.endswith(page, F.lit(".json")), url).otherwise(made)


def chunk_key(book_id: Column) -> Column:
    return F.concat(F.lit("doc_"), book_id.cast("string"))


def default_status(status: Column) -> Column:
    return F.coalesce(present(status), F.lit("new"))


def default_source_type(source_type: Column) -> Column:
    return F.coalesce(present(source_type), F.lit("reddit"))


def display_author(author: Column) -> Column:
    return F.coalesce(present(author), F.lit("Unknown"))


def clean_summary(description: Column, response: Column) -> Column:
    """Short descriptions pass through; otherwise tidy the model's answer."""
    text = F.btrim(strip(response), F.lit("\"'"))
    branches = None
    for preamble in SUMMARY_PREAMBLES:
        rest = F.ltrim(F.substr(text, F.lit(len(preamble) + 1)), F.lit(": \n"))
        opening = F.lower(F.left(text, F.lit(len(preamble))))
        match = F.startswith(opening, F.lit(preamble.lower()))
        branches = F.when(match, rest) if branches is None else branches.when(match, rest)
    tidy = ellipsis(branches.otherwise(text), 200, 197)
    short = F.char_length(or_empty(description)) < 50
    return F.when(short, description).otherwise(tidy)
