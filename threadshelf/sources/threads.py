"""Discussion threads: raw JSON text to a header table and a comment table.

Two layouts are read: the site's listing (a two-element array, the comments being a
recursive tree) and a normalised object with a flat comment list.

Replies nest without bound, which no column type describes, so each document is walked in
an Arrow batch function, which numbers the comments. One narrow pass turns it into a row with a comment array; all
else is column expressions on that.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadshelf.functions import text
from threadshelf.plans.lineage import cut
from threadshelf.plans.skew import lookup_join

# Threads held as Python objects at a time.
THREADS_AT_ONCE = 256

HEADER_COLUMNS = ["external_id", "title", "selftext", "subreddit", "url"]

COMMENT = "number int, last int, spot int, depth int, comment_id string, body string, score int"
THREAD_ROW = (
    "origin string, layout string, external_id string, title string, selftext string, "
    f"subreddit string, url string, comments array<struct<{COMMENT}>>, value string"
)
THREAD_BATCH = pa.schema(
    [
        ("origin", pa.string()),
        ("layout", pa.string()),
        *[(name, pa.string()) for name in HEADER_COLUMNS],
        (
            "comments",
            pa.list_(
                pa.struct(
                    [
                        ("number", pa.int32()),
                        ("last", pa.int32()),
                        ("spot", pa.int32()),
                        ("depth", pa.int32()),
                        ("comment_id", pa.string()),
                        ("body", pa.string()),
                        ("score", pa.int32()),
                    ]
                )
            ),
        ),
        ("value", pa.string()),
    ]
)


_COMMENTS = THREAD_BATCH.field("comments").type.value_type
PATHS_BATCH = pa.schema(
    [("origin", pa.string()), ("comments", pa.list_(pa.struct([("path", pa.list_(pa.int32())), *_COMMENTS])))]
)


@dataclass
class Threads:
    """Tables of one scan; `origin` (the file of a thread) links them."""

    headers: DataFrame
    comments: DataFrame
    quarantined: DataFrame


def read_thread_files(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Raw threads, one per file or one per line, as (origin, value)."""
    return with_origin(spark.read.text(path, wholetext=whole_files))


def with_origin(lines: DataFrame) -> DataFrame:
    """Name each raw thread after its file."""
    return lines.select(F.col("_metadata.file_path").alias("origin"), "value")


def parse(raw: DataFrame) -> DataFrame:
    """Raw threads (origin, value) as one row each: layout, header fields and comments.

    `layout` is listing, object or unreadable; only unreadable rows keep their `value`. Comments
    are numbered from 0 in reading order; `last` is the largest number among a comment and its
    replies at any depth, and `spot` its position among its siblings.
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, THREADS_AT_ONCE):
                some = batch.slice(start, THREADS_AT_ONCE).to_pylist()
                rows = [{"origin": r["origin"], **_row(r["value"])} for r in some]
                yield pa.RecordBatch.from_pylist(rows, schema=THREAD_BATCH)

    return raw.select("origin", "value").mapInArrow(walk, THREAD_ROW)


def parse_once(raw: DataFrame) -> DataFrame:
    """Parsed threads, written down, each with an `origin` of its own.

    Several threads may come from one file, and the same one more than once.
    """
    return _own_origins(parse(raw))


def _own_origins(parsed: DataFrame) -> DataFrame:
    row = F.monotonically_increasing_id().cast("string")
    return cut(parsed.withColumn("origin", F.concat_ws("#", "origin", row)), "zstd")


def split(parsed: DataFrame, paths: bool = True) -> Threads:
    """Headers, comments and unreadable documents of parsed threads.

    Numbers tell the reading order and, as intervals, what belongs to which branch (`replies_to`).
    With `paths` every comment also has the positions of itself and of the comments above it
    among their siblings; all paths of a chain of replies are quadratic in its length.
    """
    readable = parsed.where(F.col("layout") != "unreadable")
    listed = with_paths(readable.select("origin", "comments")) if paths else readable
    return Threads(
        headers=readable.select("origin", *HEADER_COLUMNS),
        comments=listed.select("origin", F.inline("comments")),
        quarantined=parsed.where(F.col("layout") == "unreadable").select("origin", "value"),
    )


def with_paths(threads: DataFrame) -> DataFrame:
    """(origin, comments) with the `path` of each comment, from the intervals."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, THREADS_AT_ONCE):
                rows = batch.slice(start, THREADS_AT_ONCE).select(["origin", "comments"]).to_pylist()
                for row in rows:
                    above: list[dict] = []
                    for comment in row["comments"] or []:
                        while above and above[-1]["last"] < comment["number"]:
                            above.pop()
                        comment["path"] = [*(above[-1]["path"] if above else []), comment["spot"]]
                        above.append(comment)
                yield pa.RecordBatch.from_pylist(rows, schema=PATHS_BATCH)

    return threads.mapInArrow(walk, f"origin string, comments array<struct<path array<int>, {COMMENT}>>")


def replies_to(comments: DataFrame, chosen: DataFrame, key: str = "origin") -> DataFrame:
    """The branches of the chosen comments (key, number): each with all its replies in order.

    Gives (key, branch, and the comments' columns); a range join inside the thread, with the few
    chosen comments next to their thread's.
    """
    columns = [c for c in comments.columns if c != key]
    heads = comments.join(chosen.select(key, "number").distinct(), [key, "number"], "left_semi")
    heads = heads.select(F.col(key).alias("_key"), F.col("number").alias("branch"), F.col("last").alias("_end"))
    inside = (F.col(key) == F.col("_key")) & F.col("number").between(F.col("branch"), F.col("_end"))
    return comments.join(heads, inside).select(key, "branch", *columns)


def _row(value: str) -> dict:
    return _read(value) or {"layout": "unreadable", "value": value}


def _read(value: str) -> dict | None:
    """One thread as a row, or None if it is malformed."""
    try:
        return _walk(json.loads(value))
    except RecursionError:
        return _read_deep(value)
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None


class _DeepDecoder(json.JSONDecoder):
    """The library's own decoder in Python, whose nesting is bounded by the recursion limit only."""

    def __init__(self):
        super().__init__()
        self.parse_object = json.decoder.JSONObject
        self.parse_array = json.decoder.JSONArray
        self.parse_string = json.decoder.py_scanstring
        self.scan_once = json.scanner.py_make_scanner(self)


def _read_deep(value: str) -> dict | None:
    """Read nesting beyond what the fast decoder takes."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000_000)
    try:
        return _walk(_DeepDecoder().decode(value))
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):
        return None
    finally:
        sys.setrecursionlimit(limit)


def _walk(doc) -> dict | None:
    if isinstance(doc, list) and len(doc) >= 2:
        post = doc[0]["data"]["children"][0]["data"]
        row = _header(post, "listing", text.THREAD_SITE + (post.get("permalink") or ""))
        row["comments"] = _tree(doc[1]["data"]["children"])
        return row
    if isinstance(doc, dict) and doc:
        row = _header(doc, "object", doc.get("url"))
        listed = doc.get("comments") or []
        row["comments"] = [_comment(i, i, i, c.get("depth") or 0, c) for i, c in enumerate(listed)]
        return row
    return None


def _header(post: dict, layout: str, url: str | None) -> dict:
    return {
        "layout": layout,
        "external_id": post.get("id"),
        "title": post.get("title"),
        "selftext": post.get("selftext") or "",
        "subreddit": post.get("subreddit"),
        "url": url,
    }


def _tree(children: list) -> list[dict]:
    """All comments below; a node that is no comment is left out with its replies."""
    rows: list[dict] = []
    waiting = [(i, 0, child) for i, child in enumerate(children)][::-1]
    above: list[dict] = []
    while waiting:
        spot, depth, node = waiting.pop()
        if node.get("kind") != "t1":
            continue
        data = node.get("data") or {}
        while len(above) > depth:
            above.pop()["last"] = len(rows) - 1
        rows.append(_comment(len(rows), len(rows), spot, depth, data))
        above.append(rows[-1])
        replies = data.get("replies")
        if isinstance(replies, dict):
            below = replies.get("data", {}).get("children", [])
            waiting.extend([(i, depth + 1, child) for i, child in enumerate(below)][::-1])
    for comment in above:
        comment["last"] = len(rows) - 1
    return rows


def _comment(number: int, last: int, spot: int, depth: int, data: dict) -> dict:
    return {
        "number": number,
        "last": last,
        "spot": spot,
        "depth": depth,
        "comment_id": data.get("id"),
        "body": data.get("body") or "",
        "score": data.get("score") or 0,
    }


# Which copy of a thread to read: lower first.
COPY_PRIORITY = {"file": 0, "cache": 1, "fetch": 2}


def latest_raw_copy(copies: DataFrame) -> DataFrame:
    """One raw copy per thread from (source, origin, kind, value).

    A supplied file wins over a cached copy, which wins over a fetched one. A cached copy
    that cannot be read is passed over; a malformed supplied file is not. A copy is known by
    its source, origin and kind. `latest_parsed` gives the threads themselves.
    """
    return lookup_join(copies, _best_copies(copies, _judged(copies)), COPY, "inner").select("thread", *COPY, "value")


COPY = ["source", "origin", "kind"]


def _judged(copies: DataFrame) -> DataFrame:
    """The names of the copies, cached ones only if they can be read."""
    cached = F.col("kind") == "cache"
    readable = parse(copies.where(cached).select(F.to_json(F.struct(*COPY)).alias("origin"), "value"))
    names = F.from_json("origin", copies.select(*COPY).schema).alias("copy")
    known = readable.where(F.col("layout") != "unreadable").select(names).select("copy.*")
    return copies.where(~cached).select(*COPY).unionByName(known)


def _best_copies(copies: DataFrame, usable: DataFrame) -> DataFrame:
    priority = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in COPY_PRIORITY.items()])
    source = F.col("source")
    address = F.when(F.startswith(source, F.lit("http")), text.json_url(source)).otherwise(source)
    thread = F.coalesce(text.external_id(source), address)
    best = usable.groupBy(thread.alias("thread")).agg(F.min_by(F.struct(*COPY), F.struct(priority, "origin")).alias("best"))
    return best.select("thread", "best.*")


def latest_parsed(copies: DataFrame) -> DataFrame:
    """The chosen copy of each thread as a parsed row, written down; every copy is read once.

    A copy is judged by the layout it was parsed with, as in `latest_raw_copy`.
    """
    names = F.to_json(F.struct(*COPY))
    parsed = cut(parse(copies.select(names.alias("origin"), "value")))
    told = parsed.select("origin", "layout", F.from_json("origin", copies.select(*COPY).schema).alias("copy"))
    usable = told.where((F.col("copy.kind") != "cache") | (F.col("layout") != "unreadable")).select("copy.*")
    best = _best_copies(copies, usable).select(names.alias("origin"))
    chosen = lookup_join(parsed, best.distinct(), ["origin"], "left_semi")
    return _own_origins(chosen)


def comment_texts(headers: DataFrame, comments: DataFrame, key: str = "origin", place: str = "path") -> DataFrame:
    """Texts to read for mentions, as (key, place, text): the post body, then each comment.

    `place` orders the comments: their path or their number. The post body is taken as it is;
    comment bodies are trimmed, and empty ones and those taken away are dropped.
    """
    before = F.lit(-1) if place == "number" else F.array(F.lit(-1))
    posts = headers.where(F.col("selftext") != "").select(
        key, before.alias(place), F.col("selftext").alias("text")
    )
    bodies = comments.select(key, place, text.strip(F.col("body")).alias("text"))
    kept = bodies.where((F.col("text") != "") & ~F.col("text").isin(text.REMOVED_BODIES))
    return posts.unionByName(kept)


def comment_counts(parsed: DataFrame) -> DataFrame:
    """Number of comments of each parsed thread."""
    readable = parsed.where(F.col("layout") != "unreadable")
    return readable.select("origin", "external_id", F.size("comments").alias("n_comments"))
