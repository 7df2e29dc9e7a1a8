"""Reading threads."""

import json

import pytest
from pyspark.sql import functions as F

from threadshelf.sources import threads


def comment(name, replies="", kind="t1", **fields):
    if isinstance(replies, list):
        replies = {"data": {"children": replies}}
    data = {"id": name, "body": f"body {name}", "score": 1, "replies": replies, **fields}
    return {"kind": kind, "data": data}


def listing(*comments, **post):
    header = {"id": "p1", "title": "Title", "selftext": "", "permalink": "/r/b/comments/p1/", **post}
    return [
        {"data": {"children": [{"data": header}]}},
        {"data": {"children": list(comments)}},
    ]


def chain(depth):
    node = ""
    for i in range(depth - 1, -1, -1):
        node = '{"data":{"children":[{"kind":"t1","data":{"id":"c%d","body":"b","replies":%s}}]}}' % (
            i, node or '""')
    return '[{"data":{"children":[{"data":{"id":"x","title":"T"}}]}},%s]' % node


@pytest.fixture
def read(table):
    def run(*documents):
        values = [d if isinstance(d, str) else json.dumps(d) for d in documents]
        raw = table("origin string, value string", *[(f"f{i}", v) for i, v in enumerate(values)])
        return threads.split(threads.parse(raw))

    return run


def ordered(found):
    return found.comments.orderBy("origin", "path").collect()


def test_header_fields(read):
    row = read(listing(selftext="Hi", subreddit="books")).headers.first()
    assert (row.external_id, row.title, row.selftext, row.subreddit) == ("p1", "Title", "Hi", "books")
    assert row.url == "https://reddit.com/r/b/comments/p1/"


def test_tree_is_flattened_in_reading_order(read):
    tree = listing(
        comment("a", [comment("a1", [comment("a11")]), comment("a2")]), comment("b"), comment("c")
    )
    rows = ordered(read(tree))
    assert [r.comment_id for r in rows] == ["a", "a1", "a11", "a2", "b", "c"]
    assert [r.depth for r in rows] == [0, 1, 2, 1, 0, 0]
    assert [list(r.path) for r in rows][:3] == [[0], [0, 0], [0, 0, 0]]


def test_other_nodes_go_with_their_replies(read):
    rows = ordered(read(listing(comment("m", [comment("m1")], kind="more"), comment("b"))))
    assert [r.comment_id for r in rows] == ["b"]


def test_many_siblings_keep_their_order(read):
    rows = ordered(read(listing(*[comment(f"c{i}") for i in range(25)])))
    assert [r.comment_id for r in rows] == [f"c{i}" for i in range(25)]


@pytest.mark.parametrize("depth", [3, 120, 250, 3000])
def test_deep_chains_are_read_whole(read, depth):
    found = read(chain(depth))
    assert found.comments.agg(F.max("depth"), F.count("*")).first() == (depth - 1, depth)
    assert found.quarantined.isEmpty()


@pytest.mark.parametrize("bad", ["[]", "{}", '{"a":', "5", '[{"data":{}},{}]', '[1]'])
def test_malformed_threads_are_set_aside(read, bad):
    found = read(listing(comment("a")), bad)
    assert found.quarantined.collect() == [("f1", bad)]
    assert found.headers.count() == 1


def test_normalised_objects(read):
    doc = {"id": "n", "title": "N", "url": "u", "comments": [{"body": "x", "depth": 2}, {"body": "y"}]}
    found = read(doc, {"id": "m", "title": "M"})
    assert [r.url for r in found.headers.orderBy("external_id").collect()] == [None, "u"]
    assert [(r.body, r.depth) for r in ordered(found)] == [("x", 2), ("y", 0)]


def test_files_are_read_whole_or_by_line(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"t{i}.json").write_text(json.dumps(listing(comment("a"), id=f"t{i}"), indent=1))
    raw = threads.read_thread_files(spark, str(tmp_path))
    assert threads.split(threads.parse(raw)).headers.count() == 2
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "all.jsonl").write_text("\n".join(json.dumps(listing(id=f"l{i}")) for i in range(3)))
    raw = threads.read_thread_files(spark, str(lines), whole_files=False)
    assert threads.split(threads.parse(raw)).headers.select("external_id").distinct().count() == 3


def test_comment_texts(table):
    headers = table("origin string, selftext string", ("a", "[deleted]"), ("b", " \t"), ("c", ""))
    comments = table(
        "origin string, path array<int>, body string",
        ("a", [0], "[deleted]"), ("a", [1], " [removed]\n"), ("a", [2], "\t"), ("a", [3], " ok "),
    )
    rows = threads.comment_texts(headers, comments).orderBy("origin", "path").collect()
    assert [(r.origin, list(r.path), r.text) for r in rows] == [
        ("a", [-1], "[deleted]"), ("a", [3], "ok"), ("b", [-1], " \t"),
    ]


def test_copies_of_a_thread(table):
    good, bad = json.dumps(listing()), "{"
    copies = table(
        "source string, origin string, kind string, value string",
        ("/comments/a/x", "1", "cache", bad), ("/comments/a/y", "2", "fetch", good),
        ("/comments/b/x", "3", "cache", good), ("b.json", "4", "file", bad),
        ("/comments/c/x", "5", "cache", good), ("/comments/c/x", "6", "fetch", good),
        ("elsewhere", "7", "fetch", good),
        ("https://short/x", "8", "fetch", good), ("https://short/x/", "9", "fetch", good),
    )
    rows = threads.latest_raw_copy(copies).collect()
    assert {(r.thread, r.origin) for r in rows} == {("a", "2"), ("b", "4"), ("c", "5"), ("elsewhere", "7"),
        ("https://short/x.json", "8")}


def test_random_trees_equal_a_recursive_walk(read):
    import random

    rng = random.Random(5)

    def grow(depth):
        nodes = []
        for _ in range(rng.randint(0, 4 - depth) if depth else 4):
            kind = "t1" if rng.random() < 0.85 else "more"
            below = grow(depth + 1) if depth < 4 else ""
            nodes.append(comment(f"c{rng.random()}", below or rng.choice(["", None]), kind))
        return nodes

    def walk(nodes, depth=0):
        for node in nodes:
            if node["kind"] == "t1":
                yield node["data"]["id"], depth
                replies = node["data"]["replies"]
                if isinstance(replies, dict):
                    yield from walk(replies["data"]["children"], depth + 1)

    trees = [grow(0) for _ in range(30)]
    rows = ordered(read(*[listing(*tree) for tree in trees]))
    for i, tree in enumerate(trees):
        found = [(r.comment_id, r.depth) for r in rows if r.origin == f"f{i}"]
        assert found == list(walk(tree))


def chain_of(n):
    """A listing in which every comment has one reply, as text; built from the inside out."""
    node = '""'
    for i in range(n - 1, -1, -1):
        node = '{"data":{"children":[{"kind":"t1","data":{"id":"c%d","body":"b","replies":' % i + node + "}}]}}"
    return '[{"data":{"children":[{"data":{"id":"t","title":"T"}}]}},' + node + "]"


def test_numbers_and_intervals(spark):
    rows = spark.createDataFrame([("x", chain_of(3))], "origin string, value string")
    comments = threads.split(threads.parse(rows), paths=False).comments
    assert "path" not in comments.columns
    assert [(r.number, r.last, r.spot, r.depth) for r in comments.orderBy("number").collect()] == [(0, 2, 0, 0), (1, 2, 0, 1), (2, 2, 0, 2)]


def test_branches_by_range(spark):
    def node(name, *replies):
        below = {"data": {"children": list(replies)}} if replies else ""
        return {"kind": "t1", "data": {"id": name, "body": name, "replies": below}}

    tree = [node("a", node("b", node("c")), {"kind": "more"}, node("d")), node("e", node("f"))]
    listing = [{"data": {"children": [{"data": {"id": "t", "title": "T"}}]}}, {"data": {"children": tree}}]
    comments = threads.split(threads.parse(spark.createDataFrame([("x", json.dumps(listing))], "origin string, value string"))).comments
    rows = comments.orderBy("number").collect()
    assert [(r.comment_id, r.number, r.last, list(r.path)) for r in rows] == [
        ("a", 0, 3, [0]), ("b", 1, 2, [0, 0]), ("c", 2, 2, [0, 0, 0]), ("d", 3, 3, [0, 2]), ("e", 4, 5, [1]), ("f", 5, 5, [1, 0])
    ]
    chosen = spark.createDataFrame([("x", 1), ("x", 4), ("x", 0), ("y", 0), ("x", 99)], "origin string, number int")
    found = threads.replies_to(comments, chosen).orderBy("branch", "number").collect()
    assert [(r.branch, r.comment_id) for r in found] == [(0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "b"), (1, "c"), (4, "e"), (4, "f")]


def test_a_chain_of_replies_is_linear(spark):
    """A chain of 100,000 replies: one small row for each."""
    row = threads._row(chain_of(2000))
    assert row["comments"][-1]["depth"] == 1999
    comments = threads._tree(_nested(100_000))
    assert len(comments) == 100_000 and comments[0]["last"] == 99_999
    assert all(c["number"] == c["depth"] and c["last"] == 99_999 for c in comments)
    assert all(not isinstance(v, (list, dict)) for v in comments[-1].values())


def _nested(n):
    node = ""
    for i in range(n - 1, -1, -1):
        node = {"data": {"children": [{"kind": "t1", "data": {"id": f"c{i}", "body": "b", "replies": node}}]}}
    return node["data"]["children"]


def test_parsed_copies_are_judged_by_their_layout(spark):
    good, bad = json.dumps({"id": "x", "title": "T"}), "{"
    copies = spark.createDataFrame(
        [("https://a.example/comments/k1/", "f", "fetch", good), ("https://a.example/comments/k1/", "c", "cache", bad),
         ("https://a.example/comments/k2/", "f", "fetch", good), ("https://a.example/comments/k2/", "c", "cache", good),
         ("https://a.example/comments/k3/", "s", "file", bad), ("https://a.example/comments/k3/", "c", "cache", good)],
        "source string, origin string, kind string, value string",
    )
    chosen = {(r.thread, r.kind) for r in threads.latest_raw_copy(copies).collect()}
    assert chosen == {("k1", "fetch"), ("k2", "cache"), ("k3", "file")}
    parsed = {(json.loads(r.origin.rsplit("#", 1)[0])["kind"], r.layout) for r in threads.latest_parsed(copies).collect()}
    assert parsed == {("fetch", "object"), ("cache", "object"), ("file", "unreadable")}
