"""Matching mentions to books and records."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threadshelf.operators import resolve
from threadshelf.plans.ingest import Models, ingest, resolve_batch
from threadshelf.plans.isbn import ingest_isbns
from threadshelf.schemas import VOLUME_INFO
from threadshelf.sources.tables import Store
from threadshelf.sources.threads import with_origin
from threadshelf.streaming.ingest import ingest_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOOK = "id long, title string, author string, google_books_id string, isbn string"


@pytest.fixture
def books(table):
    return table(
        BOOK,
        (5, "The Hobbit", "Tolkien", "g5", None), (2, "the hobbit", "Other", None, "111"),
        (7, "Émile", "Rousseau", "g7", "222"), (8, "No Author", None, None, None),
    )


@pytest.mark.parametrize(
    "title, author, expected",
    [
        ("THE HOBBIT", "tolkien", 5),
        ("The Hobbit", None, 2),
        ("The Hobbit", "", 2),
        ("The Hobbit", "Nobody", None),
        ("émile", "Rousseau", None),
        ("ÉMILE", "ROUSSEAU", 7),
        ("No Author", "Someone", None),
        ("No Author", "", 8),
    ],
)
def test_title_and_author(books, table, title, author, expected):
    if title == "ÉMILE":
        title = "ÉmilE"
    found = resolve.resolve_mentions(table("title string, author string", (title, author)), books)
    assert found.first().book_id == expected


def test_isbn_requests(books, table):
    asked = table(
        "k int, requested_isbn string, google_books_id string, title string, author string",
        (1, "111", "g5", "x", "y"), (2, "222", None, "The Hobbit", "Tolkien"),
        (3, "999", "g0", "The Hobbit", "TOLKIEN"), (4, "999", None, "New", "One"),
    )
    rows = {r.k: (r.book_id, r.match_kind) for r in resolve.match_isbn_request(asked, books).collect()}
    assert rows == {1: (5, "external_id"), 2: (7, "isbn"), 3: (5, "title_author"), 4: (None, "new")}


def volume(name, description=None, language=None, title=None, authors=None):
    return (name, (title, authors, description, language, None, None))


def candidates(spark, *rows):
    """(title_key, author_key, pos, (id, volumeInfo))."""
    schema = f"title_key string, author_key string, pos int, v struct<id:string,volumeInfo:{VOLUME_INFO.simpleString()}>"
    return spark.createDataFrame(list(rows), schema).select("title_key", "author_key", "pos", "v.*")


@pytest.mark.parametrize(
    "offered, expected",
    [
        ([volume("a", "xx"), volume("b", "yy"), volume("c", "z")], "a"),
        ([volume("a", "x"), volume("b", "long")], "b"),
        ([volume("a"), volume("b", "")], "a"),
        ([volume("a", "very long", "de"), volume("b", "x", "en")], "b"),
        ([volume("a", "very long", "de")], None),
        ([volume("a", None), volume("b", "x")], "b"),
    ],
)
def test_best_candidate(spark, offered, expected):
    rows = [("t", "", i, v) for i, v in enumerate(offered)]
    best = resolve.best_candidates(candidates(spark, *rows), ["title_key"]).collect()
    assert [r.volume.id for r in best] == ([expected] if expected else [])


def test_query_with_author_comes_first(spark, table):
    volumes = candidates(
        spark,
        ("t", "a", 0, volume("both", "x")), ("t", "", 0, volume("alone", "longer")),
        ("u", "a", 0, volume("german", "x", "de")), ("u", "", 0, volume("fallback")),
    )
    keys = table("title_key string, author_key string", ("t", "a"), ("t", "b"), ("t", ""), ("u", "a"), ("w", "a"))
    rows = {(r.title_key, r.author_key): r.volume and r.volume.id for r in resolve.enrich(keys, volumes).collect()}
    assert rows == {("t", "a"): "both", ("t", "b"): "alone", ("t", ""): "alone", ("u", "a"): "fallback", ("w", "a"): None}


def test_first_of_an_external_id_becomes_the_book(books, table):
    rows = table("k int, google_books_id string", (1, "g5"), (2, "x"), (3, "x"), (4, None), (5, None))
    found = {r.k: (r.book_id, r.is_first) for r in resolve.match_external(rows, books, ["k"]).collect()}
    assert found == {1: (5, False), 2: (None, True), 3: (None, False), 4: (None, True), 5: (None, True)}


@pytest.fixture
def run(spark, table):
    def resolve_all(mentions, volumes=(), books=()):
        said = table(
            "external_id string, path array<int>, mention_pos int, title string, author string",
            *[("t1", [i], 0, title, author) for i, (title, author) in enumerate(mentions)],
        )
        known = table(BOOK, *books)
        result = resolve_batch(said, known, candidates(spark, *volumes), last_id=100)
        rows = result.mentions.orderBy("path").collect()
        made = {r.id: (r.title, r.author) for r in result.books.collect()}
        return [(r.book_id, r.outcome) for r in rows], made

    return resolve_all


def test_batch_known_new_and_repeated(run):
    rows, made = run(
        [(" Known ", "A"), ("New", "B"), ("NEW", "b"), ("", "x"), ("New", "C")], books=[(1, "known", "a", None, None)]
    )
    assert rows == [(1, "existing"), (101, "no_description"), (101, "existing"), (102, "no_description")]
    assert made == {101: ("New", "B"), 102: ("New", "C")}


def test_batch_authorless_mention_joins_its_authored_twin(run):
    after, _ = run([("Dune", "Herbert"), ("Dune", "")])
    before, made = run([("Dune", None), ("Dune", "Herbert")])
    assert [b for b, _ in after] == [101, 101]
    assert [b for b, _ in before] == [101, 101]
    assert made == {101: ("Dune", "Herbert")}


def test_batch_unifies_by_external_id_and_corrected_title(run):
    volumes = [
        ("hobit", "tolkein", 0, volume("g1", "A tale.", "en", "The Hobbit", ["Tolkien"])),
        ("the hobbit or", "", 0, volume("g1", "A tale.", "en", "The Hobbit", ["Tolkien"])),
    ]
    rows, made = run(
        [("Hobit", "Tolkein"), ("The Hobbit or", None), ("The Hobbit", "tolkien"), ("the hobbit", "")], volumes
    )
    assert rows == [(101, "added"), (101, "existing"), (101, "existing"), (101, "existing")]
    assert made == {101: ("The Hobbit", "Tolkien")}


def test_batch_external_id_of_a_known_book(run):
    volumes = [("other name", "", 0, volume("g1", "x", "en", "Known", ["A"]))]
    rows, made = run([("Other Name", "")], volumes, [(1, "known", "a", "g1", None)])
    assert rows == [(1, "existing")] and made == {}


def test_only_books_that_are_kept_answer(run):
    volumes = [
        ("b", "y", 0, volume("g2", "d", "en", "C", ["Z"])),
        ("a", "x", 0, volume("g1", "d", "en", "B", ["Y"])),
    ]
    # "B" by "Y" is found as the first book and never looked up, so "C" by "Z" is a book of its own
    rows, made = run([("A", "X"), ("B", "Y"), ("C", "Z")], volumes)
    assert [b for b, _ in rows] == [101, 101, 102]
    assert made == {101: ("B", "Y"), 102: ("C", "Z")}


def test_records_of_one_external_id_are_one_book_only_if_the_first_is_kept(run):
    volumes = [
        ("t", "a", 0, volume("g1", "d", "en", "X", ["B"])),
        ("x", "b", 0, volume("g2", "d", "en", "Y", ["C"])),
        ("y", "c", 0, volume("g2", "d", "en", "Y", ["C"])),
    ]
    rows, made = run([("T", "a"), ("X", "b"), ("Y", "c")], volumes)
    assert [b for b, _ in rows] == [101, 101, 102] and made[102] == ("Y", "C")


@pytest.mark.parametrize("seed", range(4))
def test_random_batches_equal_a_sequence(run, seed):
    r = random.Random(seed)
    titles, authors = "abcde", ["x", "y", "z"]
    said = list(dict.fromkeys((r.choice(titles), r.choice(authors)) for _ in range(14)))
    records = {k: (f"g{r.randrange(4)}", r.choice(titles), r.choice(authors)) for k in said if r.random() < 0.7}
    volumes = [(t, a, 0, volume(g, "d", "en", ft, [fa])) for (t, a), (g, ft, fa) in records.items()]
    books, want = [], []
    for key in said:
        known = [i for i, (t, a, g) in enumerate(books) if (t, a) == key]
        g, title, author = records.get(key, (None, *key))
        if not known and g:
            known = [i for i, book in enumerate(books) if book[2] == g]
        if not known:
            known = [len(books)]
            books.append((title, author, g))
        want.append(101 + known[0])
    rows, made = run(said, volumes)
    assert [b for b, _ in rows] == want
    assert made == {101 + i: (t, a) for i, (t, a, _) in enumerate(books)}


def extractor():
    """Reads 'Title by Author' lines."""

    def model(texts):
        answers = []
        for text in texts:
            found = [line.split(" by ") for line in text.split("\n") if " by " in line]
            answers.append(json.dumps([{"title": t, "author": a} for t, a in found]))
        return answers

    return model


def thread(name, *bodies):
    children = [{"kind": "t1", "data": {"id": str(i), "body": b}} for i, b in enumerate(bodies)]
    return json.dumps([
        {"data": {"children": [{"data": {"id": name, "title": f"Thread {name}", "subreddit": "books"}}]}},
        {"data": {"children": children}},
    ])


THREADS = {
    "a": thread("a", "Dune by Herbert\nEmma by Austen", "[deleted]", "nothing"),
    "b": thread("b", "dune by herbert", "Solaris by Lem"),
}
DESCRIBED = "A long enough description of a desert planet and its spice."


def volumes_for(spark):
    return candidates(
        spark,
        ("dune", "herbert", 0, volume("g1", DESCRIBED, "en", "Dune", ["Frank Herbert"])),
        ("solaris", "", 0, volume("g2", "short", "en", "Solaris", ["Lem"])),
    )


def models():
    return Models(extractor, lambda: lambda texts: ["Summary: spice" for _ in texts])


def contents(store):
    books = {r.id: (r.title, r.author, r.summary, r.status) for r in store.read("books").collect()}
    links = {(r.book_id, r.source_id) for r in store.read("links").collect()}
    sources = {r.external_id: (r.id, r.title, r.metadata) for r in store.read("sources").collect()}
    chunks = {r.doc_id: r.text for r in store.read("chunks").collect()}
    return books, links, sources, chunks


EXPECTED = (
    {1: ("Dune", "Frank Herbert", "spice", "new"), 2: ("Emma", "Austen", None, "new"),
     3: ("Solaris", "Lem", "short", "new")},
    {(1, 1), (2, 1), (1, 2), (3, 2)},
    {"a": (1, "Thread a", '{"subreddit":"books"}'), "b": (2, "Thread b", '{"subreddit":"books"}')},
    {"doc_1": f"Recommended for: Thread a\n\nCategory: Thread a\n\nDune by Frank Herbert\n\nspice\n\n{DESCRIBED}\n\nTags: Thread a",
     "doc_3": "Recommended for: Thread b\n\nCategory: Thread b\n\nSolaris by Lem\n\nshort\n\nshort\n\nTags: Thread b"},
)


def test_ingest_is_whole_and_repeatable(spark, table, tmp_path):
    store = Store(spark, str(tmp_path))
    raw = table("origin string, value string", *THREADS.items(), ("bad", "{"))
    outcomes = ingest(raw, store, volumes_for(spark), models())
    assert sorted(r.outcome for r in outcomes.collect()) == ["added", "added", "existing", "no_description"]
    assert contents(store) == EXPECTED
    assert ingest(raw, store, volumes_for(spark), models()).isEmpty()
    assert contents(store) == EXPECTED
    forced = ingest(raw, store, volumes_for(spark), models(), force=True)
    assert {r.outcome for r in forced.collect()} == {"existing"}
    assert contents(store) == EXPECTED
    assert store.read("comments").count() == 5


def test_an_ingest_writes_texts_once(spark, table, tmp_path, monkeypatch):
    """Comments are written as parsed and as stored, and never as texts to ask about or to join."""
    from threadshelf.plans import lineage

    columns, written = [], lineage._written

    def noted(df, *given):
        columns.append(set(df.columns))
        return written(df, *given)

    monkeypatch.setattr(lineage, "_written", noted)
    store = Store(spark, str(tmp_path))
    raw = table("origin string, value string", *THREADS.items(), ("twin", THREADS["b"]))
    ingest(raw, store, volumes_for(spark), models())
    assert contents(store) == EXPECTED
    assert not [c for c in columns if c & {"body", "_text", "source_text"}]
    rows = {(r.external_id, r.number, r.body) for r in store.read("comments").collect()}
    assert rows == {("a", 0, "Dune by Herbert\nEmma by Austen"), ("a", 1, "[deleted]"), ("a", 2, "nothing"),
                    ("b", 0, "dune by herbert"), ("b", 1, "Solaris by Lem")}
    assert store.read("comments").count() == 5


def test_a_run_that_stops_leaves_nothing(spark, table, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    raw = table("origin string, value string", *THREADS.items())

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr("threadshelf.plans.ingest.build_chunks", stop)
        with pytest.raises(RuntimeError):
            ingest(raw, store, volumes_for(spark), models())
    assert contents(store) == ({}, set(), {}, {})
    ingest(raw, store, volumes_for(spark), models())
    assert contents(store) == EXPECTED


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = Store(spark, str(tmp_path / "store"))

    def run():
        ingest_stream(
            spark, str(landing), str(tmp_path / "checkpoint"), store, volumes_for(spark), models()
        ).awaitTermination()

    (landing / "a.json").write_text(THREADS["a"])
    run()
    (landing / "b.json").write_text(THREADS["b"])
    (landing / "again.json").write_text(THREADS["a"])
    run()
    assert contents(store) == EXPECTED
    run()
    assert contents(store) == EXPECTED


def by_isbn(spark, *rows):
    schema = f"isbn string, pos int, v struct<id:string,volumeInfo:{VOLUME_INFO.simpleString()}>"
    return spark.createDataFrame(list(rows), schema).select("isbn", "pos", "v.*")


def identified(name, title, authors, isbn13, description=None):
    return (name, (title, authors, description, None, [("ISBN_13", isbn13)], None))


def test_books_by_isbn(spark, table, tmp_path):
    store = Store(spark, str(tmp_path))
    landed = by_isbn(
        spark,
        ("10", 0, identified("g1", "Dune", ["Herbert"], "9781", "Sand.")),
        ("11", 0, identified("g1", "Dune, again", ["Herbert"], "9782")),
        ("9781", 0, identified("g3", "Other Dune", ["H"], "9783")),
        ("12", 0, identified("g4", "DUNE", ["herbert"], "9784")),
        ("13", 0, identified("g5", "Emma", None, "9785")),
    )
    asked = table(
        "position long, isbn string",
        *[(i, isbn) for i, isbn in enumerate(["10", "11", "9781", "12", "13", "99", "10", "13"])],
    )
    rows = {r.position: (r.book_id, r.match_kind) for r in ingest_isbns(asked, store, landed).collect()}
    again = "earlier_request"
    assert rows == {
        0: (1, "new"), 1: (1, again), 2: (1, again), 3: (1, again), 4: (2, "new"),
        5: (None, "not_found"), 6: (1, again), 7: (2, again),
    }
    books = {r.id: (r.title, r.author, r.isbn) for r in store.read("books").collect()}
    assert books == {1: ("Dune", "Herbert", "9781"), 2: ("Emma", "Unknown", "9785")}
    chunk = store.read("chunks").collect()
    assert [(c.doc_id, c.text, c.metadata.source_title) for c in chunk] == [
        ("doc_1", "Dune by Herbert\n\nSand.", "")]
    assert store.read("links").isEmpty()
    kinds = {r.match_kind for r in ingest_isbns(asked, store, landed).collect()}
    assert kinds == {"external_id", "isbn", "title_author", "not_found"}
    assert store.read("books").count() == 2


def test_a_refused_lookup_holds_its_mentions_whatever_else_landed(spark, table):
    """The lookup for Ann's book was refused; a record by another author under that title is not it."""
    landed = candidates(
        spark,
        ("title", "", 0, volume("g9", DESCRIBED, "en", "Title", ["Other Author"])),
        ("found", "ann", 0, volume("g1", DESCRIBED, "en", "Found", ["Ann"])),
    )
    said = table(
        "external_id string, path array<int>, mention_pos int, title string, author string",
        ("t", [0], 0, "Title", "Ann"), ("t", [1], 0, "Found", "Ann"), ("t", [2], 0, "Title", ""), ("t", [3], 0, "Lost", "Bob"),
        ("t", [4], 0, "Known", "Ann"),
    )
    refused = table("title_key string, author_key string", ("title", "ann"), ("found", ""), ("lost", ""), ("known", "ann"))
    books = spark.createDataFrame([(7, "Known", "Ann", None)], "id long, title string, author string, google_books_id string")
    result = resolve_batch(said, books, landed, 10, over_quota=refused)
    rows, counts = result.written()
    assert [(list(r.path), r.outcome) for r in rows.orderBy("path").collect()] == [
        ([0], "held"), ([1], "added"), ([2], "added"), ([3], "held"), ([4], "existing")
    ]
    assert counts == {"held": 2, "added": 2, "existing": 1}
    assert {(r.title, r.author) for r in result.books.collect()} == {("Found", "Ann"), ("Title", "Other Author")}


def test_ingest_gives_its_counters(spark, table, tmp_path):
    told = []
    store = Store(spark, str(tmp_path))
    raw = table("origin string, value string", *THREADS.items())
    ingest(raw, store, volumes_for(spark), models(), on_counts=told.append)
    ingest(raw, store, volumes_for(spark), models(), on_counts=told.append)
    assert told == [{"added": 2, "existing": 1, "no_description": 1}, {}]


def test_a_batch_that_was_committed_is_not_read_again(spark, table, tmp_path):
    from threadshelf.streaming.ingest import numbered

    store = Store(spark, str(tmp_path / "store"))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(THREADS["a"])
    read = []

    def process(batch, number):
        read.append(number)
        ingest(batch, store, volumes_for(spark), models(), batch=("s", number))

    each = numbered(process, lambda: store.snapshot().last_batch("s"))
    raw = with_origin(spark.read.text(str(folder), wholetext=True))
    assert store.snapshot().last_batch("s") == -1
    each(raw, 0)
    after = contents(store)
    (folder / "a.json").unlink()  # a second reading would fail
    each(raw, 0)
    assert read == [0] and contents(store) == after and store.snapshot().last_batch("s") == 0
    version = store.snapshot().version
    each(spark.createDataFrame([], "origin string, value string"), 1)
    assert read == [0, 1] and store.snapshot().last_batch("s") == 1 and store.snapshot().version == version + 1


def test_the_index_follows_ingest(spark, table, tmp_path):
    from threadshelf.operators.search import encode_queries
    from threadshelf.plans import vector_index

    store = Store(spark, str(tmp_path))
    raw = table("origin string, value string", *THREADS.items())
    ingest(raw, store, volumes_for(spark), Models(extractor, lambda: lambda texts: ["Summary: spice" for _ in texts]))
    assert {r.doc_id for r in store.read("vectors").collect()} == {r.doc_id for r in store.read("chunks").collect()}
    queries = encode_queries(table("qid long, text string", (1, "solaris lem")), weights=store.read("weights"))
    best = vector_index.search_index(queries, store, 1, probes=64).first()
    assert best.doc_id == "doc_3"
    assert store.read("frequencies").where("place = -1").agg(F.sum("documents")).first()[0] == 2
