"""From raw threads to books, links and chunks, a batch of threads at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadshelf.functions import metadata, text
from threadshelf.operators import changes, mentions, resolve
from threadshelf.operators.catalog import searchable
from threadshelf.operators.chunks import Encoder, build_chunks, count_words, document_frequencies, word_encoder
from threadshelf.plans import vector_index
from threadshelf.plans.ids import number_rows
from threadshelf.plans.lineage import cut, handed_on, job
from threadshelf.plans.settle import Rule, settle
from threadshelf.plans.skew import lookup_join
from threadshelf.sources import threads
from threadshelf.sources.tables import Store
from threadshelf.sources.volumes import Volumes

KEY = resolve.KEY
ORDER = ["external_id", "path", "mention_pos"]
RECORD = ["description", "google_books_id", "isbn", "cover_url", "amazon_url"]
# no_description: stored, but not searchable; held: made no book, as a lookup was over quota
OUTCOMES = ["added", "no_description", "existing", "held"]


@dataclass
class Resolution:
    """`mentions` has book_id and outcome for every mention; `books` are the new books."""

    mentions: DataFrame
    books: DataFrame

    def written(self) -> tuple[DataFrame, dict[str, int]]:
        """The mentions, written down, and how many had each outcome, counted as they were written."""
        seen = Observation()
        counts = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES]
        rows = handed_on(self.mentions.observe(seen, *counts))
        return rows, {name: n for name, n in seen.get.items() if n}

    def counters(self) -> DataFrame:
        """Mentions per outcome, one row each that occurs; the resolution runs once, for its rows."""
        _, counts = self.written()
        return self.mentions.sparkSession.createDataFrame(list(counts.items()), "outcome string, n long")


def resolve_batch(
    found: DataFrame,
    books: DataFrame,
    volumes: DataFrame,
    last_id: int = 0,
    live_links: DataFrame | None = None,
    now: Column | None = None,
    over_quota: DataFrame | None = None,
) -> Resolution:
    """Resolve mentions (external_id, path, mention_pos, title, author) against the catalogue.

    All mentions are first matched to known books by title and author; what is left is
    enriched once per distinct title and author, matched by external catalogue id, and
    merged where it means the same new book. The order of the mentions decides which one
    a new book is made from.

    `over_quota` (title_key, author_key) are lookups that were refused. A mention that would
    have needed one has the outcome `held`: it makes no book, as its record is not known.
    """
    now = F.current_timestamp() if now is None else now
    said = found.withColumns(
        {
            "title": text.strip(text.or_empty(F.col("title"))),
            "author": text.strip(text.or_empty(F.col("author"))),
        }
    )
    said = cut(resolve.with_keys(said.where(F.col("title") != "")))
    order = F.struct(*ORDER)
    first = F.min(F.struct(order.alias("first_order"), F.struct("title", "author").alias("said")))
    keys = said.groupBy(*KEY).agg(first.alias("first")).select(*KEY, "first.*")
    matched = cut(resolve.match_titles(keys, books))
    known = matched.where(F.col("book_id").isNotNull()).select(*KEY, "book_id")
    enriched = _records(matched.where(F.col("book_id").isNull()).drop("book_id"), volumes, live_links)
    if over_quota is not None:
        enriched = _not_refused(cut(enriched), over_quota)
    enriched = cut(resolve.match_column(enriched, books, "google_books_id", "book_id"))
    known = known.unionByName(
        enriched.where(F.col("book_id").isNotNull()).select(*KEY, "book_id")
    )
    fresh = cut(
        enriched.where(F.col("book_id").isNull())
        .drop("book_id")
        .withColumns(
            {
                "final_title": resolve.title_key(),
                "final_author": resolve.author_key(),
                "place": F.struct("first_order", *KEY),
            }
        )
    )
    roots = cut(_settled(fresh))
    kept = fresh.join(roots.where(F.col("place") == F.col("root")).select("place"), "place", "left_semi")
    numbered = number_rows(kept.drop(*KEY, "final_title", "final_author"), ["place"], last_id)
    made = roots.join(
        numbered.select(F.col("place").alias("root"), F.col("id").alias("book_id")), "root"
    ).select(F.col("place.first_order").alias("first_order"), *[F.col("place")[k].alias(k) for k in KEY], "book_id")
    new_books = changes.shaped_books(numbered, now)
    settled = _first_mentions(made, new_books).unionByName(known, allowMissingColumns=True)
    outcome = (
        F.when(F.col("book_id").isNull(), "held")
        .when(F.col("made_at") == order, F.col("made"))
        .otherwise("existing")
    )
    resolved = lookup_join(said, settled, KEY).withColumn("outcome", outcome)
    return Resolution(resolved.select(*ORDER, "title", "author", "book_id", "outcome"), new_books)


def _records(keys: DataFrame, volumes: DataFrame, live_links: DataFrame | None) -> DataFrame:
    """One row per key with the record found for it, or with what was said."""
    tried = resolve.enrich(keys, volumes).withColumn("enriched", F.col("volume").isNotNull())
    record = resolve.metadata_record(tried, live_links)
    return record.select(
        *KEY,
        "first_order",
        "enriched",
        F.coalesce(text.present(F.col("title")), F.col("said.title")).alias("title"),
        F.coalesce(metadata.joined_authors(F.col("authors")), F.col("said.author")).alias("author"),
        *RECORD,
    )


def _not_refused(enriched: DataFrame, over_quota: DataFrame) -> DataFrame:
    """Keys without those for which a lookup was refused that was needed.

    A key is looked up with its author, then, if that finds nothing, by title alone. If the
    first lookup was refused the key waits, whatever has landed for its title.
    """
    refused = over_quota.select(*KEY).distinct()
    told = lookup_join(enriched, refused, KEY, "left_semi")
    alone = refused.where(F.col("author_key") == "").select("title_key")
    untold = lookup_join(enriched.where(~F.col("enriched")), alone, ["title_key"], "left_semi")
    held = told.select(*KEY).unionByName(untold.select(*KEY)).distinct()
    return lookup_join(enriched, held, KEY, "left_anti")


def _settled(fresh: DataFrame) -> DataFrame:
    """(place, root) of what was said and is no known book: the first mention of its new book.

    What was said is answered by the first earlier new book with that title and author, or
    with that title if no author was said, and else by one with its record's external id. A
    title without author and record is answered by any new book of that title, earlier or not.
    """
    bare = ~F.col("enriched") & (F.col("author_key") == "")
    final = F.struct("final_title", "final_author")
    rules = [
        Rule(F.when(F.col("author_key") != "", F.struct(*KEY)), final),
        Rule(F.when(F.col("author_key") == "", F.col("title_key")), F.col("final_title")),
        Rule(F.col("google_books_id"), F.col("google_books_id")),
    ]
    told = settle(fresh.where(~bare), "place", rules)
    # no other asks for what a bare title offers: that would be the same key
    kept = fresh.where(~bare).join(
        told.where(F.col("place") == F.col("root")).select("place"), "place", "left_semi"
    )
    first = kept.groupBy(F.col("final_title").alias("title_key")).agg(F.min("place").alias("root"))
    untold = fresh.where(bare).join(first, "title_key", "left")
    return told.unionByName(untold.select("place", F.coalesce("root", "place").alias("root")))


def _first_mentions(made: DataFrame, new_books: DataFrame) -> DataFrame:
    """Keys of the new books; the key whose first mention made its book says when and what."""
    first = made.groupBy("book_id").agg(
        F.min(F.struct(F.col("first_order").alias("made_at"), *KEY)).alias("first")
    )
    described = text.or_empty(F.col("description")) != ""
    kind = F.when(described, "added").otherwise("no_description").alias("made")
    told = first.join(new_books.select(F.col("id").alias("book_id"), kind), "book_id")
    return made.select(*KEY, "book_id").join(told.select("first.*", "made"), KEY, "left")


@dataclass
class Models:
    """What the user plugs in: mention extraction, summaries, text encoding."""

    load_extractor: Callable[[], mentions.Model]
    load_summariser: Callable[[], mentions.Model] | None = None
    load_encoder: Callable[[], Encoder] = word_encoder


def extract(texts: DataFrame, load_extractor: Callable[[], mentions.Model]) -> DataFrame:
    """Mentions (external_id, path, mention_pos, title, author) in texts (external_id, path, text).

    `path` orders the texts of a thread; it may be a number.
    """
    return mentions.extract(texts, load_extractor)


def summarise(books: DataFrame, load_summariser: Callable[[], mentions.Model] | None) -> DataFrame:
    """Books with `summary` filled from their description."""
    if load_summariser is None:
        answered = books.withColumn("response", F.lit(None).cast("string"))
    else:
        long = F.char_length(text.or_empty(F.col("description"))) >= 50
        answered = (
            mentions.infer(books.where(long), "description", load_summariser)
            .drop("error")
            .unionByName(books.where(~long).withColumn("response", F.lit(None).cast("string")))
        )
    return mentions.clean_summaries(answered).select(*books.columns)


@job
def ingest(
    raw: DataFrame,
    store: Store,
    volumes: DataFrame | Volumes,
    models: Models,
    live_links: DataFrame | None = None,
    force: bool = False,
    now: Column | None = None,
    batch: tuple[str, int] | None = None,
    on_counts: Callable[[dict[str, int]], object] | None = None,
) -> DataFrame:
    """Add raw threads (origin, value) to the store and give the outcome of each mention.

    `on_counts` is told how many mentions had each outcome, once they are written. `batch` is
    the stream and number this call stands for; it goes into the log with the same commit.

    Raw copies (source, origin, kind, value) are also taken; one copy of each thread is read.
    Threads already indexed are skipped unless forced, those whose source names them before
    they are parsed. All tables change in one commit: a run that stops leaves nothing behind,
    and running the same threads again adds nothing.

    The table `set_aside` gets the threads that are unreadable or have no id or title, and
    those with mentions held back because a lookup was over quota; these are indexed but for
    the held mentions, and can be run again with `force`.
    """
    now = F.current_timestamp() if now is None else now
    refused = volumes.quota_errors if isinstance(volumes, Volumes) else None
    candidates = volumes.candidates if isinstance(volumes, Volumes) else volumes
    with store.commit() as commit:
        before = commit.before
        known_sources = before.read("sources")
        if batch:
            commit.mark(*batch)
        if "kind" in raw.columns:
            parsed = threads.latest_parsed(_unread(raw, known_sources, force))
        else:
            parsed = threads.parse_once(raw.select("origin", "value"))
        read = threads.split(parsed, paths=False)
        named = F.col("external_id").isNotNull() & F.col("title").isNotNull()
        one_copy = (
            read.headers.where(named)
            .groupBy("external_id")
            .agg(F.min_by(F.struct(*read.headers.columns), "origin").alias("row"))
            .select("row.*")
        )
        headers = cut(changes.unseen_sources(one_copy, known_sources, force))
        # whole threads are joined, not each comment with the name of its file
        chosen = parsed.join(headers.select("origin"), "origin", "left_semi")
        comments = chosen.select("external_id", F.inline("comments")).drop("spot")
        if force:
            again = headers.select("external_id")
            comments = cut(comments)
            kept = lookup_join(before.read("comments"), again, ["external_id"], "left_anti")
            commit.replace("comments", kept.unionByName(comments))
        else:
            comments = commit.append("comments", comments)
        texts = threads.comment_texts(headers, comments, "external_id", "number").withColumnRenamed("number", "path")
        resolved = resolve_batch(
            extract(texts, models.load_extractor),
            before.read("books"),
            candidates,
            before.last_id("books"),
            live_links,
            now,
            refused,
        )
        outcomes, counts = resolved.written()
        added = commit.append("books", summarise(resolved.books, models.load_summariser))

        described = headers.withColumn(
            "metadata", metadata.encoded_metadata(subreddit=F.col("subreddit"))
        ).select("external_id", "title", "url", "metadata")
        fresh = commit.append(
            "sources",
            changes.new_sources(
                described, known_sources, ["external_id"], before.last_id("sources"), now
            ),
        )
        sources = known_sources.unionByName(fresh).select("id", "external_id", "title")
        placed = outcomes.where(F.col("book_id").isNotNull()).join(
            sources.select(F.col("id").alias("source_id"), "external_id"), "external_id"
        )
        pairs = placed.select("book_id", "source_id").distinct()
        commit.append("links", changes.new_links(pairs, before.read("links"), before.last_id("links")))

        # a new book's chunk names the thread that made it
        first_links = placed.where(F.col("outcome") != "existing").select(
            "book_id", "source_id", F.col("source_id").alias("id")
        )
        weights = before.read("weights")
        made = build_chunks(searchable(added), first_links, sources, models.load_encoder, weights)
        fresh_chunks = commit.append("chunks", made)
        vector_index.extend(commit, fresh_chunks)
        if models.load_encoder is word_encoder:
            commit.append("frequencies", document_frequencies(count_words(fresh_chunks, ["doc_id"])))
        aside = cut(_set_aside(read, read.headers.where(~named), outcomes, before.read("set_aside")))
        if not aside.isEmpty():
            commit.append("set_aside", aside)
    if on_counts:
        on_counts(counts)
    return outcomes


def _unread(copies: DataFrame, sources: DataFrame, force: bool) -> DataFrame:
    """Raw copies of threads that are not indexed yet, as far as their source names them."""
    if force:
        return copies
    named = copies.withColumn("_thread", text.external_id(F.col("source")))
    known = sources.select(F.col("external_id").alias("_thread"))
    return named.join(known, "_thread", "left_anti").drop("_thread")


def _set_aside(
    read: threads.Threads, nameless: DataFrame, outcomes: DataFrame, known: DataFrame
) -> DataFrame:
    """Threads that were not, or not wholly, indexed, and are not set aside yet."""
    nothing = F.lit(None).cast("string")

    def row(origin: Column, external_id: Column, reason: str, value: Column) -> list[Column]:
        return [
            origin.alias("origin"), external_id.alias("external_id"), F.lit(reason).alias("reason"),
            value.alias("value"),
        ]

    source, name = F.col("origin"), F.col("external_id")
    unreadable = read.quarantined.select(*row(source, nothing, "unreadable", F.col("value")))
    unnamed = nameless.select(*row(source, name, "no id or title", nothing))
    held = outcomes.where(F.col("outcome") == "held").select("external_id").distinct()
    waiting = held.select(*row(nothing, name, "over quota", nothing))
    found = unreadable.unionByName(unnamed).unionByName(waiting)
    # a thread keeps its reason and text, whichever file it comes in again
    same = ["external_id", "reason", "value"]
    old = known.select(*[F.col(c).alias(f"_{c}") for c in same]).distinct()
    match = F.lit(True)
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return found.join(old, match, "left_anti")
