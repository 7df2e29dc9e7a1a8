import random
from collections import Counter

import numpy as np
import pyarrow as pa

from threadshelf.llm import decontaminate as de

SCHEMA = "doc_id long, text string, item long, similarity string"


def grams(words, k=5):
    k = min(k, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def words(text):
    return [n for w in (text or "").split() if (n := de.normal(w))]


def brute(docs, items):
    """Similarity of the best window of every item's length."""
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, said in items:
            x = words(said)
            if not x or not w:
                continue
            k = min(5, len(x))
            its = Counter(grams(x))
            for i in range(max(1, len(w) - len(x) + 1)):
                win = w[i : i + len(x)]
                own = Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                common = sum((own & its).values())
                union = sum(own.values()) + sum(its.values()) - common
                if own and 100 * common >= 75 * union:
                    out[doc, item] = max(out.get((doc, item), 0), common / union)
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 12, 20, 33, 60, 5, 4, 1, 7])]
    items += [(90, "a b a b a b a b a b a b a b"), (91, ""), (92, None), (93, items[2][1])]
    docs = []
    for i in range(60):
        own = [word() for _ in range(r.randrange(0, 80))]
        said = (r.choice(items)[1] or "").split()
        for _ in range(r.randrange(0, 3)):
            if said:
                said[r.randrange(len(said))] = word()
        if r.random() < 0.3:
            said = said[: int(len(said) * 0.8)]
        at = r.randrange(len(own) + 1)
        docs.append((i, ", ".join(own[:at] + said + own[at:]).upper()))
    docs += [(99, "... -- !! ? ..."), (100, None), (101, ""), (102, items[4][1]), (103, "a b a b a b a b a b a b a b a b")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 3, "z") for d in docs], SCHEMA),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long"),
    )


def test_found_items_are_those_of_brute_force(spark):
    docs, items = made(1)
    want = brute(docs, items)
    for size in (16 << 20, 300):  # one pass, and several
        found = de.contaminated(*frames(spark, docs, items), settings=de.Settings(item_bytes=size)).collect()
        assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == want
        assert len(found) == len(want)


def test_the_index_finds_every_fingerprint_within_the_radius():
    r = np.random.default_rng(2)
    items = de.Items(9, 5, list(range(300)), [r.integers(0, 2**63, 5).astype(np.uint64) for _ in range(300)])
    flips = (np.uint64(1) << r.integers(0, 64, (2000, 23)).astype(np.uint64))
    prints = items.prints[r.integers(0, 300, 2000)] ^ np.bitwise_xor.reduce(flips, axis=1)
    found = {(w, i): d for w, i, d in items.within(prints, 23)}
    apart = de.distances(prints, items.prints)
    assert found == {(w, i): apart[w, i] for w, i in zip(*np.nonzero(apart <= 23))}


def test_a_refrain_changed_throughout_is_no_reason_to_miss():
    r = random.Random(5)
    items, docs = [], []
    for i in range(40):
        own = ["w%d" % r.randrange(10**6) for _ in range(100)]
        items.append((i, " ".join(own + ["x%d" % i] * 16)))
        docs.append((i, " ".join(own + ["y%d" % i] * 16)))
    docs.append((99, " ".join(items[0][1].split()[:100] + ["u%d" % i for i in range(16)])))
    finder = de.Finder([t for _, t in items], de.Settings())
    found = list(finder.find_all(pa.array([t for _, t in docs])))
    got = {(docs[row][0], items[f[0]][0]): f[1] for row, hits in found for f in hits}
    assert got == brute(docs, items) and len(got) >= 41
    assert max(f[4] for _, hits in found for f in hits) > de.Settings().radius


def test_documents_that_hold_an_item_go(spark):
    docs, items = made(3)
    d, i = frames(spark, [*docs, (None, items[4][1])], items)
    left = de.drop_contaminated(d, i)
    gone = {doc for doc, _ in brute(docs, items)}
    assert left.columns[0] == "doc_id" and set(left.columns) == set(d.columns)
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(x) for x, _ in [*docs, (None, "")] if x not in gone)


def test_empty_tables(spark):
    docs, items = made(4)
    assert de.contaminated(*frames(spark, [], items)).count() == 0
    assert de.contaminated(*frames(spark, docs, [])).count() == 0


def test_very_long_texts_repeated_rows_and_ties(spark):
    """An item twice in a text of 100,000 words: its first window counts; rows and items that repeat."""
    item = " ".join(f"b{i}" for i in range(30))
    plain = [f"w{i}" for i in range(100_000)]
    long = " ".join([*plain[:60_000], item, *plain[60_000:], item])
    docs = spark.createDataFrame([(1, long, 0, "x"), (1, long, 0, "x"), (2, " ".join(plain), 0, "x"), (3, "la " * 50_000, 0, "x")], SCHEMA)
    items = spark.createDataFrame([(7, item), (7, item), (8, item), (9, "la " * 20)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words) for r in de.contaminated(docs, items).collect())
    assert got == sorted([(1, i, 1.0, 60_000, 30) for i in (7, 8)] * 2 + [(3, 9, 1.0, 0, 20)])
