import random
import re

import numpy as np
import pytest

from threadshelf.llm import ngram_join
from threadshelf.llm.common import mix64
from threadshelf.llm.ngram_join import Bands, Settings, parity, set_keys

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def model(rows, percent=80):
    """{id: (sizes, component)} from all pairs."""
    sets = {}
    for i, (doc, text) in enumerate(rows):
        sets[i] = (doc, shingles(text))
    parent = {doc: doc for doc, _ in rows if doc is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [x for x in sets.values() if x[0] is not None and x[1]]
    for i, (a, sa) in enumerate(items):
        for b, sb in items[:i]:
            common = len(sa & sb)
            if (100 + percent) * common >= percent * (len(sa) + len(sb)):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((doc, len(shingles(text)), root(doc)) for doc, text in rows if doc is not None), key=str)


def run(spark, rows, settings=Settings(), extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS id", "2 AS node", "'x' AS key", "3 AS component", "4 AS n_shingles")
    found = ngram_join.ngram_join(df.repartition(3), settings=settings).collect()
    return sorted((tuple(r) for r in found if r[0] is not None), key=str)


def near(rng, words, share):
    """A text with about the given share of words replaced."""
    return [w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in words]


def planted(seed, n=60):
    rng = random.Random(seed)
    shared = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((1, 3, 5, 6, 9, 14, 30, 80, 300)))]
        if rng.random() < 0.5:
            words = words + shared[: rng.choice((8, 20, 60))]
        for _ in range(rng.choice((1, 1, 2, 4))):
            copy = near(rng, words, rng.choice((0, 0.002, 0.01, 0.03, 0.06)))
            cut = rng.randrange(1 + len(copy) // 8)
            rows.append(" ".join(copy[cut:]) + rng.choice(("", " ", "\n", " Tail")))
    rng.shuffle(rows)
    return list(enumerate(rows))


def sets_at(rng, size, other, common):
    pool = mix64(np.array([rng.getrandbits(63) for _ in range(size + other - common)], np.uint64))
    return np.sort(pool[:size]), np.sort(np.r_[pool[size - common : size], pool[size:]])


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_every_pair_within_the_similarity_shares_a_key(percent):
    rng = random.Random(percent)
    s = Settings(percent=percent)
    bands = Bands(s)
    for _ in range(400):
        size = rng.choice((rng.randrange(1, 12), rng.randrange(1, 60), rng.randrange(1, 900)))
        other = rng.randrange(s.smallest_partner(size), s.largest_partner(size) + 1)
        least = -(-percent * (size + other) // (100 + percent))
        a, b = sets_at(rng, size, other, least)
        assert np.intersect1d(set_keys(a, bands), set_keys(b, bands)).size, (size, other)
        assert int(np.bitwise_count(parity(a) ^ parity(b)).sum()) <= size + other - 2 * least


def test_hot_keys_are_made_up_for():
    """Whatever keys are skipped, the second index finds the pairs that lose all others."""
    rng = random.Random(8)
    bands = Bands(Settings())
    bits = 0
    shift = 64 - ngram_join.KEY_BITS - bits
    lost = 0
    for _ in range(400):
        size = rng.choice((rng.randrange(2, 30), rng.randrange(2, 400)))
        other = rng.randrange(bands.s.smallest_partner(size), bands.s.largest_partner(size) + 1)
        least = -(-80 * (size + other) // 180)
        a, b = sets_at(rng, size, other, min(size, other, rng.randrange(least, least + 2)))
        ka, kb = set_keys(a, bands) >> np.uint64(shift), set_keys(b, bands) >> np.uint64(shift)
        both = np.intersect1d(ka, kb)
        others = np.array(rng.sample(list(np.r_[ka, kb]), min(3, len(ka))), np.uint64)
        hot = np.unique(np.r_[both, others])
        again = np.intersect1d(set_keys(a, bands, hot, shift), set_keys(b, bands, hot, shift))
        lost += 1
        assert again.size, (size, other, len(both))
    assert lost


def test_sets_without_hot_keys_do_not_go_in_again():
    a = np.sort(mix64(np.arange(1, 200, dtype=np.uint64)))
    assert not len(set_keys(a, Bands(Settings()), np.array([5], np.uint64), 24))


def test_bands_hold_all_partners():
    bands = Bands(Settings())
    for size in range(1, 3000):
        for partner in (bands.s.smallest_partner(size), bands.s.largest_partner(size)):
            assert abs(bands.of(size) - bands.of(partner)) <= 1


@pytest.mark.parametrize("settings", [Settings(open_pairs=0.4, bucket_keys=200), Settings(percent=60, open_pairs=1.0)])
def test_documents_against_all_pairs(spark, settings):
    rows = planted(int(settings.open_pairs * 10) + settings.percent)
    assert run(spark, rows, settings) == model(rows, settings.percent)


def test_large_groups_and_a_shared_passage(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(70))
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(near(rng, base, 0.01)) for _ in range(120)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((20, 30, 200)))) + " " + passage for _ in range(150)]
    texts += ["same text of some words here"] * 80 + [passage] * 3 + ["p1 p2 p3"] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows, Settings(open_pairs=2.0)) == model(rows)


def test_nulls_empty_long_repeated_and_clashing(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b"), (7, long), (8, long + " end"), (7, long), (9, "x y z"),
        (9, "q r s"), (10, "Q r s"), (11, "q R s"), (None, "a"), (None, None),
    ]
    want = model([r for r in rows if r[0] != 9] + [(9, "x y z"), (9, "q r s")])
    assert run(spark, rows, extra=True) == want
    assert run(spark, []) == []


@pytest.mark.parametrize("bits", [0, 3])
def test_index_entries_keep_keys_nodes_and_marks_in_few_bytes(spark, bits):
    """A block gives its entries back; an entry has its key and a bit, not the place of its document."""
    rng = np.random.default_rng(bits)
    own = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    own[7] = own[8]
    doc = np.sort(rng.integers(0, 40, 20_000))
    doc[:600] = 0
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) << np.uint64(1)
    keys[5000:6000] = keys[:1000]
    block = ngram_join._blocks(keys, own, doc, bits, ngram_join.arrow_schema(ngram_join.BLOCK)).to_pylist()
    short = keys >> np.uint64(64 - ngram_join.KEY_BITS - bits)
    want = {}
    for key, node in zip(short.tolist(), own[doc].tolist()):
        want.setdefault(key, set()).add(node)
    found = {}
    for row in block:
        if row["rest"] is None:
            for key, node, mark in zip(*(x.tolist() for x in ngram_join._unpacked(row))):
                assert found.setdefault((row["bucket"] << ngram_join.KEY_BITS) | key, (node, mark)) == (node, mark)
    assert found == {key: (min(nodes), len(nodes) > 1) for key, nodes in want.items()}
    held = sum(len(x) for row in block if row["rest"] is None for x in row.values() if isinstance(x, bytes))
    assert held < 5.5 * len(found) + 9 * 40 * 2**bits


def test_fine_parities_bound_the_difference_and_fold():
    """Of large sets too, they differ in no more bits than the sets, and tell unlike sets apart."""
    rng = random.Random(12)
    s = Settings()
    for size in (513, 700, 1024, 1500, 5000):
        other = s.largest_partner(size)
        least = -(-80 * (size + other) // 180)
        for common, alike in ((least, True), (size // 2, False)):
            sets = sets_at(rng, size, other, common)
            a, b = (ngram_join.fine_parity(x) for x in sets)
            assert 64 * len(b) >= other and len(b) in (len(a), 2 * len(a))
            a, b = (np.bitwise_xor.reduce(x.reshape(-1, len(a)), axis=0) for x in (a, b))
            assert (int(np.bitwise_count(a ^ b).sum()) <= size + other - 2 * least) == alike
        for x in sets:
            assert (np.bitwise_xor.reduce(ngram_join.fine_parity(x).reshape(-1, ngram_join.PARITY_WORDS), axis=0) == parity(x)).all()
    assert ngram_join.fine_parity(sets[0][:512]) is None


def test_whole_sets_of_large_unlike_documents_are_not_read(spark):
    """Halves in common meet in many buckets and fill the short parity; only alike sets are gathered."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, small = words(1500), words(505)
    rows = [(i, " ".join(shared + words(1500 + 10 * i))) for i in range(6)]
    rows += [(6, rows[0][1] + " end"), (7, " ".join(small)), (8, " ".join(small + words(20))), (9, " ".join(small[:300] + words(300)))]
    rows += [(10, rows[1][1]), (None, rows[2][1]), (2, rows[2][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    join = ngram_join.NGramJoin(df)
    held = {len(r["shingles"]) for part in join.sets for r in part.select("shingles").collect()}
    assert held == {len(shingles(rows[i][1])) for i in (0, 6, 7, 8)}
    # the row without an id belongs to its set
    assert run(spark, rows) == model(rows)


@pytest.mark.parametrize("percent", [30, 60, 80])
def test_large_documents_against_all_pairs(spark, percent):
    rng = random.Random(percent)
    base = [f"b{i}" for i in range(2200)]
    rows = []
    for i in range(24):
        words = near(rng, base[: rng.choice((500, 540, 1020, 1100, 2200))], rng.choice((0, 0.005, 0.02, 0.04, 0.07)))
        rows.append((i, " ".join(words + [f"t{rng.randrange(10**6)}" for _ in range(rng.choice((0, 30, 200)))])))
    assert run(spark, rows, Settings(percent=percent)) == model(rows, percent)
