import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from threadshelf.llm import neardup
from threadshelf.llm.common import Grams, word_hashes

SCHEMA = "doc_id long, text string, source string"


def words(r, n):
    return ["w%d" % r.randrange(3000) for _ in range(n)]


def texts(seed, groups=6, copies=7):
    """Groups of near copies around the limit, exact copies, short and empty texts."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = words(r, r.choice([20, 60, 150]))
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(1 + len(own) // 25)):
                own[r.randrange(len(own))] = "x%d" % r.randrange(10**6)
            out.append(" ".join(own))
    out += [out[0], out[0].upper(), out[5] + " ", "", None, "a b", "A  b", "a b c", " \n\t", "one"]
    r.shuffle(out)
    return out


def brute(rows):
    """The smallest id reachable, with sets of word tuples."""
    found = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        found.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = found[i], found[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (a and b and 100 * len(a & b) >= 75 * len(a | b)):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(((d, len(found[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, settings):
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], SCHEMA)
    got = neardup.near_duplicates(df, settings=settings).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


@pytest.mark.parametrize("open_pairs", [256.0, 0.0])
def test_groups_are_those_of_brute_force(spark, open_pairs):
    # without listed pairs every bucket is worked off pivot by pivot
    rows = list(enumerate(texts(1)))
    assert run(spark, rows, neardup.Settings(open_pairs=open_pairs)) == brute(rows)


def test_repeated_ids_and_null_ids(spark):
    t = texts(2, groups=2, copies=4)
    rows = [(i // 2, x) for i, x in enumerate(t)] + [(None, t[0]), (None, "alone here"), (None, None), (0, t[0])]
    assert run(spark, rows, neardup.Settings()) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], neardup.Settings()) == []


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {x["id"]: x["component"] for x in neardup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: c for x, c in label.items() if x in touched}


def test_sketch_and_bands_follow_similarity(spark):
    r, s = np.random.default_rng(4), neardup.Settings()
    multipliers = neardup._multipliers(s.samples)
    for n in (40, 400, 4000):
        for share, sure in ((1.0, True), (0.75, True), (0.6, False)):
            size = F.lit(n * (1 + share) / 2)
            limit = spark.range(1).select(s.largest_distance(size, size)).first()[0]
            met = near = 0
            for _ in range(100):
                union = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
                r.shuffle(union)
                same = int(np.ceil(n * share))
                extra = (n - same) // 2
                a, b = np.sort(union[: same + extra]), np.sort(np.r_[union[:same], union[same + extra :]])
                x, y = neardup.minhashes(a, multipliers), neardup.minhashes(b, multipliers)
                met += bool((neardup.band_keys(x, s.bands) == neardup.band_keys(y, s.bands)).any())
                bits = neardup.odd_sketch(a, s.bins, s.sketch_words) ^ neardup.odd_sketch(b, s.bins, s.sketch_words)
                near += int(np.bitwise_count(bits).sum()) <= limit
            assert (met == 100 and near == 100) if sure else near <= {40: 50, 400: 5, 4000: 100}[n], (n, share, met, near)


def test_shingle_sets():
    def sets(*texts):
        return [x.tolist() for x in neardup.shingle_sets_of(pa.array(texts, pa.string()), 5)]

    a, b, c, d = sets("a b c d e f", "a b", None, "  ")
    assert (len(a), len(b), len(c), len(d)) == (2, 1, 0, 0)
    a, b = sets("A b c", " a\x0bB\nC\r\n")
    assert a == b
    # only A-Z change, and only ASCII white space divides
    a, b, c, d = sets("É b c", "é b c", "a\u00a0b", "a b")
    assert a != b and c != d


def test_words_are_those_of_a_split():
    texts = ["", " ", "a", " a  b\t\x0b c\x0c", "x\x1cy z\x85w", "é ü\n\n", None, "one two one", "\x00 q"]
    hashes, begins = word_hashes(pa.array(texts, pa.string()).slice(1))
    want = [[xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().split()] for t in texts[1:]]
    assert [hashes[a:b].tolist() for a, b in zip(begins, begins[1:])] == want


def test_gram_hashes_do_not_depend_on_the_place():
    r = np.random.default_rng(1)
    run = r.integers(0, 2**64, 20, dtype=np.uint64)
    whole = np.concatenate([r.integers(0, 2**64, 3000, dtype=np.uint64), run, r.integers(0, 2**64, 50, dtype=np.uint64)])
    for k in (1, 5, 13, 20):
        found = Grams(whole).of(k)
        assert found[3000] == Grams(run).of(k)[0] == Grams(whole).of(k, np.array([3000]))[0]
        assert len(found) == len(whole) - k + 1 and len(set(found.tolist())) == len(found)
    assert len(Grams(run).of(21)) == 0


def test_very_long_texts(spark):
    """Sets that fill the sketch: 60,000 words, a tenth of a hundredth changed, and as many others."""
    a = [f"w{i}" for i in range(60_000)]
    b = [w if i % 1000 else f"x{i}" for i, w in enumerate(a)]
    c = [f"y{i}" for i in range(60_000)]
    got = neardup.near_duplicates(spark.createDataFrame([(5, " ".join(a)), (3, " ".join(b)), (9, " ".join(c))], "doc_id long, text string"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == {(5, 59_996, 3), (3, 59_996, 3), (9, 59_996, 9)}
