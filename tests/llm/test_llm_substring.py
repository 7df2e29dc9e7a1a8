import random

import pytest

from threadshelf.llm import substring

SCHEMA = "doc_id long, text string, kept string, doc long"


def brute(rows, length):
    first = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - length + 1):
            if doc is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if doc is not None and first[tuple(w[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], SCHEMA)
    got = substring.dedup_substrings(df, **more).collect()
    for r in got:
        assert sum(s["words"] for s in r["spans"]) == r["n_removed"]
        assert all(a["first"] + a["words"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str)


def passages(seed, n, vocabulary, length):
    r = random.Random(seed)
    said = [["v%d" % r.randrange(vocabulary) for _ in range(r.randrange(length, 5 * length))] for _ in range(6)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(r.randrange(1, 5)):
            own += ["v%d" % r.randrange(vocabulary) for _ in range(r.randrange(2 * length))]
            passage = list(r.choice(said))
            if r.random() < 0.5:
                passage[r.randrange(len(passage))] = "changed%d" % i
            own += passage[r.randrange(3) :]
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, 5000), (2, 4)])
def test_removed_words_are_those_of_brute_force(spark, seed, vocabulary):
    rows = passages(seed, 40, vocabulary, 13)
    assert run(spark, rows) == brute(rows, 13)


def test_short_windows_and_small_blocks(spark):
    rows = passages(3, 30, 3, 5)
    assert run(spark, rows, length=5, group=2, block_bytes=400) == brute(rows, 5)


def test_nulls_repeats_and_shared_ids(spark):
    rows = passages(4, 12, 50, 13)
    rows = [(i // 3, t) for i, t in rows] + [(None, rows[0][1]), (None, None), (2, None), (5, ""), (6, "few words"), rows[0], rows[0]]
    assert run(spark, rows) == brute(rows, 13)
    assert run(spark, []) == []


def test_layout_and_other_columns(spark):
    same = " ".join("p%d" % i for i in range(20))
    rows = [(1, f"a\n\n{same}", "k", 3), (2, f"  b\t\tc\n{same}\nend of  it ", "k", 4), (3, same, None, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = substring.dedup_substrings(df.withColumnRenamed("kept", "source"), carry=["source", "doc"], layout=True)
    found = {r["doc_id"]: (r["kept"], r["source"], r["doc"]) for r in got.collect()}
    assert found == {1: (f"a\n\n{same}", "k", 3), 2: ("  b\t\tc\nend of  it ", "k", 4), 3: ("", None, 5)}


def test_very_long_texts(spark):
    """150,000 words with a passage of another document at both ends, and in the middle."""
    passage = [f"p{i}" for i in range(40)]
    plain = [f"w{i}" for i in range(150_000)]
    long = passage + plain[:75_000] + passage + plain[75_000:] + passage
    rows = [(1, " ".join(["a", *passage, "b"])), (2, " ".join(long)), (3, " ".join(plain[500:600]))]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[2][1:3] == (150_120, 120) and got[2][3].split() == plain
    assert got[1][2] == 0 and got[3][2] == 100
