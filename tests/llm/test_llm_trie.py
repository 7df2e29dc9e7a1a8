import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from threadshelf.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """Turns (role, text) of every conversation, rebuilt as `trie.rebuilt` does."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def model(built):
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    rows = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(node))
        rows.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def run(lists, settings=trie.Settings()):
    found = trie.prefix_trie(lists, settings).select("conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "ends_sha256")
    return sorted(map(tuple, found.collect()), key=str)


def random_rows(seed):
    rng = random.Random(seed)
    texts = ["a", "b", "é🙂", "", None, "long " * 30]
    rows = []
    for c in range(-6, 120):
        if c % 7 == 3:
            continue
        for turn in range(rng.choice((0, 1, 2, 3, 6, 12))):
            rows.append((c, rng.choice((turn, turn, turn, None)), rng.choice(("user", "assistant", None)), rng.choice(texts[: rng.choice((1, 2, 6))])))
    rows += rows[:20] + [(None, 0, "user", "lost"), (2**62, 0, "user", "a")]
    return rows


@pytest.mark.parametrize("settings", [trie.Settings(), trie.Settings(3, 1_000, 1, 2), trie.Settings(1, 10**6, 2, 4)])
def test_nodes_against_all_prefixes(spark, settings):
    rows = random_rows(settings.least)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS n", "2 AS conv", "3 AS turns")
    assert run(trie.rebuilt(df), settings) == model(sequences(rows))


def lists_of(spark, built):
    rows = [(c, [(hashlib.md5(repr(t).encode()).digest(), len(t[1].encode())) for t in turns]) for c, turns in built.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<key:binary,bytes:long>>")


def test_long_shared_prefixes_and_copies_burst_in_few_rounds(spark):
    shared = [("user", f"t{i}") for i in range(300)]
    built = {c: shared + [("user", str(c % 50))] for c in range(120)}
    built |= {1000 + i: shared[:i] for i in range(0, 300, 10)}
    built |= {2000 + i: [] for i in range(5)}
    lists = lists_of(spark, built)
    settings = trie.Settings(5, 10**6, 16, 128)
    assert run(lists, settings) == model(built)
    heads = trie.BurstTrie(trie.chained(lists), settings).heads
    assert heads.agg(F.max("depth")).first()[0] == 300
    assert heads.count() == 301


def test_containers_hold_no_more_than_their_capacity(spark):
    rng = random.Random(2)
    built = {c: [("user", str(rng.randrange(3))) for _ in range(rng.randrange(1, 9))] for c in range(600)}
    burst = trie.BurstTrie(trie.chained(lists_of(spark, built)), trie.Settings(20, 10**6, 2, 2))
    inside = burst.contained.where(F.size("keys") > F.col("depth"))
    # a sequence lies under its lowest head, so those that go on alike are no head
    most = inside.groupBy(F.get("keys", F.col("depth"))).count().agg(F.max("count")).first()[0]
    assert most <= 20


def test_no_conversations_and_none_with_turns(spark):
    assert run(trie.turn_lists(spark.createDataFrame([], SCHEMA))) == []
    only = lists_of(spark, {4: [], 2: []})
    assert run(only) == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]


def test_very_long_texts_stay_behind(spark):
    rows = [(c, t, "user", "x" * 2_000_000 if t == 0 else str(c)) for c in (0, 1) for t in range(2)]
    assert run(trie.rebuilt(spark.createDataFrame(rows, SCHEMA))) == model(sequences(rows))
