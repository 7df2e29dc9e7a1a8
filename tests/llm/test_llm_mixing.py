import random

import numpy as np

from threadshelf.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, start long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def rows_of(seed, n=120):
    r = random.Random(seed)
    return [(i, " ".join("w" * r.randrange(1, 200)), r.choice(["a", "b", "c", None])) for i in range(n)]


def run(spark, rows, **more):
    mix = mixing.Mixture(table(spark, rows), mix=mixing.Mix(**({"block_words": 16, "shard_slots": 32, "bucket_words": 500, "bucket_shards": 4} | more)))
    return mix, [tuple(r) for r in mix.documents().select("id", "size", "source_size", "target", "taken").collect()]


def test_targets_stop_at_twice_the_size_and_are_shared_again():
    t = mixing.targets({"a": 10, "b": 1000, "é": 1000, None: 1000})
    assert t["a"] == 20 and abs(sum(t.values()) - 1.5 * 3010) < 1e-6
    # weights 5 2 1 5: the last is null
    left = 1.5 * 3010 - 20
    assert t[None] == 2000 and abs(t["b"] - (left - 2000) * 2 / 3) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(mixing.permuted(np.arange(1000), 1000, 5)) != list(mixing.permuted(np.arange(1000), 1000, 6))


def test_sources_get_their_targets_and_no_document_more_than_twice(spark):
    rows = rows_of(1) + [(500, None, "a"), (501, "", "only empty"), (502, "one two", "tiny"), (None, "a b c", "b"), (0, "again", "b")]
    _, got = run(spark, rows)
    assert sorted((d, s) for d, s, *_ in got if d is not None) == sorted((d, len((t or "").split())) for d, t, _ in rows if d is not None)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    by = {}
    for _, size, source_size, target, taken in got:
        x = by.setdefault((source_size, target), [0, 0])
        x[0] += size
        x[1] += taken
    for (source_size, target), (size, taken) in by.items():
        assert size % max(source_size, 1) == 0 and abs(taken - target) <= 1
    assert sorted(map(str, run(spark, rows)[1])) == sorted(map(str, got))


def test_spans_hold_the_words_that_are_taken(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(n)), s) for i, (n, s) in enumerate([(40, "a"), (7, "a"), (100, "b"), (3, None)])]
    mix, got = run(spark, rows)
    spans = mixing.span_texts(mix.spans(), table(spark, rows)).collect()
    taken = {}
    for s in spans:
        assert s["text"].split() == [f"d{s['id']}w{j}" for j in range(s["first_word"], s["first_word"] + s["words"])]
        taken[s["id"]] = taken.get(s["id"], 0) + s["words"]
    assert {d: t for d, _, _, _, t in got if t} == taken
    slots = {}
    for s in spans:
        slots.setdefault((s["shard"], s["slot"]), set()).add((s["source"], s["block"]))
        assert s["slot"] < 32
    assert all(len(x) == 1 for x in slots.values())


def test_empty_table(spark):
    assert run(spark, [])[1] == []
    assert run(spark, [(1, None, None)])[1] == [(1, 0, 0, 0.0, 0)]


def test_slots_are_dealt_to_many_tasks(spark, monkeypatch):
    rows = rows_of(3)
    _, once = run(spark, rows)
    monkeypatch.setattr(mixing, "EXPANDED_SLOTS", 10)
    mix, got = run(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, once))
    assert mix.slot_blocks().rdd.getNumPartitions() == int(mix.slots.sum()) // 10 > 8
