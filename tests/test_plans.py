"""Helpers that keep plans balanced."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadshelf.plans import skew
from threadshelf.plans.ids import high_water_mark, number_rows
from threadshelf.plans.lineage import cut, scratch, work_path
from threadshelf.plans.settle import Rule, settle
from threadshelf.plans.sizes import fits_broadcast, spread


@pytest.fixture
def hot(spark):
    """A third of 3000 rows on one key."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    return spark.range(3000).select(F.col("id").alias("n"), key.alias("k"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("bound, wide", [(0, False), (1_000_000, False), (0, True)])
def test_lookup_join_equals_join(spark, hot, how, bound, wide):
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = skew.lookup_join(hot, lookup, ["k"], how, wide, bound)
    expected = hot.join(lookup, ["k"], how)
    assert found.count() == expected.count()
    assert found.select(*expected.columns).exceptAll(expected).isEmpty()


def test_lookup_join_is_one_join(spark, hot):
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = skew.lookup_join(hot, lookup, ["k"], max_broadcast_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Union") == 0


def test_null_keys_match_nothing(table):
    facts = table("k string, n int", (None, 1), ("a", 2))
    lookup = table("k string, v int", (None, 5), ("a", 6))
    for bound in (0, 100):
        rows = skew.lookup_join(facts, lookup, ["k"], max_broadcast_rows=bound).collect()
        assert {(r.n, r.v) for r in rows} == {(1, None), (2, 6)}


def test_lists_are_numbered_whole_and_in_order(spark, hot):
    rows = skew.numbered_lists(hot, "k", "n", F.col("n") * 2, "value").collect()
    lists = defaultdict(dict)
    for row in rows:
        lists[row.k][row.position] = row.value
    assert len(rows) == 3000
    assert [lists[0][i] for i in range(1, 1001)] == list(range(0, 6000, 6))
    assert all(sorted(found) == list(range(1, len(found) + 1)) for found in lists.values())


@pytest.mark.parametrize("seed", range(3))
def test_settling_is_going_through_the_entries_in_order(table, seed):
    r = random.Random(seed)
    name = lambda: r.choice([*"abcdefgh", None])
    entries = [(i, name(), name(), name(), name()) for i in range(60)]
    kept, want = [], {}
    for place, ask1, offer1, ask2, offer2 in entries:
        by_first = [k for k in kept if ask1 and k[2] == ask1]
        by_second = [k for k in kept if ask2 and k[4] == ask2]
        answer = (by_first or by_second or [None])[0]
        want[place] = answer[0] if answer else place
        if not answer:
            kept.append((place, ask1, offer1, ask2, offer2))
    df = table("place int, a string, b string, c string, d string", *entries)
    rules = [Rule(F.col("a"), F.col("b")), Rule(F.col("c"), F.col("d"))]
    assert {x.place: x.root for x in settle(df, "place", rules).collect()} == want
    assert settle(df.limit(0), "place", rules).isEmpty()


def test_scratch_is_deleted(spark):
    with scratch(spark):
        path = cut(spark.range(3)).inputFiles()[0]
        assert "/job-" in path
        inside = work_path(spark, "x")
    assert not os.path.exists(path.split(":", 1)[-1].replace("///", "/"))
    assert work_path(spark, "x").rsplit("/", 1)[0] != inside.rsplit("/", 1)[0]


def test_rows_are_numbered_densely_in_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") % 7).alias("m"))
    numbered = number_rows(rows, ["m", "n"], 100).orderBy("id").collect()
    assert [r.id for r in numbered] == list(range(101, 1101))
    assert [(r.m, r.n) for r in numbered] == sorted((r.m, r.n) for r in numbered)


def test_marks_and_sizes(spark):
    assert high_water_mark(spark.range(5)) == 4
    assert high_water_mark(spark.range(0)) == 0
    texts = spark.range(5).select(F.repeat(F.lit("x"), 20_000_000).alias("t"))
    assert fits_broadcast(texts.limit(2)) and not fits_broadcast(texts)
    assert fits_broadcast(spark.range(5), 5) and not fits_broadcast(spark.range(6), 5)


def test_small_scans_are_dealt_out_by_their_bytes(spark, monkeypatch):
    scan = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = spread(scan)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 3, true" in plan
    monkeypatch.setattr("threadshelf.plans.sizes.SPREAD_LIMIT", 1000)
    assert "Repartition" not in spread(scan)._jdf.queryExecution().optimizedPlan().toString()


def test_a_named_shared_folder_is_used(spark):
    from threadshelf.session import shared_dir

    written = cut(spark.range(3))
    assert all(shared_dir(spark).split(":")[-1] in f for f in written.inputFiles())


def sequential(entries):
    """Places and roots by going through (place, asks, offers) one by one."""
    kept, want = {}, {}
    for place, ask, offer in entries:
        want[place] = kept.get(ask, place) if ask is not None else place
        if want[place] == place and offer is not None:
            kept.setdefault(offer, place)
    return want


def settled(table, entries):
    from threadshelf.plans.settle import _Settling

    df = table("place int, a string, b string", *entries)
    run = _Settling(df, "place", [Rule(F.col("a"), F.col("b"))])
    return {x.place: x.root for x in run.run().collect()}, run.steps


def test_a_long_chain_settles_in_few_steps(table):
    chain = [(i, f"k{i - 1}" if i else None, f"k{i}") for i in range(1000)]
    got, steps = settled(table, chain)
    assert got == sequential(chain)
    assert steps <= 12


def test_branching_chains_and_what_is_null(table):
    r = random.Random(1)
    entries = [(i, f"k{r.randrange(max(1, i // 2))}" if r.random() < 0.9 else None, f"k{i // 2}" if r.random() < 0.9 else None) for i in range(400)]
    got, _ = settled(table, entries)
    assert got == sequential(entries)
    nothing = [(i, None, None) for i in range(300)]
    assert settled(table, nothing) == ({i: i for i in range(300)}, 1)


def test_two_jobs_at_once_keep_their_files(spark):
    """A job that ends deletes its own files and no other's."""
    import threading

    inside, over = threading.Event(), threading.Event()
    seen = {}

    def long_job():
        with scratch(spark):
            rows = cut(spark.range(5))
            inside.set()
            over.wait(60)
            seen["rows"] = rows.count() + cut(spark.range(2)).count()
            seen["path"] = work_path(spark, "x")

    worker = threading.Thread(target=long_job)
    worker.start()
    assert inside.wait(60)
    with scratch(spark):
        mine = work_path(spark, "y")
        cut(spark.range(3))
    over.set()
    worker.join()
    assert seen["rows"] == 7
    assert seen["path"].rsplit("/", 1)[0] != mine.rsplit("/", 1)[0]


def test_a_folder_in_the_warehouse_where_none_is_named(spark, monkeypatch):
    from threadshelf import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/shared/warehouse/"}.get(key, default)

    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            Context.folder = folder

    class Session:
        conf, sparkContext = Conf(), Context()

    assert session.shared_dir(Session()) == "file:/shared/warehouse/threadshelf-work"
