from pyspark.sql import functions as F

from threadshelf.llm import chat

SCHEMA = "tree string, node long, parent long, role string, text string, score double"


def run(spark, rows, branches=1):
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.format_paths(df, branches).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("said", chat.loss_text(F.col("pieces")))
    return {(r["tree"], r["branch"]): r for r in out.collect()}


def turns(row):
    return [(t["role"], t["text"]) for t in row["read"]]


def test_branches_are_ranked_by_score(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0),
        ("t", 4, 3, "user", "more", 0.0), ("t", 5, 3, "user", "other", 9.0), ("u", 1, 99, "user", "orphan", None),
    ]
    got = run(spark, rows, None)
    assert turns(got["t", 1]) == [("user", "q"), ("assistant", "good"), ("user", "other")]
    assert [got["t", b]["leaf"] for b in (1, 2, 3)] == [5, 4, 2]
    assert turns(got["u", 1]) == [("user", "orphan")]
    assert set(run(spark, rows, 1)) == {("t", 1), ("u", 1)}


def test_long_chains_and_circles(spark):
    rows = [("t", i, i - 1, "user" if i % 2 else "assistant", f"m{i}", 0.0) for i in range(1, 301)]
    rows += [("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("s", 1, 1, "user", "self", 0.0)]
    got = run(spark, rows)
    assert set(got) == {("t", 1)}
    assert [t for _, t in turns(got["t", 1])] == [f"m{i}" for i in range(1, 301)]


def test_control_strings_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<\\s>", "<s", "</s>\n", "[/INST", "<", "\\", "", "<<SYS>> x <</SYS>>", "é🙂\n\n", "<s><s>"]
    rows = [("t", i, i - 1, "assistant" if i % 2 else odd[i], x, 0.0) for i, x in enumerate(odd)]
    rows.append(("n", 1, None, None, None, None))
    got = run(spark, rows)
    assert turns(got["t", 1]) == [("assistant" if i % 2 else x, x) for i, x in enumerate(odd)]
    assert got["t", 1]["said"] == "".join(odd[1::2])
    assert got["t", 1]["formatted"].count("</s>\n") == len(odd)
    assert turns(got["n", 1]) == [("", "")] and got["n", 1]["said"] == ""


def test_repeated_rows_null_trees_and_empty_table(spark):
    rows = [(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0), (None, 2, 1, "assistant", "b", 0.0)]
    got = run(spark, rows)
    assert turns(got[None, 1]) == [("user", "a"), ("assistant", "b")]
    assert run(spark, []) == {}


def test_flat_conversations(spark):
    df = spark.createDataFrame([(1, 5, "user", "a", 1), (1, 9, "assistant", "b", 1), (1, 9, "assistant", "a", 1), (1, None, "system", "s", 1)], "conv_id long, turn long, role string, text string, node long")
    (row,) = chat.format_paths(chat.chains(df)).select(chat.read_turns(F.col("formatted")).alias("read")).collect()
    assert turns(row) == [("system", "s"), ("user", "a"), ("assistant", "a"), ("assistant", "b")]


def brute_paths(rows):
    """{tree: [(leaf, nodes from the root)]} of all branches, the best first."""
    nodes = {}
    for tree, node, parent, *_, score in rows:
        nodes.setdefault(tree, {})[node] = (parent, score or 0.0)
    out = {}
    for tree, own in nodes.items():
        parents = {p for p, _ in own.values() if p is not None}
        found = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue  # a circle has no root
            mean = sum(own[x][1] for x in path) / len(path)
            found.append((-mean, -len(path), leaf, path[::-1]))
        out[tree] = [(leaf, path) for _, _, leaf, path in sorted(found)]
    return out


def test_random_trees_against_all_paths(spark):
    import random

    r = random.Random(9)
    rows = []
    for tree in range(40):
        n = r.randrange(1, 14)
        for node in range(n):
            parent = None if node == 0 or r.random() < 0.1 else r.randrange(node)
            rows.append((f"t{tree}", node, parent, r.choice(("user", "assistant")), f"{tree} {node}", float(r.randrange(3))))
    got = run(spark, rows, None)
    want = brute_paths(rows)
    assert set(got) == {(tree, i + 1) for tree, paths in want.items() for i in range(len(paths))}
    for tree, paths in want.items():
        for i, (leaf, path) in enumerate(paths):
            assert got[tree, i + 1]["leaf"] == leaf
            assert [t for _, t in turns(got[tree, i + 1])] == [f"{tree[1:]} {x}" for x in path]


def test_other_columns_do_no_harm(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS up", "1 AS depth", "'y' AS formatted", "2 AS leaf", "'z' AS pieces")
    (row,) = chat.format_paths(df, 1).select(chat.read_turns(F.col("formatted")).alias("read")).collect()
    assert turns(row) == [("user", "q"), ("assistant", "a")]
