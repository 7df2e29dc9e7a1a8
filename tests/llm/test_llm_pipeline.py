import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from threadshelf.plans.lineage import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    words = ["w%d" % r.randrange(5000) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture
def folder(spark, tmp_path):
    def make(docs, items):
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def planted():
    r = random.Random(1)
    clean = [prose(r, 120) for _ in range(6)]
    item, passage = " ".join("b%d" % i for i in range(30)), " ".join("p%d" % i for i in range(60)) + "."
    near = clean[0].replace(clean[0].split()[7], "changed", 1)
    texts = [
        *clean, clean[0], near, prose(r, 90) + "\n" + item + ".", clean[5][:200] + ".\n" + prose(r, 90) + "\n" + passage,
        prose(r, 100) + "\n" + passage, "too short", None, "", "a | b | c | d\n" * 60,
    ]
    return [(i, t, None, f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)], [(1, item), (2, None)]


def test_each_stage_catches_its_cases(spark, folder):
    docs, items = planted()
    path = folder(docs, items)
    kept, frame = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = cut(stage(spark, frame, path))
        kept[name] = {r["doc_id"]: r for r in frame.collect()}
        if name != "source_mix":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
    assert set(kept["quality_rules"]) == set(range(11))
    assert set(kept["near_duplicates"]) == set(range(11)) - {6, 7}
    substrings = kept["substring_dedup"]
    assert "p30" in substrings[9]["text"] and "p30" not in substrings[10]["text"]
    assert set(substrings) == set(kept["near_duplicates"])
    assert all(substrings[i]["text"] == docs[i][1] for i in range(6))
    assert set(kept["benchmark_decontamination"]) == {0, 1, 2, 3, 4, 5, 9, 10}
    mixed = kept["source_mix"]
    assert set(mixed) == {0, 1, 2, 3, 4, 5, 9, 10} and all(r["taken"] <= 2 * r["size"] for r in mixed.values())
    assert [tuple(r) for r in sorted(corpus_pipeline.run(spark, path).collect())] == [tuple(mixed[i]) for i in sorted(mixed)]


CLASHES = "n_words n_removed spans kept doc marks starts carried item item_id similarity first_word distance row found size source_size target taken id _others _row a b".split()


def test_other_columns_may_have_any_name(spark, folder):
    docs, items = planted()
    path = folder(docs, items)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    more = frame.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        frame, more = cut(stage(spark, frame, path)), cut(stage(spark, more, path))
        assert sorted(map(tuple, more.select(frame.columns).collect()), key=str) == sorted(map(tuple, frame.collect()), key=str), name
        if name != "source_mix":
            assert more.columns == [*frame.columns, *CLASHES]
            assert all(r[c] == f"{c} {r['doc_id']}" for r in more.collect() for c in CLASHES)


def test_empty_tables(spark, folder):
    path = folder([], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_repeated_and_null_ids(spark, folder):
    r = random.Random(2)
    one, two = prose(r, 80), prose(r, 80)
    path = folder([(1, one, "en", "a", 0), (1, one, "en", "a", 0), (2, two, "en", "a", 0), (2, one, "en", "a", 0), (None, two, "en", None, 0)], [(1, "x")])
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, path).collect()) == ["1", "None"]


# --- the first four stages once more, in plain Python

WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_rules(spark, docs):
    """Judged one document at a time: stage 1 depends on no other document."""
    from threadshelf.llm import quality

    found = {}
    for row in quality.judge_documents(spark.createDataFrame(docs, SCHEMA)).collect():
        if row["kept"]:
            found[row["doc_id"]] = row["clean_text"]
    return found


def one_of_each_group(texts):
    sets, root = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 175 * common >= 75 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in texts.items() if find(d) == d}


def without_earlier_windows(texts, n=13):
    first = {}
    for d, t in texts.items():
        w = WORDS.findall(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in texts.items():
        w = WORDS.findall(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        if kept or not gone:
            out[d] = kept
    return out


def test_the_first_stages_against_plain_python(spark, folder):
    r = random.Random(31)
    passages = ["Part %d %s." % (i, " ".join("p%dx%d" % (i, j) for j in range(30))) for i in range(3)]
    items = [" ".join("b%dx%d" % (i, j) for j in range(25)) for i in range(3)]
    texts = [prose(r, r.randrange(60, 160)) for _ in range(25)]
    for i in range(25):
        words = texts[r.randrange(25)].split(" ")
        words[r.randrange(len(words))] = "changed"
        extra = r.choice(("", "\n" + r.choice(passages), "\n" + r.choice(items) + ".", "\nMenu | Home | News | More"))
        texts.append(" ".join(words) + extra if i % 2 else prose(r, 90) + extra)
    docs = [(i, t, None, f"s{i % 3}", 0) for i, t in enumerate(texts)]
    path = folder(docs, [(i, t) for i, t in enumerate(items)])
    want = without_earlier_windows(one_of_each_group(kept_by_rules(spark, docs)))
    clean = {d: w for d, w in want.items() if not any(f" {i} " in f" {' '.join(w).replace('.', '')} " for i in items)}
    frame = spark.read.parquet(f"{path}/documents.parquet")
    found = []
    for _, stage in corpus_pipeline.STAGES:
        frame = cut(stage(spark, frame, path))
        found.append(frame)
    assert {x["doc_id"]: WORDS.findall(x["text"]) for x in found[2].collect()} == want
    assert {x["doc_id"]: WORDS.findall(x["text"]) for x in found[3].collect()} == clean
    assert 0 < len(clean) < len(want) < len(docs)
    # the mix: sizes of what is left, targets of the sources, and no document more than twice
    mixed = {x["doc_id"]: x for x in found[4].collect()}
    assert {d: x["size"] for d, x in mixed.items()} == {d: len(w) for d, w in clean.items()}
    by_source = {}
    for x in mixed.values():
        s = by_source.setdefault(x["source"], [0, 0, x["target"], x["source_size"]])
        s[0], s[1] = s[0] + x["size"], s[1] + x["taken"]
        assert 0 <= x["taken"] <= 2 * x["size"]
    assert all(size == told and abs(taken - target) <= 1 for size, taken, target, told in by_source.values())
    from threadshelf.llm.mixing import targets

    assert {s: x[2] for s, x in by_source.items()} == pytest.approx(targets({s: x[0] for s, x in by_source.items()}))
