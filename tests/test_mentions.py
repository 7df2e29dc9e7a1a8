"""Model answers, mentions and summaries."""

import json

import pytest
from pyspark.sql import functions as F

from threadshelf.operators import mentions
from threadshelf.sources import volumes


@pytest.fixture
def parsed(table):
    def run(response):
        df = mentions.parse_extractions(table("k int, response string", (1, response)))
        return [(r.mention_pos, r.title, r.author) for r in df.orderBy("mention_pos").collect()]

    return run


@pytest.mark.parametrize(
    "response, expected",
    [
        ('Sure:\n[{"title":"A","author":"B"},\n {"title":"C"}] done', [(0, "A", "B"), (1, "C", None)]),
        ('It is {"title":"A"} I think', [(0, "A", None)]),
        ('[{"title":"A",}] or {"title":"B"}', []),
        ("nothing here", []),
        ('["A", null, ["x"], {"title":"B"}]', [(3, "B", None)]),
        ('[{"title":5},{"title":null}]', [(0, None, None), (1, None, None)]),
        (None, []),
    ],
)
def test_parse_extractions(parsed, response, expected):
    assert parsed(response) == expected


def test_placeholders_are_no_titles(table):
    said = table(
        "title string",
        ("Real",), ("null",), ("Unknown",), ("N/A",), ("none",), ("",), ("  ",), (None,), ("None of It",),
    )
    kept = [r.title for r in mentions.valid_mentions(said).collect()]
    assert kept == ["Real", "None of It"]


@pytest.mark.parametrize(
    "title, source, kept",
    [
        ("The Hobbit", "I loved the HOBBIT when young", True),
        ("Hallucinated Book", "I loved the hobbit", False),
        ("The Lord of the Rings", "Lord of the Rings is a classic", True),
        ("It", "some random text", True),
        ("Anything Else", "", True),
        ("Éclair tales", "les éclairs", True),
    ],
)
def test_grounding(table, title, source, kept):
    said = table("title string, source_text string", (title, source))
    assert mentions.grounded_mentions(said).count() == int(kept)


LONG = "d" * 60


@pytest.mark.parametrize(
    "description, response, expected",
    [
        ("d" * 49, "ignored", "d" * 49),
        ("d" * 50, "kept", "kept"),
        (None, "x", None),
        (LONG, None, None),
        (LONG, ' "quoted" ', "quoted"),
        (LONG, "Here is a summary: of it", "of it"),
        (LONG, "HERE'S A SUMMARY:\n of it", "of it"),
        (LONG, "Summary: of it", "of it"),
        (LONG, "Here is the summary of it", "of it"),
        (LONG, "Here's the summary:of it", "of it"),
        (LONG, "Summary: Summary: x", "Summary: x"),
        (LONG, "s" * 200, "s" * 200),
        (LONG, "s" * 201, "s" * 197 + "..."),
    ],
)
def test_summaries(table, description, response, expected):
    answers = table("description string, response string", (description, response))
    assert mentions.clean_summaries(answers).first().summary == expected


def test_each_text_is_sent_once_and_one_failure_costs_one_row(table):
    def load():
        def model(texts):
            assert len(set(texts)) == len(texts)
            if "bad" in texts:
                raise ValueError("refused")
            return [t.upper() for t in texts]

        return model

    texts = table("k int, text string", *[(i, "same") for i in range(30)], (30, "bad"), (31, None))
    rows = {r.k: (r.response, r.error) for r in mentions.infer(texts, "text", load).collect()}
    assert len(rows) == 32
    assert rows[0] == rows[29] == ("SAME", None)
    assert rows[30] == (None, "ValueError: refused")
    assert rows[31] == (None, None)


def test_volume_responses(table):
    item = {"id": "v", "volumeInfo": {"title": "T", "authors": ["A"]}}
    answers = [
        {"totalItems": 2, "items": [item, {"id": "w"}]},
        {"totalItems": 0},
        {"error": {"message": "Quota exceeded for x"}},
        {"error": {"message": "boom"}},
        {"error": {}},
    ]
    split = volumes.read_volumes(
        table("q int, response string", *[(i, json.dumps(a)) for i, a in enumerate(answers)])
    )
    assert [(r.q, r.pos, r.id) for r in split.candidates.orderBy("pos").collect()] == [
        (0, 0, "v"), (0, 1, "w")]
    assert [r.q for r in split.quota_errors.collect()] == [2]
    errors = split.other_errors.orderBy("q").select("q", F.col("message")).collect()
    assert [tuple(r) for r in errors] == [(3, "boom"), (4, "unknown error")]
