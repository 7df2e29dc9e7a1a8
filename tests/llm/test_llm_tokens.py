import public_tokenizers
from tokenizers import Tokenizer

from threadshelf.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b ", "x <|endoftext|> y<|endoftext|>z", "<|endo ftext|>", "a  b", "!\x1c  b", "don't 's5 5's  \n\n x",
    "a\t b", "a \t b \n", "　 x   y", "abc123" * 30000, "q" * 70000, "\n a\n b", "é ü  ß", "x\x85 y", "日本語 テキスト", "🙂 🙂🙂", "a  ", "1 2 3 " * 5000,
]


def test_lengths_are_those_of_whole_texts(spark):
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ODD)] + [(99, None, 9), (0, ODD[0], 9)], "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, tokens.count_tokens(df, PATH).collect()))
    want = []
    for i, t in [*enumerate(ODD), (99, ""), (0, ODD[0])]:
        n = len(library.encode(t, add_special_tokens=False))
        want.append((i, len(t.encode()), n, n > 512))
    assert got == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(df, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert tokens.count_tokens(df, PATH).count() == 0


def test_long_pieces_and_batches():
    text = "a1" * 100_000
    assert "".join(tokens.long_pieces(text)) == text and len(tokens.long_pieces(text)) > 1
    batches = list(tokens.batches_by_bytes(["x" * 10] * 25, 100))
    assert [len(b) for b in batches] == [10, 10, 5]


def test_long_pieces_are_not_remembered():
    """Text without spaces: what a task keeps does not grow with it."""
    counter = tokens.Counter(PATH)
    library = Tokenizer.from_file(PATH)
    for i in range(40):
        text = " ".join(chr(0x4E00 + (i * 7 + j) % 2000) * 1000 for j in range(3)) + " short words come again"
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False))]
    assert len(counter.known) < 10
    assert sum(len(x) for x in counter.known) < 200
