"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.llm.common import slices, type_of

# Texts given to one call of the library.
BATCH_BYTES = 1 << 20
# A piece without white space that is longer is split further.
LONG_PIECE = 1 << 16
# Pieces whose lengths a task remembers, and the characters such a piece has at most: text
# without spaces is one long piece, which hardly comes again.
REMEMBERED = 500_000
REMEMBERED_CHARS = 24

# A space after white space: there a cut would divide a run of white space.
_DIVIDED = re.compile(r"\s ")
_SAFE_SPACE = re.compile(r"(?<=\S) ")
_CLASS_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def pieces(text: str) -> list[str]:
    """The text cut before each space that follows no white space, that space left out.

    A byte-level pre-tokenizer joins a single space to the word behind it and ends every run
    of letters, digits or signs at white space, so no token crosses such a cut: the tokens of
    the text are those of the first piece and of each other piece behind a space.
    """
    return _SAFE_SPACE.split(text) if _DIVIDED.search(text) else text.split(" ")


def long_pieces(piece: str) -> list[str]:
    """A long piece cut between ASCII letters and digits, which also end a run."""
    if len(piece) <= LONG_PIECE:
        return [piece]
    found, start = [], 0
    for cut in _CLASS_CHANGE.finditer(piece):
        if cut.start() - start >= LONG_PIECE:
            found.append(piece[start : cut.start()])
            start = cut.start()
    return [*found, piece[start:]]


def batches_by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts in lists of about the same number of bytes."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text.encode("utf-8", "surrogatepass"))
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Counter:
    """Token counts of whole texts by a tokenizer of the `tokenizers` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_space = not any(re.search(r"\s", s) for s in special)
        self.by_class = not any(_CLASS_CHANGE.search(s) for s in special)
        self.known: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        lengths: list[int] = []
        for batch in batches_by_bytes(texts):
            encodings = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            lengths.extend(len(e) for e in encodings)
        return lengths

    def whole(self, piece_list: list[str]) -> list[int]:
        """Lengths of pieces of any size."""
        if not self.by_class or all(len(p) <= LONG_PIECE for p in piece_list):
            return self.encoded(piece_list)
        parts = [long_pieces(p) for p in piece_list]
        lengths = iter(self.encoded([x for p in parts for x in p]))
        return [sum(next(lengths) for _ in p) for p in parts]

    def count(self, texts: list[str]) -> list[int]:
        split = [pieces(t) if self.by_space else [t] for t in texts]
        firsts = self.whole([p[0] for p in split])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({x for p in split for x in p[1:] if x not in self.known})
        here = dict(zip(new, self.whole([" " + x for x in new]), strict=True))
        self.known.update((x, n) for x, n in here.items() if len(x) <= REMEMBERED_CHARS)
        look = lambda x: self.known[x] if x in self.known else here[x]
        return [n + sum(map(look, p[1:])) for n, p in zip(firsts, split, strict=True)]


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    counter: Callable[[str], Counter] = Counter,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty.

    `path` names the tokenizer's file on the executors. No shuffle: a scan's tasks are
    balanced by bytes, and within a task every call of the library gets about `BATCH_BYTES`.
    Texts are cut at boundaries no token crosses, and a piece that comes again is not encoded
    again, so memory is bounded by a slice of texts and `REMEMBERED` short pieces. Rows are neither
    merged nor dropped; other columns are left out, whatever their names.
    """
    schema = f"`{id_col}` {type_of(docs, id_col)}, n_bytes long, n_tokens long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches, 1):
            own = own or counter(path)
            texts = batch.column(1).to_pylist()
            n_bytes = [len(t.encode()) for t in texts]
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(own.count(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(encode, schema).withColumn("over_limit", F.col("n_tokens") > limit)
