"""What several operators share: the word pattern, bounded Arrow slices, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: words are runs of anything but the ASCII space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text one Arrow function holds decoded at a time.
SLICE_BYTES = 2 << 20


def words(text: Column) -> Column:
    """The words of a text as a list; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema; needs a session, so call it on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(
    batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in `column` have about `max_bytes` or are one row.

    Memory that Arrow keeps for reuse is given back after each, as two workers share an executor
    with its JVM.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(lengths, dtype=np.int64) - lengths) // max_bytes
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)
            pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(
    texts: pa.Array, lower: bool = False, normal: Callable[[str], str] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's begin.

    Words are divided by ASCII white space; `lower` changes A to Z only. Every different word of
    the batch is hashed once, in the form `normal` gives it; words it makes empty are left out.
    """
    import xxhash

    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values = lists.flatten()
    real = pc.greater(pc.binary_length(values), 0)
    seen = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    begins = seen[offsets - offsets[0]]
    coded = values.filter(real).dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    if normal:
        different = [normal(w.decode("utf-8", "replace")).encode() for w in different]
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    places = coded.indices.to_numpy(zero_copy_only=False)
    found = own[places]
    if normal:
        full = np.fromiter(map(bool, different), bool, len(different))[places]
        found, begins = found[full], np.concatenate([[0], np.cumsum(full)])[begins]
    return found, begins


class Grams:
    """Hashes of runs of consecutive words, from one pass of prefix sums.

    A run's hash is the sum of its word hashes times powers of an odd number, scrambled; equal
    runs have equal hashes wherever they stand.
    """

    BASE = 0xD1342543DE82EF95
    _powers = _inverses = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        n = max(n, 2 * len(cls._powers))
        factors = np.full(n, cls.BASE, np.uint64)
        back = np.full(n, pow(cls.BASE, -1, 2**64), np.uint64)
        factors[0] = back[0] = 1
        cls._powers, cls._inverses = np.cumprod(factors), np.cumprod(back)

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        if self.n >= len(self._powers):
            self._grow(self.n + 1)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * self._powers[: self.n], out=self.prefix[1:])

    def of(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of k words at the given places, by default at all."""
        n = self.n - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if at is None:
            total = (self.prefix[k:] - self.prefix[:n]) * self._inverses[:n]
        else:
            total = (self.prefix[at + k] - self.prefix[at]) * self._inverses[at]
        return mix64(total + np.uint64(k))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; empty if there are fewer words."""
    return Grams(hashes).of(k)
