"""Words, word hashes and Arrow batch plumbing shared by the text operators.

A word is a maximal run of characters other than space and tab..carriage return. Splitting the UTF-8
bytes gives exactly these, and lower-casing bytes changes A-Z alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import configure

WORD = r"[^\x20\x09-\x0D]+"
MEMO_WORDS = 400_000  # words whose hash a worker remembers; the memo is then started anew
BATCH_BYTES = "32m"  # Arrow batches are cut by bytes, as one text may be very long

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: those of the library, small Arrow batches, no shuffle files left."""
    spark = configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # texts go through several shuffles: let each job delete its own files when it ends
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_count(text: Column) -> Column:
    """Number of words, without a word array; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """Memo of 64-bit word hashes, bounded by ``MEMO_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE_BYTES = 1 << 18


def pieces_of(texts: list[bytes], size: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about ``size`` bytes together; a longer text is cut between words."""
    at, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while True:
            cut = _BREAK.search(text, low + size) if len(text) - low > size else None
            at.append(i)
            pieces.append(text[low : cut.start()] if cut else text[low:])
            held += len(pieces[-1])
            if held >= size:
                yield at, pieces
                at, pieces, held = [], [], 0
            if not cut:
                break
            low = cut.start()
    if at:
        yield at, pieces


class TextHashes:
    """Hashes of all words of many texts, cut and hashed side by side.

    A word's hash is a polynomial of its bytes, taken from running sums over the bytes of a piece.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))
                for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64))
            )
        return self.up, self.down

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in order, and how many words the texts have up to the end of each."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        for at, pieces in pieces_of(texts):
            data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
            up, down = self._powers(len(data) + 1)
            edge = np.diff(np.concatenate([[True], _IS_SPACE[data]]).astype(np.int8))
            starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            parts.append(mix((sums[ends] - sums[starts]) * down[starts]))
            begins = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
            np.add.at(counts, at, np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _poly(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial in ``_ODD`` of each ``n`` consecutive hashes, put together from two halves."""
    if n == 1:
        return hashes
    low = n // 2
    high = n - low
    right = _poly(hashes, low)
    left = right if low == high else _poly(hashes, high)
    last = len(hashes) - n + 1
    out = left[:last] * np.uint64(pow(int(_ODD), low, 1 << 64))
    out += right[high : high + last]
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; one of the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    return mix(_poly(hashes, n) + np.uint64(n))


def map_batches(
    df: DataFrame, columns: Iterable[str], make: Callable[[], Callable[[dict], dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` with plain lists: ``make()`` runs once in a task and returns a function from a
    dict of column lists to a dict of output columns (lists or arrays)."""
    columns = list(columns)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            out = one({c: batch.column(c).to_pylist() for c in columns})
            arrays = [pa.array(out[f.name], type=f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.select(*columns).mapInArrow(run, schema)
