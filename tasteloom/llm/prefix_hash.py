"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for a text of n code points, the arrays P[i] = sum of c[j]*B^j (j < i) modulo
two primes. P[i+w] - P[i], brought to a common power, names the span [i, i+w): spans of two texts are
equal if these agree (``spans_equal``), and ``longest_common_extension`` finds how far two texts agree
from given places by binary search, in O(log n) comparisons.

A fingerprint is a string of three parts, all read from the arrays: length and hash of the whole text;
prefix hashes at up to ``CHECKPOINTS`` lengths (multiples of a power of two); and the ``SKETCH`` smallest
hashes among all spans of ``SPAN`` code points. ``likeness`` of two fingerprints (0 to 1) is 1 for equal
whole hashes, else the larger of (a) the share of the longer text in the common prefix, found by binary
search over the common checkpoints, and (b) the resemblance of the span sets estimated from the sketch.

Null texts are empty. Equal texts have equal fingerprints; two empty texts have likeness 1, an empty and
a non-empty one 0. A text shorter than a span has one span, itself. Nothing is sampled: all spans count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 24
SKETCH = 64
CHECKPOINTS = 64
# Two primes below 2^31 (products fit 64 bits) and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 911382323)


class _Powers:
    """Powers of the bases and of their inverses, grown by doubling to the longest text seen."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int):
        while len(self.up[0]) <= n:
            for k, p in enumerate(PRIMES):
                for table, base in ((self.up, BASES[k]), (self.down, pow(BASES[k], -1, p))):
                    have = table[k]
                    step = np.uint64(pow(base, len(have), p))
                    table[k] = np.concatenate([have, have * step % np.uint64(p)])
        return self.up, self.down


_POWERS = _Powers()


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    def __init__(self, points: np.ndarray):
        self.n = len(points)
        up, self.down = _POWERS.upto(self.n + 1)
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = values * up[k][: self.n] % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])  # below 2^31 terms of below 2^31: no overflow
            self.sums.append(sums % np.uint64(p))

    def spans(self, starts, length: int) -> np.ndarray:
        """62-bit names of the spans of one length at the given starts."""
        starts = np.asarray(starts)
        parts = []
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            raw = (self.sums[k][starts + length] + p - self.sums[k][starts]) % p
            parts.append(raw * self.down[k][starts] % p)
        return (parts[0] << np.uint64(31)) | parts[1]

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, length) == b.span(j, length)


def longest_common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Largest length for which the spans from ``i`` and ``j`` are equal."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


class Fingerprint:
    """Parts of a fingerprint; ``str()`` is its stored form."""

    def __init__(self, n: int, whole: int, step: int, marks: list[int], sketch: np.ndarray):
        self.n, self.whole, self.step, self.marks, self.sketch = n, whole, step, marks, sketch

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        hashes = PrefixHashes(code_points(text))
        n = hashes.n
        if not n:
            return cls(0, 0, 1, [], np.zeros(0, np.uint64))
        step = 1
        while n // step > CHECKPOINTS:
            step *= 2
        zero = np.uint64(31)
        ends = np.arange(step, n + 1, step)
        marks = ((hashes.sums[0][ends] << zero) | hashes.sums[1][ends]).tolist()
        width = min(SPAN, n)
        names = hashes.spans(np.arange(n - width + 1), width)
        # names are near uniform but for structured texts; a multiplication scatters them
        names = names * np.uint64(0x9E3779B97F4A7C15)
        if len(names) > 4 * SKETCH:
            # all spans compete; repeats may hold some of the first places, so look further if needed
            take = 4 * SKETCH
            least = np.unique(np.partition(names, take)[:take])
            if len(least) < SKETCH:
                least = np.unique(names)
        else:
            least = np.unique(names)
        return cls(n, hashes.span(0, n), step, marks, least[:SKETCH])

    def __str__(self) -> str:
        marks = ".".join(f"{m:x}" for m in self.marks)
        return f"{self.n:x}|{self.whole:x}|{self.step:x}|{marks}|{self.sketch.tobytes().hex()}"

    @classmethod
    def parse(cls, stored: str) -> Fingerprint:
        n, whole, step, marks, sketch = stored.split("|")
        return cls(
            int(n, 16), int(whole, 16), int(step, 16),
            [int(m, 16) for m in marks.split(".")] if marks else [],
            np.frombuffer(bytes.fromhex(sketch), np.uint64),
        )

    def prefix_share(self, other: Fingerprint) -> float:
        """Share of the longer text in the longest common prefix that the checkpoints prove."""
        step = max(self.step, other.step)
        mine, theirs = self.marks[step // self.step - 1 :: step // self.step], other.marks[step // other.step - 1 :: step // other.step]
        low, high = 0, min(len(mine), len(theirs))
        while low < high:
            middle = (low + high + 1) // 2
            if mine[middle - 1] == theirs[middle - 1]:
                low = middle
            else:
                high = middle - 1
        return low * step / max(self.n, other.n)

    def resemblance(self, other: Fingerprint) -> float:
        both = np.union1d(self.sketch, other.sketch)[:SKETCH]
        shared = np.isin(both, self.sketch) & np.isin(both, other.sketch)
        return float(shared.sum()) / len(both)

    def likeness(self, other: Fingerprint) -> float:
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        return min(1.0, max(self.prefix_share(other), self.resemblance(other)))


def likeness(a: str, b: str) -> float:
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


CELL_ROWS = 2_000  # rows of one cell of consecutive ids, at the average
MAX_CELLS = 60_000  # beyond that, cells grow; their rows stream, so a large one needs no more memory


def fingerprint_documents(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The next document is that of the next larger ``doc_id`` (after the last: the first). Rows that
    share a ``doc_id`` are ordered by text; a null ``doc_id`` comes first. Ids are cut into cells of
    consecutive ids; the first row of each cell is also sent to the cell before it, so every row
    meets its follower after a single shuffle of the texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.count()
    cells = min(MAX_CELLS, max(spark.sparkContext.defaultParallelism, total // cell_rows))
    ids = docs.select("doc_id")
    ranges = ids.repartitionByRange(cells, "doc_id").groupBy(F.spark_partition_id().alias("range"))
    # one number per range, MAX_CELLS in all: bounded by a constant, not by the table
    least = [r["least"] for r in ranges.agg(F.min("doc_id").alias("least")).collect() if r["least"] is not None]
    cell = _cell_of(sorted(least)[1:])

    ids = ids.withColumn("cell", cell)
    firsts = ids.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least"))
    firsts = firsts.select("cell", F.col("least.doc_id").alias("least"))
    # the cell before each one, and round to the last: at most 60,000 rows, so one window holds them
    order = Window.orderBy("cell")
    ring = (
        firsts.withColumn("before", F.lag("cell").over(order))
        .withColumn("last", F.max("cell").over(Window.partitionBy()))
        .select("cell", F.col("least").alias("cell_least"), F.coalesce("before", "last").alias("cell_before"))
    )
    placed = rows.withColumn("cell", cell).join(F.broadcast(ring), "cell")
    # every row of a cell's least id may be the cell's first row, whichever sorts first by text
    is_first = F.col("doc_id").eqNullSafe(F.col("cell_least"))
    homes = F.when(
        is_first,
        F.array(
            F.struct(F.col("cell").alias("at"), F.lit(False).alias("guest")),
            F.struct(F.col("cell_before").alias("at"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("cell").alias("at"), F.lit(False).alias("guest"))))
    dealt = (
        placed.select("doc_id", "text", F.explode(homes).alias("home"))
        .select("home.at", "home.guest", "doc_id", "text")
        .repartition(max(cells, 1), "at")
        .sortWithinPartitions("at", "guest", F.col("doc_id").asc_nulls_first(), "text")
    )
    return dealt.mapInArrow(_fingerprint_cells, RESULT)


def _cell_of(edges: list[int]) -> Column:
    """Number of edges at or below the id; null ids are in the first cell."""
    held = np.array(edges, np.int64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(held, ids.fill_null(-(2**63)).to_numpy(), side="right")
        return pa.array(found.astype(np.int32))

    return place(F.col("doc_id"))


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _fingerprint_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, text, real = pa.int64(), pa.string(), pa.float64()
    kinds = (whole, whole, text, text, text, real, real)
    fields = pa.schema(list(zip((c.split()[0] for c in RESULT.split(", ")), kinds, strict=True)))
    held = None  # the row whose follower is not known yet: (cell, doc_id, text, fingerprint)
    done = -1  # the cell whose first guest has been met
    out: list[tuple] = []

    def close(row, text: str, mark: Fingerprint) -> None:
        _, doc_id, own, own_mark = row
        changed = edited(own, text)
        changed_mark = own_mark if changed == own else Fingerprint.of(changed)
        out.append(
            (
                doc_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                str(own_mark), str(changed_mark), own_mark.likeness(changed_mark), own_mark.likeness(mark),
            )
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("at", "guest", "doc_id", "text"))
        for at, guest, doc_id, text in zip(*columns, strict=True):
            if guest and done == at:
                continue
            mark = Fingerprint.of(text)
            if held is not None and held[0] == at:
                close(held, text, mark)
            held, done = (None, at) if guest else ((at, doc_id, text, mark), done)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out), fields, strict=True)], schema=fields
            )
            out = []
