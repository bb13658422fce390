"""k-means for one or several sub-spaces at once, one Arrow pass over stored vectors for each iteration.

A task assigns its rows in every sub-space and gives the sums, counts and squared gaps of its centres; those
are added up by a map-side-combined aggregate, so an iteration moves ``tasks x centres`` short rows and the
driver holds the centres alone, whose size the caller's parameters set (``MAX_NUMBERS``).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import digest
from ..session import store

MAX_NUMBERS = 1 << 24  # numbers in all centres together
START_ROWS = 32  # rows for each centre among which the first centres are chosen
MAX_START = 1 << 16  # and their upper bound, unless there are more centres than that
CHUNK = 4096  # rows whose distances are held at once
TOLERANCE = 1e-4


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared gap to the nearest centre of each row; ties to the smaller index."""
    found, gaps = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    lengths = (centres**2).sum(1)
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK]
        scores = lengths[None, :] - 2.0 * (part @ centres.T)
        best = scores.argmin(1)
        found[i : i + CHUNK] = best
        gaps[i : i + CHUNK] = np.maximum(scores[np.arange(len(part)), best] + (part**2).sum(1), 0.0)
    return found, gaps


def spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the rows, each drawn with a chance that grows with its squared gap to those before it; fewer
    where the rows hold fewer different vectors."""
    chosen = [int(rng.integers(len(x)))]
    gaps = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and gaps.max() > 0.0:
        chosen.append(int(rng.choice(len(x), p=gaps / gaps.sum())))
        gaps = np.minimum(gaps, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _start(vectors: DataFrame, m: int, k: int, seed: int) -> list[np.ndarray]:
    """First centres of each sub-space, from the rows with the smallest hash: a bounded sample."""
    wanted = max(k, min(START_ROWS * k, MAX_START))
    rows = vectors.orderBy(digest(F.xxhash64("embedding"), seed=seed), "embedding").limit(wanted).collect()
    if not rows:
        raise ValueError("no vectors to train on")
    parts = np.split(np.array([r["embedding"] for r in rows], dtype=np.float64), m, axis=1)
    return [spread_start(x, k, np.random.default_rng([seed, sub])) for sub, x in enumerate(parts)]


def _sums(vectors: DataFrame, centres: list[np.ndarray]) -> list:
    """``(sub, code, n, gap, mean)`` of every centre that has rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        import pyarrow as pa

        from .grid import column_array

        books = shared.value
        totals = [np.zeros_like(c) for c in books]
        counts, gaps = [np.zeros(len(c)) for c in books], [np.zeros(len(c)) for c in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = column_array(pa.Table.from_batches([batch]), "embedding")
            for sub, part in enumerate(np.split(x, len(books), axis=1)):
                code, gap = nearest(part, books[sub])
                np.add.at(totals[sub], code, part)
                counts[sub] += np.bincount(code, minlength=len(counts[sub]))
                gaps[sub] += np.bincount(code, weights=gap, minlength=len(counts[sub]))
        for sub, n in enumerate(counts):
            used = np.nonzero(n)[0]
            means = totals[sub][used] / n[used, None]
            yield pa.RecordBatch.from_pydict(
                {
                    "sub": pa.array(np.full(len(used), sub), pa.int32()),
                    "code": pa.array(used, pa.int32()),
                    "n": pa.array(n[used]),
                    "gap": pa.array(gaps[sub][used]),
                    "mean": pa.array(list(means), pa.list_(pa.float64())),
                }
            )

    parts = vectors.mapInArrow(assign, "sub int, code int, n double, gap double, mean array<double>")
    mean = Summarizer.mean(array_to_vector("mean"), F.col("n"))
    found = parts.groupBy("sub", "code").agg(F.sum("n").alias("n"), F.sum("gap").alias("gap"), mean.alias("mean"))
    rows = found.withColumn("mean", vector_to_array("mean")).collect()  # one row for each centre
    shared.unpersist()
    return rows


def train_centres(items: DataFrame, m: int, k: int, seed: int, max_iter: int = 20) -> list[np.ndarray]:
    """Centres of each of ``m`` equal slices of ``embedding``: at most ``k`` each, fewer where there are fewer
    different slices in the starting sample. A centre without rows stays where it is."""
    vectors = items.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = store(vectors)
    centres = _start(vectors, m, k, seed)
    if sum(c.size for c in centres) > MAX_NUMBERS:
        raise ValueError("too many centres to broadcast")
    for _ in range(max_iter):
        moved = [c.copy() for c in centres]
        for r in _sums(vectors, centres):
            moved[r["sub"]][r["code"]] = r["mean"]
        change = max(float(((a - b) ** 2).sum(1).max()) for a, b in zip(moved, centres))
        centres = moved
        if change <= TOLERANCE**2:
            break
    return centres


def errors(items: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """``(sub, n, error)``: the sum of squared gaps of all vectors to the nearest centre of each sub-space."""
    vectors = items.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("embedding"))
    found = items.sparkSession.createDataFrame(
        [(r["sub"], r["n"], r["gap"]) for r in _sums(vectors, centres)], "sub int, n double, error double"
    )
    return found.groupBy("sub").agg(F.sum("n").cast("long").alias("n"), F.sum("error").alias("error"))
