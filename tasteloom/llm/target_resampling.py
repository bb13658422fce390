"""Importance resampling towards a target distribution over hashed word runs.

Texts are lower-cased (A-Z only) and cut into words by an untrained ``Split`` pre-tokeniser with a fixed
pattern, which returns every word with its offsets. Windows of one to ``RUN`` consecutive offset pairs are the
features; a feature's bucket is the CRC-32 of its words joined by one space, modulo ``BUCKETS``.

1. Texts are cut once; a document's bucket numbers are stored, two bytes for each. Texts are never shuffled.
2. Every task counts its buckets in one array and sends it when it ends, so at most ``BUCKETS`` rows leave a task.
   A bucket's gain is the floor of 1000 times the log ratio of its smoothed shares in target and documents.
   The gains are ``BUCKETS`` numbers; a pass over the stored buckets sums them for each document.
3. The score adds Gumbel noise of the id, and the best ``SHARE`` percent of the documents with at least
   ``MIN_WORDS`` words are drawn: a global order of slim rows, cut into ranges.

Null texts have no words, weight 0 and no rank. Rows that share an id have the same noise; rows equal in all
figures are interchangeable and each counts. A null id is drawn as an empty one and loses ties. Very long texts
are cut between words into pieces of ``PIECE`` characters, runs go on across them. Empty tables on either side
are smoothed like all else; no documents give no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from ..operators.ordering import with_position
from ..session import store
from .words import map_batches

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = 3  # words of the longest feature
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 5  # percent of the eligible documents
SEED = 42
PIECE = 1_000_000
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def pre_tokenizer() -> Split:
    return Split(Regex(WORDS), behavior="removed", invert=True)


def words_with_offsets(text: str | None, split: Split | None = None) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """Lists of (word, (start, end)) in code points of the text, one list for each piece of it."""
    split = split or pre_tokenizer()
    low = (text or "").encode().lower().decode()  # bytes know A-Z alone
    at = 0
    while at < len(low):
        cut = _BREAK.search(low, at + PIECE) if len(low) - at > PIECE else None
        end = cut.start() if cut else len(low)
        found = split.pre_tokenize_str(low[at:end] if at or cut else low)
        yield [(w, (a + at, b + at)) for w, (a, b) in found] if at else found
        at = end


def run_codes(words: list[bytes], prior: int = 0, run: int = RUN) -> list[list[int]]:
    """CRC-32 of every run of 1 to ``run`` words that ends after the first ``prior`` words, by length."""
    spaced = [b" " + w for w in words]
    codes, out = list(map(zlib.crc32, words)), []
    for n in range(1, run + 1):
        if n > 1:  # the code of a run goes on from that of the run without its last word
            codes = list(map(zlib.crc32, spaced[n - 1 :], codes))
        out.append(codes[max(0, prior - n + 1) :])
    return out


def feature_windows(text: str | None, run: int = RUN) -> list[tuple[int, int, int]]:
    """(start, end, CRC-32) of every feature of the text: windows over the offset pairs of its words."""
    found = [pair for piece in words_with_offsets(text) for pair in piece]
    codes = run_codes([w.encode() for w, _ in found], 0, run)
    return [
        (found[i][1][0], found[i + n][1][1], code) for n, same in enumerate(codes) for i, code in enumerate(same)
    ]


class Buckets:
    """Word count and bucket numbers of texts."""

    def __init__(self, buckets: int = BUCKETS, run: int = RUN):
        self.buckets, self.run, self.split = buckets, run, pre_tokenizer()

    def pieces(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words, bucket numbers of the features that end in them) for each piece."""
        last: list[bytes] = []
        for found in words_with_offsets(text, self.split):
            own = [w.encode() for w, _ in found]
            codes = run_codes(last + own, len(last), self.run)
            flat = np.fromiter((c for same in codes for c in same), np.int64, sum(map(len, codes)))
            yield len(own), flat % self.buckets
            last = (last + own)[-(self.run - 1) :] if self.run > 1 else []


def bucket_rows(rows: DataFrame, columns: tuple[str, ...] = (), buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``(*columns, n_words, buckets)``: the bucket numbers of all features of a text, side by side."""
    code = _code(buckets)

    def make():
        of = Buckets(buckets, run)

        def one(cols: dict) -> dict:
            out: dict = {c: cols[c] for c in columns} | {"n_words": [], "buckets": []}
            for text in cols["text"]:
                words, parts = 0, []
                for n, found in of.pieces(text):
                    words += n
                    parts.append(found.astype(code).tobytes())
                out["n_words"].append(words)
                out["buckets"].append(b"".join(parts))
            return out

        return one

    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in columns)
    return map_batches(rows, (*columns, "text"), make, types + "n_words long, buckets binary")


def _code(buckets: int) -> str:
    """How a bucket's number is stored."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(cut: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket."""
    code = _code(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column("buckets"):
                total += np.bincount(np.frombuffer(found.as_buffer(), code), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    summed = cut.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain of each bucket, from the counts on both sides."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratios = (target + 1.0) * all_corpus / ((corpus + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Whole-number Gumbel noise of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weigh_documents(cut: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row."""
    held = cut.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket
    code = _code(len(gain))

    def make():
        gain = held.value

        def one(cols: dict) -> dict:
            own = [np.frombuffer(b, code) for b in cols["buckets"]]
            weight = [int(gain[found].sum()) for found in own]
            return {
                "doc_id": cols["doc_id"],
                "n_words": cols["n_words"],
                "n_features": [len(found) for found in own],
                "weight": weight,
                "score": [w + noise(i, seed) for w, i in zip(weight, cols["doc_id"], strict=True)],
            }

        return one

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return map_batches(cut, ("doc_id", "n_words", "buckets"), make, schema)


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, run: int = RUN, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row; ``rank`` is null where it is not drawn."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = store(bucket_rows(rows, ("doc_id",), buckets, run))
    gain = gains(bucket_counts(cut, buckets), bucket_counts(bucket_rows(target, (), buckets, run), buckets))
    scored = store(weigh_documents(cut, gain, seed))
    fit = F.col("n_words") >= min_words
    n = scored.where(fit).count()
    best = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words")]
    placed = with_position(scored.where(fit), best, name="place")
    rank = F.when(F.col("place") < n * share // 100, F.col("place") + 1).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank).unionByName(
        scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
