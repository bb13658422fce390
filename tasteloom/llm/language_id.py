"""Language of a text: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Subwords are the byte runs of ``SIZES`` bytes inside a word, its borders included (A-Z lower-cased; letters are
a-z and all bytes beyond ASCII). Each is hashed to one of ``BUCKETS`` embeddings; a text is the mean of the
embeddings of all its subwords, and a linear layer with softmax tells its language.

* Training rows have a language and an id whose CRC-32 is not divisible by ``FOLDS``. Of the distinct texts of
  each language a share chosen by the hash of the text is used, about ``TEXTS_PER_LANGUAGE`` of them: this is the
  documented bound of the fit. Their whole texts are read.
* Stochastic gradient descent in numpy: ``ROUNDS`` times, every one of ``PARTS`` tasks starts from the common
  weights, goes over its texts in at least ``STEPS`` mini-batches, and the weights are averaged. One text in five
  takes no part.
* On these the temperature of the softmax is fitted, and the lowest score from which on accepted texts are right
  at least ``PRECISION`` of the time. The first makes the score a probability, the second rejects: ``accepted``.

Subwords of a whole Arrow batch are cut and hashed side by side, about ``GROUP`` bytes at a time, and a very long
text in pieces that end between words. Scoring needs no embeddings: their products with the linear layer are one
number for each bucket and language, summed over a text.

Null texts and texts without any letter are ``und`` with score 0, never accepted and never trained on. If nothing
can be learned every text is ``und``. A null id counts as an empty one (its fold is 0). Equal texts get equal
predictions; ties go to the language first in code-point order. An empty table gives no rows. Language, source
and id take no part in a prediction; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .words import map_batches

SIZES = (2, 3, 4)  # bytes of a subword
BUCKETS = 1 << 15
DIM = 12
FOLDS = 5
TEXTS_PER_LANGUAGE = 2_000
PARTS = 8
ROUNDS = 4
BATCH = 32
STEPS = 60  # mini-batches of a task in a round, at least; no fewer than all of its texts
RATE = 2.0
PRECISION = 0.99
GROUP = 1 << 18
UNKNOWN = "und"
_BORDER = re.compile(rb"[^A-Za-z\x80-\xff]")

_LETTER = np.zeros(256, np.uint8)  # lower-cased letters, 0 for everything else
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about ``GROUP`` bytes; long texts are cut at a border, which both sides keep."""
    at, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while True:
            cut = _BORDER.search(text, low + GROUP) if len(text) - low > 2 * GROUP else None
            at.append(i)
            pieces.append(text[low : cut.end()] if cut else text[low:])
            held += len(pieces[-1])
            if held >= GROUP:
                yield at, pieces
                at, pieces, held = [], [], 0
            if not cut:
                break
            low = cut.start()
    if at:
        yield at, pieces


def subwords(pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: buckets of all subwords of the pieces in order, and how many come before each piece."""
    codes = _LETTER[np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0\0\0\0", np.uint8)]
    begins = np.cumsum([0] + [len(p) + 1 for p in pieces])
    inner = codes != 0
    value = codes.astype(np.uint32)
    inside = None  # whether all letters but the first and the last are letters
    for size in range(2, max(SIZES) + 1):
        n = len(codes) - size + 1
        value = value[:n] | (codes[size - 1 :].astype(np.uint32) << np.uint32(8 * (size - 1)))
        if size == 2:
            valid = inner[:n] | inner[1:]
        else:
            inside = inner[1 : n + 1] if inside is None else inside[:n] & inner[size - 2 : size - 2 + n]
            valid = inside
        if size in SIZES:
            where = np.flatnonzero(valid[: begins[-1]])
            mixed = (value[where] * np.uint32(2654435761)) ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
            yield (mixed >> np.uint32(17)).astype(np.int32) % BUCKETS, np.searchsorted(where, begins[:-1])


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each piece."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return np.diff(total[np.append(before, len(values))])


class Bags:
    """Distinct buckets of texts with their shares: what training needs of them."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.classes: list[int] = []

    def add(self, texts: list[bytes], classes: list[int]) -> None:
        for text, label in zip(texts, classes, strict=True):
            counts = np.zeros(BUCKETS)
            for _, pieces in _groups([text]):
                for found, _ in subwords(pieces):
                    counts += np.bincount(found, minlength=BUCKETS)
            used = np.flatnonzero(counts)
            if len(used):
                self.rows.append((used.astype(np.int32), (counts[used] / counts.sum()).astype(np.float32)))
                self.classes.append(label)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Weights:
    """Subword embeddings and the linear layer."""

    def __init__(self, table: np.ndarray, layer: np.ndarray):
        self.table, self.layer = table, layer

    @classmethod
    def start(cls, n_languages: int, seed: int = 42) -> Weights:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (BUCKETS, DIM)), np.zeros((DIM, n_languages)))

    def descend(self, bags: Bags, rate: float) -> None:
        """One pass of mini-batches over the bags, in place."""
        for low in range(0, len(bags.rows), BATCH):
            part = bags.rows[low : low + BATCH]
            used = np.concatenate([u for u, _ in part])
            share = np.concatenate([s for _, s in part])[:, None]
            of = np.repeat(np.arange(len(part)), [len(u) for u, _ in part])
            starts = np.cumsum([0] + [len(u) for u, _ in part[:-1]])
            mean = np.add.reduceat(self.table[used] * share, starts, axis=0)
            error = softmax(mean @ self.layer)
            error[np.arange(len(part)), bags.classes[low : low + BATCH]] -= 1.0
            back = (error @ self.layer.T)[of] * share
            self.layer -= rate / len(part) * (mean.T @ error)
            for d in range(DIM):  # equal buckets add up
                self.table[:, d] -= rate * np.bincount(used, back[:, d], BUCKETS)

    def packed(self) -> bytes:
        return np.concatenate([self.table.ravel(), self.layer.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, numbers: np.ndarray) -> Weights:
        return cls(numbers[: BUCKETS * DIM].reshape(BUCKETS, DIM).copy(), numbers[BUCKETS * DIM :].reshape(DIM, -1).copy())


def held_out() -> F.Column:
    """Whether an id is kept from training."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(FOLDS) == 0


def training_texts(docs: DataFrame) -> DataFrame:
    """``(lang, text, key, calibrate)``: the bounded sample, stored."""
    fit = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = fit.select(F.col("lang").cast("string").alias("lang"), "text")
    # one row for each language
    rates = rows.groupBy("lang").agg((F.lit(float(TEXTS_PER_LANGUAGE)) / F.count(F.lit(1))).alias("rate"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    share = F.pmod("key", F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = keyed.join(F.broadcast(rates), "lang").where(share < F.col("rate")).drop("rate")
    distinct = picked.dropDuplicates(["lang", "key"]).withColumn("calibrate", F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    return store(distinct.repartition(PARTS, "key").sortWithinPartitions("key", "lang"))


def _average(sample: DataFrame, languages: list[str], weights: Weights, rate: float) -> Weights:
    """One round: every task goes over its texts from the common weights, then the weights are averaged."""
    held = sample.sparkSession.sparkContext.broadcast(weights)
    number = {lang: i for i, lang in enumerate(languages)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bags = Weights(held.value.table.copy(), held.value.layer.copy()), Bags()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            bags.add(texts, [number[v] for v in batch.column("lang").to_pylist()])
        n = len(bags.rows)
        if n:
            for _ in range(-(-STEPS * BATCH // n)):
                own.descend(bags, rate)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.packed()], pa.binary())], ["n", "weights"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, summed = 0, 0.0
        for batch in batches:
            for n, part in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                total, summed = total + n, summed + np.frombuffer(part, np.float64) * n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([(summed / total).tobytes()], pa.binary())], ["weights"])

    rows = sample.where("not calibrate").select("lang", "text").mapInArrow(go, "n long, weights binary")
    # one row for each of the bounded sample's partitions
    found = rows.repartition(1).mapInArrow(mean, "weights binary").collect()
    return Weights.unpacked(np.frombuffer(found[0]["weights"], np.float64)) if found else weights


class LanguageModel:
    """Languages, one number for each bucket and language, temperature and the score of acceptance."""

    def __init__(self, languages: list[str], weights: Weights | None):
        self.languages = languages
        self.products = None if weights is None else np.ascontiguousarray((weights.table @ weights.layer).T)
        self.temperature, self.accept_at = 1.0, 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the products over all subwords of each text; NaN where there are none."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, pieces in _groups(texts):
            for found, before in subwords(pieces):
                np.add.at(counts, at, np.diff(np.append(before, len(found))))
                for i, product in enumerate(self.products):
                    np.add.at(sums[:, i], at, _sums(product[found], before))
        with np.errstate(invalid="ignore", divide="ignore"):
            return sums / counts[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, calibrated score, accepted) of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if known:
            logits = np.nan_to_num(self.logits([texts[i].encode() for i in known]))
            chance = softmax(logits / self.temperature)
            best = chance.argmax(1)
            scores[known] = chance[np.arange(len(known)), best]
            for i, b in zip(known, best, strict=True):
                names[i] = self.languages[b]
        return names, scores, (scores >= self.accept_at) & (scores > 0)

    def calibrate(self, logits: np.ndarray, truth: np.ndarray) -> None:
        """Fit the temperature by golden-section search, then the score of acceptance."""

        k = len(self.languages)
        target = np.full(logits.shape, 1.0 / (len(truth) + k))  # one more row of each language: no score is certain
        target[np.arange(len(truth)), truth] += len(truth) / (len(truth) + k)

        def loss(t: float) -> float:
            return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(1).mean()

        low, high, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))
        chance = softmax(logits / self.temperature)
        order = np.argsort(-chance.max(1), kind="stable")
        right = np.cumsum((chance.argmax(1) == truth)[order]) / np.arange(1, len(truth) + 1)
        good = np.flatnonzero(right >= PRECISION)
        self.accept_at = float(chance.max(1)[order][good[-1]]) if len(good) else 1.0


def train(docs: DataFrame) -> LanguageModel:
    sample = training_texts(docs)
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], None)
    weights = Weights.start(len(languages))
    for i in range(ROUNDS):
        weights = _average(sample, languages, weights, RATE * (1.0 - i / ROUNDS))
    model = LanguageModel(languages, weights)
    held, number = sample.sparkSession.sparkContext.broadcast(model), {lang: i for i, lang in enumerate(languages)}

    def make():
        def one(cols: dict) -> dict:
            return {"lang": cols["lang"], "logits": list(held.value.logits([t.encode() for t in cols["text"]]))}

        return one

    # a fifth of the bounded sample
    rows = map_batches(sample.where("calibrate"), ("lang", "text"), make, "lang string, logits array<double>").collect()
    rows = [r for r in rows if not np.isnan(r["logits"]).any()]
    if rows:
        model.calibrate(np.array([r["logits"] for r in rows]), np.array([number[r["lang"]] for r in rows]))
    return model


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))  # BUCKETS numbers for each language

    def make():
        def one(cols: dict) -> dict:
            names, scores, accepted = held.value.predict(cols["text"])
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": names, "score": scores, "accepted": accepted}

        return one

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    return map_batches(rows, ("doc_id", "held_out", "text"), make, schema)
