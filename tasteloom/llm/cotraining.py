"""Quality classifier by co-training of a text view and a metadata view.

* Text view: logistic regression on hashed words (letters alone, lower-cased) and word shapes (case and marks), each
  scaled by the log ratio of its document frequencies in both classes.
* Metadata view: logistic regression on language, source, size and page layout (line and word lengths,
  shares of capitals, digits and marks, share of repeated words); it sees no word.

Features of every row are made once from its whole text and stored: bucket numbers and a few figures.

1. Labelled rows (good: quality 1 and not toxic) are dealt to ``FOLDS`` folds. Both views are fitted once for each
   fold, without its rows, and once on all; so every labelled row has margins from models that did not see it.
   These calibrate both views and fit the logistic combination of the two calibrated logits.
2. Exchange, ``ROUNDS`` times: all other rows are scored by both views in one pass. Where one view is confident and
   the other does not firmly say the opposite, the row is a pseudo-label for the *other* view. Each task adds up,
   apart for both classes, what the other view learns from its pseudo-labels: document frequencies of the
   buckets for the text, gradient and curvature of the loss for the metadata.
3. Both views are fitted again, with these sums beside the labelled rows. They get the labels' class shares, and
   together weigh at most ``PSEUDO`` of what the labels of a class weigh. What a view has learned stays only if the
   cross-fitted loss of the combination falls with it; if neither view gains, the rounds end.
4. Every document is scored by the models of all labelled rows, calibrated and combined.

Fitting uses at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of the id; this is the documented
bound. Every other row, labelled or not, takes part in the exchange and none is sampled. Only the bounded sample
is joined to documents, by broadcast; texts and features are never shuffled.

Null texts are empty, null metadata is a value of its own. Null labels are no labels; of repeated labels the
worst counts. Rows that repeat a labelled id and text train once. Without two rows of both classes in each fold's
complement every document gets a score of 1 and is kept. Repeated rows get equal scores; very long texts are
cut between words and their features put together; an empty table gives no rows. Columns beyond those of
documents are ignored by ``score_documents`` and kept, whatever their names, by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .words import mix

DIM = 1 << 16  # hashed text features
SIDE = 64  # hashed values of language and source
LAYOUT = 12
META = LAYOUT + SIDE + 1  # the last one is constant
MAX_LABELLED = 20_000
FOLDS = 3
MODELS = FOLDS + 1  # the last one sees all labelled rows
ROUNDS = 2
PSEUDO = 0.1  # weight of all pseudo-labels beside all labels
CONFIDENT = 0.97
OPPOSED = 0.8
THRESHOLD = 0.5
EPOCHS, BATCH, RATE, RIDGE = 20, 32, 0.1, 5e-3
SEEN_IN = 3  # documents that a bucket needs
MOST = 3.0  # bound of the log ratio
STEPS = 200  # mini-batches at least
SLICES = 16  # parts in which gradients are added up
PIECE = 1 << 19  # bytes of text whose words are cut and hashed side by side
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MEMO = 100_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True  # 0 parts two texts
_LOWER = np.zeros(256, np.uint64)  # lower-cased letters, 0 for everything else
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
_KIND = np.full(256, 4, np.uint8)  # 0 lower case, 1 capitals, 2 digits, 3 marks, 4 all else
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_MARK = np.zeros(256, np.uint64)  # one bit for each mark, one for digits, one for control characters
_MARK[48:58], _MARK[1:32] = 1 << 40, 1 << 41
for _at, _c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
    _KIND[_c], _MARK[_c] = 3, 1 << _at
_MARK[_IS_SPACE] = 0
_ODD = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))
                for base in (_ODD, pow(_ODD, -1, 1 << 64))
            )
        return self.up, self.down


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about ``PIECE`` bytes; a long text is cut between words."""
    at, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while True:
            cut = _SPACE.search(text, low + PIECE) if len(text) - low > PIECE else None
            at.append(i)
            pieces.append(text[low : cut.start()] if cut else text[low:])
            held += len(pieces[-1])
            if held >= PIECE:
                yield at, pieces
                at, pieces, held = [], [], 0
            if not cut:
                break
            low = cut.start()
    if at:
        yield at, pieces


def _sides(lang, source, memo: dict) -> tuple[int, int]:
    key = (lang, source)
    if key not in memo:
        if len(memo) >= _MEMO:
            memo.clear()
        memo[key] = tuple(
            LAYOUT + zlib.crc32(f"{name}={value}".encode()) % SIDE for name, value in (("lang", lang), ("source", source))
        )
    return memo[key]


class Features:
    """Features of both views for lists of rows."""

    def __init__(self):
        self.powers, self.sides = Powers(), {}

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word's letters and of its shape."""
        letters = _LOWER[data]
        inner = letters != 0
        codes = letters[inner]
        before = np.concatenate([[0], np.cumsum(inner)])
        up, down = self.powers.reach(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
        a, b = before[starts], before[ends]
        word = mix((sums[b] - sums[a]) * down[a])
        capital = np.concatenate([[0], np.cumsum(_KIND[data] == 1)])
        capitals = capital[ends] - capital[starts]
        case = np.where((capitals > 1) & (capitals == b - a), 2, (_KIND[data[starts]] == 1).astype(np.int64))
        shape = np.bitwise_or.reduceat(_MARK[data], starts) | (case.astype(np.uint64) << np.uint64(50))
        return (word >> np.uint64(48)).astype(np.int64), (mix(shape + np.uint64(_ODD)) >> np.uint64(48)).astype(np.int64)

    def of(self, texts: list[bytes], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all rows side by side, where each row's begin (and one more), and the figures of each row."""
        n = len(texts)
        keys, sums = [], np.zeros((n, 10))  # chars, lines, words, lengths, their squares, kinds
        distinct = np.zeros(n)
        split = False
        for at, pieces in _groups(texts):
            split |= len(set(at)) < len(at) or bool(len(keys) and at[0] == last)
            last = at[-1]
            data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
            at = np.asarray(at)
            begins = np.cumsum([0] + [len(p) + 1 for p in pieces])
            full = ~_IS_SPACE[data]
            edge = np.diff(np.concatenate([[False], full]).astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            piece = np.searchsorted(begins, starts, "right") - 1
            rows = begins[:-1]
            kinds = _KIND[data]
            figures = [(data & 0xC0) != 0x80, data == 10, *(kinds == k for k in range(5))]
            for column, found in zip((0, 1, 5, 6, 7, 8, 9), figures, strict=True):
                np.add.at(sums[:, column], at, np.add.reduceat(found.astype(np.int64), rows))
            np.add.at(sums[:, 0], at, -1)  # the parting 0
            np.add.at(sums[:, 9], at, -1)
            if len(starts):
                lengths = (ends - starts).astype(float)
                for column, found in ((2, np.ones(len(starts))), (3, lengths), (4, lengths**2)):
                    sums[:, column] += np.bincount(at[piece], found, n)
                word, shape = self._words(data, starts, ends)
                own = at[piece] * np.int64(DIM)
                words = np.unique(own + word)
                distinct += np.bincount(words // DIM, minlength=n)
                keys.append(np.union1d(words, own + shape))
        every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        if split:  # a text in several pieces
            every = np.unique(every)
        offsets = np.searchsorted(every, np.arange(n + 1) * np.int64(DIM))
        return (every % DIM).astype(np.uint16), offsets, self._meta(sums, distinct, texts, langs, sources)

    def _meta(self, sums: np.ndarray, distinct: np.ndarray, texts: list[bytes], langs: list, sources: list) -> np.ndarray:
        chars, lines, words, lengths, squares = sums[:, :5].T
        out = np.zeros((len(sums), META), np.float32)
        some, lines = np.maximum(words, 1), lines + 1
        mean = lengths / some
        out[:, 0], out[:, 1] = np.log1p(chars) / 5, np.log1p(lines) / 5
        out[:, 2] = np.minimum(3, chars / lines / 200)
        out[:, 3], out[:, 4] = np.minimum(3, mean / 5), np.minimum(3, np.sqrt(np.maximum(squares / some - mean**2, 0)) / 5)
        out[:, 5], out[:, 6] = np.minimum(1, distinct / some), words / np.maximum(chars, 1) * 5
        out[:, 7:LAYOUT] = sums[:, 5:] / np.maximum(sums[:, 5:].sum(1), 1)[:, None]
        for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            for j in _sides(lang, source, self.sides):
                out[i, j] = 1.0
        out[:, -1] = 1.0
        return out

    def of_batch(self, batch: pa.RecordBatch, text: str, lang: str, source: str):
        texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
        return self.of(texts, batch.column(lang).to_pylist(), batch.column(source).to_pylist())


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, whose features are made together."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def _text_of(docs: DataFrame, *names: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in names]


def feature_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, ids, meta)`` of every row: distinct buckets and figures, side by side."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in chain.from_iterable(map(_parts, batches)):
            ids, offsets, meta = features.of_batch(batch, "text", "lang", "source")
            packed = pa.Array.from_buffers(
                pa.binary(), len(meta), [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(ids)]
            )
            figures = pa.array([row.tobytes() for row in meta], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, figures], ["doc_id", "ids", "meta"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_of(docs, "text", "lang", "source"))
    return rows.mapInArrow(make, "doc_id long, ids binary, meta binary")


def _unpacked(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets side by side, where each row's begin (and one more), figures."""
    ids = batch.column("ids").to_pylist()
    offsets = np.cumsum([0] + [len(i) // 2 for i in ids])
    flat = np.frombuffer(b"".join(ids), np.uint16)
    return flat, offsets, np.frombuffer(b"".join(batch.column("meta").to_pylist()), np.float32).reshape(len(ids), META)


def _row_sums(weights: np.ndarray, ids: np.ndarray, offsets: np.ndarray, rows: int = 512) -> np.ndarray:
    """Sum of the weights of each row's buckets, some rows at a time."""
    out = np.zeros(len(offsets) - 1)
    for low in range(0, len(out), rows):
        bounds = offsets[low : low + rows + 1]
        total = np.concatenate([[0.0], np.cumsum(weights[ids[bounds[0] : bounds[-1]]])])
        out[low : low + rows] = np.diff(total[bounds - bounds[0]])
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class View:
    """Weights of one pair of models: buckets and a constant for the text, figures for the metadata."""

    def __init__(self, text: np.ndarray | None = None, meta: np.ndarray | None = None):
        self.text = np.zeros(DIM + 1) if text is None else text
        self.meta = np.zeros(META) if meta is None else meta

    def margins(self, ids: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _row_sums(self.text, ids, offsets) + self.text[DIM], meta @ self.meta


def _bucket_gradient(error: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over rows of the error times the row's buckets, the constant last."""
    out = np.zeros(DIM + 1)
    out[:DIM] = np.bincount(ids, np.repeat(error, np.diff(offsets)), DIM)
    out[DIM] = error.sum()
    return out


def log_ratios(ids: np.ndarray, offsets: np.ndarray, good: np.ndarray, taught: np.ndarray | None) -> np.ndarray:
    """Log ratio of each bucket's document frequencies in both classes; 0 for rare buckets, 1 for the constant.

    ``taught``: for both classes the frequencies of the buckets among pseudo-labels, and their number at the end.
    """
    lengths = np.diff(offsets)
    held = [np.bincount(ids[np.repeat(good == c, lengths)], minlength=DIM).astype(float) for c in (0, 1)]
    total = [(good == c).sum() for c in (0, 1)]
    if taught is not None:
        for c in (0, 1):
            weight = min(1.0, PSEUDO * total[c] / max(1.0, taught[c, -1]))
            held[c], total[c] = held[c] + weight * taught[c, :DIM], total[c] + weight * taught[c, -1]
    ratio = np.log((held[1] + 1) / (total[1] + 2)) - np.log((held[0] + 1) / (total[0] + 2))
    ratio[held[0] + held[1] < SEEN_IN] = 0.0
    return np.append(np.clip(ratio, -MOST, MOST), 1.0)


def fit_text(ids: np.ndarray, offsets: np.ndarray, good: np.ndarray, taught: np.ndarray | None) -> np.ndarray:
    """Mini-batches with a step for each weight, in a fixed order."""
    ratio = log_ratios(ids, offsets, good, taught)
    w, seen = np.zeros(DIM + 1), np.full(DIM + 1, 1e-2)  # the text margin is (w * ratio) summed over buckets
    order = np.random.default_rng(7).permutation(len(good))
    for epoch in range(max(EPOCHS, STEPS * BATCH // max(1, len(order)))):
        for low in range(0, len(order), BATCH):
            rows = np.sort(order[low : low + BATCH])
            own = np.concatenate([ids[offsets[r] : offsets[r + 1]] for r in rows])
            bounds = np.cumsum([0] + [offsets[r + 1] - offsets[r] for r in rows])
            error = sigmoid(_row_sums(w * ratio, own, bounds) + w[DIM]) - good[rows]
            gradient = _bucket_gradient(error / len(rows), own, bounds) * ratio + RIDGE * w
            seen += gradient**2
            w -= RATE / (1 + epoch) ** 0.5 * gradient / np.sqrt(seen)
    return w * ratio


def fit_meta(start: np.ndarray, meta: np.ndarray, good: np.ndarray, taught: np.ndarray | None) -> np.ndarray:
    """Newton steps; the figures are few.

    ``taught``: for both classes the gradient and the curvature of the pseudo-labels' loss at ``start``, and their
    number at the end.
    """
    w, x = start.copy(), meta.astype(np.float64)
    slope, curve = np.zeros(META), np.zeros((META, META))
    if taught is not None:
        for c in (0, 1):
            weight = min(PSEUDO * (good == c).sum(), taught[c, -1]) / max(1.0, taught[c, -1]) / len(good)
            slope += weight * taught[c, :META]
            curve += weight * taught[c, META:-1].reshape(META, META)
    for _ in range(25):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - good) / len(good) + 1e-3 * w + slope + curve @ (w - start)
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(good) + 1e-3 * np.eye(META) + curve
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labels_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)``: 1.0 for quality 1 and not toxic; the worst of repeated labels."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0.0).when(F.col("quality") == 1, 1.0)
    return labels.select("doc_id", bad.alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))


def _share(seed: int):
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def labelled_sample(labels: DataFrame) -> DataFrame:
    """``(doc_id, good, fold)`` of at most about ``MAX_LABELLED`` labelled ids, stored."""
    labelled = store(labels_of(labels))
    picked = labelled.where(_share(1) < F.lit(min(1.0, MAX_LABELLED / max(1, labelled.count()))))
    return store(picked.withColumn("fold", F.floor(_share(2) * FOLDS).cast("int")))


def _platt(x: np.ndarray, good: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on few columns (last: constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(good))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - good) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Combination:
    """Calibration of both views and the combination of their logits, from margins of unseen rows."""

    def __init__(self, margins: np.ndarray, good: np.ndarray):
        self.text, self.meta = (_platt(margins[:, i : i + 1], good) for i in range(2))
        self.joint = _platt(self.logits(margins), good)

    def logits(self, margins: np.ndarray) -> np.ndarray:
        return margins * [self.text[0], self.meta[0]] + [self.text[1], self.meta[1]]

    def scores(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = self.logits(margins)
        return sigmoid(logits[:, 0]), sigmoid(logits[:, 1]), sigmoid(logits @ self.joint[:2] + self.joint[2])


def cross_fitted_loss(margins: np.ndarray, good: np.ndarray, fold: np.ndarray) -> float:
    """Mean log loss of the combination on folds that it was not fitted on."""
    loss = 0.0
    for f in range(FOLDS):
        own = fold == f
        if own.any():  # the combination is fitted on the other folds
            p = np.clip(Combination(margins[~own], good[~own]).scores(margins[own])[2], 1e-6, 1 - 1e-6)
            loss -= np.where(good[own] == 1, np.log(p), np.log(1 - p)).sum()
    return loss / len(good)


def fit_folds(sample: DataFrame, views: list[View], taught: list) -> tuple[list[View], tuple]:
    """Fit both views once for each fold without its rows and once on all; margins of each row come from its own
    fold's models. One task for each model; the sample is of bounded size.
    """
    held = sample.sparkSession.sparkContext.broadcast((views, taught))

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        f = key[0].as_py()
        view, (for_text, for_meta) = held.value[0][f], held.value[1][f]
        rows = rows.take(pa.array(np.lexsort((rows.column("hash").to_numpy(), rows.column("doc_id").to_numpy()))))
        ids, offsets, meta = _unpacked(rows)
        good, fold = rows.column("good").to_numpy(), rows.column("fold").to_numpy()
        inside = np.flatnonzero(fold != f)
        lengths = np.diff(offsets)
        own = ids[np.repeat(fold != f, lengths)]
        bounds = np.cumsum(np.concatenate([[0], lengths[inside]]))
        done = View(fit_text(own, bounds, good[inside], for_text), fit_meta(view.meta, meta[inside], good[inside], for_meta))
        text, side = done.margins(ids, offsets, meta)
        out = np.flatnonzero(fold == f)
        packed = np.concatenate([done.text, done.meta]).tobytes()
        return pa.table(
            [
                pa.array([f] * (len(out) + 1), pa.int32()), pa.array([*out, -1], pa.int64()),
                pa.array([*text[out], None], pa.float64()), pa.array([*side[out], None], pa.float64()), pa.array([*good[out], None], pa.float64()),
                pa.array([None] * len(out) + [packed], pa.binary()),
            ],
            names=["fold", "place", "text", "side", "good", "weights"],
        )

    copies = sample.withColumn("model", F.explode(F.array(*[F.lit(f) for f in range(MODELS)])))
    found = copies.groupBy("model").applyInArrow(fit, "fold int, place long, text double, side double, good double, weights binary").collect()
    done = list(views)
    for r in found:
        if r["weights"] is not None:
            numbers = np.frombuffer(r["weights"], np.float64)
            done[r["fold"]] = View(numbers[: DIM + 1].copy(), numbers[DIM + 1 :].copy())
    rows = sorted((r["fold"], r["place"], r["text"], r["side"], r["good"]) for r in found if r["weights"] is None)
    fold, _, text, side, good = (np.array(c) for c in zip(*rows, strict=True))
    return done, (np.column_stack([text, side]), good, fold)


def exchange(features: DataFrame, sample_ids: np.ndarray, views: list[View], combination: Combination) -> list:
    """For each of the models what text and metadata learn from the pseudo-labels that the other view gives.

    One pass over all rows whose id is not in the sample. Tasks send their sums in ``SLICES`` parts.
    """
    held = features.sparkSession.sparkContext.broadcast((sample_ids, views, combination))
    width = DIM + 1 + META + META * META + 1  # frequencies, their number, gradient, curvature, their number

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, views, combination = held.value
        sums = np.zeros((MODELS, 2, width))
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column("doc_id").fill_null(-(2**63)).to_numpy(), known)))
            if not batch.num_rows:
                continue
            ids, offsets, meta = _unpacked(batch)
            lengths = np.diff(offsets)
            for f, view in enumerate(views):
                a, b = view.margins(ids, offsets, meta)
                p, q, _ = combination.scores(np.column_stack([a, b]))
                for c in (0, 1):
                    says = [(x >= CONFIDENT) if c else (x <= 1 - CONFIDENT) for x in (p, q)]
                    allows = [(x > 1 - OPPOSED) if c else (x < OPPOSED) for x in (p, q)]
                    for_text, for_meta = says[1] & allows[0], says[0] & allows[1]
                    x, chance, out = meta[for_meta], sigmoid(b[for_meta]), sums[f, c]
                    out[:DIM] += np.bincount(ids[np.repeat(for_text, lengths)], minlength=DIM)
                    out[DIM] += for_text.sum()
                    out[DIM + 1 : DIM + 1 + META] += (chance - c) @ x
                    out[DIM + 1 + META : -1] += ((x * (chance * (1 - chance))[:, None]).T @ x).ravel()
                    out[-1] += for_meta.sum()
        parts = np.array_split(sums.reshape(MODELS * 2, width), SLICES, axis=1)
        data = [p.astype(np.float32).tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(data, pa.binary())], ["slice", "sums"])

    def total(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = 0.0
        for part in rows.column("sums"):
            out = out + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    parts = features.mapInArrow(add_up, schema).groupBy("slice").applyInArrow(total, schema).collect()
    if not parts:
        return [(None, None)] * MODELS
    parts = sorted((r["slice"], np.frombuffer(r["sums"], np.float64).reshape(MODELS * 2, -1)) for r in parts)
    sums = np.concatenate([p for _, p in parts], axis=1).reshape(MODELS, 2, width)
    return [(sums[f, :, : DIM + 1], sums[f, :, DIM + 1 :]) for f in range(MODELS)]


class CoTrained:
    """Weights of both views and the combination; small arrays that travel with the scoring."""

    def __init__(self, view: View, combination: Combination):
        self.view, self.combination = view, combination

    def scores(self, ids: np.ndarray, offsets: np.ndarray, meta: np.ndarray):
        return self.combination.scores(np.column_stack(self.view.margins(ids, offsets, meta)))


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit both views; None if the labelled documents do not hold both classes beside every fold."""
    features = store(feature_rows(docs))
    sample = labelled_sample(labels)
    # of bounded size
    rows = features.join(F.broadcast(sample), "doc_id").withColumn("hash", F.xxhash64("ids", "meta"))
    rows = store(rows.dropDuplicates(["doc_id", "hash"]))
    counts = {(r["fold"], r["good"]): r["count"] for r in rows.groupBy("fold", "good").count().collect()}
    if any(sum(n for (g, c), n in counts.items() if g != f and c == good) < 2 for f in range(FOLDS) for good in (0.0, 1.0)):
        return None
    if len({f for f, _ in counts}) < FOLDS:
        return None
    ids = np.array(sorted(r["doc_id"] for r in sample.select("doc_id").collect()), np.int64)
    views, unseen = fit_folds(rows, [View() for _ in range(MODELS)], [(None, None)] * MODELS)
    loss = cross_fitted_loss(*unseen)
    for _ in range(rounds):
        taught = exchange(features, ids, views, Combination(*unseen[:2]))
        new_views, new_unseen = fit_folds(rows, views, taught)
        # each view may gain from the other one or not
        tries = [(t, m, np.column_stack([(unseen, new_unseen)[t][0][:, 0], (unseen, new_unseen)[m][0][:, 1]])) for t, m in ((1, 1), (1, 0), (0, 1))]
        found, t, m, margins = min(((cross_fitted_loss(x, *unseen[1:]), t, m, x) for t, m, x in tries), key=lambda v: v[0])
        if found >= loss:
            break
        both = views, new_views
        views = [View(both[t][f].text, both[m][f].meta) for f in range(MODELS)]
        unseen, loss = (margins, *unseen[1:]), found
    return CoTrained(views[-1], Combination(*unseen[:2]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(co_train(docs, labels))  # DIM + META numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), held.value
        for batch in chain.from_iterable(map(_parts, batches)):
            if model is None:
                found = [np.ones(batch.num_rows)] * 3
            else:
                found = model.scores(*features.of_batch(batch, "text", "lang", "source"))
            columns = [batch.column("doc_id"), *map(pa.array, found), pa.array(found[2] >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "meta_score", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_of(docs, "text", "lang", "source"))
    return rows.mapInArrow(score, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(co_train(docs, labels))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), held.value
        for batch in chain.from_iterable(map(_parts, batches)):
            if model is not None:
                batch = batch.filter(pa.array(model.scores(*features.of_batch(batch, "text", "lang", "source"))[2] >= threshold))
            yield batch

    return docs.mapInArrow(pick, docs.schema)
