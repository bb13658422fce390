"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

Items are queries against all documents. An item of L words belongs to the size class w, the largest
class size that leaves it a little slack (w <= L); each of its windows of w words gets a 64-bit SimHash
over its words. Documents are cut into windows of the same class size at a stride of half the slack of
the class's shortest item, so a passage that holds the item has a window aligned with one near the item's
start and one near its end. Fingerprints are compared by multi-index Hamming search: the 64 bits are cut into
``RADIUS + 1`` blocks, and by the pigeonhole principle two fingerprints within ``RADIUS`` bits agree on a
whole block, so looking up each block in its own table misses none of them.

Each hit names a place in the document and one in the item. There the exact similarity is computed: the
weighted Jaccard similarity of five-word shingles (weights: how often a shingle occurs) between the item and
the document's passage of the item's length, also moved by up to ``SHIFT`` words. ``SIMILARITY`` or more
is contamination.

A document shorter than the item may have no window of the item's class, or none at the item's ends, so it
is found by its shingles: at 0.75 it lacks at most a quarter of the item's shingles, so it holds one of any
quarter and one more of them. ``ShortIndex`` keeps the rarest such part of each item; this misses none.

Bit counts of all windows are sums of 64 bytes side by side; a window has at most 192 words, so they are
exact. Items longer than the largest class use that class.

Words are lower-cased (A-Z). Null texts are empty. Items without words match nothing; items or
documents of fewer than five words have one shingle, the whole sequence. A document shorter than the item
is compared as a whole. Distinct items come in blocks of ``ITEM_BLOCK`` words, one pass over the documents each,
so what is broadcast is bounded; the ids of equal items are joined to what was found. Repeated documents are
reported each; items that repeat are each reported. A very long document is read in pieces of ``PIECE`` bytes that
overlap by the longest item, and only the words of one piece are held. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .words import WordHashes, gram_hashes, map_batches, mix, split_words, word_count

SIZES = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192)  # window size classes: 2^k and 3 * 2^k
CHUNK_WORDS = 40_000  # words whose windows are hashed together; a longer piece is a chunk of its own
PIECE = 400_000  # bytes of a document that are read at a time
RADIUS = 7
SHINGLE = 5
SIMILARITY = 0.75
SHIFT = 2
ITEM_BLOCK = 500_000  # words of the items handled in one pass over the documents


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: str | None, size: int, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, number of the first) of pieces of about ``size`` bytes; each begins with the last ``overlap`` words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at = first = 0
    kept: list[bytes] = []
    while True:
        cut = _SPACE.search(data, at + size) if len(data) - at > size else None
        words = kept + data[at : cut.start() if cut else len(data)].split()
        yield words, first
        if not cut:
            return
        kept = words[-overlap:] if overlap else []
        first, at = first + len(words) - len(kept), cut.start()


def class_size(n_words: int) -> int:
    """Window size for an item: the largest class of at most 5/6 of it, itself if there is none."""
    fitting = [s for s in SIZES if s * 6 <= n_words * 5]
    return fitting[-1] if fitting else n_words


class WindowBits:
    """Fingerprints of all windows of some words, for any class size.

    A row holds the 64 bit counts of a window in 64 bytes. Windows of 2, 4, 8 ... words are sums of two
    neighbours; other sizes are put together from these.
    """

    def __init__(self, hashes: np.ndarray):
        bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1)
        self.sums = {1: bits}

    def counts(self, size: int) -> np.ndarray:
        if size not in self.sums:
            high = 1 << (size.bit_length() - 1)
            low = size - high
            first, second = (size // 2, size // 2) if not low else (high, low)
            a, b = self.counts(first), self.counts(second)
            n = len(self.sums[1]) - size + 1
            self.sums[size] = a[:n] + b[first : first + n]
        return self.sums[size]

    def prints(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The majority of every bit in the windows that begin at ``starts``."""
        return np.packbits(self.counts(size)[starts] > size // 2, axis=1).view(np.uint64).ravel()


def shingle_counts(words: list[bytes]) -> Counter:
    if not words:
        return Counter()
    n = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(c, b[s]) for s, c in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


class BlockIndex:
    """Multi-index tables of one size class."""

    def __init__(self, size: int, prints: np.ndarray, items: np.ndarray, offsets: np.ndarray, stride: int):
        self.size, self.stride = size, stride
        self.prints, self.items, self.offsets = prints, items, offsets
        cuts = np.linspace(0, 64, RADIUS + 2).astype(int)
        self.blocks = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            values = self._block(prints, low, high)
            order = np.argsort(values, kind="stable")
            edges = np.searchsorted(values[order], np.arange((1 << (high - low)) + 1))
            self.blocks.append((low, high, order, edges))

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, entry)`` of all fingerprints within the radius; a pair may come more than once."""
        windows, entries = [], []
        for low, high, order, edges in self.blocks:
            values = self._block(prints, low, high)
            first, count = edges[values], edges[values + 1] - edges[values]
            hit = np.nonzero(count)[0]
            if not len(hit):
                continue
            n = count[hit]
            left = np.repeat(hit, n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            right = order[np.repeat(first[hit], n) + inside]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= RADIUS
            windows.append(left[near])
            entries.append(right[near])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(windows), np.concatenate(entries)


class ShortIndex:
    """The rarest shingles of each item, so many that a shorter document at ``SIMILARITY`` holds one of them."""

    def __init__(self, hashed: list[np.ndarray]):
        """``hashed``: the word hashes of each item."""
        self.lengths = np.array([len(h) for h in hashed], np.int64)
        grams = [gram_hashes(h, SHINGLE) if len(h) >= SHINGLE else h[:0] for h in hashed]
        sizes = np.array([len(g) for g in grams], np.int64)
        every, owners = np.concatenate([np.zeros(0, np.uint64), *grams]), np.repeat(np.arange(len(grams)), sizes)
        _, which, counts = np.unique(every, return_inverse=True, return_counts=True)
        order = np.lexsort((every, counts[which], owners))
        rank = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wanted = sizes - np.ceil(SIMILARITY * sizes).astype(np.int64) + 1
        chosen = order[rank < wanted[owners]]
        chosen = chosen[np.argsort(every[chosen], kind="stable")]
        self.grams, self.owners = every[chosen], owners[chosen]

    def search(self, hashes: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """``(document, item)`` with a shared shingle, where the document is shorter and long enough for the similarity."""
        if not len(self.grams) or len(hashes) < SHINGLE:
            return set()
        sizes = np.diff(ends, prepend=0)
        starts = np.arange(len(hashes) - SHINGLE + 1)
        docs = np.searchsorted(ends, starts, side="right")
        inside = (starts + SHINGLE <= ends[docs]) & (sizes[docs] < self.lengths.max())
        docs, grams = docs[inside], gram_hashes(hashes, SHINGLE)[inside]
        first = np.searchsorted(self.grams, grams, side="left")
        n = np.searchsorted(self.grams, grams, side="right") - first
        docs, begun = np.repeat(docs, n), np.repeat(first - np.cumsum(n) + n, n)
        items = self.owners[begun + np.arange(n.sum())]
        less, whole = sizes[docs], self.lengths[items]
        fits = (less < whole) & (less - SHINGLE + 1 >= SIMILARITY * (whole - SHINGLE + 1))
        return set(zip(docs[fits].tolist(), items[fits].tolist(), strict=True))


class ItemIndex:
    def __init__(self, items: list[tuple]):
        """``items``: (key, text) of distinct texts."""
        hashes = WordHashes()
        self.ids, self.words, by_size = [], [], {}
        for item_id, text in items:
            words = split_words(text, lower=True)
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            by_size.setdefault(class_size(len(words)), []).append(k)
        self.shingles = [shingle_counts(w) for w in self.words]
        hashed = [hashes.array(w) for w in self.words]
        self.short = ShortIndex(hashed)
        self.classes = []
        for size, members in sorted(by_size.items()):
            # with a stride of half the slack an item has two aligned windows, one near each end, so that an
            # edit seldom spoils both; the offsets cover every remainder of the stride
            stride = max(1, (1 + min(len(self.words[k]) for k in members) - size) // 2)
            prints, owners, offsets = [], [], []
            for k in members:
                slack = len(self.words[k]) - size
                near, far = np.arange(min(stride, slack + 1)), np.arange(max(0, slack + 1 - stride), slack + 1)
                starts = np.union1d(near, far)
                prints.append(WindowBits(hashed[k]).prints(starts, size))
                owners.append(np.full(len(starts), k))
                offsets.append(starts)
            self.classes.append(
                BlockIndex(size, np.concatenate(prints), np.concatenate(owners), np.concatenate(offsets), stride)
            )

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """``(document, item, place)`` where a window and one of the item's are within the radius, or the
        document is shorter than the item and shares a rare shingle.

        The documents' words stand one after another; ``ends`` tells where each document ends. The place
        is where the item would begin, as a position in all words.
        """
        found: set[tuple[int, int, int]] = set()
        begins = np.append(0, ends[:-1])
        found.update((d, k, int(begins[d])) for d, k in self.short.search(hashes, ends))
        bits = WindowBits(hashes)
        for index in self.classes:
            grid = np.arange(0, len(hashes) - index.size + 1, index.stride)
            grid = grid[grid + index.size <= ends[np.searchsorted(ends, grid, side="right")]] if len(grid) else grid
            # the last window of each document, for items that are cut off there
            tails = (ends - index.size)[ends - index.size >= begins]
            starts = np.concatenate([grid, tails])
            if not len(starts):
                continue
            windows, entries = index.search(bits.prints(starts, index.size))
            docs = np.searchsorted(ends, starts[windows], side="right")
            places = starts[windows] - index.offsets[entries]
            found.update(zip(docs.tolist(), index.items[entries].tolist(), places.tolist(), strict=True))
        return found

    def confirmed(self, words: list[bytes], places: list[tuple[int, int]]) -> dict[int, tuple[float, int]]:
        """``{item: (similarity, start)}`` for the places ``(item, start)`` of one document."""
        best: dict[int, tuple[float, int]] = {}
        tried: set = set()
        for k, place in places:
            length = len(self.words[k])
            for shift in range(-SHIFT, SHIFT + 1):
                start = min(max(0, place + shift), max(0, len(words) - length))
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                score = weighted_similarity(self.shingles[k], shingle_counts(words[start : start + length]))
                if score >= SIMILARITY and (k not in best or (-score, start) < (-best[k][0], best[k][1])):
                    best[k] = (score, start)
        return best

    def matches(self, texts: list[str | None], memo: WordHashes) -> list[dict[int, tuple[float, int]]]:
        """The items that each document holds; pieces of documents are hashed in chunks of bounded words."""
        out: list[dict] = [{} for _ in texts]
        overlap = max((len(w) for w in self.words), default=0) + 2 * SHIFT
        chunk: list[tuple[int, list[bytes], int]] = []
        size = 0

        def flush() -> None:
            ends = np.cumsum([len(words) for _, words, _ in chunk])
            hashes = memo.array([w for _, words, _ in chunk for w in words])
            places = defaultdict(list)
            for at, k, place in self.candidates(hashes, ends):
                places[at].append((k, place - int(ends[at - 1] if at else 0)))
            for at, spots in places.items():
                i, words, first = chunk[at]
                for k, (score, start) in self.confirmed(words, spots).items():
                    best = out[i].get(k)
                    if best is None or (-score, start + first) < (-best[0], best[1]):
                        out[i][k] = (score, start + first)
            chunk.clear()

        for i, text in enumerate(texts):
            # an item may be longer than a piece: then the pieces grow with it
            for words, first in word_pieces(text, max(PIECE, 64 * overlap), overlap):
                if chunk and size + len(words) > CHUNK_WORDS:
                    flush()
                    size = 0
                if words:
                    chunk.append((i, words, first))
                    size += len(words)
        if chunk:
            flush()
        return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, identity: bool = False
) -> DataFrame:
    """``(doc_id, item_id, start_word, similarity)``, the best place of each item in each document.

    With ``identity`` also ``text_key``, a hash of the text, which tells rows with one id apart.
    """
    spark = docs.sparkSession
    items = store(benchmark.select(F.col("item_id").cast("long"), "text", word_count(F.col("text")).alias("n")).where("n > 0"))
    named = items.select("item_id", F.sha2("text", 256).alias("item_key"))
    distinct = store(items.select(F.sha2("text", 256).alias("item_key"), "text", "n").dropDuplicates(["item_key"]))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // item_block)
    keys = ["doc_id", "text_key"] if identity else ["doc_id"]
    types = ", ".join(f"{k} long" for k in keys)
    schema = types + ", item_key string, start_word long, similarity double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").select(*keys, "text")
    passes = []
    for b in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.select("item_key", "text").collect()])

        def make(held=held):
            index, memo = ItemIndex(held.value), WordHashes()

            def one(cols: dict) -> dict:
                out: dict = {k: [] for k in keys} | {"item_key": [], "start_word": [], "similarity": []}
                for at, found in enumerate(index.matches(cols["text"], memo)):
                    for k, (score, start) in sorted(found.items()):
                        for name in keys:
                            out[name].append(cols[name][at])
                        out["item_key"].append(index.ids[k])
                        out["start_word"].append(start)
                        out["similarity"].append(score)
                return out

            return one

        passes.append(map_batches(rows, (*keys, "text"), make, schema))
    if not passes:
        return spark.createDataFrame([], types + ", item_id long, start_word long, similarity double")
    found = reduce(DataFrame.unionByName, passes)
    return found.join(named, "item_key").select(*keys, "item_id", "start_word", "similarity")
