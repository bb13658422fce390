"""Removal of repeated passages with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. A word is removed if a window that covers it
occurs earlier (smaller ``doc_id``, or the same document and an earlier start).

1. Anchors. The least of the ``GRAM``-word hashes in a window is its anchor. Equal windows have equal
   anchors, so a window can only recur if its anchor does. Anchors that occur twice, with the smallest
   document of each, are found by one aggregation of slim rows: one for each document and anchor. Anchors with
   more than a ``HOT_SHARE`` of these rows are few, and their rows are salted where they meet their documents.
2. Confirming. In documents that hold recurring anchors, the windows of these anchors are hashed; the
   number of places of each hash tells recurring windows, the smallest document where they start.
3. Automata. Recurring windows are joined with that document; their words become the patterns. A shard holds
   the patterns whose anchors first occur in its documents, so a copied document meets few shards. Each
   shard is compiled with pyahocorasick over word numbers, and the documents that hold one of the
   shard's anchors stream through it. A shard with many documents is compiled in several tasks, each of which
   streams a bounded block of them. The automaton holds the anchors of the confirmed windows; at a hit the
   windows of that anchor are compared word by word, so a hash collision cannot remove a word.
4. Every match that is not the pattern's first place marks its words; marks of a document are merged, and
   the kept words are joined.

Null texts have no words. A document without an id comes before all others, in the order of a hash of its text.
Rows that share ``doc_id`` and text are one document listed more than once: each
gets the same result, and they do not make each other's windows recur. Of rows that share only the ``doc_id``
each is judged by place: what starts elsewhere in another of them later is a repeat. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .words import TextHashes, gram_hashes, map_batches, split_words

WINDOW = 20
GRAM = 10
HOT_SHARE = 1000  # an anchor is hot with more than one in so many rows
SALTS = 64
PART_BYTES = 4_000_000  # text that is hashed together
SHARD_WINDOWS = 30_000  # patterns of one automaton, at the average
BLOCK_CHARS = 8_000_000  # text that one task streams through one automaton, at the average
CODE = array("i").itemsize  # bytes of a word's number


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, text, own_id)``: ``t`` tells apart texts that share an id; a null id is told by the text, so that
    texts without an id are documents of their own."""
    text, own = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    nameless = F.shiftright(F.xxhash64(text, F.lit(1)), 2) - F.lit(3 * 2**61)  # below -2**62
    return docs.select(F.coalesce(own, nameless).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"), own.alias("own_id"))


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """Start of the least gram of each window; the first one if several are equal.

    The least of a span is the lesser of the least of two spans that cover it, so spans are doubled.
    """
    least = gram_hashes(hashes, GRAM)
    at = np.arange(len(least), dtype=np.int32)
    width, span = 1, WINDOW - GRAM + 1
    while width < span:
        step = min(width, span - width)
        first = least[:-step] <= least[step:]
        least, at = np.where(first, least[:-step], least[step:]), np.where(first, at[:-step], at[step:])
        width += step
    return at


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    return gram_hashes(hashes, WINDOW).view(np.int64)


def _joined(parts: list) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    low = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= PART_BYTES:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


class Windows:
    """Anchors and hashes of the windows of some texts whose words stand one after another."""

    def __init__(self, hashes: np.ndarray, ends: np.ndarray):
        self.hashes, self.ends, self.begins = hashes, ends, np.append(0, ends[:-1])
        self.text = np.repeat(np.arange(len(ends)), ends - self.begins)  # of each word
        self.at = window_anchors(hashes) if len(hashes) >= WINDOW else np.zeros(0, np.int32)
        self.grams = gram_hashes(hashes, GRAM).view(np.int64) if len(hashes) >= WINDOW else np.zeros(0, np.int64)
        starts = np.arange(len(self.at))
        self.inside = starts + WINDOW <= ends[self.text[: len(self.at)]] if len(self.at) else starts.astype(bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, anchor, places) of the anchors of all windows, each text's anchors once."""
        places = np.unique(self.at[self.inside])
        text, anchor = self.text[places], self.grams[places]
        order = np.lexsort((anchor, text))
        text, anchor = text[order], anchor[order]
        if not len(text):
            return text, anchor, text
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])]))
        return text[first], anchor[first], np.diff(np.append(first, len(text)))

    def of_anchors(self, lists: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, its first word, names, wanted) of each text's windows: their anchors, and whether these are listed."""
        for i, wanted in enumerate(lists):
            low, high = int(self.begins[i]), int(self.ends[i]) - WINDOW + 1
            if high > low:
                names = self.grams[self.at[low:high]]
                yield i, low, names, np.isin(names, np.asarray(wanted, np.int64))


def anchor_rows(rows: DataFrame) -> DataFrame:
    """``(doc_id, anchor, n)``: the anchors of each document, and how often."""

    def make():
        hashed = TextHashes()

        def one(cols: dict) -> dict:
            texts = [t.encode("utf-8", "surrogatepass") for t in cols["text"]]
            ids, anchors, counts = [], [], []
            for low, high in _parts(texts):
                text, anchor, n = Windows(*hashed.of(texts[low:high])).anchors()
                ids.append(np.asarray(cols["doc_id"][low:high], np.int64)[text])
                anchors.append(anchor)
                counts.append(n)
            return {"doc_id": _joined(ids), "anchor": _joined(anchors), "n": _joined(counts)}

        return one

    return map_batches(rows, ("doc_id", "text"), make, "doc_id long, anchor long, n int")


def recurring_anchors(anchors: DataFrame) -> DataFrame:
    """``(anchor, first, rows)``: anchors with two places or more, the smallest document of each, and its rows."""
    counted = anchors.groupBy("anchor").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    return counted.where("n > 1").select("anchor", "first", "rows")


def salted(rows: DataFrame, hot: DataFrame, spread_out: bool) -> DataFrame:
    """Add ``salt``: rows of a hot anchor are dealt over ``SALTS``, or repeated for each of them."""
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "anchor", "left")
    dealt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "anchor"]), F.lit(SALTS)).cast("int")
    if spread_out:
        return marked.withColumn("salt", F.when(F.col("_hot"), dealt).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("salt", F.explode(each)).drop("_hot")


def window_rows(held: DataFrame) -> DataFrame:
    """``(window, doc_id)`` for the windows of recurring anchors."""

    def make():
        hashed = TextHashes()

        def one(cols: dict) -> dict:
            texts = [t.encode("utf-8", "surrogatepass") for t in cols["text"]]
            windows, ids = [], []
            for low, high in _parts(texts):
                some = Windows(*hashed.of(texts[low:high]))
                own = window_hashes(some.hashes) if len(some.at) else some.grams
                for i, begin, names, mine in some.of_anchors(cols["anchors"][low:high]):
                    windows.append(own[begin : begin + len(names)][mine])
                    ids.append(np.full(len(windows[-1]), cols["doc_id"][low + i]))
            return {"window": _joined(windows), "doc_id": _joined(ids)}

        return one

    return map_batches(held, ("doc_id", "text", "anchors"), make, "window long, doc_id long")


def first_documents(windows: DataFrame) -> DataFrame:
    """``(doc_id, windows)``: the recurring windows that occur first in a document."""
    spans = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    # no more windows than the document has words
    return spans.where("n > 1").groupBy("doc_id").agg(F.collect_list("window").alias("windows"))


def pattern_rows(held: DataFrame, firsts: DataFrame, shards: int) -> DataFrame:
    """``(shard, doc_id, start, words, offsets, anchors)``: runs of recurring windows at their first places.

    A run is governed by one shard; ``offsets`` tell where each window's anchor begins in it.
    """

    def make():
        hashed = TextHashes()

        def one(cols: dict) -> dict:
            out: dict = {"shard": [], "doc_id": [], "start": [], "words": [], "offsets": [], "anchors": []}
            texts = [t.encode("utf-8", "surrogatepass") for t in cols["text"]]
            for low, high in _parts(texts):
                some = Windows(*hashed.of(texts[low:high]))
                every = window_hashes(some.hashes) if len(some.at) else some.grams
                for i, begin, names, mine in some.of_anchors(cols["anchors"][low:high]):
                    own, n = every[begin : begin + len(names)], low + i
                    first = dict(zip(cols["anchors"][n], cols["firsts"][n], strict=True))
                    offsets = (some.at[begin : begin + len(names)] - np.arange(begin, begin + len(names))).astype(np.uint8)
                    found, places = np.unique(own, return_index=True)
                    spots = np.sort(places[np.isin(found, np.array(cols["windows"][n], np.int64))])
                    spots = spots[mine[spots]].tolist()
                    if not spots:
                        continue
                    words = texts[n].split()
                    owner = [shard_of(first[int(names[p])], shards) for p in spots]
                    a = 0
                    while a < len(spots):
                        b = a
                        while b + 1 < len(spots) and spots[b + 1] == spots[b] + 1 and owner[b + 1] == owner[a]:
                            b += 1
                        out["shard"].append(owner[a])
                        out["doc_id"].append(cols["doc_id"][n])
                        out["start"].append(spots[a])
                        out["words"].append(b" ".join(words[spots[a] : spots[b] + WINDOW]))
                        out["offsets"].append(offsets[spots[a] : spots[b] + 1].tobytes())
                        out["anchors"].append(np.unique(names[spots[a] : spots[b] + 1]))
                        a = b + 1
            return out

        return one

    return map_batches(
        held.join(firsts, "doc_id"),
        ("doc_id", "text", "anchors", "firsts", "windows"),
        make,
        "shard int, doc_id long, start long, words binary, offsets binary, anchors array<long>",
    )


def shard_of(first: int, shards: int) -> int:
    return xxhash.xxh32_intdigest(int(first).to_bytes(8, "little", signed=True)) % shards


class PhraseAutomaton:
    """One shard: an automaton over the anchors of its windows, and the windows with their first place.

    Words are numbered within the shard (0: in none of its windows), a window's key is its numbers side by
    side. The automaton finds each anchor in one pass over a document; at a
    hit, the windows that have it as their anchor are compared word by word.
    """

    def __init__(self, patterns: Iterator[tuple]):
        self.numbers: dict[bytes, int] = {}
        self.places: dict[bytes, tuple[int, int]] = {}
        anchors: dict[tuple, set[int]] = {}
        number = self.numbers
        for doc_id, start, joined, offsets in patterns:
            codes = tuple([number.setdefault(w, len(number) + 1) for w in joined.split(b" ")])
            packed = array("i", codes).tobytes()
            for i, offset in enumerate(offsets):
                place = (doc_id, start + i)
                window = packed[CODE * i : CODE * (i + WINDOW)]
                if self.places.setdefault(window, place) > place:
                    self.places[window] = place
                anchors.setdefault(codes[i + offset : i + offset + GRAM], set()).add(offset)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for anchor, offsets in anchors.items():
            self.automaton.add_word(anchor, tuple(offsets))
        self.automaton.make_automaton()

    def marked_runs(self, text: str, doc_id: int) -> list[int]:
        """Flat list start, end, start, end ... of the words that later places cover."""
        number, places = self.numbers.get, self.places.get
        codes = tuple([number(w, 0) for w in split_words(text)])
        packed = array("i", codes).tobytes()
        starts = set()
        for last, offsets in self.automaton.iter(codes):
            for offset in offsets:
                start = last - GRAM + 1 - offset
                if start < 0:
                    continue
                place = places(packed[CODE * start : CODE * (start + WINDOW)])
                if place is not None and place != (doc_id, start):
                    starts.add(start)
        runs: list[int] = []
        for start in sorted(starts):
            if runs and start <= runs[-1]:
                runs[-1] = start + WINDOW
            else:
                runs += [start, start + WINDOW]
        return runs


def located(patterns: DataFrame, visits: DataFrame) -> DataFrame:
    """Stream each block's documents through its shard's automaton: ``(doc_id, t, runs)``."""
    schema = "doc_id long, t long, runs array<int>"
    fields = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            columns = (left.column(c).to_pylist() for c in ("doc_id", "start", "words", "offsets"))
            shard = PhraseAutomaton(zip(*columns, strict=True))
            for at in range(right.num_rows):
                doc_id, t, text = (right.column(c)[at].as_py() for c in ("doc_id", "t", "text"))
                if runs := shard.marked_runs(text, doc_id):
                    out.append((doc_id, t, runs))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return patterns.groupBy("shard", "block").cogroup(visits.groupBy("shard", "block")).applyInArrow(stream, schema)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def kept_words(text: str, runs: list[list[int]] | None) -> tuple[list[bytes], int]:
    """Words that stay, and the number of all words."""
    words = split_words(text)
    kept = bytearray(b"\x01") * len(words)
    for flat in runs or ():
        for start, end in zip(flat[::2], flat[1::2], strict=True):
            kept[start:end] = bytes(end - start)
    return list(compress(words, kept)), len(words)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])`` for every row."""
    rows = _keyed(docs)
    anchors = store(anchor_rows(rows))
    recurring = store(recurring_anchors(anchors))
    # fewer than HOT_SHARE anchors
    hot = store(recurring.where(F.col("rows") > F.lit(max(100, anchors.count() // HOT_SHARE))).select("anchor"))
    # no more anchors than the document has words; rows that share an id bring theirs together
    held_anchors = (
        salted(anchors.select("doc_id", "anchor"), hot, True)
        .join(salted(recurring.select("anchor", "first"), hot, False), ["anchor", "salt"])
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("anchor", "first")).alias("a"))
        .select("doc_id", F.col("a.anchor").alias("anchors"), F.col("a.first").alias("firsts"))
    )
    # the one shuffle of all texts; only documents that hold a recurring anchor go on
    held = store(rows.drop("own_id").join(held_anchors, "doc_id").dropDuplicates(["doc_id", "t"]))
    firsts = store(first_documents(window_rows(held)))
    total = firsts.agg(F.sum(F.size("windows"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WINDOWS))
    patterns = store(pattern_rows(held, firsts, shards))

    @F.arrow_udf("int")
    def shard_number(firsts: pa.Array) -> pa.Array:
        return pa.array([shard_of(f, shards) for f in firsts.to_pylist()], pa.int32())

    # a document visits the shards whose confirmed anchors it holds
    confirmed = patterns.select(F.explode("anchors").alias("anchor")).distinct()
    visits = (
        held.select("doc_id", "t", F.length("text").alias("size"), F.explode(F.arrays_zip("anchors", "firsts")).alias("a"))
        .select("doc_id", "t", "size", F.col("a.anchors").alias("anchor"), F.col("a.firsts").alias("first"))
    )
    visits = (
        salted(visits, hot, True)
        .join(salted(confirmed, hot, False), ["anchor", "salt"])
        .select("doc_id", "t", "size", "first")
        .distinct()
        .withColumn("shard", shard_number("first"))
        .select("doc_id", "t", "size", "shard")
        .distinct()
    )
    visits = store(visits)
    # one row per shard: blocks that keep a task's text bounded
    sizes = visits.groupBy("shard").agg((F.sum("size") / F.lit(float(BLOCK_CHARS))).alias("size"))
    sizes = sizes.select("shard", F.ceil(F.greatest("size", F.lit(1.0))).cast("int").alias("blocks"))
    dealt = (
        visits.join(sizes, "shard")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "t"), F.col("blocks")).cast("int"))
        .groupBy("doc_id", "t")
        .agg(F.collect_list(F.struct("shard", "block")).alias("homes"))
    )
    sent = held.select("doc_id", "t", "text").join(dealt, ["doc_id", "t"]).withColumn("home", F.explode("homes"))
    sent = sent.select("home.shard", "home.block", "doc_id", "t", "text")
    copied = patterns.join(sizes, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    marks = located(copied.select("shard", "block", "doc_id", "start", "words", "offsets"), sent)
    merged = store(marks.groupBy("doc_id", "t").agg(F.collect_list("runs").alias("runs")))

    def make():
        def one(cols: dict) -> dict:
            out: dict = {"doc_id": cols["doc_id"], "t": cols["t"], "n_removed": [], "new_sha256": [], "new_text": []}
            for text, runs in zip(cols["text"], cols["runs"], strict=True):
                words, n = kept_words(text, runs)
                out["n_removed"].append(n - len(words))
                out["new_sha256"].append(_digest(words))
                out["new_text"].append(b" ".join(words).decode("utf-8", "surrogatepass") if with_text else None)
            return out

        return one

    changed = map_batches(
        held.join(merged, ["doc_id", "t"]),
        ("doc_id", "t", "text", "runs"),
        make,
        "doc_id long, t long, n_removed long, new_sha256 string, new_text string",
    )
    return _with_unchanged(rows, changed, with_text)


def _with_unchanged(rows: DataFrame, changed: DataFrame, with_text: bool) -> DataFrame:
    def make():
        def one(cols: dict) -> dict:
            split = [split_words(text) for text in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "t": cols["t"],
                "own_id": cols["own_id"],
                "n_words": [len(w) for w in split],
                "old_sha256": [_digest(w) for w in split],
                "old_text": [b" ".join(w).decode("utf-8", "surrogatepass") if with_text else None for w in split],
            }

        return one

    every = map_batches(
        rows, ("doc_id", "t", "own_id", "text"), make,
        "doc_id long, t long, own_id long, n_words long, old_sha256 string, old_text string",
    )
    joined = every.join(changed, ["doc_id", "t"], "left")
    out = [
        F.col("own_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("new_sha256", "old_sha256").alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.coalesce("new_text", "old_text").alias("kept"))
    return joined.select(*out)
