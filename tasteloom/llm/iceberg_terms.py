"""Which sources of a language differ, term by term: divergence over the terms an iceberg query keeps.

Terms are runs of letters (A-Z lower-cased, everything beyond ASCII counts as a letter). Each language keeps the
terms that occur in at least ``MIN_DOCUMENTS`` of its documents (rows). They are found by prefix refinement:

1. Every document becomes its list of distinct terms with counts, stored once; texts are read once.
2. Level by level, the prefixes of ``FIRST_BYTES`` bytes, twice that, four times ... are counted in distinct
   documents. Only terms whose shorter prefix is held by enough documents are extended. A term shorter than the
   level's length is complete, and its count is that of the term. The levels end when no prefix is open.
   A document lies in one task, so the partial counts of Arrow batches add up.
3. The surviving prefixes travel to the next level as a bitmap of their hashes: 16 bits for each, at most
   ``MAX_BITS`` in all, whatever the vocabulary. A wrong bit only lets a prefix be counted again, exactly;
   nothing is lost and nothing wrong is kept.

The occurrences of kept terms are counted by source in each batch, and one shuffle by blocks of terms adds them
up, beside the kept terms that make the test exact. A row then has all sources of one term, so the rest needs no
shuffle of terms: with N the sum of a group's counts and V the number of terms kept,
p = 1 + floor(SCALE * (count + 1) / (N + V)), in whole numbers. ``pair`` rows compare a group with every other source
of its language over all kept terms: tasks add up dense matrices of terms by sources and send one sum for each
pair. ``term`` rows are the terms that a group uses more than its language does; a batch sends its ``top`` best.

Null text, language and source are empty strings. Groups without terms have p of their language's V; a language
that keeps nothing gives pairs of value 0. Repeated rows are documents of their own. An empty table gives no
rows. Other columns are ignored. The sources of a language are expected to be few, as the result has all pairs of
them: a task holds one number for each pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

MIN_DOCUMENTS = 3
FIRST_BYTES = 4
SCALE = 1_000_000_000
TOP_TERMS = 200
MEMO = 1_000_000  # tested prefixes that a task remembers
MAX_BITS = 1 << 27
BLOCK_TERMS = 20_000  # kept terms in one block, at the average
PIECE = 8_000_000  # bytes of text that are cut into terms at a time
SLICE = 12_000_000  # bytes of term lists that are unfolded at a time
CELL = 40  # bits of a count in a cell; the source's number stands above them
_OTHER = re.compile(rb"[^A-Za-z\x80-\xff]")

_LETTER = np.zeros(256, np.uint8)  # lower-cased letters, 0 for everything else
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about ``PIECE`` bytes; a long text is cut between terms."""
    at, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while True:
            cut = _OTHER.search(text, low + PIECE) if len(text) - low > PIECE else None
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


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _terms(pieces: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the pieces in order, and the number of each one's piece."""
    codes = _LETTER[np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)]
    inner = codes != 0
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    ends = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    begins = np.cumsum([1] + [len(p) + 1 for p in pieces])
    return _binary(offsets, codes[inner]), np.searchsorted(begins, starts, "right") - 1


def _sum_by(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values (or the number) of each."""
    if values is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


def _lists(texts: list[bytes]) -> tuple[pa.Array, list[bytes]]:
    """For each text its distinct terms joined by spaces, and their counts side by side."""
    parts = []
    for at, pieces in _pieces(texts):
        terms, of = _terms(pieces)
        parts.append((terms, np.asarray(at, np.int64)[of]))
    terms = pa.concat_arrays([t for t, _ in parts]) if parts else pa.array([], pa.binary())
    coded = terms.dictionary_encode()
    width = max(1, len(coded.dictionary))
    doc = np.concatenate([d for _, d in parts]) if parts else np.zeros(0, np.int64)
    keys, counts = _sum_by(doc * width + coded.indices.to_numpy())
    ends = np.searchsorted(keys // width, np.arange(len(texts) + 1))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(keys % width)))
    counts = counts.astype(np.int32)
    return pc.binary_join(lists, b" "), [counts[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def term_lists(docs: DataFrame) -> DataFrame:
    """``(lang, source, terms, counts)`` of every row: distinct terms joined by spaces, counts side by side."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = _lists(batch.column("text").cast(pa.binary()).to_pylist())
            arrays = [batch.column("lang"), batch.column("source"), terms, pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "terms", "counts"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(lists, "lang string, source string, terms binary, counts binary")


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each language of a batch, in slices whose terms are unfolded together."""
    order = pc.sort_indices(batch.column("lang"))
    batch = batch.take(order)
    lang = batch.column("lang").dictionary_encode()
    codes = lang.indices.to_numpy()
    low, step = 0, max(1, len(codes) * SLICE // max(1, batch.nbytes))
    for high in [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]:
        for at in range(low, high, step):
            yield lang.dictionary[codes[at]].as_py(), batch.slice(at, min(step, high - at))
        low = high


def _flat(joined: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the lists, and the row of each."""
    lists = pc.split_pattern(joined, b" ")
    values, doc = lists.flatten(), np.repeat(np.arange(len(joined)), pc.list_value_length(lists).to_numpy())
    some = pc.greater(pc.binary_length(values), 0)  # a text without terms
    return values.filter(some), doc[some.to_numpy(zero_copy_only=False)]


class Bitmap:
    """Set of (language, prefix) as bits of their hashes: may hold more, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 64

    @classmethod
    def of(cls, rows: DataFrame, column: str, n: int) -> Bitmap:
        """Set the bits in Spark; at most ``MAX_BITS / 64`` rows come to the driver."""
        size = min(MAX_BITS, max(1 << 8, 1 << (16 * n - 1).bit_length()))
        place = F.col("h").bitwiseAND(F.lit(size - 1))
        words = (
            rows.select(F.xxhash64("lang", column).alias("h"))
            .groupBy(F.shiftright(place, 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
            .toPandas()
        )
        out = np.zeros(size // 64, np.int64)
        out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        return cls(out.view(np.uint64))

    def test(self):
        """A remembering test of one language's prefixes, for use in a task."""
        known: dict[str, dict[bytes, bool]] = {}
        bits, mask = self.bits, self.size - 1

        def passes(lang: str, prefixes: pa.Array) -> np.ndarray:
            seed, memo = xxhash.xxh64_intdigest(lang.encode(), 42), known.setdefault(lang, {})
            if len(memo) > MEMO:
                memo.clear()
            out = np.zeros(len(prefixes), bool)
            for i, prefix in enumerate(prefixes.to_pylist()):
                found = memo.get(prefix)
                if found is None:
                    h = xxhash.xxh64_intdigest(prefix, seed) & mask
                    found = memo[prefix] = bool(int(bits[h >> 6]) >> (h & 63) & 1)
                out[i] = found
            return out

        return passes


def prefix_counts(lists: DataFrame, size: int, before: int, survivors: Bitmap | None) -> DataFrame:
    """``(lang, prefix, n)``: documents of a language that hold a prefix of ``size`` bytes, or a whole shorter term.

    Terms of fewer than ``before`` bytes were complete earlier; longer ones go on if their prefix of
    ``before`` bytes survived.
    """
    held = lists.sparkSession.sparkContext.broadcast(survivors)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = held.value.test() if held.value is not None else None
        for batch in batches:
            for lang, rows in _by_language(batch):
                terms, doc = _flat(rows.column("terms"))
                if passes is not None:
                    long = pc.greater_equal(pc.binary_length(terms), before)
                    terms, doc = terms.filter(long), doc[long.to_numpy(zero_copy_only=False)]
                    short = pc.binary_slice(terms, 0, before).dictionary_encode()
                    go = passes(lang, short.dictionary)[short.indices.to_numpy()]
                    terms, doc = terms.filter(pa.array(go)), doc[go]
                coded = pc.binary_slice(terms, 0, size).dictionary_encode()
                width = max(1, len(coded.dictionary))
                pairs = np.unique(doc * width + coded.indices.to_numpy())  # a document counts once
                n = np.bincount(pairs % width, minlength=len(coded.dictionary))
                names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32)))
                yield pa.RecordBatch.from_arrays([names, coded.dictionary, pa.array(n, pa.int64())], ["lang", "prefix", "n"])

    counted = lists.select("lang", "terms").mapInArrow(count, "lang string, prefix binary, n long")
    return counted.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def kept_terms(lists: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, term, n)``: terms in at least ``min_documents`` rows of a language."""
    size, before, survivors, found = FIRST_BYTES, 0, None, []
    while True:
        counts = prefix_counts(lists, size, before, survivors)
        level = store(counts.where(F.col("n") >= min_documents))
        found.append(level.where(F.length("prefix") < size).select("lang", F.col("prefix").alias("term"), "n"))
        open_prefixes = level.where(F.length("prefix") == size)
        n = open_prefixes.count()
        if not n:
            break
        survivors = Bitmap.of(open_prefixes, "prefix", n)
        size, before = 2 * size, size
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sources_of(lists: DataFrame) -> dict[str, list[str]]:
    """The sources of each language, by code point: the root of what the result holds of pairs."""
    out: dict[str, list[str]] = {}
    for r in lists.select("lang", "source").distinct().collect():
        out.setdefault(r["lang"], []).append(r["source"])
    return {lang: sorted(names) for lang, names in out.items()}


def term_cells(lists: DataFrame, kept: DataFrame, sources: dict[str, list[str]]) -> DataFrame:
    """``(lang, term, cells)``: for each kept term the sources that have it, with their counts.

    A cell is the source's place in its language, shifted by ``CELL`` bits, plus the count. Rows without a term
    hold the sums of a block for each source.
    """
    n_kept = kept.count()
    held = lists.sparkSession.sparkContext.broadcast((Bitmap.of(kept, "term", n_kept), sources))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = held.value[0].test()
        for batch in batches:
            for lang, rows in _by_language(batch):
                names = held.value[1][lang]
                number = {s: i for i, s in enumerate(names)}
                place = np.array([number[s] for s in rows.column("source").to_pylist()], np.int64)
                terms, doc = _flat(rows.column("terms"))
                counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32).astype(np.int64)
                coded = terms.dictionary_encode()
                at = coded.indices.to_numpy()
                go = passes(lang, coded.dictionary)[at]
                keys, sums = _sum_by(at[go] * np.int64(len(names)) + place[doc[go]], counts[go])
                term, place = np.divmod(keys, len(names))
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
                cells = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(term)), pa.int32()), pa.array((place << CELL) + sums)
                )
                same = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(first), np.int32)))
                found = coded.dictionary.take(pa.array(term[first]))
                yield pa.RecordBatch.from_arrays([same, found, cells], ["lang", "term", "cells"])

    parts = lists.mapInArrow(count, "lang string, term binary, cells array<long>")
    block = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-n_kept // BLOCK_TERMS)))).alias("block")

    def add_up(mine: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("cells", pa.list_(pa.int64()))])
        if not mine.num_rows or not found.num_rows:
            return schema.empty_table()
        terms = mine.column("term").combine_chunks()
        at = pc.index_in(found.column("term"), value_set=terms)  # null: not kept, the bitmap let it pass
        known = at.is_valid()
        found, at = found.filter(known), at.filter(known).to_numpy()
        lists = found.column("cells").combine_chunks()
        cells = lists.flatten().to_numpy()
        term = np.repeat(at, pc.list_value_length(lists).to_numpy()).astype(np.int64)
        place, n = cells >> CELL, cells & ((1 << CELL) - 1)
        width = int(place.max()) + 1
        keys, sums = _sum_by(term * width + place, n)
        term, place = np.divmod(keys, width)
        total = np.bincount(place, sums, width).astype(np.int64) if sums.sum() < 1 << 53 else _sum_by(place, sums)[1]
        ends = np.append(np.searchsorted(term, np.arange(len(terms) + 1)), len(term) + width)
        every = np.concatenate([(place << CELL) + sums, (np.arange(width) << CELL) + total])
        lang = pa.array([mine.column("lang")[0].as_py()] * (len(terms) + 1), pa.string())
        names = pa.concat_arrays([terms, pa.array([None], pa.binary())])
        return pa.table([lang, names, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every))], schema=schema)

    wanted = kept.select("lang", "term", block).groupBy("lang", "block")
    return wanted.cogroup(parts.select("*", block).groupBy("lang", "block")).applyInArrow(
        add_up, "lang string, term binary, cells array<long>"
    )


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """p = 1 + floor(SCALE * (count + 1) / total), exact for totals below 9e15 by dividing three digits at a time.

    ``total`` is N + V, never less than count + 1.
    """
    rest, out, left = counts + 1, np.zeros_like(counts), SCALE
    while left > 1:
        step = min(1000, left)
        out, rest, left = out * step + rest * step // total, rest * step % total, left // step
    # SCALE is a power of ten; a share of one leaves the whole in the first digit
    return 1 + out


def compare_sources(cells: DataFrame, sources: dict[str, list[str]], top: int = TOP_TERMS) -> DataFrame:
    """``(lang, place, other, term, value)``: a sum for each ordered pair of sources (no term), and what may be among
    the ``top`` terms of a source (other is -1)."""
    totals = {lang: np.zeros(len(names), np.int64) for lang, names in sources.items()}
    kept = dict.fromkeys(sources, 0)
    # a number for each source, and one for each language
    sums = cells.where("term is null").select("lang", F.explode("cells").alias("c"))
    for r in sums.groupBy("lang", F.shiftright("c", CELL).alias("place")).agg(F.sum(F.col("c").bitwiseAND(F.lit((1 << CELL) - 1)))).collect():
        totals[r[0]][r[1]] = r[2]
    for r in cells.where("term is not null").groupBy("lang").count().collect():
        kept[r[0]] = r[1]
    held = cells.sparkSession.sparkContext.broadcast((totals, kept))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, kept = held.value
        names = ["lang", "place", "other", "term", "value"]
        pairs: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in _by_language(batch):
                total, n = totals[lang], rows.num_rows
                lists = rows.column("cells")
                cell = lists.flatten().to_numpy()
                term = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
                place, count = cell >> CELL, cell & ((1 << CELL) - 1)
                p = shares(count, total[place] + kept[lang])
                absent = shares(np.zeros(len(total), np.int64), total + kept[lang])
                ends = np.searchsorted(term, np.arange(n + 1))
                mine = pairs.setdefault(lang, np.zeros((len(total), len(total)), np.int64))
                width = max(1, 400_000 // len(total))
                for low in range(0, n, width):
                    high = min(n, low + width)
                    some = slice(ends[low], ends[high])
                    dense = np.tile(absent, (high - low, 1))
                    dense[term[some] - low, place[some]] = p[some]
                    for g in range(len(total)):
                        apart = dense[:, g : g + 1] - dense
                        mine[g] += (apart * apart // dense).sum(0)
                q = shares(np.add.reduceat(count, ends[:-1]), int(total.sum()) + kept[lang])[term]
                above = np.flatnonzero(p > q)
                value = (p[above] - q[above]) ** 2 // q[above]
                rank = np.empty(n, np.int64)  # of the terms, by bytes
                rank[pc.sort_indices(rows.column("term")).to_numpy()] = np.arange(n)
                order = np.lexsort((rank[term[above]], -value, place[above]))
                above, value = above[order], value[order]
                begins = np.searchsorted(place[above], place[above])
                best = np.arange(len(above)) - begins < top
                above, value = above[best], value[best]
                columns = [pa.array([lang] * len(above), pa.string()), pa.array(place[above], pa.int32())]
                columns += [pa.array(np.full(len(above), -1), pa.int32()), rows.column("term").take(pa.array(term[above]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names)
        for lang, mine in pairs.items():
            place, other = np.divmod(np.arange(mine.size), len(mine))
            columns = [pa.array([lang] * mine.size, pa.string()), pa.array(place, pa.int32()), pa.array(other, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(mine.size, pa.binary()), pa.array(mine.ravel())], names)

    return cells.where("term is not null").mapInArrow(compare, "lang string, place int, other int, term binary, value long")


def audit_sources(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source lies from the others of its language
    (part ``pair``, all of them), and the terms it uses more than its language (part ``term``, the first ``top``)."""
    spark = docs.sparkSession
    lists = store(term_lists(docs))
    sources = sources_of(lists)
    kept = store(kept_terms(lists, min_documents))
    cells = store(term_cells(lists, kept, sources))
    found = store(compare_sources(cells, sources, top))
    rows = [(lang, s, i) for lang, names in sources.items() for i, s in enumerate(names)]
    groups = spark.createDataFrame(rows, "lang string, source string, place int")
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    sums = found.where("other >= 0").groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    pairs = groups.join(others, "lang").where("place <> other").join(sums, ["lang", "place", "other"], "left")
    value = F.coalesce("value", F.lit(0).cast("long")).alias("value")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value)
    terms = found.where("other < 0").join(F.broadcast(groups), ["lang", "place"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.expr("decode(term, 'UTF-8')").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
