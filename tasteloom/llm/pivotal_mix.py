"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; a document is wanted target / source size times, a number of whole
copies and a fraction. The fractions are rounded in pairs: two documents exchange *words* until one of
them has no fraction or a whole copy more, with chances that keep every expected value. As the words of
the pair stay the same in each exchange, a source's total moves only when its very last open document is
rounded, by less than that document's size. Documents are processed from long to short, so that the last
one is usually short, and the words it leaves are exchanged against a few documents of about that size.

Blocks of a source are reduced in parallel tasks, each leaving at most one open document; these meet in
further rounds of ``FAN_IN`` blocks each, until a source has one. Chances come from a hash of the document,
its partner and a seed, so reruns agree.

Null sources are one source that comes last; null texts have size 0. A document without words is never
taken. Rows that share a ``doc_id`` are separate. A table without words has targets of 0.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .words import word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_ROWS = 20_000
FAN_IN = 64
SEED = 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, source_rows, weight, target)``, one row for each source.

    A source's level is the share per unit of weight at which it reaches ``most`` times its size. All
    sources below the common level are full; the rest share what is left by weight. Going through the
    sources by level, the common level is fixed by the first one that it does not fill.
    """
    totals = store(
        sizes.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
        )
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    shares = F.array(*[F.lit(float(w)) for w in weights])
    # one row per source: names of sources are few against documents, so a single window holds them
    ranked = totals.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(shares, (F.col("place") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("full", F.col("source_size") * float(most)).withColumn(
        "level", F.col("full") / F.col("weight")
    )
    by_level = Window.orderBy("level", "place")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("taken_below", F.coalesce(F.sum("full").over(upto), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("try", (F.col("all_size") - F.col("taken_below")) / F.col("weight_left"))
    )
    not_filled = F.when(F.col("try") <= F.col("level"), F.struct("level", "place", "try"))
    ranked = ranked.withColumn("common", F.min(not_filled).over(everything)["try"])
    target = F.least(F.col("full"), F.col("weight") * F.coalesce("common", F.lit(0.0)))
    return ranked.select("source", "source_size", "source_rows", "weight", target.alias("target"))


def _chance(seed: int, step: int, a: tuple, b: tuple) -> float:
    digest = hashlib.blake2b(repr((seed, step, a, b)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2.0**64


def pair_off(rows: list, seed: int, step: int) -> tuple[dict, tuple | None]:
    """Round ``[(name, size, fraction)]`` in order; returns the decided 0/1 by index and what is open.

    The open entry is ``(index, fraction)``.
    """
    decided: dict[int, int] = {}
    held = None
    for i, (_, size, part) in enumerate(rows):
        if part <= 0.0 or part >= 1.0:
            decided[i] = int(part >= 1.0)
            continue
        if held is None:
            held = (i, part)
            continue
        j, other = held
        other_size = rows[j][1]
        # words that can go from the new one to the held one, and back
        give = min(part * size, (1.0 - other) * other_size)
        take = min((1.0 - part) * size, other * other_size)
        up = _chance(seed, step, rows[j][0], rows[i][0]) < take / (give + take)
        words = give if up else -take
        part_filled = (1.0 - part) * size <= other * other_size
        part_emptied = part * size <= (1.0 - other) * other_size
        if up:  # words go from the new one to the held one
            if part_emptied:
                decided[i] = 0
                held = (j, other + words / other_size)
            else:
                decided[j] = 1
                held = (i, part - words / size)
        elif part_filled:
            decided[i] = 1
            held = (j, other + words / other_size)
        else:
            decided[j] = 0
            held = (i, part - words / size)
        if held is not None and not 1e-12 < held[1] < 1.0 - 1e-12:
            decided[held[0]] = int(held[1] > 0.5)
            held = None
    return decided, held


def settle(sizes: list[float], decided: dict[int, int], over: float, exchanges: int = 4) -> list[int]:
    """Exchange whole copies against the error that the last document left (``over``: words too many).

    Each step turns over the one decision that brings the words nearest to the target, as long as one
    does; returns the documents it turned over. Only few words are left to move, so few change.
    """
    turned = []
    for _ in range(exchanges):
        gains = ((abs(over + (sizes[i] if d == 0 else -sizes[i])), i) for i, d in decided.items())
        best, i = min(gains, default=(float("inf"), -1))
        if best >= abs(over):
            break
        over += sizes[i] if decided[i] == 0 else -sizes[i]
        decided[i] = 1 - decided[i]
        turned.append(i)
    return turned


CARRIED = "doc_id long, text_key long, source string, size long, source_size long, target double, whole long"


def _reduce_blocks(rows: DataFrame, step: int, last: bool, seed: int) -> DataFrame:
    """Round each ``(source, block)``; ``extra`` is the decision, null for the one left open."""
    schema = CARRIED + ", fraction double, block long, extra long"

    def run(block: pa.Table) -> pa.Table:
        columns = {c: block.column(c).to_pylist() for c in block.column_names}
        ids, keys, sizes, parts = columns["doc_id"], columns["text_key"], columns["size"], list(columns["fraction"])
        order = sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i] is not None, ids[i] or 0, keys[i]))
        entries = [(ids[i], float(sizes[i]), parts[i]) for i in order]
        decided, held = pair_off(entries, seed, step)
        extra: list = [None] * len(ids)
        for at, value in decided.items():
            extra[order[at]] = value
        if held is not None:
            at, part = held
            name = entries[at][0]
            if last:
                decided[at] = int(_chance(seed, step, name, name) < part)
                for i in settle([e[1] for e in entries], decided, (decided[at] - part) * entries[at][1]):
                    extra[order[i]] = decided[i]
                extra[order[at]] = decided[at]
            parts[order[at]] = part
        block = block.set_column(block.column_names.index("fraction"), "fraction", pa.array(parts, pa.float64()))
        return block.append_column("extra", pa.array(extra, pa.int64()))

    names = [part.strip().split()[0] for part in schema.split(",")][:-1]
    return rows.select(*names).groupBy("source", "block").applyInArrow(run, schema)


def mix_documents(
    docs: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``text_key`` is a hash of the text, which tells rows with one id apart.
    """
    sizes = store(
        docs.select(
            F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "source", word_count(F.col("text")).alias("size")
        )
    )
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "_source")
    wanted = F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    wanted = F.when(F.col("size") > 0, wanted).otherwise(0.0)
    rows = store(
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.floor(wanted).cast("long"))
        .withColumn("fraction", wanted - F.col("whole"))
        # one task holds one block of one source, so a source of any size is many tasks
        .withColumn("blocks", F.expr(f"(source_rows - 1) div {block_rows} + 1"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
        .drop("_source", "weight")
    )
    done = [rows.where("fraction = 0").withColumn("extra", F.lit(0).cast("long"))]
    current, step = rows.where("fraction > 0"), 0
    blocks = rows.agg(F.max("blocks")).first()[0] or 1
    while True:
        out = store(_reduce_blocks(current, step, blocks == 1, seed))
        done.append(out.where(F.col("extra").isNotNull()))
        if blocks == 1:
            break
        current = out.where(F.col("extra").isNull()).withColumn("block", F.expr(f"block div {FAN_IN}"))
        blocks, step = -(-blocks // FAN_IN), step + 1
    names = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    copies = (F.col("whole") + F.col("extra")).alias("copies")
    every = [d.select(*names, copies) for d in done]
    return reduce(DataFrame.unionByName, every).withColumn("taken", F.col("copies") * F.col("size"))
