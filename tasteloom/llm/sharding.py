"""Extendible hashing into shards of bounded bytes, with DataFrame operations only.

Every row has 60 hash bits. The directory starts with one bucket; a bucket above the byte limit is
split on its next bit, and only it, until each bucket fits. ``directory`` finds the leaves without
one pass per bit: rows are summed by a prefix of ``STEP`` more bits than are settled, the sums roll
up to every shorter prefix, and a leaf is the shortest prefix that fits. Only rows of prefixes that
are still too large take part in the next step, so the usual table needs one or two aggregations.

A bucket with one row is never split: a row above the limit is a shard of its own (``over_limit``).
Rows that repeat exactly are told apart by a copy number, so a group of copies spreads like any
other rows; the copies are counted first, so a hot group is one row up to that point.

Null texts have size 0 and are placed as empty texts; a null key is a key of its own. Rows that
share a key but not a text hash apart. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

BITS = 60  # fifteen hex digits of the digest
STEP = 12  # bits settled by one aggregation
COPIES = 4096  # copies made from one row in one task
SHARD_BYTES = 1 << 20


def hash_bits(key: Column, digest: Column, copy: Column) -> Column:
    named = F.md5(F.concat_ws("|", key.cast("string"), digest, copy.cast("string")))
    return F.conv(F.substring(named, 1, BITS // 4), 16, 10).cast("long")


def sized_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, digest, copy, n_bytes, bits)``: one slim row for each input row."""
    value = F.coalesce(F.col(text), F.lit(""))
    counted = (
        docs.select(F.col(key), F.md5(value).alias("digest"), F.octet_length(value).cast("long").alias("n_bytes"))
        .groupBy(key, "digest", "n_bytes")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    one = counted.where("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    # a large group of copies becomes blocks first, and the blocks are dealt out
    blocks = counted.where("copies > 1").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}")))
    )
    first = F.col("block") * COPIES
    many = blocks.repartition(key, "digest", "block").withColumn(
        "copy", F.explode(F.sequence(first, F.least(first + (COPIES - 1), F.col("copies") - 1)))
    )
    columns = [key, "digest", "n_bytes", "copy"]
    rows = one.select(*columns).unionByName(many.select(*columns))
    return rows.withColumn("bits", hash_bits(F.col(key), F.col("digest"), F.col("copy")))


def prefix(bits: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits as a number."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """The leaves: ``(depth, prefix, shard_bytes, shard_rows)``; ``rows`` need ``bits`` and ``n_bytes``."""
    spark, leaves, settled, open_cells = rows.sparkSession, None, 0, None
    while True:
        deep = min(BITS, settled + step)
        part = rows
        if open_cells is not None:
            part = rows.withColumn("cell", prefix(F.col("bits"), settled)).join(open_cells, "cell", "left_semi")
        cells = store(
            part.groupBy(prefix(F.col("bits"), deep).alias("cell")).agg(
                F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
            )
        )
        depths = F.sequence(F.lit(settled), F.lit(deep))
        nodes = (
            cells.withColumn("depth", F.explode(depths))
            .groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(deep) - F.col("depth")).alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        )
        small = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1)
        nodes = store(nodes.withColumn("fits", small))
        parents = nodes.where(~F.col("fits")).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
        )
        # a node is a leaf if it fits and its parent does not; the top of this step has an open parent
        below = nodes.where("fits").withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        found = below.where(F.col("depth") > settled).join(parents, ["depth", "parent"], "left_semi")
        if settled == 0:
            found = found.unionByName(below.where("depth = 0"))
        if deep == BITS:  # equal bits to the last: a 60-bit collision, kept together
            found = found.drop("parent").unionByName(nodes.where(~F.col("fits") & (F.col("depth") == BITS)))
        found = found.select("depth", "prefix", "shard_bytes", "shard_rows")
        leaves = found if leaves is None else leaves.unionByName(found)
        left = nodes.where(~F.col("fits") & (F.col("depth") == deep)).select(F.col("prefix").alias("cell"))
        if deep == BITS or left.isEmpty():
            return leaves
        settled, open_cells = deep, left


def assign_shards(
    docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text", step: int = STEP
) -> DataFrame:
    """``(key, copy, n_bytes, shard, depth, shard_bytes, shard_rows, over_limit)`` for every row.

    ``shard`` is the bucket's bit string ("*" if the table is one bucket).
    """
    rows = store(sized_rows(docs, key, text))
    leaves = store(directory(rows, limit, step))
    # rows meet their leaf on (depth, prefix) for the depths that occur: one per bit at the most
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())
    candidates = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("bits"), d).alias("prefix")) for d in depths])
    if not depths:
        candidates = F.array().cast("array<struct<depth:int,prefix:bigint>>")
    bits = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0")
    return (
        rows.withColumn("at", F.explode(candidates))
        .select("*", "at.depth", "at.prefix")
        .join(leaves, ["depth", "prefix"])
        .select(
            key,
            "copy",
            "n_bytes",
            F.when(F.col("depth") == 0, "*").otherwise(bits).alias("shard"),
            "depth",
            "shard_bytes",
            "shard_rows",
            (F.col("shard_bytes") > limit).alias("over_limit"),
        )
    )
