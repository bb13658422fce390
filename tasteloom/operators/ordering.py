"""Positions and running totals that hold when one key owns a large part of the table.

A window over a key puts all rows of that key into one task. Each function here first looks at the
largest group (one aggregate with map-side combine). If every group fits a task, the plain window
is used: one shuffle. Otherwise the table is range-partitioned on ``(key, order)``, which cuts
through keys, and group offsets are added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

GROUP_BOUND = 2_000_000  # rows of one key that one task may sort (spilling) without being late


def as_cols(names) -> list[Column]:
    if isinstance(names, (str, Column)):
        names = [names]
    return [F.col(c) if isinstance(c, str) else c for c in names]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    found = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(found or 0)


def top_per_group(df: DataFrame, keys, order, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Spark trims every input partition to ``k`` rows per group before the shuffle, so a hot group
    costs no more than ``k`` rows per map task.
    """
    w = Window.partitionBy(*as_cols(keys)).orderBy(*as_cols(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def _ranged(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """Sorted, range-partitioned and pinned; ``_part`` and ``_at`` locate every row.

    The last sort column numbers rows inside an already sorted input partition: it spreads copies
    with an equal key over several partitions and gives the same numbers if a task is repeated.
    """
    by = [*as_cols(keys), *order]
    numbered = df.sortWithinPartitions(*by).withColumn("_copy", F.monotonically_increasing_id())
    placed = (
        numbered.repartitionByRange(*by, "_copy")
        .sortWithinPartitions(*by, "_copy")
        .drop("_copy")
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return store(
        placed.withColumn("_part", F.shiftright("_slot", 33))
        .withColumn("_at", F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_slot")
    )


def _offsets(ranged: DataFrame, amount: Column) -> DataFrame:
    """Sum of ``amount`` over all earlier partitions: one row per partition, so a window over the
    whole of it and a broadcast are bounded by the partition count."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = ranged.groupBy("_part").agg(amount.alias("_amount"))
    return per_part.select("_part", F.coalesce(F.sum("_amount").over(w), F.lit(0)).alias("_before"))


def with_position(
    df: DataFrame,
    order,
    keys: Sequence[str] = (),
    name: str = "pos",
    group_bound: int = GROUP_BOUND,
) -> DataFrame:
    """Add the 0-based position of each row in its group (or in the whole table)."""
    keys, order = list(keys), as_cols(order)
    if keys and largest_group(df, keys) <= group_bound:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    ranged = _ranged(df, keys, order)
    offsets = _offsets(ranged, F.count(F.lit(1)))
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_at") + F.col("_before")).cast("long")
    )
    placed = placed.drop("_part", "_at", "_before")
    if not keys:
        return placed
    starts = placed.groupBy(*keys).agg(F.min(name).alias("_start"))
    return (
        placed.join(starts, keys)
        .withColumn(name, F.col(name) - F.col("_start"))
        .select(*df.columns, name)
    )


def running_total(
    df: DataFrame,
    value: str | dict[str, str],
    order,
    keys: Sequence[str] = (),
    name: str = "before",
    group_bound: int = GROUP_BOUND,
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group; a dict ``{name: value}`` adds several at once."""
    keys, order = list(keys), as_cols(order)
    values = {name: value} if isinstance(value, str) else value

    def before(over) -> dict:
        return {n: F.coalesce(F.sum(v).over(over), F.lit(0)) for n, v in values.items()}

    if keys and largest_group(df, keys) <= group_bound:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(before(w))
    placed = _ranged(df, keys, order)
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [_offsets(placed, F.sum(v)).withColumnRenamed("_before", f"_b_{n}") for n, v in values.items()]
    placed = placed.withColumns(before(w))
    for own in offsets:
        placed = placed.join(F.broadcast(own), "_part")
    placed = placed.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in values})
    if not keys:
        return placed.select(*df.columns, *values)
    first = F.struct("_part", "_at")
    starts = placed.groupBy(*keys).agg(*[F.min_by(n, first).alias(f"_s_{n}") for n in values])
    return (
        placed.join(starts, keys)
        .withColumns({n: F.col(n) - F.col(f"_s_{n}") for n in values})
        .select(*df.columns, *values)
    )
