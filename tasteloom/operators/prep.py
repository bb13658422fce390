"""Filters, k-core and dense ids."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..session import store
from .ordering import as_cols, with_position


def filter_positive(df: DataFrame, threshold: float | None = 0.0, col: str = "rating") -> DataFrame:
    return df if threshold is None else df.where(F.col(col) >= threshold)


def filter_pos_neg(
    df: DataFrame, pos: float | None = None, neg: float | None = None, col: str = "rating"
) -> DataFrame:
    """Keep clear positives and clear negatives; a negative bound alone filters nothing."""
    if pos is None:
        return df
    keep = F.col(col) >= pos
    return df.where(keep if neg is None else keep | (F.col(col) <= neg))


def split_pos_neg(
    df: DataFrame, pos: float | None = None, neg: float | None = None, col: str = "rating"
) -> tuple[DataFrame | None, DataFrame | None]:
    pairs = ["user_idx", "item_idx"]
    positives = None if pos is None else df.where(F.col(col) >= pos).select(*pairs)
    negatives = None if neg is None else df.where(F.col(col) <= neg).select(*pairs)
    return positives, negatives


def filter_known_ids(df: DataFrame, vocab: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` occurs in the (unique) column of the same name in ``vocab``."""
    return df.join(vocab.select(col), col, "left_semi")


def filter_id_below(df: DataFrame, n: int, col: str) -> DataFrame:
    """Rows whose dense id has a vector when there are ``n`` of them."""
    return df.where((F.col(col) >= 0) & (F.col(col) < n))


def filter_min_history(df: DataFrame, n: int, col: str = "seq", strict: bool = False) -> DataFrame:
    size = F.size(col)
    return df.where(size > n if strict else size >= n)


def drop_padding(col) -> Column:
    return arrays.drop_padding(col)


def kcore(df: DataFrame, k: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Rows left after dropping users and items with fewer than ``k`` rows until nothing changes.

    The loop counts (user, item, rows) pairs and writes down only the ids it drops. These are few
    after the first rounds, so they are usually broadcast (their number is known by then) and the
    pairs are not shuffled: a round moves partial counts only.
    """
    if k <= 1:
        return df
    kept = store(df.groupBy(user, item).agg(F.count(F.lit(1)).alias("_rows")))
    dropped = {user: [], item: []}
    for r in count(1):  # each round but the last drops an id, so this ends
        changed = False
        for side in (user, item):
            few = kept.groupBy(side).agg(F.sum("_rows").alias("_n")).where(F.col("_n") < k)
            few = store(few.select(side))
            n = few.count()
            if n:
                changed = True
                dropped[side].append(few)
                kept = kept.join(broadcast_if_few(few, n), side, "left_anti")
        if not changed:
            break
        if r % STORE_EVERY == 0:
            kept = store(kept)
    out = df
    for side, tables in dropped.items():
        if tables:
            ids = reduce(DataFrame.unionByName, tables)
            out = out.join(broadcast_if_few(ids, ids.count()), side, "left_anti")
    return out.select(*df.columns)


BROADCAST_IDS = 1_000_000  # a table of that many ids is some ten megabytes
STORE_EVERY = 4  # rounds of filters the plan may pile up


def broadcast_if_few(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def id_map(df: DataFrame, col: str, order_by=None) -> DataFrame:
    """``(idx, raw_id)``: dense 0-based ids by first appearance in ``order_by`` (default: raw id)."""
    if order_by is None:
        firsts = df.select(F.col(col).alias("raw_id")).distinct()
        order = [F.col("raw_id")]
    else:
        firsts = df.groupBy(F.col(col).alias("raw_id")).agg(
            F.min(F.struct(*as_cols(order_by))).alias("_first")
        )
        order = [F.col("_first"), F.col("raw_id")]
    return with_position(firsts, order, name="idx").select("idx", "raw_id")


def encode_ids(
    df: DataFrame, col: str, order_by=None, out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add the dense id of ``col``; also returns the map, pinned as a table."""
    mapping = store(id_map(df, col, order_by))
    out = out or f"{col}_idx"
    renamed = mapping.select(F.col("raw_id").alias(col), F.col("idx").alias(out))
    return df.join(renamed, col), mapping


def apply_id_map(df: DataFrame, mapping: DataFrame, col: str, out: str) -> DataFrame:
    """Encode with an existing map; rows with an unknown id are dropped."""
    return df.join(mapping.select(F.col("raw_id").alias(col), F.col("idx").alias(out)), col)


def decode_ids(df: DataFrame, mapping: DataFrame, col: str, out: str = "raw_id") -> DataFrame:
    return df.join(mapping.select(F.col("idx").alias(col), F.col("raw_id").alias(out)), col)


def with_entries(df: DataFrame, ids_col: str, catalogue: DataFrame, key: str, item: str = "item_idx") -> DataFrame:
    """Add ``_e``: ``(_pos, title, item)`` of the ids in an array that have a title, in order; null if none has."""
    entries = df.select(key, F.posexplode(ids_col).alias("_pos", item)).join(
        catalogue.select(item, "title").where(F.col("title").isNotNull()), item
    )
    lists = entries.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "title", item))).alias("_e")
    )
    return df.join(lists, key, "left")


def _titles_of(df: DataFrame, entries, item: str) -> DataFrame:
    empty_titles, empty_ids = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    return (
        df.withColumn("titles", F.coalesce(F.transform(entries, lambda e: e["title"]), empty_titles))
        .withColumn("valid_ids", F.coalesce(F.transform(entries, lambda e: e[item]), empty_ids))
        .drop("_e")
    )


def decode_titles(
    df: DataFrame,
    ids_col: str,
    catalogue: DataFrame,
    key: str = "example_id",
    item: str = "item_idx",
) -> DataFrame:
    """Add parallel ``titles`` and ``valid_ids``: ids without a title drop out, order stays."""
    return _titles_of(with_entries(df, ids_col, catalogue, key, item), F.col("_e"), item)


def decode_positions(
    seqs: DataFrame,
    catalogue: DataFrame,
    last: int | None = None,
    min_len: int = 0,
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """``(user, pos, target, titles, valid_ids)`` for every position of padded sequences, one for each user:
    ``decode_titles`` of the histories of ``next_item_pairs``, or of their ``last`` ids, if they have ``min_len``.

    Titles are looked up once for each item of a sequence; a position's titles are a part of its sequence's list.
    """
    named = with_entries(seqs.select(user, "seq", drop_padding("seq").alias("_ids")), "_ids", catalogue, user, item)
    n = F.size("seq")
    held = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.size(F.filter(F.slice("seq", F.lit(1), i), lambda x: x != 0)))
    steps = F.arrays_zip(F.slice("seq", 2, n).alias("next"), held.alias("held"))
    rows = named.select(user, "_e", F.posexplode(steps).alias("pos", "_s")).where("_s.next <> 0")
    rows = rows.select(user, "pos", (F.col("_s.next") - 1).alias("target"), F.col("_s.held").alias("_n"), "_e").where(F.col("_n") >= min_len)
    inside = F.filter(
        "_e", lambda e: (e["_pos"] < F.col("_n")) & (e["_pos"] >= F.col("_n") - last if last is not None else F.lit(True))
    )
    return _titles_of(rows, inside, item).drop("_n")
