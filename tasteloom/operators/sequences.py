"""User histories and padded model windows.

Whole histories come as bounded pieces: a user with at most ``chunk`` items has one row, a longer
history continues in further rows. Windows have at most ``max_len + 1`` items by definition, and
are built from the few rows that fall into them, never from a whole history in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.portable import draw01
from ..schemas import MAX_SEQ_LEN, MIN_SEQ_LEN, SEED, SEQ_STEP
from .ordering import as_cols, top_per_group, with_position

CHUNK = 4096
PIECE = 4  # window widths of positions that are kept together


def user_histories(
    df: DataFrame,
    ts: str | None = "timestamp",
    tie: list[str] | tuple = (),
    user: str = "user_idx",
    item: str = "item_idx",
    chunk: int = CHUNK,
    **bounds,
) -> DataFrame:
    """``(user, chunk, items)``: items in time order, ``chunk`` of them per row."""
    order = [*([ts] if ts else []), *tie]
    placed = with_position(df, order, keys=[user], name="_pos", **bounds)
    return (
        placed.withColumn("chunk", F.floor(F.col("_pos") / chunk))
        .groupBy(user, "chunk")
        .agg(F.collect_list(F.struct("_pos", item)).alias("_e"))
        .select(user, "chunk", arrays.ordered("_e", item).alias("items"))
    )


def recent_items(
    df: DataFrame, n: int, order, user: str = "user_idx", item: str = "item_idx"
) -> DataFrame:
    """``(user, items)``: the last ``n`` items of each user, oldest first."""
    newest = [c.desc() for c in as_cols(order)]
    return (
        top_per_group(df, [user], newest, n, "_age")
        .groupBy(user)
        .agg(F.collect_list(F.struct((-F.col("_age")).alias("_at"), item)).alias("_e"))
        .select(user, arrays.ordered("_e", item).alias("items"))
    )


def user_positive_sets(
    df: DataFrame,
    threshold: float | None = 0.0,
    splits=("train", "val", "test"),
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """Distinct (user, item) positives over the chosen splits, in long form."""
    rows = df.where(F.col("split").isin(*splits))
    if threshold is not None:
        rows = rows.where(F.col("rating") >= threshold)
    return rows.select(user, item).distinct()


def train_last_window(
    train: DataFrame,
    order,
    max_len: int = MAX_SEQ_LEN,
    min_len: int = MIN_SEQ_LEN,
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """One padded window per user: its last ``max_len + 1`` items, if it has more than ``min_len``."""
    width = max_len + 1
    recent = recent_items(train, max(width, min_len + 1), order, user, item)
    return recent.where(F.size("items") > min_len).select(
        user, arrays.pad_left(arrays.last_n("items", width), width).alias("seq")
    )


def train_sliding_windows(
    train: DataFrame,
    order,
    max_len: int = MAX_SEQ_LEN,
    min_len: int = MIN_SEQ_LEN,
    step: int = SEQ_STEP,
    user: str = "user_idx",
    item: str = "item_idx",
    **bounds,
) -> DataFrame:
    """Windows ending at positions ``min_len, min_len + step, ...`` of each history.

    Positions are grouped in pieces of ``PIECE`` window widths; only the last ``max_len`` rows of a piece go to the
    next one too. A window is a slice of the piece that it ends in, so a row is sent once or twice, however many
    windows it lies in, and a piece is bounded, however long the history.
    """
    width = max_len + 1
    size = width * PIECE
    placed = with_position(train, order, keys=[user], name="_pos", **bounds)
    home = F.floor(F.col("_pos") / size)
    also = F.col("_pos") % size >= size - max_len
    sent = placed.select(
        user, item, "_pos", F.explode(F.when(also, F.array(home, home + 1)).otherwise(F.array(home))).alias("_piece")
    )
    pieces = sent.groupBy(user, "_piece").agg(
        F.array_sort(F.collect_list(F.struct("_pos", item))).alias("_e"), F.max("_pos").alias("_top"), F.min("_pos").alias("_low")
    )
    # window j ends at min_len + j*step and holds positions (end - width, end]
    first = F.greatest(F.ceil((F.col("_piece") * size - min_len) / F.lit(float(step))), F.lit(0))
    last = F.floor((F.col("_top") - min_len) / F.lit(float(step)))
    bounded = pieces.withColumn("_first", first).withColumn("_last", last).where(F.col("_first") <= F.col("_last"))
    windows = bounded.select(
        user, "_low", F.transform("_e", lambda e: e[item]).alias("_items"), F.explode(F.sequence("_first", "_last")).alias("window")
    )
    at = (F.col("window") * step + min_len - F.col("_low")).cast("int")  # positions of a piece are consecutive
    held = F.slice("_items", F.greatest(at + 2 - width, F.lit(1)), F.least(at + 1, F.lit(width)))
    return windows.select(user, "window", arrays.pad_left(held, width).alias("seq"))


def eval_windows(
    df: DataFrame,
    split: str,
    order,
    max_len: int = MAX_SEQ_LEN,
    user: str = "user_idx",
    item: str = "item_idx",
    **bounds,
) -> DataFrame:
    """One padded window per target row of ``split`` ("val" or "test"), target last.

    History is train, then val when testing, then earlier targets. Only the newest ``max_len``
    history rows can matter, so the rest is cut before the shuffle; each row then goes to the
    targets it precedes by at most ``max_len``.
    """
    width = max_len + 1
    order = as_cols(order)
    stages = {"train": 0, "val": 1, "test": 2}
    stage = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    by = [F.col(f"_o{i}") for i in range(len(order))]
    rows = df.where(stage <= stages[split]).select(
        user,
        item,
        (stage == stages[split]).alias("_target"),
        stage.alias("_stage"),
        *[c.alias(f"_o{i}") for i, c in enumerate(order)],
    )
    newest = [F.col("_stage").desc(), *[c.desc() for c in by]]
    base = top_per_group(rows.where(~F.col("_target")), [user], newest, max_len, "_age").drop("_age")
    relevant = base.unionByName(rows.where(F.col("_target")))
    placed = with_position(relevant, ["_stage", *by], keys=[user], name="_pos", **bounds)
    # group positions by blocks of `width`; a block also gets the rows of the block before it
    home = F.floor(F.col("_pos") / width)
    blocks = placed.withColumn("_block", F.explode(F.array(home, home + 1)))
    pieces = blocks.groupBy(user, "_block").agg(
        F.array_sort(F.collect_list(F.struct("_pos", item, "_target"))).alias("_e")
    )
    # positions of a piece are consecutive, so a window is a slice that ends at its target
    targets = pieces.select(
        user,
        "_block",
        F.transform("_e", lambda e: e[item]).alias("_items"),
        F.posexplode("_e").alias("_i", "_t"),
    ).where(F.col("_t._target") & (F.floor(F.col("_t._pos") / width) == F.col("_block")))
    window = F.slice(
        "_items", F.greatest(F.col("_i") + 2 - width, F.lit(1)), F.least(F.col("_i") + 1, F.lit(width))
    )
    return targets.select(
        user,
        F.col("_t._pos").alias("position"),
        arrays.pad_left(window, width).alias("seq"),
    )


def inference_windows(
    df: DataFrame,
    order,
    max_len: int = MAX_SEQ_LEN,
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """One padded input per user of any split; test rows are never part of it."""
    stage = F.when(F.col("split") == "train", 0).otherwise(1)
    history = df.where(F.col("split").isin("train", "val")).withColumn("_stage", stage)
    recent = recent_items(history, max_len, [F.col("_stage"), *as_cols(order)], user, item)
    users = df.select(user).distinct()
    none = F.array().cast("array<bigint>")
    return users.join(recent, user, "left").select(
        user, arrays.pad_left(F.coalesce("items", none), max_len).alias("seq")
    )


def split_input_target(seqs: DataFrame, col: str = "seq") -> DataFrame:
    """Padded input without the last position, and the 0-based target at it."""
    return seqs.withColumn("input", F.slice(col, 1, F.size(col) - 1)).withColumn(
        "target", F.element_at(col, -1) - 1
    )


def next_item_pairs(seqs: DataFrame, user: str = "user_idx", extra=()) -> DataFrame:
    """``(user, pos, history, target)`` for every position whose next item is not padding.

    ``pos`` is the 0-based input position; the history holds the non-padding items up to it.
    """
    exploded = seqs.select(user, *extra, "seq", F.posexplode(F.slice("seq", 2, F.size("seq"))).alias("pos", "_next"))
    return exploded.where(F.col("_next") != 0).select(
        user,
        *extra,
        "pos",
        history_at_position("seq", F.col("pos")).alias("history"),
        (F.col("_next") - 1).alias("target"),
    )


def history_at_position(seq, pos):
    """Non-padding items of input positions ``0..pos``, 0-based ids."""
    return arrays.drop_padding(F.slice(F.col(seq), F.lit(1), (pos + 1).cast("int")))


def sample_positions(
    pairs: DataFrame,
    split: str,
    ratio: float = 1.0,
    seed: int = SEED,
    user: str = "user_idx",
    extra=(),
) -> DataFrame:
    """Train: keep each position with probability ``ratio``. Otherwise only the last position."""
    if split == "train":
        return pairs.where(draw01(user, *extra, "pos", seed=seed) < ratio)
    last = pairs.groupBy(user, *extra).agg(F.max("pos").alias("pos"))
    return pairs.join(last, [user, *extra, "pos"], "left_semi")


def recent_history(
    df: DataFrame,
    n: int,
    order,
    catalogue: DataFrame,
    newest_first: bool = True,
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """The last ``n`` rows of each user with their catalogue entry, numbered from 1."""
    newest = [c.desc() for c in as_cols(order)]
    rows = top_per_group(df, [user], newest, n, "rank")
    if not newest_first:
        held = rows.groupBy(user).agg(F.max("rank").alias("_held"))
        rows = rows.join(held, user).withColumn("rank", F.col("_held") + 1 - F.col("rank")).drop("_held")
    return rows.join(catalogue.select(item, "title", "genres"), item, "left").select(
        user, "rank", item, "title", "genres"
    )


def ground_truth(
    test: DataFrame,
    threshold: float | None = 0.0,
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """Long form ``(user, item, copies)`` of the test targets."""
    rows = test if threshold is None else test.where(F.col("rating") >= threshold)
    return rows.groupBy(user, item).agg(F.count(F.lit(1)).alias("copies"))


def ground_truth_catalogue(
    test: DataFrame, catalogue: DataFrame, item: str = "item_idx", user: str = "user_idx"
) -> DataFrame:
    """Test rows with the title and genres of their item."""
    return test.join(catalogue.select(item, "title", "genres"), item, "left").select(
        user, item, "rating", "title", "genres"
    )


def newest_windows(
    df: DataFrame,
    split: str,
    order,
    max_len: int = MAX_SEQ_LEN,
    user: str = "user_idx",
    item: str = "item_idx",
) -> DataFrame:
    """``(user, seq)``: of the windows of ``eval_windows`` each user's last one.

    It holds the user's newest rows, so no other row and no other window is needed.
    """
    width = max_len + 1
    stages = {"train": 0, "val": 1, "test": 2}
    stage = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    newest = [F.col("_stage").desc(), *[c.desc() for c in as_cols(order)]]
    rows = df.withColumn("_stage", stage).where(F.col("_stage") <= stages[split])
    lists = top_per_group(rows, [user], newest, width, "_age").groupBy(user).agg(
        F.collect_list(F.struct((-F.col("_age")).alias("_at"), item)).alias("_e"), F.max("_stage").alias("_stage")
    )
    lists = lists.where(F.col("_stage") == stages[split])
    return lists.select(user, arrays.pad_left(arrays.ordered("_e", item), width).alias("seq"))


def without_target(seqs: DataFrame, user: str = "user_idx") -> DataFrame:
    """``(user, history)``: the 0-based history of each sequence."""
    return seqs.select(user, arrays.drop_padding(F.slice("seq", 1, F.size("seq") - 1)).alias("history"))


def sequence_lookup(seqs: DataFrame, order, user: str = "user_idx") -> DataFrame:
    """Each user's last sequence without its target, as 0-based history."""
    newest = [c.desc() for c in as_cols(order)]
    return without_target(top_per_group(seqs, [user], newest, 1, "_n"), user)
