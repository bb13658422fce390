"""Negative sampling. All draws are functions of row keys and a seed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import digest, draw, draw_below
from ..schemas import MINING_SKIP_TOP, RANDOM_NEGATIVES, SEED
from ..session import spread, store
from .ordering import running_total, top_per_group, with_position


def past_gaps(draws: DataFrame, gaps: DataFrame, user: str, keys) -> DataFrame:
    """Move each draw past the gaps of its user: ``(keys, user, x, y)``.

    ``draws`` is ``(keys, user, x)``, a place among what the user may still get; ``gaps`` is
    ``(user, at, width)``: before place ``at`` comes a gap of ``width`` that the user may not get.
    y is x plus the widths of all gaps with ``at`` <= x. Gaps and draws are put in one order and
    the widths are a running sum, so a user's gaps and draws may be split over tasks.
    """
    names = list(dict.fromkeys([*keys, user]))
    kinds = dict(draws.dtypes)
    mine = draws.select(*names, F.col("x").cast("long").alias("_x"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_w"))
    others = [F.lit(None).cast(kinds[c]).alias(c) if c != user else F.col(c) for c in names]
    theirs = gaps.select(*others, F.col("at").cast("long").alias("_x"), F.lit(0).alias("_kind"), F.col("width").cast("long").alias("_w"))
    # written once: the largest group is looked for before the sums are made
    total = running_total(store(mine.unionByName(theirs)), "_w", ["_x", "_kind"], [user], name="_past")
    return total.where("_kind = 1").select(*names, F.col("_x").alias("x"), (F.col("_x") + F.col("_past")).alias("y"))


def nth_unseen(draws: DataFrame, seen: DataFrame, user: str = "user_idx", keys=("draw_id",)) -> DataFrame:
    """Turn "the r-th item this user has not seen" into the item: ``(keys, item_idx)``.

    ``draws`` is ``(keys, user, r)`` and ``seen`` distinct ``(user, item_idx)``. With the seen
    items s_0 < s_1 < ... of a user, s_j - j unseen items lie below s_j, so the answer is r plus
    the number of j with s_j - j <= r: no rejection, no retry, and it works for users who have
    seen almost everything. Neither the seen list nor the draws of a user need to fit a task.
    ``keys`` keep their types.
    """
    asked = draws.select(user).distinct()
    listed = with_position(store(seen.select(user, "item_idx").join(asked, user, "left_semi")), ["item_idx"], [user], name="_j")
    gaps = listed.select(user, (F.col("item_idx") - F.col("_j")).alias("at"), F.lit(1).alias("width"))
    found = past_gaps(draws.withColumnRenamed("r", "x"), gaps, user, keys)
    return found.select(*keys, F.col("y").alias("item_idx"))


def unseen_counts(seen: DataFrame, n_items: int, user: str = "user_idx") -> DataFrame:
    """``(user, unseen)`` for users with at least one seen item."""
    return seen.groupBy(user).agg((F.lit(n_items) - F.count(F.lit(1))).alias("unseen"))


def hard_negatives_user(
    inter: DataFrame,
    topk: DataFrame,
    positives: DataFrame,
    n_items: int,
    skip_top: int = MINING_SKIP_TOP,
    seed: int = SEED,
    key: str = "example_id",
    user: str = "user_idx",
) -> DataFrame:
    """One hard negative per interaction from the user's top-k list: ``(key, user, neg_item_idx)``.

    Known positives leave the list; of what remains, the first ``skip_top`` are passed over when
    more than that remain. Users without a pool get a random unseen item; one who has seen every
    item gets none.
    """
    negs = topk.select(F.col("query_id").alias(user), "item_idx", "rank").join(
        positives.select(user, "item_idx"), [user, "item_idx"], "left_anti"
    )
    pools = store(pool_after_skip(negs, user, skip_top))  # at most k items per user
    pick = F.element_at("pool", (draw_below(F.size("pool").cast("long"), key, seed=seed) + 1).cast("int"))
    chosen = inter.select(key, user).join(pools, user).select(key, user, pick.alias("neg_item_idx"))
    rest = inter.select(key, user).join(pools.select(user), user, "left_anti")
    if rest.isEmpty():
        return chosen
    return chosen.unionByName(_random_unseen(rest, positives, n_items, 1, seed, key, user).select(
        key, user, F.col("neg_item_idx_1").alias("neg_item_idx")
    ))


def pool_after_skip(negs: DataFrame, owner: str, skip_top: int) -> DataFrame:
    """``(owner, pool)``: each owner's ranked list without its head, if it is long enough."""
    lists = negs.groupBy(owner).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_idx"))), lambda e: e["item_idx"]).alias("_l")
    )
    tail = F.when(F.size("_l") > skip_top, F.slice("_l", F.lit(skip_top + 1), F.size("_l"))).otherwise(F.col("_l"))
    return lists.select(owner, tail.alias("pool"))


def hard_negatives_position(
    pairs: DataFrame,
    topk: DataFrame,
    n_items: int,
    skip_top: int = MINING_SKIP_TOP,
    seed: int = SEED,
    key: str = "example_id",
) -> DataFrame:
    """One hard negative per training position; only the position's own target is excluded.

    ``topk`` holds top-(k+1) lists with ``query_id`` = the position's key. A position without a pool gets a
    random item other than its target; with a single item there is none.
    """
    lists = topk.select(F.col("query_id").alias(key), "item_idx", "rank")
    targets = pairs.select(key, F.col("target").alias("item_idx"))
    negs = lists.join(targets, [key, "item_idx"], "left_anti")
    pools = pool_after_skip(negs, key, skip_top)
    return _from_pool(pairs.select(key, "target").join(pools, key, "left"), n_items, seed, key)


def hard_negatives_listed(
    listed: DataFrame,
    n_items: int,
    skip_top: int = MINING_SKIP_TOP,
    seed: int = SEED,
    key: str = "example_id",
) -> DataFrame:
    """``hard_negatives_position`` for positions that bring their list along: ``(key, target, items)``, the items by
    rank, null without one. Each position is one row that meets no other."""
    left = F.filter("items", lambda x: ~x.eqNullSafe(F.col("target")))
    tail = F.when(F.size("_l") > skip_top, F.slice("_l", F.lit(skip_top + 1), F.size("_l"))).otherwise(F.col("_l"))
    pools = listed.select(key, "target", left.alias("_l")).select(key, "target", F.when(F.size("_l") > 0, tail).alias("pool"))
    return _from_pool(pools, n_items, seed, key)


def _from_pool(pools: DataFrame, n_items: int, seed: int, key: str) -> DataFrame:
    """One draw for each ``(key, target, pool)``."""
    pick = F.element_at("pool", (draw_below(F.size("pool").cast("long"), key, seed=seed) + 1).cast("int"))
    spare = F.pmod(F.col("target") + 1 + draw_below(max(1, n_items - 1), key, F.lit(1), seed=seed), F.lit(n_items))
    found = pools.select(key, "target", F.when(F.col("pool").isNull(), spare).otherwise(pick).alias("neg_item_idx"))
    return found.where(F.col("neg_item_idx") != F.col("target")).select(key, "neg_item_idx")


def _random_unseen(
    rows: DataFrame, positives: DataFrame, n_items: int, n: int, seed: int, key: str, user: str
) -> DataFrame:
    """``(key, user, neg_item_idx_1..n)``: uniform over the user's unseen items, repeats allowed."""
    seen = store(positives.select(user, "item_idx").distinct())
    free = rows.select(key, user).join(unseen_counts(seen, n_items, user), user, "left")
    free = free.withColumn("unseen", F.coalesce("unseen", F.lit(n_items)).cast("long"))
    able = free.where(F.col("unseen") > 0)
    numbers = F.explode(F.sequence(F.lit(1), F.lit(n)))
    draws = able.select(key, user, "unseen", numbers.alias("j")).select(
        key, user, "j", draw_below(F.col("unseen"), key, F.col("j"), seed=seed).alias("r")
    )
    found = nth_unseen(draws, seen, user, (key, user, "j"))
    wide = [F.max(F.when(F.col("j") == j, F.col("item_idx"))).alias(f"neg_item_idx_{j}") for j in range(1, n + 1)]
    return found.groupBy(key, user).agg(*wide)


def random_negatives_user(
    inter: DataFrame,
    positives: DataFrame,
    n_items: int,
    n: int = RANDOM_NEGATIVES,
    seed: int = SEED,
    key: str = "example_id",
    user: str = "user_idx",
) -> DataFrame:
    """``n`` random negatives per interaction, never a known positive. A user who has seen every
    item has none, and its rows are absent."""
    return _random_unseen(inter, positives, n_items, n, seed, key, user)


def random_negatives_position(
    pairs: DataFrame,
    n_items: int,
    n: int = RANDOM_NEGATIVES,
    seed: int = SEED,
    key: str = "example_id",
) -> DataFrame:
    """``n`` uniform items per position other than its target: a shift by a non-zero draw."""
    picks = [
        F.pmod(
            F.col("target") + 1 + draw_below(n_items - 1, key, F.lit(j), seed=seed), F.lit(n_items)
        ).alias(f"neg_item_idx_{j}")
        for j in range(1, n + 1)
    ]
    return pairs.select(key, *picks)


def uniform_unseen(
    users: DataFrame, seen: DataFrame, n_items: int, n: int, seed: int = SEED, user: str = "user_idx"
) -> DataFrame:
    """``n`` different unseen items per user (all of them if fewer): ``(user, slot, item_idx)``.

    Floyd's sampling, one rule for every user: step i draws a place among the first
    ``room - n + i`` unseen items and takes the last of these instead if the draw is taken
    already. Every set of ``n`` places is equally likely; there is no retry, and a user costs
    ``n`` steps however many items are unseen. The places and the seen list of a user are one row, so that only
    the seen items are shuffled; users who have seen more than ``LISTED_SEEN`` go through ``nth_unseen``.
    """
    counts = unseen_counts(seen, n_items, user)
    long = store(counts.where(F.lit(n_items) - F.col("unseen") > LISTED_SEEN))
    hot = not long.isEmpty()
    # a null item is a gap before all places
    entry = F.coalesce(F.col("item_idx").cast("long"), F.lit(-(1 << 62)))
    short, asked = seen, users.select(user)
    if hot:
        short, asked = (df.join(F.broadcast(long.select(user)), user, "left_anti") for df in (seen, asked))
    listed = short.groupBy(user).agg(F.sort_array(F.collect_list(entry)).alias("_seen"))
    room = (F.lit(n_items) - F.coalesce(F.size("_seen"), F.lit(0))).cast("long")
    rows = spread(asked, user).join(listed, user, "left").withColumn("_room", room)
    found = _floyd_lists(rows, n, seed, user)
    if hot:
        rows = users.select(user).join(F.broadcast(long), user).withColumn("_room", F.col("unseen").cast("long"))
        draws = _floyd_lists(rows.withColumn("_seen", F.lit(None).cast("array<bigint>")), n, seed, user)
        rest = nth_unseen(draws.withColumnRenamed("item_idx", "r"), seen, user, (user, "slot"))
        found = found.unionByName(rest)
    return found


LISTED_SEEN = 100_000  # seen items of a user that may lie in one row


def _floyd_lists(rows: DataFrame, n: int, seed: int, user: str) -> DataFrame:
    """Places of Floyd's sampling for ``(user, _room, _seen)``, moved past the sorted seen items: ``(user, slot, item_idx)``.

    A draw is that of ``functions.portable``, the step being its second key.
    """

    def drawn(text: str | None, room: int) -> list[int]:
        head, taken = "" if text is None else f"{text}|", {}
        k = min(n, room)
        for i in range(1, k + 1):
            last = room - k + i - 1
            r = int(hashlib.md5(f"{head}{i}|{seed}".encode()).hexdigest()[:13], 16) % (last + 1)
            taken[last if r in taken else r] = i
        return list(taken)

    def run(batches):
        for batch in batches:
            seen, out = batch.column("_seen"), []
            for i, (text, room) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_room").to_pylist())):
                r = np.array(drawn(text, room), dtype=np.int64)
                if seen[i].is_valid:
                    s = seen[i].values.to_numpy(zero_copy_only=False)
                    r = r + np.searchsorted(s - np.arange(len(s)), r, "right")
                out.append(r)
            sizes = [len(r) for r in out]
            owner = batch.column(user).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
            slots = [np.arange(1, size + 1, dtype=np.int32) for size in sizes]
            columns = [owner, *(pa.array(np.concatenate(x)) for x in (slots, out))]
            yield pa.RecordBatch.from_arrays(columns, [user, "slot", "item_idx"])

    kinds = [T.StructField("slot", T.IntegerType()), T.StructField("item_idx", T.LongType())]
    schema = T.StructType([rows.schema[user], *kinds])
    asked = rows.where("_room > 0").select(user, F.col(user).cast("string").alias("_text"), "_room", "_seen")
    return asked.mapInArrow(run, schema)


def weighted_unseen(
    users: DataFrame,
    seen: DataFrame,
    counts: DataFrame,
    n: int,
    seed: int = SEED,
    user: str = "user_idx",
) -> DataFrame:
    """``n`` different unseen items per user, drawn by raw popularity: ``(user, slot, item_idx)``.

    Items lie side by side as intervals of the running count. A draw is a uniform place in the weight that the
    user has not seen: it is moved past the user's seen intervals (``past_gaps``), so no draw meets a seen item.
    Intervals are cut into buckets of the mean width, so the look-up is an equi-join. Different items are
    taken in the order of the draws; they are gaps for users who are still short. As a user's first draw of a round
    always gives a new item, the rounds end. A user with fewer than ``n`` items of any popularity gets all.
    """
    live = store(running_total(counts.where(F.col("cnt") > 0), "cnt", ["item_idx"], name="lo"))
    total, n_live = live.agg(F.sum("cnt"), F.count(F.lit(1))).first()
    if not n_live:
        return users.select(user, F.lit(1).alias("slot"), F.lit(0).cast("long").alias("item_idx")).limit(0)
    width = max(1, -(-total // n_live))
    ends = F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("cnt") - 1) / width)
    buckets = live.select("item_idx", "cnt", "lo", F.explode(F.sequence(*ends)).alias("_bucket"))
    asked = users.select(user).distinct()
    blocked = store(seen.select(user, "item_idx").distinct().join(asked, user, "left_semi").join(live, "item_idx"))
    short, done, rounds = asked.withColumn("_got", F.lit(0).cast("long")), None, 0
    state = [user, "_got", "need", "item_idx", "cnt", "lo", "_a"]
    while True:
        sums = blocked.groupBy(user).agg(F.sum("cnt").alias("_w"), F.count(F.lit(1)).alias("_b"))
        room = short.join(sums, user, "left").select(
            user, "_got", (F.lit(total) - F.coalesce("_w", F.lit(0))).alias("_room"),
            F.least(F.lit(n) - F.col("_got"), F.lit(n_live) - F.coalesce("_b", F.lit(0))).cast("int").alias("need"),
        ).where("need > 0")
        before = running_total(blocked, "cnt", ["lo"], [user], name="_before")
        gaps = before.select(user, (F.col("lo") - F.col("_before")).alias("at"), F.col("cnt").alias("width"))

        def firsts(asking: DataFrame, start, stop) -> DataFrame:
            """Each item that the draws ``start`` to ``stop`` hit, with the first draw that did."""
            tries = F.explode(F.sequence(start, stop)).alias("_a")
            place = draw_below(F.col("_room"), user, F.col("_a"), F.lit(f"w{rounds or ''}"), seed=seed)
            draws = spread(asking, user).select(user, "_got", "need", "_room", tries).withColumn("x", place)
            moved = past_gaps(draws, gaps, user, (user, "_got", "need", "_a")).withColumn("_bucket", F.floor(F.col("y") / width))
            hit = moved.join(buckets, "_bucket").where("y >= lo and y < lo + cnt")
            return hit.groupBy(user, "item_idx", "cnt", "lo", "_got", "need").agg(F.min("_a").alias("_a")).select(*state)

        def first_of(found: DataFrame) -> DataFrame:
            best = top_per_group(found, [user], ["_a"], n, "_slot").where("_slot <= need")
            return store(best.withColumn("slot", (F.col("_got") + F.col("_slot")).cast("int")))

        # a round has four draws for each item wanted; few users need more than the first of them
        few = F.least(F.col("need") + F.ceil(F.col("need") / 8).cast("int") + 4, F.col("need") * 4)
        room = store(room)
        taken = first_of(firsts(room, F.lit(1), few))
        owned = taken.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
        rest = store(room.join(owned, user, "left").where(F.coalesce("_n", F.lit(0)) < F.col("need")).where(few < F.col("need") * 4).drop("_n"))
        if not rest.isEmpty():
            names, same = rest.select(F.col(user).alias("_u")), F.col(user).eqNullSafe(F.col("_u"))
            both = firsts(rest, few + 1, F.col("need") * 4).unionByName(taken.join(names, same, "left_semi").select(*state))
            both = both.groupBy(*[c for c in state if c != "_a"]).agg(F.min("_a").alias("_a")).select(*state)
            taken = taken.join(names, same, "left_anti").unionByName(first_of(both).select(*taken.columns))
        part = taken.select(user, "slot", "item_idx")
        done = part if done is None else done.unionByName(part)
        full = taken.groupBy(user, "need", "_got").agg(F.count(F.lit(1)).alias("_n")).where("_n < need")
        short = store(full.select(user, (F.col("_got") + F.col("_n")).alias("_got")))
        if short.isEmpty():
            return done
        rounds += 1
        more = taken.select("item_idx", user, "cnt", "lo").join(short.select(user), user, "left_semi")
        blocked = store(blocked.select("item_idx", user, "cnt", "lo").join(short.select(user), user, "left_semi").unionByName(more.select("item_idx", user, "cnt", "lo")))


def sampled_candidates(
    test: DataFrame,
    positives: DataFrame,
    n_items: int,
    strategy: str = "uniform",
    n: int = 100,
    counts: DataFrame | None = None,
    seed: int = SEED,
    user: str = "user_idx",
) -> DataFrame:
    """One positive and ``n`` different non-positives per test user: ``(user, slot, item_idx)``.

    Slot 0 is the positive. ``strategy`` is uniform, popularity, or mixed (half and half).
    """
    targets = test.groupBy(user).agg(F.max("item_idx").alias("item_idx"), F.count(F.lit(1)).alias("_c"))
    targets = store(targets)
    most = targets.agg(F.max("_c")).first()[0]
    if most is not None and most != 1:
        raise ValueError(f"sampled evaluation needs exactly one test item per user, found {most}")
    known = store(positives.select(user, "item_idx").distinct())
    users = targets.select(user)
    if strategy == "popularity":
        negs = weighted_unseen(users, known, counts, n, seed, user)
    elif strategy == "mixed":
        half = n // 2
        first = store(uniform_unseen(users, known, n_items, half, seed, user))
        taken = known.unionByName(first.select(user, "item_idx"))
        second = weighted_unseen(users, taken, counts, n - half, seed, user)
        negs = first.unionByName(second.withColumn("slot", F.col("slot") + half))
    else:
        negs = uniform_unseen(users, known, n_items, n, seed, user)
    head = targets.select(user, F.lit(0).alias("slot"), "item_idx")
    return head.unionByName(negs.select(user, F.col("slot").cast("int").alias("slot"), "item_idx"))


def unpivot_negatives(df: DataFrame, prefix: str = "neg_item_idx_", keys=("user_idx",)) -> DataFrame:
    """Wide negative columns, found by prefix, as rows ``(keys, slot, neg_item_idx)``."""
    wide = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    long = df.unpivot(list(keys), wide, "_name", "neg_item_idx")
    return long.select(*keys, F.substring("_name", len(prefix) + 1, 9).cast("int").alias("slot"), "neg_item_idx")


HEAD_DIGITS = 4  # hexadecimal digits of a hash that are counted: 65,536 numbers come to the driver


def subsample_exact(df: DataFrame, ratio: float, keys, seed: int = SEED) -> DataFrame:
    """Exactly ``int(n * ratio)`` rows without replacement, by the hash order of ``keys``."""
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be in [0, 1]")
    if ratio == 1.0:
        return df
    rows, h = store(df), digest(*keys, seed=seed)  # counted, then cut
    head = F.conv(F.substring(h, 1, HEAD_DIGITS), 16, 10).cast("int")
    counts = sorted((r["_b"], r["_n"]) for r in rows.groupBy(head.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect())
    left = int(sum(size for _, size in counts) * ratio)
    for edge, size in counts:
        if size > left:
            break
        left -= size
    else:
        return rows
    # only the rows whose hash starts as that of the last one taken are put in order
    last = with_position(rows.where(head == edge), [h, *keys], name="_pos").where(F.col("_pos") < left).drop("_pos")
    return rows.where(head < edge).unionByName(last)


def one_positive_per_user(
    df: DataFrame, keys, seed: int = SEED, user: str = "user_idx", item: str = "item_idx"
) -> DataFrame:
    """A random row of each user with the dummy rating 5.0."""
    order = [digest(*keys, seed=seed), *[F.col(k) for k in keys]]
    return top_per_group(df, [user], order, 1, "_n").select(user, item, F.lit(5.0).alias("rating"))


def training_negatives(
    seqs: DataFrame, n_items: int, k: int = 3000, seed: int = SEED, keys=("user_idx",)
) -> DataFrame:
    """``k`` uniform items per sequence: ``(keys, slot, neg_item_idx)``."""
    slots = seqs.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    return slots.withColumn("neg_item_idx", draw_below(n_items, *keys, F.col("slot"), seed=seed))


def collision_mask(pairs: DataFrame, negs: DataFrame, keys=("user_idx",)) -> DataFrame:
    """The (position, slot) pairs to mask: a sampled negative that is the position's own target.

    An equi-join on sequence and item, so positions x negatives never become rows. Both sides are unfolded from a
    row per sequence, which Spark's size estimate does not see: the hint keeps either from being broadcast.
    """
    targets = pairs.select(*keys, "pos", F.col("target").alias("neg_item_idx"))
    return targets.join(negs.hint("merge"), [*keys, "neg_item_idx"]).select(*keys, "pos", "slot", "neg_item_idx")


def negatives_excluding(
    users: DataFrame, history: DataFrame, truth: DataFrame, n_items: int, n: int, seed: int = SEED,
    user: str = "user_idx",
) -> DataFrame:
    """``n`` different items per user from neither its history nor its truth."""
    known = store(history.select(user, "item_idx").unionByName(truth.select(user, "item_idx")).distinct())
    return uniform_unseen(users, known, n_items, n, seed, user)
