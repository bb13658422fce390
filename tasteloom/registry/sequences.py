"""Queries over histories and windows."""

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import prep, sequences, splits
from ..schemas import MAX_SEQ_LEN
from ..session import store
from ..sources import views
from .common import TIE, TIE_DESC, draw01 as d_draw01, query, view, written_once

L = MAX_SEQ_LEN
ORDER = views.INTERACTION_ORDER


@written_once
def labelled(spark, sf):
    """Interactions with the last row of each user as test and the one before as validation.

    Written once, as the split tables every later stage reads.
    """
    return store(splits.split_user_last_k(views.interactions(spark, sf), tie=views.INTERACTION_TIE))


@written_once
def labelled_events(spark, sf):
    return store(
        splits.split_user_last_k(views.event_interactions(spark, sf), ts="ts", tie=["event_id"])
    )


def text(df, *cols):
    for c in cols:
        df = df.withColumn(c, arrays.joined(c))
    return df


def padded(width: int, items: str = "item_idx + 1", order: str = "p") -> str:
    """SQL of a left-padded window as text, over rows already cut to ``width``."""
    return f"repeat('0,', {width} - count(*)::int) || string_agg(({items})::varchar, ',' order by {order})"


view("v_pos", f"select *, row_number() over (partition by user_idx order by {TIE}) - 1 p from v_inter")
view(
    "v_trainpos",
    f"""select *, row_number() over (partition by user_idx order by {TIE}) - 1 p,
        count(*) over (partition by user_idx) n from v_lab where split = 'train'""",
)


@query(
    "user_histories",
    """select user_idx, p // 16 as chunk, string_agg(item_idx::varchar, ',' order by p) items
       from v_pos group by 1, 2""",
)
def user_histories(spark, sf):
    hist = sequences.user_histories(
        views.interactions(spark, sf), tie=views.INTERACTION_TIE, chunk=16
    )
    return text(hist, "items")


@query(
    "user_positive_sets",
    "select distinct user_idx, item_idx from v_lab where rating >= 3.0 and split in ('train', 'val')",
)
def user_positive_sets(spark, sf):
    return sequences.user_positive_sets(labelled(spark, sf), 3.0, ("train", "val"))


@query(
    "train_last_window",
    f"""select user_idx, {padded(L + 1)} seq from v_trainpos where n > 20 and p >= n - {L + 1} group by 1""",
)
def train_last_window(spark, sf):
    train = splits.take_split(labelled(spark, sf), "train")
    return text(sequences.train_last_window(train, ORDER, L, min_len=20), "seq")


@query(
    "train_sliding_windows",
    f"""select w.user_idx, w.j as "window", {padded(L + 1, 't.item_idx + 1', 't.p')} seq
        from (select user_idx, p, (p - 3) // 5 j from v_trainpos where p >= 3 and (p - 3) % 5 = 0) w
        join v_trainpos t on t.user_idx = w.user_idx and t.p <= w.p and t.p > w.p - {L + 1} group by 1, 2""",
)
def train_sliding_windows(spark, sf):
    train = splits.take_split(labelled(spark, sf), "train")
    return text(sequences.train_sliding_windows(train, ORDER, L, min_len=3, step=5), "seq")


view(
    "v_stage",
    f"""select *, case split when 'train' then 0 when 'val' then 1 else 2 end stage,
        row_number() over (partition by user_idx order by
          case split when 'train' then 0 when 'val' then 1 else 2 end, {TIE}) - 1 p from v_hashsplit""",
)


def _eval_sql(split: str, stages: str) -> str:
    """Windows of every target of a split in which users have many targets."""
    source = f"(select *, row_number() over (partition by user_idx order by stage, p) q from v_stage where split in ({stages}))"
    return f"""select t.user_idx, t.l_orderkey, t.l_linenumber, t.l_suppkey,
        {padded(L + 1, 'h.item_idx + 1', 'h.q')} seq
        from {source} t join {source} h on h.user_idx = t.user_idx and h.q <= t.q and h.q > t.q - {L + 1}
        where t.split = '{split}' group by t.user_idx, t.q, t.l_orderkey, t.l_linenumber, t.l_suppkey"""


def _windows(spark, sf, split):
    from .prep import hash_split

    return text(sequences.eval_windows(hash_split(spark, sf), split, ORDER, L), "seq").select("user_idx", "seq")


@query("eval_windows_val", f"select user_idx, seq from ({_eval_sql('val', chr(39) + 'train' + chr(39) + ',' + chr(39) + 'val' + chr(39))})")
def eval_windows_val(spark, sf):
    return _windows(spark, sf, "val")


@query("eval_windows_test", f"select user_idx, seq from ({_eval_sql('test', chr(39) + 'train' + chr(39) + ',' + chr(39) + 'val' + chr(39) + ',' + chr(39) + 'test' + chr(39))})")
def eval_windows_test(spark, sf):
    return _windows(spark, sf, "test")


view(
    "v_window",
    f"""select user_idx, list(item_idx + 1 order by p) seq from v_trainpos
        where p >= n - {L + 1} group by 1""",
)
view(
    "v_seq",
    f"""select user_idx, list_concat(list_transform(range({L + 1} - len(seq)), lambda x: 0::bigint), seq) seq
        from v_window""",
)
view(
    "v_seqpos",
    """select user_idx, i - 1 pos, seq[i + 1] - 1 target,
         list_transform(list_filter(seq[1:i], lambda x: x <> 0), lambda x: x - 1) history
       from (select user_idx, seq, unnest(range(1, len(seq))) i from v_seq) where seq[i + 1] <> 0""",
)


def train_seqs(spark, sf):
    train = splits.take_split(labelled(spark, sf), "train")
    return sequences.train_last_window(train, ORDER, L)


@query(
    "inference_windows",
    f"""select u.user_idx, rtrim(repeat('0,', {L} - count(h.q)::int) ||
          coalesce(string_agg((h.item_idx + 1)::varchar, ',' order by h.q desc), ''), ',') seq
        from (select distinct user_idx from v_globaltime) u left join (
          select user_idx, item_idx, row_number() over (partition by user_idx order by {TIE_DESC}) q
          from v_globaltime where split <> 'test') h
        on u.user_idx = h.user_idx and h.q <= {L} group by 1""",
)
def inference_windows(spark, sf):
    from .prep import global_time

    return text(sequences.inference_windows(global_time(spark, sf), ORDER, L), "seq")


@query(
    "split_input_target",
    f"""select user_idx, array_to_string(seq[1:{L}], ',') input, seq[{L + 1}] - 1 target from v_seq""",
)
def split_input_target(spark, sf):
    return text(sequences.split_input_target(train_seqs(spark, sf)), "input").drop("seq")


@query("next_item_pairs", "select user_idx, pos, array_to_string(history, ',') history, target from v_seqpos")
def next_item_pairs(spark, sf):
    pairs = sequences.next_item_pairs(train_seqs(spark, sf))
    return text(pairs.withColumn("pos", F.col("pos").cast("long")), "history")


@query(
    "sample_positions",
    f"select user_idx, pos, target from v_seqpos where {d_draw01('user_idx', 'pos')} < 0.2",
)
def sample_positions(spark, sf):
    pairs = sequences.next_item_pairs(train_seqs(spark, sf))
    kept = sequences.sample_positions(pairs, "train", 0.2)
    return kept.select("user_idx", F.col("pos").cast("long").alias("pos"), "target")


@query(
    "last_positions",
    "select user_idx, max(pos) pos, arg_max(target, pos) target from v_seqpos group by 1",
)
def last_positions(spark, sf):
    pairs = sequences.next_item_pairs(train_seqs(spark, sf))
    kept = sequences.sample_positions(pairs, "val")
    return kept.select("user_idx", F.col("pos").cast("long").alias("pos"), "target")


@query(
    "drop_padding",
    "select user_idx, array_to_string(list_transform(list_filter(seq, lambda x: x <> 0), lambda x: x - 1), ',') items from v_seq",
)
def drop_padding(spark, sf):
    return text(train_seqs(spark, sf).select("user_idx", prep.drop_padding("seq").alias("items")), "items")


@query(
    "filter_min_history",
    "select user_idx, pos from v_seqpos where len(history) >= 5",
)
def filter_min_history(spark, sf):
    pairs = sequences.next_item_pairs(train_seqs(spark, sf))
    kept = prep.filter_min_history(pairs, 5, "history")
    return kept.select("user_idx", F.col("pos").cast("long").alias("pos"))


@query(
    "recent_history",
    f"""select r.user_idx, r.rank, r.item_idx, title, genres from (
          select user_idx, item_idx, row_number() over (partition by user_idx order by {TIE_DESC}) rank
          from v_inter) r left join v_cat using (item_idx) where r.rank <= 5""",
)
def recent_history(spark, sf):
    rows = sequences.recent_history(
        views.interactions(spark, sf), 5, ORDER, views.catalogue(spark, sf)
    )
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(
    "ground_truth",
    "select user_idx, item_idx, count(*) copies from v_globaltime where split = 'test' and rating >= 4 group by 1, 2",
)
def ground_truth(spark, sf):
    from .prep import global_time

    return sequences.ground_truth(splits.take_split(global_time(spark, sf), "test"), 4.0)


@query(
    "ground_truth_catalogue",
    """select user_idx, item_idx, rating, title, genres from v_lab left join v_cat using (item_idx)
       where split = 'test'""",
)
def ground_truth_catalogue(spark, sf):
    test = splits.take_split(labelled(spark, sf), "test")
    return sequences.ground_truth_catalogue(test, views.catalogue(spark, sf))


@query(
    "sequence_lookup",
    f"""select u.user_idx, coalesce(history, '') history
        from (select distinct user_idx from v_stage where split = 'test') u left join (
        select user_idx, array_to_string(list(item_idx order by q), ',') history from (
          select user_idx, item_idx, row_number() over (partition by user_idx order by stage desc, p desc) b,
            row_number() over (partition by user_idx order by stage, p) q
          from v_stage where user_idx in (select user_idx from v_stage where split = 'test'))
        where b between 2 and {L + 1} group by 1) h on h.user_idx = u.user_idx""",
)
def sequence_lookup(spark, sf):
    from .prep import hash_split

    seqs = sequences.newest_windows(hash_split(spark, sf), "test", ORDER, L)
    return text(sequences.without_target(seqs), "history")
