"""Queries over filters, ids, k-core and splits."""

from pyspark.sql import functions as F

from ..functions.portable import draw
from ..operators import prep, splits
from ..session import store
from ..sources import views
from .common import TIE, draw as d_draw, query, view

ROW = "user_idx, item_idx, l_orderkey, l_linenumber, l_suppkey"
ROW_COLS = [c.strip() for c in ROW.split(",")]


@query("filter_positive", f"select {ROW}, rating from v_inter where rating >= 4.0")
def filter_positive(spark, sf):
    df = prep.filter_positive(views.interactions(spark, sf), 4.0)
    return df.select(*ROW_COLS, "rating")


@query("filter_pos_neg", f"select {ROW}, rating from v_inter where rating >= 4.0 or rating <= 1.5")
def filter_pos_neg(spark, sf):
    return prep.filter_pos_neg(views.interactions(spark, sf), 4.0, 1.5).select(*ROW_COLS, "rating")


@query(
    "split_pos_neg",
    """select 'pos' side, user_idx, item_idx, count(*) n from v_inter where rating >= 4.0 group by all
       union all select 'neg', user_idx, item_idx, count(*) from v_inter where rating <= 2.0 group by all""",
)
def split_pos_neg(spark, sf):
    pos, neg = prep.split_pos_neg(views.interactions(spark, sf), 4.0, 2.0)
    both = pos.withColumn("side", F.lit("pos")).unionByName(neg.withColumn("side", F.lit("neg")))
    return both.groupBy("side", "user_idx", "item_idx").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_known_ids",
    f"""select {ROW} from v_inter where item_idx in
        (select p_partkey from part where p_size >= 25)""",
)
def filter_known_ids(spark, sf):
    vocab = views.table(spark, sf, "part").where("p_size >= 25").select(F.col("p_partkey").alias("item_idx"))
    return prep.filter_known_ids(views.interactions(spark, sf), vocab, "item_idx").select(*ROW_COLS)


@query(
    "filter_id_below",
    "select event_id, user_idx, item_idx from v_ev where item_idx < (select count(*) / 10 from embeddings)",
)
def filter_id_below(spark, sf):
    n = views.item_vectors(spark, sf).count() / 10
    df = prep.filter_id_below(views.event_interactions(spark, sf), n, "item_idx")
    return df.select("event_id", "user_idx", "item_idx")


KCORE_K, KCORE_ROUNDS = 22, 8


def _kcore_sql() -> str:
    view("v_core0", "select user_idx, item_idx from v_inter")
    for r in range(1, KCORE_ROUNDS + 1):
        p = f"v_core{r - 1}"
        view(
            f"v_coreu{r}",
            f"select * from {p} where user_idx in (select user_idx from {p} group by 1 having count(*) >= {KCORE_K})",
        )
        view(
            f"v_core{r}",
            f"""select * from v_coreu{r} where item_idx in
                (select item_idx from v_coreu{r} group by 1 having count(*) >= {KCORE_K})""",
        )
    return f"select user_idx, item_idx, count(*) n from v_core{KCORE_ROUNDS} group by 1, 2"


@query("kcore", _kcore_sql())
def kcore(spark, sf):
    core = prep.kcore(views.interactions(spark, sf), KCORE_K, "user_idx", "item_idx")
    return core.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).alias("n"))


view(
    "v_itemmap",
    f"""select raw_id, row_number() over (order by f, raw_id) - 1 idx from (
        select item_idx raw_id, min(row({TIE})) f from v_inter group by 1)""",
)


@query("encode_ids", f"select {ROW}, idx as item_dense from v_inter join v_itemmap on item_idx = raw_id")
def encode_ids(spark, sf):
    df = views.interactions(spark, sf)
    coded, _ = prep.encode_ids(df, "item_idx", views.INTERACTION_ORDER, out="item_dense")
    return coded.select(*ROW_COLS, "item_dense")


@query("id_map", "select idx, raw_id from (select raw_id, row_number() over (order by raw_id) - 1 idx from (select distinct user_idx raw_id from v_inter))")
def id_map(spark, sf):
    return prep.id_map(views.interactions(spark, sf), "user_idx")


@query(
    "decode_ids",
    """select idx as item_dense, raw_id, count(*) n from v_inter join v_itemmap on item_idx = raw_id
       group by 1, 2""",
)
def decode_ids(spark, sf):
    df = views.interactions(spark, sf)
    coded, mapping = prep.encode_ids(df, "item_idx", views.INTERACTION_ORDER, out="item_dense")
    counts = coded.groupBy("item_dense").agg(F.count(F.lit(1)).alias("n"))
    return prep.decode_ids(counts, mapping, "item_dense")


@query("vocab_sizes", "select max(user_idx) + 1 as n_users, max(item_idx) + 1 as n_items from v_ev")
def vocab_sizes(spark, sf):
    from ..sources.tables import vocab_sizes as sizes

    users, items = sizes(None, None, views.event_interactions(spark, sf))
    return spark.range(1).select(
        F.lit(users).cast("long").alias("n_users"), F.lit(items).cast("long").alias("n_items")
    )


@query(
    "unique_catalogue",
    """select movieId, title, genres from (
         select l_partkey as movieId, l_returnflag || cast(l_suppkey as varchar) as title, l_linestatus as genres,
           row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_suppkey desc) r
         from lineitem) where r = 1""",
)
def unique_catalogue(spark, sf):
    from ..sources.tables import unique_catalogue as unique

    raw = views.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("movieId"),
        F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("title"),
        F.col("l_linestatus").alias("genres"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )
    kept = unique(raw, "last", ["l_orderkey", "l_linenumber", "l_suppkey"])
    return kept.select("movieId", "title", "genres")


@query("split_user_last_k", f"""select {ROW}, case when age < 2 then 'test' when age < 5 then 'val' else 'train' end split from v_lab""")
def split_user_last_k(spark, sf):
    df = splits.split_user_last_k(
        views.interactions(spark, sf), val_k=3, test_k=2, tie=views.INTERACTION_TIE
    )
    return df.select(*ROW_COLS, "split")


view(
    "v_globaltime",
    f"""select *, case when p < cast(floor(n * (1 - 0.1 - 0.2)) as bigint) then 'train'
                 when p < cast(floor(n * (1 - 0.2)) as bigint) then 'val' else 'test' end split
        from (select *, row_number() over (order by {TIE}) - 1 p, count(*) over () n from v_inter)""",
)


def global_time(spark, sf):
    return store(
        splits.split_global_time(
            views.interactions(spark, sf), 0.1, 0.2, tie=views.INTERACTION_TIE
        )
    )


@query("split_global_time", f"select {ROW}, split from v_globaltime")
def split_global_time(spark, sf):
    return global_time(spark, sf).select(*ROW_COLS, "split")


@query(
    "split_stats",
    """select split, count(*) as "rows", round(count(*) / (select count(*) from v_globaltime)::double, 6) as share,
         epoch_ms(min("timestamp") * 1000) first_time, epoch_ms(max("timestamp") * 1000) last_time,
         count(distinct user_idx) users,
         count(distinct case when user_idx not in (select user_idx from v_globaltime where split = 'train')
                        then user_idx end) users_not_in_train
       from v_globaltime group by 1""",
)
def split_stats(spark, sf):
    stats = splits.split_stats(global_time(spark, sf))
    return stats.withColumn("share", F.round("share", 6)).withColumn(
        "first_time", F.col("first_time").cast("timestamp_ntz")
    ).withColumn("last_time", F.col("last_time").cast("timestamp_ntz"))


@query("train_entities", "select distinct item_idx from v_globaltime where split = 'train'")
def train_entities(spark, sf):
    return splits.train_entities(splits.take_split(global_time(spark, sf), "train"), "item_idx")


@query("shuffle_split", f"select {ROW} from v_globaltime where split = 'test'")
def shuffle_split(spark, sf):
    return splits.shuffle_split(splits.take_split(global_time(spark, sf), "test")).select(*ROW_COLS)


# a split by hash is wrong on purpose, so that the check has something to find
view(
    "v_hashsplit",
    f"""select *, case {d_draw('l_orderkey', 'l_linenumber', 'item_idx', 'l_suppkey')} % 3
          when 0 then 'train' when 1 then 'val' else 'test' end split from v_inter""",
)


def hash_split(spark, sf):
    side = F.pmod(draw("l_orderkey", "l_linenumber", "item_idx", "l_suppkey", seed=42), F.lit(3))
    sided = views.interactions(spark, sf).withColumn("side", side)
    side = F.col("side")
    return store(sided.withColumn(
        "split", F.when(side == 0, "train").when(side == 1, "val").otherwise("test")
    ).drop("side"))


@query(
    "check_temporal_order",
    """select * from (select user_idx,
         max(case when split = 'train' then "timestamp" end) train_last,
         min(case when split = 'val' then "timestamp" end) val_first,
         max(case when split = 'val' then "timestamp" end) val_last,
         min(case when split = 'test' then "timestamp" end) test_first
       from v_hashsplit group by 1) where train_last > val_first or val_last > test_first""",
)
def check_temporal_order(spark, sf):
    return splits.check_temporal_order(hash_split(spark, sf))


@query(
    "check_split_counts",
    """select *, (train > 0 and val > 0 and test > 0 and total > 1000) ok from (
         select count(case when split = 'train' then 1 end) train, count(case when split = 'val' then 1 end) val,
           count(case when split = 'test' then 1 end) test, count(*) total from v_hashsplit)""",
)
def check_split_counts(spark, sf):
    return splits.check_split_counts(hash_split(spark, sf))
