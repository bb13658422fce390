"""Queries over negative sampling."""

from pyspark.sql import functions as F

from ..operators import features, negatives, positions, retrieval, sequences, splits
from ..sources import views
from .common import digest as d_digest, draw as d_draw, query, view
from .features import n_parts
from .sequences import labelled, labelled_events
from .vectors import topk_sql, user_vectors

SKIP = 20


def event_positives(spark, sf):
    return sequences.user_positive_sets(labelled_events(spark, sf), 0.0)


def event_examples(spark, sf):
    """Training interactions of the event table, one example each."""
    train = splits.take_split(labelled_events(spark, sf), "train")
    return train.select(F.col("event_id").alias("example_id"), "user_idx", "item_idx", "rating")


view("v_exam", "select event_id example_id, user_idx, item_idx, rating from v_evlab where split = 'train'")
view("v_evpos", "select distinct user_idx, item_idx from v_evlab")
view(
    "v_usertop",
    topk_sql("raw", 100, "desc", "from (select user_idx query_id, item_idx, raw from v_scores)"),
)
view(
    "v_userpool",
    f"""select user_idx, list(item_idx order by rank) pool from (
          select *, row_number() over (partition by user_idx order by rank) r, count(*) over (partition by user_idx) c
          from (select query_id user_idx, item_idx, rank from v_usertop anti join v_evpos p
                on p.user_idx = v_usertop.query_id and p.item_idx = v_usertop.item_idx))
        where c <= {SKIP} or r > {SKIP} group by 1""",
)
# the r-th item (from 0) a user has not interacted with
view(
    "v_free",
    """select user_idx, item_idx, row_number() over (partition by user_idx order by item_idx) - 1 r,
         count(*) over (partition by user_idx) m
       from (select user_idx, item_idx from (select distinct user_idx from v_evlab), v_items)
       anti join v_evpos using (user_idx, item_idx)""",
)


def user_top(spark, sf, k=100):
    return retrieval.exact_topk(
        user_vectors(spark, sf, "query_id"), views.item_vectors(spark, sf), k
    )


@query(
    "hard_negatives_user",
    f"""select example_id, user_idx, pool[1 + {d_draw('example_id')} % len(pool)] neg_item_idx
        from v_exam join v_userpool using (user_idx)
        union all
        select example_id, user_idx, f.item_idx from v_exam e anti join v_userpool using (user_idx)
        join v_free f using (user_idx) where f.r = {d_draw('example_id', '1')} % f.m""",
)
def hard_negatives_user(spark, sf):
    n = views.item_vectors(spark, sf).count()
    return negatives.hard_negatives_user(
        event_examples(spark, sf), user_top(spark, sf), event_positives(spark, sf), n, SKIP
    )


view(
    "v_pospairs",
    """select row_number() over (order by user_idx, pos) - 1 example_id, user_idx, pos, target
       from (select user_idx, i - 1 pos, seq[i + 1] - 1 target from (
         select user_idx, seq, unnest(range(1, len(seq))) i from v_evseq) where seq[i + 1] <> 0)""",
)


def position_pairs(spark, sf):
    """Training positions of the event table, numbered by user and position."""
    from ..operators.ordering import with_position
    from .vectors import event_seqs

    pairs = sequences.next_item_pairs(event_seqs(spark, sf)).select("user_idx", "pos", "target")  # histories need no order
    return with_position(pairs, ["user_idx", "pos"], name="example_id")


@query(
    "hard_negatives_position",
    f"""select example_id, pool[1 + {d_draw('example_id')} % len(pool)] neg_item_idx from (
          select example_id, list(item_idx order by rank) pool from (
            select *, row_number() over (partition by example_id order by rank) r,
              count(*) over (partition by example_id) c
            from (select example_id, t.item_idx, t.rank from v_pospairs p join v_usertop t on t.query_id = p.user_idx
                  where t.rank <= 41 and t.item_idx <> p.target))
          where c <= {SKIP} or r > {SKIP} group by 1)""",
)
def hard_negatives_position(spark, sf):
    """The user's vector stands in for the vector of each of its positions."""
    pairs = position_pairs(spark, sf)
    top = user_top(spark, sf, 41).withColumnRenamed("query_id", "user_idx")
    lists = pairs.select(F.col("example_id").alias("query_id"), "user_idx").join(top, "user_idx")
    n = views.item_vectors(spark, sf).count()
    return negatives.hard_negatives_position(pairs, lists, n, SKIP)


# a unit vector for every position: the sum of its items' vectors up to it, an item j steps before weighing 0.9^j
view(
    "v_possteps",
    """select user_idx, p - 1 pos, seq[p] - 1 item_idx
       from (select user_idx, seq, unnest(range(1, len(seq))) p from v_evseq) where seq[p] <> 0""",
)
view(
    "v_posraw",
    """select user_idx, pos, d, power(0.9::double, pos) * sum(coalesce(embedding[d], 0) / power(0.9::double, pos))
         over (partition by user_idx, d order by pos) s
       from v_possteps left join v_items using (item_idx), (select unnest(range(1, 65)) d)""",
)
view(
    "v_posunit",
    """select user_idx, pos, d, s / case when n = 0 then 1 else n end x from (
         select *, sqrt(sum(s * s) over (partition by user_idx, pos)) n from v_posraw)""",
)
view("v_posvec", "select user_idx, pos, list(x order by d) embedding from v_posunit group by 1, 2")
view(
    "v_postop",
    topk_sql(
        "list_dot_product(q.embedding, i.embedding)", 41, "desc",
        "from (select example_id query_id, embedding from v_pospairs join v_posvec using (user_idx, pos)) q, v_items i",
    ),
)


@query("encode_positions", "select user_idx, pos, (d - 1)::int dim, round(x, 6) x from v_posunit")
def encode_positions(spark, sf):
    from .vectors import event_seqs

    out = positions.encode_positions(event_seqs(spark, sf), views.item_vectors(spark, sf), decay=0.9)
    return out.select("user_idx", F.col("pos").cast("long").alias("pos"), F.posexplode("embedding").alias("dim", "x")).withColumn(
        "x", F.round("x", 6)
    )


@query(
    "mine_positions",
    f"""select example_id, pool[1 + {d_draw('example_id')} % len(pool)] neg_item_idx from (
          select example_id, list(item_idx order by rank) pool from (
            select *, row_number() over (partition by example_id order by rank) r,
              count(*) over (partition by example_id) c
            from (select example_id, t.item_idx, t.rank from v_pospairs p join v_postop t on t.query_id = p.example_id
                  where t.item_idx <> p.target))
          where c <= {SKIP} or r > {SKIP} group by 1)
        union all
        select example_id, (target + 1 + {d_draw('example_id', '1')} % (m - 1)) % m
        from v_pospairs anti join v_posvec using (user_idx, pos), (select count(*) m from v_items)""",
)
def mine_positions(spark, sf):
    """Each position searches with its own vector; the first of a history has none and gets a random item."""
    from .vectors import event_seqs

    items = views.item_vectors(spark, sf)
    return positions.mine_positions(
        position_pairs(spark, sf), event_seqs(spark, sf), items, items.count(), 40, SKIP, decay=0.9
    )


@query(
    "random_negatives_user",
    f"""select example_id, user_idx, max(case when j = 1 then item_idx end) neg_item_idx_1,
          max(case when j = 2 then item_idx end) neg_item_idx_2
        from (select example_id, e.user_idx, j, f.item_idx from v_exam e, (select unnest([1, 2]) j)
              join v_free f on f.user_idx = e.user_idx and f.r = {d_draw('example_id', 'j')} % f.m)
        group by 1, 2""",
)
def random_negatives_user(spark, sf):
    n = views.item_vectors(spark, sf).count()
    return negatives.random_negatives_user(
        event_examples(spark, sf), event_positives(spark, sf), n
    )


@query(
    "random_negatives_position",
    f"""select example_id, (target + 1 + {d_draw('example_id', '1')} % (n - 1)) % n neg_item_idx_1,
          (target + 1 + {d_draw('example_id', '2')} % (n - 1)) % n neg_item_idx_2
        from v_pospairs, (select count(*) n from v_items)""",
)
def random_negatives_position(spark, sf):
    n = views.item_vectors(spark, sf).count()
    return negatives.random_negatives_position(position_pairs(spark, sf), n)


# sampled candidates of the interaction table: all users have exactly one test row
view("v_pospart", "select distinct user_idx, item_idx from v_inter")
view(
    "v_unseenpart",
    """select user_idx, item_idx, row_number() over (partition by user_idx order by item_idx) - 1 r,
         count(*) over (partition by user_idx) m
       from (select user_idx, p_partkey item_idx from (select distinct user_idx from v_inter), part)
       anti join v_pospart using (user_idx, item_idx)""",
)


def _uniform_sql(n: int) -> str:
    """``n`` different places of each user (all if fewer) by Floyd's sampling, one step a round."""
    return f"""select user_idx, slot, item_idx from (
          with recursive floyd as (
            select distinct user_idx, m, least(m, {n}) k, 0::bigint i, []::bigint[] places from v_unseenpart
            union all
            select user_idx, m, k, i + 1, list_append(places, case when list_contains(places, r) then j else r end)
            from (select *, m - k + i j, {d_draw('user_idx', '(i + 1)')} % (m - k + i + 1) r from floyd where i < k))
          select user_idx, unnest(places) r, unnest(range(1, k + 1)) slot from floyd where i = k)
        join v_unseenpart using (user_idx, r)"""


def _weighted_sql(n: int, blocked: str) -> str:
    """First ``n`` different items at places drawn in the weight that a user has not seen, as running counts tell."""
    return f"""select user_idx, row_number() over (partition by user_idx order by a) slot, item_idx from (
          with free as (
            select user_idx, item_idx, cnt, sum(cnt) over (partition by user_idx order by item_idx) - cnt lo
            from (select * from (select distinct user_idx from v_inter), (select * from v_icnt where cnt > 0))
            anti join {blocked} using (user_idx, item_idx)),
          room as (select user_idx, sum(cnt)::bigint m, least(count(*), {n}) need from free group by 1),
          drawn as (
            select user_idx, a, {d_draw('user_idx', 'a', chr(39) + 'w' + chr(39))} % m x
            from room, (select unnest(range(1, {4 * n} + 1)) a) where a <= 4 * need)
          select d.user_idx, f.item_idx, min(a) a
          from drawn d asof join free f on d.user_idx = f.user_idx and d.x >= f.lo group by 1, 2)
        qualify slot <= {n}"""


view("v_target", "select user_idx, 0 slot, item_idx from v_lab where split = 'test'")
view("v_candu", f"select user_idx, slot, item_idx from v_target union all {_uniform_sql(100)}")
view("v_candp", f"select user_idx, slot, item_idx from v_target union all {_weighted_sql(100, 'v_pospart')}")
view("v_half", _uniform_sql(50))
view("v_halfseen", "select user_idx, item_idx from v_pospart union all select user_idx, item_idx from v_half")
view(
    "v_candm",
    f"""select user_idx, slot, item_idx from v_target union all select user_idx, slot, item_idx from v_half
        union all select user_idx, slot + 50, item_idx from ({_weighted_sql(50, 'v_halfseen')})""",
)


def candidates(spark, sf, strategy):
    lab, n = labelled(spark, sf), n_parts(spark, sf)
    return negatives.sampled_candidates(
        splits.take_split(lab, "test"),
        sequences.user_positive_sets(lab, 0.0),
        n,
        strategy,
        counts=None if strategy == "uniform" else features.item_counts(splits.take_split(lab, "train"), n),
    )


@query("sampled_candidates_uniform", "select user_idx, slot::int slot, item_idx from v_candu")
def sampled_candidates_uniform(spark, sf):
    return candidates(spark, sf, "uniform")


@query("sampled_candidates_popularity", "select user_idx, slot::int slot, item_idx from v_candp")
def sampled_candidates_popularity(spark, sf):
    return candidates(spark, sf, "popularity")


@query("sampled_candidates_mixed", "select user_idx, slot::int slot, item_idx from v_candm")
def sampled_candidates_mixed(spark, sf):
    return candidates(spark, sf, "mixed")


view(
    "v_randwide",
    f"""select example_id, user_idx, max(case when j = 1 then item_idx end) neg_item_idx_1,
          max(case when j = 2 then item_idx end) neg_item_idx_2
        from (select example_id, e.user_idx, j, f.item_idx from v_exam e, (select unnest([1, 2]) j)
              join v_free f on f.user_idx = e.user_idx and f.r = {d_draw('example_id', 'j')} % f.m)
        group by 1, 2""",
)


@query(
    "unpivot_negatives",
    """select example_id, user_idx, 1 slot, neg_item_idx_1 neg_item_idx from v_randwide
       union all select example_id, user_idx, 2, neg_item_idx_2 from v_randwide""",
)
def unpivot_negatives(spark, sf):
    wide = random_negatives_user(spark, sf)
    return negatives.unpivot_negatives(wide, keys=("example_id", "user_idx"))


@query(
    "subsample_exact",
    f"""select event_id, user_idx from (select *, row_number() over (order by {d_digest('event_id')}, event_id) r from v_ev)
        where r <= cast(floor((select count(*) from v_ev) * 0.3) as bigint)""",
)
def subsample_exact(spark, sf):
    kept = negatives.subsample_exact(views.event_interactions(spark, sf), 0.3, ["event_id"])
    return kept.select("event_id", "user_idx")


@query(
    "one_positive_per_user",
    f"""select user_idx, item_idx, 5.0::double rating from (select *, row_number() over
          (partition by user_idx order by {d_digest('event_id')}, event_id) r from v_ev) where r = 1""",
)
def one_positive_per_user(spark, sf):
    return negatives.one_positive_per_user(views.event_interactions(spark, sf), ["event_id"])


view(
    "v_trainneg",
    f"""select user_idx, slot::int slot, {d_draw('user_idx', 'slot')} % (select count(*) from v_items) neg_item_idx
        from v_evseq, (select unnest(range(1, 201)) slot)""",
)


def sequence_negatives(spark, sf):
    from .vectors import event_seqs

    seqs = event_seqs(spark, sf)
    return seqs, negatives.training_negatives(seqs, views.item_vectors(spark, sf).count(), 200)


@query("training_negatives", "select user_idx, slot, neg_item_idx from v_trainneg")
def training_negatives(spark, sf):
    return sequence_negatives(spark, sf)[1]


@query(
    "collision_mask",
    """select p.user_idx, pos, slot, neg_item_idx from v_pospairs p join v_trainneg n
       on n.user_idx = p.user_idx and n.neg_item_idx = p.target""",
)
def collision_mask(spark, sf):
    seqs, negs = sequence_negatives(spark, sf)
    mask = negatives.collision_mask(sequences.next_item_pairs(seqs), negs)
    return mask.withColumn("pos", F.col("pos").cast("long"))


@query(
    "negatives_excluding",
    f"""select user_idx, slot::int slot, item_idx from ({_uniform_sql(20)})""",
)
def negatives_excluding(spark, sf):
    lab = labelled(spark, sf)
    history, truth = splits.take_split(lab, "train", "val"), splits.take_split(lab, "test")
    out = negatives.negatives_excluding(
        truth.select("user_idx").distinct(), history, truth, n_parts(spark, sf), 20
    )
    return out.select("user_idx", F.col("slot").cast("int").alias("slot"), "item_idx")


