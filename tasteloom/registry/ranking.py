"""Queries over ranker tables, losses and metrics."""

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.portable import draw, draw01
from ..operators import features, losses, metrics, negatives, ranker, retrieval, splits
from ..plans import evaluate
from ..session import store
from ..sources import views
from .common import digest as d_digest, draw as d_draw, draw01 as d_draw01, query, report_sql, view
from .negatives import candidates, event_examples, random_negatives_user, user_top
from .sequences import labelled, labelled_events
from .vectors import (
    UNSEEN,
    event_probs,
    event_seqs,
    features_rounded,
    part_counts,
    seen_items,
    topk_sql,
    user_vectors,
)

K = (10, 20)


# --- labelled tables

view(
    "v_hardneg",
    f"""select example_id, user_idx, pool[1 + {d_draw('example_id')} % len(pool)] neg_item_idx
        from v_exam join v_userpool using (user_idx)""",
)
view(
    "v_randlong",
    """select example_id, user_idx, 1 slot, neg_item_idx_1 item_idx from v_randwide
       union all select example_id, user_idx, 2, neg_item_idx_2 from v_randwide""",
)
view(
    "v_traintable",
    f"""select user_idx, item_idx, 1.0::double label, 1.0::double weight, 'positive' source from v_exam where rating >= 3
        union all select user_idx, item_idx, 0, 4, 'explicit' from v_exam where rating <= 1
        union all select user_idx, neg_item_idx, 0, 1, 'hard' from v_hardneg
        union all select user_idx, item_idx, 0, 1, 'random' from (
          select *, row_number() over (order by {d_digest('example_id', 'slot')}, example_id, slot) r from v_randlong)
          where r <= cast(floor((select count(*) from v_randlong) * 0.5) as bigint)""",
)


def hard_negatives(spark, sf):
    from .negatives import hard_negatives_user

    return hard_negatives_user(spark, sf)


def train_table(spark, sf):
    return ranker.ranker_train_table(
        event_examples(spark, sf),
        hard_negatives(spark, sf),
        random_negatives_user(spark, sf),
        pos=3.0,
        neg=1.0,
        random_neg_ratio=0.5,
    )


@query("ranker_train_table", "select user_idx, item_idx, label, weight, source from v_traintable")
def ranker_train_table(spark, sf):
    return train_table(spark, sf)


POSITIVES = "select user_idx, item_idx, 1.0::double label, 1.0::double weight, 'positive' source from v_exam where rating >= 3"


@query(
    "ranker_eval_table_explicit",
    POSITIVES + " union all select user_idx, item_idx, 0, 1, 'explicit' from v_exam where rating <= 1",
)
def ranker_eval_table_explicit(spark, sf):
    return ranker.ranker_eval_table(event_examples(spark, sf), mode="explicit", pos=3.0, neg=1.0)


@query(
    "ranker_eval_table_hard",
    POSITIVES + " union all select user_idx, neg_item_idx, 0, 1, 'hard' from v_hardneg",
)
def ranker_eval_table_hard(spark, sf):
    return ranker.ranker_eval_table(event_examples(spark, sf), hard_negatives(spark, sf), "hard", 3.0)


@query(
    "ranker_eval_table_random",
    POSITIVES + " union all select user_idx, item_idx, 0, 1, 'random' from v_randlong",
)
def ranker_eval_table_random(spark, sf):
    return ranker.ranker_eval_table(
        event_examples(spark, sf), random_negatives_user(spark, sf), "random", 3.0
    )


@query(
    "id_dropout",
    f"""select example_id, case when {d_draw01('user_idx', 'item_idx')} < 0.1 then 1.0::double else 0 end is_unknown
        from v_exam""",
)
def id_dropout(spark, sf):
    return ranker.id_dropout(event_examples(spark, sf), 0.1).select("example_id", "is_unknown")


# --- features; event items take the catalogue entry of the part with the same id

view("v_evz", "select item_idx, (log_prob - avg(log_prob) over ()) / (stddev_samp(log_prob) over () + 1e-6) z from v_evprob")
view(
    "v_evmeta",
    """select i.item_idx, title, coalesce(b, 0) b, case when genres is null or genres = '(no genres listed)'
         then ['Unknown'] else string_split(genres, '|') end own
       from v_items i left join v_cat c using (item_idx) left join v_year y using (item_idx)""",
)


def event_meta(spark, sf):
    cat = views.catalogue(spark, sf)
    ids = views.item_vectors(spark, sf).select(F.col("item_idx").alias("idx"), F.col("item_idx").alias("raw_id"))
    vocab = features.genre_vocabulary(cat)
    return features.item_metadata(ids, cat.withColumnRenamed("item_idx", "item_id"), vocab)


def event_z(spark, sf):
    return features.popularity_zscore(event_probs(spark, sf))


def feature_inputs(spark, sf):
    return (
        user_vectors(spark, sf),
        views.item_vectors(spark, sf),
        event_meta(spark, sf),
        event_z(spark, sf),
    )


@query(
    "ranker_features",
    f"""select example_id, (3 * 64 + 1 + 6 + (select count(*) from v_vocab) + 1)::int n,
          round(dot * (1 - unk) + usum + isum * (1 - unk) + 2 * z + 3 * b + gsum + 4 * unk, 5) s from (
          select example_id, case when {d_draw01('user_idx', 'item_idx')} < 0.1 then 1.0::double else 0 end unk,
            list_dot_product(u.embedding, i.embedding) dot, list_sum(u.embedding) usum, list_sum(i.embedding) isum, z, b,
            (select sum(pos) from v_vocab where list_contains(own, g)) / greatest(len(list_distinct(own)), 1)::double gsum
          from v_exam e join v_uvec u using (user_idx) join v_items i using (item_idx)
          join v_evz using (item_idx) join v_evmeta m using (item_idx))""",
)
def ranker_features(spark, sf):
    """Features are compared through a weighted sum over their sections."""
    pairs = ranker.id_dropout(event_examples(spark, sf).select("example_id", "user_idx", "item_idx"), 0.1)
    feats = ranker.ranker_features(pairs, *feature_inputs(spark, sf))

    def total(lo, n, weigh):
        part = F.transform(F.slice("features", F.lit(lo), n), weigh)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)

    plain, scaled = (lambda x, i: x), (lambda x, i: x * i)
    n_genres = F.size("features") - 3 * 64 - 8
    s = (
        total(1, F.lit(3 * 64), plain)
        + 2 * F.col("features")[192]
        + 3 * total(194, F.lit(6), scaled)
        + total(200, n_genres, scaled)
        + 4 * F.element_at("features", -1)
    )
    return feats.select("example_id", F.size("features").alias("n"), F.round(s, 5).alias("s"))


def labelled_rows(spark, sf):
    """The labelled rows, written once, and what their features are made of; the features themselves are not written."""
    users, *rest = feature_inputs(spark, sf)
    return store(ranker.id_dropout(train_table(spark, sf), 0.1)), (store(users), *map(store, rest))


def areas(scored, **name):
    """Area under the curve of ``(source, label, score)`` rows, per kind of negative."""
    tags, out = [F.lit(v).alias(k) for k, v in name.items()], None
    for source in ("explicit", "hard", "random"):
        rows = scored.where(F.col("source").isin("positive", source))
        part = ranker.auroc(rows).select(*tags, F.lit(source).alias("negatives"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out


@query("train_ranker")
def train_ranker(spark, sf):
    """Area under the curve of three trained rankers, per kind of negative, and of chance."""
    rows, inputs = labelled_rows(spark, sf)
    models = {
        "lr": ranker.fit_ranker(rows, *inputs),
        "gbt": ranker.train_ranker(ranker.ranker_features(rows, *inputs), model="gbt", max_iter=5),
        "bpr": ranker.fit_ranker(rows, *inputs, loss="bpr"),
    }
    out = None
    for name, model in models.items():
        scored = store(ranker.score_rows(model, rows, *inputs).select("source", "label", "score"))
        part = areas(scored, model=name)
        out = part if out is None else out.unionByName(part)
    return out


HELD_OUT = 0.2  # share of the users whose rows judge the ranker fitted on the others


def held_out_auroc(spark, sf):
    """``(model, negatives, auroc)`` over held-out users of rankers fitted on the other users."""
    rows, inputs = labelled_rows(spark, sf)
    out_of_fit = draw01("user_idx", seed=7) < HELD_OUT
    fit, held, out = rows.where(~out_of_fit), rows.where(out_of_fit), None
    for loss in ("bce", "bpr"):
        model = ranker.fit_ranker(fit, *inputs, loss=loss)
        scored = store(ranker.score_rows(model, held, *inputs).select("source", "label", "score"))
        part = areas(scored, model=loss)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "ranker_held_out",
    """select model, negatives, true as enough from (select unnest(['bce', 'bpr']) model) m,
         (select unnest(['explicit', 'hard', 'random']) negatives) n""",
)
def ranker_held_out(spark, sf):
    """Areas of at least 0.9 against hard and random negatives; ratings here are random, so that explicit
    ones cannot be told from positives and the area is that of chance, 0.4 to 0.6."""
    area = F.col("auroc")
    enough = F.when(F.col("negatives") == "explicit", area.between(0.4, 0.6)).otherwise(area >= 0.9)
    return held_out_auroc(spark, sf).select("model", "negatives", enough.alias("enough"))


def event_truth(spark, sf):
    return evaluate.test_truth(labelled_events(spark, sf), 0.0)


def trained(spark, sf):
    """The fitted ranker, and what features are made of."""
    rows, inputs = labelled_rows(spark, sf)
    return ranker.fit_ranker(rows, *inputs), inputs


@query("score_ranker")
def score_ranker(spark, sf):
    pairs = user_top(spark, sf).select("query_id", F.col("query_id").alias("user_idx"), "item_idx")
    model, inputs = trained(spark, sf)
    return ranker.best_scored(ranker.score_rows(model, pairs, *inputs), 20)


@query("eval_ranker")
def eval_ranker(spark, sf):
    model, inputs = trained(spark, sf)
    truth, history = event_truth(spark, sf), seen_items(spark, sf, "query_id")
    known = evaluate.eval_ranker(model, *inputs, truth, history, K)
    new = evaluate.eval_ranker(model, *inputs, truth, history, K, new_items=True)
    return known.unionByName(new.where(F.col("name").startswith("RankerNew")))


@query("eval_feature_sensitivity")
def eval_feature_sensitivity(spark, sf):
    model, inputs = trained(spark, sf)
    return evaluate.eval_feature_sensitivity(model, *inputs, event_truth(spark, sf), seen_items(spark, sf, "query_id"), K)


@query(
    "permute_column",
    f"""select a.event_id, b.item_idx from (select event_id, row_number() over (order by event_id) n from v_ev) a
        join (select item_idx, row_number() over (order by {d_digest('event_id')}, event_id) n from v_ev) b using (n)""",
)
def permute_column(spark, sf):
    ev = views.event_interactions(spark, sf).select("event_id", "item_idx")
    return ranker.permute_column(ev, ["item_idx"], ["event_id"])


@query(
    "auroc",
    """select lang, round((sum(case when quality = 1 then r end) - max(p) * (max(p) + 1) / 2.0) / nullif(max(p) * max(q), 0), 6) auroc
       from (select lang, quality, rank() over w + (count(*) over (partition by lang, n_chars) - 1) / 2.0 r,
               sum(quality) over (partition by lang) p, sum(1 - quality) over (partition by lang) q
             from labels join documents using (doc_id) window w as (partition by lang order by n_chars)) group by 1""",
)
def auroc(spark, sf):
    rows = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents"), "doc_id")
    return features_rounded(ranker.auroc(rows, "n_chars", "quality", "lang"), "auroc")


# --- losses; logits are event values, labels their rating

view(
    "v_logit",
    """select event_id // 500 as batch, (value - 50) / 100 x, case when rating >= 3 then 1 else 0 end y,
         1.0::double + (item_idx % 3) w from events join v_ev using (event_id, ts)""",
)


def logits(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", ((F.col("value") - 50) / 100).alias("logit"))
    return views.event_interactions(spark, sf).join(ev, "event_id").select(
        F.floor(F.col("event_id") / 500).alias("batch"),
        "logit",
        (F.col("rating") >= 3).cast("int").alias("label"),
        (1.0 + F.col("item_idx") % 3).alias("weight"),
    )


@query(
    "bce_loss",
    "select batch, round(avg(w * (greatest(x, 0) + ln(1 + exp(-abs(x))) - x * y)), 6) loss from v_logit group by 1",
)
def bce_loss(spark, sf):
    return features_rounded(losses.ranker_loss("bce")(logits(spark, sf), weight="weight", batch="batch"), "loss")


def _pair_sql(term: str) -> str:
    return f"""select batch, round(coalesce(avg(p.w * ({term})), 0), 6) loss from (select distinct batch from v_logit)
        left join (select batch, x, w from v_logit where y = 1) p using (batch)
        left join (select batch, x from v_logit where y = 0) q using (batch) group by 1"""


@query("bpr_loss", _pair_sql("ln(1 + exp(-(p.x - q.x)))"))
def bpr_loss(spark, sf):
    return features_rounded(losses.ranker_loss("bpr")(logits(spark, sf), weight="weight", batch="batch"), "loss")


@query("margin_loss", _pair_sql("greatest(0, 0.5 - (p.x - q.x))"))
def margin_loss(spark, sf):
    df = losses.margin_loss(logits(spark, sf), weight="weight", batch="batch", margin=0.5)
    return features_rounded(df, "loss")


# batches of 32 vectors, each with the following vector as its item; ids with collisions
view(
    "v_pair",
    """select n.item_idx // 32 as batch, n.item_idx row_id, u, v, (n.item_idx * 7) % 20 usr, (n.item_idx * 5) % 50 itm, prob
       from v_next n join v_evprob p on p.item_idx = n.item_idx""",
)
view(
    "v_inbatch",
    """select a.batch, a.row_id, b.row_id other, list_dot_product(a.u, b.v) s, a.row_id = b.row_id diag,
         (a.usr = b.usr or a.itm = b.itm) clash, ln(b.prob + 1e-10) lp
       from v_pair a join v_pair b using (batch)""",
)


def loss_pairs(spark, sf):
    items = views.item_vectors(spark, sf)
    nxt = items.select((F.col("item_idx") - 1).alias("item_idx"), F.col("embedding").alias("item_vec"))
    probs = event_probs(spark, sf).select("item_idx", "prob")
    return items.join(nxt, "item_idx").join(probs, "item_idx").select(
        F.floor(F.col("item_idx") / 32).alias("batch"),
        F.col("item_idx").alias("row_id"),
        F.col("embedding").alias("user_vec"),
        "item_vec",
        (F.col("item_idx") * 7 % 20).alias("usr"),
        (F.col("item_idx") * 5 % 50).alias("itm"),
        "prob",
    )


def _softmax_sql(logit: str, keep: str = "true") -> str:
    return f"""select batch, round(avg(lse - own), 5) loss from (
        select batch, row_id, max(l) + ln(sum(exp(l - top))) lse, max(own) own from (
          select *, max(l) over (partition by batch, row_id) top from (
            select batch, row_id, {logit} l, max(case when diag then s / 0.05::double - lp end) over (partition by batch, row_id) own
            from v_inbatch where {keep})) group by 1, 2) group by 1"""


@query("info_nce_loss", _softmax_sql("case when clash and not diag then -1e9::double else s / 0.05::double end - lp"))
def info_nce_loss(spark, sf):
    df = losses.info_nce_loss(loss_pairs(spark, sf), probs="prob", user_col="usr", item_col="itm")
    return df.withColumn("loss", F.round("loss", 5))


@query("dcl_loss", _softmax_sql("case when clash or diag then -1e9::double else s / 0.05::double - lp end"))
def dcl_loss(spark, sf):
    df = losses.dcl_loss(loss_pairs(spark, sf), probs="prob", user_col="usr", item_col="itm")
    return df.withColumn("loss", F.round("loss", 5))


view(
    "v_negs",
    f"""select user_idx, slot, {d_draw('user_idx', 'slot')} % (select count(*) from v_items) neg
        from v_evseq, (select unnest(range(1, 51)) slot)""",
)


@query(
    "sampled_softmax_loss",
    """select round(avg(greatest(own, top) + ln(coalesce(m, 0) + exp(own - greatest(own, top))) - own), 6) loss from (
         select user_idx, pos, any_value(own) own, max(l) top, sum(exp(l - greatest(own, mx))) m from (
           select *, max(l) over (partition by user_idx, pos) mx from (
             select p.user_idx, p.pos, list_dot_product(u.embedding, t.embedding) / 0.05::double own,
               list_dot_product(u.embedding, i.embedding) / 0.05::double l
             from v_pospairs p join v_uvec u using (user_idx) join v_items t on t.item_idx = p.target
             join v_negs n on n.user_idx = p.user_idx join v_items i on i.item_idx = n.neg where n.neg <> p.target))
         group by 1, 2)""",
)
def sampled_softmax_loss(spark, sf):
    from ..operators.sequences import next_item_pairs

    items = views.item_vectors(spark, sf)
    seqs = event_seqs(spark, sf)
    pairs = next_item_pairs(seqs).select("user_idx", "pos", "target")
    positions = (
        pairs.join(user_vectors(spark, sf), "user_idx")
        .join(items.select(F.col("item_idx").alias("target"), F.col("embedding").alias("item_vec")), "target")
        .select(
            F.col("user_idx").alias("batch"),
            (F.col("user_idx") * 1000 + F.col("pos")).alias("row_id"),
            F.col("embedding").alias("user_vec"),
            "item_vec",
            "target",
        )
    )
    negs = negatives.training_negatives(seqs, items.count(), 50)
    negs = negs.join(items.select(F.col("item_idx").alias("neg_item_idx"), "embedding"), "neg_item_idx")
    df = losses.sampled_softmax_loss(positions, negs.withColumnRenamed("user_idx", "batch"))
    return features_rounded(df, "loss")


# --- metrics

view("v_evtruth", "select user_idx query_id, item_idx from v_ev where rating >= 2")
view("v_evpred", topk_sql("raw", 100, "desc", "from (select user_idx query_id, item_idx, raw from v_scores)"))


def repeated_truth(spark, sf):
    """All events of a user as targets: many repeat."""
    ev = views.event_interactions(spark, sf).where("rating >= 2")
    return ev.select(F.col("user_idx").alias("query_id"), "item_idx")


# targets repeat, so hits are counted on distinct pairs and the denominator on rows
SINGLE = """select round(avg({value}), 6) as value from (
    select t.query_id, n, count(rank) h, coalesce(sum(1 / log2(rank + 1)), 0) g, min(rank) as first from
      (select query_id, item_idx, sum(count(*)) over (partition by query_id) n from v_evtruth group by 1, 2) t
    left join (select * from v_evpred where rank <= 10) p on p.query_id = t.query_id and p.item_idx = t.item_idx
    group by 1, 2)"""
IDEAL10 = "list_sum(list_transform(range(1, least(n, 10)::bigint + 1), lambda i: 1 / log2(i + 1)))"


@query("recall_at_k", SINGLE.format(value="h / n::double"))
def recall_at_k(spark, sf):
    return features_rounded(metrics.recall_at_k(user_top(spark, sf), repeated_truth(spark, sf), 10), "value")


@query("ndcg_at_k", SINGLE.format(value=f"g / {IDEAL10}"))
def ndcg_at_k(spark, sf):
    return features_rounded(metrics.ndcg_at_k(user_top(spark, sf), repeated_truth(spark, sf), 10), "value")


@query("hit_rate_at_k", SINGLE.format(value="case when h > 0 then 1.0::double else 0 end"))
def hit_rate_at_k(spark, sf):
    return features_rounded(metrics.hit_rate_at_k(user_top(spark, sf), repeated_truth(spark, sf), 10), "value")


@query("mrr_at_k", SINGLE.format(value="coalesce(1.0::double / first, 0)"))
def mrr_at_k(spark, sf):
    return features_rounded(metrics.mrr_at_k(user_top(spark, sf), repeated_truth(spark, sf), 10), "value")


@query("batch_metrics", report_sql("v_evpred", "v_evtruth", "1", (10, 50)))
def batch_metrics(spark, sf):
    return features_rounded(
        metrics.batch_metrics(user_top(spark, sf), repeated_truth(spark, sf), (10, 50)), "value"
    )


@query(
    "mean_metrics",
    report_sql("v_evpred", "v_evtruth", "(select count(distinct user_id)::double from events)", (10, 50)),
)
def mean_metrics(spark, sf):
    sums = metrics.batch_metrics(user_top(spark, sf), repeated_truth(spark, sf), (10, 50))
    n = views.table(spark, sf, "events").select("user_id").distinct().count()
    return features_rounded(metrics.mean_metrics(sums, n), "value")


@query(
    "metrics_table",
    f"""select k, max(case when m = 'HitRate' then value end) "HitRate", max(case when m = 'Recall' then value end) "Recall",
          max(case when m = 'NDCG' then value end) "NDCG", max(case when m = 'MRR' then value end) "MRR" from (
          select split_part(name, '@', 1) m, split_part(name, '@', 2)::int k, value from
            ({report_sql("v_evpred", "v_evtruth", "1", (10, 50))})) group by 1""",
)
def metrics_table(spark, sf):
    return metrics.metrics_table(batch_metrics(spark, sf), list(metrics.NAMES))


@query(
    "in_batch_hit_rate",
    """select batch, round(avg(case when above < 10 then 1.0::double else 0 end), 6) hit_rate from (
         select batch, row_id, count(case when not diag and (round(s, 6) > own or (round(s, 6) = own and other < row_id)) then 1 end) above
         from (select *, max(case when diag then round(s, 6) end) over (partition by batch, row_id) own from v_inbatch)
         group by 1, 2) group by 1""",
)
def in_batch_hit_rate(spark, sf):
    return features_rounded(metrics.in_batch_hit_rate(loss_pairs(spark, sf)), "hit_rate")


@query(
    "sampled_hit_rate",
    """select round(avg(case when above < 10 then 1.0::double else 0 end), 6) hit_rate from (
         select p.user_idx, p.pos, count(case when n.s > p.s then 1 end) above from
           (select user_idx, pos, round(raw, 12) s from v_pospairs join v_scores s using (user_idx) where s.item_idx = target) p
         join (select n.user_idx, slot, round(raw, 12) s from v_negs n join v_scores s on s.user_idx = n.user_idx and s.item_idx = n.neg) n
           on n.user_idx = p.user_idx group by 1, 2)""",
)
def sampled_hit_rate(spark, sf):
    from ..operators.sequences import next_item_pairs

    items, users, seqs = views.item_vectors(spark, sf), user_vectors(spark, sf, "query_id"), event_seqs(spark, sf)
    pairs = next_item_pairs(seqs).select(
        F.col("user_idx").alias("query_id"), (F.col("user_idx") * 1000 + F.col("pos")).alias("row_id"), "target"
    )

    def scored(rows, item):
        # rows are unfolded from a row per user, which Spark's size estimate does not see: they must not be broadcast
        joined = rows.hint("merge").join(users, "query_id").join(
            items.select(F.col("item_idx").alias(item), F.col("embedding").alias("_i")), item
        )
        return joined.withColumn("score", F.round(vectors.dot("embedding", "_i"), 12)).drop("embedding", "_i")

    negs = negatives.training_negatives(seqs, items.count(), 50).withColumnRenamed("user_idx", "query_id")
    rate = metrics.sampled_hit_rate(scored(pairs, "target"), scored(negs, "neg_item_idx"), group="query_id")
    return features_rounded(rate, "hit_rate")


# --- evaluation jobs

view(
    "v_poppred",
    """select query_id, item_idx, rank from (
         select u.user_idx query_id, item_idx, row_number() over (partition by u.user_idx order by cnt desc, item_idx) rank
         from (select user_idx, item_idx, cnt from (select distinct user_idx from v_lab), v_icnt) u
         anti join (select user_idx, item_idx from v_lab where split <> 'test') h using (user_idx, item_idx))
       where rank <= 100""",
)
view("v_truth", "select user_idx query_id, item_idx from v_lab where split = 'test'")
N_TRUTH = "(select count(distinct query_id)::double from v_truth)"
ALL_K = (10, 20, 50, 100)


def popularity_report(spark, sf):
    from .features import n_parts

    return evaluate.eval_popularity(labelled(spark, sf), n_parts(spark, sf))


@query("eval_popularity", report_sql("v_poppred", "v_truth", N_TRUTH, ALL_K))
def eval_popularity(spark, sf):
    return features_rounded(popularity_report(spark, sf), "value")


view(
    "v_sampledpred",
    """select user_idx query_id, item_idx, row_number() over (partition by user_idx order by cnt desc, item_idx) rank
       from v_candu join v_icnt using (item_idx)""",
)


@query("eval_popularity_sampled", report_sql("v_sampledpred", "v_truth", N_TRUTH, ALL_K))
def eval_popularity_sampled(spark, sf):
    from .features import n_parts

    df = evaluate.eval_popularity(
        labelled(spark, sf), n_parts(spark, sf), sampled=candidates(spark, sf, "uniform")
    )
    return features_rounded(df, "value")


view(
    "v_poptop",
    """select query_id, t.item_idx, t.rank from (select distinct query_id from v_truth),
       (select item_idx, row_number() over (order by cnt desc, item_idx) rank from v_icnt order by rank limit 100) t""",
)


@query("eval_popularity_unmasked", report_sql("v_poptop", "v_truth", N_TRUTH, ALL_K))
def eval_popularity_unmasked(spark, sf):
    from .features import n_parts

    df = evaluate.eval_popularity(labelled(spark, sf), n_parts(spark, sf), mask=False)
    return features_rounded(df, "value")


view("v_evtest", "select user_idx query_id, item_idx from v_evlab where split = 'test'")
view("v_stdpred", topk_sql("raw", 100, "desc", UNSEEN))
view("v_logqpred", topk_sql("raw / 0.05::double + log_prob", 100, "desc", UNSEEN))
N_EV = "(select count(distinct query_id)::double from v_evtest)"


@query(
    "eval_retrieval",
    report_sql("v_stdpred", "v_evtest", N_EV, ALL_K, "Standard_")
    + " union all "
    + report_sql("v_logqpred", "v_evtest", N_EV, ALL_K, "LogQ_"),
)
def eval_retrieval(spark, sf):
    df = evaluate.eval_retrieval(
        user_vectors(spark, sf, "query_id"),
        views.item_vectors(spark, sf),
        event_truth(spark, sf),
        seen_items(spark, sf, "query_id"),
        event_probs(spark, sf),
    )
    return features_rounded(df, "value")


view(
    "v_candscore",
    """select user_idx query_id, item_idx, round(raw, 12) s, log_prob from (
         select user_idx, item_idx from v_seen union select query_id, item_idx from v_evtest)
       join v_scores using (user_idx, item_idx) join v_evprob using (item_idx)""",
)
view("v_stdcand", "select query_id, item_idx, row_number() over (partition by query_id order by s desc, item_idx) rank from v_candscore")
view(
    "v_logqcand",
    """select query_id, item_idx, row_number() over (partition by query_id order by round(s / 0.05::double + log_prob, 12) desc, item_idx) rank
       from v_candscore""",
)


@query(
    "eval_retrieval_candidates",
    report_sql("v_stdcand", "v_evtest", N_EV, K, "Standard_")
    + " union all "
    + report_sql("v_logqcand", "v_evtest", N_EV, K, "LogQ_"),
)
def eval_retrieval_candidates(spark, sf):
    """Each user's own items and its target as the candidates."""
    truth = event_truth(spark, sf)
    cands = seen_items(spark, sf, "query_id").union(truth.select("query_id", "item_idx")).distinct()
    df = evaluate.eval_retrieval(
        user_vectors(spark, sf, "query_id"), views.item_vectors(spark, sf), truth,
        log_probs=event_probs(spark, sf), k_list=K, candidates=cands,
    )
    return features_rounded(df, "value")


view(
    "v_seqvec",
    """select user_idx, list(m / n order by pos) embedding from (
         select *, sqrt(sum(m * m) over (partition by user_idx)) n from (
           select user_idx, pos, avg(v) m from (
             select user_idx, unnest(embedding) v, generate_subscripts(embedding, 1) pos
             from (select user_idx, unnest(seq) it from v_evseq) join v_items on item_idx = it - 1)
           group by 1, 2)) group by 1""",
)
view(
    "v_seqpred",
    topk_sql(
        "raw", 100, "desc",
        """from (select user_idx query_id, item_idx, list_dot_product(u.embedding, i.embedding) raw
                 from v_seqvec u, v_items i) s anti join v_seen h on h.user_idx = s.query_id and h.item_idx = s.item_idx""",
    ),
)


@query("eval_sequential_retrieval", report_sql("v_seqpred", "v_evtest", N_EV, ALL_K, "Standard_"))
def eval_sequential_retrieval(spark, sf):
    from ..operators.sequences import eval_windows

    seqs = eval_windows(labelled_events(spark, sf), "test", views.EVENT_ORDER)
    seqs = seqs.select(F.col("user_idx").alias("query_id"), "user_idx", "seq")
    df = evaluate.eval_sequential_retrieval(
        seqs, views.item_vectors(spark, sf), seen_items(spark, sf)
    )
    return features_rounded(df, "value")


view(
    "v_valrec",
    f"""select user_idx query_id, item_idx from v_evlab where split = 'val' and user_idx in (
          select user_idx from (select distinct user_idx from v_evlab where split = 'val')
          order by {d_digest('user_idx')}, user_idx limit 100)""",
)


@query(
    "validation_recall",
    " union all ".join(
        f"""select 'Recall@{k}' as name, round(avg(case when rank <= {k} then 1.0::double else 0 end), 6) as value
            from v_valrec left join v_usertop using (query_id, item_idx)"""
        for k in (10, 50, 100)
    ),
)
def validation_recall(spark, sf):
    val = splits.take_split(labelled_events(spark, sf), "val")
    df = evaluate.validation_recall(
        val, user_vectors(spark, sf), views.item_vectors(spark, sf), n=100
    )
    return features_rounded(df, "value")


@query(
    "eval_served_hit_rate",
    " union all ".join(
        f"""select 'HR@{k}' as name, round(avg(hit), 6) as value from (
              select query_id, max(case when rank <= {k} then 1.0::double else 0 end) hit from v_evtest
              left join v_stdpred using (query_id, item_idx)
              where query_id not in (select user_id from events group by 1 having arg_max(event_type, event_id) = 'error') and query_id in (select query_id from v_evtest order by {d_digest('query_id')}, query_id limit 100)
              group by 1)"""
        for k in (10, 50, 100)
    ),
)
def eval_served_hit_rate(spark, sf):
    """Served lists; the request of a user whose newest event is an error failed."""
    lists = retrieval.masked_topk(
        user_vectors(spark, sf, "query_id"), views.item_vectors(spark, sf), seen_items(spark, sf, "query_id")
    )
    outcome = views.table(spark, sf, "events").groupBy(F.col("user_id").alias("query_id")).agg(
        (F.max_by("event_type", "event_id") != "error").alias("ok")
    )
    served = lists.join(outcome, "query_id").select(
        F.col("query_id").alias("user_idx"), "item_idx", "rank", "ok"
    )
    test = splits.take_split(labelled_events(spark, sf), "test").select("user_idx", "item_idx")
    return features_rounded(evaluate.eval_served_hit_rate(served, test, n=100), "value")


view(
    "v_rerank",
    f"""select query_id, item_idx, rank place, case when {d_draw('query_id', 'item_idx')} % 5 = 0 then -999.0::double
          else floor({d_draw01('query_id', 'item_idx')} * 20) end noisy, -rank::double keep from v_stdpred""",
)
for _name, _col in (("v_noisypred", "noisy"), ("v_keeppred", "keep")):
    view(
        _name,
        f"""select query_id, item_idx, row_number() over (partition by query_id order by {_col} desc, place) rank
            from v_rerank""",
    )
view("v_firsttruth", "select * from v_evtest where query_id in (select distinct query_id from v_stdpred order by 1 limit 50)")


@query(
    "compare_rerankers",
    report_sql("v_keeppred", "v_firsttruth", "50.0::double", K, "keep_")
    + " union all "
    + report_sql("v_noisypred", "v_firsttruth", "50.0::double", K, "noisy_"),
)
def compare_rerankers(spark, sf):
    """Retrieval order against seeded noise with ties and missing scores, on the first 50 users."""
    cands = store(
        retrieval.masked_topk(
            user_vectors(spark, sf, "query_id"), views.item_vectors(spark, sf), seen_items(spark, sf, "query_id")
        )
    )
    keep = cands.select(F.lit("keep").alias("scorer"), "query_id", "item_idx", (-F.col("rank")).cast("double").alias("score"))
    noise = cands.where(draw("query_id", "item_idx", seed=42) % 5 != 0).select(
        F.lit("noisy").alias("scorer"), "query_id", "item_idx",
        F.floor(draw01("query_id", "item_idx", seed=42) * 20).cast("double").alias("score"),
    )
    df = evaluate.compare_rerankers(
        cands, keep.unionByName(noise), event_truth(spark, sf), ["keep", "noisy"],
        seen_items(spark, sf, "query_id"), 50, K,
    )
    return features_rounded(df, "value")
