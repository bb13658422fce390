"""Offline evaluation jobs: each is one DataFrame pipeline from tables to ``(name, value)`` rows.

Interactions carry a ``split`` column; truth, history and queries are long tables keyed by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embeddings, metrics, ranker, retrieval, sequences
from ..operators.features import item_counts
from ..operators.linear import LinearRanker, term_score
from ..operators.ordering import top_per_group
from ..schemas import K_LIST, RETRIEVAL_K, SEED, TEMPERATURE, UNSCORED
from ..session import store


def test_truth(df: DataFrame, threshold: float | None = 0.0, split: str = "test") -> DataFrame:
    rows = df.where(F.col("split") == split)
    return sequences.ground_truth(rows, threshold).withColumnRenamed("user_idx", "query_id")


def seen_before_test(df: DataFrame, threshold: float | None = 0.0) -> DataFrame:
    return sequences.user_positive_sets(df, threshold, ("train", "val")).withColumnRenamed(
        "user_idx", "query_id"
    )


def _report(preds: DataFrame, truth: DataFrame, k_list, prefix: str = "", n: int | None = None) -> DataFrame:
    n = truth.select("query_id").distinct().count() if n is None else n
    return metrics.mean_metrics(metrics.batch_metrics(preds, truth, k_list, prefix), n)


def eval_popularity(
    df: DataFrame,
    n_items: int,
    k_list=K_LIST,
    sampled: DataFrame | None = None,
    mask: bool = True,
    threshold: float | None = 0.0,
) -> DataFrame:
    """The most popular train items against the test items.

    ``sampled`` is a candidate table ``(user_idx, slot, item_idx)``; otherwise the whole catalogue
    is ranked, with the user's history left out if ``mask``.
    """
    counts = item_counts(df.where(F.col("split") == "train"), n_items)
    truth = test_truth(df, threshold)
    if sampled is not None:
        cands = sampled.withColumnRenamed("user_idx", "query_id")
        preds = retrieval.popularity_topk(counts, max(k_list), candidates=cands)
    else:
        counts = store(counts)
        users = truth.select("query_id").distinct()
        history = seen_before_test(df, threshold) if mask else None
        preds = retrieval.popularity_topk(counts, max(k_list), users=users, history=history)
    return _report(preds, truth, k_list)


def eval_retrieval(
    user_emb: DataFrame,
    item_emb: DataFrame,
    truth: DataFrame,
    history: DataFrame | None = None,
    log_probs: DataFrame | None = None,
    k_list=K_LIST,
    candidates: DataFrame | None = None,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Dot-product ranking of all items (history left out) or of given candidates.

    With ``log_probs`` there is a second, popularity-corrected report.
    """
    k = max(k_list)
    queries = store(user_emb.join(truth.select("query_id").distinct(), "query_id", "left_semi"))
    if history is not None:
        history = store(history.select("query_id", "item_idx").distinct())
    n = truth.select("query_id").distinct().count()

    def report(items: DataFrame, scale: float, prefix: str) -> DataFrame:
        if candidates is not None:
            scored = retrieval.score_pairs(candidates, queries, item_emb)
            if scale != 1.0:
                scored = retrieval.score_with_logq(scored, log_probs, temperature)
            preds = retrieval.rank_scored(scored, k)
        elif history is not None:
            preds = retrieval.masked_topk(queries, items, history, k, scale)
        else:
            preds = retrieval.exact_topk(queries, items, k, scale=scale)
        return _report(preds, truth, k_list, prefix, n)

    out = report(item_emb, 1.0, "Standard_")
    if log_probs is not None:
        biased = retrieval.with_logq_bias(item_emb, log_probs)
        out = out.unionByName(report(biased, 1.0 / temperature, "LogQ_"))
    return out


def eval_sequential_retrieval(
    seqs: DataFrame,
    item_emb: DataFrame,
    history: DataFrame | None = None,
    log_probs: DataFrame | None = None,
    k_list=K_LIST,
    decay: float = 1.0,
    encoder=None,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """One query per test sequence ``(query_id, user_idx, seq)``; its last item is the target."""
    k = max(k_list)
    parts = sequences.split_input_target(seqs)
    vectors = store(
        embeddings.encode_sequences(
            parts.withColumnRenamed("input", "_in"), item_emb, encoder, decay,
            user="query_id", extra=["user_idx"], col="_in",
        )
    )
    truth = parts.select("query_id", F.col("target").alias("item_idx"))
    n = seqs.count()

    def report(items: DataFrame, scale: float, prefix: str) -> DataFrame:
        if history is None:
            preds = retrieval.exact_topk(vectors, items, k, scale=scale)
        else:
            preds = retrieval.masked_topk(vectors, items, history, k, scale, owner="user_idx")
        return _report(preds, truth, k_list, prefix, n)

    out = report(item_emb, 1.0, "Standard_")
    if log_probs is not None:
        biased = retrieval.with_logq_bias(item_emb, log_probs)
        out = out.unionByName(report(biased, 1.0 / temperature, "LogQ_"))
    return out


def _ranking_candidates(user_emb, item_emb, truth, history, temperature) -> DataFrame:
    queries = user_emb.select(F.col("user_idx").alias("query_id"), "embedding").join(
        truth.select("query_id").distinct(), "query_id", "left_semi"
    )
    found = retrieval.masked_topk(queries, item_emb, history, RETRIEVAL_K)
    return store(found.withColumn("score", F.col("score") / temperature))


def eval_ranker(
    model,
    user_emb: DataFrame,
    item_emb: DataFrame,
    meta: DataFrame,
    pop: DataFrame,
    truth: DataFrame,
    history: DataFrame,
    k_list=K_LIST,
    new_items: bool = False,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Retrieve 100 unseen items per user, report them, re-rank them, report again."""
    if max(k_list) > RETRIEVAL_K:
        raise ValueError(f"cuts above {RETRIEVAL_K} cannot be evaluated")
    cands = _ranking_candidates(user_emb, item_emb, truth, history, temperature)
    n = truth.select("query_id").distinct().count()
    pairs = cands.select("query_id", F.col("query_id").alias("user_idx"), "item_idx")
    if new_items:
        pairs = ranker.new_item_mask(pairs)
    ranked = ranker.best_scored(ranker.score_rows(model, pairs, user_emb, item_emb, meta, pop), max(k_list))
    prefix = "RankerNew_" if new_items else "Ranker_"
    return _report(cands, truth, k_list, "Retrieval_", n).unionByName(
        _report(ranked, truth, k_list, prefix, n)
    )


# feature name -> raw columns that are exchanged between rows
SENSITIVITY = {"genre": ["genre_share"], "year": ["year_bucket"], "popularity": ["z"]}


def eval_feature_sensitivity(
    model,
    user_emb: DataFrame,
    item_emb: DataFrame,
    meta: DataFrame,
    pop: DataFrame,
    truth: DataFrame,
    history: DataFrame,
    k_list=K_LIST,
    seed: int = SEED,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Metrics as they are and with one feature exchanged between candidate rows at a time."""
    cands = _ranking_candidates(user_emb, item_emb, truth, history, temperature)
    pairs = cands.select("query_id", F.col("query_id").alias("user_idx"), "item_idx")
    if isinstance(model, LinearRanker):  # rows carry the shares of their score instead of features
        terms = model.terms(pairs, user_emb, ranker.item_parts(item_emb, meta, pop))
        return permutation_importance(model, store(terms), truth, k_list, seed, {name: [name] for name in SENSITIVITY})
    parts = store(ranker.ranker_parts(pairs, user_emb, item_emb, meta, pop))
    return permutation_importance(model, parts, truth, k_list, seed)


def permutation_importance(
    model, parts: DataFrame, truth: DataFrame, k_list=K_LIST, seed: int = SEED, features=SENSITIVITY
) -> DataFrame:
    """Ranker metrics of raw feature rows, or of the score's terms, and again for each exchanged feature."""
    n = truth.select("query_id").distinct().count()

    def report(rows: DataFrame, prefix: str) -> DataFrame:
        if "base" in rows.columns:
            ranked = ranker.best_scored(rows.withColumn("score", term_score()), max(k_list))
        else:
            ranked = ranker.score_ranker(model, ranker.assemble_features(rows), max(k_list))
        return _report(ranked, truth, k_list, prefix, n)

    out = report(parts, "Ranker_")
    # the other row is the same one for every feature, so rows are put in order once
    every = [c for cols in features.values() for c in cols]
    other = {c: f"_other_{c}" for c in every}
    mixed = parts.withColumns({other[c]: F.col(c) for c in every})
    mixed = store(ranker.permute_column(mixed, list(other.values()), ["query_id", "item_idx"], seed))
    for name, cols in features.items():
        rows = mixed.withColumns({c: F.col(other[c]) for c in cols}).drop(*other.values())
        out = out.unionByName(report(rows, f"Perturb_{name.capitalize()}_"))
    return out


def validation_recall(
    val: DataFrame,
    user_emb: DataFrame,
    item_emb: DataFrame,
    n: int = 500,
    k_list=(10, 50, 100),
    seed: int = SEED,
) -> DataFrame:
    """Recall of at most ``n`` sampled validation users against all items, nothing masked."""
    truth = val.select(F.col("user_idx").alias("query_id"), "item_idx")
    users = retrieval.sample_queries(truth, n, seed, "query_id")
    truth = truth.join(users, "query_id", "left_semi")
    queries = user_emb.select(F.col("user_idx").alias("query_id"), "embedding").join(
        users, "query_id", "left_semi"
    )
    preds = store(retrieval.exact_topk(queries, item_emb, max(k_list)))
    out = None
    for k in k_list:
        row = metrics.recall_at_k(preds, truth, k).select(F.lit(f"Recall@{k}").alias("name"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def eval_served_hit_rate(
    served: DataFrame, test: DataFrame, k_list=(10, 50, 100), n: int = 1000, seed: int = SEED
) -> DataFrame:
    """Hit rate of served lists ``(user_idx, item_idx, rank, ok)`` for at most ``n`` test users.

    Users whose request failed, or was never answered, leave the denominator.
    """
    users = retrieval.sample_queries(test, n, seed, "user_idx")
    answered = served.where("ok").select("user_idx").distinct().join(users, "user_idx", "left_semi")
    truth = test.join(answered, "user_idx", "left_semi").select(
        F.col("user_idx").alias("query_id"), "item_idx"
    )
    preds = served.where("ok").select(F.col("user_idx").alias("query_id"), "item_idx", "rank")
    rows = metrics.per_query(preds, truth, k_list)
    rates = [
        F.coalesce(F.avg((F.col(f"hits_{k}") > 0).cast("double")), F.lit(0.0)).alias(f"HR@{k}")
        for k in k_list
    ]
    return rows.agg(*rates).unpivot([], [F.col(f"`HR@{k}`") for k in k_list], "name", "value")


def compare_rerankers(
    cands: DataFrame,
    scores: DataFrame,
    truth: DataFrame,
    scorers: list[str],
    users: DataFrame,
    n_users: int = 100,
    k_list=K_LIST,
) -> DataFrame:
    """The same candidates ``(query_id, item_idx, rank)`` ordered by each scorer.

    ``scores`` is ``(scorer, query_id, item_idx, score)``; a missing score counts as unscored, equal
    scores keep retrieval order. The first ``n_users`` of ``users`` (those with a history, in id
    order) that have candidates take part, and all of them count in the mean.
    """
    retrieved = cands.select("query_id").distinct()
    taking_part = (
        users.select("query_id").distinct().join(retrieved, "query_id", "left_semi")
        .orderBy("query_id").limit(n_users)
    )
    taking_part = store(taking_part)
    n = taking_part.count()
    base = cands.join(taking_part, "query_id", "left_semi").select(
        "query_id", "item_idx", F.col("rank").alias("_place")
    )
    truth = truth.join(taking_part, "query_id", "left_semi")
    out = None
    for name in scorers:
        own = scores.where(F.col("scorer") == name).select("query_id", "item_idx", "score")
        ranked = base.join(own, ["query_id", "item_idx"], "left").withColumn(
            "score", F.coalesce("score", F.lit(UNSCORED))
        )
        preds = top_per_group(ranked, ["query_id"], [F.col("score").desc(), F.col("_place")], max(k_list))
        part = _report(preds, truth, k_list, f"{name}_", n)
        out = part if out is None else out.unionByName(part)
    return out
