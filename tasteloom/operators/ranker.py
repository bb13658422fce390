"""Labelled tables, features, training and scoring of the second-stage ranker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import map_with
from ..functions.portable import digest, draw01
from ..schemas import EXPLICIT_NEG_WEIGHT, RANDOM_NEG_RATIO, RETRIEVAL_K, SEED
from .linear import YEAR_BUCKETS, LinearRanker, fit_linear, term_score
from .negatives import subsample_exact, unpivot_negatives
from .ordering import running_total, top_per_group, with_position
from .pairwise import fit_pairwise
from .prep import split_pos_neg


def _tagged(df: DataFrame, item: str, label: float, weight: float, source: str) -> DataFrame:
    return df.select(
        "user_idx",
        F.col(item).cast("long").alias("item_idx"),
        F.lit(label).alias("label"),
        F.lit(float(weight)).alias("weight"),
        F.lit(source).alias("source"),
    )


def ranker_train_table(
    inter: DataFrame,
    hard: DataFrame | None = None,
    rand: DataFrame | None = None,
    pos: float | None = 0.0,
    neg: float | None = None,
    explicit_neg_weight: float = EXPLICIT_NEG_WEIGHT,
    random_neg_ratio: float = RANDOM_NEG_RATIO,
    seed: int = SEED,
    key: str = "example_id",
) -> DataFrame:
    """``(user_idx, item_idx, label, weight, source)`` from positives and up to three kinds of
    negatives; random ones (wide) are cut to an exact share of their rows."""
    positives, explicit = split_pos_neg(inter, pos, neg)
    parts = []
    if positives is not None:
        parts.append(_tagged(positives, "item_idx", 1.0, 1.0, "positive"))
    if explicit is not None and explicit_neg_weight > 0:
        parts.append(_tagged(explicit, "item_idx", 0.0, explicit_neg_weight, "explicit"))
    if hard is not None:
        parts.append(_tagged(hard, "neg_item_idx", 0.0, 1.0, "hard"))
    if rand is not None and random_neg_ratio > 0:
        long = unpivot_negatives(rand, keys=(key, "user_idx"))
        kept = subsample_exact(long, random_neg_ratio, [key, "slot"], seed)
        parts.append(_tagged(kept, "neg_item_idx", 0.0, 1.0, "random"))
    if not parts:
        raise ValueError("no source of training rows")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranker_eval_table(
    inter: DataFrame,
    negatives: DataFrame | None = None,
    mode: str = "explicit",
    pos: float | None = 0.0,
    neg: float | None = None,
    key: str = "example_id",
) -> DataFrame:
    """Positives and one kind of negatives; an unknown mode means positives only."""
    if mode == "explicit":
        if neg is None:
            raise ValueError("explicit negatives need a negative threshold")
        return ranker_train_table(inter, pos=pos, neg=neg, explicit_neg_weight=1.0)
    if mode == "hard":
        return ranker_train_table(inter, hard=negatives, pos=pos)
    if mode == "random":
        return ranker_train_table(inter, rand=negatives, pos=pos, key=key)
    return ranker_train_table(inter, pos=pos)


def id_dropout(df: DataFrame, p: float = 0.1, seed: int = SEED, keys=("user_idx", "item_idx")) -> DataFrame:
    """Flag a share ``p`` of rows as unknown items (training-time cold start)."""
    return df.withColumn("is_unknown", F.when(draw01(*keys, seed=seed) < p, 1.0).otherwise(0.0))


def new_item_mask(df: DataFrame, unknown: bool = True) -> DataFrame:
    """Flag all rows explicitly; this overrides dropout."""
    return df.withColumn("is_unknown", F.lit(1.0 if unknown else 0.0))


def item_parts(item_emb: DataFrame, meta: DataFrame, pop: DataFrame) -> DataFrame:
    """Raw feature columns of each item: double vector, genre shares, year bucket, popularity."""
    n_genres = F.greatest(F.aggregate("genre_multihot", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    share = map_with("genre_multihot", n_genres, lambda g, n: g / n)
    return (
        item_emb.select("item_idx", F.col("embedding").cast("array<double>").alias("i_vec"))
        .join(meta.select("item_idx", share.alias("genre_share"), "year_bucket"), "item_idx")
        .join(pop.select("item_idx", "z"), "item_idx")
    )


def ranker_parts(
    pairs: DataFrame, user_emb: DataFrame, item_emb: DataFrame, meta: DataFrame, pop: DataFrame
) -> DataFrame:
    """Join the raw feature columns to (user_idx, item_idx) rows; other columns stay.

    What depends on the item alone is computed once per item.
    """
    items = item_parts(item_emb, meta, pop)
    users = user_emb.select("user_idx", F.col("embedding").cast("array<double>").alias("u_vec"))
    return pairs.join(items, "item_idx").join(users, "user_idx")


def assemble_features(parts: DataFrame) -> DataFrame:
    """``features``: user, item (zeroed if unknown), their product, popularity, year one-hot,
    genre shares, and the unknown flag."""
    flag = F.col("is_unknown") if "is_unknown" in parts.columns else F.lit(0.0)
    zeros = F.array_repeat(F.lit(0.0), F.size("i_vec"))
    item = F.when(flag > 0, zeros).otherwise(F.col("i_vec"))
    product = F.when(flag > 0, zeros).otherwise(F.zip_with("u_vec", "i_vec", lambda a, b: a * b))
    year = F.array(*[(F.col("year_bucket") == y).cast("double") for y in range(YEAR_BUCKETS)])
    vec = F.concat("u_vec", item, product, F.array(F.col("z")), year, "genre_share", F.array(flag))
    drop = ["u_vec", "i_vec", "genre_share", "year_bucket", "z"]
    return parts.withColumn("features", vec).drop(*drop)


def ranker_features(
    pairs: DataFrame, user_emb: DataFrame, item_emb: DataFrame, meta: DataFrame, pop: DataFrame
) -> DataFrame:
    return assemble_features(ranker_parts(pairs, user_emb, item_emb, meta, pop))


def bpr_differences(features: DataFrame, group: str, keys, seed: int = SEED) -> DataFrame:
    """Each positive next to one negative of its group as a feature difference.

    Positives and negatives of a group are numbered by hash and matched by number, the negatives
    starting over when they run out: as many rows as positives, never all pairs.
    """
    h = digest(*keys, seed=seed)
    rows = features.withColumn("_h", h)
    pos = with_position(rows.where("label = 1"), ["_h", *keys], keys=[group], name="_n")
    neg = with_position(rows.where("label = 0"), ["_h", *keys], keys=[group], name="_n")
    sizes = neg.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    matched = pos.join(sizes, group).withColumn("_n", F.pmod("_n", "_size")).join(
        neg.select(group, "_n", F.col("features").alias("_f")), [group, "_n"]
    )
    gap = F.zip_with("features", "_f", lambda a, b: a - b)
    # both directions, so that a classifier without intercept sees two classes
    side = F.explode(F.array(F.lit(1.0), F.lit(0.0)))
    both = matched.select(gap.alias("_gap"), "weight", side.alias("label"))
    signed = F.transform("_gap", lambda x: x * (F.col("label") * 2.0 - 1.0))
    return both.select(signed.alias("features"), "label", "weight")


def train_ranker(
    features: DataFrame,
    loss: str = "bce",
    model: str = "lr",
    group: str = "user_idx",
    keys=("user_idx", "item_idx"),
    max_iter: int = 30,
    reg: float = 1e-4,
    seed: int = SEED,
):
    """Fit a weighted classifier on ``features``.

    ``bpr`` fits a linear model to all pairs of a group; ``bpr_matched``, or ``bpr`` with trees, fits the
    classifier to the differences of each positive and one negative.
    """
    if loss == "bpr" and model == "lr":
        return fit_pairwise(features, group, max_iter, reg)
    loss = "bpr" if loss == "bpr_matched" else loss
    rows = bpr_differences(features, group, keys, seed) if loss == "bpr" else features
    rows = rows.select(array_to_vector("features").alias("features"), "label", "weight")
    if model == "gbt":
        return GBTClassifier(weightCol="weight", maxIter=max_iter, seed=seed).fit(rows)
    return LogisticRegression(
        weightCol="weight", maxIter=max_iter, regParam=reg, fitIntercept=loss != "bpr"
    ).fit(rows)


def fit_ranker(
    rows: DataFrame, user_emb: DataFrame, item_emb: DataFrame, meta: DataFrame, pop: DataFrame,
    loss: str = "bce", max_iter: int = 30, reg: float = 1e-4,
):
    """Fit a linear ranker to ``(user_idx, item_idx, label, weight, is_unknown)`` rows; their features are never
    written. Users have one vector each. With more items than a task holds, features are assembled."""
    model = fit_linear(rows, user_emb, item_parts(item_emb, meta, pop), loss, max_iter, reg)
    if model is not None:
        return model
    return train_ranker(ranker_features(rows, user_emb, item_emb, meta, pop), loss, max_iter=max_iter, reg=reg)


def score_rows(
    model, rows: DataFrame, user_emb: DataFrame, item_emb: DataFrame, meta: DataFrame, pop: DataFrame
) -> DataFrame:
    """The (user_idx, item_idx) rows with ``score``; a linear ranker needs no assembled features."""
    if isinstance(model, LinearRanker):
        terms = model.terms(rows, user_emb, item_parts(item_emb, meta, pop))
        return terms.withColumn("score", term_score()).select(*rows.columns, "score")
    return predict(model, ranker_features(rows, user_emb, item_emb, meta, pop)).select(*rows.columns, "score")


def predict(model, features: DataFrame) -> DataFrame:
    """Add ``score``: the probability of the positive class. ``model`` may also be a column
    function over the feature array, such as one made by ``predict_batch_udf``."""
    if isinstance(model, Callable) and not hasattr(model, "transform"):
        return features.withColumn("score", model(F.col("features")))
    rows = features.withColumn("_vec", array_to_vector("features"))
    scored = model.copy().setFeaturesCol("_vec").transform(rows)
    probability = vector_to_array("probability")[1]
    return scored.withColumn("score", probability).drop("_vec", "rawPrediction", "probability", "prediction")


def score_ranker(model, features: DataFrame, k: int = RETRIEVAL_K) -> DataFrame:
    """Best ``k`` items per query by ranker score."""
    return best_scored(predict(model, features), k)


def best_scored(rows: DataFrame, k: int = RETRIEVAL_K) -> DataFrame:
    scored = rows.select("query_id", "item_idx", F.round("score", 12).alias("score"))
    return top_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("item_idx")], k)


def permute_column(df: DataFrame, cols: list[str], keys: list[str], seed: int = SEED) -> DataFrame:
    """Give each row the ``cols`` of another row: rows in key order meet rows in hash order."""
    placed = with_position(df.drop(*cols), keys, name="_n")
    named = [f"_k{i}" for i in range(len(keys))]
    shuffled = with_position(
        df.select(*cols, *[F.col(k).alias(n) for k, n in zip(keys, named)]), [digest(*named, seed=seed), *named], name="_n"
    ).select(*cols, "_n")
    return placed.join(shuffled, "_n").drop("_n").select(*df.columns)


def auroc(df: DataFrame, score: str = "score", label: str = "label", group: str | None = None, **bounds) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null without both classes.

    Rows are first summed per distinct score, then negatives are accumulated in score order.
    """
    keys = [group] if group else []
    y = F.col(label)
    per_score = df.groupBy(*keys, score).agg(
        F.count(F.when(y == 1, 1)).alias("_p"), F.count(F.when(y == 0, 1)).alias("_q")
    )
    below = running_total(per_score, "_q", [score], keys, "_below", **bounds)
    sums = below.groupBy(*keys).agg(
        F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2.0)).alias("_u"),
        F.sum("_p").alias("_pos"),
        F.sum("_q").alias("_neg"),
    )
    area = F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.col("_u") / (F.col("_pos") * F.col("_neg")))
    return sums.select(*keys, area.alias("auroc"))
