"""Ranking metrics, in two families with different rules.

``recall_at_k`` and its siblings average over queries that have targets and count repeated targets
in the denominator. ``batch_metrics`` gives sums over distinct targets, to be divided by a number of
queries the caller chooses.

Predictions are ``(query_id, item_idx, rank)``; truth is ``(query_id, item_idx)`` with optional
``copies``.
"""

from __future__ import annotations

from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import K_LIST
from .grid import grid_apply
from .ordering import top_per_group

NAMES = ("HitRate", "Recall", "NDCG", "MRR")


def _ideal(n, k: int):
    """Best possible gain for ``n`` targets at cut ``k``."""
    gains = list(accumulate(1.0 / log2(i + 2) for i in range(k)))
    return F.element_at(F.array(*[F.lit(g) for g in gains]), F.least(n, F.lit(k)).cast("int"))


def per_query(preds: DataFrame, truth: DataFrame, k_list) -> DataFrame:
    """One row per query with targets: target counts, and hits, gain and first hit for each k."""
    k_list = sorted(set(k_list))
    copies = F.sum("copies") if "copies" in truth.columns else F.count(F.lit(1))
    targets = truth.groupBy("query_id", "item_idx").agg(copies.alias("copies"))
    sizes = targets.groupBy("query_id").agg(
        F.sum("copies").alias("n_rows"), F.count(F.lit(1)).alias("n_items")
    )
    hits = (
        preds.where(F.col("rank") <= k_list[-1])
        .select("query_id", "item_idx", "rank")
        .join(targets.select("query_id", "item_idx"), ["query_id", "item_idx"])
    )
    aggs = [F.min("rank").alias("first")]
    for k in k_list:
        at = F.col("rank") <= k
        aggs.append(F.count(F.when(at, 1)).alias(f"hits_{k}"))
        aggs.append(F.sum(F.when(at, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"gain_{k}"))
    found = hits.groupBy("query_id").agg(*aggs)
    fill = {c: 0 for c in found.columns if c.startswith(("hits_", "gain_"))}
    return sizes.join(found, "query_id", "left").fillna(fill)


def _values(k: int, size: str):
    """The four metric values of one query."""
    return {
        "HitRate": F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0),
        "Recall": F.col(f"hits_{k}") / F.col(size),
        "NDCG": F.col(f"gain_{k}") / _ideal(F.col(size), k),
        "MRR": F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0),
    }


def _mean(preds: DataFrame, truth: DataFrame, k: int, name: str) -> DataFrame:
    rows = per_query(preds, truth, [k])
    return rows.agg(F.coalesce(F.avg(_values(k, "n_rows")[name]), F.lit(0.0)).alias("value"))


def recall_at_k(preds: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(preds, truth, k, "Recall")


def ndcg_at_k(preds: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(preds, truth, k, "NDCG")


def hit_rate_at_k(preds: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(preds, truth, k, "HitRate")


def mrr_at_k(preds: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(preds, truth, k, "MRR")


def batch_metrics(preds: DataFrame, truth: DataFrame, k_list=K_LIST, prefix: str = "") -> DataFrame:
    """Sums of all metrics at all cuts in one aggregate: ``(name, value)``, name ``Metric@k``."""
    rows = per_query(preds, truth, k_list)
    aggs, names = [], []
    for k in sorted(set(k_list)):
        for metric, value in _values(k, "n_items").items():
            names.append(f"{prefix}{metric}@{k}")
            aggs.append(F.coalesce(F.sum(value), F.lit(0.0)).alias(names[-1]))
    return rows.agg(*aggs).unpivot([], [F.col(f"`{n}`") for n in names], "name", "value")


def mean_metrics(sums: DataFrame, n: int) -> DataFrame:
    """Sums divided by the number of queries, those without targets included."""
    return sums.withColumn("value", F.col("value") / F.lit(float(max(n, 1))))


def metrics_table(long: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``Prefix_Metric@K`` rows as one row per K with a column per ``Prefix_Metric``."""
    parts = F.split("name", "@")
    rows = long.where(F.col("name").contains("@")).select(
        parts[0].alias("metric"), parts[1].cast("int").alias("k"), "value"
    )
    return rows.groupBy("k").pivot("metric", columns).agg(F.first("value"))


def in_batch_hit_rate(pairs: DataFrame, batch: str = "batch", k: int = 10) -> DataFrame:
    """Per batch: share of rows whose own item is in the top ``k`` of the batch.

    ``pairs`` is ``(batch, row_id, user_vec, item_vec)``. Equal scores rank by row id.
    """
    import numpy as np

    def kernel(left: dict, right: dict) -> dict:
        scores = np.round(left["user_vec"] @ right["item_vec"].T, 6)
        own = np.round((left["user_vec"] * left["item_vec"]).sum(1), 6)[:, None]
        earlier = right["row_id"][None, :] < left["row_id"][:, None]
        other = right["row_id"][None, :] != left["row_id"][:, None]
        above = ((scores > own) | ((scores == own) & earlier)) & other
        return {"b": left[batch], "row_id": left["row_id"], "above": above.sum(1)}

    left = pairs.select(batch, "row_id", "user_vec", "item_vec")
    right = pairs.select(batch, "row_id", "item_vec")
    counts = grid_apply(left, right, kernel, "b long, row_id long, above long", keys=[batch])
    ranks = counts.groupBy("b", "row_id").agg(F.sum("above").alias("above"))
    return ranks.groupBy(F.col("b").alias(batch)).agg(
        F.avg((F.col("above") < k).cast("double")).alias("hit_rate")
    )


def sampled_hit_rate(
    pos: DataFrame, neg: DataFrame, k: int = 10, key: str = "row_id", group: str | None = None
) -> DataFrame:
    """Share of rows with fewer than ``k`` sampled negatives scoring strictly higher.

    With ``group`` the rows of a group share its negatives: their best ``k`` scores decide, so rows x negatives
    are never formed.
    """
    if group is not None:
        best = top_per_group(neg.where("score is not null").select(group, "score"), [group], [F.col("score").desc()], k, "_n")
        lists = best.groupBy(group).agg(F.collect_list("score").alias("_best"))
        # rows may be unfolded from a list, which Spark's size estimate does not see: they must not be broadcast
        met = pos.select(group, key, "score").hint("merge").join(lists, group, "left")
        higher = F.size(F.filter("_best", lambda s: s > F.col("score")))
        above = met.groupBy(key).agg(F.sum(F.when(F.col("_best").isNull(), 0).otherwise(higher)).alias("above"))
        return above.agg(F.avg((F.col("above") < k).cast("double")).alias("hit_rate"))
    joined = pos.select(key, F.col("score").alias("_own")).join(neg.select(key, "score"), key, "left")
    above = joined.groupBy(key).agg(F.count(F.when(F.col("score") > F.col("_own"), 1)).alias("above"))
    return above.agg(F.avg((F.col("above") < k).cast("double")).alias("hit_rate"))
