"""Loss values over tables of vectors or scores, per batch.

All pairs of a batch enter a loss, but they are reduced inside block products: a row comes out with
the peak and mass of its part of the softmax, and parts are merged afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..schemas import LOG_EPS, MASKED, TEMPERATURE
from .grid import grid_apply
from .ordering import running_total

_PARTS = "b long, row_id long, peak double, mass double, own double"


def _contrastive(
    pairs: DataFrame,
    batch: str,
    temperature: float,
    prob: str | None,
    user_col: str | None,
    item_col: str | None,
    decoupled: bool,
) -> DataFrame:
    ids = [c for c in (user_col, item_col) if c]

    def kernel(left: dict, right: dict) -> dict:
        logits = left["user_vec"] @ right["item_vec"].T / temperature
        diagonal = left["row_id"][:, None] == right["row_id"][None, :]
        clash = np.zeros_like(diagonal)
        for c in ids:
            clash |= left[c][:, None] == right[c][None, :]
        if not decoupled:
            logits[clash & ~diagonal] = MASKED
        if prob:
            logits = logits - np.log(right["prob"] + LOG_EPS)[None, :]
        own = np.where(diagonal, logits, 0.0).sum(1)
        if decoupled:
            logits = np.where(diagonal | clash, MASKED, logits)
        peak = logits.max(1)
        mass = np.exp(logits - peak[:, None]).sum(1)
        return {"b": left[batch], "row_id": left["row_id"], "peak": peak, "mass": mass, "own": own}

    probs = [F.col(prob).cast("double").alias("prob")] if prob else []
    left = pairs.select(batch, "row_id", "user_vec", *ids)
    right = pairs.select(batch, "row_id", "item_vec", *ids, *probs)
    parts = grid_apply(left, right, kernel, _PARTS, keys=[batch])
    rows = _merge_parts(parts)
    return rows.groupBy(F.col("b").alias(batch)).agg(F.avg("loss").alias("loss"))


def _merge_parts(parts: DataFrame) -> DataFrame:
    """Log-sum-exp of a row over its block parts, minus its own logit."""
    row = Window.partitionBy("b", "row_id")  # as many rows as the batch has blocks
    lifted = parts.withColumn("_top", F.max("peak").over(row))
    return lifted.groupBy("b", "row_id").agg(
        (
            F.max("_top")
            + F.log(F.sum(F.col("mass") * F.exp(F.col("peak") - F.col("_top"))))
            - F.sum("own")
        ).alias("loss")
    )


def info_nce_loss(
    pairs: DataFrame,
    batch: str = "batch",
    temperature: float = TEMPERATURE,
    probs: str | None = None,
    user_col: str | None = None,
    item_col: str | None = None,
) -> DataFrame:
    """In-batch softmax loss per batch of ``(batch, row_id, user_vec, item_vec)``.

    Same-user and same-item pairs off the diagonal are masked before the popularity shift.
    """
    return _contrastive(pairs, batch, temperature, probs, user_col, item_col, False)


def dcl_loss(
    pairs: DataFrame,
    batch: str = "batch",
    temperature: float = TEMPERATURE,
    probs: str | None = None,
    user_col: str | None = None,
    item_col: str | None = None,
) -> DataFrame:
    """As ``info_nce_loss`` without the positive in the denominator, masked after the shift."""
    return _contrastive(pairs, batch, temperature, probs, user_col, item_col, True)


def sampled_softmax_loss(
    positions: DataFrame,
    negatives: DataFrame,
    temperature: float = TEMPERATURE,
    group: str = "batch",
) -> DataFrame:
    """Softmax loss of each position's target against its sequence's sampled negatives; one row.

    ``positions`` is ``(group, row_id, user_vec, item_vec, target)`` and ``negatives``
    ``(group, slot, neg_item_idx, embedding)``. A negative equal to the target is left out.
    """

    def kernel(left: dict, right: dict) -> dict:
        own = (left["user_vec"] * left["item_vec"]).sum(1) / temperature
        logits = left["user_vec"] @ right["embedding"].T / temperature
        logits[left["target"][:, None] == right["neg_item_idx"][None, :]] = MASKED / temperature
        peak = logits.max(1)
        mass = np.exp(logits - peak[:, None]).sum(1)
        return {"b": left[group], "row_id": left["row_id"], "peak": peak, "mass": mass, "own": own}

    parts = grid_apply(
        positions.select(group, "row_id", "user_vec", "item_vec", "target"),
        negatives.select(group, "slot", "neg_item_idx", "embedding"),
        kernel,
        _PARTS,
        keys=[group],
    )
    row = Window.partitionBy("b", "row_id")
    lifted = parts.withColumn("_top", F.greatest(F.max("peak").over(row), F.col("own")))
    rows = lifted.groupBy("b", "row_id").agg(
        F.max("_top").alias("_top"),
        F.max("own").alias("own"),
        F.sum(F.col("mass") * F.exp(F.col("peak") - F.col("_top"))).alias("_mass"),
    )
    loss = F.col("_top") + F.log(F.col("_mass") + F.exp(F.col("own") - F.col("_top"))) - F.col("own")
    return rows.agg(F.avg(loss).alias("loss"))


def bce_loss(
    df: DataFrame, logit: str = "logit", label: str = "label", weight: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Mean of the weighted logistic loss on logits."""
    x, y = F.col(logit), F.col(label)
    per_row = vectors.softplus(x) - x * y
    if weight:
        per_row = per_row * F.col(weight)
    return df.groupBy(*([batch] if batch else [])).agg(F.avg(per_row).alias("loss"))


def _pair_rows(df: DataFrame, logit: str, label: str, weight: str | None, batch: str | None):
    """Distinct positives ``(b, x, w, n)`` and negatives ``(b, x, n)``: equal rows give equal terms."""
    b = F.col(batch) if batch else F.lit(0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(
        b.cast("long").alias("b"), F.col(label).alias("y"), F.col(logit).cast("double").alias("x"), w.alias("w")
    )
    pos = rows.where("y = 1").groupBy("b", "x", "w").agg(F.count(F.lit(1)).alias("n"))
    neg = rows.where("y = 0").groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
    return rows, pos, neg


def _pair_mean(rows: DataFrame, sums: DataFrame, batch: str | None) -> DataFrame:
    """The sums ``(b, part)`` over all pairs as means; 0 for a batch without pairs."""
    sizes = rows.groupBy("b").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("q")
    )
    loss = F.when(
        (F.col("p") > 0) & (F.col("q") > 0), F.col("part") / (F.col("p") * F.col("q"))
    ).otherwise(0.0)
    out = sizes.join(sums, "b", "left").select("b", loss.alias("loss"))
    return out.withColumnRenamed("b", batch) if batch else out.select("loss")


def bpr_loss(
    df: DataFrame, logit: str = "logit", label: str = "label", weight: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Pairwise logistic loss; 0 for a batch without positives or without negatives."""
    rows, pos, neg = _pair_rows(df, logit, label, weight, batch)

    def kernel(left: dict, right: dict) -> dict:
        terms = np.logaddexp(0.0, right["x"][None, :] - left["x"][:, None])
        part = float((left["w"] * left["n"]) @ (terms @ right["n"].astype(float)))
        return {"b": left["b"][:1], "part": np.array([part])}

    parts = grid_apply(pos, neg, kernel, "b long, part double", keys=["b"])
    return _pair_mean(rows, parts.groupBy("b").agg(F.sum("part").alias("part")), batch)


def margin_loss(
    df: DataFrame, logit: str = "logit", label: str = "label", weight: str | None = None,
    batch: str | None = None, margin: float = 1.0, **bounds,
) -> DataFrame:
    """Mean of ``max(0, margin - (pos - neg))`` over all pairs of a batch.

    A sweep down the scores: the loss of a positive is linear in the number and the sum of the negatives
    above ``pos - margin``, so rows are sorted once and no pair is formed.
    """
    rows, pos, neg = _pair_rows(df, logit, label, weight, batch)
    none = F.lit(None).cast("double")
    steps = pos.select("b", (F.col("x") - margin).alias("at"), (F.col("w") * F.col("n")).alias("own"), F.lit(0).cast("long").alias("q"), F.lit(0.0).alias("s"))
    steps = steps.unionByName(neg.select("b", F.col("x").alias("at"), none.alias("own"), F.col("n").alias("q"), (F.col("n") * F.col("x")).alias("s")))
    swept = running_total(steps, {"above": "q", "total": "s"}, [F.col("at").desc()], ["b"], **bounds)
    part = F.sum(F.col("own") * (F.col("total") - F.col("at") * F.col("above")))
    return _pair_mean(rows, swept.where("own is not null").groupBy("b").agg(part.alias("part")), batch)


LOSSES = {"bce": bce_loss, "bpr": bpr_loss, "margin_ranking": margin_loss}


def ranker_loss(kind: str):
    """The loss function of that name."""
    try:
        return LOSSES[kind.lower()]
    except KeyError:
        raise ValueError(f"unknown loss {kind!r}; known: {', '.join(LOSSES)}") from None
