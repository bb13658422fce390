"""Tables of vectors: look-up, checks, statistics, and how vectors are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, vectors
from ..functions.portable import normal
from ..schemas import SEED
from ..session import store
from .prep import decode_ids, encode_ids
from .spectral import signs, symmetric_factors


def embedding_norm_report(emb: DataFrame, col: str = "embedding") -> DataFrame:
    length = vectors.norm(col)
    return emb.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(col)).alias("min_dim"),
        F.max(F.size(col)).alias("max_dim"),
        F.min(length).alias("min_norm"),
        F.max(length).alias("max_norm"),
        F.avg(length).alias("avg_norm"),
    )


def lookup_embeddings(
    df: DataFrame, emb: DataFrame, key: str, how: str = "inner", out: str = "embedding"
) -> DataFrame:
    """Attach the vector of ``key``. Small tables are broadcast by their measured size."""
    return df.join(emb.select(key, F.col("embedding").alias(out)), key, how)


def fill_missing_embeddings(emb: DataFrame, n: int, dim: int, key: str = "user_idx") -> DataFrame:
    """One vector for each id below ``n``; the zero vector where there was none."""
    every = emb.sparkSession.range(n).select(F.col("id").alias(key))
    vec = F.coalesce(F.col("embedding").cast("array<double>"), vectors.zero_vector(dim))
    return every.join(emb, key, "left").select(key, vec.alias("embedding"))


def embedding_drift_gate(
    ref: DataFrame, cands: DataFrame, lo: float = 0.95, hi: float = 1.01, key: str = "id"
) -> DataFrame:
    """Per candidate table: range of the dot product with the reference vector, and acceptance."""
    pairs = cands.join(ref.select(key, F.col("embedding").alias("_ref")), key)
    sims = pairs.select("cand", vectors.dot("embedding", "_ref").alias("_sim"))
    return sims.groupBy("cand").agg(
        F.min("_sim").alias("min_sim"),
        F.max("_sim").alias("max_sim"),
        F.bool_and((F.col("_sim") >= lo) & (F.col("_sim") <= hi)).alias("ok"),
    )


def best_accepted(gate: DataFrame, latency: DataFrame) -> DataFrame:
    """The accepted candidate with the least latency (ties to the smaller name)."""
    accepted = gate.where("ok").join(latency, "cand")
    return accepted.orderBy("latency_ms", "cand").limit(1)


def dimension_stats(emb: DataFrame, col: str = "embedding") -> DataFrame:
    """Mean and population deviation per dimension; one vector aggregate, no row per element."""
    vec = array_to_vector(F.col(col).cast("array<double>"))
    stats = emb.agg(
        Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s")
    ).select(
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("var"),
        F.col("s.count").alias("n"),
    )
    # the aggregate gives the sample variance
    return stats.select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("pos", "e")).select(
        "pos",
        F.col("e.mean").alias("mean"),
        F.sqrt(F.col("e.var") * (F.col("n") - 1) / F.col("n")).alias("std"),
    )


def expand_embeddings(
    emb: DataFrame, target: int, seed: int = SEED, key: str = "vec_id"
) -> DataFrame:
    """The given vectors plus gaussian ones with the same mean and spread, up to ``target``.

    A number is drawn from its row's key, its dimension and the seed, so a rerun in other partitions agrees.
    """
    have = emb.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    n = have.count()
    if n >= target:
        return have
    stats = {r["pos"]: (r["mean"], r["std"]) for r in dimension_stats(emb).collect()}
    form = F.array(*[F.struct(F.lit(stats[d][0]).alias("mean"), F.lit(stats[d][1]).alias("std")) for d in sorted(stats)])
    numbers = F.transform(F.sequence(F.lit(0), F.lit(len(stats) - 1)), lambda d: normal(key, d, seed=seed))
    draws = F.zip_with(numbers, form, lambda x, f: x * f["std"] + f["mean"])
    # drawn in one step and normalised in the next, or each use would draw again
    drawn = emb.sparkSession.range(n, target).select(F.col("id").alias(key), draws.alias("_v"))
    made = drawn.select(key, vectors.l2_normalize("_v").alias("embedding"))
    return have.unionByName(made)


def encode_sequences(
    seqs: DataFrame,
    item_emb: DataFrame | None = None,
    encoder: Callable | None = None,
    decay: float = 1.0,
    user: str = "user_idx",
    item: str = "item_idx",
    col: str = "seq",
    extra=(),
) -> DataFrame:
    """One unit vector per padded sequence.

    Built in: the mean of the item vectors, an item ``j`` steps from the end weighing ``decay^j``.
    Otherwise ``encoder`` is a column function such as one made by ``predict_batch_udf``.
    """
    keys = [user, *extra]
    if encoder is not None:
        return seqs.select(*keys, vectors.l2_normalize(encoder(F.col(col))).alias("embedding"))
    items = seqs.select(*keys, arrays.drop_padding(col).alias("_h"))
    exploded = items.select(*keys, F.size("_h").alias("_n"), F.posexplode("_h").alias("_p", item))
    weighted = exploded.withColumn(
        "_w", F.pow(F.lit(float(decay)), (F.col("_n") - 1 - F.col("_p")).cast("double"))
    ).join(item_emb.select(item, "embedding"), item)
    return weighted.groupBy(*keys).agg(
        vectors.l2_normalize(vectors.mean_vector("embedding", "_w")).alias("embedding")
    )


def encode_histories(
    history: DataFrame, item_emb: DataFrame, user: str = "user_idx", item: str = "item_idx"
) -> DataFrame:
    """Unit mean vector of each user's (user, item) rows."""
    return (
        history.select(user, item)
        .join(item_emb.select(item, "embedding"), item)
        .groupBy(user)
        .agg(vectors.l2_normalize(vectors.mean_vector("embedding")).alias("embedding"))
    )


def _factorise(cells: DataFrame, row: str, col: str, value: str, rank: int, seed: int, max_iter: int):
    """Factors of a sparse table, as ``(raw_id, features)`` of its rows and of its columns.

    ALS takes 32-bit ids, so both sides get dense ones for the fit.
    """
    coded, rows = encode_ids(cells, row, out="_row")
    coded, cols = encode_ids(coded, col, out="_col")
    als = ALS(
        rank=rank, maxIter=max_iter, implicitPrefs=True, userCol="_row", itemCol="_col", ratingCol=value,
        seed=seed, checkpointInterval=-1,
    )
    model = als.fit(coded.select(F.col("_row").cast("int"), F.col("_col").cast("int"), F.col(value).cast("float")))
    sides = ((model.userFactors, rows), (model.itemFactors, cols))
    return [decode_ids(f.withColumnRenamed("id", "_code"), m, "_code").select("raw_id", "features") for f, m in sides]


def train_factors(
    inter: DataFrame,
    rank: int = 64,
    seed: int = SEED,
    max_iter: int = 10,
    user: str = "user_idx",
    item: str = "item_idx",
) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback matrix factorisation; unit user and item vectors. Ids may be of any type."""
    pairs = inter.groupBy(user, item).agg(F.count(F.lit(1)).alias("_w"))
    users, items = _factorise(pairs, user, item, "_w", rank, seed, max_iter)

    def unit(factors: DataFrame, key: str) -> DataFrame:
        return factors.select(F.col("raw_id").alias(key), vectors.l2_normalize("features").alias("embedding"))

    return unit(users, user), unit(items, item)


def half_cooccurrence(seqs: DataFrame, window: int = 5, col: str = "seq") -> DataFrame:
    """``item_cooccurrence`` with each pair of items once, the smaller one first."""
    items = arrays.drop_padding(col)

    def at_distance(d: int):
        left = F.slice("_items", F.lit(1), F.greatest(F.size("_items") - d, F.lit(0)))
        return F.arrays_zip(left.alias("a"), F.slice("_items", F.lit(1 + d), F.size(left)).alias("b"))

    near = F.flatten(F.array(*[at_distance(d) for d in range(window + 1)]))
    found = seqs.select(items.alias("_items")).select(F.inline(near))
    turned = F.col("a") > F.col("b")
    smaller, larger = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    return found.groupBy(smaller.alias("a"), larger.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def both_ways(half: DataFrame) -> DataFrame:
    """Each row ``(a, b, ...)`` of different items also as ``(b, a, ...)``; no shuffle."""
    rest = [c for c in half.columns if c not in ("a", "b")]
    own = F.struct("a", "b", *rest)
    other = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *rest)
    return half.select(F.inline(F.when(F.col("a") != F.col("b"), F.array(own, other)).otherwise(F.array(own))))


def item_cooccurrence(seqs: DataFrame, window: int = 5, col: str = "seq") -> DataFrame:
    """``(a, b, n)``: how often two items stand at most ``window`` places apart, both ways; an item
    stands beside itself at every place. Counts are combined in the map tasks."""
    return both_ways(half_cooccurrence(seqs, window, col))


def item_information(pairs: DataFrame, negatives: int = 1) -> DataFrame:
    """``(a, b, value)``: positive pointwise mutual information of different items, less log ``negatives``.

    ``pairs`` has both halves; a value is found for one of them and given both ways.
    """
    apart = pairs.where("a <> b")
    totals = apart.groupBy("a").agg(F.sum("n").alias("_t"))
    whole = totals.agg(F.sum("_t").cast("double").alias("_all"))
    other = totals.select(F.col("a").alias("b"), F.col("_t").alias("_u"))
    # the whole is one row
    info = apart.where("a < b").join(totals, "a").join(other, "b").join(F.broadcast(whole))
    value = F.log(F.col("n") * F.col("_all") / (F.col("_t").cast("double") * F.col("_u"))) - F.log(F.lit(float(negatives)))
    return both_ways(info.select("a", "b", value.alias("value")).where("value > 0"))


def train_item2vec(
    seqs: DataFrame,
    dim: int = 64,
    seed: int = SEED,
    window: int = 5,
    max_iter: int = 4,
    negatives: int = 1,
    col: str = "seq",
    item: str = "item_idx",
    half: DataFrame | None = None,
) -> DataFrame:
    """Unit item vectors from the order of items in padded sequences; ``half`` is their ``half_cooccurrence`` if it is
    written already.

    Skip-gram training with negative sampling factorises the pointwise mutual information of items and
    their neighbours, less the log of the number of negatives; here the positive part of that table is
    counted and its leading singular vectors are found, pairs that never meet counting as zero. Every item
    of the sequences gets a vector; one without such neighbours a random one, as it would keep its start.
    """
    pairs = both_ways(store(half_cooccurrence(seqs, window, col)) if half is None else half)
    factors = symmetric_factors(item_information(pairs, negatives), dim, seed, max_iter)
    every = pairs.select("a").distinct().join(factors, "a", "left")
    placed = F.col("v").isNotNull() & (vectors.norm("v") > 0)
    vector = F.when(placed, F.col("v")).otherwise(signs("a", dim, seed))
    return every.select(F.col("a").alias(item), vector.alias("v")).select(item, vectors.l2_normalize("v").alias("embedding"))


def build_item_embeddings(vectors_df: DataFrame, n_items: int, dim: int) -> DataFrame:
    """A vector for every item of the vocabulary."""
    return fill_missing_embeddings(vectors_df, n_items, dim, key="item_idx")


def build_user_embeddings(
    seqs: DataFrame, item_emb: DataFrame, n_users: int, dim: int, decay: float = 1.0
) -> DataFrame:
    """Encode each user's inference window; users without one get the zero vector."""
    return fill_missing_embeddings(encode_sequences(seqs, item_emb, decay=decay), n_users, dim)
