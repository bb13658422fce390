"""Item popularity and catalogue features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import year_bucket
from ..schemas import LOG_EPS, STD_EPS

UNKNOWN_GENRE = "Unknown"
NO_GENRES = "(no genres listed)"
MAX_GENRES = 10_000  # the vocabulary becomes a literal array, so it must stay small


def _dense(counts: DataFrame, n_items: int, item: str) -> DataFrame:
    every = counts.sparkSession.range(n_items).select(F.col("id").alias(item))
    return every.join(counts, item, "left").select(item, F.coalesce("cnt", F.lit(0)).alias("cnt"))


def item_counts(train: DataFrame, n_items: int, item: str = "item_idx") -> DataFrame:
    """Rows per item, with zeros for items never seen."""
    return _dense(train.groupBy(item).agg(F.count(F.lit(1)).alias("cnt")), n_items, item)


def probabilities(counts: DataFrame, smooth: bool = True, log: bool = False) -> DataFrame:
    """Add ``prob`` (and ``log_prob``) to one row per item; add-one smoothing if asked."""
    totals = counts.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("m")).first()
    n, m = int(totals["n"] or 0), int(totals["m"])
    if smooth:
        prob = (F.col("cnt") + 1) / F.lit(float(n + m))
    else:
        prob = F.col("cnt") / F.lit(float(n)) if n else F.lit(0.0)
    out = counts.withColumn("prob", prob)
    return out.withColumn("log_prob", F.log(F.col("prob") + LOG_EPS)) if log else out


def item_probabilities(
    train: DataFrame, n_items: int, smooth: bool = True, log: bool = False, item: str = "item_idx"
) -> DataFrame:
    return probabilities(item_counts(train, n_items, item), smooth, log)


def sequence_item_probabilities(
    seqs: DataFrame, n_items: int, smooth: bool = True, log: bool = False, item: str = "item_idx"
) -> DataFrame:
    """Probabilities from the non-padding entries of a sequence table."""
    tokens = seqs.select(F.explode(arrays.drop_padding("seq")).alias(item))
    return item_probabilities(tokens, n_items, smooth, log, item)


def popularity_stats(probs: DataFrame, col: str = "log_prob") -> tuple[float, float]:
    """Mean and sample deviation over all items."""
    row = probs.agg(F.avg(col), F.stddev_samp(col)).first()
    return float(row[0]), float(row[1] or 0.0)


def popularity_zscore(probs: DataFrame, item: str = "item_idx") -> DataFrame:
    """Standardised smoothed log-probability of each item."""
    mean, std = popularity_stats(probs)
    return probs.select(item, ((F.col("log_prob") - mean) / (std + STD_EPS)).alias("z"))


def _genre_array(col: str = "genres"):
    return F.split(F.col(col), r"\|")


def genre_vocabulary(catalogue: DataFrame) -> list[str]:
    """``Unknown`` and then all genres in order."""
    found = (
        catalogue.where(F.col("genres").isNotNull())
        .select(F.explode(_genre_array()).alias("g"))
        .distinct()
        .orderBy("g")
        .limit(MAX_GENRES + 1)
        .collect()
    )
    if len(found) > MAX_GENRES:
        raise ValueError(f"more than {MAX_GENRES} genres: not a vocabulary")
    return [UNKNOWN_GENRE, *[r["g"] for r in found]]


def genre_multihot(catalogue: DataFrame, vocab: list[str], col: str = "genres") -> DataFrame:
    """Add ``genre_multihot``; missing or unlisted genres count as Unknown."""
    text = F.col(col)
    none = text.isNull() | (text == "") | (text == NO_GENRES)
    own = F.when(none, F.array(F.lit(UNKNOWN_GENRE))).otherwise(_genre_array(col))
    vocab_lit = F.array(*[F.lit(g) for g in vocab])
    hot = arrays.map_with(vocab_lit, own, lambda g, mine: F.array_contains(mine, g).cast("double"))
    return catalogue.withColumn("genre_multihot", hot)


def item_metadata(
    item_map: DataFrame, catalogue: DataFrame, vocab: list[str], item: str = "item_idx"
) -> DataFrame:
    """Genres and year bucket for every id of the map, catalogue entry or not."""
    ids = item_map.select(F.col("idx").alias(item), F.col("raw_id").alias("_raw"))
    rows = ids.join(
        catalogue.select(F.col("item_id").alias("_raw"), "title", "genres"), "_raw", "left"
    )
    return genre_multihot(rows, vocab).select(
        item, "title", "genres", "genre_multihot", year_bucket("title").alias("year_bucket")
    )


def genre_mean_pool(items: DataFrame, genre_vectors: DataFrame, item: str = "item_idx") -> DataFrame:
    """Mean of the vectors of an item's genres."""
    parts = items.select(item, F.explode(_genre_array()).alias("genre")).join(genre_vectors, "genre")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return parts.groupBy(item).agg(vector_to_array(mean).alias("genre_embedding"))
