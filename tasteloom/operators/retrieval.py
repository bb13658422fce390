"""Exact scoring and top-k lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.portable import digest
from ..schemas import RETRIEVAL_K, SEED, TEMPERATURE
from ..session import spread, store
from .grid import best_rows, column_array, grid_apply, in_slices
from .ordering import top_per_group, with_position

DECIMALS = 12  # what sums in another order may differ by is cut off before ranking; outputs may round more
BROADCAST_PLACES = 1_000_000  # the head of a ranking of that many rows is some ten megabytes
RESIDENT_BYTES = 64 << 20  # item vectors of at most this size stay in every task, beside the queries
SEARCH_BLOCKS = {"left_rows": 32_768, "right_rows": 65_536}  # vectors travel once for every block of the other side
FILTER_ROWS, FILTER_COLUMNS = 256, 4096  # pairs that meet in single precision at once
FILTER_START = 1024  # items that give a row its first bound, or more for long lists; fewer are scored in double at once
FILTER_SHARE = 16  # if more than one of so many items pass for a row, it is scored in double against all of them
FILTER_LARGEST = 1e30  # lengths whose products single precision holds


def score_matrix(queries: np.ndarray, items: np.ndarray, metric: str) -> np.ndarray:
    """Scores, larger is better; L2 is negated for ranking."""
    dots = queries @ items.T
    if metric == "ip":
        return np.round(dots, DECIMALS)
    squares = (queries**2).sum(1)[:, None] + (items**2).sum(1)[None, :] - 2 * dots
    return -np.round(np.maximum(squares, 0.0), DECIMALS)


def _in_single(queries: np.ndarray, items: np.ndarray, metric: str):
    """Both sides in single precision, with a column more, so that a row's products rank as its scores, and the most
    by which a row's products may be off. None if numbers are missing or too large for it."""
    width = queries.shape[1]
    squares = (items**2).sum(1)
    offset = -0.5 * squares if metric == "l2" else np.zeros(len(items))
    own, other = np.sqrt((queries**2).sum(1)), np.sqrt(squares.max())
    total = own * other + np.abs(offset).max()  # no sum of the absolute products is larger
    if not np.max([own.max(), other, total.max()]) < FILTER_LARGEST:
        return None
    # every product of a sum is rounded a few times, in proportion to its size or by the smallest number
    kind = np.finfo(np.float32)
    off = (width + 9) * (total * float(kind.eps) + (own + other + 1.0) * float(kind.tiny)) + 10.0**-DECIMALS
    left, right = np.ones((len(queries), width + 1), np.float32), np.empty((len(items), width + 1), np.float32)
    left[:, :width], right[:, :width], right[:, width] = queries, items, offset
    return left, right, off


def nearest_rows(
    queries: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_rows`` of ``score_matrix`` with the best ``k`` of every row, by row, score and id.

    Pairs meet in single precision; only those that its error does not rule out are scored in double and ranked, so
    the result is that of scoring all. Few pairs are held at once, whatever the size of both sides.
    """
    found = []
    enough = k > 0 and len(queries) > 0 and len(items) >= max(FILTER_START, FILTER_SHARE * k)
    single = _in_single(queries, items, metric) if enough else None
    if single is None:

        def kernel(left: dict, right: dict) -> dict:
            rows, cols, best = best_rows(score_matrix(left["x"], right["x"], metric), right["ids"], np.full(len(left["x"]), k))
            return {"rows": left["at"][rows], "cols": cols, "best": best}

        found = in_slices(kernel)({"at": np.arange(len(queries)), "x": queries}, {"x": items, "ids": ids})
        return found["rows"], found["cols"], found["best"]
    left, right, off = single
    squares = (items**2).sum(1)
    room = np.empty(FILTER_ROWS * FILTER_COLUMNS, np.float32), np.empty(FILTER_ROWS * FILTER_COLUMNS, bool)
    for low in range(0, len(queries), FILTER_ROWS):
        part = slice(low, low + FILTER_ROWS)
        rows, cols, best = _nearest_of(queries[part], left[part], off[part], items, right, squares, ids, k, metric, room)
        found.append((rows + low, cols, best))
    return tuple(np.concatenate(column) for column in zip(*found))


def _places(flags: np.ndarray, size: int) -> np.ndarray:
    """Where the first ``size`` flags are set; eight are looked at together, as few are."""
    whole = flags[: -(-size // 8) * 8]
    whole[size:] = False
    words = np.flatnonzero(whole.view(np.uint64))
    at, byte = np.nonzero(whole.reshape(-1, 8)[words])
    return words[at] * 8 + byte


def _nearest_of(x, single, off, items, right, squares, ids, k: int, metric: str, room):
    """``nearest_rows`` of a few queries ``x``."""
    lengths = (x**2).sum(1)
    start = min(len(items), max(FILTER_START, 4 * FILTER_SHARE * k))
    first = single @ right[:start].T
    bound = (np.partition(first, start - k, axis=1)[:, start - k] - 2 * off).astype(np.float32)
    held, waiting, n_waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
    for low in range(0, len(items), FILTER_COLUMNS):
        shape = len(x), min(FILTER_COLUMNS, len(items) - low)
        dots, near = (a[: shape[0] * shape[1]].reshape(shape) for a in room)
        np.matmul(single, right[low : low + shape[1]].T, out=dots)
        np.greater_equal(dots, bound[:, None], out=near)
        rows, cols = np.divmod(_places(room[1], near.size), shape[1])
        many = np.bincount(rows, minlength=len(x)) * FILTER_SHARE > shape[1]
        if many.any():  # they meet many equal vectors
            part, rest = slice(low, low + FILTER_COLUMNS), ~many[rows]
            found = best_rows(score_matrix(x[many], items[part], metric), ids[part], np.full(many.sum(), k))
            waiting.append((np.nonzero(many)[0][found[0]], low + found[1], found[2]))
            rows, cols = rows[rest], cols[rest]
        scores = np.einsum("ij,ij->i", x[rows], items[low + cols])
        if metric == "l2":
            scores = -np.maximum(lengths[rows] + squares[low + cols] - 2 * scores, 0.0)
        waiting.append((rows, low + cols, np.round(scores, DECIMALS)))
        n_waiting += len(rows)
        if n_waiting > 2 * k * len(x) or low + FILTER_COLUMNS >= len(items):
            rows, cols, scores = (np.concatenate(column) for column in zip(held, *waiting))
            order = np.lexsort((ids[cols], -scores, rows))
            starts = np.searchsorted(rows[order], np.arange(len(x) + 1))
            kept = order[np.arange(len(order)) - starts[rows[order]] < k]
            held, waiting, n_waiting = (rows[kept], cols[kept], scores[kept]), [], 0
            full = np.nonzero(np.diff(starts) >= k)[0]
            last = scores[order[starts[full] + k - 1]]
            bound[full] = ((last + lengths[full]) / 2.0 if metric == "l2" else last) - off[full]
    return held


def _topk_kernel(k: int, metric: str, scale: float = 1.0, carry=()):
    def result(left: dict, right: dict, rows: np.ndarray, cols: np.ndarray, best: np.ndarray) -> dict:
        return {
            "query_id": left["query_id"][rows],
            "item_idx": right["item_idx"][cols],
            "score": -best if metric == "l2" else best,
            **{c: left[c][rows] for c in carry},
        }

    def of_all_scores(left: dict, right: dict) -> dict:
        if "bias" in right:
            dots = left["embedding"] @ right["embedding"].T
            scores = np.round(dots * scale + right["bias"][None, :], DECIMALS)
        else:
            scores = score_matrix(left["embedding"] * scale, right["embedding"], metric)
        fetch = left["fetch"] if "fetch" in left else np.full(len(scores), k)
        return result(left, right, *best_rows(scores, right["item_idx"], fetch))

    def kernel(left: dict, right: dict) -> dict:
        if "bias" in right or "fetch" in left:
            return in_slices(of_all_scores)(left, right)
        vectors = left["embedding"] * scale if scale != 1.0 else left["embedding"]
        return result(left, right, *nearest_rows(vectors, right["embedding"], right["item_idx"], k, metric))

    return kernel


RESULT = "query_id long, item_idx long, score double"


def candidates_by_block(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str = "ip",
    keys=(),
    scale: float = 1.0,
    carry=(),
    **blocks,
) -> DataFrame:
    """The best ``k`` (or the query's own ``fetch``) items of every item block, all exact.

    ``carry`` names integer columns of the query to repeat in its result rows.
    """
    left_cols = [*keys, "query_id", "embedding", *carry, *(["fetch"] if "fetch" in queries.columns else [])]
    right_cols = [*keys, "item_idx", "embedding", *[c for c in ("bias",) if c in items.columns]]
    return grid_apply(
        queries.select(*left_cols),
        items.select(*right_cols),
        _topk_kernel(k, metric, scale, carry),
        RESULT + "".join(f", {c} long" for c in carry),
        keys=keys,
        **{**SEARCH_BLOCKS, **blocks},
    )


def rank_scored(scored: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return top_per_group(scored, ["query_id"], [best, F.col("item_idx")], k)


def resident_items(items: DataFrame) -> dict | None:
    """Ids, vectors and biases of all items by rising id, or None if they are beyond ``RESIDENT_BYTES``."""
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n * ((width or 0) + 2) * 8 > RESIDENT_BYTES:
        return None
    columns = ["item_idx", "embedding", *[c for c in ("bias",) if c in items.columns]]
    table = items.select(F.col("item_idx").cast("long").alias("item_idx"), *columns[1:]).toArrow()
    side = {c: column_array(table, c) for c in columns}
    order = np.argsort(side["item_idx"], kind="stable")
    return {c: v[order] for c, v in side.items()}


def resident_topk(
    queries: DataFrame, items: dict, k: int, metric: str = "ip", scale: float = 1.0, seen: str | None = None
) -> DataFrame:
    """``(query_id, item_idx, score, rank)`` with all items in every task: queries stream past them.

    A list is complete where it is made, so neither vectors nor results are shuffled. ``seen`` names a column
    with the ids a query must not get; their scores are masked inside the kernel.
    """

    def rows(part: pa.Table, ids: np.ndarray, r: np.ndarray, c: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
        query = part.column("query_id").combine_chunks().take(pa.array(r))
        score = pa.array(-best if metric == "l2" else best)
        columns = [query, pa.array(ids[c]), score, pa.array(rank, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "item_idx", "score", "rank"])

    columns = [F.col("query_id").cast("long").alias("query_id"), "embedding", *([seen] if seen else [])]
    return _past_items(queries.select(*columns), items, k, metric, scale, seen, rows, RESULT + ", rank int")


def _past_items(queries, items: dict, k: int, metric: str, scale: float, seen: str | None, emit, schema) -> DataFrame:
    """Streams queries past the items; ``emit`` gets rows of queries, ids, and the best as row, place and score by rank."""
    held = queries.sparkSession.sparkContext.broadcast(items)  # at most RESIDENT_BYTES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held.value["item_idx"]
        plain = "bias" not in held.value and seen is None
        rows = FILTER_ROWS * 16 if plain else max(1, 2_000_000 // max(1, len(ids)))
        for batch in batches:
            for low in range(0, batch.num_rows if len(ids) else 0, rows):
                part = pa.Table.from_batches([batch.slice(low, rows)])
                vectors = column_array(part, "embedding")
                if "bias" in held.value:
                    scores = np.round(vectors @ held.value["embedding"].T * scale + held.value["bias"][None, :], DECIMALS)
                else:
                    vectors = vectors * scale if scale != 1.0 else vectors
                    scores = None if plain else score_matrix(vectors, held.value["embedding"], metric)
                if seen is not None:
                    lists = part.column(seen).combine_chunks()
                    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    hidden = lists.flatten().to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(ids, hidden), len(ids) - 1)
                    known = ids[at] == hidden
                    scores[owner[known], at[known]] = -np.inf
                if plain:
                    r, c, best = nearest_rows(vectors, held.value["embedding"], ids, k, metric)
                else:
                    r, c, best = best_rows(scores, ids, np.full(len(scores), k))
                found = np.isfinite(best)
                r, c, best = r[found], c[found], best[found]
                order = np.lexsort((c, -best, r))
                yield emit(part, ids, r[order], c[order], best[order])

    return queries.mapInArrow(search, schema)


def exact_topk(
    queries: DataFrame, items: DataFrame, k: int = RETRIEVAL_K, metric: str = "ip", scale: float = 1.0, **blocks
) -> DataFrame:
    """Brute-force nearest items: ``(query_id, item_idx, score, rank)``; query ids are distinct.

    Items whose vectors fit a task stay there and queries stream past them: nothing is shuffled. A larger
    catalogue is cut into blocks that meet blocks of queries; only the best ``k`` per query and item block are
    ever rows.
    """
    resident = resident_items(items)
    if resident is not None:
        return resident_topk(queries, resident, k, metric, scale)
    return rank_scored(candidates_by_block(queries, items, k, metric, scale=scale, **blocks), k, metric)


def masked_topk(
    queries: DataFrame,
    items: DataFrame,
    history: DataFrame,
    k: int = RETRIEVAL_K,
    scale: float = 1.0,
    owner: str = "query_id",
    **blocks,
) -> DataFrame:
    """Top ``k`` among the items not in the history of the query's ``owner``; query ids are distinct.

    With items that stay in the tasks, a query brings its seen ids along (never more than the catalogue) and they are
    masked before the best ``k`` are taken. Beyond that size a query fetches ``k`` plus the number of its distinct
    history items, which is always enough, and the history is joined to results.
    """
    seen = history.select(owner, "item_idx").distinct()
    resident = resident_items(items)
    if resident is not None:
        known = queries.sparkSession.sparkContext.broadcast(resident["item_idx"])  # a part of the resident items

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(np.isin(batch.column("item_idx").to_numpy(zero_copy_only=False), known.value)))

        listed = seen.select(owner, F.col("item_idx").cast("long").alias("item_idx")).where("item_idx is not null")
        listed = listed.mapInArrow(within, listed.schema).groupBy(owner).agg(F.collect_list("item_idx").alias("_seen"))
        return resident_topk(queries.join(listed, owner, "left"), resident, k, scale=scale, seen="_seen")
    counts = seen.groupBy(owner).agg(F.count(F.lit(1)).alias("_seen"))
    asking = queries.join(counts, owner, "left").withColumn(
        "fetch", F.coalesce("_seen", F.lit(0)) + k
    )
    carry = [owner] if owner != "query_id" else []
    found = candidates_by_block(asking, items, k, scale=scale, carry=carry, **blocks)
    return rank_scored(mask_history(found, seen, owner), k)


def mask_history(scored: DataFrame, history: DataFrame, owner: str = "query_id") -> DataFrame:
    return scored.join(history.select(owner, "item_idx"), [owner, "item_idx"], "left_anti")


def with_logq_bias(items: DataFrame, log_probs: DataFrame) -> DataFrame:
    """Item vectors with ``ln p(item)`` as an additive score bias (see ``scale`` for 1/temperature)."""
    return items.join(log_probs.select("item_idx", F.col("log_prob").alias("bias")), "item_idx")


def score_with_logq(
    scored: DataFrame, log_probs: DataFrame, temperature: float = TEMPERATURE
) -> DataFrame:
    """Popularity-corrected score of scored pairs: evaluation adds the log-probability."""
    joined = scored.join(log_probs.select("item_idx", "log_prob"), "item_idx")
    score = F.round(F.col("score") / temperature + F.col("log_prob"), DECIMALS)
    return joined.withColumn("score", score).drop("log_prob")


def score_pairs(cands: DataFrame, user_emb: DataFrame, item_emb: DataFrame) -> DataFrame:
    """Dot product of the listed (query, item) pairs only."""
    pairs = (
        cands.select("query_id", "item_idx")
        .join(item_emb.select("item_idx", F.col("embedding").alias("_i")), "item_idx")
        .join(user_emb.select("query_id", F.col("embedding").alias("_u")), "query_id")
    )
    return pairs.select(
        "query_id", "item_idx", F.round(vectors.dot("_u", "_i"), DECIMALS).alias("score")
    )


def score_candidates(
    cands: DataFrame, user_emb: DataFrame, item_emb: DataFrame, k: int
) -> DataFrame:
    """The best ``k`` of the listed candidates of each query."""
    return rank_scored(score_pairs(cands, user_emb, item_emb), k)


def popularity_ranking(counts: DataFrame) -> DataFrame:
    """All items by falling count: ``(item_idx, cnt, place)``, places from 1."""
    placed = with_position(counts, [F.col("cnt").desc(), F.col("item_idx")], name="_p")
    return placed.select("item_idx", "cnt", (F.col("_p") + 1).alias("place"))


def popularity_topk(
    counts: DataFrame,
    k: int,
    users: DataFrame | None = None,
    history: DataFrame | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Most popular items: overall, per user without their history, or among candidates.

    Without a history every user gets the same ``k`` rows. With one, a user walks down the ranking ``k`` plus
    history-size places and joins on the place, so users x items are never formed.
    """
    if candidates is not None:
        scored = candidates.join(counts.select("item_idx", F.col("cnt").alias("score")), "item_idx")
        return rank_scored(scored.select("query_id", "item_idx", "score"), k)
    if users is None or history is None:
        by = [F.col("cnt").desc(), F.col("item_idx")]
        best = counts.orderBy(*by).limit(k)  # k rows from here on
        rank = F.row_number().over(Window.orderBy(*by))
        best = best.select("item_idx", F.col("cnt").alias("score"), rank.alias("rank"))
        return best if users is None else _same_for_all(best, users, k)
    ranking = popularity_ranking(counts)
    n_items = counts.count()
    seen = history.select("query_id", "item_idx").distinct()
    sizes = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("_seen"))
    asking = users.select("query_id").join(sizes, "query_id", "left")
    asking = store(asking.withColumn("fetch", F.coalesce("_seen", F.lit(0)) + k))
    deepest = min(n_items, asking.agg(F.max("fetch")).first()[0] or 0)
    places = spread(asking, "query_id").select(
        "query_id",
        F.explode(F.sequence(F.lit(1), F.least("fetch", F.lit(n_items)).cast("int"))).alias("place"),
    ).withColumn("place", F.col("place").cast("long"))
    # the places are many rows a user, which Spark's size estimate does not see: it must not broadcast them
    asked = ranking.where(F.col("place") <= deepest)
    walked = places.join(F.broadcast(asked) if deepest <= BROADCAST_PLACES else asked.hint("merge"), "place")
    walked = mask_history(walked, seen)
    return rank_scored(walked.select("query_id", "item_idx", F.col("cnt").alias("score")), k)


def _same_for_all(best: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The ``k`` ranked rows for every user; each row counts once for every time the user is listed."""
    listed = users.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    first = (F.col("rank") - 1) * F.col("_n") + 1
    rows = listed.crossJoin(F.broadcast(best)).where(first <= k)
    ranks = F.sequence(first.cast("int"), F.least(F.col("rank") * F.col("_n"), F.lit(k)).cast("int"))
    return rows.select("query_id", "item_idx", "score", F.explode(ranks).alias("rank"))


def sample_queries(df: DataFrame, n: int = 1000, seed: int = SEED, key: str = "user_idx") -> DataFrame:
    """At most ``n`` distinct keys, drawn without replacement."""
    keys = df.select(key).distinct()
    return keys.orderBy(digest(key, seed=seed), key).limit(n)
