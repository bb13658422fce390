"""Inverted-file search with plain, product-quantised and scalar-quantised vectors.

Cells are join keys: a query is sent to its ``nprobe`` nearest cells and meets only their items, in
block products that split hot cells. Codes are those of residuals, the difference of a vector to its cell's
centre: in a cell the query is moved by the same centre, so distances stay what they are. Centroids and codebooks are tables of a size set by a
parameter (``nlist``, ``2^nbits``), checked before they are broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..schemas import RETRIEVAL_K, SEED
from ..session import store
from .grid import best_rows, grid_apply, in_slices
from .lloyd import errors, train_centres
from .ordering import top_per_group
from .retrieval import DECIMALS, RESULT, SEARCH_BLOCKS, candidates_by_block, exact_topk, nearest_rows, rank_scored

NPROBE = 8
SWEEP_NPROBES = (1, 5, 10, 20, 50, 100)


def ivf_train(items: DataFrame, nlist: int, seed: int = SEED, max_iter: int = 20) -> DataFrame:
    """k-means cell centres: ``(cell, centroid)``."""
    rows = items.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return items.sparkSession.createDataFrame(centres, "cell int, centroid array<double>")


def _nearest_cells(
    df: DataFrame, centroids: DataFrame, key: str, n: int
) -> DataFrame:
    """``(key, cell, cell_rank)``: the ``n`` nearest cells by L2, ties to the smaller cell."""
    found = exact_topk(
        df.select(F.col(key).alias("query_id"), "embedding"),
        centroids.select(
            F.col("cell").cast("long").alias("item_idx"), F.col("centroid").alias("embedding")
        ),
        n,
        metric="l2",
    )
    return found.select(
        F.col("query_id").alias(key), F.col("item_idx").cast("int").alias("cell"), F.col("rank").alias("cell_rank")
    )


def ivf_assign(items: DataFrame, centroids: DataFrame, key: str = "item_idx") -> DataFrame:
    """Add the nearest ``cell`` to each item."""
    return items.join(_nearest_cells(items, centroids, key, 1).drop("cell_rank"), key)


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    return queries.join(_nearest_cells(queries, centroids, "query_id", nprobe), "query_id")


def ivf_search(
    queries: DataFrame,
    assigned: DataFrame,
    centroids: DataFrame,
    nprobe: int = NPROBE,
    k: int = RETRIEVAL_K,
    metric: str = "l2",
) -> DataFrame:
    """Search the ``nprobe`` nearest cells of each query."""
    probes = probe_cells(queries, centroids, nprobe).select("query_id", "embedding", "cell")
    return rank_scored(candidates_by_block(probes, assigned, k, metric, keys=["cell"]), k, metric)


MAX_CENTRES = 1 << 24  # numbers in the centroids that are broadcast


def to_residuals(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """``embedding`` less the centre of the row's ``cell``."""
    count, width = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    centres = centroids.select("cell", F.col("centroid").alias("_centre"))
    if count * (width or 0) <= MAX_CENTRES:
        centres = F.broadcast(centres)
    moved = F.zip_with(F.col("embedding").cast("array<double>"), "_centre", lambda x, c: x - c)
    return rows.join(centres, "cell").withColumn("embedding", moved).drop("_centre")


def pq_train(items: DataFrame, m: int = 8, nbits: int = 8, seed: int = SEED, max_iter: int = 20) -> DataFrame:
    """Codebooks per sub-space: ``(sub, code, codeword)``; for a search in cells, of residuals.

    All sub-spaces are trained together, in one pass over the vectors for each iteration.
    """
    check_pq(len(items.select("embedding").first()[0]), m)
    found = train_centres(items, m, 1 << nbits, seed, max_iter)
    rows = [(sub, i, c.tolist()) for sub, book in enumerate(found) for i, c in enumerate(book)]
    return items.sparkSession.createDataFrame(rows, "sub int, code int, codeword array<double>")


def check_pq(dim: int, m: int) -> None:
    if dim % m:
        raise ValueError(f"dimension {dim} does not split into {m} sub-vectors")


MAX_CODEWORDS = 1 << 20


def _codebook_matrix(codebooks: DataFrame) -> np.ndarray:
    """(m, codes, width) array; its size is set by the quantiser's parameters and checked."""
    found = codebooks.limit(MAX_CODEWORDS + 1).collect()
    if len(found) > MAX_CODEWORDS:
        raise ValueError("codebooks too large to broadcast")
    m = 1 + max(r["sub"] for r in found)
    codes = 1 + max(r["code"] for r in found)
    books = np.full((m, codes, len(found[0]["codeword"])), np.inf)
    for r in found:
        books[r["sub"], r["code"]] = r["codeword"]
    return books


def pq_error(items: DataFrame, codebooks: DataFrame) -> DataFrame:
    """``(sub, n, error)``: the sum of squared gaps between all sub-vectors and their nearest codewords."""
    books = _codebook_matrix(codebooks)
    return errors(items, [b[np.isfinite(b).all(1)] for b in books])


def ivf_error(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(sub, n, error)``, one row: the sum of squared gaps between all vectors and their nearest centres."""
    found = centroids.limit(MAX_CENTRES).collect()
    return errors(items, [np.array([r["centroid"] for r in found])])


def pq_encode(items: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Replace each vector by ``codes``: the nearest codeword of each sub-space."""
    books = items.sparkSession.sparkContext.broadcast(_codebook_matrix(codebooks))
    schema = items.drop("embedding").schema
    names = schema.names
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", codes array<int>"

    def encode(batches):
        import pyarrow as pa

        from .grid import column_array

        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = column_array(table, "embedding")
            m, _, width = books.value.shape
            codes = np.empty((len(x), m), dtype=np.int32)
            for sub in range(m):
                part = x[:, sub * width : (sub + 1) * width]
                gaps = ((part[:, None, :] - books.value[sub][None, :, :]) ** 2).sum(2)
                codes[:, sub] = np.argmin(np.round(gaps, 9), axis=1)
            flat = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, m, dtype=np.int32), pa.array(codes.ravel()))
            out = table.select(names).append_column("codes", flat)
            yield from out.to_batches()

    return items.select(*names, "embedding").mapInArrow(encode, ddl)


def ivfpq_search(
    queries: DataFrame,
    codes: DataFrame,
    codebooks: DataFrame,
    centroids: DataFrame,
    nprobe: int = NPROBE,
    k: int = RETRIEVAL_K,
) -> DataFrame:
    """IVF search on codes of residuals: distance is a sum of look-ups in a table for each query and cell."""
    books = queries.sparkSession.sparkContext.broadcast(_codebook_matrix(codebooks))

    def kernel(left: dict, right: dict) -> dict:
        x, item_codes = left["embedding"], right["codes"].astype(int)
        m, _, width = books.value.shape
        dist = np.zeros((len(x), len(item_codes)))
        for sub in range(m):
            part = x[:, sub * width : (sub + 1) * width]
            table = ((part[:, None, :] - books.value[sub][None, :, :]) ** 2).sum(2)
            dist += table[:, item_codes[:, sub]]
        rows, cols, best = best_rows(-np.round(dist, DECIMALS), right["item_idx"], np.full(len(x), k))
        return {"query_id": left["query_id"][rows], "item_idx": right["item_idx"][cols], "score": -best}

    probes = to_residuals(probe_cells(queries, centroids, nprobe).select("query_id", "embedding", "cell"), centroids)
    found = grid_apply(probes, codes.select("cell", "item_idx", "codes"), in_slices(kernel), RESULT, keys=["cell"])
    return rank_scored(found, k, "l2")


def sq_ranges(items: DataFrame) -> DataFrame:
    """One row: per-dimension minimum and maximum, as arrays."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    vec = array_to_vector(F.col("embedding").cast("array<double>"))
    stats = items.agg(Summarizer.metrics("min", "max").summary(vec).alias("s"))
    return stats.select(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))


def sq_encode(items: DataFrame, bits: int | str = 8, ranges: DataFrame | None = None) -> DataFrame:
    """Scalar codes per dimension: 8 or 4 bits, or half precision; any other name means 8 bits."""
    bits = bits if bits in (4, 8, "fp16") else 8
    if bits == "fp16":
        return _converted(items, "embedding", "codes", "array<smallint>", _half_bits).withColumn("bits", F.lit("fp16"))
    row = (ranges if ranges is not None else sq_ranges(items)).first()
    top = float((1 << bits) - 1)
    lo, hi = (F.array(*[F.lit(float(x)) for x in row[c]]) for c in ("lo", "hi"))
    unit = F.zip_with(
        F.col("embedding").cast("array<double>"),
        F.arrays_zip(lo.alias("lo"), hi.alias("hi")),
        lambda x, r: F.when(r["hi"] > r["lo"], (x - r["lo"]) / (r["hi"] - r["lo"])).otherwise(0.0),
    )
    codes = F.transform(unit, lambda u: F.floor(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * top + 0.5).cast("int"))
    return items.withColumn("codes", codes).withColumn("bits", F.lit(str(bits)))


def sq_decode(codes: DataFrame, bits: int | str, ranges: DataFrame) -> DataFrame:
    """Vectors back from codes."""
    bits = bits if bits in (4, 8, "fp16") else 8
    if bits == "fp16":
        return _converted(codes, "codes", "embedding", "array<double>", _from_half_bits).drop("bits")
    row = ranges.first()
    top = float((1 << bits) - 1)
    lo, hi = (F.array(*[F.lit(float(x)) for x in row[c]]) for c in ("lo", "hi"))
    back = F.zip_with(
        "codes",
        F.arrays_zip(lo.alias("lo"), hi.alias("hi")),
        lambda c, r: r["lo"] + c.cast("double") / top * (r["hi"] - r["lo"]),
    )
    return codes.withColumn("embedding", back).drop("codes", "bits")


def _half_bits(x: np.ndarray) -> np.ndarray:
    """The sixteen bits of the nearest half-precision numbers."""
    return x.astype(np.float16).view(np.int16)


def _from_half_bits(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int16).view(np.float16).astype(np.float64)


def _converted(df: DataFrame, column: str, name: str, kind: str, convert) -> DataFrame:
    """Replace an array column by another one of the same lengths, a whole Arrow batch at a time."""
    kept = [f for f in df.schema if f.name != column]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"{name} {kind}"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(column)
            flat = pa.array(convert(lists.flatten().to_numpy(zero_copy_only=False)))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), out], [*(f.name for f in kept), name])

    return df.select(*[f.name for f in kept], column).mapInArrow(run, ddl)


def ivfsq_search(
    queries: DataFrame,
    codes: DataFrame,
    ranges: DataFrame,
    centroids: DataFrame,
    nprobe: int = NPROBE,
    k: int = RETRIEVAL_K,
    bits: int | str = 8,
) -> DataFrame:
    """IVF search on decoded scalar codes of residuals (``codes`` carries ``cell``)."""
    probes = to_residuals(probe_cells(queries, centroids, nprobe).select("query_id", "embedding", "cell"), centroids)
    decoded = sq_decode(codes, bits, ranges)
    return rank_scored(candidates_by_block(probes, decoded, k, "l2", keys=["cell"]), k, "l2")


def ann_recall(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """One row: share of the exact top ``k`` found by the approximate search."""
    truth = exact.where(F.col("rank") <= k).select("query_id", "item_idx")
    found = approx.where(F.col("rank") <= k).select("query_id", "item_idx", F.lit(1).alias("_hit"))
    joined = truth.join(found, ["query_id", "item_idx"], "left")
    per_query = joined.groupBy("query_id").agg(F.count("_hit").alias("_hits"))
    return per_query.agg(
        (F.sum("_hits") / (F.count(F.lit(1)) * F.lit(float(k)))).alias("recall")
    )


def ivf_sweep_lists(
    queries: DataFrame,
    assigned: DataFrame,
    centroids: DataFrame,
    nprobes,
    k: int,
    metric: str = "l2",
) -> DataFrame:
    """Top ``k`` for each nprobe from one pass: cells are ranked once, and an item found in the
    query's r-th cell counts for every nprobe of at least r."""
    nprobes = sorted(set(nprobes))
    probes = probe_cells(queries, centroids, nprobes[-1])

    def kernel(left: dict, right: dict) -> dict:
        rows, cols, best = nearest_rows(left["embedding"], right["embedding"], right["item_idx"], k, metric)
        return {
            "query_id": left["query_id"][rows],
            "item_idx": right["item_idx"][cols],
            "score": -best if metric == "l2" else best,
            "cell_rank": left["cell_rank"][rows],
        }

    found = grid_apply(
        probes.select("query_id", "embedding", "cell", "cell_rank"),
        assigned.select("cell", "item_idx", "embedding"),
        kernel,
        RESULT + ", cell_rank int",
        keys=["cell"],
        **SEARCH_BLOCKS,
    )
    tags = F.filter(F.array(*[F.lit(n) for n in nprobes]), lambda n: n >= F.col("cell_rank"))
    spread = found.withColumn("nprobe", F.explode(tags))
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return top_per_group(spread, ["nprobe", "query_id"], [best, F.col("item_idx")], k)


def sweep_recall(lists: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(nprobe, recall)`` of the sweep's lists against exact lists, which are counted and joined: found once."""
    want = store(truth.where(F.col("rank") <= k).select("query_id", "item_idx"))
    total = want.count()
    hits = lists.where(F.col("rank") <= k).join(want, ["query_id", "item_idx"])
    return hits.groupBy("nprobe").agg((F.count(F.lit(1)) / F.lit(float(total))).alias("recall"))


def ann_sweep(
    items: DataFrame,
    queries: DataFrame,
    configs: list[dict],
    nprobes=SWEEP_NPROBES,
    k: int = 10,
    truth: DataFrame | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Recall and time per query for each index config and nprobe.

    A config is ``{"name", "kind": "flat"|"pq"|"sq", "nlist", "m", "nbits", "bits"}``. A PQ config
    whose ``m`` does not divide the dimension is skipped. The returned table has one row per
    (config, nprobe), so building it on the driver is bounded by the caller's own lists.
    """
    import time

    exact = truth if truth is not None else store(exact_topk(queries, items, k, "l2"))
    n_queries = queries.count()
    dim = len(items.select("embedding").first()[0])
    centres: dict[int, DataFrame] = {}
    out = []
    for conf in configs:
        kind, nlist = conf.get("kind", "flat"), int(conf["nlist"])
        if kind == "pq" and dim % int(conf.get("m", 8)):
            continue
        if nlist not in centres:
            centres[nlist] = ivf_train(items, nlist, seed)
        assigned = store(ivf_assign(items, centres[nlist]))
        probes = [n for n in nprobes if n <= nlist]
        own = to_residuals(assigned, centres[nlist])
        if kind == "pq":
            books = pq_train(own, int(conf.get("m", 8)), int(conf.get("nbits", 8)), seed)
            codes = store(pq_encode(own, books))
            runs = {n: ivfpq_search(queries, codes, books, centres[nlist], n, k) for n in probes}
        elif kind == "sq":
            ranges, bits = store(sq_ranges(own)), conf.get("bits", 8)
            codes = store(sq_encode(own, bits, ranges))
            runs = {n: ivfsq_search(queries, codes, ranges, centres[nlist], n, k, bits) for n in probes}
        else:
            runs = {n: ivf_search(queries, assigned, centres[nlist], n, k) for n in probes}
        for n, run in runs.items():
            began = time.perf_counter()
            recall = ann_recall(exact, run, k).first()[0]
            spent = (time.perf_counter() - began) * 1000.0
            out.append((conf["name"], nlist, conf.get("m"), n, spent / max(n_queries, 1), float(recall or 0.0)))
    return items.sparkSession.createDataFrame(
        out, "name string, nlist int, m int, nprobe int, latency_ms double, recall double"
    )
