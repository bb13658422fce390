"""Block products: apply a numpy kernel to every pair of left and right blocks of a group.

Brute-force search, in-batch losses and pairwise losses all look at each (left, right) pair of a
group but keep only a few numbers per left row. The pairs are never rows: both sides are cut into
bounded blocks, every block pair is one grouped task, and the kernel reduces the pairs inside it.
A group of any size becomes many block pairs, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store

LEFT_ROWS = 4096
RIGHT_ROWS = 8192
MAX_BUCKETS = 65_536  # rows of the broadcast block-count table
PAIRS_AT_ONCE = 2_000_000  # pairs of a block whose scores are held together

Kernel = Callable[[dict, dict], dict]


def column_array(table: pa.Table, name: str) -> np.ndarray:
    """A column as numpy; a list column becomes a 2-d float64 matrix."""
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    return col.to_numpy(zero_copy_only=False)


def _side(table: pa.Table, drop: set[str]) -> dict:
    return {n: column_array(table, n) for n in table.column_names if n not in drop}


def _take(side: dict, index: np.ndarray) -> dict:
    return {n: v[index] for n, v in side.items()}


def in_slices(kernel: Kernel) -> Kernel:
    """The kernel over slices of the left block: its pair matrix and the copies of it that ranking makes stay at
    ``PAIRS_AT_ONCE``, whatever the size of the blocks. For kernels that treat each left row by itself."""

    def run(left: dict, right: dict) -> dict:
        n, width = (len(next(iter(side.values()))) for side in (left, right))
        rows = max(1, PAIRS_AT_ONCE // max(1, width))
        if n <= rows:
            return kernel(left, right)
        parts = [kernel(_take(left, np.arange(low, min(n, low + rows))), right) for low in range(0, n, rows)]
        return {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}

    return run


def _segments(codes: np.ndarray) -> dict:
    order = np.argsort(codes, kind="stable")
    values, starts = np.unique(codes[order], return_index=True)
    bounds = np.append(starts, len(codes))
    return {v: order[bounds[i] : bounds[i + 1]] for i, v in enumerate(values)}


def grid_apply(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    schema: str,
    keys: Sequence[str] = (),
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
    split_right: bool = True,
) -> DataFrame:
    """Run ``kernel(left_block, right_block)`` for each block pair with equal ``keys``.

    The kernel gets dicts of numpy arrays and returns a dict with the columns of ``schema``. Left
    rows meet every right row of their group exactly once, spread over the group's block pairs.
    """
    keys = list(keys)
    # Each side is counted and then read: written once, so that what it comes from runs once. This
    # also gives fresh column identities, as both sides often come from one table.
    left, right = store(left), store(right)
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    left = left.withColumn("_group", key)
    right = right.withColumn("_group", key)

    parallel = left.sparkSession.sparkContext.defaultParallelism
    buckets = 1
    if keys:
        blocks = max(left.count() // left_rows, right.count() // right_rows)
        buckets = min(MAX_BUCKETS, max(parallel, blocks))
    bucket = F.pmod(F.col("_group"), F.lit(buckets)).cast("int")
    left = left.withColumn("_bucket", bucket)
    right = right.withColumn("_bucket", bucket)

    # block counts: at most MAX_BUCKETS rows, which bounds the broadcast
    sizes = (
        left.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("nl"))
        .join(right.groupBy("_bucket").agg(F.count(F.lit(1)).alias("nr")), "_bucket")
    )
    wanted = F.ceil(F.col("nl") / F.lit(float(left_rows)))
    cuts = F.ceil(F.col("nr") / F.lit(float(right_rows))) if split_right else F.lit(1).cast("long")
    if buckets == 1:  # a single group: use all cores, but not for tiny blocks
        spare = F.least(F.ceil(F.lit(float(parallel)) / cuts), F.ceil(F.col("nl") / F.lit(256.0)))
        wanted = F.greatest(wanted, spare)
    sizes = F.broadcast(sizes.select("_bucket", wanted.alias("_nl"), cuts.alias("_nr")))

    def block(df: DataFrame, mine: str, other: str, count: str, other_count: str) -> DataFrame:
        row = F.xxhash64(F.lit(7), *[c for c in df.columns if not c.startswith("_")])
        return (
            df.join(sizes, "_bucket")
            .withColumn(mine, F.pmod(row, F.col(count)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(other_count) - 1).cast("int"))))
            .drop("_nl", "_nr")
        )

    cells = ["_bucket", "_lb", "_rb"]
    lefts = block(left, "_lb", "_rb", "_nl", "_nr").groupBy(*cells)
    rights = block(right, "_rb", "_lb", "_nr", "_nl").groupBy(*cells)
    names = [part.strip().split()[0] for part in schema.split(",")]
    hidden = {*cells, "_group"}

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        outputs = []
        if lt.num_rows and rt.num_rows:
            lside, rside = _side(lt, hidden), _side(rt, hidden)
            lcodes, rcodes = column_array(lt, "_group"), column_array(rt, "_group")
            rsegments = _segments(rcodes)
            for code, lindex in _segments(lcodes).items():
                rindex = rsegments.get(code)
                if rindex is not None:
                    outputs.append(kernel(_take(lside, lindex), _take(rside, rindex)))
        if not outputs:
            return arrow_schema.empty_table()
        merged = {n: np.concatenate([o[n] for o in outputs]) for n in names}
        return pa.table({n: pa.array(merged[n]) for n in names}).cast(arrow_schema)

    arrow_schema = _arrow_schema(left, schema)
    return lefts.cogroup(rights).applyInArrow(run, schema=schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    return to_arrow_schema(parsed)


def best_rows(
    scores: np.ndarray, ids: np.ndarray, fetch: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the best ``fetch[row]`` entries, ties to the smaller id.

    Rows are handled by the power of two of their fetch size, so that one row asking for
    everything does not make all rows sort everything.
    """
    rank_by_id = np.argsort(ids, kind="stable")
    scores, width = scores[:, rank_by_id], scores.shape[1]
    fetch = np.minimum(np.asarray(fetch, dtype=np.int64), width)
    rows_out, cols_out = [], []
    classes = np.ceil(np.log2(np.maximum(fetch, 1))).astype(int)
    for cls in np.unique(classes):
        rows = np.nonzero((classes == cls) & (fetch > 0))[0]
        if not len(rows):
            continue
        block = -scores[rows]
        top = int(fetch[rows].max())
        if top < width:
            limit = np.partition(block, top - 1, axis=1)[:, top - 1 : top]
            r, c = np.nonzero(block <= limit)
        else:
            r, c = np.nonzero(np.ones_like(block, dtype=bool))
        order = np.lexsort((c, block[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(rows)))
        keep = (np.arange(len(r)) - first[r]) < fetch[rows][r]
        rows_out.append(rows[r[keep]])
        cols_out.append(c[keep])
    if not rows_out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0)
    rows, cols = np.concatenate(rows_out), np.concatenate(cols_out)
    return rows, rank_by_id[cols], scores[rows, cols]
