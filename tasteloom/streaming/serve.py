"""Structured Streaming forms of serving: de-duplication, look-up, counters and histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.recommend import answer, validate_requests
from ..schemas import MAX_SEQ_LEN

TTL = "300 seconds"
REQUEST_KEY = ["user_id", "k", "include_history", "explain"]


def dedupe_requests(stream: DataFrame, ttl: str = TTL, ts: str = "ts") -> DataFrame:
    """Keep the first of equal requests while the watermark keeps it in state for ``ttl``."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(REQUEST_KEY)


def serve_stream(
    requests: DataFrame,
    user_map: DataFrame,
    lists: DataFrame,
    pop: DataFrame,
    item_map: DataFrame,
    shown: DataFrame | None = None,
    ttl: str | None = TTL,
) -> DataFrame:
    """Answer a request stream from prepared lists (a stream-static join)."""
    ok, _ = validate_requests(requests)
    fresh = dedupe_requests(ok, ttl) if ttl else ok
    return answer(fresh, user_map, lists, pop, item_map, shown)


def windowed_stats(log: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Service counters per closed window of a log stream."""
    served = ~F.col("failed")
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count(F.when(F.col("cache_hit"), 1)).alias("cache_hits"),
            F.count(F.when(served & ~F.col("cache_hit"), 1)).alias("cache_misses"),
            F.count(F.when(F.col("failed"), 1)).alias("errors"),
            F.percentile_approx("latency_ms", F.lit(0.5), F.lit(10_000)).alias("median"),
        )
        .select(F.col("window.start").alias("window_start"), "requests", "cache_hits", "cache_misses", "errors", "median")
    )


def user_history_state(stream: DataFrame, max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """Keep the last ``max_len`` items of each user up to date; update-mode rows ``(user_idx, items)``.

    Input is ``(user_idx, item_idx, ts, event_id)``. State holds only that tail. Each map task first
    trims its own rows to the tail, so a hot user costs a task at most ``max_len`` rows per batch.
    Events older than a full kept tail cannot matter and are ignored.
    """
    rows = stream.select("user_idx", "item_idx", F.unix_micros("ts").alias("at"), "event_id")

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["at", "event_id"]).groupby("user_idx", sort=False).tail(max_len)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, event, item = (list(x) for x in state.get) if state.exists else ([], [], [])
        kept = pd.DataFrame({"at": at, "event_id": event, "item_idx": item})
        for pdf in batches:
            both = pd.concat([kept, pdf[["at", "event_id", "item_idx"]]]) if len(kept) else pdf
            kept = both.sort_values(["at", "event_id"]).tail(max_len)
        at, event, item = ([int(x) for x in kept[c]] for c in ("at", "event_id", "item_idx"))
        state.update((at, event, item))
        yield pd.DataFrame({"user_idx": [key[0]], "items": [item]})

    return (
        rows.mapInPandas(tail, rows.schema)
        .groupBy("user_idx")
        .applyInPandasWithState(
            update,
            outputStructType="user_idx long, items array<long>",
            stateStructType="at array<long>, event_id array<long>, item_idx array<long>",
            outputMode="update",
            timeoutConf=GroupStateTimeout.NoTimeout,
        )
    )


def latest_histories(updates: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The newest state row of each user from a log of update-mode rows."""
    newest = updates.groupBy("user_idx").agg(F.max_by("items", batch).alias("items"))
    return newest
