"""Queries over request tables and streams."""

import uuid

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import splits
from ..plans import recommend as rec
from ..session import scratch_dir
from ..sources import views
from ..streaming import serve
from .common import query, view
from .features import rounded
from .ranking import event_z
from .sequences import labelled_events

# Every event is a request of its user: ids shifted so that some users are unknown, k from the item.
view(
    "v_request",
    """select event_id request_id, user_idx + 1000 + case when event_id % 10 = 0 then 100000 else 0 end user_id,
         (item_idx % 25)::int k, event_id % 3 = 0 explain, event_id % 4 = 0 include_history from v_ev""",
)
view("v_okrequest", "select * from v_request where k between 1 and 100")
view("v_usermap", "select distinct user_idx idx, user_idx + 1000 raw_id from v_evlab")


def requests(spark, sf):
    ev = views.event_interactions(spark, sf)
    unknown = F.when(F.col("event_id") % 10 == 0, 100000).otherwise(0)
    return ev.select(
        F.col("event_id").alias("request_id"),
        (F.col("user_idx") + 1000 + unknown).alias("user_id"),
        (F.col("item_idx") % 25).cast("int").alias("k"),
        (F.col("event_id") % 3 == 0).alias("explain"),
        (F.col("event_id") % 4 == 0).alias("include_history"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def user_map(spark, sf):
    ev = views.event_interactions(spark, sf)
    return ev.select(F.col("user_idx").alias("idx"), (F.col("user_idx") + 1000).alias("raw_id")).distinct()


def item_map(spark, sf):
    items = views.item_vectors(spark, sf)
    return items.select(F.col("item_idx").alias("idx"), (F.col("item_idx") + 5000).alias("raw_id"))


def train_history(spark, sf):
    return splits.take_split(labelled_events(spark, sf), "train", "val")


@query("validate_requests", "select request_id, k, k between 1 and 100 ok from v_request")
def validate_requests(spark, sf):
    ok, rejected = rec.validate_requests(requests(spark, sf))
    both = ok.withColumn("ok", F.lit(True)).unionByName(rejected.withColumn("ok", F.lit(False)))
    return both.select("request_id", "k", "ok")


view(
    "v_fallback",
    """select list({'id': item_idx + 5000, 's': round(1 / (1 + exp(-z)), 6)} order by z desc, item_idx) l from (
         select item_idx, z from v_evz order by z desc, item_idx limit 100)""",
)
# 100 nearest of the mean vector of the last 200 items, watched items removed afterwards
view(
    "v_servevec",
    """select user_idx, list(m / n order by pos) embedding from (
         select *, sqrt(sum(m * m) over (partition by user_idx)) n from (
           select user_idx, pos, avg(x) m from (
             select user_idx, unnest(embedding) x, generate_subscripts(embedding, 1) pos from (
               select *, row_number() over (partition by user_idx order by ts desc, event_id desc) r
               from v_evlab where split <> 'test') join v_items using (item_idx) where r <= 200) group by 1, 2)) group by 1""",
)
view(
    "v_servelist",
    """select user_idx, coalesce(list({'id': item_idx + 5000, 's': s} order by s desc, item_idx) filter (fresh), []) l from (
         select t.user_idx, t.item_idx, s, h.item_idx is null fresh from (
           select *, row_number() over (partition by user_idx order by s desc, item_idx) r from (
             select user_idx, item_idx, round(list_dot_product(u.embedding, i.embedding), 12) s from v_servevec u, v_items i)) t
         left join v_seen h on h.user_idx = t.user_idx and h.item_idx = t.item_idx where r <= 100) group by 1""",
)
view(
    "v_shown",
    """select user_idx, list(item_idx + 5000 order by ts, event_id) h from (
         select *, row_number() over (partition by user_idx order by ts desc, event_id desc) r
         from v_evlab where split <> 'test') where r <= 20 group by 1""",
)
view(
    "v_answer",
    """select request_id, case when idx is null then 'Popularity fallback (User Unknown)'
           when s.l is null then 'Popularity fallback (No History)'
           when len(s.l) = 0 then 'Popularity fallback (No Candidates)' end reason,
         case when idx is null or s.l is null or len(s.l) = 0 then f.l[1:k] else s.l[1:k] end a,
         case when include_history then case when s.l is null or len(s.l) = 0 then [] else coalesce(h, []) end end hist,
         explain
       from v_okrequest left join v_usermap on raw_id = user_id left join v_servelist s on s.user_idx = idx
       left join v_shown w on w.user_idx = idx, v_fallback f""",
)
ANSWER = """select request_id, reason fallback_reason, array_to_string(list_transform(a, lambda e: e.id), ',') movie_ids,
    round(list_sum(list_transform(a, lambda e: e.s)), 6) score_sum, array_to_string(hist, ',') history,
    case when explain then repeat(coalesce(reason, 'Explanation not implemented') || ';', len(a)) else '' end explanations
    from v_answer"""


def as_text(df):
    score_sum = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    explanations = F.array_join(F.transform("explanations", lambda e: F.concat(e, F.lit(";"))), "")
    return df.select(
        "request_id",
        "fallback_reason",
        arrays.joined("movie_ids").alias("movie_ids"),
        F.round(score_sum, 6).alias("score_sum"),
        arrays.joined("history").alias("history"),
        explanations.alias("explanations"),
    )


def served(spark, sf):
    return rec.recommend(
        requests(spark, sf),
        user_map(spark, sf),
        item_map(spark, sf),
        train_history(spark, sf),
        views.EVENT_ORDER,
        views.item_vectors(spark, sf),
        event_z(spark, sf),
    )


@query("recommend", ANSWER)
def recommend(spark, sf):
    return as_text(served(spark, sf))


@query("recommend_with_ranker")
def recommend_with_ranker(spark, sf):
    from .ranking import event_meta, trained

    model, _ = trained(spark, sf)
    return rec.recommend(
        requests(spark, sf), user_map(spark, sf), item_map(spark, sf), train_history(spark, sf),
        views.EVENT_ORDER, views.item_vectors(spark, sf), event_z(spark, sf),
        model, event_meta(spark, sf),
    )


@query(
    "precompute_topk",
    "select user_idx, array_to_string(list_transform(l, lambda e: e.id), ',') ids from v_servelist",
)
def precompute_topk(spark, sf):
    history = train_history(spark, sf)
    lists = rec.precompute_topk(
        history, history, views.EVENT_ORDER, views.item_vectors(spark, sf), item_map(spark, sf)
    )
    ids = F.transform("items", lambda e: e["movie_id"])
    return lists.select("user_idx", arrays.joined(ids).alias("ids"))


@query(
    "popularity_fallback",
    """select request_id, array_to_string(list_transform(l[1:k], lambda e: e.id), ',') movie_ids,
         'Popularity fallback (No History)' fallback_reason from v_okrequest, v_fallback""",
)
def popularity_fallback(spark, sf):
    ok, _ = rec.validate_requests(requests(spark, sf))
    out = rec.popularity_fallback(ok, event_z(spark, sf), item_map(spark, sf), "history")
    return out.select("request_id", arrays.joined("movie_ids").alias("movie_ids"), "fallback_reason")


@query(
    "attach_history",
    "select idx user_idx, array_to_string(coalesce(h, []), ',') history from v_usermap left join v_shown on user_idx = idx",
)
def attach_history(spark, sf):
    users = user_map(spark, sf).select(F.col("idx").alias("user_idx"))
    out = rec.attach_history(users, train_history(spark, sf), views.EVENT_ORDER, item_map(spark, sf))
    return out.select("user_idx", arrays.joined("history").alias("history"))


@query(
    "recommendation_cards",
    """select request_id, i as rank, a[i].id movie_id, coalesce(title, 'Unknown Title') title,
         coalesce(genres, 'Unknown') genres, a[i].s score
       from (select *, unnest(range(1, len(a) + 1))::int i from v_answer) left join v_cat on item_idx + 5000 = a[i].id""",
)
def recommendation_cards(spark, sf):
    return rec.recommendation_cards(served(spark, sf), views.catalogue(spark, sf), item_map(spark, sf))


STATS = """count(*) requests, count(case when event_type = 'view' then 1 end) cache_hits,
    count(case when event_type not in ('view', 'error') then 1 end) cache_misses,
    count(case when event_type = 'error' then 1 end) errors"""


@query("service_stats", f"select {STATS} from events")
def service_stats(spark, sf):
    return rec.service_stats(views.request_log(spark, sf))


@query("service_stats_windowed", f"select time_bucket(interval 1 hour, ts) window_start, {STATS} from events group by 1")
def service_stats_windowed(spark, sf):
    stats = rec.service_stats(views.request_log(spark, sf), "1 hour")
    return stats.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "latency_summary",
    """select event_type component, count(*) requests,
         round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double), 6) per_second,
         round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99
       from events group by 1""",
)
def latency_summary(spark, sf):
    out = rec.latency_summary(views.request_log(spark, sf), "component")
    return rounded(out, "per_second", "median", "p95", "p99")


# --- streams, run to completion over the event table


def event_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def drain(spark, stream, mode="append"):
    """Run a stream over what is there; every micro-batch goes to a table with its number."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, number):
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch_id={number}")

    job = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    job.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query(
    "user_history_state",
    """select user_idx, string_agg(item_idx::varchar, ',' order by ts, event_id) items from (
         select *, row_number() over (partition by user_idx order by ts desc, event_id desc) r from v_ev)
       where r <= 50 group by 1""",
)
def user_history_state(spark, sf):
    """State after the whole stream; its batch twin is the SQL."""
    ev = event_stream(spark, sf).select(
        F.col("user_id").alias("user_idx"),
        F.get_json_object("props", "$.k").cast("long").alias("item_idx"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
    log = drain(spark, serve.user_history_state(ev, 50), "update")
    return serve.latest_histories(log).select("user_idx", arrays.joined("items").alias("items"))


def request_stream(spark, sf):
    item = F.get_json_object("props", "$.k").cast("long")
    unknown = F.when(F.col("event_id") % 10 == 0, 100000).otherwise(0)
    return event_stream(spark, sf).select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") + 1000 + unknown).alias("user_id"),
        (item % 25).cast("int").alias("k"),
        (F.col("event_id") % 3 == 0).alias("explain"),
        (F.col("event_id") % 4 == 0).alias("include_history"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("dedupe_requests")
def dedupe_requests(spark, sf):
    return drain(spark, serve.dedupe_requests(request_stream(spark, sf)))


@query("serve_stream", ANSWER)
def serve_stream(spark, sf):
    """All requests of the stream (no de-duplication) answered from prepared lists."""
    from ..session import store

    history = train_history(spark, sf)
    lists = store(
        rec.precompute_topk(history, history, views.EVENT_ORDER, views.item_vectors(spark, sf), item_map(spark, sf))
    )
    users = user_map(spark, sf).select(F.col("idx").alias("user_idx"))
    shown = store(rec.attach_history(users, history, views.EVENT_ORDER, item_map(spark, sf)))
    answers = serve.serve_stream(
        request_stream(spark, sf), store(user_map(spark, sf)), lists, event_z(spark, sf), item_map(spark, sf), shown, ttl=None
    )
    return as_text(drain(spark, answers))


@query("windowed_stats")
def windowed_stats(spark, sf):
    log = event_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "view").alias("cache_hit"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("latency_ms"),
    )
    return drain(spark, serve.windowed_stats(log, "1 hour"))
