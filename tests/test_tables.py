"""Readers, writers and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tasteloom.operators import ann, embeddings, sequences
from tasteloom.sources import tables, views
from tasteloom.streaming import serve


def test_csv(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.5,100\n2,11,3.0,200\n")
    got = tables.read_ratings(spark, str(tmp_path / "ratings.csv"))
    assert [tuple(r) for r in got.orderBy("userId").collect()] == [(1, 10, 4.5, 100), (2, 11, 3.0, 200)]
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n1,"A, The (1990)",X|Y\n2,B,Z\n1,Again,Q\n')
    first = tables.read_catalogue(spark, str(tmp_path / "movies.csv"))
    last = tables.read_catalogue(spark, str(tmp_path / "movies.csv"), "last")
    assert {r["movieId"]: r["title"] for r in first.collect()} == {1: "A, The (1990)", 2: "B"}
    assert {r["movieId"]: r["title"] for r in last.collect()} == {1: "Again", 2: "B"}


def test_split_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "train"), (1, 3, "val"), (2, 4, "test")], "user_idx long, item_idx long, split string")
    path = str(tmp_path / "split")
    tables.write_split(df, path)
    assert tables.read_split(spark, path, ["val"]).select("item_idx").first()[0] == 3
    with pytest.raises(FileNotFoundError):
        tables.read_split(spark, path, ["none"])
    df.where("split = 'train'").drop("split").write.parquet(str(tmp_path / "train.parquet"))
    assert tables.read_split_dirs(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_split_dirs(spark, str(tmp_path / "nothing"))
    plan = tables.read_columns(spark, path, ["item_idx"])._jdf.queryExecution().toString()
    assert "user_idx" not in plan.split("ReadSchema")[-1]


def test_maps_vectors_sequences(spark, tmp_path):
    ids = spark.createDataFrame([(0, 50), (1, 70)], "idx long, raw_id long")
    tables.write_id_map(ids, str(tmp_path / "map"))
    assert tables.vocab_sizes(tables.read_id_map(spark, str(tmp_path / "map")), ids) == (2, 2)
    emb = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, embedding array<double>")
    tables.write_embeddings(emb, str(tmp_path / "emb"))
    tables.append_embeddings(emb.withColumn("id", F.col("id") + 10), str(tmp_path / "emb"))
    assert tables.read_embeddings(spark, str(tmp_path / "emb")).count() == 20
    seqs = spark.createDataFrame([(1, [0, 1]), (2, [1, 2])], "user_idx long, seq array<long>")
    tables.write_sequences(seqs, str(tmp_path / "seq"))
    assert tables.read_sequences(spark, str(tmp_path / "seq"), 42).count() == 2
    with pytest.raises(Exception):
        tables.read_sequences(spark, str(tmp_path / "absent")).count()
    tables.write_results_csv(seqs.select("user_idx"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_score_cache_file(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"1_20": 0.5, "2_30": -1.0}))
    got = tables.read_score_cache(spark, str(tmp_path / "cache.json")).orderBy("user_idx").collect()
    assert [tuple(r) for r in got] == [(1, 20, 0.5), (2, 30, -1.0)]


def test_expansion(spark, sf):
    emb = views.table(spark, sf, "embeddings")
    big = embeddings.expand_embeddings(emb, 700)
    report = embeddings.embedding_norm_report(big).first()
    assert report["n"] == 700 and report["min_norm"] == pytest.approx(1, abs=1e-5) == report["max_norm"]
    assert embeddings.expand_embeddings(emb, 10).count() == 500


def test_all_cells_probed_is_exact(spark, sf):
    from tasteloom.operators.retrieval import exact_topk

    items = views.item_vectors(spark, sf)
    queries = items.select(F.col("item_idx").alias("query_id"), "embedding")
    cents = ann.ivf_train(items, 5)
    found = ann.ivf_search(queries, ann.ivf_assign(items, cents), cents, 5, 10)
    assert ann.ann_recall(exact_topk(queries, items, 10, "l2"), found, 10).first()["recall"] == 1.0
    with pytest.raises(ValueError):
        ann.pq_train(items, m=7)


def test_histories_over_many_batches(spark, tmp_path, sf):
    """Files arrive one per micro-batch and not in time order; the state ends as the batch result."""
    ev = views.event_interactions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ev = ev.select("user_idx", "item_idx", "ts", "event_id")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev.repartition(4, F.col("event_id") % 4).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    job = (
        serve.user_history_state(stream, 1000)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .foreachBatch(lambda b, n: b.withColumn("batch_id", F.lit(n)).write.mode("append").parquet(out))
        .start()
    )
    job.awaitTermination()
    log = spark.read.parquet(out)
    assert log.select("batch_id").distinct().count() > 1
    got = {r["user_idx"]: r["items"] for r in serve.latest_histories(log).collect()}
    want = {r["user_idx"]: r["items"] for r in sequences.user_histories(ev, "ts", ["event_id"]).collect()}
    assert got == want


def test_equal_requests_within_the_time_limit(spark, tmp_path):
    rows = [(1, 7, 0), (2, 7, 100), (3, 7, 10_000), (4, 8, 10_050), (5, 7, 10_060)]
    schema = "request_id long, user_id long, k int, include_history boolean, explain boolean, ts timestamp"
    src = tmp_path / "in"
    src.mkdir()
    for i, (rid, user, at) in enumerate(rows):  # one file per request, in order of arrival
        path = src / f"{i}.json"
        moment = f"2024-01-01T{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}Z"
        path.write_text(json.dumps({"request_id": rid, "user_id": user, "k": 10, "include_history": False, "explain": False, "ts": moment}))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    job = (
        serve.dedupe_requests(stream)
        .writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
        .start()
    )
    job.awaitTermination()
    kept = {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("request_id").collect()}
    assert {1, 4} <= kept and 2 not in kept and len(kept & {3, 5}) == 1
