"""What must not grow with the input: broadcasts of unfolded rows, and what is written, shuffled or held for each row."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteloom.operators import negatives, positions, retrieval
from tasteloom.operators.sequences import next_item_pairs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_collision_mask_broadcasts_neither_side(spark):
    seqs = spark.range(40).select(F.col("id").alias("user_idx"))
    negs = negatives.training_negatives(seqs, 5, 20)
    pairs = seqs.select("user_idx", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos")).withColumn("target", F.col("pos") % 5)
    mask = negatives.collision_mask(pairs, negs)
    assert "BroadcastExchange" not in plan_of(mask)
    drawn = [(r["user_idx"], r["slot"], r["neg_item_idx"]) for r in negs.collect()]
    want = sorted((u, p, s, i) for u, s, i in drawn for p in range(10) if p % 5 == i)
    assert sorted(tuple(r) for r in mask.select("user_idx", "pos", "slot", "neg_item_idx").collect()) == want


def test_unmasked_popularity_gives_every_user_the_same_rows(spark):
    counts = spark.range(50).select(F.col("id").alias("item_idx"), (F.col("id") % 7).alias("cnt"))
    users = spark.createDataFrame([(1,), (2,), (None,)], "query_id long")
    got = retrieval.popularity_topk(counts, 8, users)
    best = sorted(((i % 7, i) for i in range(50)), key=lambda e: (-e[0], e[1]))[:8]
    want = [(u, i, c, r + 1) for u in (1, 2, None) for r, (c, i) in enumerate(best)]
    found = [tuple(r) for r in got.select("query_id", "item_idx", "score", "rank").collect()]
    assert Counter(found) == Counter(want)
    # places of users meet the ranking in no join
    assert "HashJoin" not in plan_of(got) and "SortMergeJoin" not in plan_of(got)


def test_unmasked_popularity_counts_a_user_listed_twice(spark):
    counts = spark.range(50).select(F.col("id").alias("item_idx"), F.lit(1).alias("cnt"))
    got = retrieval.popularity_topk(counts, 5, spark.createDataFrame([(1,), (1,)], "query_id long"))
    assert sorted((r["rank"], r["item_idx"]) for r in got.collect()) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]


def test_masked_popularity_walks_past_the_history(spark):
    counts = spark.range(30).select(F.col("id").alias("item_idx"), (100 - F.col("id")).alias("cnt"))
    users = spark.createDataFrame([(1,), (2,)], "query_id long")
    history = spark.createDataFrame([(1, 0), (1, 2), (2, 29)], "query_id long, item_idx long")
    got = retrieval.popularity_topk(counts, 3, users, history)
    lists = {u: [r["item_idx"] for r in sorted(got.collect(), key=lambda r: r["rank"]) if r["query_id"] == u] for u in (1, 2)}
    assert lists == {1: [1, 3, 4], 2: [0, 1, 2]}


def test_popularity_draws_in_two_steps_are_the_same_draws(spark, monkeypatch):
    counts, n, seen_draws = [60, 1, 1, 1, 3, 1, 9, 1, 1, 1, 1, 1], 6, []
    inner = negatives.past_gaps

    def counted(draws, *rest):
        seen_draws.append(draws.count())
        return inner(draws, *rest)

    monkeypatch.setattr(negatives, "past_gaps", counted)
    table = spark.createDataFrame(list(enumerate(counts)), "item_idx long, cnt long")
    users = spark.range(40).select(F.col("id").alias("user_idx"))
    none = spark.createDataFrame([], "user_idx long, item_idx long")
    lists = {}
    for r in negatives.weighted_unseen(users, none, table, n).orderBy("user_idx", "slot").collect():
        lists.setdefault(r["user_idx"], []).append(r["item_idx"])
    holder = np.repeat(np.arange(len(counts)), counts)
    for u in range(40):
        x = [int(hashlib.md5(f"{u}|{a}|w|42".encode()).hexdigest()[:13], 16) % len(holder) for a in range(1, 4 * n + 1)]
        first = list(dict.fromkeys(int(holder[i]) for i in x))[:n]
        assert lists[u][: len(first)] == first and len(lists[u]) == n
    # all users draw a little more than they want, and only those still short the rest of their four draws an item
    assert seen_draws[0] == 40 * (n + 1 + 4) and seen_draws[1] % (4 * n - n - 5) == 0


def test_mined_positions_keep_their_lists_beside_them(spark):
    rng = np.random.default_rng(5)
    seqs = spark.createDataFrame([(u, [0, *[int(x) + 1 for x in rng.integers(0, 9, 7)]]) for u in range(12)], "user_idx long, seq array<bigint>")
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "item_idx long, embedding array<double>")
    pairs = next_item_pairs(seqs).withColumn("example_id", F.col("user_idx") * 100 + F.col("pos")).drop("history")
    mined = positions.mine_positions(pairs, seqs, items, 9, 4, skip_top=2)
    assert "collect_list" not in plan_of(mined)  # no list is put together again from its rows
    twice = positions.mine_positions(pairs, seqs, items.union(items), 9, 4, skip_top=2)
    assert twice.count() == twice.select("example_id").distinct().count() <= pairs.count()
    # the same draws as from lists that are rows
    encoded = positions.encode_positions(seqs, items)
    queries = pairs.join(encoded, ["user_idx", "pos"]).select(F.col("example_id").alias("query_id"), "embedding")
    want = negatives.hard_negatives_position(pairs, retrieval.exact_topk(queries, items, 5), 9, 2)
    assert sorted(map(tuple, mined.select("example_id", "neg_item_idx").collect())) == sorted(
        map(tuple, want.select("example_id", "neg_item_idx").collect())
    )


def test_items_are_counted_together_in_one_shuffle(spark):
    """the two halves of a pair were summed in a second shuffle of all pairs."""
    from tasteloom.operators import embeddings

    seqs = spark.createDataFrame([(1, [0, 3, 2, 3, 2]), (2, [5, 2, 3, 9, 9])], "user_idx long, seq array<long>")
    met = embeddings.item_cooccurrence(seqs, 2)
    assert plan_of(met).count("Exchange hashpartitioning") == 1
    want = Counter()
    for row in ([2, 1, 2, 1], [4, 1, 2, 8, 8]):
        for i, a in enumerate(row):
            for b in row[i : i + 3]:
                want[a, b] += 1
    for a, b in list(want):
        if a < b or (b, a) not in want:
            if a != b:
                want[a, b] = want[b, a] = want[a, b] + want[b, a]
    assert {(r["a"], r["b"]): r["n"] for r in met.collect()} == dict(want)


def test_factors_of_several_blocks_and_rows_sent_once_a_block(spark, monkeypatch):
    """a product made a row of the columns for every cell."""
    from tasteloom.operators import spectral

    monkeypatch.setattr(spectral, "BLOCK_IDS", 16)
    rng = np.random.default_rng(5)
    base = rng.random((50, 4)) * np.array([8.0, 5.0, 3.0, 2.0])
    table = base @ base.T
    cells = spark.createDataFrame([(i, j, float(table[i, j])) for i in range(50) for j in range(50)], "a long, b long, value double")
    found = np.array([r["v"] for r in spectral.symmetric_factors(cells, 3).orderBy("a").collect()])
    u, s, _ = np.linalg.svd(table)
    np.testing.assert_allclose(found @ found.T, (u[:, :3] * s[:3]) @ u[:, :3].T, atol=1e-6 * s[0])
    half = cells.where("a <= b")
    pieces = spectral._pieces(half, 4)
    assert pieces.count() <= 4 * 10  # lists of cells, at most one a pair of blocks in each of four tasks
    block = half.select("a").distinct().withColumn("v", F.array(F.col("a") + 1.0, F.lit(1.0)))
    made = {r["a"]: r["v"] for r in spectral._product(pieces, block, 4).collect()}
    x = np.stack([np.arange(50) + 1.0, np.ones(50)], axis=1)
    np.testing.assert_allclose(np.array([made[i] for i in range(50)]), table @ x, rtol=1e-12)


def test_pair_scores_of_a_block_are_held_in_slices(spark, monkeypatch):
    """a block of 4096 x 8192 pairs was scored and ranked as one matrix."""
    from tasteloom.operators import grid

    rng = np.random.default_rng(3)
    left = {"query_id": np.arange(300), "embedding": rng.normal(size=(300, 4))}
    right = {"item_idx": np.arange(200), "embedding": rng.normal(size=(200, 4))}
    whole = retrieval._topk_kernel(5, "l2")(left, right)
    shapes, plain = [], retrieval.score_matrix
    monkeypatch.setattr(retrieval, "score_matrix", lambda q, i, m: shapes.append(len(q) * len(i)) or plain(q, i, m))
    monkeypatch.setattr(grid, "PAIRS_AT_ONCE", 10_000, raising=False)
    cut = retrieval._topk_kernel(5, "l2")(left, right)
    assert max(shapes) <= 10_000 and len(cut["query_id"]) == 1500
    for name in whole:
        np.testing.assert_allclose(cut[name], whole[name], atol=1e-9)


def test_few_pairs_of_a_search_are_scored_in_double(spark, monkeypatch):
    """every pair was scored in double, rounded and ranked."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    x[::9] = x[5]  # a common vector
    x[1::500] = x[7] + 1e-9 * rng.normal(size=(12, 16))
    ids, scored, plain = rng.permutation(6000), [], retrieval.score_matrix
    monkeypatch.setattr(retrieval, "score_matrix", lambda q, i, m: scored.append(len(q) * len(i)) or plain(q, i, m))
    for metric, y in (("l2", x), ("ip", x), ("l2", 1e6 * x), ("l2", x + 100.0), ("ip", 1e20 * x), ("l2", np.where(ids[:, None] == 9, np.nan, x))):
        scored.clear()
        left, right = {"query_id": np.arange(300), "embedding": y[1500:1800]}, {"item_idx": ids, "embedding": y}
        got = retrieval._topk_kernel(7, metric)(left, right)
        usual = y is x
        assert not usual or sum(scored) < 300 * 6000 / 4
        rows, cols, best = retrieval.best_rows(plain(left["embedding"], y, metric), ids, np.full(300, 7))
        np.testing.assert_array_equal(got["query_id"], rows)
        if usual:
            np.testing.assert_array_equal(got["item_idx"], ids[cols])
        np.testing.assert_allclose(got["score"], -best if metric == "l2" else best, rtol=1e-9, atol=1e-9 * np.nanmax(np.abs(y)) ** 2)


def test_exact_lists_of_a_sweep_are_found_once(spark):
    """exact lists were made to be counted and again to be joined."""
    from tasteloom.operators import ann

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    truth = spark.createDataFrame([(q, i, i + 1) for q in range(4) for i in range(5)], "query_id long, item_idx long, rank int")
    truth = truth.mapInArrow(counted, truth.schema)
    lists = spark.createDataFrame([(q, i, q + 1, n) for n in (1, 2) for q in range(4) for i in range(n)], "query_id long, item_idx long, rank int, nprobe int")
    got = {r["nprobe"]: r["recall"] for r in ann.sweep_recall(lists, truth, 5).collect()}
    assert got == {1: 4 / 20, 2: 8 / 20} and made.value == 20


def test_blocks_of_items_are_not_cut_for_cores_that_they_keep_busy(spark):
    """queries were cut into a block for each core, and all items travelled to each of them."""
    from tasteloom.operators import grid

    def kernel(left, right):
        return {"n": np.array([len(right["b"])])}

    left, right = (spark.range(3000).select(F.col("id").alias(name)) for name in "ab")
    cut = grid.grid_apply(left, right, kernel, "n long", right_rows=200).agg(F.sum("n")).first()[0]
    assert cut <= 3000 * max(1, -(-spark.sparkContext.defaultParallelism // 15))


def test_searches_ask_for_every_vector(spark, tmp_path):
    """Only vectors whose id is divisible by 50 were queries."""
    from tasteloom.registry import QUERIES

    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(120, 64))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(vecs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("ivf_search", "ivfsq_search", "ivfsq_search_4bit", "ivfsq_search_half", "ivfpq_search"):
        got = Counter(r["query_id"] for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == {i: 10 for i in range(120)}, name
    x = np.float32(vecs).astype(float)
    centres = np.stack([x[i::4].mean(0) for i in range(4)])
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    cells = np.argsort(((x[:, None] - centres[None]) ** 2).sum(2), axis=1)
    best = np.argsort(far, axis=1)[:, :10]

    def recall(n):
        return round(np.mean([cells[i, 0] in cells[q, :n] for q in range(120) for i in best[q]]), 6)

    assert QUERIES["ann_recall"](spark, str(tmp_path)).first()["recall"] == pytest.approx(recall(3), abs=1e-6)
    swept = {r["nprobe"]: r["recall"] for r in QUERIES["ann_sweep_recall"](spark, str(tmp_path)).collect()}
    assert swept == pytest.approx({n: recall(n) for n in (1, 2, 4, 8)}, abs=1e-6)


def test_titles_are_looked_up_once_an_item_of_a_sequence(spark):
    """Every position looked all of its history up again."""
    from tasteloom.operators import prep
    from tasteloom.functions.arrays import last_n

    rows = [(1, [0, 0, 3, 1, 4, 1, 5]), (2, [0, 9, 2, None, 6, 5, 3]), (None, [0, 0, 0, 1, 2, 3, 4]), (4, [0, 0, 0, 0, 0, 8, 8])]
    seqs = spark.createDataFrame(rows, "user_idx long, seq array<long>")
    cat = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (3, None), (4, "d"), (5, "e")], "item_idx long, title string")
    pairs = next_item_pairs(seqs).withColumn("example_id", F.col("user_idx") * 1000 + F.col("pos"))

    def lists(df):
        return Counter((r["user_idx"], r["pos"], r["target"], *r["titles"], *r["valid_ids"]) for r in df.collect())

    assert lists(prep.decode_positions(seqs, cat)) == lists(prep.decode_titles(pairs, "history", cat))
    some = pairs.where(F.size("history") >= 2).withColumn("history", last_n("history", 3))
    assert lists(prep.decode_positions(seqs, cat, 3, 2)) == lists(prep.decode_titles(some, "history", cat))
    assert plan_of(prep.decode_positions(seqs, cat)).count("posexplode") == 2


def test_sliding_windows_send_a_row_at_most_twice(spark):
    """a row was sent to every window it lies in."""
    from tasteloom.operators.sequences import train_sliding_windows

    n = 47
    rows = spark.range(n).select(F.lit(1).alias("user_idx"), F.col("id").alias("item_idx"), F.col("id").alias("t"))
    for min_len, step, max_len in ((3, 2, 5), (0, 1, 1), (2, 9, 4), (50, 3, 4)):
        got = train_sliding_windows(rows, ["t"], max_len, min_len, step).collect()
        want = {}
        for j, end in enumerate(range(min_len, n, step)):
            items = list(range(max(0, end - max_len), end + 1))
            want[j] = [0] * (max_len + 1 - len(items)) + [i + 1 for i in items]
        assert {r["window"]: r["seq"] for r in got} == want and len(got) == len(want)
    plan = train_sliding_windows(rows, ["t"], 5, 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and plan.index("explode(sequence(") < plan.index("Aggregate")  # unfolded after grouping


def test_newest_windows_are_the_last_of_all_windows(spark):
    """all windows of a user were made and sorted to keep one."""
    from tasteloom.operators import sequences

    rows = [(u, (u * 7 + i * 3) % 11, i, ("train", "val", "test")[(u + i) % 3] if u else "train") for u in range(6) for i in range(3 + 4 * u)]
    df = spark.createDataFrame(rows, "user_idx long, item_idx long, t long, split string")
    every = sequences.eval_windows(df, "test", ["t"], 4)
    want = {r["user_idx"]: r["history"] for r in sequences.sequence_lookup(every, ["position"]).collect()}
    got = sequences.without_target(sequences.newest_windows(df, "test", ["t"], 4)).collect()
    assert {r["user_idx"]: r["history"] for r in got} == want and len(got) == len(want) == 5


def test_uniform_draws_shuffle_no_draw_and_long_lists_agree(spark, monkeypatch):
    """every draw was written and shuffled among the gaps of its user."""
    users = spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_idx long")
    rows = [(1, i) for i in range(0, 40, 3)] + [(1, None), (2, 39), (3, 0), (9, 1)]
    seen = spark.createDataFrame(rows, "user_idx long, item_idx long")
    met, inner = [], negatives.past_gaps
    monkeypatch.setattr(negatives, "past_gaps", lambda *a: met.append(1) or inner(*a))
    got = {(r["user_idx"], r["slot"]): r["item_idx"] for r in negatives.uniform_unseen(users, seen, 40, 30).collect()}
    assert not met
    for user, text, gaps in ((1, "1|", [-1, *range(0, 40, 3)]), (2, "2|", [39]), (3, "3|", [0]), (None, "", [])):
        room, places = 40 - len(gaps), []
        k = min(30, room)
        for i in range(1, k + 1):
            r = int(hashlib.md5(f"{text}{i}|42".encode()).hexdigest()[:13], 16) % (room - k + i)
            places.append(room - k + i - 1 if r in places else r)
        want = [r + sum(s - j <= r for j, s in enumerate(gaps)) for r in places]
        assert [got[user, slot] for slot in range(1, k + 1)] == want
    monkeypatch.setattr(negatives, "LISTED_SEEN", 2)
    long = negatives.uniform_unseen(users, seen, 40, 30).collect()
    assert met and {(r["user_idx"], r["slot"]): r["item_idx"] for r in long} == got


def ranker_rows(spark, seed=3):
    rng = np.random.default_rng(seed)
    users = [(u, rng.normal(size=3).tolist()) for u in range(20)]
    items = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    meta = [(i, [float(i % 3 == 0), float(i % 2), 1.0], i % 6) for i in range(30)]
    rows = [
        (u, i, float(rng.random() < 1 / (1 + np.exp(-np.dot(users[u][1], items[i][1])))), 1.0 + i % 4, float(rng.random() < 0.2))
        for u in range(20) for i in rng.integers(0, 30, 25).tolist()
    ]
    return spark.createDataFrame(rows, "user_idx long, item_idx long, label double, weight double, is_unknown double"), (
        spark.createDataFrame(users, "user_idx long, embedding array<double>"),
        spark.createDataFrame(items, "item_idx long, embedding array<double>"),
        spark.createDataFrame(meta, "item_idx long, genre_multihot array<double>, year_bucket int"),
        spark.createDataFrame([(i, float(rng.normal())) for i in range(30)], "item_idx long, z double"),
    )


def test_linear_rankers_fit_without_assembled_features(spark, monkeypatch):
    """Features of all rows were written and fitted as dense rows."""
    from tasteloom.operators import linear, ranker

    rows, inputs = ranker_rows(spark)
    monkeypatch.setattr(linear, "LIST_ROWS", 7)
    monkeypatch.setattr(linear, "BLOCK_ROWS", 5)
    feats = ranker.ranker_features(rows, *inputs)
    wanted = {
        "bce": ranker.train_ranker(feats, max_iter=200, reg=1e-2),
        "bpr": ranker.train_ranker(feats, loss="bpr", max_iter=200, reg=1e-2),
    }
    keys = ["user_idx", "item_idx", "is_unknown"]
    for loss, want in wanted.items():
        made = ranker.fit_ranker(rows, *inputs, loss=loss, max_iter=200, reg=1e-2)
        assert isinstance(made, linear.LinearRanker)
        scores = {tuple(r[k] for k in keys): r["score"] for r in ranker.score_rows(made, rows, *inputs).collect()}
        for model, close in ((made, 1e-12), (want, 5e-3)):
            dense = {tuple(r[k] for k in keys): r["score"] for r in ranker.predict(model, feats).collect()}
            assert scores.keys() == dense.keys() and max(abs(scores[k] - dense[k]) for k in dense) < close


def test_sensitivity_of_a_linear_ranker_exchanges_terms(spark):
    """the raw features of all candidates were written and sorted for each feature."""
    from tasteloom.operators import ranker
    from tasteloom.plans import evaluate

    rows, inputs = ranker_rows(spark)
    model = ranker.fit_ranker(rows, *inputs, max_iter=20)
    pairs = rows.select(F.col("user_idx").alias("query_id"), "user_idx", "item_idx").distinct()
    truth = rows.where("label = 1").select(F.col("user_idx").alias("query_id"), "item_idx").distinct()
    want = evaluate.permutation_importance(model, ranker.ranker_parts(pairs, *inputs), truth, (3, 5)).collect()
    terms = model.terms(pairs, inputs[0], ranker.item_parts(*inputs[1:]))
    assert not [t for _, t in terms.dtypes if t.startswith("array")]
    got = evaluate.permutation_importance(model, terms, truth, (3, 5), features={n: [n] for n in evaluate.SENSITIVITY}).collect()
    found = {r["name"]: r["value"] for r in got}
    assert len(found) == len(want) and all(abs(found[r["name"]] - r["value"]) < 1e-9 for r in want)


def small_tables(spark, folder, users=12, items=8):
    """Events and vectors of a few users and items, as the registered queries read them."""
    rng = np.random.default_rng(8)
    rows = [
        (u * 50 + j, u, "view", float(rng.uniform(0, 60)), '{"k": %d}' % rng.integers(0, items), f"2024-01-01 00:{u:02d}:{j:02d}")
        for u in range(users) for j in range(3 + u)
    ]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    vecs = [(i, rng.normal(size=64).tolist(), i % 3) for i in range(items)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_labelled_events_are_written_once_a_query(spark, tmp_path, monkeypatch):
    """Every use of the labelled events sorted and wrote them again."""
    from tasteloom.registry import QUERIES, common, sequences

    folder, calls, plain = small_tables(spark, tmp_path), [], sequences.splits.split_user_last_k
    monkeypatch.setattr(sequences.splits, "split_user_last_k", lambda *a, **k: calls.append(1) or plain(*a, **k))
    first = sorted(map(tuple, QUERIES["hard_negatives_user"](spark, folder).collect()))
    assert len(calls) == 1 and first
    assert sorted(map(tuple, QUERIES["hard_negatives_user"](spark, folder).collect())) == first
    assert len(calls) == 2 and common._WRITTEN.get() is None  # the next query writes its own
    both = sequences.labelled_events(spark, folder)
    assert both.join(both.select("event_id", "split"), ["event_id", "split"]).count() == both.count()


def test_an_exact_subsample_orders_only_the_rows_at_the_cut(spark, monkeypatch):
    """All rows were sorted by their hash to take a share of them."""
    ordered, plain = [], negatives.with_position
    monkeypatch.setattr(negatives, "with_position", lambda df, *a, **k: ordered.append(df.count()) or plain(df, *a, **k))
    df = spark.range(3000).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"))
    hashes = sorted((hashlib.md5("|".join([*map(str, r), "42"]).encode()).hexdigest(), r) for r in ([x for x in row if x is not None] for row in df.collect()))
    for digits in (4, 1):
        monkeypatch.setattr(negatives, "HEAD_DIGITS", digits)
        for ratio in (0.0, 0.3, 0.777):
            got = negatives.subsample_exact(df, ratio, ["a", "b"]).collect()
            want = [h for h, _ in hashes][: int(3000 * ratio)]
            assert sorted(hashlib.md5("|".join([*(str(x) for x in r if x is not None), "42"]).encode()).hexdigest() for r in got) == want
    assert max(ordered) < 3000 / 4
    assert negatives.subsample_exact(df.limit(0), 0.5, ["a"]).count() == 0


def test_sensitivity_puts_the_rows_in_order_once(spark, monkeypatch):
    """rows were sorted twice and joined for each feature."""
    from tasteloom.operators import ranker
    from tasteloom.plans import evaluate

    rows, inputs = ranker_rows(spark)
    model = ranker.fit_ranker(rows, *inputs, max_iter=5)
    pairs = rows.select(F.col("user_idx").alias("query_id"), "user_idx", "item_idx").distinct()
    truth = rows.where("label = 1").select(F.col("user_idx").alias("query_id"), "item_idx").distinct()
    terms = model.terms(pairs, inputs[0], ranker.item_parts(*inputs[1:]))
    assert "BroadcastHashJoin [item_idx" in plan_of(terms)
    calls, plain = [], ranker.with_position
    monkeypatch.setattr(ranker, "with_position", lambda *a, **k: calls.append(1) or plain(*a, **k))
    names = {n: [n] for n in evaluate.SENSITIVITY}
    got = {r["name"]: r["value"] for r in evaluate.permutation_importance(model, terms, truth, (3, 5), features=names).collect()}
    assert len(calls) == 2
    for name in names:
        mixed = ranker.permute_column(terms, [name], ["query_id", "item_idx"])
        for r in evaluate.permutation_importance(model, mixed, truth, (3, 5), features={}).collect():
            assert abs(got[r["name"].replace("Ranker_", f"Perturb_{name.capitalize()}_")] - r["value"]) < 1e-9


def test_sampled_hit_rate_of_a_group_keeps_its_best_scores(spark):
    """every position met every negative of its user as a row."""
    from tasteloom.operators import metrics

    rng = np.random.default_rng(2)
    pos = [(u, u * 1000 + p, float(rng.integers(0, 9))) for u in range(30) for p in range(u % 5 + 1)]
    pos += [(3, 3001, 4.0), (3, 3001, 1.0), (99, 99000, 0.0), (7, 7000, None)]  # repeated rows, no negatives, no score
    neg = [(u, None if n == 5 else float(rng.integers(0, 9))) for u in range(30) for n in range(u)]
    pdf = spark.createDataFrame(pos, "query_id long, row_id long, score double")
    ndf = spark.createDataFrame(neg, "query_id long, score double")
    for k in (1, 3, 10):
        each = pdf.select("query_id", "row_id").distinct().join(ndf, "query_id")
        want = metrics.sampled_hit_rate(pdf, each, k).first()[0]
        made = metrics.sampled_hit_rate(pdf, ndf, k, group="query_id")
        assert made.first()[0] == pytest.approx(want)


def test_sampled_hit_rate_broadcasts_no_unfolded_rows(spark, tmp_path):
    """negatives unfolded from a row per user were sent to the driver."""
    from tasteloom.registry import QUERIES

    lines = plan_of(QUERIES["sampled_hit_rate"](spark, small_tables(spark, tmp_path))).splitlines()
    depths = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((i for i in range(at + 1, len(lines)) if depths[i] <= depths[at]), len(lines))
            assert not [x for x in lines[at:below] if "explode" in x]


def test_pairs_of_a_hot_user_lie_in_few_blocks(spark, monkeypatch):
    """a row of a user with many rows travelled once for every 512 rows of the other side."""
    from tasteloom.operators import linear, ranker

    rows, inputs = ranker_rows(spark)
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("user_idx"), (F.col("id") % 30).alias("item_idx"), (F.col("id") % 3 == 0).cast("double").alias("label"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("is_unknown"))
    held = linear.held_items(ranker.item_parts(*inputs[1:]))
    blocks = linear.listed_pairs(hot, inputs[0], held).select(F.size("pos").alias("p"), F.size("neg").alias("n")).collect()
    assert sum(b["p"] * b["n"] for b in blocks) == 1000 * 2000
    assert sum(b["p"] + b["n"] for b in blocks) < 2 * 3000
    fitted = ranker.fit_ranker(rows, *inputs, loss="bpr", max_iter=9)
    monkeypatch.setattr(linear, "GAP_ROWS", 3)
    again = ranker.fit_ranker(rows, *inputs, loss="bpr", max_iter=9)
    np.testing.assert_allclose(again.weights, fitted.weights, rtol=1e-6, atol=1e-9)


def test_mining_ships_no_vectors(spark, monkeypatch):
    """the vector of every position was shuffled to its history's task and again to its pair."""
    rng = np.random.default_rng(9)
    seqs = [(u, [0] * (8 - n) + [int(x) + 1 for x in rng.integers(0, 11, n)]) for u, n in enumerate(rng.integers(0, 9, 40).tolist())]
    seqs = spark.createDataFrame([*seqs, (None, [0] * 5 + [1, 2, 3])], "user_idx long, seq array<bigint>")
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "item_idx long, embedding array<double>")
    pairs = next_item_pairs(seqs).drop("history").withColumn("example_id", F.monotonically_increasing_id())
    pairs = pairs.unionByName(spark.createDataFrame([(77, 3, 2, 10**12), (1, 99, 2, 10**12 + 1)], "user_idx long, pos int, target long, example_id long"))
    got = positions.mine_positions(pairs, seqs, items, 9, 4, skip_top=2, decay=0.9)
    assert "embedding" not in plan_of(got)
    want = negatives.hard_negatives_position(
        pairs,
        retrieval.exact_topk(
            pairs.select(F.col("example_id").alias("query_id"), "user_idx", "pos").join(positions.encode_positions(seqs, items, 0.9), ["user_idx", "pos"]).select("query_id", "embedding"),
            items, 5),
        9, 2)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 50
    monkeypatch.setattr(positions, "STEPS_AT_ONCE", 20)
    assert sorted(map(tuple, positions.mine_positions(pairs, seqs, items, 9, 4, skip_top=2, decay=0.9).collect())) == rows


def test_neighbours_ask_every_item_and_count_pairs_once(spark, monkeypatch, sf):
    """every fiftieth item was a query, and pairs of items were counted for every use."""
    from tasteloom.registry import QUERIES, vectors

    asked, plain, counted, half = [], retrieval.exact_topk, [], vectors.embeddings.half_cooccurrence
    monkeypatch.setattr(vectors.retrieval, "exact_topk", lambda q, items, *a, **k: asked.append((q.count(), items.count())) or plain(q, items, *a, **k))
    monkeypatch.setattr(vectors.embeddings, "half_cooccurrence", lambda *a, **k: counted.append(1) or half(*a, **k))
    row = QUERIES["item2vec_neighbours"](spark, sf).first()
    assert asked == [(row["items"], row["items"])] and row["closer"] and len(counted) == 1
