"""The paths for hot keys give the same answers as brute force: one key holds most rows, exact
copies are many, and blocks and bounds are set so small that everything is split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteloom.operators import ann, losses, negatives, ordering, pairwise, prep, ranker, retrieval, sequences, splits
from tasteloom.operators.grid import best_rows, grid_apply
from tasteloom.plans import recommend as rec


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(1, rng.randrange(40), rng.randrange(60), float(rng.randrange(6))) for _ in range(400)]
    out += [(1, 7, 30, 5.0)] * 150  # copies
    out += [(rng.randrange(2, 30), rng.randrange(40), rng.randrange(60), float(rng.randrange(6))) for _ in range(450)]
    return out


@pytest.fixture(scope="module")
def hot(spark, rows):
    df = spark.createDataFrame(rows, "user_idx long, item_idx long, timestamp long, rating double")
    return df.repartition(6).cache()


ORDER = ["timestamp", "item_idx", "rating"]


def by_user(rows):
    users = {}
    for u, i, t, r in sorted(rows, key=lambda x: (x[0], x[2], x[1], x[3])):
        users.setdefault(u, []).append(i)
    return users


@pytest.mark.parametrize("bound", [0, 10**9])
def test_positions(hot, rows, bound):
    got = ordering.with_position(hot, ORDER, ["user_idx"], group_bound=bound).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r["user_idx"], []).append((r["pos"], r["timestamp"], r["item_idx"], r["rating"]))
    for u, items in seen.items():
        items.sort()
        assert [p for p, *_ in items] == list(range(len(items)))
        assert [x[1:] for x in items] == sorted(x[1:] for x in items)


def test_global_positions(hot, rows):
    got = sorted(ordering.with_position(hot, ORDER).select("pos", "timestamp").collect())
    assert [r["pos"] for r in got] == list(range(len(rows)))
    assert [r["timestamp"] for r in got] == sorted(r[2] for r in rows)


@pytest.mark.parametrize("bound", [0, 10**9])
def test_running_total(hot, rows, bound):
    got = ordering.running_total(hot.withColumn("v", F.col("item_idx") + 1), "v", ORDER, ["user_idx"], group_bound=bound)
    total = {u: sum(i + 1 for i in items) for u, items in by_user(rows).items()}
    last = {r["user_idx"]: r["m"] for r in got.groupBy("user_idx").agg(F.max(F.col("before") + F.col("v")).alias("m")).collect()}
    assert last == total


@pytest.mark.parametrize("bound", [0, 10**9])
def test_histories_in_pieces(hot, rows, bound):
    got = sequences.user_histories(hot, tie=["item_idx", "rating"], chunk=50, group_bound=bound).orderBy("user_idx", "chunk").collect()
    whole = {}
    for r in got:
        assert len(r["items"]) <= 50
        whole.setdefault(r["user_idx"], []).extend(r["items"])
    assert whole == by_user(rows)


@pytest.mark.parametrize("bound", [0, 10**9])
def test_split_with_copies(hot, rows, bound):
    got = splits.split_user_last_k(hot, 2, 3, tie=["item_idx", "rating"], group_bound=bound)
    counts = {(r["user_idx"], r["split"]): r["count"] for r in got.groupBy("user_idx", "split").count().collect()}
    for u, items in by_user(rows).items():
        assert counts[(u, "test")] == min(3, len(items))
        assert counts.get((u, "val"), 0) == min(2, max(0, len(items) - 3))
        assert counts.get((u, "train"), 0) == max(0, len(items) - 5)


@pytest.mark.parametrize("bound", [0, 10**9])
def test_windows(hot, rows, bound):
    got = sequences.train_sliding_windows(hot, ORDER, max_len=9, min_len=2, step=4, group_bound=bound).collect()
    want = set()
    for u, items in by_user(rows).items():
        for j, i in enumerate(range(2, len(items), 4)):
            seq = [x + 1 for x in items[max(0, i + 1 - 10) : i + 1]]
            want.add((u, j, tuple([0] * (10 - len(seq)) + seq)))
    assert {(r["user_idx"], r["window"], tuple(r["seq"])) for r in got} == want


@pytest.mark.parametrize("bound", [0, 10**9])
def test_eval_windows(spark, rows, bound):
    """Unique times, a third of the rows in test, one user with most of them."""
    unique = [(u, i, n, ("train", "val", "test")[n % 3]) for n, (u, i, _, _) in enumerate(rows)]
    df = spark.createDataFrame(unique, "user_idx long, item_idx long, timestamp long, split string")
    got = sequences.eval_windows(df, "test", ["timestamp"], max_len=6, group_bound=bound).collect()
    want = []
    for u in {r[0] for r in unique}:
        hist = [r[1] + 1 for s in ("train", "val") for r in unique if r[0] == u and r[3] == s]
        for r in unique:
            if r[0] == u and r[3] == "test":
                hist.append(r[1] + 1)
                seq = hist[-7:]
                want.append((u, tuple([0] * (7 - len(seq)) + seq)))
    assert sorted((r["user_idx"], tuple(r["seq"])) for r in got) == sorted(want)


def test_kcore(hot, rows):
    import pandas as pd

    x = pd.DataFrame(rows, columns=["u", "i", "t", "r"])
    for _ in range(50):
        x = x[x.groupby("u").u.transform("size") >= 14]
        x = x[x.groupby("i").i.transform("size") >= 14]
    got = prep.kcore(hot, 14, "user_idx", "item_idx").select("user_idx", "item_idx").collect()
    assert sorted(map(tuple, got)) == sorted(zip(x.u, x.i)) and len(x)


def vectors_df(spark, n, name, seed, dim=8):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("blocks", [None, {}, {"left_rows": 7, "right_rows": 11}])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_search_in_blocks(spark, blocks, metric, monkeypatch):
    if blocks is not None:  # items beyond what may stay in a task
        monkeypatch.setattr(retrieval, "RESIDENT_BYTES", 0)
    blocks = blocks or {}
    q, qdf = vectors_df(spark, 40, "query_id", 1)
    x, xdf = vectors_df(spark, 90, "item_idx", 2)
    got = retrieval.exact_topk(qdf, xdf, 9, metric, **blocks).orderBy("query_id", "rank").collect()
    score = -(q @ x.T) if metric == "ip" else ((q[:, None] - x[None]) ** 2).sum(2)
    want = [np.lexsort((np.arange(90), np.round(s, 6)))[:9].tolist() for s in score]
    assert [[r["item_idx"] for r in got if r["query_id"] == i] for i in range(40)] == want


def test_close_scores_are_told_apart_and_equal_ones_go_by_id(spark, monkeypatch):
    near = [(0, [1.0, 0.0]), (1, [1.0 + 1e-9, 0.0]), (2, [1.0, 0.0]), (3, [1.0 - 1e-9, 0.0])]
    items = spark.createDataFrame(near, "item_idx long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 5.0])], "query_id long, embedding array<double>")
    for bound in (retrieval.RESIDENT_BYTES, 0):
        monkeypatch.setattr(retrieval, "RESIDENT_BYTES", bound)
        got = retrieval.exact_topk(queries, items, 4).orderBy("rank").collect()
        assert [(r["item_idx"], r["rank"]) for r in got] == [(1, 1), (0, 2), (2, 3), (3, 4)]


def test_search_without_a_shuffle_of_vectors(spark):
    _, qdf = vectors_df(spark, 40, "query_id", 1)
    _, xdf = vectors_df(spark, 90, "item_idx", 2)
    plan = retrieval.exact_topk(qdf, xdf, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_search_with_nothing_to_find(spark):
    _, qdf = vectors_df(spark, 3, "query_id", 1)
    _, xdf = vectors_df(spark, 4, "item_idx", 2)
    hist = spark.createDataFrame([(0, i) for i in range(9)] + [(1, None), (None, 2)], "query_id long, item_idx long")
    assert retrieval.exact_topk(qdf, xdf.limit(0), 2).count() == 0
    found = retrieval.masked_topk(qdf, xdf, hist, 4).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {1: 4, 2: 4}


@pytest.mark.parametrize("resident", [True, False])
def test_masked_search_with_one_who_saw_nearly_all(spark, resident, monkeypatch):
    if not resident:
        monkeypatch.setattr(retrieval, "RESIDENT_BYTES", 0)
    q, qdf = vectors_df(spark, 5, "query_id", 1)
    x, xdf = vectors_df(spark, 60, "item_idx", 2)
    seen = [(0, i) for i in range(57)] + [(1, 3)]
    hist = spark.createDataFrame(seen, "query_id long, item_idx long")
    got = retrieval.masked_topk(qdf, xdf, hist, 4, left_rows=2, right_rows=16).orderBy("query_id", "rank").collect()
    for u in range(5):
        free = [i for i in range(60) if (u, i) not in seen]
        want = sorted(free, key=lambda i: (-round(float(q[u] @ x[i]), 6), i))[:4]
        assert [r["item_idx"] for r in got if r["query_id"] == u] == want


def test_best_rows_with_ties_and_own_fetch():
    scores = np.array([[1.0, 2.0, 2.0, 0.0], [0.0, 0.0, 0.0, 0.0]])
    rows, cols, best = best_rows(scores, np.array([9, 8, 7, 6]), np.array([2, 3]))
    assert list(zip(rows, cols)) == [(0, 2), (0, 1), (1, 3), (1, 2), (1, 1)]


def test_pairs_meet_once_in_a_split_hot_group(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(100)], "g long, a long")
    right = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(80)], "g long, b long")

    def kernel(lt, rt):
        a, b = np.meshgrid(lt["a"], rt["b"], indexing="ij")
        return {"a": a.ravel(), "b": b.ravel()}

    got = grid_apply(left, right, kernel, "a long, b long", keys=["g"], left_rows=5, right_rows=6).collect()
    want = left.join(right, "g").select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pairwise_loss_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(losses, "grid_apply", lambda *a, **k: grid_apply(*a, **k, left_rows=9, right_rows=10))
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=120), rng.integers(0, 2, 120), rng.random(120)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, y, w)], "logit double, label int, w double")
    terms = np.logaddexp(0, -(x[y == 1][:, None] - x[y == 0][None])) * w[y == 1][:, None]
    assert losses.bpr_loss(df, weight="w").first()["loss"] == pytest.approx(terms.mean())


@pytest.mark.parametrize("decoupled", [False, True])
def test_contrastive_loss_in_blocks(spark, monkeypatch, decoupled):
    monkeypatch.setattr(losses, "grid_apply", lambda *a, **k: grid_apply(*a, **k, left_rows=8, right_rows=6))
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(50, 4)), rng.normal(size=(50, 4))
    df = spark.createDataFrame([(0, i, u[i].tolist(), v[i].tolist()) for i in range(50)], "batch long, row_id long, user_vec array<double>, item_vec array<double>")
    s = u @ v.T
    off = np.where(np.eye(50, dtype=bool), -1e9, s) if decoupled else s
    want = (np.log(np.exp(off - s.max()).sum(1)) + s.max() - np.diag(s)).mean()
    fn = losses.dcl_loss if decoupled else losses.info_nce_loss
    assert fn(df, temperature=1.0).first()["loss"] == pytest.approx(want)


def test_unseen_draws(spark):
    """One user has seen all items but two, another everything; a third nothing."""
    n = 50
    seen = [(1, i) for i in range(n) if i not in (7, 31)] + [(2, i) for i in range(n)]
    sdf = spark.createDataFrame(seen, "user_idx long, item_idx long")
    inter = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000, 2), (1001, 3)], "example_id long, user_idx long")
    got = negatives.random_negatives_user(inter, sdf, n, 2).collect()
    mine = [r for r in got if r["user_idx"] == 1]
    assert len(mine) == 300 and {r["neg_item_idx_1"] for r in mine} | {r["neg_item_idx_2"] for r in mine} == {7, 31}
    assert [r for r in got if r["user_idx"] == 2] == []
    assert all(0 <= r["neg_item_idx_2"] < n for r in got if r["user_idx"] == 3)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_idx long")
    drawn = negatives.uniform_unseen(users, sdf, n, 5).collect()
    assert sorted(r["item_idx"] for r in drawn if r["user_idx"] == 1) == [7, 31]
    third = [r["item_idx"] for r in drawn if r["user_idx"] == 3]
    assert len(third) == len(set(third)) == 5


@pytest.mark.parametrize("n_items", [4, 12, 60])
def test_uniform_unseen_is_uniform_for_any_room(spark, n_items):
    """Three of ``n_items`` less the seen one: different, and every item and pair equally often. Ids are strings."""
    n, users = 3, 3000
    asked = spark.range(users).select(F.concat(F.lit("u|"), "id").alias("user_idx"))
    seen = asked.select("user_idx", F.lit(2).cast("long").alias("item_idx"))
    by_user = {}
    for r in negatives.uniform_unseen(asked, seen, n_items, n).collect():
        by_user.setdefault(r["user_idx"], {})[r["slot"]] = r["item_idx"]
    assert len(by_user) == users
    items, pairs = np.zeros(n_items), np.zeros((n_items, n_items))
    for slots in by_user.values():
        assert sorted(slots) == [1, 2, 3] and len(set(slots.values())) == n
        for a in slots.values():
            items[a] += 1
            for b in slots.values():
                pairs[a, b] += a != b
    room = n_items - 1
    assert items[2] == 0
    rest = [i for i in range(n_items) if i != 2]
    p = n / room
    assert np.abs(items[rest] / users - p).max() <= 5 * np.sqrt(p * (1 - p) / users)
    q = p * (n - 1) / (room - 1)
    off = pairs[np.ix_(rest, rest)][~np.eye(room, dtype=bool)]
    assert np.abs(off / users - q).max() <= 5 * np.sqrt(q * (1 - q) / users)


def test_weighted_draws_when_little_is_left(spark):
    """The only unseen item with any popularity is found; zero-count items are never drawn."""
    counts = spark.createDataFrame([(0, 5000), (1, 3000), (2, 1), (3, 0)], "item_idx long, cnt long")
    seen = spark.createDataFrame([(1, 0), (1, 1)], "user_idx long, item_idx long")
    users = spark.createDataFrame([(1,), (2,)], "user_idx long")
    got = negatives.weighted_unseen(users, seen, counts, 2).collect()
    assert [r["item_idx"] for r in got if r["user_idx"] == 1] == [2]
    assert sorted(r["item_idx"] for r in got if r["user_idx"] == 2) == [0, 1]


def test_weighted_draws_in_rounds_find_all_that_is_left(spark):
    """One item holds nearly all weight, so the first round finds little else; in the end all are found."""
    counts = spark.createDataFrame([(0, 10**9), *[(i, 1) for i in range(1, 12)], (12, 0)], "item_idx long, cnt long")
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_idx string")
    seen = spark.createDataFrame([("b", 3), ("b", 12), ("c", 0)], "user_idx string, item_idx long")
    got = {}
    for r in negatives.weighted_unseen(users, seen, counts, 11).collect():
        got.setdefault(r["user_idx"], {})[r["slot"]] = r["item_idx"]
    assert all(sorted(slots) == list(range(1, 12)) for slots in got.values())
    assert set(got["b"].values()) == {0, 1, 2, *range(4, 12)} and set(got["c"].values()) == set(range(1, 12))
    assert len(set(got["a"].values())) == 11 and got["a"][1] == 0
    assert negatives.weighted_unseen(users, seen, counts.where("cnt = 0"), 2).count() == 0


@pytest.mark.parametrize("bound", [3, 10**9])
def test_unseen_ranks_of_a_user_with_most_of_the_catalogue(spark, bound, monkeypatch):
    """Seen list and draws of one user go over several tasks; the answer is the r-th item left."""
    for name in ("running_total", "with_position"):
        own = getattr(ordering, name)
        monkeypatch.setattr(negatives, name, lambda *a, own=own, **k: own(*a, **k, group_bound=bound))
    seen = [("u", i) for i in range(500) if i % 50 != 7] + [("v", 0), ("v", 2)]
    draws = [(i, "u", i % 10) for i in range(40)] + [(100, "v", 0), (101, "v", 1), (102, "w", 4)]
    found = negatives.nth_unseen(
        spark.createDataFrame(draws, "draw_id long, user_idx string, r long"), spark.createDataFrame(seen, "user_idx string, item_idx long")
    )
    want = {i: 7 + 50 * (i % 10) for i in range(40)} | {100: 1, 101: 3, 102: 4}
    assert {r["draw_id"]: r["item_idx"] for r in found.collect()} == want


@pytest.mark.parametrize("bits", [8, 4, "fp16"])
def test_residual_codes_keep_distances(spark, bits):
    """Items far from the origin but near their centres: only codes of residuals tell them apart."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (3, 4))
    x = np.repeat(centres, 30, axis=0) + rng.normal(0, 0.5, (90, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_idx long, embedding array<double>")
    cents = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    own = ann.to_residuals(ann.ivf_assign(items, cents), cents)
    ranges = ann.sq_ranges(own)
    codes = ann.sq_encode(own, bits, ranges)
    if bits == "fp16":
        assert dict(codes.dtypes)["codes"] == "array<smallint>"
        back = {r["item_idx"]: r["embedding"] for r in ann.sq_decode(codes, bits, ranges).collect()}
        want = (x - np.repeat(centres, 30, axis=0)).astype(np.float16).astype(float)
        assert np.array_equal(np.array([back[i] for i in range(90)]), want)
    queries = items.withColumnRenamed("item_idx", "query_id")
    found = ann.ivfsq_search(queries, codes, ranges, cents, 3, 1, bits).collect()
    right = np.mean([r["query_id"] == r["item_idx"] for r in found])
    assert right >= (0.9 if bits != 4 else 0.6)


def test_weighted_draws_follow_popularity(spark):
    counts = spark.createDataFrame([(0, 900), (1, 90), (2, 10)], "item_idx long, cnt long")
    users = spark.range(2000).withColumnRenamed("id", "user_idx")
    none = spark.createDataFrame([], "user_idx long, item_idx long")
    got = negatives.weighted_unseen(users, none, counts, 1).groupBy("item_idx").count().collect()
    share = {r["item_idx"]: r["count"] / 2000 for r in got}
    assert share[0] == pytest.approx(0.9, abs=0.03) and share[1] == pytest.approx(0.09, abs=0.03)


@pytest.mark.parametrize("bound", [0, 10**9])
def test_auroc(spark, bound):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 30, 400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "score long, label int")
    p, q = s[y == 1][:, None], s[y == 0][None]
    want = ((p > q) + 0.5 * (p == q)).mean()
    assert ranker.auroc(df, group_bound=bound).first()["auroc"] == pytest.approx(want)


@pytest.mark.parametrize("bound", [0, 10**9])
def test_latency_quantiles(spark, bound):
    v = np.random.default_rng(2).random(333)
    df = spark.createDataFrame([("a", float(x)) for x in v], "component string, latency_ms double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    row = rec.latency_summary(df, "component", group_bound=bound).first()
    assert [row["median"], row["p95"], row["p99"]] == pytest.approx(np.quantile(v, [0.5, 0.95, 0.99]).tolist())


def test_bpr_pairs_are_linear(spark, hot):
    feats = hot.select("user_idx", "item_idx", (F.col("rating") > 2).cast("double").alias("label"), F.lit(1.0).alias("weight"), F.array("rating").alias("features"), F.monotonically_increasing_id().alias("id"))
    out = ranker.bpr_differences(feats, "user_idx", ["id"])
    sides = feats.groupBy("user_idx").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).where("q > 0")
    assert out.count() == 2 * sides.agg(F.sum("p")).first()[0]


def test_exact_subsample(hot, rows):
    df = hot.withColumn("id", F.monotonically_increasing_id())
    assert negatives.subsample_exact(df, 0.37, ["id"]).count() == int(len(rows) * 0.37)
    with pytest.raises(ValueError):
        negatives.subsample_exact(df, 1.5, ["id"])


def test_several_running_totals(hot, rows):
    df = hot.withColumn("v", F.col("rating") - 3.0).withColumn("w", F.lit(1))
    plain = ordering.running_total(df, {"a": "v", "b": "w"}, ORDER, ["user_idx"]).collect()
    cut = ordering.running_total(df, {"a": "v", "b": "w"}, ORDER, ["user_idx"], group_bound=0).collect()
    key = lambda r: (r["user_idx"], r["b"])
    assert [r["a"] for r in sorted(cut, key=key)] == pytest.approx([r["a"] for r in sorted(plain, key=key)])


@pytest.mark.parametrize("bound", [0, 10**9])
def test_margin_loss_by_sweep(spark, bound):
    rng = np.random.default_rng(3)
    x, y, w, b = rng.integers(-9, 9, 150) / 4, rng.integers(0, 2, 150), rng.random(150), rng.integers(0, 3, 150)
    b[y == 1] = np.minimum(b[y == 1], 1)  # the last batch has no positives
    df = spark.createDataFrame([(float(a), int(c), float(d), int(e)) for a, c, d, e in zip(x, y, w, b)], "logit double, label int, w double, b long")
    got = {r["b"]: r["loss"] for r in losses.margin_loss(df, weight="w", batch="b", margin=0.5, group_bound=bound).collect()}
    for i in (0, 1):
        p, q = (b == i) & (y == 1), (b == i) & (y == 0)
        want = np.maximum(0, 0.5 - (x[p][:, None] - x[q][None])) * w[p][:, None]
        assert got[i] == pytest.approx(want.mean())
    assert got[2] == 0.0


def test_sub_spaces_trained_together(spark):
    """Four clear clusters in each half of the vectors, in other combinations: both halves are found."""
    rng = np.random.default_rng(4)
    corners = np.array([[0, 0], [0, 9], [9, 0], [9, 9.0]])
    x = np.hstack([corners[rng.integers(0, 4, 300)], corners[rng.integers(0, 4, 300)]]) + rng.normal(0, 0.05, (300, 4))
    items = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "item_idx long, embedding array<double>")
    books = ann.pq_train(items.repartition(5), 2, 2)
    for sub in (0, 1):
        found = [r["codeword"] for r in books.where(f"sub = {sub}").collect()]
        assert sorted(np.round(found).tolist()) == sorted(corners.tolist())
    got = {r["sub"]: r["error"] for r in ann.pq_error(items, books).collect()}
    assert got[0] < 300 * 2 * 0.05**2 * 1.2 and got[1] < 300 * 2 * 0.05**2 * 1.2
    copies = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2), 0.0]) for i in range(50)], "item_idx long, embedding array<double>")
    few = ann.pq_train(copies, 2, 3)  # fewer different vectors than codes
    assert few.where("sub = 0").count() == 1 and few.where("sub = 1").count() == 2
    assert {tuple(r["codes"]) for r in ann.pq_encode(copies, few).collect()} <= {(0, 0), (0, 1)}


def test_pairwise_gradient_in_blocks(spark, monkeypatch):
    """All pairs of a hot group, cut into blocks, against one matrix; surplus negatives count."""
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    f, y, w = rng.normal(size=(90, 3)), (rng.random(90) < 0.3).astype(float), rng.random(90)
    g = np.where(rng.random(90) < 0.7, 1, rng.integers(2, 6, 90))
    y[g == 5] = 1.0  # a group without negatives
    data = [(int(a), [float(x) for x in b], float(c), float(d)) for a, b, c, d in zip(g, f, y, w)]
    data += data[:10]  # copies
    df = spark.createDataFrame(data, "user_idx long, features array<double>, label double, weight double")
    blocks, beta = pairwise.pair_blocks(df, "user_idx"), np.array([0.3, -1.0, 0.5])
    loss = mass = 0.0
    grad = np.zeros(3)
    for a in data:
        for b in data:
            if a[0] == b[0] and a[2] == 1.0 and b[2] == 0.0:
                d = np.array(a[1]) - np.array(b[1])
                loss, mass = loss + a[3] * np.logaddexp(0, -d @ beta), mass + a[3]
                grad -= a[3] * d / (1 + np.exp(d @ beta))
    got, slope = pairwise.pair_gradient(blocks, beta)
    assert got == pytest.approx(loss / mass) and slope == pytest.approx(grad / mass)


def test_pairwise_fit_orders_within_groups(spark):
    """Labels follow one feature of three; without a pair all weights stay zero."""
    rng = np.random.default_rng(6)
    data = []
    for g in range(30):
        for i in range(8):
            signal = float(rng.normal())
            label = float(signal + rng.normal(0, 0.3) > 0)
            data.append((g, [signal, float(rng.normal()), 1.0], label, 1.0))
    df = spark.createDataFrame(data, "user_idx long, features array<double>, label double, weight double")
    scored = ranker.predict(ranker.train_ranker(df, loss="bpr"), df)
    assert ranker.auroc(scored).first()["auroc"] > 0.95
    one_sided = df.withColumn("label", F.lit(1.0))
    assert ranker.predict(ranker.train_ranker(one_sided, loss="bpr"), df).where("score <> 0.5").count() == 0
