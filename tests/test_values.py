"""Hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from tasteloom.functions import arrays, text, vectors
from tasteloom.operators import embeddings, features, losses, metrics, prep, prompts, ranker, sequences, splits
from tasteloom.plans import recommend as rec

PREDICTIONS = [[10, 20, 30, 40, 50], [11, 22, 33, 44, 55], [1, 2, 3, 4, 5]]
TARGETS = [[10, 30, 99], [99, 88], [1, 5]]


def lists(spark, preds, targets):
    p = [(q, i, r + 1) for q, items in enumerate(preds) for r, i in enumerate(items)]
    t = [(q, i) for q, items in enumerate(targets) for i in items]
    return (
        spark.createDataFrame(p, "query_id long, item_idx long, rank int"),
        spark.createDataFrame(t, "query_id long, item_idx long"),
    )


def value(df):
    return df.first()["value"]


def test_metrics_at_three(spark):
    preds, truth = lists(spark, PREDICTIONS, TARGETS)
    assert value(metrics.recall_at_k(preds, truth, 3)) == pytest.approx((2 / 3 + 0 + 1 / 2) / 3)
    assert value(metrics.mrr_at_k(preds, truth, 3)) == pytest.approx(2 / 3)
    assert value(metrics.hit_rate_at_k(preds, truth, 3)) == pytest.approx(2 / 3)
    sums = {r["name"]: r["value"] for r in metrics.batch_metrics(preds, truth, [3]).collect()}
    assert sums["Recall@3"] == pytest.approx(1.16666, abs=1e-4)
    assert sums["HitRate@3"] == 2.0


def test_ndcg(spark):
    preds, truth = lists(spark, [[10, 20]], [[10, 30]])
    assert value(metrics.ndcg_at_k(preds, truth, 2)) == pytest.approx(1 / (1 + 1 / math.log2(3)))


def test_no_targets(spark):
    preds, truth = lists(spark, [[1, 2, 3]], [[]])
    for fn in (metrics.recall_at_k, metrics.ndcg_at_k, metrics.mrr_at_k, metrics.hit_rate_at_k):
        assert value(fn(preds, truth, 3)) == 0.0


def test_families_differ_on_repeats(spark):
    """Repeated targets lower recall in the first family and not in the second."""
    preds, truth = lists(spark, [[1, 2]], [[1, 1, 9]])
    assert value(metrics.recall_at_k(preds, truth, 2)) == pytest.approx(1 / 3)
    sums = {r["name"]: r["value"] for r in metrics.batch_metrics(preds, truth, [2]).collect()}
    assert sums["Recall@2"] == pytest.approx(1 / 2)


def test_metrics_table_ignores_keys_without_cut(spark):
    long = spark.createDataFrame([("A_Recall@10", 0.5), ("A_Recall@20", 0.6), ("time", 3.0)], "name string, value double")
    rows = {r["k"]: r["A_Recall"] for r in metrics.metrics_table(long).collect()}
    assert rows == {10: 0.5, 20: 0.6}


def test_popularity(spark):
    train = spark.createDataFrame([(0,), (0,), (1,), (2,)], "item_idx long")
    raw = {r["item_idx"]: r["prob"] for r in features.item_probabilities(train, 5, smooth=False).collect()}
    smooth = {r["item_idx"]: r["prob"] for r in features.item_probabilities(train, 5).collect()}
    assert raw[0] == 0.5 and raw[3] == 0.0
    assert smooth[0] == pytest.approx(3 / 9) and smooth[3] == pytest.approx(1 / 9)


def test_popularity_of_nothing(spark):
    train = spark.createDataFrame([], "item_idx long")
    assert {r["prob"] for r in features.item_probabilities(train, 3, smooth=False).collect()} == {0.0}


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(vectors.l2_normalize("v")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_titles(spark):
    cases = {
        "Matrix, The (1999)": "The Matrix (1999)",
        "Clockwork Orange, A (1971)": "A Clockwork Orange (1971)",
        "Affair, An": "An Affair",
        "Heat (1995)": "Heat (1995)",
        "One, Two, The (2000)": "The One, Two (2000)",
        "Man, Of (1990)": "Man, Of (1990)",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.format_title("t")).collect()] == list(cases.values())


def test_year_buckets(spark):
    cases = {"a": 0, "a (1969)": 1, "a (1970)": 2, "a (1985)": 3, "a (1999)": 4, "a (2000)": 5, "b (x) (1971) (2001)": 2, None: 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.year_bucket("t")).collect()] == list(cases.values())


def test_yes_no(spark):
    cases = [
        ([(" Yes", -0.1), ("no.", -2.0)], 1.9),
        ([("YES", -0.5), ("yes!", -1.0)], math.log(math.exp(-0.5) + math.exp(-1.0))),
        ([("no", -0.1)], -999.0),
        ([("maybe", -0.1)], -999.0),
        ([], -999.0),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t array<struct<token:string,logprob:double>>")
    got = [r[0] for r in df.select(text.yes_no_score("t")).collect()]
    assert got == pytest.approx([w for _, w in cases])


def test_completion_mask(spark):
    df = spark.createDataFrame([(2, 5), (9, 3)], "p int, t int")
    got = df.select(text.completion_mask("p", "t"), text.completion_mask("p", "t", True)).collect()
    assert [list(r) for r in got] == [[[0, 0, 1, 1, 1], [0, 0, 0, 1, 1]], [[0, 0, 0], [0, 0, 0]]]


def test_padding_round_trip(spark):
    df = spark.createDataFrame([([5, 0, 7],), ([],)], "h array<long>")
    padded = df.select(arrays.pad_left("h", 5).alias("s"))
    assert [r[0] for r in padded.collect()] == [[0, 0, 6, 1, 8], [0] * 5]
    assert [r[0] for r in padded.select(arrays.drop_padding("s")).collect()] == [[5, 0, 7], []]


def test_collision_raises_no_loss_to_zero(spark):
    rows = [(0, i, [1.0 if j == i else 0.1 for j in range(3)], [1.0 if j == i else 0.0 for j in range(3)], u, i) for i, u in enumerate([101, 101, 102])]
    pairs = spark.createDataFrame(rows, "batch long, row_id long, user_vec array<double>, item_vec array<double>, user_idx long, item_idx long")
    plain = losses.info_nce_loss(pairs, temperature=1.0).first()["loss"]
    masked = losses.info_nce_loss(pairs, temperature=1.0, user_col="user_idx").first()["loss"]
    assert 0 < masked < plain
    e = math.exp
    want = (2 * -math.log(e(1) / (e(1) + e(0.1))) - math.log(e(1) / (e(1) + 2 * e(0.1)))) / 3
    assert masked == pytest.approx(want)


def test_bpr_without_negatives(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "logit double, label int")
    assert losses.bpr_loss(df).first()["loss"] == 0.0
    with pytest.raises(ValueError):
        losses.ranker_loss("other")


def test_negative_bound_alone_filters_nothing(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 5.0)], "user_idx long, item_idx long, rating double")
    assert prep.filter_pos_neg(df, None, 1.0).count() == 2
    assert prep.split_pos_neg(df, 4.0, None)[1] is None


def test_short_histories_fill_test_first(spark):
    df = spark.createDataFrame([(1, 7, 10), (2, 8, 10), (2, 9, 20)], "user_idx long, item_idx long, timestamp long")
    got = {(r["user_idx"], r["item_idx"]): r["split"] for r in splits.split_user_last_k(df, 1, 1).collect()}
    assert got == {(1, 7): "test", (2, 9): "test", (2, 8): "val"}


def test_drift_gate_choice(spark):
    gate = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "cand string, ok boolean")
    speed = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0)], "cand string, latency_ms double")
    assert embeddings.best_accepted(gate, speed).first()["cand"] == "b"


def test_ranker_overfits_two_rows(spark):
    vec = [[1.0, 0.0, 0.2], [0.0, 1.0, 0.1]]
    feats = spark.createDataFrame([(1, 1, 1.0, 1.0, vec[0]), (1, 2, 0.0, 1.0, vec[1])], "user_idx long, item_idx long, label double, weight double, features array<double>")
    model = ranker.train_ranker(feats, max_iter=100, reg=0.0)
    got = {r["item_idx"]: r["score"] for r in ranker.predict(model, feats).collect()}
    assert got[1] > 0.9 and got[2] < 0.1
    bpr = ranker.predict(ranker.train_ranker(feats, loss="bpr"), feats)
    got = {r["item_idx"]: r["score"] for r in bpr.collect()}
    assert got[1] > got[2]


def test_windows_shorter_than_histories(spark):
    rows = [(u, i, i) for u, n in ((1, 30), (2, 13), (3, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "user_idx long, item_idx long, timestamp long").withColumn("split", F.lit("train"))
    got = {r["user_idx"]: r["seq"] for r in sequences.train_last_window(df, ["timestamp"], 12).collect()}
    assert got == {1: list(range(18, 31)), 2: list(range(1, 14)), 3: [0] * 9 + [1, 2, 3, 4]}
    got = {r["user_idx"]: r["seq"] for r in sequences.inference_windows(df, ["timestamp"], 12).collect()}
    assert got == {1: list(range(19, 31)), 2: list(range(2, 14)), 3: [0] * 8 + [1, 2, 3, 4]}


def test_requests(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 1, 0), (4, 1, 101)], "request_id long, user_id long, k int")
    ok, bad = rec.validate_requests(df)
    assert {r["request_id"]: r["k"] for r in ok.collect()} == {1: 5, 2: 10}
    assert {r["request_id"] for r in bad.collect()} == {3, 4}


def test_eval_table_modes(spark):
    inter = spark.createDataFrame([(0, 1, 1, 5.0), (1, 1, 2, 1.0)], "example_id long, user_idx long, item_idx long, rating double")
    assert ranker.ranker_eval_table(inter, mode="other", pos=3.0).count() == 1
    with pytest.raises(ValueError):
        ranker.ranker_eval_table(inter, mode="explicit")
    with pytest.raises(ValueError):
        ranker.ranker_train_table(inter, pos=None)


def test_long_conversation_continues(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)], "conv_id long, turn long, role string, text string")
    parts = prompts.chat_format(turns, chunk=2).orderBy("part").collect()
    assert "\n".join(r["text"] for r in parts) == prompts.chat_format(turns).first()["text"]
    assert len(parts) == 3


def test_sft_text(spark):
    titles = ["Heat (1995)", "Fargo (1996)", "Alien (1979)", "Se7en (1995)", "Brazil (1985)", "Up (2009)"]
    cat = spark.createDataFrame(list(enumerate(titles)), "item_idx long, title string")
    inter = spark.createDataFrame([(1, 5, [0, 1, 2, 3, 4]), (2, 5, [0, 1])], "example_id long, item_idx long, history array<long>")
    hard = spark.createDataFrame([(1, 99), (2, 0)], "example_id long, neg_item_idx long")
    rand = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "example_id long, neg_item_idx_1 long, neg_item_idx_2 long")
    rows = prompts.sft_examples(inter, hard, rand, cat, rand_ratio=1.0, system_prompt="S").orderBy("kind", "slot").collect()
    # the second example is too short, the hard negative has no title
    assert [(r["example_id"], r["kind"], r["slot"], r["target_label"]) for r in rows] == [(1, "positive", 0, 1), (1, "random", 1, 0), (1, "random", 2, 0)]
    assert rows[0]["text"] == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nUser Viewing History:\n"
        "1. <movie_emb> Heat (1995)\n2. <movie_emb> Fargo (1996)\n3. <movie_emb> Alien (1979)\n"
        "4. <movie_emb> Se7en (1995)\n5. <movie_emb> Brazil (1985)\n\n"
        "Candidate Movie: <movie_emb> Up (2009)\n\nWill the user watch this next?<|im_end|>\n"
        "<|im_start|>assistant\nYes<|im_end|>"
    )
    assert rows[0]["item_sequence"] == [0, 1, 2, 3, 4, 5]


def test_genre_of_missing_item(spark):
    cat = spark.createDataFrame([(1, "t", None), (2, "t", ""), (3, "t", "B|A")], "item_idx long, title string, genres string")
    vocab = features.genre_vocabulary(cat)
    assert vocab == ["Unknown", "", "A", "B"]
    hot = {r["item_idx"]: r["genre_multihot"] for r in features.genre_multihot(cat, vocab).collect()}
    assert hot[1] == hot[2] == [1.0, 0.0, 0.0, 0.0] and hot[3] == [0.0, 0.0, 1.0, 1.0]


def test_positions_without_a_pool_get_a_random_item(spark):
    from tasteloom.operators import negatives

    pairs = spark.createDataFrame([(0, 5), (1, 5), (2, 7)], "example_id long, target long")
    top = spark.createDataFrame([(0, 5, 1), (2, 7, 1), (2, 3, 2)], "query_id long, item_idx long, rank int")
    rows = negatives.hard_negatives_position(pairs, top, n_items=9).collect()
    found = {r["example_id"]: r["neg_item_idx"] for r in rows}
    assert set(found) == {0, 1, 2} and found[2] == 3
    assert all(0 <= found[i] < 9 and found[i] != 5 for i in (0, 1))
