"""Each operator against a plain version, and the cases its docstring defines."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from math import log2

import brute
import numpy as np
import pytest
from tasteloom.llm import (
    chat_format,
    components,
    cotraining,
    decontaminate,
    phrase_dedup,
    pivotal_mix,
    prefix_hash,
    secret_scan,
    setsketch,
    sharding,
    template_html,
    words,
)
from tasteloom.llm.words import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def llm(spark):
    return prepare(spark)


def prose(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    """Null, empty, blanks, one word, copies, near copies, a repeated word, a very long text."""
    base = prose(120, 1)
    near = base.split()
    near[100] = "changed"
    shared = prose(40, 2)
    return [
        None, "", " \t\n ", "word", base, base, " ".join(near), base.upper(), "de " * 90, "de " * 30,
        prose(60, 3) + " " + shared, prose(60, 4) + "\n" + shared + " " + prose(30, 5), prose(30_000, 6, 5000),
        "é" * 40 + " ß\x1f\x85 \xa0 end", prose(19, 7), prose(20, 8), prose(20, 8),
    ]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# sharding


def test_shards_fit_and_are_a_partition(llm, odd_texts):
    docs = table(llm, odd_texts * 5).withColumn("bits", __import__("pyspark.sql.functions").sql.functions.lit(1))
    rows = sharding.assign_shards(docs, limit=2_000, step=3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(range(len(odd_texts) * 5))
    size, count = defaultdict(int), Counter()
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
    assert all(size[s] <= 2_000 or count[s] == 1 for s in size)
    assert all(r["shard_bytes"] == size[r["shard"]] and r["over_limit"] == (size[r["shard"]] > 2_000) for r in rows)
    # no shard's bits begin another's, and two sister leaves never fit together
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    sums = defaultdict(int)
    rows_below = Counter()
    for s in names:
        for d in range(len(s)):
            sums[s[:d]] += size[s]
            rows_below[s[:d]] += count[s]
    assert all(v > 2_000 and rows_below[s] > 1 for s, v in sums.items())


def test_shards_same_for_any_step_and_copies_spread(llm):
    docs = table(llm, ["x" * 100]).crossJoin(llm.range(5_000)).drop("id")
    a = sharding.assign_shards(docs, limit=20_000, step=2)
    b = sharding.assign_shards(docs, limit=20_000, step=12)
    assert a.count() == 5_000 and a.exceptAll(b).count() == 0
    assert a.select("shard").distinct().count() > 20


def test_shards_of_nothing(llm):
    assert sharding.assign_shards(table(llm, [])).count() == 0


# co-training


def test_cotraining_keeps_good_and_rejects_bad(llm):
    draw = random.Random(3)
    texts, labels = [], []
    for i in range(600):
        kind = i % 4
        words = prose(80, 100 + i, 300).split()
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words[draw.randrange(80)] = words[draw.randrange(80)] = "vile"
        texts.append(" ".join(words))
        if i < 400:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    labels += [(0, None, None), (None, 1, 0), (4, 1, 0)]
    docs = table(llm, texts + [None, ""]).withColumnRenamed("n_chars", "score")
    scored = cotraining.score_documents(docs, llm.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = by_id(scored, "keep", "score", "text_score", "meta_score")
    assert len(kept) == 602 and all(0 <= v <= 1 for r in kept.values() for v in r[1:])
    right = [kept[i][0] == (i % 4 in (0, 3)) for i in range(400, 600)]
    assert np.mean(right) > 0.95


def test_every_unlabelled_row_may_teach(llm):
    docs = table(llm, [prose(30, i) for i in range(300)])
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    known = np.array(sorted(r["doc_id"] for r in cotraining.labelled_sample(labels).collect()))
    assert known.tolist() == list(range(100))
    sure = cotraining.View()
    sure.text[cotraining.DIM] = 9.0  # the text view is sure of every row, the metadata view of none
    combination = cotraining.Combination(np.array([[-9.0, 0.0], [9.0, 0.0]] * 50), np.array([0.0, 1.0] * 50))
    taught = cotraining.exchange(cotraining.feature_rows(docs), known, [sure] * cotraining.MODELS, combination)
    for text, meta in taught:
        assert text[:, -1].tolist() == [0, 0] and meta[:, -1].tolist() == [0, 200]


def test_what_a_view_learns_is_dropped_if_it_hurts():
    draw = np.random.default_rng(1)
    good = (draw.random(300) < 0.5).astype(float)
    signal = np.column_stack([good * 4 - 2 + draw.normal(0, 1, 300), draw.normal(0, 1, 300)])
    fold = np.arange(300) % cotraining.FOLDS
    noisy = signal + [[5.0, 0.0]] * draw.normal(0, 1, (300, 1))
    assert cotraining.cross_fitted_loss(signal, good, fold) < cotraining.cross_fitted_loss(noisy, good, fold)


def plain_features(texts):
    """For each text the sets of its words' letters and of its words' shapes."""
    out = []
    for text in texts:
        words = [w for w in (text or "").encode().split()]
        cores = {bytes(c for c in w.lower() if chr(c).isalpha() and c < 128 or c >= 128) for w in words}
        out.append((len(words), cores))
    return out


def test_cotraining_features_are_those_of_the_words(odd_texts, monkeypatch):
    texts = [(t or "").encode() for t in odd_texts] + [b"Word wOrd, WORD 12 w-ord!", b"a,b a;b"]
    langs, sources = ["en", None] * 10, ["s"] * 20
    langs, sources = langs[: len(texts)], sources[: len(texts)]
    ids, offsets, meta = cotraining.Features().of(texts, langs, sources)
    for i, (n, cores) in enumerate(plain_features(t.decode() for t in texts)):
        own = ids[offsets[i] : offsets[i + 1]]
        assert len(own) == len(set(own.tolist())) >= min(1, n)
        # buckets may collide, and shapes come on top
        assert len(cores) * 0.9 <= len(own) <= len(cores) + 40
    same = [offsets[i : i + 2] for i in (len(texts) - 2, len(texts) - 1)]
    assert len(ids[slice(*same[0])]) == 2 + 5 and len(ids[slice(*same[1])]) == 1 + 2  # letters "word" and none; five shapes
    monkeypatch.setattr(cotraining, "PIECE", 100)
    cut = cotraining.Features().of(texts, langs, sources)
    assert (cut[0] == ids).all() and (cut[1] == offsets).all()
    layout = [c for c in range(cotraining.META) if c != 5]  # distinct words are counted in each piece
    assert np.allclose(cut[2][:, layout], meta[:, layout], atol=1e-5)


def test_cotraining_odd_rows(llm, odd_texts):
    rows = [(i % 40, t, "en" if i % 3 else None, None if i % 4 else "s", 1) for i, t in enumerate(odd_texts * 6)]
    docs = llm.createDataFrame([*rows, (None, "null id", None, None, None)], DOCS)
    clash = docs.selectExpr("*", "1 keep", "'x' score", "2 good", "3 fold", "4 ids", "5 meta", "6 hash", "7 model")
    labels = llm.createDataFrame([(i % 40, int(i % 3 > 0), 0) for i in range(50)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = cotraining.score_documents(clash, labels).collect()
    assert len(scored) == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    kept = cotraining.keep_good(clash, labels)
    assert kept.schema == clash.schema and kept.count() == sum(r["keep"] for r in scored)


def test_cotraining_without_two_classes_keeps_all(llm):
    docs = table(llm, ["a b", None])
    for rows in ([], [(0, 1, 0)]):
        labels = llm.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert [r["keep"] for r in cotraining.score_documents(docs, labels).collect()] == [True, True]
    assert cotraining.score_documents(table(llm, []), labels).count() == 0


def test_equal_turns_go_by_text_as_it_stands(llm):
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "<a"), (1, 0, "user", None), (1, 0, "a|>", "z")]
    formatted = chat_format.format_conversations(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = formatted.select(chat_format.read_back("formatted").alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("a|>", "z"), ("user", ""), ("user", "<a"), ("user", "<|x")]


def test_pages_keep_what_only_sounds_like_a_menu():
    def inside(part):
        return template_html.extract(f"<body><article><p>first</p>{part}<p>last</p></article></body>")

    for kept in (
        "<h2 id='side-effects'>words</h2>", "<section id='related-work'><p>words</p></section>", "<p class='search results'>words</p>",
        "<p><a title='the hidden truth'>words</a></p>", "<div class='layout with-sidebar'>words</div>", "<p id=comments>words</p>",
        "<div data-x='hidden'>words</div>",
    ):
        assert inside(kept) == "first\nwords\nlast", kept
    for gone in (
        "<div class='ad'>words</div>", "<div class='box ad-banner'>words</div>", "<div id='comments'>words</div>", "<div hidden>words</div>",
        "<ul class='site-nav'><li>words</ul>", "<p HIDDEN=''>words</p>", "<div class='cookie-notice2'>words</div>", "<section class=related>words</section>",
    ):
        assert inside(gone) == "first\nlast", gone


def test_templates_of_pages_without_an_id_and_of_two_hosts(llm):
    def page(i, menu):
        items = "".join(f"<li class='x{' active' if k == i % 3 else ''}'><a href='/{i}/{k}'>{menu} {k}</a></li>" for k in range(3))
        return f"<body><article><p>text {i}</p><div class='tools'><ul>{items}</ul></div></article></body>"

    rows = [(None if i % 2 else 7, f"http://a.x/{i}", page(i, "goto")) for i in range(8)]
    rows += [(7, f"http://b.x/{i}", page(i, "walk")) for i in range(8)] + [(1, "http://c.x/1", page(1, "goto")), rows[1]]
    found = template_html.extract_pages(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {(r["url"], r["text"]) for r in found}
    assert len(found) == len(rows)
    want = {(u, "text " + u.rsplit("/", 1)[1]) for _, u, _ in rows if "c.x" not in u}
    assert texts == want | {("http://c.x/1", "text 1\ngoto 0\ngoto 1\ngoto 2")}


def test_broken_long_and_deep_markup():
    import time

    began = time.perf_counter()
    assert template_html.extract("<a " * 300_000).startswith("<a <a")
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert template_html.extract(deep) == "deep" and template_html.extract("<p>" + "long " * 400_000).count("long") == 400_000
    assert template_html.extract("text <!-- open comment") == "text"
    assert time.perf_counter() - began < 20


# secrets


def test_entropy_counts_equal_plain_entropy():
    draw = random.Random(1)
    for n in (1, 5, 20, 21, 64):
        text = "".join(draw.choice("abcdef0123456789XYZ") for _ in range(n))
        width = min(20, n)
        plain = [
            -sum(c / width * log2(c / width) for c in Counter(text[i : i + width]).values())
            for i in range(n - width + 1)
        ]
        assert abs(secret_scan.peak_entropy(text) - max(plain)) < 1e-9
    assert secret_scan.peak_entropy("") == 0.0


def test_secret_spans():
    text = 'é Password = "abcdef" token:abc AKIA' + "A1" * 8 + " x" + "0a" * 12 + " secret=token: abcdefgh"
    base, spans = secret_scan.scan_text(text)
    assert [(k, text[s:e]) for k, s, e in base] == [
        ("assign", 'Password = "abcdef'), ("access", "AKIA" + "A1" * 8), ("hex", "0a" * 12),
    ]
    random_key = "q7Zk3VbX9mPw2RtY8sLd4HfJ"
    _, spans = secret_scan.scan_text(f"key {random_key} and 123e4567-e89b-12d3-a456-426614174000 plainwordsplainwords2024")
    assert spans == [("entropy", 4, 4 + len(random_key))]


def test_secrets_of_odd_rows(llm, odd_texts):
    docs = table(llm, odd_texts).withColumnRenamed("source", "spans")
    assert secret_scan.scan_documents(docs).count() == len(odd_texts)
    assert secret_scan.scan_documents(table(llm, [])).count() == 0
    row = secret_scan.scan_documents(table(llm, [None])).first()
    assert (row["n_assign"], row["spans"], row["base_sha256"]) == (0, "", brute.sha(""))


# repeated passages


def test_repeats_equal_brute_force(llm, odd_texts):
    docs = table(llm, odd_texts).withColumnRenamed("lang", "anchors")
    found = by_id(phrase_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert found == brute.repeats(list(enumerate(odd_texts)))


def test_repeats_on_documents(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    found = by_id(phrase_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert found == brute.repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeats_in_blocks_and_shards(llm, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SHARD_WINDOWS", 50)
    monkeypatch.setattr(phrase_dedup, "BLOCK_CHARS", 500)
    shared = [prose(60, 20 + i) for i in range(4)]
    texts = [prose(25, 50 + i) + " " + shared[i % 4] + " " + shared[(i + 1) % 4] for i in range(60)]
    found = by_id(phrase_dedup.remove_repeats(table(llm, texts), with_text=True), "n_words", "n_removed", "kept_sha256", "kept")
    assert {k: v[:3] for k, v in found.items()} == brute.repeats(list(enumerate(texts)))
    assert all(brute.sha(v[3]) == v[2] for v in found.values())


def test_repeats_with_a_hot_passage_and_rows_without_an_id(llm, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "HOT_SHARE", 40)
    monkeypatch.setattr(phrase_dedup, "PART_BYTES", 900)
    shared, other = prose(30, 1), prose(26, 2)
    texts = [prose(8 + i % 5, 300 + i) + " " + shared + " " + prose(9, 700 + i) for i in range(240)]
    texts += [prose(30, 1100 + i) for i in range(60)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = by_id(phrase_dedup.remove_repeats(llm.createDataFrame(rows, DOCS)), "n_words", "n_removed", "kept_sha256")
    assert found == brute.repeats(list(enumerate(texts)))
    nameless = [(None, f"{prose(5, 40 + i)} {other} {prose(4, 60 + i)}", "en", "s", 1) for i in range(3)]
    mixed = phrase_dedup.remove_repeats(llm.createDataFrame([*rows, *nameless, nameless[0], (900, other, "en", "s", 1)], DOCS))
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in mixed.collect()]
    assert Counter(x for x in got if x[0] is not None) == Counter({(i, *v[:2]): 1 for i, v in found.items()} | {(900, 26, 26): 1})
    # one of the three texts has the passage first; the repeated row gets what its twin gets
    assert Counter(x[2] for x in got if x[0] is None) in (Counter({26: 3, 0: 1}), Counter({26: 2, 0: 2}))


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    texts = [b"", b"  a bc\ta  ", prose(300, 5).encode(), "\u00e9 a\x1fb \u2003 a".encode(), b"x" * 500, b"\n", b"a"]
    split = [t.split() for t in texts]
    hashes, ends = words.TextHashes().of(texts)
    assert np.diff(ends, prepend=0).tolist() == [len(w) for w in split]
    flat = [w for some in split for w in some]
    assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist(), strict=True)))
    cut = [(at, p) for at, p in words.pieces_of(texts, 100)]
    assert [w for _, p in cut for piece in p for w in piece.split()] == flat
    monkeypatch.setattr(words, "pieces_of", lambda t: iter(cut))
    again = words.TextHashes().of(texts)
    assert (again[0] == hashes).all() and (again[1] == ends).all()


def test_repeats_of_repeated_rows(llm):
    text = prose(50, 9)
    docs = llm.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    rows = phrase_dedup.remove_repeats(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (1, 50), (1, 50), (2, 50)]
    assert phrase_dedup.remove_repeats(table(llm, [])).count() == 0


# mixing


def test_targets_equal_sharing_again(llm):
    totals = {"b": 10, "a": 10_000, "é": 500, "c": 0, None: 3_000, "Z": 7}
    sizes = llm.createDataFrame([(s, n) for s, n in totals.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in pivotal_mix.source_targets(sizes).collect()}
    assert found == pytest.approx(brute.shares(totals))


def test_mix_meets_targets_and_reruns_agree(llm):
    rows = []
    for i in range(4_000):
        source = "hot" if i % 3 else None if i % 2 else f"s{i % 5}"
        rows.append((i, prose(5 + (i * 7) % 90, i), source))
    docs = llm.createDataFrame(rows + [(7, None, "s1"), (7, "", "s2")], "doc_id long, text string, source string")
    first = pivotal_mix.mix_documents(docs, block_rows=300)
    taken, target = defaultdict(int), {}
    for r in first.collect():
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 95 for s in target)
    again = pivotal_mix.mix_documents(docs.repartition(7), block_rows=300)
    assert first.count() == 4_002 and first.exceptAll(again).count() == 0
    assert pivotal_mix.mix_documents(table(llm, [])).count() == 0
    assert [r["taken"] for r in pivotal_mix.mix_documents(table(llm, [None, ""])).collect()] == [0, 0]


def test_pairs_keep_words_and_expectation():
    draw = random.Random(5)
    rows = [(i, draw.randrange(1, 50), 0.3) for i in range(30)]
    hits = np.zeros(30)
    for seed in range(3_000):
        decided, held = pivotal_mix.pair_off(rows, seed, 0)
        got = sum(rows[i][1] * d for i, d in decided.items()) + (held[1] * rows[held[0]][1] if held else 0)
        assert abs(got - sum(s * p for _, s, p in rows)) < 1e-6
        for i, d in decided.items():
            hits[i] += d
        if held:
            hits[held[0]] += held[1]
    assert np.abs(hits / 3_000 - 0.3).max() < 0.05


# fingerprints


def test_spans_and_extensions():
    a, b = "the quick brown fox", "xx quick brown dog"
    x, y = (prefix_hash.PrefixHashes(prefix_hash.code_points(t)) for t in (a, b))
    for i in range(len(a)):
        for j in range(len(b)):
            plain = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert prefix_hash.longest_common_extension(x, i, y, j) == plain
            for n in (1, 3):
                if i + n <= len(a) and j + n <= len(b):
                    assert prefix_hash.spans_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])


def test_fingerprints_equal_brute_force(llm, odd_texts):
    docs = table(llm, odd_texts).withColumnRenamed("lang", "cell")
    found = by_id(
        prefix_hash.fingerprint_documents(docs, cell_rows=2),
        "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
    texts = [t or "" for t in odd_texts]
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        n, digest, mark, edited_mark, near_edited, near_next = found[i]
        assert (n, digest) == (len(text), brute.sha(changed))
        assert edited_mark == str(prefix_hash.Fingerprint.of(changed)) and mark == str(prefix_hash.Fingerprint.of(text))
        assert near_edited == prefix_hash.likeness(mark, edited_mark) and 0 <= near_edited <= 1
        assert near_next == prefix_hash.likeness(mark, found[(i + 1) % len(texts)][2])
    assert found[4][2] == found[5][2] and found[4][5] == 1.0 and found[0][5] == 1.0 and found[2][5] < 1


def test_cells_hold_like_numbers_of_rows(llm, monkeypatch):
    from pyspark.sql import functions as F

    frame = type(llm.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a: self)
    docs = llm.range(4_000).selectExpr("id as doc_id", "'a' as text")
    dealt = prefix_hash.fingerprint_documents(docs, cell_rows=200)
    sizes = [r["count"] for r in dealt.where(~F.col("guest")).groupBy("at").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 800 and sum(sizes) == 4_000


def test_fingerprints_of_ties(llm):
    docs = llm.createDataFrame([(1, "b" * 10), (1, "a" * 10), (None, "n" * 4)], "doc_id long, text string")
    rows = prefix_hash.fingerprint_documents(docs).collect()
    changed = {"n" * 4: "nnaa", "a" * 10: "aaaaabbbbb", "b" * 10: "bbbbbnnnn"}
    assert sorted(r["edited_sha256"] for r in rows) == sorted(map(brute.sha, changed.values()))
    assert prefix_hash.fingerprint_documents(table(llm, [])).count() == 0


# near-duplicates


def test_groups_equal_brute_force(llm, odd_texts):
    docs = table(llm, odd_texts).withColumnRenamed("lang", "component_id")
    found = by_id(setsketch.near_duplicates(docs), "n_shingles", "component_id")
    assert found == brute.groups(list(enumerate(odd_texts)))


def test_chains_of_near_copies(llm):
    base, texts = prose(200, 77).split(), []
    for i in range(40):  # each differs from the one before in a few words, ends are far apart
        base = base[:]
        base[(i * 5) % 200] = f"new{i}"
        texts.append(" ".join(base))
    texts += [prose(150, 200 + i) for i in range(30)] + [texts[3]] * 5
    found = by_id(setsketch.near_duplicates(table(llm, texts)), "n_shingles", "component_id", "kept")
    assert {k: v[:2] for k, v in found.items()} == brute.groups(list(enumerate(texts)))
    assert all(v[2] == (k == v[1]) for k, v in found.items())


def test_groups_on_documents(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    found = by_id(setsketch.near_duplicates(docs), "n_shingles", "component_id")
    assert found == brute.groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_groups_of_repeated_rows(llm):
    text = prose(30, 1)
    docs = llm.createDataFrame([(5, text), (5, text), (9, text), (None, text), (None, None)], "doc_id long, text string")
    rows = setsketch.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == {(5, 5): 2, (9, 5): 1, (None, 5): 1, (None, None): 1}
    assert setsketch.near_duplicates(table(llm, [])).count() == 0


def test_sketch_registers_merge_and_resemble():
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 2**63, 4_000, dtype=np.uint64) for _ in range(2))
    b[:3_000] = a[:3_000]
    x, y = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.registers(np.union1d(a, b)) == np.maximum(x, y)).all()
    assert abs((x == y).mean() - 0.6) < 0.15
    pair = lambda p, q: bool(setsketch.may_be_similar(p[None], q[None], np.array([4e3]), np.array([4e3]))[0])
    assert pair(x, x) and not pair(x, setsketch.registers(draw.integers(0, 2**63, 4_000, dtype=np.uint64)))


def test_components(llm):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    found = {r["node"]: r["component"] for r in components.components(llm.createDataFrame(links, "a long, b long")).collect()}
    least = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert found == {x: c for x, c in least.items() if any(x in e and e[0] != e[1] for e in links)}


# pages


def test_page_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class='cookie-notice'>ok</div>"
        "<article><h1>Head &amp; line</h1><script>var t='</p>';</script><p>One  <b>two\n three.<br><p>Four&nbsp;&lt;x&gt;"
        "<aside>side</aside><div class='share-buttons'>share</div><section id=comments><p>I agree</p></section>"
        "<!-- no --></article><footer>foot</footer></body>"
    )
    assert template_html.extract(page) == "Head & line\nOne two three.\nFour <x>"
    assert template_html.extract(None) == template_html.extract("") == template_html.extract("<nav>x</nav>") == ""
    assert template_html.extract("no < markup &copy;") == "no < markup ©"


def test_recurring_subtrees_go(llm):
    rows = []
    for i in range(8):
        box = "<div><b>Join our list</b> today</div>"
        rows.append((i, "https://a.example/x", f"<body>{box}<div><p>{prose(20, i)}</p></div></body>"))
        rows.append((100 + i, "https://b.example/x", f"<body>{box if i < 2 else ''}<div><p>{prose(20, i)}</p></div></body>"))
        rows.append((200 + i, "https://c.example/", f"<article><p>same words here</p><p>{i}</p></article>"))
    rows += [(300, None, None), (300, None, None), (301, "x", "")]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as doomed")
    found = {r["page_id"]: r["text"] for r in template_html.extract_pages(pages).collect()}
    for i in range(8):
        assert found[i] == prose(20, i)
        assert found[100 + i] == ("Join our list today\n" if i < 2 else "") + prose(20, i)
        assert found[200 + i] == f"same words here\n{i}"
    assert found[300] == "" and template_html.extract_pages(pages.limit(0)).count() == 0


def test_templates_of_whole_pages_are_counted(llm):
    notice, menu = "<ul><li>Read more</li><li>Join us</li></ul>", "<div class='top'><a href='/'>Home</a></div><nav>menu</nav>"
    rows = [
        (i, "https://a.example/x", f"<body>{menu}<article><p>{prose(20, i)}</p>{notice}<p>Thank you.</p></article></body>")
        for i in range(8)
    ]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    for r in template_html.extract_pages(pages).collect():
        assert r["text"] == prose(20, r["page_id"]) + "\nThank you." and r["n_templates"] >= 3


def test_templates_are_a_share_of_the_host(llm):
    rows = []
    for i in range(90):
        box = "<div><p>Sign up</p></div>" if i < 6 else ""
        link = "<a href='/de'>de</a>" if i % 3 else "<p>Thank you.</p>"
        rows.append((i, "https://a.example/x", f"<body><div>{box}<p>{prose(20, i)} {link}</p></div></body>"))
    rows += [(100 + i, "https://b.example/x", f"<article><div>Sign up</div><p>{prose(9, i)}</p></article>") for i in range(3)]
    found = {r["page_id"]: r["text"] for r in template_html.extract_pages(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(90):
        assert found[i] == ("Sign up\n" if i < 6 else "") + prose(20, i) + (" de" if i % 3 else "\nThank you.")
    assert [found[100 + i] for i in range(3)] == [prose(9, i) for i in range(3)]


def test_classes_never_delete_what_holds_the_article():
    comments = "<section id='comments'><article class='comment'>me too</article></section>"
    for page in (
        f"<body><div class='layout with-sidebar'><article><p>text of it</p></article>{comments}</div></body>",
        f"<body><article class='post comments-open'><p>text of it</p>{comments}</article></body>",
        "<body><div class='entry has-header'><main><p>text of it</p><div class='share'>x</div></main></div></body>",
    ):
        assert template_html.extract(page) == "text of it"


# benchmark leaks


def test_leaks_equal_brute_force(llm):
    items = [(i, prose(n, 900 + i)) for i, n in enumerate([4, 7, 15, 20, 33, 57, 120, 300])] + [(50, None), (51, " ")]
    texts = [None, "", "a b"]
    for i, item in items[:8]:
        w = item.split()
        texts.append(prose(37, i) + " " + item.upper() + " " + prose(50, i + 40))
        if len(w) > 30:
            w[3] = "other"
            texts.append(prose(20, i) + " " + " ".join(w))
            texts.append(prose(20, i) + " " + " ".join(w[: len(w) // 3]))
        texts.append(prose(200, 700 + i))
    docs = table(llm, texts).withColumnRenamed("lang", "item_id")
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 100):
        found = decontaminate.find_contamination(docs, benchmark, item_block=block)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute.leaks(list(enumerate(texts)), items)
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0


def test_leaks_on_documents(llm, sf):
    docs, items = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs, items).collect()}
    held = [(r["item_id"], " ".join(brute.words(r["text"], True))) for r in items.collect()]
    for r in docs.collect():
        text = " ".join(brute.words(r["text"], True))
        assert {k for k, item in held if item in text} <= {k for d, k in found if d == r["doc_id"]}


def test_leaks_in_documents_shorter_than_the_item(llm):
    lengths = [4, 5, 9, 15, 29, 39, 40, 58, 61, 231, 250, 400]
    items = [(i, prose(n, 600 + i, 4_000)) for i, n in enumerate(lengths)] + [(50, prose(39, 605, 4_000)), (51, "la " * 39)]
    texts = ["la " * 31, "la " * 20]
    for _, item in items[: len(lengths)]:
        w = item.split()
        least = int(0.75 * (len(w) - 4)) + 4
        for d in {least - 1, least, least + 1, (least + len(w)) // 2, len(w) - 1}:
            texts += [" ".join(w[a : a + d]) for a in {0, (len(w) - d) // 2, len(w) - d}]
    found = decontaminate.find_contamination(table(llm, texts), llm.createDataFrame(items, "item_id long, text string"))
    want = brute.leaks(list(enumerate(texts)), items)
    assert {k for _, k in want} == {k for k, _ in items}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_leaks_in_pieces_of_long_documents(llm, monkeypatch):
    items = [(i, prose(12 + 7 * i, 900 + i, 4_000)) for i in range(6)]
    items += [(20, items[3][1]), (21, items[3][1]), (None, items[2][1])]  # equal items
    texts = []
    for i in range(12):
        inside = items[i % 6][1].split()
        if i % 2:
            inside[len(inside) // 2] = "edited"
        texts.append(" ".join([prose(150 + 37 * i, 950 + i, 4_000), *inside, prose(211, 970 + i, 4_000), items[(i + 1) % 6][1]]))
    whole = decontaminate.find_contamination(table(llm, texts), llm.createDataFrame(items, "item_id long, text string"))
    columns = ("doc_id", "item_id", "start_word", "similarity")
    want = sorted((tuple(r[c] for c in columns) for r in whole.collect()), key=str)
    assert {(d, i) for d, i, _, _ in want} == brute.leaks(list(enumerate(texts)), items)
    index = decontaminate.ItemIndex([(i, t) for i, t in items[:6]])
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    longest = max(len(w) for w in index.words) + 2 * decontaminate.SHIFT
    for text in texts:  # every run of the longest item's length lies in a piece
        pieces = list(decontaminate.word_pieces(text, 700, longest))
        assert len(pieces) > 1 and pieces[0][0] + [w for p, _ in pieces[1:] for w in p[longest:]] == text.encode().split()
        assert all(p == text.encode().split()[at : at + len(p)] for p, at in pieces)
    cut = index.matches(texts, decontaminate.WordHashes())
    assert [(d, index.ids[k], start) for d, found in enumerate(cut) for k, (_, start) in sorted(found.items())] == sorted(
        {(d, i, start) for d, i, start, _ in want if i is not None and i < 6}
    )


def test_blocks_find_all_within_radius():
    draw = np.random.default_rng(4)
    prints = draw.integers(0, 2**63, 200, dtype=np.uint64)
    index = decontaminate.BlockIndex(10, prints, np.arange(200), np.zeros(200, int), 1)
    queries = prints.copy()
    for i in range(200):
        for bit in draw.choice(64, i % 11, replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(bit)
    distance = np.bitwise_count(queries[:, None] ^ prints[None, :])
    want = set(zip(*map(list, np.nonzero(distance <= decontaminate.RADIUS)), strict=True))
    assert set(zip(*map(list, index.search(queries)), strict=True)) == want


# chat


def test_chat_round_trip(llm):
    from pyspark.sql import functions as F

    odd = ["", None, "\\", "<|end|>", "a<|next|>b", "\\<|", "|>\n", "<", "<\\|user|>", "$1 \\\\ x\n\n", "ü" * 3000]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(odd)]
    rows += [(2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, None, None, "x"), (None, 0, "system", "y")]
    rows += [(4, 0, "odd|>\nrole<|", "z")]
    chats = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = chat_format.format_conversations(chats)
    read = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in done.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert read[1] == [("user" if i % 3 else "assistant", t or "") for i, t in enumerate(odd)]
    assert read[2] == [("user", "a"), ("user", "a"), ("user", "b")]
    assert read[3] == [("", "x")] and read[None] == [("system", "y")] and read[4] == [("odd|>\nrole<|", "z")]
    text = {r["conv_id"]: r["formatted"] for r in done.collect()}
    assert text[2] == "<|user|>\na<|next|>a<|next|>b<|end|>"
    assert chat_format.format_conversations(chats.limit(0)).count() == 0
