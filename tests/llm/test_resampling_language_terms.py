"""Importance resampling, language identification and the source audit, against plain versions and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tasteloom.llm import iceberg_terms, language_id, target_resampling
from tasteloom.llm.queries import QUERIES
from tasteloom.llm.words import prepare

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def llm(spark):
    return prepare(spark)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- resampling -----------------------------------------------------------------------------------------------


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in runs]


def drawn(docs, target):
    """[(doc_id, n_features, weight, score, rank)], null ids as empty and last among ties."""
    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    out = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(best[: 5 * len(best) // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in out), key=str)


def test_resampling_equals_plain_version(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    items = llm.read.parquet(f"{sf}/benchmark.parquet")
    found = QUERIES["op11_target_resampling"](llm, sf)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    want = drawn([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()])
    assert sorted(rows_of(found), key=str) == want and any(r[4] for r in want)


def test_resampling_odd_rows(llm, monkeypatch):
    long_text = " ".join(f"W{i % 977}-{i % 31}é" for i in range(20_000))
    texts = [None, "", " .,!\x00\x7f", "One", "one two", "Ünïcode ÀB ¿x 日本", "a b " * 10, "a b " * 10, long_text]
    docs = [(i, t) for i, t in enumerate(texts)] + [(6, "a b " * 10), (None, "z " * 30), (None, "y " * 30)]
    docs += [(100 + i, f"t{i} " * 25) for i in range(60)]
    frame = llm.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, weight int")
    target = llm.createDataFrame([("a b a b t3",), (None,)], "text string")
    monkeypatch.setattr(target_resampling, "PIECE", 500)  # runs go on across pieces
    found = rows_of(target_resampling.resample(frame, target))
    assert sorted(found, key=str) == drawn(docs, ["a b a b t3", None])
    assert rows_of(target_resampling.resample(frame.limit(0), target)) == []
    empty = target_resampling.resample(frame, target.limit(0))
    assert sorted(rows_of(empty), key=str) == drawn(docs, [])


def test_feature_windows_are_spans_of_the_text(monkeypatch):
    text = "Über-den  WOLKEN, 7 Meere."
    spans = target_resampling.feature_windows(text)
    said = Counter((re.sub(r"[^\x80-\U0010ffffa-z0-9]+", " ", ascii_lower(text[a:b])), c) for a, b, c in spans)
    words = ["Über", "den", "wolken", "7", "meere"]
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(6 - n)]
    assert said == Counter((f, zlib.crc32(f.encode())) for f in runs)
    monkeypatch.setattr(target_resampling, "PIECE", 4)
    assert target_resampling.feature_windows(text) == spans


# --- language -------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(llm, sf):
    docs = {r["doc_id"]: r for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op12_language_id"](llm, sf).collect()}
    assert found.keys() == docs.keys()
    fresh = [r for r in found.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found.values())
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in fresh]
    assert sum(right) >= 0.97 * len(right)
    scores = [r["score"] for r in fresh]
    assert all(0 <= s <= 1 for s in scores) and abs(sum(scores) / len(scores) - sum(right) / len(right)) < 0.15


def test_language_ignores_what_it_must_not_see(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    said = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    # the languages of held-out rows are unknown, and the source says nothing
    blind = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, null, lang) lang", "'q' source")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(blind).collect()} == said


def test_language_odd_rows(llm, monkeypatch):
    monkeypatch.setattr(language_id, "ROUNDS", 2)
    monkeypatch.setattr(language_id, "STEPS", 10)
    words = {"aa": "kala pata mala tana", "bb": "strong growth thick sprung"}
    rows = [(i, f"{words[k]} {i}", k, None) for k in words for i in range(60)]
    odd = [(None, None, "aa", "s"), (1, "", "bb", "s"), (2, "12 34 !?", "bb", None), (3, "kala mala", None, None)]
    odd += [(4, "strong " * 200_000, None, None), (4, "é", None, None), (4, "— 5", None, None)]
    docs = llm.createDataFrame(rows + odd, DOCS).selectExpr("*", "1 score", "'x' lang_pred", "true held_out")
    found = language_id.identify(docs).collect()
    assert len(found) == len(docs.collect()) and found[0].asDict().keys() >= {"doc_id", "held_out", "lang_pred", "score"}
    und = [r for r in found if r["lang_pred"] == "und"]
    assert sorted(str(r["doc_id"]) for r in und) == ["1", "2", "4", "None"]
    assert all(r["score"] == 0 and not r["accepted"] for r in und)
    assert next(r["held_out"] for r in found if r["doc_id"] is None)  # crc32 of an empty text is 0
    assert {r["lang_pred"] for r in found} == {"aa", "bb", "und"}
    assert language_id.identify(docs.limit(0)).collect() == []
    none = language_id.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = language_id.identify(docs.where("lang = 'aa'")).collect()
    assert {r["lang_pred"] for r in one} == {"aa", "und"}


def test_subwords_do_not_depend_on_the_cut(monkeypatch):
    text = ("Straße über den Fluß, caña y sol 42 x! " * 40).encode()
    whole = language_id.Bags()
    whole.add([text], [0])
    monkeypatch.setattr(language_id, "GROUP", 64)
    cut = language_id.Bags()
    cut.add([text], [0])
    assert (whole.rows[0][0] == cut.rows[0][0]).all() and abs(whole.rows[0][1] - cut.rows[0][1]).max() < 1e-7
    plain = Counter()
    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower()):
        for n in language_id.SIZES:  # a border on either side
            plain[n] += max(0, len(word) + 2 - n + 1)
    found = {n: len(f) for n, (f, _) in zip(language_id.SIZES, language_id.subwords([text]), strict=True)}
    assert found == dict(plain)


# --- terms ----------------------------------------------------------------------------------------------------


def audit(docs, least=3, top=200):
    docs = [(text or "", lang or "", source or "") for _, text, lang, source in docs]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t)) for t, _, _ in docs]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), found in zip(docs, terms, strict=True):
        held[lang].update(set(found))
        count[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in held[lang].items() if n >= least}

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1000000000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            more = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def test_terms_odd_rows(llm, monkeypatch):
    monkeypatch.setattr(iceberg_terms, "PIECE", 400)
    monkeypatch.setattr(iceberg_terms, "MEMO", 10)
    monkeypatch.setattr(iceberg_terms, "BLOCK_TERMS", 20)
    giant = "Ab" * 3000
    rows = [(i, f"Alpha alphabet ALPHABETS x{i % 4} é éa éab {'zeta ' * (i % 7)}", "en", f"s{i % 3}") for i in range(20)]
    rows += [(i, f"{giant} {'y' * (i + 1)}", "de", f"s{i % 2}") for i in range(4)]
    rows += [(9, None, "en", "s9"), (9, "", None, None), (9, "only two", "fr", "a"), (9, "only two", "fr", "b")]
    rows += [(None, "null id", "en", None), (None, "null id", "en", None), (7, " ".join(f"w{i % 50}q" for i in range(3000)), "en", "s1")]
    docs = llm.createDataFrame(rows, DOCS).selectExpr("*", "'x' item", "1 rank", "'p' part", "2 n", "'t' term", "3 prefix")
    found = sorted(rows_of(iceberg_terms.audit_sources(docs)))
    assert found == audit(rows)
    assert dict(iceberg_terms.audit_sources(docs).dtypes) == {
        "lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"
    }
    assert sorted(rows_of(iceberg_terms.audit_sources(docs, 2, 3))) == audit(rows, 2, 3)
    assert rows_of(iceberg_terms.audit_sources(docs.limit(0))) == []


def test_a_crowded_bitmap_keeps_the_same_terms(llm, sf, monkeypatch):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    lists = iceberg_terms.term_lists(docs)
    want = sorted(rows_of(iceberg_terms.kept_terms(lists)))
    monkeypatch.setattr(iceberg_terms, "MAX_BITS", 1 << 8)
    assert sorted(rows_of(iceberg_terms.kept_terms(lists))) == want
