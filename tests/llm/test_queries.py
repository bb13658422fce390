"""The registered queries, their SQL twins and the pipeline."""

import corpus_pipeline
import pytest
from brute import groups, leaks, shares, words
from check import compare, connect
from pyspark.sql import functions as F
from tasteloom.llm.queries import QUERIES, SQL
from tasteloom.llm.words import prepare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), SQL[name], connect(sf)) is None


def test_registered():
    import __spark_entry__ as e

    assert {*QUERIES, "pipeline"} <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark, sf, tmp_path):
    prepare(spark)
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == first.columns
        tables.append(docs.collect())
    good, unique, clean, mixed, sharded = tables
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    fine = [i for i, v in labels.items() if v == (1, 0)]
    assert sum(i in kept for i in fine) > 0.95 * len(fine)
    found = groups([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"] for r in unique} == {i for i, (_, c) in found.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in unique], items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} - leaked
    size, taken = {}, {}
    for rows, out in ((clean, size), (mixed, taken)):
        for r in rows:
            out[r["source"]] = out.get(r["source"], 0) + len(words(r["text"]))
    for source, target in shares(size).items():
        longest = max(len(words(r["text"])) for r in clean if r["source"] == source)
        assert abs(taken.get(source, 0) - target) <= longest
    assert sorted(r["doc_id"] for r in sharded) == sorted(r["doc_id"] for r in mixed)


def test_stages_keep_texts_that_share_an_id(spark, tmp_path):
    prepare(spark)
    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    near = say(3).split()
    near[-1] = "other"
    rows = [(None, say(1)), (None, say(2)), (None, say(2)), (3, say(3)), (7, " ".join(near)), (7, say(4)), (8, say(4))]
    rows += [(9, say(5)), (9, say(6)), (9, say(7) + " " + say(8)), (10, say(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source", "1L n_chars")
    item = spark.createDataFrame([(0, say(8))], "item_id long, text string")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    unique = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = {(None, say(1)), (None, say(2)), (3, say(3)), (7, say(4)), (9, say(5)), (9, say(6)), (9, say(7) + " " + say(8))}
    found = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert len(found) == len(want) and set(found) == want
    clean = corpus_pipeline.decontamination(spark, unique, str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == want - {(9, say(7) + " " + say(8))}
    # one source: its target is its size, so each text is taken once
    mixed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()]
    assert sorted(mixed, key=str) == sorted(rows, key=str)


def test_stages_stand_odd_rows(spark, tmp_path):
    prepare(spark)
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "x " * 30, "en", "a", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("copies", F.lit(9))
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, folder).count()
