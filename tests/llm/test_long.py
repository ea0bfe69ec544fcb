"""Every operator on very long texts: none may crash, cut them off or take a time that grows with the square of their length."""

import time

import pytest
from pyspark.sql import functions as F

from lateweave.llm import decontamination, language_id, line_dedup, maxent_lm, ngram_join, packing, quality_rules, sharding, text_stats, token_files, url_filter

LINE = "some words that make up a line of a very long text and go on and on for a while"
LONG = {
    1: " " * 2_000_000,
    2: "x" * 2_000_000,
    3: "word " * 300_000,
    4: "\n".join(f"{LINE} {i}" for i in range(20_000)),
    5: "\n".join([LINE] * 20_000),
    6: "1, 2 kg Anna. " * 60_000,
    7: "é漢🙂 " * 200_000,
}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in LONG.items()] + [(8, "a short one of eleven words that is kept here now", "en", "s", 5), (9, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


def within(seconds, f):
    began = time.time()
    out = f()
    assert time.time() - began < seconds
    return out


def test_stats(long_docs):
    got = {r["doc_id"]: r for r in within(120, lambda: text_stats.with_stats(long_docs).collect())}
    for i, t in LONG.items():
        w = t.split()
        assert got[i]["n_words"] == len(w) and got[i]["word_chars"] == sum(map(len, w))
    assert got[3]["n_repeat_words"] == 300_000 and got[5]["n_dup_lines"] == 19_999 and got[2]["n_repeat_words"] == 0


def test_quality(spark, long_docs):
    labels = spark.createDataFrame([(8, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in within(120, lambda: quality_rules.judge(long_docs, labels).collect())}
    assert kept == {1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True, 9: False}


def test_lines(long_docs):
    got = {r["doc_id"]: r["n_removed"] for r in within(120, lambda: line_dedup.dedup_lines(long_docs).collect())}
    # Three lines make a window; those from the second line on repeat the first.
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 19_999, 6: 0, 7: 0, 8: 0, 9: 0}


def test_join(long_docs):
    got = {r["doc_id"]: r["n_shingles"] for r in within(180, lambda: ngram_join.link_components(long_docs.union(long_docs.withColumn("doc_id", F.col("doc_id") + 10))).collect())}
    assert got[3] == 1 and got[2] == 1 and got[1] == 0 and got[4] > 100_000 and got[14] == got[4]


def test_leaks(spark, long_docs):
    items = spark.createDataFrame([(1, LINE), (2, "1, 2 kg Anna."), (3, "no such item in any of the texts here")], "item_id long, text string")
    got = {(r["doc_id"], r["item"]) for r in within(240, lambda: decontamination.find_leaks(long_docs, items).collect())}
    assert got == {(4, 1), (5, 1), (6, 2)}


def test_languages(spark, long_docs):
    model = within(120, lambda: language_id.fit(long_docs.union(spark.createDataFrame([(20, "das ist ein deutscher text", "de", "s", 1)], long_docs.schema))))
    got = {r["doc_id"]: r["lang_pred"] for r in within(120, lambda: language_id.predict(long_docs, model).collect())}
    assert got[1] == got[9] == "und" and got[4] == got[2] == "en"


def test_model(long_docs):
    got = {r["doc_id"]: r["n_tokens"] for r in within(240, lambda: maxent_lm.score(long_docs).collect())}
    assert got == {**{i: len(t.split()) + 1 for i, t in LONG.items()}, 8: 12, 9: 1}


def test_packing_and_counts(long_docs):
    counted = {r["doc_id"]: r["n_tokens"] for r in within(120, lambda: token_files.document_token_counts(long_docs).collect())}
    packed = {r["doc_id"]: r["n"] for r in within(120, lambda: packing.pack(long_docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect())}
    assert packed == {i: n + 1 for i, n in counted.items()} and counted[9] == 0 and counted[3] >= 300_000


def test_shards(long_docs):
    got = {r["doc_id"]: r["size"] for r in within(60, lambda: sharding.place(long_docs, [1.0] * 3).collect())}
    assert got == {**{i: len(t.encode()) + 16 for i, t in LONG.items()}, 8: 65, 9: 16}


def test_urls(spark):
    urls = [(1, "http://a.org/" + "x" * 300_000), (2, "http://" + "h" * 300_000), (3, "y" * 300_000), (4, "http://b.biz/" + "z/" * 100_000)]
    rows = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (len(r["host"]), len(r["path"])) for r in within(180, lambda: url_filter.judge_urls(rows, (("allow", "org/"), ("block", "biz/"))).collect())}
    assert got == {1: (5, 300_001), 2: (300_000, 0), 3: (0, 0), 4: (5, 200_001)}
