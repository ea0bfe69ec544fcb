"""The pipeline against brute-force versions of its stages."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lateweave.llm import packing, quality_rules

from .brute_lines import dedup
from .test_free import brute_components
from .test_native import WORD

DATA = "/root/testdata/sf0.001"


def plain(text):
    """Template words where neither side has numbers or names inside sentences that matter: lower case, no punctuation."""
    return [w for w in (re.sub(r"[\W_]+", "", x).lower() for x in WORD.findall(text)) if w]


def leaked(text, item):
    """Share of an item's words inside windows of 8 words that the text has too."""
    t, b = plain(text), plain(item)
    size = min(8, len(b))
    have = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
    covered = {k for i in range(len(b) - size + 1) if tuple(b[i : i + size]) in have for k in range(i, i + size)}
    return len(covered) / len(b) if b else 0.0


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if judged[r["doc_id"]]]
    before = dict(left)
    left = [(k, t) for k, t in dedup(left).items() if t == before[k] or WORD.search(t)]
    left = [(k, t) for (k, t), (_, _, name) in zip(left, brute_components(left)) if k == name]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = [(k, t) for k, t in left if not any(leaked(t, b) >= 0.5 for b in items)]
    encode = packing.encoder(packing.TOKENIZER)
    want = Counter()
    for k, t in left:
        x = np.append(encode(t), 0).astype("<u4")
        first = len(x) % 2048 or 2048
        for piece, (a, b) in enumerate(zip([0, *range(first, len(x), 2048)], range(first, len(x) + 1, 2048))):
            want[k, piece, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, " \n", None, "s", 2)], base.schema)
    for rows in (base.limit(20).unionByName(odd), base.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, DATA)
            assert out.columns == base.columns, name
            assert out.count() <= rows.count()


def test_stages_decide_by_row(spark):
    """Null, repeated and conflicting ids: a row goes for its own text alone, and one row of every component stays."""
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r["doc_id"]: r["text"] for r in quality_rules.judge(base, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").join(base.select("doc_id", "text"), "doc_id").collect()}
    texts = [t for t in good.values() if len(t.split()) > 40][:6]
    row = lambda i, t, s="s": (i, t, "en", s, len(t or ""))
    rows = [row(i, t) for i, t in good.items()]
    extra = [row(10**9, texts[0] + " tail"), row(10**9, "too short"), row(None, "too short"), row(None, None), row(10**9 + 1, "a lone text " + " ".join(f"q{k}" for k in range(60)), "b")]
    extra += [row(10**9 + 1, "a lone text " + " ".join(f"q{k}" for k in range(60)), s) for s in "cab"] + [row(None, "nobody's text " + " ".join(f"z{k}" for k in range(60)))] * 3
    docs = spark.createDataFrame(rows + extra, base.schema)
    judged = corpus_pipeline.quality_rules(spark, docs, DATA)
    keys = Counter((r["doc_id"], r["text"]) for r in judged.collect())
    # The rules may be others with further rows, but a verdict follows the text.
    verdict = {r["text"]: r["kept"] for r in quality_rules.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).join(docs.select("doc_id", "text").distinct(), "doc_id").where("th = xxhash64(text)").collect()}
    assert keys == Counter((i, t) for i, t, *_ in rows + extra if t is not None and verdict.get(t, t.startswith("nobody")))
    assert (10**9, "too short") not in keys and (None, "too short") not in keys and (None, None) not in keys

    left = Counter(tuple(r) for r in corpus_pipeline.ngram_jaccard(spark, docs, DATA).collect())
    components = {}
    for (i, t), (_, n, name) in zip([x[:2] for x in rows + extra], brute_roots([x[:2] for x in rows + extra])):
        components.setdefault(name, []).append((i, t))
    assert sum(left.values()) == len(components)
    chosen = Counter((i, t) for i, t, *_ in left.elements())
    for members in components.values():
        least = min((i for i, _ in members if i is not None), default=None)
        assert sum(chosen[m] for m in {m for m in members if m[0] == least}) >= 1
    assert left[row(10**9 + 1, "a lone text " + " ".join(f"q{k}" for k in range(60)), "a")] == 1
    assert chosen[None, "nobody's text " + " ".join(f"z{k}" for k in range(60))] == 1 and chosen[None, None] == 1


def brute_roots(rows):
    """As brute_components(), with the position of a component's first row for its name."""
    return [(k, n, name) for (k, _), (_, n, name) in zip(rows, brute_components([(i, t) for i, (_, t) in enumerate(rows)]))]


def test_registered():
    queries = __spark_entry__.queries()
    assert "pipeline" in queries and {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", q)[0] for q in queries if q.startswith("op")}
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_ngram_jaccard_join", "op9_rendezvous_sharding"])
def test_matches_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    show = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert show(df.select(*columns).collect()) == show(con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
