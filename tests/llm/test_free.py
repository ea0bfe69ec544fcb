"""N-gram join, LM scoring, language id, line dedup, packing, token files, components: brute force and edge cases."""

import dataclasses
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lateweave.llm import common, connected, encoders, language_id, line_dedup, maxent_lm, ngram_join, packing, token_files, word_hash

from .brute_lines import dedup
from .test_native import DOCS, ODD, WORD, docs


def lowered(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]


def test_word_hashes_depend_on_words_alone():
    long = "q" * 300_000
    a, tail = word_hash.word_hashes(f"Ab c\tAB {long} é")
    b, _ = word_hash.word_hashes(f"{' ' * 262_100}ab\n{long}   é c")
    assert a[0] == a[2] == b[0] and a[3] == b[1] and a[4] == b[2] and a[1] == b[3] and len(set(a.tolist())) == 4
    assert word_hash.word_hashes(None)[0].size == word_hash.word_hashes(" \n")[0].size == 0 and tail[1] == ord("c")


@pytest.fixture
def nothing_broadcast(monkeypatch):
    for m in (common, connected, ngram_join):
        monkeypatch.setattr(m, "BROADCAST_BYTES", -1)


def test_components_by_shuffles_alone(spark, nothing_broadcast):
    test_components(spark)


def test_near_duplicates_by_shuffles_alone(spark, nothing_broadcast):
    test_near_duplicates_match_brute_force(spark, 1, (8,))


def test_lines_by_shuffles_alone(spark, nothing_broadcast):
    test_lines_match_brute_force(spark)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (200, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected.components(edges.limit(0)).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = lowered(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    name = {}
    for i, (k, _) in enumerate(rows):
        name.setdefault(find(i), []).append(k)
    return [(k, len(sets[i]), min((x for x in name[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)]


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out, bases = [], [[word() for _ in range(rng.choice([3, 5, 30, 60, 120]))] for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    passage = [word() for _ in range(40)]
    return out + [(1000 + i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(i)])) for i in range(40)]


@pytest.mark.parametrize("seed,chain", [(1, (8,)), (2, (1,)), (3, (2, 2))])
def test_near_duplicates_match_brute_force(spark, seed, chain):
    rows = [*ODD, *near_copies(seed)]
    p = ngram_join.JoinParams(sample=2, frequent=3, chain=chain, block=8)
    got = ngram_join.link_components(docs(spark, *rows), params=p).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows))


def test_no_documents_to_join(spark):
    assert ngram_join.link_components(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (2, 3, 7, 12, 20, 30, 49, 50, 51, 70)]
    rows = [(i, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, *rows)).collect()}
    assert got == dedup(rows)
    again = line_dedup.dedup_lines(docs(spark, *[(i, t) for i, t in got.items()]))
    assert sum(r["n_removed"] for r in again.collect()) <= sum(t != got[i] for i, t in rows) * 12


def test_line_edge_cases(spark):
    rows = [*ODD, (6, "x" * 60_000 + " " + "long " * 9_000), (None, "v " * 60 + "\nend"), (None, "v " * 60 + "\nend"), (9, "v " * 60 + "\nend"), (8, "v " * 60 + "\nend\n" + "v " * 60)]
    out = line_dedup.dedup_lines(docs(spark, *rows))
    assert out.columns == ["doc_id", "text", "row", "h", "_key", "n_removed"]
    got = Counter((r["doc_id"], r["n_removed"]) for r in out.collect())
    # 8 repeats its own first line, 9 repeats 8; rows of one key, and of none, leave each other alone.
    assert got[8, 1] == 1 and got[9, 2] == 1 and got[None, 0] == 3 and got[6, 0] == 2 and got[1, 0] == 1
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


LONG = [" " * 3_000_000, "a" * 3_000_000, "é" * 1_000_000, "x " * 600_000 + "<|endoftext|>" + " y\n\n z" * 100_000, " \n" * 600_000 + "w"]


def test_ids_are_those_of_the_tokenizers_library():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.TOKENIZER)
    for text in ["", "Hello  world\n\n\tx", "été ß 漢字 🙂", "1234.5 don't", "a" * 5000, "  trailing  ", "a <|endoftext|> b", "<|endoftext|>", *LONG]:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_both_tokenizer_libraries_agree_on_every_character():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranked = encoders.encoder("byte_bpe_50k.tiktoken")
    for i in range(1, 0x110000, 1 << 15):
        text = "".join(f"a{c}1 {c}{c}.{c}\n{c} b'{c}s" for c in map(chr, range(i, min(i + (1 << 15), 0x110000))) if not "\ud800" <= c <= "\udfff")
        assert ranked(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_parts_make_up_the_text():
    for text in ["", "a b c d", "  a  b\n", "abcdefgh i", "a" * 30]:
        assert "".join(encoders.parts(text, 3)) == text
    assert list(encoders.parts("ab cd ef", 4)) == ["ab", " cd", " ef"]


def test_very_long_texts_and_special_strings_are_packed_and_counted(spark):
    rows = [(i, t) for i, t in enumerate([*LONG, "a <|endoftext|> b", None])]
    ids = packing.encoder(packing.TOKENIZER)
    lengths = {r["doc_id"]: r["n"] for r in packing.pack(docs(spark, *rows)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    counted = {r["doc_id"]: r["n_tokens"] for r in token_files.document_token_counts(docs(spark, *rows)).collect()}
    assert counted == {i: len(ids(t or "")) for i, t in rows} and lengths == {i: n + 1 for i, n in counted.items()}


def test_packing_laws(spark):
    rng = random.Random(3)
    rows = [*ODD, *[(100 + i, "word " * rng.randrange(1, 900)) for i in range(200)]]
    packed = packing.pack(docs(spark, *rows), capacity=256, bucket=64, keep_ids=True).collect()
    ids = packing.encoder(packing.TOKENIZER)
    want = Counter()
    for k, t in rows:
        x = np.append(ids(t or ""), 0).astype("<u4")
        first = len(x) % 256 or min(256, len(x))
        for piece, (a, b) in enumerate(zip([0, *range(first, len(x), 256)], [*range(first, len(x) + 1, 256)])):
            want[k, piece, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = {}
    for r in packed:
        assert len(r["ids"]) == r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    least = sum(r["length"] for r in packed) / 256
    assert len(bins) <= least * 1.05 + 8


def test_two_smaller_replace_the_smallest():
    # Greedy: 10 + 5 leaves 1; 5 goes out for 4 + 2, which fill 16.
    assert sorted(map(sorted, ([[10, 5, 4, 2][i] for i in b] for b in packing.pack_lengths([10, 5, 4, 2], 16)))) == [[2, 4, 10], [5]]


@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths_keeps_everything(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(300))]
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 64 for b in bins)


def test_sequences_and_empty_packing(spark):
    packed = packing.pack(docs(spark, *ODD[:5]), keep_ids=True)
    assert packing.sequences(packed).first()["ids"].count(0) == 5
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_token_file_round_trip(spark, tmp_path):
    counts = token_files.document_token_counts(docs(spark, *ODD, *[(50 + i, "some words " * i) for i in range(40)]), block_bytes=64)
    ids = packing.encoder(token_files.TOKENIZER)
    want = Counter((k, len(ids(t or ""))) for k, t in [*ODD, *[(50 + i, "some words " * i) for i in range(40)]])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counts.collect()) == want
    assert token_files.document_token_counts(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block", [2, 6, 10, 1000])
def test_scan_matches_plain_split(spark, tmp_path, block):
    rng = random.Random(block)
    files = {"a": [rng.choice([0, 1, 2, 3]) for _ in range(57)], "b": [0, 0, 0], "c": [5, 6, 7], "d": [], "e": [9] * 40 + [0]}
    for name, x in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(x, "<u2").tobytes())
    got = token_files.scan(token_files.flat_files(spark, str(tmp_path)), end_id=0, block_bytes=block).collect()
    want = set()
    for name, x in files.items():
        start = number = 0
        for i, v in enumerate(x):
            if v == 0:
                want.add((name, number, start, i - start, True))
                start, number = i + 1, number + 1
        if start < len(x):
            want.add((name, number, start, len(x) - start, False))
    assert {(r["path"].split("/")[-1][0], r["number"], r["start"], r["n_tokens"], r["closed"]) for r in got} == want and len(got) == len(want)


def test_odd_file_length_is_an_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no multiple of the token width"):
        token_files.scan(token_files.flat_files(spark, str(tmp_path))).count()


def test_language_counts_and_scores_match_plain_version(spark):
    p = language_id.LanguageParams(buckets=64, orders=(1, 2))
    texts = [("abab cd", "x"), ("éa é", "y"), ("b", "x"), ("", "y")]
    m = language_id.fit(spark.createDataFrame([(t, v) for t, v in texts] + [(None, "x"), ("q", None)], "text string, lang string"), params=p)
    counts = np.zeros((64, 2))
    for t, v in texts:
        codes = np.array([ord(c) for c in t.lower()], np.uint32)
        for order in p.orders:
            for g in language_id._ngrams(codes, order, 64) if len(codes) >= order else ():
                counts[g, m.languages.index(v)] += 1
    want = np.log((counts + p.alpha) / (counts + p.alpha).sum(0))
    assert m.languages == ["x", "y"] and np.allclose(m.weights, want, atol=1e-5) and np.allclose(m.prior, np.log([0.5, 0.5]))
    m = dataclasses.replace(m, prior=np.log([0.9, 0.1]))
    asked = ["abcd", "é", None, "123 !", ""]
    got = language_id.predict(spark.createDataFrame([(i, t, "z") for i, t in enumerate(asked)], "doc_id long, text string, lang string"), m).orderBy("doc_id").collect()
    for r, t in zip(got, asked):
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        codes = np.array([ord(c) for c in t], np.uint32)
        rows = np.concatenate([language_id._ngrams(codes, o, 64) for o in p.orders if len(codes) >= o])
        odds = want[rows].sum(0) + m.prior
        odds = np.exp(odds - odds.max())
        assert r["lang_pred"] == m.languages[int(odds.argmax())] and math.isclose(r["score"], odds.max() / odds.sum(), rel_tol=1e-4)


def test_language_sums_do_not_depend_on_how_much_is_gathered(spark, monkeypatch):
    p = language_id.LanguageParams(buckets=256)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (0, 1, 2, 3, 50, 400, 3000)]
    m = language_id.LanguageModel(["x", "y"], np.array([[rng.random() for _ in "xy"] for _ in range(256)], np.float32), np.log([0.3, 0.7]), p)
    whole = language_id._likelihoods(m, texts)
    monkeypatch.setattr(language_id, "_GATHER", 14)
    monkeypatch.setattr(language_id, "_CHUNK", 64)
    assert np.allclose(language_id._likelihoods(m, texts), whole)


def test_many_languages_share_a_smaller_matrix(spark):
    rows = spark.createDataFrame([(f"{chr(97 + i % 26)}{i} " * 20, f"l{i:03}") for i in range(130)] * 2, "text string, lang string")
    m = language_id.fit(rows, params=language_id.LanguageParams(max_cells=1 << 14))
    assert m.weights.shape == (64, 130) and np.allclose(np.exp(m.weights).sum(0), 1, atol=1e-4)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(rows, params=language_id.LanguageParams(max_cells=1 << 12))


def test_language_accuracy_on_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = language_id.predict(rows.where(held), language_id.fit(rows.where(~held)), keep=("doc_id", "lang"))
    hit, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert hit >= 0.97 * n


def test_language_edge_cases(spark):
    none = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    out = language_id.predict(docs(spark, *ODD), none).collect()
    assert len(out) == len(ODD) and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out)
    assert language_id.predict(spark.createDataFrame([], DOCS), none).count() == 0


def test_lm_base_is_exact_and_the_model_beats_it(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    got = maxent_lm.score(docs(spark, *rows), params=maxent_lm.LmParams(held_counts=500)).collect()
    tokens = lambda t: [*lowered(t), None]
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for k, t in rows:
        w = tokens(t)
        want[k, held(k), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lm_distribution_sums_to_one(spark):
    """Over all known words and one unseen word for each suffix class, after some history."""
    rows = docs(spark, *[(i, "a b c a b d e f g " * 3) for i in range(8)])
    p = maxent_lm.LmParams(frequent_classes=2, class_words=2, suffix_classes=4, held_counts=100)
    counts = maxent_lm.count_words(rows, p)
    m = maxent_lm.train(rows, counts, p)
    history = word_hash.word_hashes("a b")[0]
    words = m.held
    total = 0.0
    seen = {int(h): int(c) for h, c in zip(m.held, m.held_c)}
    with np.errstate(over="ignore"):
        for w in [*words, *[np.uint64(1 << 40 | s) for s in range(p.suffix_classes)]]:
            first = [h for h, _, _, _ in maxent_lm._chunks(["a b"], p)][0][:2]
            h = np.append(first, w)
            cls, place, features = maxent_lm._contexts(m, h, np.zeros(3, np.int64))
            value = maxent_lm._log10_prob(m.class_base, m.by_class, maxent_lm._rows(features, p), cls)[2]
            if place[2] >= 0:
                value += maxent_lm._log10_prob(m.word_base[cls[2:]], m.by_word, maxent_lm._rows(features[:, 2:], p, cls[2:]), place[2:])[0]
            else:
                value += math.log10(seen.get(int(w), 0) + 0.5) - m.suffix_norm[int(w) & 63] / math.log(10)
            total += 10**value
    assert len(history) == 2 and math.isclose(total, 1.0, abs_tol=1e-3)


SMALL = maxent_lm.LmParams(frequent_classes=2, class_words=3, suffix_classes=4, buckets=32, held_counts=100, start_smoothing=2.0, smoothing=5.0, rounds=2)


def test_lm_training_matches_a_plain_trainer(spark):
    """Observed and expected counts position by position, in plain loops over words."""
    p, texts = SMALL, ["a b c a b d e f g a b c", "b a c d a b", None, "x y z a b c", "a b c a b c a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = maxent_lm.count_words(rows, p)
    start, got = maxent_lm._start(counts, p), maxent_lm.train(rows, counts, p)
    positions = []
    for t in texts:
        h, doc, _, _ = next(maxent_lm._chunks([t], p))
        cls, place, features = maxent_lm._contexts(start, h, doc)
        plain, by = maxent_lm._rows(features, p), maxent_lm._rows(features, p, cls)
        positions += [(int(c), int(w), list(map(int, plain[:, i])), list(map(int, by[:, i]))) for i, (c, w) in enumerate(zip(cls, place))]
    classes = len(start.class_base)
    tables = [[[0.0] * classes for _ in range(p.buckets)], [[0.0] * p.class_words for _ in range(p.buckets)]]

    def softmax(base, rows_of_table):
        x = [b + sum(r[i] for r in rows_of_table) for i, b in enumerate(base)]
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    bases = [[[math.exp(b) + 1e-12 for b in start.class_base]] * p.buckets, None]
    for turn in range(p.rounds + 1):
        seen = [[[0.0] * len(t[0]) for _ in t] for t in tables]
        wanted = [[[0.0] * len(t[0]) for _ in t] for t in tables]
        for c, w, plain, by in positions:
            q = softmax(start.class_base, [tables[0][r] for r in plain])
            for r in plain:
                seen[0][r][c] += 1
                wanted[0][r] = [x + y for x, y in zip(wanted[0][r], q)]
            if w >= 0:
                q = softmax(start.word_base[c], [tables[1][r] for r in by])
                for r in by:
                    seen[1][r][w] += 1
                    wanted[1][r] = [x + y for x, y in zip(wanted[1][r], q)]
        if turn == 0:
            bases[1] = [[(x / sum(r) if sum(r) else 1 / p.class_words) + 1e-9 for x in r] for r in wanted[1]]
        rate, extra = (p.start_rate, p.start_smoothing) if turn == 0 else (p.rate, p.smoothing)
        for t, o, e, base in zip(tables, seen, wanted, bases):
            for r in range(p.buckets):
                t[r] = [x + rate * math.log((a + extra * b) / (d + extra * b)) for x, a, d, b in zip(t[r], o[r], e[r], base[r])]
    assert np.allclose(got.by_class, tables[0], atol=2e-4) and np.allclose(got.by_word, tables[1], atol=2e-4)
    assert np.abs(got.by_class).max() > 0.1 and np.abs(got.by_word).max() > 0.1


def test_lm_counts_every_position(spark):
    rows = docs(spark, *[(i, " ".join(f"w{(i * 200 + k) % 1500}" for k in range(900))) for i in range(8)])
    p = maxent_lm.LmParams()
    m = maxent_lm._start(maxent_lm.count_words(rows, p), p)
    assert len(m.words) == 1501  # every word and the end are modelled word by word
    width = m.by_class.shape[1] + p.class_words + p.frequent_classes
    whole = maxent_lm._gathered(rows.select("text"), maxent_lm._observed(spark.sparkContext.broadcast(m)), (p.buckets, width), np.int64)
    assert whole[:, : m.by_class.shape[1]].sum() == whole[:, m.by_class.shape[1] : -p.frequent_classes].sum() == 4 * m.tokens == 4 * 8 * 901
    expected = maxent_lm._gathered(rows.select("text"), maxent_lm._expected(spark.sparkContext.broadcast(m)), (p.buckets, width - p.frequent_classes), np.float32)
    assert math.isclose(expected[:, : m.by_class.shape[1]].sum(dtype=np.float64), 4 * m.tokens, rel_tol=1e-4)


@pytest.mark.parametrize("n,width,top", [(1, 3, 1), (7, 2, 3), (500, 5, 4), (300, 1, 300)])
def test_lm_segment_sums(n, width, top):
    rng = np.random.default_rng(n)
    values, rows = rng.random((n, width)), rng.integers(0, top, (4, n))
    at, sums = maxent_lm._segment_sums(values, rows)
    want = np.zeros((top, width))
    for r in rows:
        np.add.at(want, r, values)
    assert sorted(at.tolist()) == sorted(set(rows.ravel().tolist())) and np.allclose(sums, want[at])


def test_lm_models_equally_frequent_words_up_to_its_size(spark):
    """More words of one count than workers hold: those with the smaller hashes are held and modelled all the same."""
    rows = docs(spark, *[(i, " ".join(f"w{k}" for k in range(150))) for i in range(12)])
    p = maxent_lm.LmParams(frequent_classes=4, class_words=8, suffix_classes=4, buckets=64, held_counts=100)
    counts = maxent_lm.count_words(rows, p)
    m = maxent_lm._start(counts, p)
    by_rank = sorted((-r["c"], r["h"] % 2**64) for r in counts.collect())
    assert len(by_rank) == 151 and m.held.tolist() == sorted(h for _, h in by_rank[:100]) and m.words.tolist() == sorted(h for _, h in by_rank[:32])


def test_lm_every_pair_of_words_counts(spark, monkeypatch):
    """What pairs of words add to a score, text by text, against plain counts; by parcels of few documents."""
    monkeypatch.setattr(maxent_lm, "_PARCEL_DOCS", 3)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:9], *(f"{t} unseen{i}" for i, t in enumerate(texts[:9])), "", None])]
    p = maxent_lm.LmParams(frequent_classes=2, class_words=3, suffix_classes=4, buckets=32, held_counts=20, unigram_counts=3.0, chunk=300)
    frame, held = docs(spark, *rows), {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    learn = spark.createDataFrame([(i, t) for i, t in rows if not held[i]], "doc_id long, text string")
    m = maxent_lm._start(maxent_lm.count_words(learn, p), p)
    frequent, tokens = set(m.words.tolist()), {i: next(maxent_lm._chunks([t], p))[0].tolist() for i, t in rows}
    pairs = {i: [(a, b) for a, b in zip([None, *t], t) if b not in frequent] for i, t in tokens.items()}
    c, both, after = Counter(), Counter(), Counter()
    for i in (i for i, _ in rows if not held[i]):
        for a, b in pairs[i]:
            c[b] += 1
            both[a, b] += 1
            after[a, b & 63] += 1

    def added(a, b):
        u = 3 * (c[b] + 0.5) / math.exp(m.suffix_norm[b & 63])
        return math.log10((both[a, b] + u) / (after[a, b & 63] + 3) / (u / 3))

    # In a class after a word the probabilities of all words, and of an unseen one, are 1.
    for a, s in [*after][:40]:
        words = [w for w in c if w & 63 == s]
        assert math.isclose(sum((both[a, w] + 3 * x) / (after[a, s] + 3) for w, x in [*((w, (c[w] + 0.5) / math.exp(m.suffix_norm[s])) for w in words), (0, 0.5 / math.exp(m.suffix_norm[s]))]), 1)
    score = lambda q: {r["doc_id"]: r["score"] for r in maxent_lm.score(frame, params=q).collect()}
    got, plain = score(p), score(dataclasses.replace(p, unigram_counts=1e15))
    assert got.keys() == held.keys() and len(c) > 200 and any(both[x] > 1 for i in got if held[i] for x in pairs[i])
    assert all(math.isclose(got[i] - plain[i], sum(added(a, b) for a, b in pairs[i]), abs_tol=1e-3) for i in got)


def test_lm_gains_by_pairs_of_words(spark):
    """Words beyond the softmaxes are scored after the word before: held-out texts gain by it (0.34 a token without)."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = [r for r in maxent_lm.score(rows).collect() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.5


def test_lm_scores_do_not_depend_on_the_partitioning(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r for r in maxent_lm.score(rows.repartition(n, "doc_id")).collect()} for n in (1, 16))
    assert one.keys() == many.keys() and all(math.isclose(one[k]["score"], many[k]["score"], rel_tol=1e-4, abs_tol=1e-3) for k in one)
    held = [r for r in one.values() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.33


def test_lm_takes_very_long_texts(spark):
    rows = docs(spark, (1, "many words of a very long text " * 60_000), (2, "x" * 2_000_000), (3, "short"))
    got = {r["doc_id"]: r for r in maxent_lm.score(rows).collect()}
    assert got[1]["n_tokens"] == 420_001 and got[2]["n_tokens"] == 2 and all(math.isfinite(r["score"]) for r in got.values())


def test_no_documents_to_score(spark):
    assert maxent_lm.score(spark.createDataFrame([], DOCS)).count() == 0


def test_pattern_of_words():
    assert re.findall(WORD, "a\u00a0b c") == ["a\u00a0b", "c"]
