"""URL filter, quality rules, decontamination, sharding: contracts, edge cases, brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lateweave.llm import decontamination, quality_rules, sharding, text_stats, url_filter

from .brute_leaks import coverage

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, row int, h string, _key string"


def docs(spark, *rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (None, "a b c d e f"), (5, "tie tie tie tie tie tie"), (5, "tie tie tie tie tie tie"), (6, "x" * 60_000 + " " + "long " * 9_000)]


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_stats_match_brute_force(spark):
    rows = [*ODD, (7, "a\nb\na\n\n\nb a"), (8, "p q r s t u p q r s t v p q r s t"), (9, "é# ünï*$ \x0b|<>&%"), (10, "a b c d e a b c d e")]
    for r in text_stats.with_stats(docs(spark, *rows)).join(docs(spark, *rows).select("doc_id", "text").distinct(), "doc_id").collect():
        assert tuple(r[c] for c in quality_rules.BASE) == brute_stats(r["text"]), r["doc_id"]



def test_learned_rules_reject_the_labelled_kind(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}y{k}###" for k in range(40))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, *good, *bad, (500, "short"), (501, None)), labels).collect()}
    assert all(judged[i]["kept"] for i, _ in good)
    assert not any(judged[i]["kept"] for i, _ in bad)
    assert judged[500]["base_failed"] and judged[501]["base_failed"] and not judged[501]["kept"]


def test_every_rule_is_precise_and_covers_in_order(spark):
    stats = text_stats.with_stats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labelled = quality_rules.label_rows(stats, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    found = quality_rules.fit(labelled)
    assert found.rules
    rows = labelled.withColumn("rule", found.rule_number()).select("bad", "rule", *[c.alias(f"f_{n}") for n, c in quality_rules.features().items()]).collect()
    # The list as plain Python conditions gives the same first rule everywhere.
    for r in rows:
        hit = next((k for k, rule in enumerate(found.rules, 1) if all((r[f"f_{c.feature}"] >= c.threshold) == c.at_least for c in rule)), None)
        assert hit == r["rule"]
    caught = [r for r in rows if r["rule"]]
    assert sum(r["bad"] for r in caught) >= 0.9 * len(caught) and sum(r["bad"] for r in caught) >= 0.7 * sum(r["bad"] for r in rows)


def plain_list(rows, edges, p):
    """Sequential covering in plain Python over (bad, grow, bins) rows."""
    n_features, rules, all_bad = len(edges), [], None
    meets = lambda b, c: (b[c[0]] > c[2]) == c[1]
    left = list(rows)
    while len(rules) < p.max_rules:
        conj = []
        while len(conj) < p.max_conditions:
            grow = [(bad, b) for bad, g, b in left if g and all(meets(b, c) for c in conj)]
            p0 = sum(bad for bad, _ in grow)
            n0 = len(grow) - p0
            all_bad = p0 if all_bad is None else all_bad
            if not p0 or not n0 or (conj and p0 >= p.enough * (p0 + n0)):
                break
            found = []
            for i in range(n_features):
                for k, up in enumerate((True, False)):
                    for e in range(len(edges[i])):
                        hit = [bad for bad, b in grow if meets(b, (i, up, e))]
                        pos, neg = sum(hit), len(hit) - sum(hit)
                        if pos >= max(p.min_covered, p.min_share * all_bad):
                            gain = pos * (math.log2(pos / (pos + neg)) - math.log2(p0 / (p0 + n0)))
                            if gain > 1e-9:
                                found.append((-gain, i, k, e, (i, up, e)))
            if not found:
                break
            # Floating sums of one gain may differ in the last bits.
            best = min(x[0] for x in found)
            conj.append(min(x[1:] for x in found if x[0] <= best * (1 - 1e-12))[-1])
        if not conj:
            break
        worth = []
        for k in range(1, len(conj) + 1):
            held = [bad for bad, g, b in left if not g and all(meets(b, c) for c in conj[:k])]
            worth.append((sum(held) / len(held) if held else 0.0, -k))
        precision, k = max(worth)
        if precision < p.min_precision:
            break
        rules.append(conj[:-k])
        left = [(bad, g, b) for bad, g, b in left if not all(meets(b, c) for c in conj[:-k])]
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_learner_matches_plain_sequential_covering(spark, seed):
    rng = random.Random(seed)
    p = quality_rules.FitParams(bins=8, min_precision=0.7)
    schema = "doc_id long, bad int, fold int, " + ", ".join(f"{c} long" for c in (*quality_rules.BASE, "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"))
    rows = []
    for i in range(900):
        v = {c: rng.randrange(1, 40) for c in (*quality_rules.BASE, "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")}
        odd = v["n_words"] < 12 and v["n_symbols"] > 20 or v["n_digits"] > 30 and v["word_chars"] < 20
        rows.append((i, int(odd != (rng.random() < 0.05)), rng.randrange(3), *v.values()))
    labelled = spark.createDataFrame(rows, schema)
    found = quality_rules.fit(labelled, p)
    names = list(quality_rules.features())
    x = labelled.select("bad", (F.col("fold") != 0).alias("grow"), *[c.alias(f"f_{n}") for n, c in quality_rules.features().items()])
    edges = quality_rules.cut_points(x.select("bad", "grow", F.array(*[f"f_{n}" for n in names]).alias("x")), p)
    binned = [(r["bad"], r["grow"], [sum(e <= r[f"f_{n}"] for e in edges[i]) for i, n in enumerate(names)]) for r in x.collect()]
    want = tuple(tuple(quality_rules.Condition(names[i], up, edges[i][e]) for i, up, e in rule) for rule in plain_list(binned, edges, p))
    assert any(len(r) > 1 for r in want)
    assert found.rules == want


def test_no_labels_no_rules(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(docs(spark, (1, "a " * 3 + "b c d e f g h i")), labels).first()["kept"]
    assert quality_rules.judge(spark.createDataFrame([], DOCS), labels).count() == 0


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.ORG/es/x?q=/a", "http://a.org", "no scheme", None, "", "x://h.com/de/1#f", "http://notorg/x", "https://org/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows, rules).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(8)] == [("www.example.org", "/es/x"), ("a.org", ""), ("", ""), ("", ""), ("", ""), ("h.com", "/de/1"), ("notorg", "/x"), ("org", "/")]
    assert [got[i]["rule"] for i in range(8)] == ["example.org/es/", None, None, None, None, "com/de/", None, "org/"]
    assert got[0]["verdict"] == "block" and got[7]["verdict"] == "allow" and got[3]["verdict"] == got[4]["verdict"] == "block"


def test_many_rules_are_joined(spark, monkeypatch):
    rng = random.Random(2)
    hosts = ["a.org", "b.a.org", "org", "x.com", "c.b.a.org", "notorg", ""]
    rules = [(rng.choice(["allow", "block"]), f"{rng.choice(['a.org', 'org', 'b.a.org', 'COM', 'x.com', 'rg'])}/{rng.choice(['', 'd', 'de/', 'de/1', 'f'])}") for _ in range(25)]
    rows = spark.createDataFrame([(h, p) for h in hosts for p in ("", "/", "/d", "/de/1/x", "/f?")], "host string, path string")
    one = {(r["host"], r["path"]): r["_rule"] for r in url_filter.with_rules(rows, rules).collect()}
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 10)
    many = url_filter.with_rules(rows, rules).collect()
    assert len(many) == rows.count() and {(r["host"], r["path"]): r["_rule"] for r in many} == one and sum(x is not None for x in one.values()) > 10


def test_url_models_tell_kinds_apart(spark):
    good = [f"http://n{i}.org/article/{i}" for i in range(80)]
    bad = [f"http://spam{i}.biz/win-casino-{i}" for i in range(80)]
    asked = ["http://q.net/article/5", "http://q.net/win-casino-5"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + asked + asked)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows, (("allow", "org/"), ("block", "biz/"))).collect()}
    assert len(got) == 164 and [got[i]["verdict"] for i in (160, 161, 162, 163)] == ["allow", "block", "allow", "block"]


def test_url_scores_match_plain_markov_models(spark):
    urls = [(f"ab{i % 7}c/{i % 3}", "allow" if i % 2 else "block") for i in range(30)] + [("zz", None)]
    m = url_filter.UrlModel(order=2, min_context=3)
    scored, _ = url_filter.url_scores(spark.createDataFrame([(u, v) for u, v in dict(urls).items()], "url string, label string"), m)
    grams = {"allow": Counter(), "block": Counter()}
    for u, v in dict(urls).items():
        if v and zlib.crc32(u.encode()) % 5:
            t = url_filter.PAD * 2 + u
            for i in range(2, len(t)):
                for k in range(3):
                    grams[v][t[i - k : i + 1]] += 1
    total = {v: Counter() for v in grams}
    for v, c in grams.items():
        for g, n in c.items():
            total[v][(len(g), g[:-1])] += n

    def p(v, context, ch):
        out = (grams[v][ch] + m.smoothing / m.alphabet) / (total[v][(1, "")] + m.smoothing)
        for k in (1, 2):
            s = context[-k:]
            if sum(total[x][(k + 1, s)] for x in total) >= m.min_context:
                out = (grams[v][s + ch] + m.smoothing * out) / (total[v][(k + 1, s)] + m.smoothing)
        return out

    for r in scored.collect():
        t = url_filter.PAD * 2 + r["url"]
        want = sum(math.log(p("allow", t[i - 2 : i], t[i]) / p("block", t[i - 2 : i], t[i])) for i in range(2, len(t))) / len(r["url"])
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-12)


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(none, (("allow", "org/"),)).count() == 0


ITEM = "Tom has 5 apples and gives 3 kg of them to Anna, how many does he have left over now?"


def test_leaks(spark):
    items = spark.createDataFrame([(9, ITEM), (10, None), (11, "too short"), (12, "")], "item_id long, text string")
    found = decontamination.find_leaks(
        docs(
            spark, *ODD, (20, "Before.\n" + ITEM.upper().lower() + " After."), (21, "Bob has 7 apples and gives 4 lbs of them to Mary, how many does he have left over now?"),
            (22, "Tom has 5 apples, and he likes them."), (23, ITEM), (23, ITEM), (24, "filler words " * 20_000 + ITEM),
        ), items,
    )
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {20, 21, 23, 24} and got[21]["changed"] and not got[23]["changed"]
    assert got[24]["first_word"] == 40_001
    left = decontamination.decontaminate(docs(spark, *ODD, (23, ITEM), (22, "Tom has 5 apples.")), items)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 22] and left.columns == ["doc_id", "text", "row", "h", "_key"]


def test_inconsistent_slots_are_no_leak(spark):
    items = spark.createDataFrame([(1, "from 4 to 9 then from 4 to 9 and back from 4 to 9 again and again")], "item_id long, text string")
    same, mixed = "from 3 to 8 then from 3 to 8 and back from 3 to 8 again and again", "from 1 to 2 then from 3 to 4 and back from 5 to 6 again and again"
    found = decontamination.find_leaks(docs(spark, (1, same), (2, mixed)), items)
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_one_edited_value_spoils_its_windows_alone(spark):
    item = "Anna paid 30 coins for the old red boat that was lying near the river and then she sold it again to a friend from the next village who gave her another 30 coins for it and was very happy with it"
    edited = item.replace("another 30", "another 45")
    other = item.replace("paid 30", "paid 12").replace("another 30", "another 45")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(docs(spark, (1, item), (2, edited), (3, "Once " + other)), items).collect()}
    assert set(got) == {1, 2, 3} and got[1]["coverage"] == 1 and not got[1]["changed"]
    words = len(item.split())
    # Only the edited words are not covered by another window.
    assert got[2]["covered_words"] == words - 1 and got[2]["changed"] and got[2]["first_word"] == 0
    assert got[3]["covered_words"] == words - 4 and got[3]["first_word"] == 4


def test_verbatim_copies_of_items_without_words_of_their_own(spark):
    texts = ["Evaluate 12 + 5 * 3 - 8 / 2", "we met Anna Bert Carl Dora Emil Frida Gustav Hanna Ida Jan Karl", "too short", "7 kg", "1 2 3 4 5 6 7 8 9 10"]
    items = spark.createDataFrame([*enumerate(texts), (8, "?!"), (9, None)], "item_id long, text string")
    rows = [(i, f"Some text before. {t} and some after it.") for i, t in enumerate(texts)]
    other = [(10, "Evaluate 13 + 5 * 3 - 8 / 2"), (11, "we met Anton Berta Carla Dieter Eva Fritz Greta Hans Inge Jo Kurt"), (12, "too very short"), (13, "8 kg"), (14, "2 3 1 5 4 7 6 9 8 10")]
    found = decontamination.find_leaks(docs(spark, *rows, *other, *ODD), items).collect()
    assert sorted((r["doc_id"], r["item"], r["coverage"], r["changed"]) for r in found) == [(i, i, 1.0, False) for i in range(5)]


def test_leaks_match_brute_force(spark):
    base, p = "/root/testdata/sf0.001", decontamination.LeakParams()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    items += [(10_000, "What is 5 plus 7?"), (10_001, ITEM), (10_002, "Evaluate 12 + 5 * 3 - 8 / 2"), (10_003, ITEM)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    rng = random.Random(9)
    for i in range(60):
        # An item among other words, some of its values replaced throughout or here and there.
        text = rng.choice(items)[1]
        for n in set(re.findall(r"\d+", text)):
            if rng.random() < 0.6:
                text = re.sub(rf"\b{n}\b", str(rng.randrange(100)), text, count=rng.choice([0, 1]))
        rows.append((20_000 + i, f"Some words before. {text} " + rng.choice(["And some after.", "", text])))
    found = decontamination.find_leaks(docs(spark, *rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item"]): (r["covered_words"], r["item_words"]) for r in found.collect()}
    want = {(i, j): c for i, t in rows for j, x in items if (c := coverage(t, x))[1] and c[0] >= c[1] * p.min_coverage}
    assert got == want and len(want) > 60


def test_what_is_five_plus_seven(spark):
    items = spark.createDataFrame([(1, "What is 5 plus 7?")], "item_id long, text string")
    found = decontamination.find_leaks(docs(spark, (1, "They ask: what is 5 plus 7? It is easy."), (2, "What is 5 plus 8?")), items)
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_no_leaks_in_empty_tables(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontamination.find_leaks(spark.createDataFrame([], DOCS), items).count() == 0
    assert decontamination.find_leaks(docs(spark, (1, ITEM)), items.limit(0)).count() == 0


def brute_shard(key, n):
    return max(range(n), key=lambda i: (-1 / math.log((int(__import__("hashlib").md5(f"{key}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13), -i))


def test_shards(spark):
    rows = [*ODD, *[(i, f"text {i}") for i in range(100, 400)]]
    got = sharding.place(docs(spark, *rows), [1.0] * 7).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == brute_shard(key, 7) and r["grown_shard"] == brute_shard(key, 8) and r["grown_shard"] in (r["shard"], 7)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by = {r["doc_id"]: r for r in got}
    assert by[1]["size"] == 16 and by[1]["text_crc32"] == 0 and by[4]["text_crc32"] == zlib.crc32(b"word")


def test_weighted_shards(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    n = Counter(r["s"] for r in ids.select(sharding.rendezvous(F.col("doc_id"), [1.0, 3.0, 0.0]).alias("s")).collect())
    assert set(n) == {0, 1} and 0.7 < n[1] / 4000 < 0.8
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


def test_no_rows_to_place(spark):
    assert sharding.place(spark.createDataFrame([], DOCS), [1.0, 1.0]).count() == 0
