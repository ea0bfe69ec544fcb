"""Learned decision lists for document quality (DataFrame functions only).

Sequential covering: each rule is a conjunction of threshold conditions over
text statistics, grown condition by condition on two thirds of the labelled
documents (information gain of the rejected class), pruned on the other third,
and removed from the data together with what it covers before the next rule is
grown. The result is an ordered list of Spark conditional expressions.

The data never leave Spark: a growing step is one aggregation that counts
labels by (feature, bin), a few hundred rows whatever the corpus size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .text_stats import with_stats

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features() -> dict[str, Column]:
    """Feature name -> expression over the columns of with_stats(); 0 where the denominator is 0."""

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "distinct_word_share": per("n_distinct", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


def base_failed() -> Column:
    """Too short, or more than a fifth of the words inside repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.threshold) if self.at_least else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document matching any is rejected by the first that matches."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def rule_number(self) -> Column:
        """1-based number of the first matching rule; null if none matches."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(reduce(lambda a, b: a & b, (c.column() for c in self.rules[k - 1])), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) or "keep all"


@dataclass(frozen=True)
class FitParams:
    bins: int = 32
    max_rules: int = 8
    max_conditions: int = 3
    #: A rule is kept if at least this share of the pruning documents that it matches carry the rejected label.
    min_precision: float = 0.9
    #: ... and if it covers this many rejected growing documents, and this share of all of them.
    min_covered: int = 5
    min_share: float = 0.002
    #: Growing stops at this precision.
    enough: float = 0.995


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def cut_points(rows: DataFrame, params: FitParams) -> list[list[float]]:
    """The thresholds tried for each feature: quantiles of the array column ``x``; no feature if there are no rows."""
    n, steps = len(features()), [i / params.bins for i in range(1, params.bins)]
    at = rows.agg(*[F.percentile_approx(F.col("x")[i], steps, 10_000).alias(f"q{i}") for i in range(n)]).first()
    if at is None or at["q0"] is None:
        return []
    # For a feature that is 0 almost everywhere all quantiles can be 0: "more than the minimum" stays possible through the next value.
    least = rows.agg(*[F.min(F.when(F.col("x")[i] > at[f"q{i}"][-1], F.col("x")[i])).alias(f"m{i}") for i in range(n)]).first()
    return [sorted({*at[f"q{i}"], *([least[f"m{i}"]] if least[f"m{i}"] is not None else [])}) for i in range(n)]


def fit(labelled: DataFrame, params: FitParams = FitParams()) -> DecisionList:
    """Learn the list from labelled statistics.

    labelled: the columns of with_stats(), ``bad`` (1: to reject, 0: to keep)
    and ``fold`` (0: prune, else grow). Rows with a null ``bad`` are left out.
    Without both labels there is no rule. Equal gains: the feature first in
    features(), then >= before <, then the smaller threshold.
    """
    names = list(features())
    rows = labelled.where(F.col("bad").isNotNull()).select("bad", (F.col("fold") != 0).alias("grow"), F.array(*features().values()).alias("x"))
    rows = materialize(rows, "quality-labelled")
    edges = cut_points(rows, params)
    if not edges:
        return DecisionList()

    def bin_of(i: int) -> Column:
        cuts = F.array(*[F.lit(float(e)) for e in edges[i]])
        return F.size(F.filter(cuts, lambda c: c <= F.col("x")[i]))

    binned = materialize(rows.select("bad", "grow", F.array(*[bin_of(i) for i in range(len(names))]).alias("b")), "quality-binned")

    def test(c: tuple[int, bool, int]) -> Column:
        """(feature, at least, edge): the value is at least edges[feature][edge], or below it."""
        i, up, e = c
        return F.col("b")[i] > e if up else F.col("b")[i] <= e

    def matches(conj: list[tuple[int, bool, int]]) -> Column:
        return reduce(lambda a, b: a & b, map(test, conj), F.lit(True))

    def counts(conj: list, left: Column) -> tuple[dict[tuple[int, int], list[int]], int, int]:
        at = binned.where(F.col("grow") & left & matches(conj)).select("bad", F.posexplode("b").alias("i", "bin"))
        found: dict[tuple[int, int], list[int]] = {}
        for r in at.groupBy("i", "bin").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect():
            found[r["i"], r["bin"]] = [int(r["p"]), int(r["n"] - r["p"])]
        p, n = (sum(v[k] for (i, _), v in found.items() if i == 0) for k in (0, 1))
        return found, p, n

    rules: list[list[tuple[int, bool, int]]] = []
    left, all_bad = F.lit(True), None
    while len(rules) < params.max_rules:
        conj: list[tuple[int, bool, int]] = []
        while len(conj) < params.max_conditions:
            found, p0, n0 = counts(conj, left)
            all_bad = p0 if all_bad is None else all_bad
            if not p0 or not n0 or p0 >= params.enough * (p0 + n0) and conj:
                break
            least_p = max(params.min_covered, params.min_share * all_bad)
            best: tuple[float, tuple[int, bool, int] | None] = (1e-9, None)
            for i in range(len(names)):
                for up in (True, False):
                    for e in range(len(edges[i])):
                        p, n = (sum(v[k] for (f, b), v in found.items() if f == i and (b > e) == up) for k in (0, 1))
                        if p >= least_p and (g := _gain(p, n, p0, n0)) > best[0]:
                            best = (g, (i, up, e))
            if best[1] is None:
                break
            conj.append(best[1])
        if not conj:
            break
        # Prune: the shortest beginning of the conjunction with the best (p - n) / (p + n) on the held-back third.
        heads = [conj[:k] for k in range(1, len(conj) + 1)]
        agg = [F.sum(F.when(matches(h), F.col("bad")).otherwise(0)).alias(f"p{k}") for k, h in enumerate(heads)]
        agg += [F.sum(F.when(matches(h), 1).otherwise(0)).alias(f"n{k}") for k, h in enumerate(heads)]
        held = binned.where(~F.col("grow") & left).agg(*agg).first()
        worth = [((held[f"p{k}"] or 0) / held[f"n{k}"] if held[f"n{k}"] else 0.0, -k) for k in range(len(heads))]
        precision, k = max(worth)
        if precision < params.min_precision:
            break
        rules.append(heads[-k])
        left = left & ~matches(heads[-k])
    return DecisionList(tuple(tuple(Condition(names[i], up, float(edges[i][e])) for i, up, e in r) for r in rules))


def label_rows(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """The statistics of labelled documents with ``bad`` and ``fold``. A document with several labels takes the lowest quality."""
    one = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(quality).alias("_q"))
    return stats.join(one, key).withColumn("bad", F.when(F.col("_q") > 0, 0).otherwise(1)).withColumn("fold", F.crc32(F.col(key).cast("string").cast("binary")) % 3).drop("_q")


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", params: FitParams = FitParams()) -> DataFrame:
    """Statistics and verdict of every document.

    Returns key, th (hash of the text), the statistics, base_failed, rule
    (number of the rejecting rule or null) and kept. A null or empty text has
    no words: base_failed. Texts of any length are read whole; a value equal to
    a threshold counts as reaching it. Repeated rows are judged alike; other
    columns of docs are ignored; an empty table gives an empty result.
    """
    stats = materialize(with_stats(docs, key=key, text=text), "quality-stats")
    rules = fit(label_rows(stats, labels, key=key), params)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
