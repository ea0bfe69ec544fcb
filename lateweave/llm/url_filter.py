"""URL filtering: host/path rules, and a character language-model ratio where no rule fits (DataFrame functions only).

The URLs that the rules decide are the accepted and the rejected training
texts. For each class a variable-order Markov model gives
p(char | up to `order` characters before), interpolated with its shorter
contexts; contexts seen less than `min_context` times are cut off, so that the
order varies with the data. A URL's score is the mean over its characters of
ln p_accepted - ln p_rejected, and the threshold is calibrated on a fifth of
the decided URLs that the models haven't seen.

All counts come from one aggregation over (order + 1)-character windows of the
distinct URLs, and each distinct window is scored once; a URL then sums the
values of its windows. Windows are bounded by the alphabet rather than by the
corpus, the table of their values is broadcast only while it is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief, lower_ascii, materialize, shuffle_width

#: Stands before the first character.
PAD = "\x02"


@dataclass(frozen=True)
class UrlModel:
    order: int = 4
    #: Weight of the next shorter context, as a count.
    smoothing: float = 4.0
    #: Shorter contexts are used where a context has been seen less often.
    min_context: int = 8
    #: Size of the alphabet behind the uniform distribution that ends the recursion.
    alphabet: int = 256
    #: Scores are calibrated on a grid of this step, cut off at grid * clip.
    grid: float = 0.005
    clip: int = 2000
    #: Window values are broadcast up to this many rows, joined by a shuffle beyond.
    broadcast_rows: int = 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(verdict, rule); null if none fits.

    A rule ``host/path`` fits its host and all subdomains if the path starts
    with the rule's path. Of equally long rules block comes first, then the
    last in order.
    """
    out = F.lit(None).cast(_RULE)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, _, start = rule.partition("/")
        name = name.lower()
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


#: Rules that become one expression; more of them are joined.
EXPRESSION_RULES = 1000
_RULE = "struct<verdict:string,rule:string>"


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rows (host, path, ...) with ``_rule``, as rule_for() has it, whatever the number of rules: many are joined by the host's suffixes."""
    if len(rules) <= EXPRESSION_RULES:
        return rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    at = F.instr("rule", "/")
    named = rows.sparkSession.createDataFrame(sorted(set(rules)), "verdict string, rule string").select(
        "verdict", "rule", F.lower(F.substring_index("rule", "/", 1)).alias("name"), F.concat(F.lit("/"), F.when(at > 0, F.substring("rule", at + 1, F.length("rule"))).otherwise("")).alias("start")
    )
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    each = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("name"))
    fitting = each.join(named, "name").where(F.col("path").startswith(F.col("start")))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("_best"))
    found = best.select("host", "path", F.struct(F.col("_best.verdict").alias("verdict"), F.col("_best.rule").alias("rule")).alias("_rule"))
    return rows.join(found, ["host", "path"], "left")


def _windows(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of ``url``: the character and the ``order`` characters before it, as ``g``."""
    chars = F.concat(F.array(*[F.lit(PAD)] * order), F.regexp_extract_all(lower_ascii(F.col("url")), F.lit("(?s)."), 0))
    at = F.transform(F.sequence(F.lit(0), F.size("_c") - (order + 1)), lambda i: F.concat(*[F.get(F.col("_c"), i + k) for k in range(order + 1)]))
    return urls.where(F.length("url") > 0).select(*keep, chars.alias("_c")).select(*keep, F.explode(at).alias("g"))


def _values(counts: DataFrame, m: UrlModel) -> DataFrame:
    """g -> llr: ln p_accepted - ln p_rejected of the last character of every window, by recursion over context lengths."""
    levels = {m.order: counts.select("g", "a", "r")}
    for k in range(m.order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("g", 2, m.order + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    solved = None
    for k in range(m.order + 1):
        context = F.substring("g", 1, k)
        total = levels[k].groupBy(context.alias("_s")).agg(F.sum("a").alias("_a"), F.sum("r").alias("_r"))
        here = levels[k].withColumn("_s", context).join(total, "_s")
        if solved is None:
            here = here.withColumn("_pa", F.lit(1.0 / m.alphabet)).withColumn("_pr", F.lit(1.0 / m.alphabet))
        else:
            here = here.withColumn("_g", F.substring("g", 2, k + 1)).join(solved.select(F.col("g").alias("_g"), F.col("pa").alias("_pa"), F.col("pr").alias("_pr")), "_g")
        # The empty context always counts: without any training text both classes are uniform.
        known = F.lit(True) if k == 0 else F.col("_a") + F.col("_r") >= m.min_context
        mixed = {c: (F.col(c) + m.smoothing * F.col(f"_p{c}")) / (F.col(f"_{c}") + m.smoothing) for c in ("a", "r")}
        solved = here.select("g", *[F.when(known, mixed[c]).otherwise(F.col(f"_p{c}")).alias(f"p{c}") for c in ("a", "r")])
    return solved.select("g", (F.log("pa") - F.log("pr")).alias("llr"))


def url_scores(urls: DataFrame, m: UrlModel = UrlModel()) -> tuple[DataFrame, float]:
    """(distinct url, label, fold, score), and the calibrated threshold.

    urls: ``url`` and ``label`` (allow, block or null), one label for each url.
    A null or empty url has no score.
    """
    spark = urls.sparkSession
    once = urls.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("label").alias("label"))
    # A number stands for the URL among its characters' rows. Distinct URLs lie in few files; dealt out, they are cut up in parallel.
    once = once.select(F.monotonically_increasing_id().alias("id"), "url", "label", (F.crc32(F.col("url").cast("binary")) % 5).alias("fold"))
    once = materialize(once, "url-distinct")
    dealt = once.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), "id")
    learn = F.col("fold") != 0
    marked = dealt.select("url", F.when(learn & (F.col("label") == "allow"), 1).otherwise(0).alias("_a"), F.when(learn & (F.col("label") == "block"), 1).otherwise(0).alias("_r"))
    counts = materialize(_windows(marked, m.order, "_a", "_r").groupBy("g").agg(F.sum("_a").alias("a"), F.sum("_r").alias("r")), "url-windows")
    values = materialize(_values(counts, m), "url-values")
    small = values.count() <= m.broadcast_rows
    seen = _windows(dealt, m.order, "id").join(F.broadcast(values) if small else values, "g")
    means = materialize(seen.groupBy("id").agg((F.sum("llr") / F.count("llr")).alias("score")), "url-means")
    scored = materialize(once.join(brief(means), "id").select("url", "label", "fold", "score"), "url-scores")

    # The cut between neighbouring bins with the best mean of the two classes' hit rates; of equals the one whose upper bin
    # is nearest 0, then the lower. The threshold is the middle of the gap between the bins.
    step = F.greatest(F.lit(-m.clip), F.least(F.lit(m.clip), F.floor(F.col("score") / m.grid)))
    bins = scored.where((F.col("fold") == 0) & F.col("label").isNotNull()).groupBy(step.cast("int").alias("bin"))
    bins = bins.agg(F.sum((F.col("label") == "allow").cast("long")).alias("a"), F.sum((F.col("label") == "block").cast("long")).alias("r")).collect()
    a, r = sum(x["a"] for x in bins), sum(x["r"] for x in bins)
    if not a or not r:
        return scored, 0.0
    cuts = [(sum(x["a"] for x in bins if x["bin"] >= b) / a + sum(x["r"] for x in bins if x["bin"] < b) / r, -abs(b), -b) for b in {x["bin"] for x in bins}]
    upper = -max(cuts)[2]
    lower = max((x["bin"] + 1 for x in bins if x["bin"] < upper), default=upper)
    return scored, (lower + upper) / 2 * m.grid


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], *, key: str = "page_id", url: str = "url", model: UrlModel = UrlModel()) -> DataFrame:
    """Verdict on every row: the longest fitting rule's, else the language models'.

    Returns key, host, path, rule, verdict, score. A URL that no rule decides
    is allowed if its score reaches the calibrated threshold; a null or empty
    URL has no score and is blocked. Of equally long rules block comes first.
    URLs of any length are read whole; repeated rows are judged alike, other
    columns are ignored, an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = with_rules(rows, rules)
    scored, threshold = url_scores(rows.select("url", F.col("_rule.verdict").alias("label")), model)
    joined = rows.join(scored.select("url", "score"), "url", "left")
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return joined.select(
        F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"), "score"
    )
