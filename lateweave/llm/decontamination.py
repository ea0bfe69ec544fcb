"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts and benchmark items are turned into templates: numbers, units after a
number and names inside a sentence become typed placeholders; other words are
lower-cased and lose their punctuation. Windows of template words are joined by
hash. Where a matched window has placeholders, the slots behind them are read
on both sides: a re-parameterised question replaces a value by the same other
value throughout, while mere likeness of form does not; windows with conflicting
values don't count, those beside them do.

Windows of an item with too few words of their own as templates are joined by
the hash of their very words, so that every verbatim copy is found.

Only benchmark windows are broadcast, and only while they are few (a benchmark
doesn't grow with the corpus, but its size is checked all the same); documents
are never exchanged, only their matches are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize

# Units that become a placeholder after a number.
UNITS = (
    "kg", "g", "mg", "t", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "foot", "inch", "inches", "yard", "yards",
    "l", "ml", "litre", "litres", "liter", "liters", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "pound", "pounds",
    "kmh", "mph", "degree", "degrees", "watt", "watts", "volt", "volts", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
    "gram", "grams", "kilogram", "kilograms",
)

#: Private marks that begin a placeholder; no input keeps them.
_MARK = "\x01"


@dataclass(frozen=True)
class LeakParams:
    window: int = 8
    #: Windows with fewer words that are no placeholders are too unspecific as templates and are matched by their very words.
    min_literal: int = 4
    #: Share of an item's words inside consistently matched windows from which a document leaks it.
    min_coverage: float = 0.5
    #: Benchmark windows are broadcast up to this many rows.
    broadcast_rows: int = 1_000_000


def _plain(text: Column) -> Column:
    """The text's words without punctuation; a word of punctuation alone vanishes."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")


def _marked(text: Column) -> Column:
    """The text with its placeholders, parted by the same white space."""
    t = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}\p{M}]+", f"{_MARK}n")
    number = r"\p{N}+(?:[.,:/]\p{N}+)*"
    units = "|".join(sorted(UNITS, key=lambda u: -len(u)))
    t = F.regexp_replace(t, rf"{number}( ?)(?i:{units})(?![\p{{L}}\p{{N}}])", f"{_MARK}d$1{_MARK}u")
    t = F.regexp_replace(t, number, f"{_MARK}d")
    return F.lower(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}\s{_MARK}]+", ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def template(text: Column) -> Column:
    """Array of template words. Null: none."""
    return _words(_marked(F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(""))))


def slots(text: Column) -> Column:
    """Array of the words behind template(), position by position."""
    return _words(F.lower(_plain(F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit("")))))


def _hashes(words: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, p: LeakParams, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, size, pos, exact, h, slotted, n_words, words, open: the windows of every item; an item shorter than the window is one window by itself.

    The hash is that of the template or, of exact windows, of the words themselves.
    """
    w = F.col("_t")
    size = F.least(F.lit(p.window), F.size(w))
    rows = benchmark.select(F.col(key).alias("item"), template(F.col(text)).alias("_t"), slots(F.col(text)).alias("_o")).where(F.size(w) > 0)
    at = rows.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size(w) - size)).alias("pos"))
    part = F.slice(w, F.col("pos") + 1, F.col("size"))
    literal = F.size(F.filter(part, lambda x: ~x.contains(_MARK)))
    raw, exact = F.slice("_o", F.col("pos") + 1, F.col("size")), literal < F.lit(p.min_literal)
    return at.select(
        "item", "size", "pos", exact.alias("exact"), F.when(exact, F.xxhash64(raw)).otherwise(F.xxhash64(part)).alias("h"), (~exact & (literal < F.col("size"))).alias("slotted"), F.size(w).alias("n_words"),
        raw.alias("words"),
        F.transform(part, lambda x: x.contains(_MARK)).alias("open"),
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", params: LeakParams = LeakParams()) -> DataFrame:
    """Pairs of a document and an item that it leaks.

    Returns key, th (hash of the text), item, item_words, covered_words,
    coverage, n_slots (placeholders compared), changed (whether a slot has
    another value than in the item) and first_word (position of the first
    match). Null and empty texts leak nothing, nor is an item without a word
    looked for; texts of any length are read whole; an item covered to exactly
    the least share is leaked. Items of one text give a pair each, rows that
    repeat a key and text one pair together; other columns are ignored; empty
    tables give an empty result.
    """
    p = params
    bench = materialize(benchmark_windows(benchmark, p, key=item_key, text=item_text), "leaks-benchmark")
    kinds = sorted((r["exact"], r["size"]) for r in bench.select("exact", "size").distinct().collect())
    few = bench.count() <= p.broadcast_rows
    narrow = bench.select("h", "size", "item", F.col("pos").alias("ipos"), "exact", "slotted", "n_words")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # One pass, whatever kinds of windows the items have: each kind's windows are part of one array.
    needed = {exact: of(F.col("text")).alias(name) for exact, of, name in ((False, template, "_t"), (True, slots, "_o")) if any(e == exact for e, _ in kinds)}
    words = rows.select("key", "th", *needed.values())

    def windows(exact: bool, size: int) -> Column:
        return F.transform(_hashes(F.col("_o" if exact else "_t"), size), lambda h, i: F.struct(h.alias("h"), i.alias("pos"), F.lit(size).alias("size"), F.lit(exact).alias("exact")))

    if len(kinds) > 1:
        at = words.select("key", "th", F.explode(F.concat(*[windows(*k) for k in kinds])).alias("x")).select("key", "th", "x.*")
    else:
        # One kind needs no structs.
        exact, size = kinds[0] if kinds else (False, p.window)
        column = F.col("_o" if exact else "_t") if kinds else F.array().cast("array<string>")
        at = words.select("key", "th", F.posexplode(_hashes(column, size)).alias("pos", "h"), F.lit(size).alias("size"), F.lit(exact).alias("exact"))
    hits = at.join(F.broadcast(narrow) if few else narrow, ["h", "size", "exact"]).drop("exact")
    hits = materialize(hits.withColumn("shift", F.col("pos") - F.col("ipos")), "leaks-hits")

    # Slots of the matches that have any; documents without such a match are not read again.
    slotted = hits.where("slotted")
    wanted = materialize(slotted.select("key", "th").distinct(), "leaks-slotted")
    side = F.broadcast(wanted) if wanted.count() <= p.broadcast_rows else wanted
    again = rows.join(side, rows["key"].eqNullSafe(side["key"]) & (rows["th"] == side["th"]), "left_semi").dropDuplicates(["key", "th"]).select(F.col("key").alias("_k"), F.col("th").alias("_th"), slots(F.col("text")).alias("_o"))
    pairs = slotted.join(again, slotted["key"].eqNullSafe(F.col("_k")) & (slotted["th"] == F.col("_th"))).join(bench.select("item", F.col("pos").alias("ipos"), "words", "open"), ["item", "ipos"])
    pairs = pairs.select("key", "th", "item", "shift", "ipos", F.explode(F.arrays_zip(F.col("words").alias("a"), F.slice("_o", F.col("pos") + 1, F.col("size")).alias("b"), F.col("open").alias("o"))).alias("x")).where("x.o")
    # Consistent: a value of the item has one value in the document throughout; windows in which a value with several is changed go.
    pairs = pairs.select("key", "th", "item", "shift", "ipos", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    same = ["key", "th", "item", "shift"]
    values = pairs.groupBy(*same, "a").agg(F.collect_set("b").alias("b"), F.collect_set(F.when(F.col("a") != F.col("b"), F.col("ipos"))).alias("at"))
    mapped = values.groupBy(*same).agg(
        F.sum(F.size("b")).alias("n"), F.sum(F.size(F.array_remove("b", F.col("a")))).alias("moved"), F.flatten(F.collect_list(F.when(F.size("b") > 1, F.col("at")))).alias("gone")
    )
    runs = hits.groupBy(*same).agg(F.collect_set(F.struct("ipos", "size")).alias("at"), F.max("n_words").alias("n_words"))
    m = mapped.alias("m")
    runs = runs.alias("r").join(m, F.col("r.key").eqNullSafe(F.col("m.key")) & (F.col("r.th") == F.col("m.th")) & F.col("r.item").eqNullSafe(F.col("m.item")) & (F.col("r.shift") == F.col("m.shift")), "left")
    gone = F.coalesce("m.gone", F.array().cast("array<int>"))
    runs = runs.select("r.key", "r.th", "r.item", "r.shift", F.filter("r.at", lambda x: ~F.array_contains(gone, x["ipos"])).alias("at"), "r.n_words", F.coalesce("m.n", F.lit(0)).alias("n"), F.coalesce("m.moved", F.lit(0)).alias("moved")).where(F.size("at") > 0)
    # A set of the item's windows, however often the document repeats them.
    each = runs.withColumn("first", F.col("shift") + F.array_min("at")["ipos"]).select("key", "th", "item", "first", "n_words", "n", "moved", F.posexplode("at").alias("k", "x"))
    found = each.groupBy("key", "th", "item").agg(
        F.array_sort(F.collect_set("x")).alias("at"), F.min("first").alias("first"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("n"), F.max("moved").alias("moved")
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    covered = F.aggregate("at", zero, lambda s, x: F.struct((x["ipos"] + x["size"]).alias("end"), (s["sum"] + F.least(x["size"], x["ipos"] + x["size"] - s["end"])).alias("sum")))["sum"]
    found = found.withColumn("covered", covered)
    return found.where(F.col("covered") >= F.col("n_words") * F.lit(p.min_coverage)).select(
        F.col("key").alias(key), "th", "item", F.col("n_words").alias("item_words"), F.col("covered").alias("covered_words"), (F.col("covered") / F.col("n_words")).alias("coverage"),
        F.col("n").alias("n_slots"), (F.col("moved") > 0).alias("changed"), F.col("first").alias("first_word"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", params: LeakParams = LeakParams()) -> DataFrame:
    """docs without the documents that leak an item."""
    leaks = find_leaks(docs, benchmark, key=key, text=text, params=params).select(F.col(key).alias("_k"), F.col("th").alias("_th")).distinct()
    leaks = materialize(leaks, "leaks-found")
    side = F.broadcast(leaks) if leaks.count() <= params.broadcast_rows else leaks
    return docs.join(side, docs[key].eqNullSafe(side["_k"]) & (F.xxhash64(docs[text]) == side["_th"]), "left_anti")
