"""Per-document text statistics as Spark expressions (DataFrame functions only).

Every statistic is computed inside its own row, over the whole text; nothing
is exploded or exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACES, words_of

#: Inside a character class.
SYMBOLS = r"#*$%\&|<>"
WINDOW = 5


def char_count(text: Column, chars: str) -> Column:
    """How many characters of a text are in a regular expression's character class (its inner part)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def repeat_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that the text has twice or more.

    hashes: the 64-bit hashes of the text's windows, in order. Texts without a
    repeated window leave through a set-size test; only the others sort their
    windows to find the repeated ones and add up what they cover.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(p: Column) -> Column:
        n = F.size(p)
        # get() is 0-based and null outside the array; a null never equals.
        twice = F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        step = F.aggregate(starts, zero, lambda s, i: F.struct((i + size).alias("end"), (s["sum"] + F.least(F.lit(size), i + size - s["end"])).alias("sum")))
        return F.when(n > 0, step["sum"]).otherwise(0)

    # The one-element transform binds the sorted pairs once.
    deep = F.transform(F.array(pairs), covered)[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(deep)


def with_stats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th (hash of the text), the five base counts (long) and the counts behind the further features.

    Words are [^\\x20\\x09-\\x0D]+. A null or empty text has all counts 0.
    n_upper, n_letters, n_digits and n_marks count characters; n_lines lines with a word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select(F.col(key).alias(key), F.xxhash64(text).alias("th"), t.alias("_t"))
        .select(key, "th", "_t", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"))
        .select(
            "*",
            F.when(
                F.size("_w") >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")).alias("_h"),
        )
        .select(
            key,
            "th",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.regexp_replace("_t", SPACES, "")).cast("long").alias("word_chars"),
            char_count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("_h")).cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
            char_count(F.col("_t"), "A-Z").cast("long").alias("n_upper"),
            char_count(F.col("_t"), "0-9").cast("long").alias("n_digits"),
            char_count(F.col("_t"), ".,;:!?").cast("long").alias("n_marks"),
        )
    )
