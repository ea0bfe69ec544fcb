"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and scored as arrays of code points; n-grams that cross
two texts of a batch are left out. The model is a (buckets x languages) matrix
of log-probabilities and the languages' prior, broadcast to the workers (its
size is bounded by a parameter). A batch is scored by a gather and a segmented
sum per n-gram length, over so many positions at a time as bound what is
gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches


@dataclass(frozen=True)
class LanguageParams:
    orders: tuple[int, ...] = (1, 2, 3)
    #: Rows of the matrix, a power of 2; fewer where languages are so many that the matrix would pass max_cells.
    buckets: int = 1 << 15
    max_cells: int = 1 << 24
    #: Additive smoothing of n-gram counts.
    alpha: float = 0.5
    #: At most about this many labelled documents of each language are learned from, chosen by a hash of the text.
    train_docs: int = 20_000


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points handled at a time.
_CHUNK = 1 << 20
#: Log-probabilities gathered at a time.
_GATHER = 1 << 22
#: Languages whose counts a task holds at a time.
_HELD = 64
_UNKNOWN = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and where each text ends."""
    lowered = [t.lower() for t in texts]
    joined = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, np.cumsum([len(t) for t in lowered])


def _ngrams(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; the last order - 1 are missing."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for k in range(order):
        h = (h + codes[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return (h & np.uint64(buckets - 1)).astype(np.int32)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about _CHUNK characters; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t or "") > _CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(t or "")
        size += len(t or "")
    if held:
        yield first, held


def _grams(codes: np.ndarray, ends: np.ndarray, order: int, buckets: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams inside texts, and the texts they are in, from ``step`` positions at a time."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) if len(ends) > 1 else None
    for i in range(0, len(codes), step):
        grams = _ngrams(codes[i : i + step + order - 1], order, buckets)
        own = np.zeros(len(grams), np.int64) if owner is None else owner[i : i + len(grams)]
        inside = np.arange(i, i + len(grams)) + order <= ends[own]
        yield grams[inside], own[inside]


def _count(p: LanguageParams, buckets: int, languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        lang = np.repeat(np.array([*total], np.int32), [np.count_nonzero(c) for c in total.values()])
        bucket = np.concatenate([np.flatnonzero(c) for c in total.values()])
        n = np.concatenate([c[c > 0] for c in total.values()])
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket.astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                counts = total.setdefault(number[lang], np.zeros(buckets, np.int64))
                for _, some in _groups(texts):
                    codes, ends = _codes(some)
                    for order in p.orders:
                        for grams, _ in _grams(codes, ends, order, buckets, _CHUNK):
                            counts += np.bincount(grams, minlength=buckets)
                if len(total) >= _HELD:
                    yield rows(total)
                    total.clear()
        if total:
            yield rows(total)

    return run


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: (buckets, languages) float32 log-probabilities.
    weights: np.ndarray
    #: (languages) log shares of the labelled documents.
    prior: np.ndarray
    params: LanguageParams


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from the rows with a text and a language, at most about params.train_docs of each language."""
    p, spark = params, labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    most = p.max_cells // 64
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages")
    languages = sorted(sizes)
    buckets = p.buckets
    while buckets * len(languages) > p.max_cells:
        buckets //= 2
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), p)
    # Out of 10,000 hash classes of texts, as many as the bound allows.
    share = spark.createDataFrame([(x, max(1, min(10_000, 10_000 * p.train_docs // sizes[x]))) for x in languages], "lang string, share int")
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text"), F.lit(10_000)) < F.col("share")).select("text", "lang")
    counted = chosen.mapInArrow(lean(_count(p, buckets, languages)), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    weights = np.full((buckets, len(languages)), p.alpha)
    weights[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    n = np.array([sizes[x] for x in languages], np.float64)
    return LanguageModel(languages, np.log(weights / weights.sum(0)).astype(np.float32), np.log(n / n.sum()), p)


def _likelihoods(m: LanguageModel, texts: list[str | None]) -> np.ndarray:
    """(texts, languages): ln of the prior and of the probability of a text's n-grams."""
    p, width = m.params, len(m.languages)
    sums = np.tile(m.prior, (len(texts), 1))
    for first, some in _groups(texts) if width else ():
        codes, ends = _codes(some)
        for order in p.orders:
            for grams, own in _grams(codes, ends, order, len(m.weights), max(1, _GATHER // width)):
                if len(own):
                    at = np.flatnonzero(np.diff(own, prepend=-1))
                    sums[first + own[at]] += np.add.reduceat(m.weights[grams], at, axis=0, dtype=np.float64)
    return sums


def _score(model, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        width = len(m.languages)
        for batch in batches:
            texts = batch.column(keep).to_pylist()
            lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
            if width:
                odds = _likelihoods(m, texts)
                odds = np.exp(odds - odds.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                best = odds.argmax(1)
                score = np.where(lettered, odds[np.arange(len(texts)), best], 0.0)
                names = np.array([*m.languages, _UNKNOWN], object)[np.where(lettered, best, width)]
            else:
                score, names = np.zeros(len(texts)), np.full(len(texts), _UNKNOWN, object)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names[:keep], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score (0 to 1: the likeliest language's posterior probability) of every row.

    Only the text decides, the whole of it, however long. A null or empty
    text, or one without a letter, is ``und`` with score 0, as is everything
    if the model has no language; ties go to the first language in order.
    Repeated rows are judged alike; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(_score(shared, len(keep))), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")
