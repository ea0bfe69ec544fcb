"""Grouped prefix join: documents whose word 5-gram sets have a Jaccard similarity of 0.8 or more.

A document's set is hashed (64 bits a shingle) and ordered by (count among
frequent shingles, hash). Two sets of similarity t share a shingle among their
first size - ceil(t * size) + 1: the prefix. Any total order is correct, and
putting shingles that a sample of the texts shows to be frequent last, the most
frequent at the very end, keeps common passages out of the prefixes.

* Copies are one class: a task emits a set once, and equal sets meet later.
* Classes with identical prefixes and size are one group; only groups are
  joined on prefix shingles, under size and position bounds and a bound on what
  two sets differ in, by 512 parity bits of each.
* Blocks of frequent shingles are counted first and dealt out in salted parts,
  so that no task holds a whole large block.
* In a shingle's block, neighbouring groups are paired first and their members
  verified, in a few rounds; what that connects is one cluster. Then only group pairs of
  different clusters are formed, expanded and verified. A link inside a cluster
  can't change a component, so no link is lost, and a block of thousands of
  near copies costs a chain instead of all pairs.

A pair is first held against sketches of its sets, which bound what they can
have in common; only what these leave is verified on whole sets, read again
from the texts of those documents alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, brief, lean, materialize, most_frequent, small_batches
from .connected import components
from .word_hash import BASE, mix, word_hashes


@dataclass(frozen=True)
class JoinParams:
    shingle: int = 5
    #: Similarity threshold numerator / denominator, compared exactly.
    percent: int = 80
    #: One text in so many is looked at for frequent shingles.
    sample: int = 16
    #: Frequent: in so many of the sampled texts at least ...
    frequent: int = 4
    #: ... and at most so many shingles, the most frequent ones. The order of the others isn't affected.
    frequent_rows: int = 500_000
    #: A group is held against its neighbours in its first so many shared blocks, round by round.
    chain: tuple[int, ...] = (8,)
    #: Neighbours are of about one size: bands grow by this factor.
    band: float = 1.1
    #: Larger blocks are dealt out in parts of about so many groups.
    block: int = 2048


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer words than n: the whole sequence as one; no words: empty."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for text in texts:
            words = word_hashes(text)[0]
            k = min(n, len(words))
            if not k:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.full(len(words) - k + 1, np.uint64(k))
            for i in range(k):
                h = mix(h * BASE + words[i : len(words) - k + 1 + i])
            out.append(np.unique(h))
    return out


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a non-empty set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ mix(np.arange(1, len(s) + 1, dtype=np.uint64))).sum(dtype=np.uint64)) - (1 << 63)


def _group_of(head: np.ndarray, n: int) -> int:
    """A 64-bit name of a prefix and a size."""
    with np.errstate(over="ignore"):
        return int(mix(mix(head ^ mix(np.arange(1, len(head) + 1, dtype=np.uint64))).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))[0]) - (1 << 63)


#: Counters of a sketch.
_CELLS = 256


def sketch_of(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of _CELLS cells, up to 255."""
    return np.minimum(np.bincount((s >> np.uint64(32) & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS), 255).astype(np.uint8).tobytes()


#: Parity bits of a set, 64 to a long.
_BITS = 512


def parity_of(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each of _BITS bits: two sets differ in at least as many members as in bits."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _plausible(p: JoinParams):
    """Pairs whose sketches leave room for enough common shingles: no more than the lesser count of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _CELLS) for i in (4, 5))
            low = np.minimum(a, b)
            room = (low.sum(1, dtype=np.int64) * (100 + p.percent) >= p.percent * n) | (low == 255).any(1)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(room)).columns[:2], ["a", "b"])

    return run


def _sampled(p: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = shingle_sets(part.column(0).to_pylist(), p.shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["s"])

    return run


def need(size: int, p: JoinParams) -> int:
    """ceil(threshold * size)."""
    return -(-size * p.percent // 100)


def _prefixes(p: JoinParams, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, counts), emitted = frequent.value, set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            out = []
            for s in shingle_sets(batch.column(2).to_pylist(), p.shingle):
                n = len(s)
                if not n:
                    out.append((0, *[None] * 6))
                    continue
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                late = common[at] == s if len(common) else np.zeros(n, bool)
                last = s[late][np.argsort(counts[at[late]], kind="stable")]
                head = np.concatenate([s[~late], last])[: n - need(n, p) + 1]
                group = _group_of(head, n)
                # A task emits a group's prefix once, whatever the number of its copies.
                first = group not in emitted
                emitted.add(group)
                out.append((n, class_of(s), group, head.view(np.int64) if first else None, min(len(head), n - len(last)), sketch_of(s), parity_of(s)))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["key", "th", "n", "class", "grp", "prefix", "rare", "sketch", "parity"])

    return run


def _checked_sets(p: JoinParams):
    """Sets of the texts that are of the class they were fetched for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = shingle_sets(part.column(1).to_pylist(), p.shingle)
                good = [(c, s.tobytes()) for c, s in zip(part.column(0).to_pylist(), found) if len(s) and class_of(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in good], pa.int64()), pa.array([s for _, s in good], pa.binary())], ["class", "set"])

    return run


def _verify(p: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                good.append(100 * both >= p.percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good, pa.bool_())).columns[:2], ["a", "b"])

    return run


def _common(p: JoinParams, n1: str, n2: str) -> Column:
    """Shingles that linked sets of these sizes have in common at least."""
    return F.ceil((F.col(n1) + F.col(n2)) * p.percent / (100.0 + p.percent) - 1e-9)


def _bounds(p: JoinParams, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Whether two sets of these sizes whose first common prefix shingle is at these places (from 0) can be linked."""
    sizes = 100 * F.least(n1, n2) >= p.percent * F.greatest(n1, n2)
    return sizes & (F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= _common(p, n1, n2))


def _alike(p: JoinParams, x: str, y: str) -> Column:
    """Whether the parity bits of two sets let them be linked; also where one of them is unknown."""
    differ = sum((F.bit_count(F.get(f"{x}.parity", F.lit(i)).bitwiseXOR(F.get(f"{y}.parity", F.lit(i)))) for i in range(1, _BITS // 64)), F.bit_count(F.get(f"{x}.parity", F.lit(0)).bitwiseXOR(F.get(f"{y}.parity", F.lit(0)))))
    return F.coalesce(differ <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * _common(p, f"{x}.n", f"{y}.n"), F.lit(True))


def link_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """key, th (hash of the text), n_shingles, class_id (equal for documents with equal sets), root (equal for a component's documents) and component_id of every row.

    component_id is the smallest key reachable over links, the row's own
    included. A null or empty text, or one without a word, has no shingles, no
    class, no root and no links; rows that repeat a key are separate documents
    with one name, repeated rows too. A null key is linked like any other but
    never gives a component its name if there is another. Texts of any length
    are compared whole; a similarity of exactly the threshold links. Other
    columns are ignored; an empty table gives an empty result.
    """
    p, spark = params, docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))

    # Frequent shingles among one text in p.sample (copies once): a bounded table, and only a matter of speed.
    some = rows.where(F.pmod("th", F.lit(p.sample)) == 0).select("text").dropDuplicates()
    often = some.mapInArrow(lean(_sampled(p)), "s long").groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= p.frequent)
    often = most_frequent(materialize(often, "join-often"), p.frequent_rows).toArrow().sort_by("s")
    found, counts = often["s"].to_numpy().view(np.uint64), often["c"].to_numpy()
    ordered = np.argsort(found)
    frequent = spark.sparkContext.broadcast((found[ordered], counts[ordered]))

    schema = f"key {kind}, th long, n long, class long, grp long, prefix array<long>, rare int, sketch binary, parity array<long>"
    known = materialize(rows.mapInArrow(lean(_prefixes(p, frequent)), schema), "join-prefixes")

    # Blocks: groups that share a prefix shingle. Those of rare shingles are small; a group's rows from several tasks stand side by side there.
    heads = known.where(F.col("prefix").isNotNull())
    each = heads.select("grp", F.col("n").cast("int").alias("n"), F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("pos", "s"))
    whole, order = Window.partitionBy("s"), Window.partitionBy("s").orderBy("grp")
    each = each.select("*", F.min("grp").over(whole).alias("a"), F.max("grp").over(whole).alias("b"), F.lag("grp").over(order).alias("before"))
    small = each.where((F.col("a") != F.col("b")) & ~F.col("before").eqNullSafe(F.col("grp"))).select("s", "grp", "n", "pos", F.lit(1).alias("members"))
    small = materialize(small, "join-small")
    # Those of frequent shingles are counted, and their rows joined with the counts.
    each = heads.where(F.size("prefix") > F.col("rare")).select("grp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "s"), "rare").where("pos >= rare").drop("rare")
    sizes = each.groupBy("s").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.count(F.lit(1)).cast("int").alias("members")).where("a < b").select("s", "members")
    large = materialize(each.join(brief(materialize(sizes, "join-sizes")), "s").select("s", "grp", "n", "pos", "members").dropDuplicates(["s", "grp"]), "join-large")
    # The bits of a group of several sets are unknown.
    groups = materialize(large.select("grp").distinct(), "join-large-groups")
    sole = known.where(F.col("class").isNotNull()).join(brief(groups), "grp", "left_semi").groupBy("grp").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.any_value("parity").alias("parity"))
    sole = materialize(sole.select("grp", F.when(F.col("a") == F.col("b"), F.col("parity")).alias("parity")), "join-parity")

    classes = known.where(F.col("class").isNotNull()).groupBy("class", "grp").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.any_value("sketch").alias("sketch"))
    classes = materialize(classes, "join-classes")
    sketches = classes.select("class", "n", "sketch")
    first = materialize(classes.groupBy("grp").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("members")), "join-first")
    inside = classes.join(first.where("members > 1").select("grp"), "grp").select(F.col("class").alias("a"), F.lag("class").over(Window.partitionBy("grp").orderBy("class")).alias("b")).where("b IS NOT NULL")

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        """The linked pairs (a, b) among candidates: sketches first, then the whole sets of what they leave."""
        left, right = (sketches.select(F.col("class").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
        near = left.join(brief(candidates, 32), "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(lean(_plausible(p)), "a long, b long")
        near = materialize(near, f"{name}-near")
        few = near.count() * 2 * 64 <= BROADCAST_BYTES
        wanted = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct()
        wanted = F.broadcast(wanted) if few else brief(materialize(wanted, f"{name}-classes"))
        # As many rows as there are classes wanted at most: what lies before a bounded table needs no table of its own.
        one = classes.join(wanted, "class", "left_semi").select("class", F.col("key").alias("_k"))
        one = F.broadcast(one) if few else brief(materialize(one, f"{name}-wanted"))
        # A key may name several rows; a text's class tells them apart, and of equal rows one is enough.
        texts = rows.join(one, F.col("key").eqNullSafe(F.col("_k"))).select("class", "text")
        sets = materialize(texts.mapInArrow(lean(_checked_sets(p)), "class long, set binary").dropDuplicates(["class"]), f"{name}-sets")
        left, right = (sets.select(F.col("class").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
        return left.join(F.broadcast(near) if few else near, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(lean(_verify(p)), "a long, b long")

    firsts = brief(first)
    f1, f2 = (firsts.select(F.col("grp").alias(f"g{i}"), F.col("class").alias(c)) for i, c in ((1, "a"), (2, "b")))

    def neighbours(block: DataFrame, turns: int, seed: int, clustered: bool) -> DataFrame:
        """(a, b): each group's first class, and its predecessor's and its hub's, in the group's first ``turns`` blocks where the two aren't one cluster yet.

        The order differs from block to block, so that a group meets several others of its size.
        """
        band = F.floor(F.log(F.col("n")) / math.log(p.band)).cast("int")
        # The parts of a large block differ from shingle to shingle, so that groups of one part here are in several there.
        part = F.pmod(F.xxhash64("grp", "s", F.lit(seed + 100)), F.ceil(F.col("members") / p.block)).cast("int")
        mixed = Window.partitionBy("s", "part").orderBy("band", F.xxhash64("grp", "s", F.lit(seed)))
        # A hub has the fewest shingles of its own before the block's: what edited copies have in common.
        hub = Window.partitionBy("s", "part", "band").orderBy("pos", F.xxhash64("grp", F.lit(seed)))
        own = ["grp", "n", "pos", *(["lo", "hi"] if clustered else [])]
        each = block.select("s", *own, part.alias("part"), band.alias("band"))
        met = each.select(*own, *[take(c).over(w).alias(f"{c}_{k}") for k, (w, take) in enumerate(((mixed, F.lag), (hub, F.first))) for c in own])
        near = met.select(*own, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{c}_{k}").alias(f"{c}2") for c in own]) for k in (0, 1)])).alias("x"))
        near = near.select(*own, "x.*").where(F.col("grp2").isNotNull() & (F.col("grp") != F.col("grp2")) & _bounds(p, "n", "pos", "n2", "pos2"))
        if clustered:
            near = near.where((F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo") != F.col("lo2")))
        near = near.withColumn("turn", F.row_number().over(Window.partitionBy("grp", "kind").orderBy("pos"))).where(F.col("turn") <= turns)
        found = near.select(F.least("grp", "grp2").alias("x"), F.greatest("grp", "grp2").alias("y")).distinct()
        return found.join(f1, F.col("x") == F.col("g1")).join(f2, F.col("y") == F.col("g2")).select("a", "b")

    def clusters_of(links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Classes with their clusters so far, and each group's lowest and highest cluster."""
        clusters = materialize(components(links), f"{name}-clusters")
        named = classes.join(brief(clusters), classes["class"] == clusters["node"], "left").select("class", "grp", F.coalesce("root", "class").alias("cluster"))
        return named, brief(materialize(named.groupBy("grp").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")), f"{name}-spread"))

    # Before the first links every group is a cluster of its own.
    block = small.unionByName(large)
    pairs = materialize(neighbours(block, p.chain[0], 0, False).unionByName(inside).distinct(), "join-0-pairs")
    links = materialize(verified(pairs, "join-0"), "join-0-links")
    for turn, width in enumerate(p.chain[1:], 1):
        _, spread = clusters_of(links, f"join-{turn}")
        tried = materialize(neighbours(block.join(spread, "grp"), width, turn, True), f"join-{turn}-pairs")
        pairs = pairs.unionByName(tried)
        links = links.unionByName(materialize(verified(tried, f"join-{turn}"), f"join-{turn}-links"))

    # What is left: pairs of different clusters in a block.
    named, spread = clusters_of(links, "join-last")
    crossing = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
    bounds = (F.col("x.s") == F.col("y.s")) & (F.col("x.grp") < F.col("y.grp")) & crossing & _bounds(p, "x.n", "x.pos", "y.n", "y.pos")
    whole = Window.partitionBy("s")
    few = small.drop("members").join(spread, "grp").select("*", F.min("lo").over(whole).alias("l"), F.max("hi").over(whole).alias("h")).where("l < h").drop("l", "h")
    met = few.alias("x").join(few.alias("y"), bounds).select(F.col("x.grp").alias("g1"), F.col("y.grp").alias("g2"))
    # Of a large block, each row meets one part of the others at a time.
    many = materialize(large.join(spread, "grp").join(brief(sole, 160), "grp"), "join-last-large")
    several = materialize(many.groupBy("s").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("s"), "join-last-several")
    many = many.join(brief(several), "s", "left_semi")
    parts = F.ceil(F.col("members") / p.block).cast("int")
    x = many.withColumn("part", F.pmod(F.hash("grp"), parts)).alias("x")
    y = many.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    met = met.unionByName(x.join(y, bounds & (F.col("x.part") == F.col("y.part")) & _alike(p, "x", "y")).select(F.col("x.grp").alias("g1"), F.col("y.grp").alias("g2"))).distinct()
    # Members of one group that its chain left apart are a group pair too.
    met = met.unionByName(spread.where("lo < hi").select(F.col("grp").alias("g1"), F.col("grp").alias("g2")))
    m1, m2 = (named.select(F.col("grp").alias(f"g{i}"), F.col("class").alias(c), F.col("cluster").alias(f"c{i}")) for i, c in ((1, "a"), (2, "b")))
    rest = met.join(m1, "g1").join(m2, "g2").where((F.col("c1") != F.col("c2")) & ((F.col("g1") != F.col("g2")) | (F.col("a") < F.col("b")))).select("a", "b").distinct().join(pairs.distinct(), ["a", "b"], "left_anti")
    rest = materialize(rest, "join-rest")
    found = materialize(components(links.unionByName(verified(rest, "join-rest"))), "join-components")

    rooted = classes.join(brief(found), classes["class"] == found["node"], "left").select("class", "key", F.coalesce("root", "class").alias("root"))
    rooted = materialize(rooted, "join-roots")
    least = materialize(rooted.groupBy("root").agg(F.min("key").alias("name")), "join-names")
    names = materialize(rooted.join(brief(least), "root").select("class", "root", "name").dropDuplicates(["class"]), "join-class-names")
    out = known.select("key", "th", "n", "class").join(brief(names), "class", "left")
    return out.select(
        F.col("key").alias(key), "th", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), "root", F.coalesce("name", "key").alias("component_id")
    )
