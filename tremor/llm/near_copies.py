"""Near copies for the pipeline: groups of texts linked by 5-word Jaccard similarity of 0.8 and more.

Texts of equal words are one node, so copies cost nothing. First op10's fingerprints, over five words, are linked by op10's search
(``simhash.linked``), and every node of a group of fingerprints is held against one node of it; a group that this does not link
whole is a bucket like those below. Four bits show the nearest
copies only, so candidates also share one of ``BANDS`` keys made of ``ROWS``
least hashes of their sets; two sets of similarity 0.8 share none with probability (1 - 0.8^6)^40 = 5e-6, and sets of 0.3 share one with
probability 0.03. Every link is held against the exact similarity of the whole sets.

The nodes of a bucket (one key) are first compared with one of them, the one that meets most others over all its buckets, so that the text
a large group was copied from is the same choice in each; what this links takes one label, and a bucket of one label is finished. Then all pairs of unlike labels are compared in buckets of at most ``SMALL`` nodes. In larger ones
every node outside the largest label is compared with ``PROBES`` members of that label and with one
node outside of it, others in each round, until a round links nothing. Then all nodes of unlike labels that are left in them and share
one of their rarest shingles, as similar sets do (``_rest_pairs``), are compared, so that no pair is missed. A linked
node stays in its buckets, so that it still meets the nodes its label lacks. No bucket is cut, and the work of a round of probes grows with its nodes, not their pairs.
"""
from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import simhash
from tremor.llm.common import LOWER_ASCII, slices, unused
from tremor.operators.graph import components
from tremor.plans.loops import CutTable

WORDS = 5
#: Similar means Jaccard >= FOUR / FIVE, in whole numbers.
FOUR, FIVE = 4, 5
BANDS, ROWS = 40, 6
#: Nodes of a bucket whose pairs of unlike labels are all compared; nodes of the largest label that others meet in a round.
SMALL, PROBES = 32, 4
SALTS = 16
_SLICE_CHARS = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR, _SHIFT = np.random.default_rng(20).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_FACTOR |= np.uint32(1)


def shingles(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """Hash of a text's words (A-Z lowered), and the sorted distinct hashes of its shingles."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split()
    node = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(found))).view(np.int64))
    if not found:
        return node, np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(len(found) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(words, len(found))):
        out = (out ^ h[j:j + n]) * _ODD
        out ^= out >> np.uint64(29)
    return node, np.unique(out.view(np.int64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of hashes: sets of Jaccard similarity s share each with probability s ** ROWS."""
    if not len(own):
        return np.zeros(0, np.int64)
    lows = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    high = (own.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), 4096):
        np.minimum(lows, (high[k:k + 4096] * _FACTOR + _SHIFT).min(axis=1), out=lows)
    rows, keys = lows.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * _ODD
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, row_hash, node, n, fp, part) per row: size of the set, and all its shingles, or fingerprint and keys of its bands."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in slices(texts, _SLICE_CHARS):
                nodes, sizes, marks, parts = [], [], [], []
                for text in texts[i:j]:
                    node, own = shingles(text)
                    nodes.append(node)
                    marks.append(None if whole else simhash.fingerprint(text, WORDS) - (1 << 63))
                    sizes.append(len(own))
                    parts.append(own if whole else band_keys(own))
                ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.int64()), lists],
                                                 names=["doc_id", "row_hash", "node", "n", "fp", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"),
                       F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id bigint, row_hash bigint, node bigint, n int, fp bigint, part array<bigint>")


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of the text) is a ``low`` in ``wanted``; one of equal rows."""
    own, key, digest = (unused(docs, c) for c in ("_own_hash", "_keep_id", "_keep_hash"))
    keys = wanted.select(F.col("low.doc_id").alias(key), F.col("low.row_hash").alias(digest))
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest))
    return marked.join(keys, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (from_id, to_id) whose whole sets are similar."""
    a, b = sets.select(F.col("node").alias("from_id"), F.col("part").alias("a")), sets.select(F.col("node").alias("to_id"), F.col("part").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "from_id").join(b, "to_id").where(both * (FOUR + FIVE) >= (F.size("a") + F.size("b")) * FOUR).select("from_id", "to_id")


def _fits(a: str, b: str):
    """Sizes that similar sets can have."""
    return (F.col(a) * FIVE >= F.col(b) * FOUR) & (F.col(b) * FIVE >= F.col(a) * FOUR)


def _pairs(members: DataFrame, centres: DataFrame, also: str = "true") -> DataFrame:
    """Each member of a bucket with the centres of another label that its bucket has, where ``also`` holds; one bucket may hold a third of all rows."""
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    spread = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    met = spread.join(centres.withColumn("salt", F.explode(salts)), ["key", "salt"]).where((F.col("label") != F.col("other")) & _fits("n", "m") & F.expr(also))
    return met.select(F.least("node", "to_id").alias("from_id"), F.greatest("node", "to_id").alias("to_id")).distinct()


def _first(of: Column, seed: int) -> Column:
    """The member that comes first in an order of its own for each seed, among those where ``of`` holds."""
    return F.min(F.when(of, F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("to_id"), F.col("n").alias("m"), F.col("label").alias("other"))))


def _centres(members: DataFrame, seed: int) -> DataFrame:
    """(key, to_id, m, other): ``PROBES`` members of the largest label of each bucket, and one of no such label."""
    each = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    top = each.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"))
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    marked = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
        top.select("key", F.col("top.label").alias("main"), F.explode(salts).alias("salt")), ["key", "salt"])
    inside = F.col("label") == F.col("main")
    picked = marked.groupBy("key").agg(F.array(*[_first(inside, seed + k) for k in range(PROBES)], _first(~inside, seed)).alias("c"))
    return picked.select("key", F.explode("c").alias("c")).where("c IS NOT NULL").select("key", "c.to_id", "c.m", "c.other").distinct()


def _relabelled(labels: DataFrame, near: DataFrame) -> DataFrame:
    """(node, label) after the links ``near`` (from_id, to_id) have joined their labels."""
    ends = near.join(labels.select(F.col("node").alias("from_id"), F.col("label").alias("a")), "from_id").join(
        labels.select(F.col("node").alias("to_id"), F.col("label").alias("b")), "to_id")
    moved = components(ends.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))).select(F.col("node_id").alias("label"), "component")
    return labels.join(moved, "label", "left").select("node", F.coalesce("component", "label").alias("label"))


def _groups(nodes: DataFrame) -> DataFrame:
    """(key, node, n): the nodes of each group of linked fingerprints that has several; nodes: stored (node, n, fp)."""
    fps = CutTable(nodes.select("fp").distinct()).df
    group = CutTable(nodes.join(simhash.linked(fps).withColumnRenamed("node_id", "fp"), "fp", "left").select(
        F.xxhash64(F.lit("group"), F.coalesce("component", "fp")).alias("key"), "node", "n")).df
    return group.join(group.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "key", "left_semi")


def _by_fingerprint(groups: DataFrame) -> DataFrame:
    """(from_id, to_id): each node of a group of linked fingerprints with the first node of the group; what this leaves unlinked stays a bucket."""
    own = groups.withColumn("label", F.col("node"))
    first = own.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"))
    return _pairs(own, first.select("key", F.col("c.node").alias("to_id"), F.col("c.n").alias("m"), F.col("c.node").alias("other")))


def _busiest(members: DataFrame) -> DataFrame:
    """(key, to_id, m, other): of each bucket the node that meets most nodes over all its buckets."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    meets = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("meets"))
    top = members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("c"))
    return top.select("key", F.col("c.node").alias("to_id"), F.col("c.n").alias("m"), F.col("c.node").alias("other"))


def _all_pairs(members: DataFrame, also: str = "true", *more: Column) -> DataFrame:
    """Every pair of unlike labels of each bucket, where ``also`` holds; a pair is met from its smaller node."""
    return _pairs(members, members.select("key", F.col("node").alias("to_id"), F.col("n").alias("m"), F.col("label").alias("other"), *more), f"node < to_id AND {also}")


def _rest_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Every pair of unlike labels among ``members`` that can be similar, whatever their buckets.

    Shingles have one order for all, rarest first. Similar sets share four fifths of either, so they share one among the first
    fifth and one more of each; and at the first one that they share, both must have enough shingles left for the overlap they need.
    """
    each = members.select("node", "n", "label").distinct().join(sets, "node").select("node", "n", "label", F.explode("part").alias("key"))
    met = each.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    rarest = each.join(met, "key").groupBy("node", "n", "label").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("k"))
    least = F.col("n") - F.ceil(F.col("n") * FOUR / FIVE).cast("int") + 1
    own = CutTable(rarest.select("node", "n", "label", F.posexplode(F.slice("k", F.lit(1), least)).alias("at", "k")).where("k.c > 1").select(
        "k.key", "node", "n", "label", (F.col("n") - F.col("at")).alias("left"))).df
    return _all_pairs(own, f"least(left, there) * {FOUR + FIVE} >= (n + m) * {FOUR}", F.col("left").alias("there"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id): similar pairs of ``nodes`` (stored) that connect what fingerprints and buckets show to be connected."""
    each = nodes.select("node", "n", F.explode("part").alias("key")).repartition("key")
    # Both sides of the join read one exchange: they have the same columns.
    shared = each.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max("n").alias("n")).where("a <> b").select("key")
    found_buckets = each.join(shared, "key", "left_semi").select("key", "node", "n")
    groups = CutTable(_groups(nodes)) if "fp" in nodes.columns else None
    member = CutTable(found_buckets if groups is None else found_buckets.unionByName(groups.df))
    marked = CutTable(_by_fingerprint(groups.df)) if groups is not None else None
    sets = CutTable(_sets(_rows_of(docs, nodes.join(member.df.select("node").distinct(), "node", "left_semi").select("low")), True).select("node", "part").dropDuplicates(["node"]))
    labels, found, rounds, whole = CutTable(sets.df.select("node", F.col("node").alias("label"))), [], 0, False
    if marked is not None:
        near = CutTable(_similar(marked.df, sets.df))
        marked.drop()
        groups.drop()
        found.append(near.df)
        after = CutTable(_relabelled(labels.df, near.df))
        labels.drop()
        labels = after
    while True:
        own = member.df.select("key", "node", "n").join(labels.df, "node").select("key", "node", "n", "label")
        mixed = own.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b").select("key", "size")
        active = CutTable(own.join(mixed, "key"))
        rest = active.df.where(F.col("size") > SMALL)
        if not rounds:
            pairs = _pairs(active.df, _busiest(active.df.select("key", "node", "n")).join(labels.df.select(F.col("node").alias("to_id"), "label"), "to_id").select("key", "to_id", "m", F.col("label").alias("other")))
        elif rounds == 1:  # small buckets: every pair of two labels
            pairs = _all_pairs(active.df.where(F.col("size") <= SMALL))
        else:
            pairs = _rest_pairs(rest, sets.df) if whole else _pairs(rest, _centres(rest, rounds * (PROBES + 1)))
        near = CutTable(_similar(pairs, sets.df))
        member.drop()
        member, rounds = active, rounds + 1
        if near.is_empty():
            near.drop()
            if whole:
                break
            whole = rounds > 2  # a round of probes has linked nothing: now every pair of unlike labels that can be similar
            continue
        found.append(near.df)
        if whole:
            break
        after = CutTable(_relabelled(labels.df, near.df))
        labels.drop()
        labels = after
    for table in (member, labels, sets):
        table.drop()
    return functools.reduce(DataFrame.unionAll, found) if found else nodes.where("false").select(F.col("node").alias("from_id"), F.col("node").alias("to_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    It is the row with the smallest ``doc_id`` of its group, null last, then by hash of the text. Texts that are null
    or have no word are one group; rows with equal words are one group, repeated rows too. An empty table stays empty.
    """
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("low")
    nodes = CutTable(_sets(docs, False).groupBy("node").agg(low, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("part").alias("part"))).df
    comp = CutTable(components(CutTable(links(docs, nodes)).df)).df
    group = nodes.select("node", "low").join(comp.withColumnRenamed("node_id", "node"), "node", "left")
    return _rows_of(docs, group.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("low").alias("low")))
