"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text becomes a 64-bit fingerprint of its word shingles. Texts with fingerprints at most ``distance`` bits apart
are linked; components of links are groups. To find the links, the bits are split into parts that hold correlated
bits together, and every part i gets its own threshold t_i with sum(t_i + 1) = distance + 1: two fingerprints within
``distance`` bits then agree up to t_i bits in some part. Number of parts and thresholds minimise, by dynamic
programming, the estimated cost of probes and candidates. Split and thresholds are tuned on a bounded sample of
fingerprints; the search itself covers all of them and is exact for any split.

Equal fingerprints are one node from the start, so copies cost nothing. A bucket (part, value) is compared in the
task that holds it, which returns a spanning forest of the links, never more rows than it read; buckets of more than
``BLOCK`` fingerprints are cut into blocks, so no task holds an unbounded group.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import LOWER_ASCII, unused
from tremor.operators.graph import components
from tremor.plans.loops import CutTable

WORDS, DISTANCE, SEED = 4, 4, 42
#: Fingerprints the split and the thresholds are tuned on, and fingerprints of one bucket compared in one task.
SAMPLE, BLOCK = 4096, 4096
#: Cost of moving one probe through the shuffle, in comparisons of two fingerprints.
PROBE_COST = 20.0
_PAIRS = 1 << 21


# --- fingerprints -----------------------------------------------------------------------------

def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64; 0 for a text without words."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    n = max(len(found) - words + 1, 1)
    starts, stops = (ends - size)[:n], ends[-n:]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 16):
        spans = zip(starts[a:a + (1 << 16)].tolist(), stops[a:a + (1 << 16)].tolist())
        h = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit one byte
        votes += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row_hash, fp) per row; ``row_hash`` tells rows of one ``doc_id`` with different texts apart."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "row_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"),
                       F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id bigint, row_hash bigint, fp bigint")


# --- plan of the search -----------------------------------------------------------------------

@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """Every change of at most ``threshold`` bits of the part, as a number to xor with."""
        return [_signed(sum(1 << b for b in some)) for k in range(self.threshold + 1) for some in combinations(self.bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of nearly equal size; each group grows by the free bit that correlates most with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0.0
    norm = np.sqrt((bits ** 2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, groups)) + parts - k - 1) // (parts - k)
        own = [max(free, key=lambda b: corr[b][free].max())]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: corr[b][own].sum()))
            free.remove(own[-1])
        groups.append(tuple(sorted(own)))
    return groups


def _near_share(sample: np.ndarray, bits: tuple[int, ...], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t bits of a part, t = 0..most.

    What the sample is too small to show is filled in by independent fair bits.
    """
    w, n = len(bits), len(sample)
    fair = np.cumsum([comb(w, t) for t in range(most + 1)]) / 2.0 ** w
    value = sample & np.uint64(sum(1 << b for b in bits))
    seen = np.zeros(most + 1)
    for a in range(0, n, 512):
        d = np.bitwise_count(value[a:a + 512, None] ^ value[None, :])
        seen += [np.count_nonzero(d <= t) for t in range(most + 1)]
    return ((seen - n) / max(n * (n - 1), 1) + fair).tolist()


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[Part]:
    """Parts and thresholds of least estimated cost for ``total`` fingerprints."""
    best: tuple[float, list[Part]] | None = None
    for m in range(2, distance + 2):
        groups = _group_bits(sample, m)
        # cheapest[r]: (cost, thresholds) of the parts so far that use r of the distance + 1 units
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            share = _near_share(sample, bits, distance)
            probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
            cost = [0.0] + [total * (PROBE_COST * (probes[t] + 1) + total * share[t]) for t in range(distance + 1)]
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, chosen) in cheapest.items():
                for t in range(-1, distance - used + 1):
                    option = (spent + cost[t + 1], [*chosen, t])
                    if used + t + 1 not in step or option < step[used + t + 1]:
                        step[used + t + 1] = option
            cheapest = step
        cost, thresholds = cheapest[distance + 1]
        if best is None or cost < best[0]:
            best = cost, [Part(b, t) for b, t in zip(groups, thresholds) if t >= 0]
    return best[1]


# --- links ------------------------------------------------------------------------------------

def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that join what the links a-b join."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = code[:len(a)], code[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _compare(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by key, stored fingerprints (probe 0) before probes (1) in each."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else first
    stored = np.add.reduceat((probe == 0).astype(np.int64), first) if len(key) else first
    asks = np.flatnonzero((probe == 1) & (stored[group] > 0)) if len(key) else first
    found_a, found_b = [fp[:0]], [fp[:0]]
    width = stored[group[asks]]
    upto = np.cumsum(width)
    at = 0
    while at < len(asks):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
        some, w = asks[at:end], width[at:end]
        other = np.repeat(first[group[some]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        x, y = fp[np.repeat(some, w)], fp[other]
        hit = (y < x) & (np.bitwise_count(x ^ y) <= distance)
        if hit.any():
            a, b = _forest(x[hit], y[hit])
            found_a.append(a)
            found_b.append(b)
        at = end
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return _forest(a, b) if len(a) else (a, b)


def links(fps: DataFrame, parts: list[Part], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(from_id, to_id): links that connect just what the pairs within ``distance`` bits connect; fps: distinct ``fp``."""
    shapes = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(p.mask()).alias("mask")) for k, p in enumerate(parts)])
    value = F.col("fp").bitwiseAND(F.col("s.mask"))
    stored = fps.select("fp", F.explode(shapes).alias("s")).select(F.col("s.part").alias("part"), value.alias("value"), "fp")
    asked = None
    for k, p in enumerate(parts):
        flips = F.explode(F.array(*[F.lit(x) for x in p.flips()]))
        one = fps.select("fp", flips.alias("x")).select(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(p.mask())).bitwiseXOR(F.col("x")).alias("value"), "fp")
        asked = one if asked is None else asked.unionAll(one)
    # blocks of the buckets that one task should not hold: mostly none, so Spark can broadcast the few
    large = CutTable(stored.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
                     .select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    block_of, all_blocks = F.lit(0), F.array(F.lit(0))
    if not large.is_empty():
        stored, asked = (x.join(large.df, ["part", "value"], "left") for x in (stored, asked))
        block_of = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0))
        all_blocks = F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))
    rows = stored.select("part", "value", block_of.alias("block"), F.lit(0).alias("probe"), "fp").unionAll(
        asked.select("part", "value", F.explode(all_blocks).alias("block"), F.lit(1).alias("probe"), "fp"))
    dealt = rows.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "probe")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple | None = None  # the stored rows of a bucket that may go on in the next batch
        for b in batches:
            part, value, blk, probe, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            fp = fp.view(np.uint64)
            fresh = np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (blk[1:] != blk[:-1])] if len(fp) else np.zeros(0, bool)
            key = np.cumsum(fresh)
            if carried is not None and len(fp):
                if carried[0] == (part[0], value[0], blk[0]):
                    held = carried[1]
                    key = np.r_[np.ones(len(held), key.dtype), key]
                    probe, fp = np.r_[np.zeros(len(held), probe.dtype), probe], np.r_[held, fp]
            if len(fp):
                last = key == key[-1]
                carried = (part[-1], value[-1], blk[-1]), fp[last & (probe == 0)]
            x, y = _compare(key, probe, fp, distance)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()), pa.array(y.view(np.int64), pa.int64())], names=["from_id", "to_id"])

    return dealt.mapInArrow(work, "from_id bigint, to_id bigint")


# --- groups -----------------------------------------------------------------------------------

def linked(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node_id, component) of the fingerprints that have a link, over all of ``fps``, a stored table of distinct ``fp``."""
    total = fps.count()
    share = min(1.0, 2.0 * SAMPLE / max(total, 1))
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < F.lit(share * float(1 << 40))).limit(SAMPLE).toPandas()["fp"]
    sample = np.sort(picked.to_numpy(np.int64)).view(np.uint64)
    return components(CutTable(links(fps, plan(sample, total, distance), distance)).df)


def group(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, row_hash, fp, component_id, keeper_hash) per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links; rows with a null ``doc_id`` are linked like any
    other and never name a group that has another id. ``keeper_hash`` is the ``row_hash`` of the group's keeper, so
    that (component_id, keeper_hash) tells which row stays. Texts that are null or have no word share fingerprint 0.
    """
    marked = CutTable(fingerprints(docs, words)).df
    nodes = CutTable(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("low"))).df
    comp = CutTable(linked(nodes.select("fp"), distance)).df
    lows = comp.join(nodes, comp["node_id"] == nodes["fp"]).groupBy("component").agg(F.min("low").alias("lowest"))
    known = comp.join(lows, "component").select(F.col("node_id").alias("fp"), "lowest")
    resolved = CutTable(nodes.join(known, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("low"))).df
    return marked.join(resolved, "fp").select("doc_id", "row_hash", "fp", F.col("low.doc_id").alias("component_id"),
                                             F.col("low.row_hash").alias("keeper_hash"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row; the fingerprint as 16 hexadecimal digits."""
    return group(docs, words, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    own, key, digest = (unused(docs, c) for c in ("_own_hash", "_keep_id", "_keep_hash"))
    keepers = group(docs, words, distance).select(F.col("component_id").alias(key), F.col("keeper_hash").alias(digest)).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest))
    return marked.join(keepers, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
